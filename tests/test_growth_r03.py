"""Cases that went wrong on larger tables only, made small."""

from pyspark.sql import functions as F

from rulescape import schemas
from rulescape.operators import condense, suggest
from rulescape.plans import snapshot
from rulescape.sources import normalize
from rulescape.sources.exports import normalize_firewall, parse_firewall


def _firewall_read_twice(spark):
    """One document as two reads give it: the map of objects is built in another order."""
    objects = {"a": ("host", "10.0.0.1", ["pci"]), "b": ("network", "10.1.0.0/16", ["dev"])}
    rules = [("R1", 1, "x", "a", "tcp/443", None, "allow", "n"), ("R2", 2, "x", "b", "tcp/22", None, "deny", "n")]
    one = spark.createDataFrame([("v", "rules", "fw-1", "", objects, rules)], schemas.FIREWALL_EXPORT)
    turned = one.withColumn("objects", F.map_from_entries(F.reverse(F.map_entries("objects"))))
    return one.unionByName(turned)


def test_rules_of_a_document_meet_its_objects_whatever_the_order_of_a_map(spark):
    records = normalize_firewall(_firewall_read_twice(spark)).records
    assert sorted((r.raw_ref, r.dest_ip, tuple(r.dest_tags)) for r in records.collect()) == [
        ("R1", "10.0.0.1", ("pci",)), ("R2", None, ("dev",))]


def test_objects_of_a_document_are_listed_once_whatever_the_order_of_a_map(spark):
    resolved = normalize_firewall(_firewall_read_twice(spark)).resolved
    assert sorted((r.source_device, r.object_name) for r in resolved.collect()) == [("fw-1", "a"), ("fw-1", "b")]


def test_components_without_a_way_in_take_no_part_in_the_rounds_of_reach(spark, monkeypatch):
    chain, leaves = 12, 40
    edges = [(f"n{i + 1:02d}", f"n{i:02d}") for i in range(chain)]
    edges += [(f"leaf{j}", f"n{i:02d}") for i in range(chain) for j in range(leaves)]
    pairs = spark.createDataFrame(edges, "s string, d string")
    asked = spark.createDataFrame([("n00",), ("n05",), ("leaf3",)], "target string")
    looked = []
    back = condense._back
    monkeypatch.setattr(condense, "_back", lambda links, ring: looked.append(links.count()) or back(links, ring))
    reach = condense.Reach(asked, pairs)
    assert max(looked[:-1]) < chain  # inner links only; the leaves are looked up once, at the end
    assert {r.target: r.n_sources for r in reach.counts().collect()} == {"n00": chain + leaves, "n05": chain - 5 + leaves, "leaf3": 0}
    got = reach.pairs().collect()
    assert len(got) == len(set(got)) == 2 * leaves + chain + chain - 5


def test_suggestions_by_matrices_are_those_of_all_pairs(spark):
    vectors = [[1.0, 0.0, 0.2], [0.9, 0.1, 0.0], [0.0, 1.0, 0.0], None, [0.0, 0.0, 0.0], [1.0, 0.0], [1.0, None, 0.2],
               [float("nan"), 0.0, 1.0], [1e-200, 0.0, 0.0], [-1.0, 0.0, -0.2], [1e160, 1.0, 0.0], [1.0, 0.0]]
    tags = [["pci"], ["pci", "phi"], ["pci", "phi"], ["customer-data", "pci", "phi"]]
    rows = [(f"a{i:02d}", "concrete", tags[i % 4] if i % 5 else ["phi"], [f"10.0.0.{i // 3 if i < 6 else i}/32"], ["cloud"])
            for i in range(3 * len(vectors))]
    assets = spark.createDataFrame(rows, "asset_key string, kind string, tags array<string>, ip_set array<string>, source_tools array<string>")
    given = spark.createDataFrame([(f"a{i:02d}", vectors[i % len(vectors)]) for i in range(3 * len(vectors))],
                                  "asset_key string, vector array<double>")
    every = suggest.suggest_merges(assets, given, 0.0).collect()
    for least in (0.41, 0.5, 0.6, 0.9):
        got = [repr(r) for r in suggest.suggest_merges(assets, given, least).collect()]
        want = [repr(r) for r in every if r.confidence >= least or r.confidence != r.confidence]
        assert len(want) > 5 and sorted(got) == sorted(want)
    # cells of one tag meet as matrices: no join pairs all assets of a cell
    plan = suggest.suggest_merges(assets, given, 0.6)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_a_view_groups_no_edges_until_they_are_asked_for(spark, monkeypatch):
    written = []
    monkeypatch.setattr(snapshot, "cut", lambda df: written.append(df.columns) or df)
    source = normalize_firewall(_firewall_read_twice(spark))
    view = snapshot.build_view(source.records, source.entities, materialize=True)
    assert not [c for c in written if "n_grants" in c]
    assert view.edges is view.edges and [r.n_grants for r in view.edges.collect()] == [1]
    assert len([c for c in written if "n_grants" in c]) == 1


def test_resolved_rules_are_written_without_what_no_step_reads(spark, monkeypatch):
    written = []
    monkeypatch.setattr(normalize, "cut", lambda df: written.append(df.columns) or df)
    export = parse_firewall(_firewall_read_twice(spark))
    records = normalize.normalize(export, materialize=True).records
    assert records.count() == 2 and not {"src", "dst", "src_named", "dst_named", "destination_net"} & set(written[0])
