"""The estate's shared steps move and write only what is asked, and give the same rows."""

from pyspark.sql import functions as F

from rulescape.operators import graph, paths
from rulescape.operators.detect import nesting
from rulescape.operators.scratch import cut
from rulescape.plans import snapshot
from rulescape.sources import normalize
from rulescape.workload import core
from rulescape.workload.estate import Estate

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(repr(r) for r in df.select(*sorted(df.columns)).collect())


def test_ranking_moves_no_texts(spark, monkeypatch):
    written = []
    monkeypatch.setattr(snapshot, "cut", lambda df: written.append(df.columns) or cut(df))
    core.findings_ranked(spark, SF)
    assert [c for c in written if "_range" in c] and not [c for c in written if "_range" in c and "signals" in c]


def test_rules_of_one_catalog_are_placed_as_if_they_were_resolved_first(spark):
    e = Estate(spark, SF)
    found = normalize.normalize(e.parsed, by_tool=False)
    assert _rows(e.entities) == _rows(found.entities)
    names = cut(graph.directory(snapshot.resolve_identities(found.entities)))
    placed = normalize.shared_placed(e.parsed, names)
    assert _rows(placed) == _rows(graph.place(found.records, names))
    # one join an end
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2


def test_ends_unknown_to_the_names_keep_their_facts(spark):
    rules = spark.sql("""SELECT * FROM VALUES (1, 'a', 'b', 'allow'), (2, '10.0.0.0/8', 'c', 'deny'), (3, 'c', 'zz', 'allow')
                         AS t(record_seq, src, dst, action)""")
    catalog = spark.sql("""SELECT * FROM VALUES ('a', '10.0.0.1', array('pci')), ('b', '10.0.0.2', array('dmz')),
                           ('10.0.0.0/8', '10.9.9.9', array('dev')) AS t(name, ip, tags)""")
    parsed = normalize.Parsed(
        normalize.shaped(rules, normalize.RULE, source_tool="'cloud'", tool_rank="2", raw_ref="CAST(record_seq AS string)", service="'tcp/443'"),
        normalize.shaped(catalog, normalize.CATALOG), normalize.shaped(catalog.limit(0), normalize.SEEN), catalog.limit(0))
    found = normalize.normalize(parsed, by_tool=False)
    assert _rows(normalize.shared_entities(parsed)) == _rows(found.entities)
    names = graph.directory(snapshot.resolve_identities(found.entities)).filter("name <> 'b'")
    assert _rows(normalize.shared_placed(parsed, names)) == _rows(graph.place(found.records, names))


def test_only_edges_that_a_path_can_use_are_grouped_for_paths(spark, monkeypatch):
    e = Estate(spark, SF)
    grouped = []
    monkeypatch.setattr(snapshot, "cut", lambda df: grouped.append(df) or cut(df))
    few = e.view.passing.count()
    monkeypatch.undo()
    assert not [df for df in grouped if "n_grants" in df.columns and df.filter("s_kind <> 'concrete' AND s <> '0.0.0.0/0'").count()]
    every = graph.edges(e.view.placed)
    assert 0 < few < every.count()
    assert _rows(paths.internet_paths(every, e.view.nodes)) == _rows(e.internet_paths)


def test_rules_without_a_rival_ask_no_keys(spark):
    e = Estate(spark, SF)
    ordered = nesting.ordered_rules(e.view.placed)
    some = nesting.rivals(ordered)
    assert some.count() < ordered.count()
    # as without leaving any out
    probes = nesting.probing_keys(ordered, nesting.group_lengths(ordered.filter("src_net IS NOT NULL"), nesting.SHADOW_GROUP))
    hit = probes.join(nesting.first_covering(ordered), nesting._KEY).filter(F.col("cover.pos") < nesting.position())
    want = hit.groupBy("record_seq").agg(F.min_by("cover", F.col("cover.pos")).alias("cover"))
    assert want.count() > 0 and _rows(nesting.shadowers(ordered)) == _rows(want)
    # an open rule covers every service, whatever its slot
    def rule(i, service):
        return (i, "t", "host", "10.0.0.0/8", "allow", service, "any" if service == "any" else "tcp", i, f"R{i}")
    made = spark.createDataFrame([rule(i, s) for i, s in enumerate(["any", "tcp/1", "tcp/2", "tcp/3", "any"])],
                                 "record_seq long, source_tool string, d string, source string, action string, service string, "
                                 "protocol string, `order` int, raw_ref string")
    made = normalize.with_endpoint(made.withColumnRenamed("source", "token"), "token", "source").withColumnRenamed("source_net", "src_net")
    got = {r.record_seq: r.cover.pos.raw_ref for r in nesting.shadowers(nesting.ordered_rules(made)).collect()}
    assert got == {1: "R0", 2: "R0", 3: "R0", 4: "R0"}
