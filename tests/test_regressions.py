"""Cases that once went wrong, on tiny tables."""

import pytest
from pyspark.sql import functions as F

from rulescape import schemas
from rulescape.operators import change, scratch
from rulescape.plans.snapshot import build_view
from rulescape.sources.exports import normalize_microseg, parse_microseg


def _microseg(spark, *policies, name="x"):
    labels = {"lb": ("lb", "e", []), "app": ("app", "e", []), "db": ("db", "e", ["pci"])}
    rules = [(f"{name}-{i}", s, d, 443, "tcp", None, "allow", name) for i, (s, d) in enumerate(policies)]
    return spark.createDataFrame([("v", name, labels, rules)], schemas.MICROSEG_EXPORT)


@pytest.mark.parametrize("with_internet", [False, True])
def test_a_proposal_opens_the_internet_to_an_estate_without_it(spark, with_internet):
    source = normalize_microseg(_microseg(spark, ("lb", "db")))
    view = build_view(source.records, source.entities, materialize=True)
    asked = spark.createDataFrame([("c1", "0.0.0.0/0", "lb", "tcp/443", "allow"), ("c2", "0.0.0.0/0", "nowhere", "tcp/443", "allow"),
                                   ("c3", "ghost", "lb", "tcp/443", "allow")],
                                  "change_id string, source string, destination string, service string, action string")
    nodes = view.nodes
    if with_internet:
        nodes = change.with_ends(nodes, spark.createDataFrame([("0.0.0.0/0",)], "node string"))
    placed = change.propose(asked, view.names, nodes)
    opened = scratch.cut(change.new_paths(placed, view.edges, nodes))
    assert [(r.change_id, r.path, r.boundary) for r in opened.collect()] == [("c1", ["0.0.0.0/0", "lb", "db"], "internet->internal")]
    delta = {r.change_id: r for r in change.change_delta(placed, opened).collect()}
    assert delta["c1"].forced_escalate and delta["c1"].n_exposed == 1 and delta["c3"].n_new_paths == 0


def _orders(spark, edits, orders):
    e = spark.createDataFrame(edits, "at int, op string, target_ref string, shadowing_ref string")
    o = spark.createDataFrame(orders, "raw_ref string, `order` int")
    return {r["at"]: r["new_order"] for r in change._orders(e, o).collect()}


def test_reorders_without_effect_are_no_links(spark):
    got = _orders(spark, [(1, "reorder_before", "X", "Y"), (2, "reorder_before", "X", "missing"), (3, "reorder_before", "Z", "X")],
                  [("X", 100), ("Y", 50), ("Z", 10)])
    assert got == {1: 49, 3: 48}
    got = _orders(spark, [(1, "reorder_before", "X", "Y"), (2, "remove", "Y", None), (3, "reorder_before", "X", "Y"), (4, "reorder_before", "Z", "X")],
                  [("X", 100), ("Y", 50), ("Z", 10)])
    assert got == {1: 49, 4: 48}


def test_a_long_chain_of_reorders(spark):
    n = 300
    got = _orders(spark, [(i, "reorder_before", f"r{i}", f"r{i - 1}") for i in range(1, n)], [(f"r{i}", 1000 + i) for i in range(n)])
    assert got == {i: 1000 - i for i in range(1, n)}


def test_rules_of_several_documents_keep_their_own_keys(spark):
    first, second = _microseg(spark, ("lb", "db"), ("lb", "app"), name="a"), _microseg(spark, ("lb", "db"), ("app", "db"), name="b")
    rules = parse_microseg(first.unionByName(second).unionByName(first)).rules
    rows = rules.orderBy("record_seq").collect()
    assert len(rows) == len({r.record_seq for r in rows}) == 4
    by_document = [[r.raw_ref for r in rows[:2]], [r.raw_ref for r in rows[2:]]]
    assert sorted(by_document) == [["a-0", "a-1"], ["b-0", "b-1"]]


def test_a_cluster_must_name_its_scratch_folder():
    class Context:
        master = "spark://head:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.folder(Session())


def test_fallback_findings_name_one_rule_of_each_side_at_any_size(spark):
    from rulescape.operators.detect.rules import fallback_refs, tls_fallback

    rows = [(f"R{i:03d}", "t", i, "tcp" if i % 2 else "udp", 443) for i in range(50)]
    placed = spark.createDataFrame(rows, "raw_ref string, source_tool string, record_seq long, protocol string, port int").withColumns({
        "action": F.lit("allow"), "d": F.lit("D"), "d_display": F.lit("D"), "source": F.lit("s"), "source_kind": F.lit("identity"),
        "src_net": F.expr("CAST(NULL AS struct<plen:int>)"), "dest_tags": F.array(F.lit("pci")), "src_zone": F.lit("internal"), "dst_zone": F.lit("internal")})
    found = tls_fallback(placed).first()
    assert found.raw_refs == ["R000", "R001"] and '"n_tcp":25,"n_udp":25' in found.signals and '"udp_ref":"R000"' in found.signals
    assert fallback_refs(placed).count() == 50
