"""Strong components and reach against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from rulescape.operators.condense import Reach, strong_components


def _closure(pairs):
    ways = {}
    for s, d in pairs:
        ways.setdefault(s, set()).add(d)
        ways.setdefault(d, set())
    out = {}
    for n in ways:
        seen, stack = {n}, [n]
        while stack:
            for d in ways[stack.pop()] - seen:
                seen.add(d)
                stack.append(d)
        out[n] = seen
    return out


def _graphs():
    rng = random.Random(2)
    ring = [(f"r{i:02d}", f"r{(i + 1) % 14:02d}") for i in range(14)]
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(20)]
    # a long way round that comes back through the middle of a component, with smaller names than its hub
    handles = [("m", "a1"), ("a1", "a2"), ("a2", "a3"), ("a3", "m"), ("m", "z1"), ("z1", "z2"), ("z2", "m"), ("z1", "q"), ("x", "a2")]
    hub = [("hub", f"l{i}") for i in range(12)] + [(f"l{i}", "hub") for i in range(0, 12, 3)]
    yield ring + chain + handles + hub + [("c05", "r03"), ("r07", "c09"), ("hub", "m"), ("own", "own")]
    for n, m in ((14, 30), (40, 55)):
        yield [(f"v{rng.randrange(n):02d}", f"v{rng.randrange(n):02d}") for _ in range(m)]


@pytest.mark.parametrize("pairs", list(_graphs()), ids=range(3))
def test_components_and_reach(spark, pairs):
    ways = _closure(pairs)
    want = {n: min(m for m in seen if n in ways[m]) for n, seen in ways.items()}
    df = spark.createDataFrame(pairs + pairs[:3] + [(None, "v01")], "s string, d string")
    got = [tuple(r) for r in strong_components(df).collect()]
    expected = dict(want)
    if "v01" not in ways:
        expected["v01"] = "v01"
    assert len(got) == len(expected) and dict(got) == expected
    asked = sorted(ways)[::3] + ["nowhere", None]
    reach = Reach(spark.createDataFrame([(t,) for t in asked], "target string"), df)
    sources = {t: {n for n, seen in ways.items() if t in seen and n != t} for t in asked if t}
    listed = [tuple(r) for r in reach.pairs().collect()]
    assert len(listed) == len(set(listed)) and set(listed) == {(t, n) for t, of in sources.items() for n in of}
    assert dict(map(tuple, reach.counts().collect())) == {t: len(of) for t, of in sources.items()}
    one = sorted(ways)[0]
    assert {r.target for r in reach.from_node(one).collect()} == {t for t, of in sources.items() if one in of}


def test_one_cycle_of_many_nodes_is_one_component(spark):
    n = 100_000
    ring = spark.range(n).select(F.format_string("n%06d", "id").alias("s"), F.format_string("n%06d", (F.col("id") + 1) % n).alias("d"))
    row = strong_components(ring).agg(F.count_distinct("component").alias("parts"), F.count(F.lit(1)).alias("nodes"), F.min("component").alias("name")).first()
    assert tuple(row) == (1, n, "n000000")


def test_no_edges(spark):
    none = spark.createDataFrame([], "s string, d string")
    assert strong_components(none).count() == 0
    reach = Reach(spark.createDataFrame([("t",)], "target string"), none)
    assert reach.pairs().count() == 0 and tuple(reach.counts().first()) == ("t", 0)


def test_siblings_of_one_flow_are_counted_not_paired(spark):
    from rulescape.operators import staging

    n = 50_000
    staged = spark.range(n).select(
        F.format_string("s%06d", "id").alias("staged_id"), F.lit("add_allow").alias("kind"), F.lit("fw").alias("target_tool"),
        F.when(F.col("id") % 5 == 0, "rolled_back").otherwise("staged").alias("status"), F.lit("10.0.0.0/8").alias("source"),
        F.lit("db").alias("destination"), F.lit("tcp/443").alias("service"), F.lit(None).cast("string").alias("target_ref"))
    names = spark.createDataFrame([("db", "db")], "name string, node string")
    assert [tuple(r) for r in staging.sibling_classes(staged, names).collect()] == [("fw", "db", "10.0.0.0/8", n, n * 4 // 5, "s000001")]
    live = n * 4 // 5
    counts = staging.sibling_members(staged, names).groupBy("n_siblings").count().collect()
    assert {(r[0], r[1]) for r in counts} == {(live, n - live), (live - 1, live)}
