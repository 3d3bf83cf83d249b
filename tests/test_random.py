"""Joins and loops against brute force on small random estates."""

import ipaddress
import itertools
import random

import pytest
from pyspark.sql import functions as F

from rulescape.functions import net
from rulescape.operators import paths
from rulescape.operators.components import components
from rulescape.operators.detect import nesting
from rulescape.sources import profile, tables

POOL = ["0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.3/32", "172.16.0.0/12", "::/0", "2001:db8::/32",
        "2001:db8::/64", "2001:db8::1/128", "host-a", "host-b"]


@pytest.fixture(scope="module")
def rules():
    rng = random.Random(7)
    out = []
    for i in range(160):
        src = rng.choice(POOL)
        service = rng.choice(["tcp/443", "tcp/443", "udp/53", "any"])
        out.append((i, f"R{rng.randrange(1000):03d}-{i}", rng.choice("ab"), src, rng.choice(["x", "x", "y"]), service,
                    "any" if service == "any" else service[:3], rng.choice(["allow", "allow", "deny"]), rng.choice([None, 1, 2, 3, 4, 5])))
    return out


@pytest.fixture(scope="module")
def placed(spark, rules):
    df = spark.createDataFrame(rules, "record_seq long, raw_ref string, source_tool string, source string, destination string, "
                                      "service string, protocol string, action string, `order` int")
    df = net.with_network(df, "source", "src_net").withColumns({
        "source_kind": F.when(F.col("source").contains("/"), "cidr").otherwise("identity"), "dest_tags": F.array(F.lit("prod")),
        "port": F.lit(443), "s": F.col("source"), "d": F.col("destination"), "src_zone": F.lit("internal"),
        "dst_zone": F.lit("internal"), "s_display": F.col("source"), "d_display": F.col("destination")})
    return df.withColumn("src_net", F.when(F.col("source_kind") == "cidr", F.col("src_net")))


def _network(text):
    return ipaddress.ip_network(text) if "/" in text else None


def _inside(inner, outer):
    a, b = _network(inner), _network(outer)
    return a is not None and b is not None and a.version == b.version and a.subnet_of(b)


def test_overlap(rules, placed):
    want = set()
    for a, b in itertools.combinations([r for r in rules if r[7] == "allow" and "/" in r[3]], 2):
        if (a[2], a[4], a[5]) == (b[2], b[4], b[5]) and (_inside(a[3], b[3]) or _inside(b[3], a[3])):
            first, second = sorted([a, b], key=lambda r: r[1])
            outer = second if _inside(first[3], second[3]) else first
            want.add((first[1], second[1], outer[3]))
    found = nesting.cidr_overlap(placed).select("raw_refs", F.get_json_object("signals", "$.outer").alias("o")).collect()
    got = [(*r.raw_refs, r.o) for r in found]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_network_forest(spark, rules, placed):
    allowed = [r for r in rules if r[7] == "allow" and "/" in r[3]]
    classes = {}
    for r in allowed:
        classes.setdefault((r[2], r[4], r[5], r[3]), []).append(r[1])
    want = set()
    for (tool, dest, service, net_), refs in classes.items():
        above = [(k[3], v) for k, v in classes.items() if k[:3] == (tool, dest, service) and k[3] != net_ and _inside(net_, k[3])]
        parent = max(above, key=lambda a: _network(a[0]).prefixlen, default=(None,))[0]
        n, n_above = len(refs), sum(len(v) for _, v in above)
        want.add((tool, dest, service, net_, n, min(refs), parent, n_above, n * (n - 1) // 2 + n * n_above))
    got = [tuple(r) for r in nesting.network_forest(placed).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r[-1] for r in got) == nesting.cidr_overlap(placed).count()
    # a network with very many rules stays one row with an exact count
    hot = placed.filter("raw_ref IS NOT NULL AND action = 'allow' AND source = '10.0.0.0/8'").limit(1)
    many = hot.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(200_000)))).withColumn("raw_ref", F.concat("raw_ref", F.lit("-"), F.col("i"))).drop("i")
    rows = nesting.network_forest(many).collect()
    assert len(rows) == 1 and rows[0].n_pairs == 200_000 * 199_999 // 2


def test_shadowing(rules, placed):
    want = {}
    for tool in "ab":
        run = sorted([r for r in rules if r[2] == tool and r[8] is not None], key=lambda r: (r[8], r[1]))
        for i, later in enumerate(run):
            for early in run[:i]:
                covers = _inside(later[3], early[3]) or ("/" not in later[3] and early[3] == later[3])
                service = "any" in (early[6], later[6]) or early[5] == later[5]
                if early[4] == later[4] and service and covers:
                    want[later[1]] = early[1]
                    break
    got = {r.a: r.b for r in nesting.shadowed_rules(placed).select(
        F.get_json_object("signals", "$.shadowed_ref").alias("a"), F.get_json_object("signals", "$.shadowing_ref").alias("b")).collect()}
    assert got == want and want


def test_components(spark):
    rng = random.Random(3)
    links = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [
        (f"c{i:02d}", f"c{i + 1:02d}") for i in range(20)] + [("hub", f"leaf{i}") for i in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = sorted([find(a), find(b)])
        root[y] = x
    linked = {x for a, b in links for x in (a, b) if a != b}
    got = {r.name: r.root for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {n: find(n) for n in linked}


def _edges(spark, pairs, concrete):
    df = spark.createDataFrame([(s, d) for s, d in pairs], "s string, d string")

    def kind(c):
        return F.when(F.col(c).isin(sorted(concrete)), "concrete").otherwise("abstract")
    grant = F.struct(F.lit("t").alias("source_tool"), F.concat("s", F.lit(">"), "d").alias("raw_ref"), F.lit("any").alias("service"),
                     F.lit(None).cast("string").alias("l7_app"), F.lit(None).cast("string").alias("l7_source"))
    text = F.array().cast("array<string>")
    return df.withColumns({"s_kind": kind("s"), "d_kind": kind("d"), "s_display": F.col("s"), "d_display": F.col("d"),
                           "tools": F.array(F.lit("t")), "services": text, "apps": text, "rep": grant})


def _walks(pairs, concrete, start, goals, most):
    out, stack = set(), [[start]]
    while stack:
        p = stack.pop()
        for s, d in pairs:
            if s == p[-1] and d not in p and len(p) <= most and (len(p) == 1 or p[-1] in concrete):
                q = p + [d]
                if d in goals:
                    out.add(tuple(q))
                stack.append(q)
    return out


def test_simple_paths(spark):
    rng = random.Random(11)
    names = [f"v{i}" for i in range(9)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(26)})
    concrete = set(names) - {"v3", "v7"}
    edges = _edges(spark, pairs, concrete)
    one = spark.createDataFrame([("*", "v0")], "goal string, node string")
    goals = spark.createDataFrame([("*", n) for n in ("v4", "v5", "v7")], "goal string, node string")
    got = [tuple(r.path) for r in paths.simple_paths(paths.hop_edges(edges), one, goals, True, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == _walks(pairs, concrete, "v0", {"v4", "v5", "v7"}, 5) and got
    targets = spark.createDataFrame([("v4",), ("v7",)], "target string")
    reach = {(r.target, r.source) for r in paths.who_can_reach(targets, edges).collect()}
    want = {(t, n) for t in ("v4", "v7") for n in names if n != t and _walks(pairs, set(names), n, {t}, 9)}
    assert reach == want


def test_profile(spark, tmp_path):
    (tmp_path / "doc.json").write_text("""{"policies": [
        {"from": "10.0.0.5/8", "to": "db", "svc": "tcp/5432", "do": "allow"}, {"from": "web", "to": "db", "svc": "quic", "do": "drop", "name": "P2"},
        {"from": "web", "to": 7, "svc": "any", "do": "deny"}], "things": {"db": {"value": "10.9.9.9", "type": "host", "tags": ["pci"]},
        "web": {"value": "10.8.0.0/16", "type": "network"}}}""")
    p = profile.SourceProfile("sd_wan", "policies", profile.FieldMap("from", "to", action="do", service="svc", ref="name"), "things")
    docs = profile.read_documents(spark, str(tmp_path / "doc.json"))
    out = profile.apply_profile(docs, p)
    rows = [(r.raw_ref, r.source, r.source_kind, r.destination, r.service, r.action, r.order, r.dest_tags, r.l7_app)
            for r in out.records.orderBy("record_seq").collect()]
    assert rows == [("SD_WAN-1", "10.0.0.0/8", "cidr", "db", "tcp/5432", "allow", 10, ["pci"], "postgresql"),
                    ("P2", "web", "identity", "db", "quic", "allow", 20, ["pci"], "quic"),
                    ("SD_WAN-3", "web", "identity", "7", "any", "deny", 30, [], None)]
    ents = {r.name: (r.ip, r.cidr, r.abstract) for r in out.entities.collect()}
    assert ents == {"10.0.0.0/8": (None, "10.0.0.0/8", True), "db": ("10.9.9.9", None, False), "web": (None, "10.8.0.0/16", False),
                    "7": (None, None, False)}
    assert out.resolved.count() == 2
    checked, sample = profile.validate_profile(docs, p)
    assert tuple(checked.first()) == (True, 3, 4) and sample.count() == 3
    empty = profile.validate_profile(docs, profile.SourceProfile("x", "nothing", profile.FieldMap("a", "b")))[0].first()
    assert (empty.valid, empty.records) == (False, 0)


def test_upsert_keeps_columns_the_batch_lacks(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, note string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    got = sorted(tuple(r) for r in tables.upsert(old, new.drop("n"), ["k"]).select("k", "note").collect())
    assert got == [(1, "x"), (2, "y"), (3, None)]
    last = tables.last_of_batch(new, ["k"], F.col("n")).select("k", "v").collect()
    assert sorted(tuple(r) for r in last) == [(2, "d"), (3, "e")]
