"""Column functions against the standard library and hand-written expectations."""

import hashlib
import ipaddress
import itertools
import json

import pytest
from pyspark.sql import functions as F

from rulescape.functions import ids, lookups as L, net, score
from rulescape.functions.service import SERVICE_COLUMNS, with_service

TOKENS = [
    "10.20.5.7/8", "10.20.5.7", "0.0.0.0/0", "255.255.255.255/32", "10.0.0.0/255.0.0.0",
    "10.1.2.3/0.0.255.255", "10.0.0.0/255.0.255.0", "10.0.0.0/33", "10.0.0.0/", "/8", "10.0.0/8",
    "010.0.0.0/8", "10.0.0.256/8", "10.0.0.0/8/9", "a/8", "host-1", "", "1.2.3.4/08", "1.2.3.4/-1",
    "192.168.255.1/23", "172.16.9.9/0.0.0.0", "172.16.9.9/255.255.255.255", "1.2.3.4/ 8", " 1.2.3.4/8",
    "::/0", "::1/128", "2001:db8::1/32", "2001:DB8:0:0:1:0:0:1/64", "2001:db8:1:2:3:4:5:6/128",
    "fe80::/10", "1::8:0:0:0:0/128", "::1.2.3.4/128", "64:ff9b::192.0.2.33/96", ":::/8", "1::2::3/8",
    "1:2:3:4:5:6:7/8", "1:2:3:4:5:6:7:8:9/8", "1:2:3:4:5:6:7::/112", "::2:3:4:5:6:7:8/112", "12345::/16",
    "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff/127", "2001:db8::/129", "2001:db8::/ffff::", "g::/8",
    "0:0:1::/48", "a:0:0:b:0:0:0:c/128", "2001:db8::1", "::", "1:2::/64", "1:0:2:0:3:0:4:0/128",
]


def _expected(token):
    try:
        n = ipaddress.ip_network(token, strict=False)
    except ValueError:
        return None
    return n


def test_networks_match_the_standard_library(spark):
    df = spark.createDataFrame([(t,) for t in TOKENS], "t string")
    df = net.with_network(df, "t", "n").withColumns(
        {"txt": net.network_text("n"), "cidr": net.is_cidr("t", "n")})
    for r in df.collect():
        want = _expected(r.t)
        if want is None:
            assert r.n is None and r.txt is None, r
        else:
            assert (r.n.version, r.n.plen, r.txt) == (want.version, want.prefixlen, str(want)), r
        assert r.cidr == (want is not None and "/" in r.t), r


def test_containment_is_equality_of_cut_networks(spark):
    texts = [t for t in TOKENS if _expected(t) is not None]
    pairs = spark.createDataFrame(list(itertools.product(texts, texts)), "a string, b string")
    pairs = net.with_network(net.with_network(pairs, "a", "na"), "b", "nb")
    got = pairs.select("a", "b", ((F.col("na.plen") <= F.col("nb.plen"))
                                  & (F.col("na.version") == F.col("nb.version"))
                                  & (net.parent_at("nb", "na.plen") == F.col("na"))).alias("c")).collect()
    for r in got:
        a, b = _expected(r.a), _expected(r.b)
        assert r.c == (a.version == b.version and b.subnet_of(a)), r


def test_length_sets(spark):
    rows = [("10.0.0.0/8",), ("10.0.0.0/32",), ("2001:db8::/64",), ("::1/128",), ("::/0",)]
    df = net.with_network(spark.createDataFrame(rows, "t string"), "t", "n")
    w = net.length_bits("n")
    words = df.agg(*[F.bit_or(c).alias(f"w{i}") for i, c in enumerate(w)])
    out = words.select(net.lengths_up_to(["w0", "w1", "w2"], "100").alias("x"),
                       net.lengths_up_to(["w0", "w1", "w2"], "128").alias("y")).first()
    assert out.x == [0, 8, 32, 64] and out.y == [0, 8, 32, 64, 128]


SERVICES = [
    # service, port, protocol, app -> protocol, port, port_end, label, l7_app, l7_source
    (("tcp/3389", None, None, None), ("tcp", 3389, None, "tcp/3389", "rdp", "inferred")),
    (("tcp/8000-8100", None, None, None), ("tcp", 8000, 8100, "tcp/8000-8100", None, None)),
    (("any", None, None, None), ("any", None, None, "any", None, None)),
    ((" ANY ", None, None, None), ("any", None, None, "any", None, None)),
    (("quic", None, None, None), ("udp", 443, None, "quic", "quic", "declared")),
    (("QUIC", 444, "TCP", None), ("tcp", 444, None, "quic", "quic", "declared")),
    (("kubernetes", None, None, None), ("tcp", None, None, "kubernetes", "kubernetes", "declared")),
    (("icmp", None, None, None), ("icmp", None, None, "icmp", None, None)),
    (("weird", None, None, None), ("tcp", None, None, "weird", None, None)),
    (("foo/80", None, None, None), ("tcp", 80, None, "foo/80", "http", "inferred")),
    (("udp/443", None, None, None), ("udp", 443, None, "udp/443", "quic", "inferred")),
    (("any/443", None, None, None), ("any", 443, None, "any/443", None, None)),
    (("tcp/x", None, None, None), ("tcp", None, None, "tcp/x", None, None)),
    (("tcp/80-x", None, None, None), ("tcp", None, None, "tcp/80-x", None, None)),
    (("tcp/-5", None, None, None), ("tcp", None, None, "tcp/-5", None, None)),
    (("tcp/ 80 - 90 ", None, None, None), ("tcp", 80, 90, "tcp/ 80 - 90", "http", "inferred")),
    (("", 443, "udp", None), ("udp", 443, None, "udp/443", "quic", "inferred")),
    ((None, None, None, None), ("tcp", None, None, "tcp", None, None)),
    ((None, 8443, "tcp", None), ("tcp", 8443, None, "tcp/8443", "tls", "inferred")),
    ((None, None, "icmp", None), ("icmp", None, None, "icmp", None, None)),
    ((None, 99, "bogus", None), ("tcp", 99, None, "tcp/99", None, None)),
    ((None, None, None, "quic"), ("udp", 443, None, "quic", "quic", "declared")),
    (("tcp/22", None, None, " DNS "), ("udp", 53, None, "dns", "dns", "declared")),
    (("tcp/22", None, None, "nonsense"), ("tcp", 22, None, "tcp/22", "ssh", "inferred")),
    ((None, 5432, "tcp", ""), ("tcp", 5432, None, "tcp/5432", "postgresql", "inferred")),
]


def test_service_decode(spark):
    df = spark.createDataFrame([(i, *s) for i, (s, _) in enumerate(SERVICES)],
                               "i int, s string, p int, pr string, a string")
    out = with_service(df, "s", "p", "pr", "a").orderBy("i")
    for r, (given, want) in zip(out.select(*SERVICE_COLUMNS).collect(), SERVICES):
        assert tuple(r) == want, (given, tuple(r))


def test_severity_rounding_over_the_whole_grid(spark):
    Es = [1.0, 0.9, 0.7, 0.5, 0.3, 0.1]
    Ps = [1.0, 0.9, 0.85, 0.4, 0.5]
    Ds = [1.0, 0.9, 0.6, 0.4, 0.2]
    Bs = [1.0, 1.25, 1.5]
    grid = list(itertools.product(Es, Ps, Ds, Bs))
    df = spark.createDataFrame(grid, "E double, P double, D double, B double")
    got = df.withColumn("s", score.severity("E", "P", "D", "B")).collect()
    for r in got:
        raw = r.D * (0.5 + 0.5 * r.P) * (0.4 + 0.6 * r.E) * r.B
        assert r.s == round(100 * min(raw, 1.0)), r
    assert [r.b for r in spark.createDataFrame([(0,), (34,), (35,), (59,), (60,), (79,), (80,)], "s int")
            .select(score.band("s").alias("b")).collect()] == \
        ["low", "low", "medium", "medium", "high", "high", "critical"]


def test_exposure_bands(spark):
    rows = [("cidr", 0, 1.0), ("cidr", 1, .9), ("cidr", 8, .9), ("cidr", 9, .7), ("cidr", 16, .7), ("cidr", 23, .5),
            ("cidr", 24, .3), ("cidr", 28, .1), ("cidr", 64, .1), ("cidr", None, .1), ("identity", 0, .1)]
    df = spark.createDataFrame(rows, "k string, n int, want double")
    for r in df.withColumn("e", score.exposure("k", "n")).collect():
        assert r.e == r.want, r


def test_zones_and_tags(spark):
    rows = [("0.0.0.0/0", [], "internet", .4), ("a", ["dev", "dmz"], "dmz", .4), ("a", ["sandbox"], "dev", .2),
            ("a", None, "internal", .4), ("a", ["prod", "pci"], "internal", .9), ("a", ["x"], "internal", .4)]
    df = spark.createDataFrame(rows, "n string, t array<string>, z string, d double")
    for r in df.withColumns({"gz": score.zone("n", "t"),
                             "gd": score.dest_sensitivity("t")}).collect():
        assert (r.gz, r.gd) == (r.z, r.d), r


def test_token_cost(spark):
    key, (i, o) = next(iter(L.TOKEN_PRICES.items()))
    provider, model = key.split(":")
    df = spark.createDataFrame([(provider, model, 1_000_000, 500_000), ("ollama", model, 5, 5), ("x", "y", 5, 5)],
                               "p string, m string, a long, b long")
    got = [r.c for r in df.select(score.token_cost("p", "m", "a", "b").alias("c")).collect()]
    assert got == [round(i + 0.5 * o, 6), 0.0, 0.0]


@pytest.mark.parametrize("text", ["plain", 'q"b\\s', "tab\tnl\n\x1f\x7f", "ünï", "emoji 😀", ""])
def test_ids_match_python(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(ids.json_text(F.col("t")).alias("j"), ids.stable_id("F", F.lit("snap"), F.col("t")).alias("d")).first()
    assert r.j == json.dumps(text)
    assert r.d == "F_" + hashlib.sha1(f"snap\x1f{text}".encode()).hexdigest()[:16]


def _records(spark, n=300):
    return spark.range(n).select(
        F.lit("t").alias("source_tool"), F.concat(F.lit("r"), "id").alias("raw_ref"), F.lit("s").alias("source"),
        F.lit("d").alias("destination"), F.lit("any").alias("service"), F.lit("allow").alias("action"),
        F.when(F.col("id") % 2 == 0, F.col("id")).cast("int").alias("order"))


def test_fingerprint_is_one_scheme_at_every_size(spark):
    for n in (0, 10, 300, 60_000):
        df = _records(spark, n)
        words = [0] * 4
        for i in range(n):
            h = hashlib.sha256(f"t|r{i}|s|d|any|allow|{i if i % 2 == 0 else None}".encode()).hexdigest()
            words = [w + int(h[15 * k:15 * k + 15], 16) for k, w in enumerate(words)]
        total = "|".join(str(v) for v in (n, *words)) if n else "0"
        assert ids.fingerprint(df).first()[0] == "sum:" + hashlib.sha1(total.encode()).hexdigest()
        assert ids.fingerprint(df.repartition(7)).first()[0] == ids.fingerprint(df).first()[0]
    assert ids.fingerprint(df).first()[0] != ids.fingerprint(df.filter("raw_ref <> 'r7'")).first()[0]
