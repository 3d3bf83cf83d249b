"""Registered queries: decoding, scoring, detectors, identities, graph and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, score
from ..functions.service import with_service
from ..operators import condense, graph, paths
from ..operators.detect import nesting, rules
from ..plans import snapshot
from ..sources.normalize import with_endpoint
from .estate import LABEL, estate
from .oracle import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, **ctes: str):
    """Register a query under its function's name, with the SQL that must give the same rows."""
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = sql(oracle, **ctes)
        return fn
    return register


def csv(column: str, sep: str = ",") -> F.Column:
    return F.array_join(column, sep).alias(column)


# ---- decoding and scoring --------------------------------------------------

@query("""SELECT r.raw_ref, d.protocol, d.port, d.port_end, r.service, d.l7_app, d.l7_source
          FROM td_rule r JOIN decoded d ON d.rule_order = r.rule_order""")
def service_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_service(estate(spark, sf_dir).rules, "service")
    return out.select("raw_ref", "protocol", "port", "port_end", "service", "l7_app", "l7_source")


@query("SELECT ref AS raw_ref, source, source_kind, plen AS prefix_len, lo AS network_start FROM rec")
def cidr_columns(spark, sf_dir):
    out = with_endpoint(estate(spark, sf_dir).rules, "src_token", "source")
    return out.select("raw_ref", "source", "source_kind", F.col("source_net.plen").alias("prefix_len"),
                      F.expr("shiftrightunsigned(source_net.hi, 32)").alias("network_start"))


@query("""SELECT ref AS raw_ref, round(e, 3) AS e, round(p, 3) AS p, round(d, 3) AS d, round(b, 3) AS b, sev AS severity,
          CASE WHEN sev >= 80 THEN 'critical' WHEN sev >= 60 THEN 'high' WHEN sev >= 35 THEN 'medium' ELSE 'low' END AS band,
          concat(src_zone, '->', dst_zone) AS boundary FROM scored""")
def severity_scores(spark, sf_dir):
    out = rules.scored(estate(spark, sf_dir).view.placed).withColumn("severity", rules.formula())
    return out.select("raw_ref", *[F.round(f, 3).alias(n) for f, n in zip(rules.FACTORS, "epdb")], "severity",
                      score.band("severity").alias("band"), score.boundary("src_zone", "dst_zone").alias("boundary"))


@query("""SELECT tool AS source_tool, ref AS raw_ref, source, source_kind, destination, dest_tags, protocol, port, service, l7_app,
          action, seq AS rule_order FROM rec""")
def canonical_records(spark, sf_dir):
    return estate(spark, sf_dir).normalized.records.select(
        "source_tool", "raw_ref", "source", "source_kind", "destination", csv("dest_tags"), "protocol", "port",
        "service", "l7_app", "action", F.col("order").cast("bigint").alias("rule_order"))


# ---- detectors -------------------------------------------------------------

_BAND = "CASE WHEN {0} >= 80 THEN 'critical' WHEN {0} >= 60 THEN 'high' WHEN {0} >= 35 THEN 'medium' ELSE 'low' END"
_OVER = f"""
SELECT concat('over_permissive|', tool, '|', ref) AS local_key, 'over_permissive' AS type, sev AS severity,
  CASE WHEN forced THEN 'critical' ELSE {_BAND.format('sev')} END AS severity_band, forced AS forced_critical,
  concat(CASE WHEN protocol = 'any' THEN 'any protocol/port' WHEN port = 3389 THEN 'RDP' WHEN port = 443 THEN 'HTTPS'
    WHEN port = 5432 THEN 'PostgreSQL' ELSE service END, ' open from ', CASE WHEN e >= 1 THEN 'the internet' ELSE source END,
    ' to ', destination) AS title, ref AS raw_refs, concat(source, '>', destination) AS involved, n_reasons
FROM (SELECT *, e >= 1 AND (protocol = 'any' OR coalesce(port = 3389, false) OR sensitive) AS forced,
        CAST(protocol = 'any' AS INTEGER) + CAST(e >= 1 AND (p >= 0.85 OR sensitive) AS INTEGER)
        + CAST(sensitive AND e >= 0.3 AS INTEGER) + CAST(p >= 0.85 AND e >= 0.5 AS INTEGER) AS n_reasons
      FROM scored WHERE action = 'allow')
WHERE n_reasons > 0"""
_OVERLAP = f"""
SELECT concat('cidr_overlap|', tool, '|', least(ref, ref2), '|', greatest(ref, ref2)) AS local_key, 'cidr_overlap' AS type,
  sev AS severity, {_BAND.format('sev')} AS severity_band, false AS forced_critical,
  concat('Redundant rules to ', destination, ' (', service, '): ', source, ' already covers ', source2) AS title,
  concat(least(ref, ref2), '>', greatest(ref, ref2)) AS raw_refs, destination AS involved
FROM (SELECT o.*, i.ref AS ref2, i.source AS source2,
        10 + CASE WHEN o.sensitive OR i.sensitive OR o.plen <= 8 THEN 20 ELSE 0 END AS sev
      FROM rec o JOIN rec i ON o.tool = i.tool AND o.destination = i.destination AND o.service = i.service
        AND o.lo <= i.lo AND i.hi <= o.hi AND (o.plen < i.plen OR o.ref > i.ref)
      WHERE o.action = 'allow' AND i.action = 'allow')"""
_SHADOW = f"""
SELECT concat('shadowed_rule|', tool, '|', ref) AS local_key, 'shadowed_rule' AS type, severity,
  {_BAND.format('severity')} AS severity_band, false AS forced_critical,
  CASE action WHEN 'deny' THEN concat('Dead deny on ', destination, ': blocked traffic is actually allowed')
    ELSE concat('Dead allow on ', destination, ': redundant rule never adds anything') END AS title,
  concat(least(ref, by_ref), '>', greatest(ref, by_ref)) AS raw_refs, concat(source, '>', destination) AS involved, by_ref AS shadowing_ref
FROM (SELECT l.*, e.ref AS by_ref, CASE l.action WHEN 'allow' THEN 10 ELSE l.sev END AS severity,
        row_number() OVER (PARTITION BY l.seq ORDER BY e.seq) AS nth
      FROM scored l JOIN rec e ON e.tool = l.tool AND e.destination = l.destination AND e.seq < l.seq
        AND (e.protocol = 'any' OR l.protocol = 'any' OR e.service = l.service)
        AND ((e.lo <= l.lo AND l.hi <= e.hi) OR (e.plen IS NULL AND l.plen IS NULL AND e.source = l.source)))
WHERE nth = 1"""
_BLIND = f"""
SELECT concat('transport_exposure|blind|', tool, '|', ref) AS local_key, 'transport_exposure' AS type, severity,
  CASE WHEN forced THEN 'critical' ELSE {_BAND.format('severity')} END AS severity_band, forced AS forced_critical,
  concat('QUIC (', service, ') reachable from ', CASE WHEN e >= 1 THEN 'the internet' ELSE source END, ' to ', destination,
    ' — likely uninspected') AS title, ref AS raw_refs, concat(source, '>', destination) AS involved
FROM (SELECT *, least(sev + 15, 100) AS severity, e >= 1 AND (b > 1 OR sensitive) AS forced FROM scored
      WHERE action = 'allow' AND l7_app = 'quic')"""
_FALLBACK = f"""
SELECT concat('transport_exposure|fallback|', destination, '|tcp443-udp443') AS local_key, 'transport_exposure' AS type,
  severity, {_BAND.format('severity')} AS severity_band, false AS forced_critical,
  concat(destination, ' is reachable on both tcp/443 and udp/443 — QUIC cannot be forced to the inspectable path') AS title,
  raw_refs, destination AS involved
FROM (SELECT destination, 40 + CASE WHEN bool_or(sensitive) THEN 20 ELSE 0 END AS severity,
        array_to_string(list_sort(list_distinct([min(ref) FILTER (WHERE protocol = 'tcp'), min(ref) FILTER (WHERE protocol = 'udp')])), '>') AS raw_refs
      FROM rec WHERE action = 'allow' AND port = 443 AND protocol IN ('tcp', 'udp') GROUP BY destination
      HAVING count(DISTINCT protocol) = 2)"""
_PATH = f"""
SELECT w.path, w.hops, w.refs, w.last_service, list_sort(list_distinct(w.tools)) AS tools, n.tags, n.dmz, n.dev
FROM walk w JOIN node n ON n.node = w.last WHERE n.sensitive AND len(list_distinct(w.tools)) >= 2"""
_PATH_SCORED = """
SELECT *, CAST(CASE WHEN last_service IN ('any', 'tcp/3389') THEN 1.0 WHEN last_service = 'tcp/5432' THEN 0.9
    WHEN last_service IN ('tcp/443', 'udp/443', 'quic') THEN 0.4 ELSE 0.5 END AS DOUBLE) AS p,
  CAST(CASE WHEN dmz OR dev THEN 1.0 ELSE 1.5 END AS DOUBLE) AS b FROM chain"""
_CHAIN = f"""
SELECT concat('cross_tool_path|', array_to_string(path, '>')) AS local_key, 'cross_tool_path' AS type, severity,
  CASE WHEN b > 1 THEN 'critical' ELSE {_BAND.format('severity')} END AS severity_band, b > 1 AS forced_critical,
  concat('Cross-tool path: Internet can reach ', path[len(path)], ' through ', cast(len(tools) AS VARCHAR), ' tools') AS title,
  array_to_string(refs, '>') AS raw_refs, array_to_string(path, '>') AS involved
FROM (SELECT *, CAST(round_even(100 * least((0.9::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * p)) * 1.0::DOUBLE * b, 1.0::DOUBLE), 0)
        AS INTEGER) AS severity FROM chain_scored)"""
_COMMON = "local_key, type, severity, severity_band, forced_critical, title, raw_refs, involved"
FINDING_CTES = {
    "chain": _PATH, "chain_scored": _PATH_SCORED, "f_over": _OVER, "f_overlap": _OVERLAP, "f_shadow": _SHADOW,
    "f_blind": _BLIND, "f_fallback": _FALLBACK, "f_chain": _CHAIN,
    "finding": " UNION ALL ".join(
        f"SELECT {_COMMON} FROM {t}" for t in ("f_over", "f_overlap", "f_shadow", "f_blind", "f_fallback", "f_chain")),
}


def _flat(findings: DataFrame, *more) -> DataFrame:
    return findings.select("local_key", "type", "severity", "severity_band", "forced_critical", "title",
                           csv("raw_refs", ">"), csv("involved", ">"), *more)


@query(f"SELECT {_COMMON}, n_reasons FROM f_over", **FINDING_CTES)
def over_permissive(spark, sf_dir):
    found = rules.over_permissive(estate(spark, sf_dir).view.placed)
    return _flat(found, F.expr("size(from_json(signals, 'reasons array<string>').reasons)").alias("n_reasons"))


_CLASSES = """SELECT tool, destination, service, plen, lo, hi, min(source) AS source, count(*) AS n_rules, min(ref) AS first_ref
  FROM scored WHERE action = 'allow' AND source_kind = 'cidr' GROUP BY tool, destination, service, plen, lo, hi"""


@query("""SELECT a.tool AS source_tool, a.destination, a.service, a.source, a.n_rules, a.first_ref, arg_max(b.source, b.plen) AS parent,
          CAST(coalesce(sum(b.n_rules), 0) AS BIGINT) AS n_above,
          CAST(a.n_rules * (a.n_rules - 1) // 2 + a.n_rules * coalesce(sum(b.n_rules), 0) AS BIGINT) AS n_pairs
          FROM classed a LEFT JOIN classed b ON b.tool = a.tool AND b.destination = a.destination AND b.service = a.service
            AND b.plen < a.plen AND b.lo <= a.lo AND b.hi >= a.hi
          GROUP BY a.tool, a.destination, a.service, a.plen, a.lo, a.source, a.n_rules, a.first_ref""", classed=_CLASSES)
def network_forest(spark, sf_dir):
    """Networks of allow rules with their nearest enclosing network and exact counts of overlapping pairs."""
    return nesting.network_forest(estate(spark, sf_dir).view.placed)


@query(f"SELECT {_COMMON} FROM f_overlap", **FINDING_CTES)
def cidr_overlap(spark, sf_dir):
    return _flat(nesting.cidr_overlap(estate(spark, sf_dir).view.placed))


@query(f"SELECT {_COMMON}, shadowing_ref FROM f_shadow", **FINDING_CTES)
def shadowed_rules(spark, sf_dir):
    found = nesting.shadowed_rules(estate(spark, sf_dir).view.placed)
    return _flat(found, F.get_json_object("signals", "$.shadowing_ref").alias("shadowing_ref"))


@query(f"SELECT {_COMMON} FROM f_blind", **FINDING_CTES)
def transport_blind_spot(spark, sf_dir):
    return _flat(rules.blind_spots(estate(spark, sf_dir).view.placed))


@query(f"SELECT {_COMMON} FROM f_fallback", **FINDING_CTES)
def tls_fallback(spark, sf_dir):
    return _flat(rules.tls_fallback(estate(spark, sf_dir).view.placed))


@query("""SELECT destination AS node, CASE protocol WHEN 'tcp' THEN 'tcp' ELSE 'udp' END AS side, tool AS source_tool, ref AS raw_ref
          FROM rec WHERE action = 'allow' AND port = 443 AND destination IN (SELECT involved FROM f_fallback)""", **FINDING_CTES)
def tls_fallback_refs(spark, sf_dir):
    return rules.fallback_refs(estate(spark, sf_dir).view.placed).withColumnRenamed("d", "node")


@query(f"SELECT {_COMMON} FROM finding", **FINDING_CTES)
def all_findings(spark, sf_dir):
    return _flat(snapshot.detect(estate(spark, sf_dir).view))


_SNAP = ids.snapshot_id(LABEL, "estate")


@query(f"""SELECT concat('F_', substr(sha1(concat('{_SNAP}', chr(31), local_key)), 1, 16)) AS finding_id, type, severity,
           severity_band, forced_critical FROM finding""", **FINDING_CTES)
def finding_ids(spark, sf_dir):
    return snapshot.finalize(estate(spark, sf_dir).findings, _SNAP).select(
        "finding_id", "type", "severity", "severity_band", "forced_critical")


@query(f"""SELECT row_number() OVER (ORDER BY forced_critical DESC, severity DESC, CASE severity_band WHEN 'critical' THEN 0
           WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, type, fid) AS position, local_key, severity FROM
           (SELECT *, concat('F_', substr(sha1(concat('{_SNAP}', chr(31), local_key)), 1, 16)) AS fid FROM finding)""", **FINDING_CTES)
def findings_ranked(spark, sf_dir):
    """Every finding with its place in the total order."""
    found = estate(spark, sf_dir).findings
    # texts and signals take no part in the order, so they are not moved
    keyed = found.select("local_key", "type", "severity", "severity_band", "forced_critical",
                         ids.stable_id("F", F.lit(_SNAP), F.col("local_key")).alias("finding_id"))
    return snapshot.ranked(keyed).select("position", "local_key", "severity")


@query("SELECT local_key, severity FROM finding WHERE type = 'over_permissive' AND severity >= 60", **FINDING_CTES)
def findings_by_filter(spark, sf_dir):
    return snapshot.filter_findings(estate(spark, sf_dir).findings, "over_permissive", 60).select("local_key", "severity")


# ---- identities ------------------------------------------------------------

@query("""SELECT node AS asset_key, kind, address AS ip_set, array_to_string(tags, ',') AS tags,
          array_to_string(tools, ',') AS source_tools, CASE WHEN node = '0.0.0.0/0' THEN 'Internet' ELSE node END AS display_name
          FROM node""")
def identity_assets(spark, sf_dir):
    found = snapshot.resolve_identities(estate(spark, sf_dir).entities)
    return found.assets.select("asset_key", "kind", csv("ip_set"), csv("tags"), csv("source_tools"), "display_name")


@query("SELECT name, asset_key FROM aliased")
def alias_map(spark, sf_dir):
    return snapshot.resolve_identities(estate(spark, sf_dir).entities).alias_map


@query("""SELECT asset_key, 'hostname' AS match_key, concat('{"name":"', name, '","tools":["', array_to_string(tools, '","'), '"]}')
            AS evidence, CAST(1 AS BIGINT) AS n_names
          FROM aliased WHERE n_tools > 1 AND asset_key NOT LIKE '%/%'
          UNION ALL SELECT any_value(asset_key), 'context_ip', concat('{"ip":"', ip, '","n_names":', count(*), '}'), count(*)
          FROM aliased WHERE ip IS NOT NULL GROUP BY ip HAVING count(*) > 1""")
def identity_correlations(spark, sf_dir):
    found = snapshot.resolve_identities(estate(spark, sf_dir).entities)
    return found.correlations.select("asset_key", "match_key", "evidence", "n_names")


@query("""SELECT a.name AS asked, coalesce(b.asset_key, a.name) AS asset_key, b.asset_key IS NOT NULL AS found, n.kind,
          array_to_string(n.tags, ',') AS tags
          FROM (SELECT concat('vm-', cast(c_custkey AS VARCHAR)) AS name FROM customer) a
          LEFT JOIN aliased b ON b.name = a.name LEFT JOIN node n ON n.node = b.asset_key""")
def resolve_names(spark, sf_dir):
    e = estate(spark, sf_dir)
    asked = e.table("customer").select(F.concat(F.lit("vm-"), F.col("c_custkey").cast("string")).alias("asked"))
    out = graph.lookup(asked, F.col("asked"), e.view.names, "name", {"node": "node", "kind": "kind", "tags": "tags"})
    return out.select("asked", F.coalesce("node", "asked").alias("asset_key"), F.col("node").isNotNull().alias("found"),
                      "kind", csv("tags"))


# ---- graph -----------------------------------------------------------------

@query("""SELECT node, kind, array_to_string(tags, ',') AS tags, CASE WHEN node = '0.0.0.0/0' THEN 'internet' WHEN dmz THEN 'dmz'
          WHEN dev THEN 'dev' ELSE 'internal' END AS zone FROM node""")
def graph_nodes(spark, sf_dir):
    v = estate(spark, sf_dir).view
    return graph.nodes(v.identities.assets, v.placed).select("node", "kind", csv("tags"), "zone")


@query("""SELECT s, d, array_to_string(tools, ',') AS tools, array_to_string(services, ',') AS services,
          coalesce(array_to_string(apps, ','), '') AS apps, n_grants, rep_tool, rep_ref FROM edge""")
def graph_edges(spark, sf_dir):
    out = graph.edges(estate(spark, sf_dir).view.placed)
    return out.select("s", "d", csv("tools"), csv("services"), csv("apps"), "n_grants",
                      F.col("rep.source_tool").alias("rep_tool"), F.col("rep.raw_ref").alias("rep_ref"))


@query("SELECT node FROM node WHERE sensitive")
def sensitive_nodes(spark, sf_dir):
    return graph.sensitive_nodes(estate(spark, sf_dir).view.nodes)


@query("""SELECT n.node, coalesce(g.degree, 0) AS degree FROM node n LEFT JOIN (SELECT node, count(*) AS degree FROM
          (SELECT s AS node FROM edge UNION ALL SELECT d FROM edge) GROUP BY node) g ON g.node = n.node
          ORDER BY degree DESC, n.node LIMIT 90""")
def node_degree_top(spark, sf_dir):
    v = estate(spark, sf_dir).view
    return graph.busiest(v.nodes, v.edges.select("s", "d"))


_SEED = """SELECT DISTINCT node FROM (SELECT unnest(path) AS node FROM chain UNION ALL
  SELECT node FROM node WHERE sensitive OR node = '0.0.0.0/0')"""
_KEPT = """SELECT node FROM seed UNION SELECT d FROM edge WHERE s IN (SELECT node FROM seed)
  UNION SELECT s FROM edge WHERE d IN (SELECT node FROM seed)"""


@query("SELECT s, d FROM edge WHERE s IN (SELECT node FROM kept) AND d IN (SELECT node FROM kept)",
       **FINDING_CTES, seed=_SEED, kept=_KEPT)
def focus_subgraph(spark, sf_dir):
    e = estate(spark, sf_dir)
    on_path = paths.cross_tool(e.internet_paths).select(F.explode("path").alias("node")).distinct()
    _, inside = graph.focus(e.view.nodes, e.view.edges.select("s", "d"), on_path)
    return inside.select("s", "d")


# ---- paths -----------------------------------------------------------------

@query("""SELECT array_to_string(path, '>') AS path, hops AS length, array_to_string(tools, ',') AS tools,
          array_to_string(refs, ',') AS refs, last_service AS terminal_service, array_to_string(tags, ',') AS terminal_tags,
          CASE WHEN dmz THEN 'internet->dmz' WHEN dev THEN 'internet->dev' ELSE 'internet->internal' END AS boundary FROM chain""",
       **FINDING_CTES)
def cross_tool_paths(spark, sf_dir):
    v = estate(spark, sf_dir).view
    return paths.cross_tool_paths(v.passing, v.nodes).select(
        csv("path", ">"), "length", csv("tools"), F.array_join(F.transform("hops", lambda h: h["ref"]), ",").alias("refs"),
        "terminal_service", csv("terminal_tags"), "boundary")


_ASKED = """SELECT s_suppkey AS query_id,
  CASE WHEN s_acctbal < 2500 THEN '0.0.0.0/0' ELSE concat('host-', cast((s_suppkey * 31) % (SELECT count(*) FROM {customer}) AS string)) END AS src,
  concat('host-', cast((s_suppkey * 17 + s_nationkey) % (SELECT count(*) FROM {customer}) AS string)) AS dst,
  CAST(CASE WHEN s_nationkey < 6 THEN 443 WHEN s_nationkey < 9 THEN 8050 END AS int) AS port,
  CASE WHEN s_nationkey BETWEEN 3 AND 12 THEN 'udp' END AS protocol,
  CASE WHEN s_nationkey BETWEEN 13 AND 17 THEN 'QUIC' END AS app
FROM {supplier}"""
_ASKED_DUCK = _ASKED.format(customer="customer", supplier="supplier").replace("AS string", "AS VARCHAR")
_TRAIL = """
SELECT DISTINCT a.src, e.d AS last, [a.src, e.d] AS path, 1 AS hops FROM asked a JOIN edge e ON e.s = a.src AND e.s <> e.d
UNION ALL
SELECT t.src, e.d, list_append(t.path, e.d), t.hops + 1 FROM trail t JOIN edge e ON e.s = t.last
  WHERE t.hops < 8 AND NOT list_contains(t.path, e.d) AND t.last NOT LIKE '%/%'"""
_REACHED = """
SELECT a.query_id, t.path, t.hops FROM asked a JOIN trail t ON t.src = a.src AND t.last = a.dst
WHERE (a.port IS NULL AND a.protocol IS NULL AND a.app IS NULL) OR EXISTS (
  SELECT 1 FROM rec g WHERE g.action = 'allow' AND g.source = t.path[len(t.path) - 1] AND g.destination = t.last AND (
    g.protocol = 'any' OR CASE WHEN a.app IS NOT NULL THEN lower(g.l7_app) = lower(a.app)
      ELSE (a.protocol IS NULL OR a.protocol = g.protocol)
        AND (a.port IS NULL OR a.port BETWEEN g.port AND coalesce(g.port_end, g.port)) END))
UNION ALL SELECT query_id, [src], 0 FROM asked WHERE src = dst"""
ASK_CTES = {"asked": _ASKED_DUCK, "trail": _TRAIL, "reached": _REACHED}


def _questions(spark, sf_dir) -> DataFrame:
    return estate(spark, sf_dir).derived(_ASKED, "supplier", "customer")


@query("""SELECT a.query_id, a.src, a.dst, count(r.query_id) > 0 AS reachable, count(r.query_id) AS n_paths,
          array_to_string(arg_min(r.path, [cast(r.hops AS VARCHAR), array_to_string(r.path, '>')]), '>') AS shortest
          FROM asked a LEFT JOIN reached r ON r.query_id = a.query_id GROUP BY 1, 2, 3""", **ASK_CTES)
def reachable_batch(spark, sf_dir):
    v = estate(spark, sf_dir).view
    return paths.reachable(_questions(spark, sf_dir), v.names, v.pairs, v.grants).select(
        "query_id", "src", "dst", "reachable", "n_paths", csv("shortest", ">"))


@query("""SELECT a.query_id, array_to_string(t.path, '>') AS path FROM asked a JOIN trail t ON t.src = a.src AND t.last = a.dst
          UNION ALL SELECT query_id, src FROM asked WHERE src = dst""", **ASK_CTES)
def find_paths_batch(spark, sf_dir):
    v = estate(spark, sf_dir).view
    return paths.paths_between(_questions(spark, sf_dir), v.names, v.pairs).select("query_id", csv("path", ">"))


@query("""SELECT DISTINCT target, source FROM reach WHERE source <> target""", asked=_ASKED_DUCK,
       reach="""SELECT DISTINCT dst AS target, dst AS source FROM asked
                UNION SELECT r.target, e.s FROM reach r JOIN edge e ON e.d = r.source""")
def who_can_reach(spark, sf_dir):
    targets = _questions(spark, sf_dir).select(F.col("dst").alias("target"))
    return paths.who_can_reach(targets, estate(spark, sf_dir).view.edges)


# every node, with the smallest node that it reaches and that reaches it
_MUTUAL = """SELECT DISTINCT s AS a, d AS b FROM edge UNION SELECT m.a, e.d FROM mutual m JOIN edge e ON e.s = m.b"""


@query("""SELECT n.node, least(n.node, coalesce(min(m.b), n.node)) AS component
          FROM (SELECT s AS node FROM edge UNION SELECT d FROM edge) n
          LEFT JOIN (SELECT a, b FROM mutual x WHERE EXISTS (SELECT 1 FROM mutual y WHERE y.a = x.b AND y.b = x.a)) m ON m.a = n.node
          GROUP BY n.node""", mutual=_MUTUAL)
def reach_components(spark, sf_dir):
    """Strongly connected components of the permitted-flow graph."""
    return condense.strong_components(estate(spark, sf_dir).view.edges)


@query("""SELECT target, count(source) AS n_sources FROM (
            SELECT t.target, r.source FROM (SELECT DISTINCT dst AS target FROM asked) t
            LEFT JOIN reach r ON r.target = t.target AND r.source <> t.target) GROUP BY target""",
       asked=_ASKED_DUCK, reach="""SELECT DISTINCT dst AS target, dst AS source FROM asked
                UNION SELECT r.target, e.s FROM reach r JOIN edge e ON e.d = r.source""")
def reach_counts(spark, sf_dir):
    """How many nodes reach each asked one, from component sizes; no pair is listed."""
    targets = _questions(spark, sf_dir).select(F.col("dst").alias("target"))
    return condense.Reach(targets, estate(spark, sf_dir).view.edges).counts()


@query("""SELECT t.target AS asked, t.target, array_to_string(n.tags, ',') AS target_tags, count(r.source) AS n_sources,
          coalesce(bool_or(r.source = '0.0.0.0/0'), false) AS internet_exposed
          FROM (SELECT DISTINCT dst AS target FROM asked) t LEFT JOIN node n ON n.node = t.target
          LEFT JOIN reach r ON r.target = t.target AND r.source <> r.target AND n.node IS NOT NULL GROUP BY 1, 2, 3""",
       asked=_ASKED_DUCK, reach="""SELECT DISTINCT dst AS target, dst AS source FROM asked
                UNION SELECT r.target, e.s FROM reach r JOIN edge e ON e.d = r.source""")
def effective_policy(spark, sf_dir):
    v = estate(spark, sf_dir).view
    targets = _questions(spark, sf_dir).select(F.col("dst").alias("target")).distinct()
    return paths.effective_policy(targets, v.names, v.edges, v.nodes).withColumn("target_tags", F.array_join("target_tags", ","))
