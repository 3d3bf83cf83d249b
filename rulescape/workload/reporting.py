"""Registered queries: tables at rest, listings, posture, ranking, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import graph, suggest
from ..plans import reports, snapshot
from ..sources import tables
from .core import _SNAP, FINDING_CTES, csv, query
from .estate import estate

# ---- tables at rest ------------------------------------------------------------

_FID = f"concat('F_', substr(sha1(concat('{_SNAP}', chr(31), local_key)), 1, 16))"


def _sha(prefix: str, *parts: str) -> str:
    return f"concat('{prefix}_', substr(sha1(concat_ws(chr(31), {', '.join(parts)})), 1, 16))"


_PORTS = """CASE WHEN protocol = 'any' THEN 'any' WHEN port_end IS NULL OR port_end = port THEN concat(protocol, '/', cast(port AS VARCHAR))
  ELSE concat(protocol, '/', cast(port AS VARCHAR), '-', cast(port_end AS VARCHAR)) END"""


@query(f"""SELECT {_sha('rule', f"'{_SNAP}'", 'tool', 'ref')} AS rule_uid, tool AS source_tool, ref AS raw_rule_id, action,
           CASE source_kind WHEN 'cidr' THEN concat('{{"cidrs":["', source, '"]}}') ELSE concat('{{"identity":"', source, '"}}') END AS src_value,
           concat('{{"identity":"', destination, '"}}') AS dst_value, {_PORTS} AS ports,
           {_sha('asset', f"'{_SNAP}'", 'source')} AS src_asset, {_sha('asset', f"'{_SNAP}'", 'destination')} AS dst_asset FROM rec""")
def canonical_rules(spark, sf_dir):
    out = tables.canonical_rules(estate(spark, sf_dir).view.placed, _SNAP)
    return out.select("rule_uid", "source_tool", "raw_rule_id", "action", "src_value", "dst_value",
                      F.array_join(graph.port_label(F.col("ports")), ",").alias("ports"),
                      F.col("src_asset_refs")[0].alias("src_asset"), F.col("dst_asset_refs")[0].alias("dst_asset"))


@query(f"""SELECT node AS node_id, CASE WHEN node = '0.0.0.0/0' THEN 'internet' WHEN kind = 'abstract' THEN 'subnet' ELSE 'asset' END AS kind,
           CASE WHEN node = '0.0.0.0/0' THEN 'Internet' ELSE node END AS label, {_sha('asset', f"'{_SNAP}'", 'node')} AS asset_id FROM node""")
def graph_node_rows(spark, sf_dir):
    return tables.graph_node_rows(estate(spark, sf_dir).view.nodes, _SNAP).select("node_id", "kind", "label", "asset_id")


@query(f"""SELECT {_sha('edge', f"'{_SNAP}'", 'tool', 'ref')} AS edge_id, source AS src_node, destination AS dst_node, l7_app, tool AS source_tool
           FROM rec WHERE action = 'allow'""")
def graph_edge_rows(spark, sf_dir):
    return tables.graph_edge_rows(estate(spark, sf_dir).view.placed, _SNAP).select(
        "edge_id", "src_node", "dst_node", "l7_app", "source_tool")


@query(f"""SELECT source AS src_node, destination AS dst_node, array_to_string(list_sort(list(DISTINCT tool)), ',') AS tools,
           array_to_string(list_sort(list(DISTINCT {_PORTS})), ',') AS services FROM rec WHERE action = 'allow' GROUP BY 1, 2""")
def edge_rollup(spark, sf_dir):
    out = graph.rollup(tables.graph_edge_rows(estate(spark, sf_dir).view.placed, _SNAP))
    return out.select("src_node", "dst_node", csv("tools"), csv("services"))


@query("""SELECT name AS object_name, 'address' AS object_kind, concat('{"ip":"', ip, '","name":"', name, '","tags":[',
          CASE WHEN tags_csv = '' THEN '' ELSE concat('"', replace(tags_csv, ',', '","'), '"') END, ']}') AS resolved FROM td_asset""")
def resolved_objects(spark, sf_dir):
    return tables.resolved_object_rows(estate(spark, sf_dir).parsed.resolved, _SNAP).select(
        "object_name", "object_kind", "resolved")


@query(f"SELECT DISTINCT {_sha('src', 'tool')} AS source_id, tool FROM rec")
def source_registry(spark, sf_dir):
    return tables.source_rows(estate(spark, sf_dir).normalized.records).select("source_id", "tool")


def _stored(e) -> dict[str, DataFrame]:
    """The estate's tables at rest, one snapshot per tool."""
    v = e.view
    by_tool = {"snapshot_id": F.col("source_tool")}
    return {
        "canonical_rules": tables.canonical_rules(v.placed, _SNAP).withColumns(by_tool),
        "graph_edges": tables.graph_edge_rows(v.placed, _SNAP).withColumns(by_tool),
        "assets": e.entities.select(F.col("tool").alias("snapshot_id"), F.col("name").alias("asset_key"),
                                               F.concat("tool", F.lit("/"), "name").alias("asset_id"),
                                               F.when(F.col("abstract"), "abstract").otherwise("concrete").alias("kind")),
        "findings": e.findings.select(F.col("source_tools")[0].alias("snapshot_id"), "type", "severity", "severity_band",
                                      F.col("local_key").alias("finding_id")),
    }


@query("""SELECT t.tool AS snapshot_id, a.n AS assets, r.n AS rules, f.n AS findings, coalesce(f.paths, 0) AS paths, f.critical
          FROM (SELECT DISTINCT tool FROM rec) t
          LEFT JOIN (SELECT tool, count(*) AS n FROM observed GROUP BY 1) a ON a.tool = t.tool
          LEFT JOIN (SELECT tool, count(*) AS n FROM rec GROUP BY 1) r ON r.tool = t.tool
          LEFT JOIN (SELECT tool, count(*) AS n, count(*) FILTER (WHERE type = 'cross_tool_path') AS paths,
              count(*) FILTER (WHERE severity_band = 'critical') AS critical FROM (
            SELECT type, severity_band, split_part(local_key, '|', 2) AS tool FROM f_over UNION ALL
            SELECT type, severity_band, split_part(local_key, '|', 2) FROM f_overlap UNION ALL
            SELECT type, severity_band, split_part(local_key, '|', 2) FROM f_shadow UNION ALL
            SELECT type, severity_band, split_part(local_key, '|', 3) FROM f_blind UNION ALL
            SELECT type, severity_band, (SELECT min(r.tool) FROM rec r WHERE r.action = 'allow' AND r.port = 443
              AND r.protocol IN ('tcp', 'udp') AND r.destination = f_fallback.involved) FROM f_fallback UNION ALL
            SELECT 'cross_tool_path', c.severity_band, h.tools[1] FROM f_chain c JOIN chain h
              ON array_to_string(h.path, '>') = c.involved) GROUP BY 1) f ON f.tool = t.tool""", **FINDING_CTES)
def snapshot_counts(spark, sf_dir):
    s = _stored(estate(spark, sf_dir))
    snaps = estate(spark, sf_dir).normalized.records.select(F.col("source_tool").alias("snapshot_id")).distinct().withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp"))
    return reports.snapshot_counts(snaps, s["assets"], s["canonical_rules"], s["findings"]).drop("created_at")


@query("""SELECT tool AS snapshot_id, 'canonical_rules' AS "table", count(*) AS n FROM rec GROUP BY 1
          UNION ALL SELECT tool, 'graph_edges', count(*) FROM rec WHERE action = 'allow' GROUP BY 1
          UNION ALL SELECT tool, 'assets', count(*) FROM observed GROUP BY 1""")
def table_counts(spark, sf_dir):
    s = _stored(estate(spark, sf_dir))
    return reports.table_counts({n: s[n] for n in ("canonical_rules", "graph_edges", "assets")})


@query("""SELECT 'canonical_rules' AS "table", x.rule, CAST(0 AS BIGINT) AS violations FROM (VALUES ('action in domain'), ('src_kind in domain'),
            ('dst_kind in domain'), ('unique rule_uid')) x(rule)
          UNION ALL SELECT 'assets', x.rule, 0 FROM (VALUES ('kind in domain'), ('unique asset_id')) x(rule)
          UNION ALL SELECT 'graph_edges', x.rule, 0 FROM (VALUES ('action in domain'), ('unique snapshot_id, edge_id')) x(rule)
          UNION ALL SELECT 'findings', x.rule, 0 FROM (VALUES ('type in domain'), ('severity in range'), ('severity_band in domain')) x(rule)
          UNION ALL SELECT 'findings', 'unique finding_id', (SELECT count(*) FROM (SELECT local_key FROM finding GROUP BY 1 HAVING count(*) > 1))
          UNION ALL SELECT 'sources', 'tool in domain', (SELECT count(DISTINCT tool) FROM rec)
          UNION ALL SELECT 'sources', 'unique source_id', 0""", **FINDING_CTES)
def domain_checks(spark, sf_dir):
    """The generated tools are not among the known ones, so exactly that rule is broken."""
    e = estate(spark, sf_dir)
    return tables.domain_checks({**_stored(e), "sources": tables.source_rows(e.normalized.records)})


# ---- ranking and posture ----------------------------------------------------------

_BUCKET = """SELECT *, CASE WHEN type = 'over_permissive' AND forced_critical THEN 'internet' WHEN type = 'cross_tool_path' THEN 'path'
  WHEN type = 'over_permissive' THEN 'broad' WHEN type IN ('cidr_overlap', 'shadowed_rule') THEN 'hygiene' END AS bucket FROM finding"""
_RANK = "CASE severity_band WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


def _keyed(e) -> DataFrame:
    return e.findings.withColumn("finding_id", ids.stable_id("F", F.lit(_SNAP), F.col("local_key")))


@query(f"""SELECT bucket, {_FID} AS finding_id FROM bucketed WHERE bucket IS NOT NULL""", **FINDING_CTES, bucketed=_BUCKET)
def action_members(spark, sf_dir):
    return reports.action_members(_keyed(estate(spark, sf_dir))).select("bucket", "finding_id")


@query(f"""SELECT bucket, count(*) AS n_findings, max(severity) AS max_severity, bool_or(forced_critical) AS any_forced,
           ['critical', 'high', 'medium', 'low'][min({_RANK}) + 1] AS severity_band,
           row_number() OVER (ORDER BY bool_or(forced_critical) DESC, min({_RANK}), max(severity) DESC,
             arg_min(fid, nth)) AS priority
           FROM (SELECT *, row_number() OVER (ORDER BY forced_critical DESC, severity DESC, {_RANK}, type, fid) AS nth
                 FROM (SELECT *, {_FID} AS fid FROM bucketed WHERE bucket IS NOT NULL)) GROUP BY bucket""",
       **FINDING_CTES, bucketed=_BUCKET)
def action_ranking(spark, sf_dir):
    out = reports.rank_actions(reports.action_members(_keyed(estate(spark, sf_dir))))
    return out.select("bucket", "n_findings", "max_severity", "any_forced", "severity_band",
                      F.col("priority").cast("bigint").alias("priority"))


# a path that ends in a sensitive asset, or a grant from the internet to one
_REACHES = """((SELECT count(*) FROM f_chain) > 0
          OR (SELECT count(*) FROM scored WHERE action = 'allow' AND e >= 1 AND sensitive) > 0)"""


@query(f"""SELECT count(*) AS total_findings, count(*) FILTER (WHERE severity_band = 'critical') AS critical,
          count(*) FILTER (WHERE severity_band = 'high') AS high, count(*) FILTER (WHERE severity_band = 'medium') AS medium,
          count(*) FILTER (WHERE severity_band = 'low') AS low, count(*) FILTER (WHERE type = 'cidr_overlap') AS cidr_overlap,
          count(*) FILTER (WHERE type = 'cross_tool_path') AS cross_tool_path,
          count(*) FILTER (WHERE type = 'over_permissive') AS over_permissive,
          count(*) FILTER (WHERE type = 'shadowed_rule') AS shadowed_rule,
          count(*) FILTER (WHERE type = 'transport_exposure') AS transport_exposure,
          count(*) FILTER (WHERE forced_critical) AS forced_critical, {_REACHES} AS internet_reaches_regulated_data,
          (SELECT count(*) FROM node WHERE sensitive) AS sensitive_assets FROM finding""", **FINDING_CTES)
def posture_summary(spark, sf_dir):
    e = estate(spark, sf_dir)
    return reports.posture_summary(e.findings, e.view.identities.assets)


@query(f"""SELECT title, severity_band AS band, severity FROM (SELECT *, {_FID} AS fid FROM finding)
           ORDER BY forced_critical DESC, severity DESC, {_RANK}, type, fid LIMIT 5""", **FINDING_CTES)
def top_findings(spark, sf_dir):
    return reports.top_findings(_keyed(estate(spark, sf_dir)))


@query("""SELECT local_key, concat('Rules ', replace(raw_refs, '>', ', '), ' are redundant: ',
            split_part(split_part(title, ': ', 2), ' already covers ', 1), ' already covers ', split_part(title, ' already covers ', 2),
            ' for ', involved, ' (', split_part(split_part(title, '(', 2), ')', 1), '). Remove the narrower rule to cut policy clutter.') AS explanation
          FROM f_overlap
          UNION ALL SELECT local_key, concat(title, ' (refs: ', replace(raw_refs, '>', ', '), ').') FROM f_blind
          UNION ALL SELECT local_key, concat(title, ' (refs: ', replace(raw_refs, '>', ', '), ').') FROM f_fallback
          UNION ALL SELECT concat('over_permissive|', tool, '|', ref), concat('Rule ', ref, ' allows ', access, ' from ',
            CASE WHEN source = '0.0.0.0/0' THEN 'the internet (0.0.0.0/0)' ELSE source END, ' to ', destination, ' (',
            CASE WHEN coalesce(dest_tags, '') = '' THEN 'internal' ELSE array_to_string(list_sort(string_split(dest_tags, ',')), ', ') END,
            '). This is over-permissive because ', array_to_string(reasons, '; '),
            '. Suggested fix: scope the source to only the hosts that genuinely need ', access, ', and remove any internet exposure.')
          FROM (SELECT *, CASE WHEN protocol = 'any' THEN 'any protocol/port' WHEN port = 3389 THEN 'RDP' WHEN port = 443 THEN 'HTTPS'
              WHEN port = 5432 THEN 'PostgreSQL' ELSE service END AS access,
            list_filter([CASE WHEN protocol = 'any' THEN 'allows every protocol and port (any/any)' END,
              CASE WHEN e >= 1 AND (p >= 0.85 OR sensitive) THEN 'exposed directly to the internet' END,
              CASE WHEN sensitive AND e >= 0.3 THEN 'regulated destination reachable from more than a single host' END,
              CASE WHEN p >= 0.85 AND e >= 0.5 THEN 'admin/data port open to a broad source range' END], lambda x: x IS NOT NULL) AS reasons
            FROM scored WHERE action = 'allow') WHERE len(reasons) > 0
          UNION ALL SELECT local_key, concat('A reachability chain crosses ', cast(len(c.tools) AS VARCHAR), ' tools (',
            array_to_string(c.tools, ', '), ') from Internet to ', c.path[len(c.path)], ' (', array_to_string(c.tags, ', '), ') -- a internet->',
            CASE WHEN c.dmz THEN 'dmz' WHEN c.dev THEN 'dev' ELSE 'internal' END,
            ' crossing that no single tool reveals. Break one hop (e.g. rule ', c.refs[1], ') to cut the chain.')
          FROM f_chain JOIN chain_scored c ON local_key = concat('cross_tool_path|', array_to_string(c.path, '>'))
          UNION ALL SELECT s.local_key, concat(r.action, ' ', r.source, ' -> ', r.destination, ' (', r.service, ')',
            CASE r.action WHEN 'deny' THEN ' never fires; earlier allow ' ELSE ' is redundant; earlier rule ' END, x.ref, ' (', x.source,
            CASE r.action WHEN 'deny' THEN ') already permits it' ELSE ') already covers it' END,
            ' Reorder or remove rule ', r.ref, ' so the intended policy is actually enforced.')
          FROM f_shadow s JOIN rec r ON s.local_key = concat('shadowed_rule|', r.tool, '|', r.ref)
          JOIN rec x ON x.tool = r.tool AND x.ref = s.shadowing_ref""", **FINDING_CTES)
def explanations(spark, sf_dir):
    return estate(spark, sf_dir).findings.select("local_key", reports.explanation().alias("explanation"))


_TOP = f"""SELECT title, severity_band, severity FROM (SELECT *, {_FID} AS fid FROM finding)
           ORDER BY forced_critical DESC, severity DESC, {_RANK}, type, fid LIMIT 5"""


@query(f"""SELECT concat('## Executive summary', chr(10), 'The current snapshot surfaced ', count(*), ' policy risks across the estate (',
            count(*) FILTER (WHERE severity_band = 'critical'), ' critical, ', count(*) FILTER (WHERE severity_band = 'high'), ' high, ',
            count(*) FILTER (WHERE severity_band = 'medium'), ' medium, ', count(*) FILTER (WHERE severity_band = 'low'), ' low). ',
            CASE WHEN {_REACHES} THEN 'A cross-tool attack path reaches regulated data from the internet, which no single tool reveals. ' ELSE '' END,
            count(*) FILTER (WHERE forced_critical), ' findings are categorically unacceptable and were force-flagged critical.', chr(10), chr(10),
            '## Top risks', chr(10),
            (SELECT string_agg(concat('- ', title, ' (', severity_band, ')', chr(10)), '' ORDER BY severity DESC, title) FROM ({_TOP})),
            chr(10), '## Compliance posture', chr(10), 'Regulated assets in scope: ', (SELECT count(*) FROM node WHERE sensitive), ' assets',
            '. Internet-exposed access to PCI/customer-data assets is a PCI-DSS segmentation gap (Req. 1) and a Zero-Trust violation; ',
            'closing the flagged criticals moves the estate toward an enforced-segmentation maturity level.') AS narrative
          FROM finding""", **FINDING_CTES)
def posture_narrative(spark, sf_dir):
    e = estate(spark, sf_dir)
    return reports.narrative(_keyed(e), e.view.identities.assets)


_ORDER = f"ORDER BY forced_critical DESC, severity DESC, {_RANK}, type, fid LIMIT 1"
_WITH_ID = f"SELECT *, {_FID} AS fid FROM finding"


@query(f"""SELECT * FROM (
          SELECT 1 AS n, (SELECT concat('Can the internet reach ', split_part(involved, '>', -1), ', and through which path and tools?')
            FROM ({_WITH_ID}) WHERE type = 'cross_tool_path' {_ORDER}) AS question
          UNION ALL SELECT 2, (SELECT concat('What can reach ', min(node), '?') FROM node WHERE sensitive)
          UNION ALL SELECT 3, (SELECT concat('What would happen if I open ', r.service, ' from ', r.source, ' to ', r.destination, '?')
            FROM ({_WITH_ID}) f JOIN rec r ON f.local_key = concat('over_permissive|', r.tool, '|', r.ref) WHERE type = 'over_permissive' {_ORDER})
          UNION ALL SELECT 4, (SELECT 'Which findings are forced-critical, and why?' FROM finding WHERE forced_critical LIMIT 1)
          UNION ALL SELECT 5, 'Summarize the riskiest exposure in this snapshot.') WHERE question IS NOT NULL ORDER BY n LIMIT 4""", **FINDING_CTES)
def suggested_questions(spark, sf_dir):
    e = estate(spark, sf_dir)
    return reports.suggested_questions(_keyed(e), e.view.identities.assets)


# ---- requests, decisions, staged changes ---------------------------------------------

REQUEST_SQL = """
SELECT concat('cr-', cast(p_partkey AS string)) AS request_id, CASE WHEN p_size < 40 THEN 'add_allow' ELSE 'remediation' END AS kind,
  CASE WHEN p_size < 40 THEN 'change_gate' ELSE 'risk_todo' END AS origin, p_brand AS requested_by, p_name AS justification,
  CASE WHEN p_retailprice > 1800 THEN 'rejected' ELSE 'open' END AS status, 'snap' AS snapshot_id,
  CASE WHEN p_size < 10 THEN 'wiz' END AS target_tool
FROM {part}"""
DECISION_SQL = """
SELECT concat('dec-', cast(p_partkey AS string)) AS decision_id, concat('cr-', cast(p_partkey AS string)) AS request_id,
  CASE WHEN p_size < 25 THEN 'auto_approve' ELSE 'escalate' END AS decision, p_size > 45 AS forced_escalate,
  CASE WHEN p_size < 25 THEN CAST(1.0 AS double) ELSE CAST(0.5 AS double) END AS confidence, d.decided_at
FROM {part} LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS decided_at FROM {lineitem} GROUP BY l_partkey) d ON d.l_partkey = p_partkey"""
STAGED_SQL = """
SELECT concat('stage-', cast(p_partkey AS string)) AS staged_id, concat('cr-', cast(p_partkey AS string)) AS request_id,
  CASE p_type WHEN 'ECONOMY' THEN 'algosec' ELSE 'wiz' END AS target_tool, p_retailprice AS created_at,
  CASE WHEN p_size < 10 THEN 'pushed' WHEN p_size < 15 THEN 'conflict' ELSE 'staged' END AS status
FROM {part} WHERE p_size < 20"""


def _duck(text: str) -> str:
    return text.format(part="part", lineitem="lineitem").replace("AS string", "AS VARCHAR")


_FLOW = {"request": _duck(REQUEST_SQL), "decided": _duck(DECISION_SQL), "stagedc": _duck(STAGED_SQL)}


def _flow(e) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (e.derived(REQUEST_SQL, "part"), e.derived(DECISION_SQL, "part", "lineitem"), e.derived(STAGED_SQL, "part"))


@query("""SELECT d.decision_id, d.decision, d.forced_escalate, strftime(d.decided_at, '%Y-%m-%d') AS decided_on, r.kind, r.origin,
          r.status AS request_status, s.staged_id, CASE WHEN s.staged_id IS NOT NULL OR r.status = 'rejected' THEN 'done' ELSE 'pending' END AS tab
          FROM decided d JOIN request r ON r.request_id = d.request_id LEFT JOIN stagedc s ON s.request_id = d.request_id
          ORDER BY d.decided_at DESC NULLS LAST, d.decision_id LIMIT 25""", **_FLOW)
def decision_log(spark, sf_dir):
    requests, decisions, staged = _flow(estate(spark, sf_dir))
    out = reports.open_or_done(reports.decision_log(decisions, requests, staged))
    return out.select("decision_id", "decision", "forced_escalate", F.date_format("decided_at", "yyyy-MM-dd").alias("decided_on"),
                      "kind", "origin", "request_status", "staged_id", "tab")


@query("""SELECT s.staged_id, s.target_tool, s.status, r.justification, r.requested_by FROM stagedc s
          LEFT JOIN request r ON r.request_id = s.request_id""", **_FLOW)
def staging_list(spark, sf_dir):
    requests, _, staged = _flow(estate(spark, sf_dir))
    return reports.staging_list(staged, requests).select("staged_id", "target_tool", "status", "justification", "requested_by")


@query(f"""SELECT {_sha('stage', 'r.request_id')} AS staged_id, r.request_id, r.kind, r.origin,
           coalesce(r.target_tool, 'algosec') AS target_tool,
           CASE d.decision WHEN 'escalate' THEN 'manual_approved' ELSE 'auto_approve' END AS decision
           FROM request r JOIN decided d ON d.request_id = r.request_id
           WHERE r.status <> 'rejected' AND (d.decision <> 'escalate' OR r.kind = 'remediation')""", **_FLOW)
def stage_eligibility(spark, sf_dir):
    """Everything is asked to be staged; remediations with manual approval."""
    from ..operators.staging import stage

    requests, decisions, _ = _flow(estate(spark, sf_dir))
    asked = requests.select("request_id", F.lit(None).cast("string").alias("target_tool"),
                            (F.col("kind") == "remediation").alias("manual_approve"))
    return stage(asked, requests, decisions).select("staged_id", "request_id", "kind", "origin", "target_tool", "decision")


@query("""SELECT 'decision' AS measure, decision AS value, count(*) AS n FROM decided GROUP BY 2
          UNION ALL SELECT 'staging', status, count(*) FROM stagedc GROUP BY 2
          UNION ALL SELECT 'findings', 'findings', count(*) FROM finding
          UNION ALL SELECT 'findings', 'critical', count(*) FROM finding WHERE severity_band = 'critical'""", **_FLOW, **FINDING_CTES)
def status_counts(spark, sf_dir):
    e = estate(spark, sf_dir)
    _, decisions, staged = _flow(e)
    return reports.status_counts(decisions, staged, e.findings)


@query("""SELECT request_id, CASE WHEN request_id IN (SELECT request_id FROM stagedc WHERE status = 'conflict') THEN 'rejected'
          ELSE status END AS status, CASE WHEN request_id IN (SELECT request_id FROM stagedc WHERE status = 'conflict')
          THEN 'reviewer' END AS rejected_by FROM request""", **_FLOW)
def request_lifecycle(spark, sf_dir):
    """Requests whose push met a conflict are rejected."""
    requests, _, staged = _flow(estate(spark, sf_dir))
    out = staged.filter("status = 'conflict'").select("request_id", F.lit("reviewer").alias("rejected_by"),
                                                      F.lit("conflict").alias("reject_reason"))
    blank = requests.withColumns({"rejected_by": F.lit(None).cast("string"), "reject_reason": F.lit(None).cast("string")})
    return tables.reject(blank, out).select("request_id", "status", "rejected_by")


# ---- keyed tables ---------------------------------------------------------------------

@query("""SELECT l_orderkey AS order_key, l_linenumber AS line, arg_max(l_quantity, k) AS quantity, max(k) AS last_seen
          FROM (SELECT *, l_partkey * 1000000 + l_suppkey * 1000 + cast(l_quantity AS BIGINT) AS k FROM lineitem) GROUP BY 1, 2""")
def upsert_latest(spark, sf_dir):
    """A batch with repeated keys over a table that holds the first half of the orders: the last row of a key stays."""
    e = estate(spark, sf_dir)
    lines = e.table("lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"),
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("bigint")).alias("last_seen"))
    held = tables.last_of_batch(lines, ["order_key", "line"], -F.col("last_seen"))
    return tables.upsert(held, lines, ["order_key", "line"], F.col("last_seen"))


@query("""SELECT concat('finding-', cast(l_orderkey AS VARCHAR)) AS finding_id, l_linenumber AS line,
          CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1
            + coalesce(h.held, 0) AS INTEGER) AS seq
          FROM lineitem LEFT JOIN (SELECT o_orderkey, 2 AS held FROM orders WHERE o_orderstatus = 'F') h ON h.o_orderkey = l_orderkey""")
def revision_threads(spark, sf_dir):
    """Line items as drafts of their order's thread; finished orders already hold revisions 0 and 1."""
    e = estate(spark, sf_dir)
    name = F.concat(F.lit("finding-"), F.col("l_orderkey").cast("string"))
    drafts = e.table("lineitem").select(
        F.lit("snap").alias("snapshot_id"), name.alias("finding_id"), F.col("l_linenumber").alias("line"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("written"))
    held = e.table("orders").filter("o_orderstatus = 'F'").select(
        F.lit("snap").alias("snapshot_id"), F.concat(F.lit("finding-"), F.col("o_orderkey").cast("string")).alias("finding_id"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("seq")).withColumn("thread_id", tables.thread_id())
    return tables.next_revisions(held, drafts, "written").select("finding_id", "line", "seq")


_MERGED = """SELECT DISTINCT least(concat('host-', cast(s_suppkey * 3 AS VARCHAR)), concat('vm-', cast(s_nationkey AS VARCHAR))) AS a,
  greatest(concat('host-', cast(s_suppkey * 3 AS VARCHAR)), concat('vm-', cast(s_nationkey AS VARCHAR))) AS b, s_acctbal < 0 AS gone FROM supplier"""


@query(f"""SELECT {_sha('merge', 'a', 'b')} AS merge_id, a AS name_a, b AS name_b FROM merged WHERE NOT gone""", merged=_MERGED)
def confirmed_merges(spark, sf_dir):
    """Every supplier confirms a merge twice; those in debt withdraw it again."""
    pairs = estate(spark, sf_dir).table("supplier").select(
        F.concat(F.lit("vm-"), F.col("s_nationkey").cast("string")).alias("name_a"),
        F.concat(F.lit("host-"), (F.col("s_suppkey") * 3).cast("string")).alias("name_b"), (F.col("s_acctbal") < 0).alias("gone"))
    empty = pairs.limit(0).select("name_a", "name_b").withColumn("merge_id", F.lit("").cast("string"))
    once = tables.add_merges(empty, pairs.select("name_a", "name_b"))
    twice = tables.add_merges(once, pairs.select(F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b")))
    return tables.remove_merges(twice, pairs.filter("gone").select("name_a", "name_b"))


@query("""SELECT name AS asset_key, string_agg(DISTINCT CASE WHEN other IS NULL THEN name ELSE least(name, other) END) AS first_name
          FROM (SELECT n.name, m.name AS other FROM named n LEFT JOIN named m ON m.ip = n.ip AND m.name <> n.name) GROUP BY name""")
def merged_components(spark, sf_dir):
    """Component root of every observed name (names that share an address)."""
    from ..operators.components import components

    entities = estate(spark, sf_dir).entities
    by_ip = entities.filter("ip IS NOT NULL").select("ip", "name").distinct()
    links = by_ip.join(by_ip.groupBy("ip").agg(F.min("name").alias("b")), "ip").select(F.col("name").alias("a"), "b")
    names = entities.select("name").distinct()
    return names.join(components(links), "name", "left").select(
        F.col("name").alias("asset_key"), F.coalesce("root", "name").alias("first_name"))


_LINKED = """SELECT n.name AS a, m.name AS b FROM named n JOIN named m ON m.ip = n.ip AND m.name <> n.name
  UNION SELECT a, b FROM merged JOIN named x ON x.name = a JOIN named y ON y.name = b WHERE NOT gone
  UNION SELECT b, a FROM merged JOIN named x ON x.name = a JOIN named y ON y.name = b WHERE NOT gone"""
_JOINED = "SELECT name AS a, name AS b FROM named UNION SELECT j.a, l.b FROM joined j JOIN linked l ON l.a = j.b"


def _confirmed(e) -> DataFrame:
    """The merges that suppliers confirmed and did not withdraw, as their table holds them."""
    return e.table("supplier").filter("s_acctbal >= 0").select(
        F.concat(F.lit("vm-"), F.col("s_nationkey").cast("string")).alias("name_a"),
        F.concat(F.lit("host-"), (F.col("s_suppkey") * 3).cast("string")).alias("name_b"))


@query("""SELECT j.a AS name, arg_min(n.name, [cast(99 - n.n_tools AS VARCHAR), n.name]) AS asset_key
          FROM joined j JOIN named n ON n.name = j.b GROUP BY j.a""", merged=_MERGED, linked=_LINKED, joined=_JOINED)
def merged_alias_map(spark, sf_dir):
    """Canonical asset of every name with confirmed merges as links beside shared addresses."""
    e = estate(spark, sf_dir)
    return snapshot.resolve_identities(e.entities, _confirmed(e)).alias_map


@query("""SELECT c.asset_key, concat('{"by":"human-confirmed","names":["', m.a, '","', m.b, '"]}') AS evidence
          FROM (SELECT DISTINCT a, b FROM merged WHERE NOT gone) m JOIN named y ON y.name = m.b
          JOIN (SELECT j.a AS name, arg_min(n.name, [cast(99 - n.n_tools AS VARCHAR), n.name]) AS asset_key
                FROM joined j JOIN named n ON n.name = j.b GROUP BY j.a) c ON c.name = m.a""", merged=_MERGED, linked=_LINKED, joined=_JOINED)
def merge_evidence(spark, sf_dir):
    """Correlations that a person confirmed."""
    e = estate(spark, sf_dir)
    found = snapshot.resolve_identities(e.entities, _confirmed(e).distinct())
    return found.correlations.filter("match_key = 'manual_review'").select("asset_key", "evidence")


@query("""SELECT name, CASE WHEN name LIKE '%/%' THEN 'cidr' ELSE 'identity' END AS kind, coalesce(min(tool), '') AS tool FROM (
            SELECT name, arg_min(tool, [seq, side]) AS tool FROM (
              SELECT source AS name, tool, seq, 0 AS side FROM rec UNION ALL SELECT destination, tool, seq, 1 FROM rec)
            WHERE name NOT IN (SELECT name FROM td_asset) GROUP BY name) GROUP BY name""")
def gap_filled_entities(spark, sf_dir):
    """Endpoints that only the records name, as entities; the known names are the inventory's."""
    e = estate(spark, sf_dir)
    known = e.entities.join(e.hosts.select("name"), "name", "left_semi").select(*e.entities.columns)
    from ..operators.identity import fill_missing_entities

    filled = fill_missing_entities(known, e.normalized.records)
    return filled.join(known.select("name").distinct(), "name", "left_anti").select("name", "kind", "tool")


# ---- listings ---------------------------------------------------------------------------

@query(f"SELECT {_FID} AS finding_id, type, severity, forced_critical FROM finding", **FINDING_CTES)
def finding_listing(spark, sf_dir):
    return reports.finding_listing(_keyed(estate(spark, sf_dir))).select("finding_id", "type", "severity", "forced_critical")


@query(f"""SELECT {_FID} AS finding_id, local_key, severity FROM finding
           WHERE {_FID} = (SELECT max({_FID}) FROM finding WHERE type = 'over_permissive')""", **FINDING_CTES)
def finding_by_id(spark, sf_dir):
    keyed = _keyed(estate(spark, sf_dir))
    wanted = keyed.filter("type = 'over_permissive'").agg(F.max("finding_id")).scalar()
    return reports.finding(keyed, wanted).select("finding_id", "local_key", "severity")


@query("""SELECT staged_id, target_tool, status FROM stagedc WHERE status IN ('staged', 'pushed')
            AND staged_id <> (SELECT min(staged_id) FROM stagedc)
            AND target_tool IN (SELECT target_tool FROM stagedc WHERE staged_id = (SELECT min(staged_id) FROM stagedc))""", **_FLOW)
def staged_siblings(spark, sf_dir):
    _, _, staged = _flow(estate(spark, sf_dir))
    return reports.siblings(staged, staged.agg(F.min("staged_id")).scalar()).select("staged_id", "target_tool", "status")


@query("""SELECT 'source' AS part, tool AS name FROM (SELECT DISTINCT tool FROM rec) UNION ALL
          SELECT 'object', name FROM td_asset UNION ALL SELECT 'rule', ref FROM rec""")
def ingest_inspection(spark, sf_dir):
    """What one snapshot took in: sources, resolved objects and rules."""
    e = estate(spark, sf_dir)
    sources, objects, taken = reports.ingest_inspection(
        tables.canonical_rules(e.view.placed, _SNAP), tables.resolved_object_rows(e.parsed.resolved, _SNAP))
    return (sources.select(F.lit("source").alias("part"), F.col("tool").alias("name"))
            .unionByName(objects.select(F.lit("object").alias("part"), F.col("object_name").alias("name")))
            .unionByName(taken.select(F.lit("rule").alias("part"), F.col("raw_rule_id").alias("name"))))


@query("""SELECT concat('rev-', cast(l_orderkey AS VARCHAR), '-', cast(l_linenumber AS VARCHAR)) AS revision_id,
          CASE WHEN bool_or(l_returnflag = 'R') THEN 'accepted' ELSE 'draft' END AS status FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def accepted_revisions(spark, sf_dir):
    """Line items as drafted revisions; returned ones are accepted, as are ids that no revision has."""
    lines = estate(spark, sf_dir).table("lineitem")
    name = F.concat(F.lit("rev-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("revision_id")
    drafts = lines.select(name, F.lit("draft").alias("status")).distinct()
    accepted = lines.filter("l_returnflag = 'R'").select(name)
    unknown = accepted.select(F.concat("revision_id", F.lit("-none")).alias("revision_id"))
    return tables.accept_revisions(drafts, accepted.unionByName(unknown)).select("revision_id", "status")


# ---- search -------------------------------------------------------------------------

@query("""SELECT ref AS raw_ref, seq AS rule_order FROM rec WHERE contains(lower(concat_ws(' ', source, destination, service, action, tool, ref,
          replace(dest_tags, ',', ' '))), 'quic allow cloud')""")
def rule_search(spark, sf_dir):
    placed = estate(spark, sf_dir).view.placed
    found = reports.search(placed, " QUIC allow Cloud ", *[F.col(c) for c in ("source", "destination", "service", "action",
                           "source_tool", "raw_ref")], F.array_join("dest_tags", " "))
    return reports.sort_rows(found, "source_tool", False, "raw_ref").select("raw_ref", F.col("order").cast("bigint").alias("rule_order"))


@query("""SELECT ref AS raw_rule_id, tool AS source_tool, action FROM rec WHERE ref IN (SELECT concat('R-', cast(max(s_suppkey) AS VARCHAR)) FROM supplier)""")
def rule_lookup(spark, sf_dir):
    e = estate(spark, sf_dir)
    last = e.table("supplier").agg(F.max("s_suppkey").cast("string")).scalar()
    return reports.rule_by_ref(tables.canonical_rules(e.view.placed, _SNAP), F.concat(F.lit("R-"), last)).select(
        "raw_rule_id", "source_tool", "action")


# ---- usage ----------------------------------------------------------------------------

METRIC_SQL = """
SELECT ts, event_type AS capability, CASE event_type WHEN 'view' THEN 'anthropic' WHEN 'click' THEN 'openai' ELSE 'ollama' END AS provider,
  CASE event_type WHEN 'view' THEN 'claude-haiku-4-5' WHEN 'click' THEN 'gpt-4o-mini' ELSE 'local' END AS model,
  CASE WHEN user_id < 50 THEN 'admin' WHEN user_id < 120 THEN 'analyst' ELSE 'viewer' END AS role,
  CAST(floor(value * 10) AS int) AS latency_ms, CAST({json} AS int) AS prompt_tokens, CAST(user_id AS int) AS completion_tokens,
  event_type <> 'error' AS ok, concat('tool-', cast(user_id AS string)) AS tool_name, (SELECT max(ts) FROM {events}) AS newest
FROM {events}"""
_METRIC = METRIC_SQL.format(json="json_extract(props, '$.k')", events="events").replace("AS string", "AS VARCHAR")
_CALL = """SELECT *, prompt_tokens + completion_tokens AS tokens, CASE model WHEN 'claude-haiku-4-5' THEN prompt_tokens * 1.0 + completion_tokens * 5.0
  WHEN 'gpt-4o-mini' THEN prompt_tokens * 0.15 + completion_tokens * 0.6 ELSE 0 END / 1000000.0 AS raw_cost FROM metric
  WHERE ts > (SELECT max(ts) FROM metric) - INTERVAL 7 DAY"""
_M = {"metric": _METRIC, "call": _CALL}
_WHOLE_LOG = {"metric": _METRIC, "call": _CALL.split("  WHERE ts >")[0]}
_TOK = "CAST(sum(tokens) AS BIGINT)"
_COST = "CAST(round(sum(raw_cost), 3) AS DOUBLE)"


def _all_metrics(spark, sf_dir) -> DataFrame:
    e = estate(spark, sf_dir)
    return tables.metric_rows(spark.sql(METRIC_SQL.replace("{json}", "get_json_object(props, '$.k')"), events=e.table("events")).withColumns({
        "error": F.lit(None).cast("string")}))


def _metrics(spark, sf_dir) -> DataFrame:
    """The last seven days of the event log, counted back from its newest row."""
    return reports.last_days(_all_metrics(spark, sf_dir), 7, F.col("newest"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("cost", F.round(F.col("cost").cast("double"), 3)) if "cost" in df.columns else df


@query(f"""SELECT count(*) AS calls, {_TOK} AS tokens, {_COST} AS cost, CAST(round(avg(latency_ms)) AS BIGINT) AS avg_latency,
           count(*) FILTER (WHERE NOT ok) AS errors FROM call""", **_M)
def metrics_totals(spark, sf_dir):
    return _rounded(reports.metric_totals(_metrics(spark, sf_dir)))


@query("""SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS p50,
          percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95 FROM call""", **_M)
def metrics_latency(spark, sf_dir):
    return reports.latency_percentiles(_metrics(spark, sf_dir))


@query(f"SELECT provider, model, count(*) AS calls, {_TOK} AS tokens, {_COST} AS cost FROM call GROUP BY 1, 2", **_M)
def metrics_by_provider(spark, sf_dir):
    return _rounded(reports.by_provider(_metrics(spark, sf_dir)))


@query(f"""SELECT capability, count(*) AS calls, {_TOK} AS tokens, {_COST} AS cost, CAST(round(avg(latency_ms)) AS BIGINT) AS avg_latency
           FROM call GROUP BY 1""", **_M)
def metrics_by_capability(spark, sf_dir):
    return _rounded(reports.by_capability(_metrics(spark, sf_dir)))


@query(f"SELECT role, count(*) AS calls, {_TOK} AS tokens FROM call GROUP BY 1", **_M)
def metrics_by_role(spark, sf_dir):
    return reports.by_role(_metrics(spark, sf_dir))


@query(f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS calls, {_TOK} AS tokens, {_COST} AS cost FROM call GROUP BY 1", **_M)
def metrics_daily(spark, sf_dir):
    return _rounded(reports.daily(_metrics(spark, sf_dir)))


@query(f"SELECT tool_name, count(*) AS uses, {_TOK} AS tokens FROM call GROUP BY 1 ORDER BY uses DESC, tool_name LIMIT 8", **_M)
def metrics_top(spark, sf_dir):
    return reports.top_tools(_metrics(spark, sf_dir))


@query(f"""SELECT concat('tool-', cast(s_suppkey AS VARCHAR)) AS tool_key, coalesce(u.uses, 0) AS uses, coalesce(u.tokens, 0) AS total_tokens,
           coalesce(u.errors, 0) AS errors, CASE WHEN s_acctbal < 0 THEN 'admin' ELSE 'admin,analyst,viewer' END AS enabled_roles
           FROM supplier LEFT JOIN (SELECT tool_name, count(*) AS uses, {_TOK} AS tokens, count(*) FILTER (WHERE NOT ok) AS errors
             FROM call GROUP BY 1) u ON u.tool_name = concat('tool-', cast(s_suppkey AS VARCHAR))""", **_WHOLE_LOG)
def tool_usage(spark, sf_dir):
    key = F.concat(F.lit("tool-"), F.col("s_suppkey").cast("string")).alias("tool_key")
    suppliers = estate(spark, sf_dir).table("supplier")
    settings = suppliers.filter("s_acctbal < 0").select(key, F.array(F.lit("admin")).alias("enabled_roles"))
    out = reports.tool_registry(suppliers.select(key), settings, _all_metrics(spark, sf_dir), ["admin", "analyst", "viewer"])
    return out.select("tool_key", "uses", "total_tokens", "errors", csv("enabled_roles"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type AS action FROM events ORDER BY ts DESC, event_id LIMIT 50""")
def audit_tail(spark, sf_dir):
    log = estate(spark, sf_dir).table("events")
    return reports.last_audit(log, key="event_id").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"),
                                          F.col("event_type").alias("action"))


# ---- suggestions -----------------------------------------------------------------------

@query("""SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN a.label < 3 THEN 'pci' WHEN a.label < 6 THEN 'phi' ELSE 'customer-data' END AS shared,
          CAST(round_even(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 3) AS DOUBLE) AS similarity
          FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id 
          WHERE (CASE WHEN a.label < 3 THEN 1 WHEN a.label < 6 THEN 2 ELSE 3 END) = (CASE WHEN b.label < 3 THEN 1 WHEN b.label < 6 THEN 2 ELSE 3 END)
            AND round_even(0.5 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 0.5 * 0.8, 3) >= 0.6""")
def merge_suggestions(spark, sf_dir):
    """Vectors as sensitive assets; pairs of at least 0.6 confidence."""
    v = estate(spark, sf_dir).table("embeddings")
    key = F.lpad(F.col("vec_id").cast("string"), 12, "0")
    tag = F.when(F.col("label") < 3, "pci").when(F.col("label") < 6, "phi").when(F.col("label") < 9, "customer-data")
    assets = v.select(key.alias("asset_key"), F.lit("concrete").alias("kind"), F.array_compact(F.array(
        F.coalesce(tag, F.lit("customer-data")))).alias("tags"), F.array(F.concat(key, F.lit("/32"))).alias("ip_set"),
        F.array(F.lit("cloud")).alias("source_tools"))
    out = suggest.suggest_merges(assets, v.select(key.alias("asset_key"), F.col("embedding").alias("vector")), 0.6)
    return out.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"),
                      F.array_join("shared_sensitive_tags", ",").alias("shared"), F.col("name_similarity").alias("similarity"))
