"""Registered queries: proposals, overlay, fixes, staging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import change, fixes, staging
from ..operators.scratch import cut
from .core import FINDING_CTES, csv, query
from .estate import estate

_COUNT_C = "(SELECT count(*) FROM {customer})"
_COUNT_O = "(SELECT count(*) FROM {orders})"

PROPOSAL_SQL = f"""
SELECT concat('P-', cast(s_suppkey AS string)) AS change_id,
  CASE WHEN s_nationkey < 5 THEN '0.0.0.0/0'
    WHEN s_nationkey < 15 THEN concat('host-', cast((s_suppkey * 13) % {_COUNT_C} AS string))
    WHEN s_nationkey < 21 THEN concat('10.20.', cast(s_suppkey % 256 AS string), '.0/24')
    ELSE concat('ext-', cast(s_suppkey AS string)) END AS source,
  CASE WHEN s_acctbal > 9000 THEN concat('new-', cast(s_suppkey AS string))
    ELSE concat('host-', cast((s_suppkey * 29 + s_nationkey) % {_COUNT_C} AS string)) END AS destination,
  CASE WHEN s_acctbal < 1000 THEN 'any' WHEN s_acctbal < 3000 THEN 'tcp/3389' WHEN s_acctbal < 5000 THEN 'tcp/443'
    ELSE 'udp/443' END AS service,
  CASE WHEN s_acctbal BETWEEN 4000 AND 4500 THEN 'deny' ELSE 'allow' END AS action
FROM {{supplier}}"""


def _duck(sql: str) -> str:
    return sql.format(customer="customer", supplier="supplier", orders="orders").replace("AS string", "AS VARCHAR")


_CHANGE_CTES = {
    **FINDING_CTES,
    "prop": _duck(PROPOSAL_SQL),
    "step": """
SELECT CAST(NULL AS VARCHAR) AS change_id, s, d, tools FROM edge
UNION ALL SELECT change_id, source, destination, ['algosec'] FROM prop p WHERE action = 'allow' AND source <> destination
  AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.s = p.source AND e.d = p.destination)""",
    "after_walk": """
SELECT p.change_id, e.d AS last, [e.s, e.d] AS path, e.tools, 1 AS hops, e.change_id IS NOT NULL AS fresh
  FROM prop p JOIN step e ON e.s = '0.0.0.0/0' AND (e.change_id IS NULL OR e.change_id = p.change_id)
UNION ALL
SELECT w.change_id, e.d, list_append(w.path, e.d), list_concat(w.tools, e.tools), w.hops + 1, w.fresh OR e.change_id IS NOT NULL
  FROM after_walk w JOIN step e ON e.s = w.last AND (e.change_id IS NULL OR e.change_id = w.change_id)
  WHERE w.hops < 8 AND NOT list_contains(w.path, e.d) AND w.last LIKE 'host-%'""",
    "opened": """
SELECT w.change_id, w.path, w.last AS terminal, list_sort(list_distinct(w.tools)) AS tools,
  concat('internet->', CASE WHEN n.dmz THEN 'dmz' WHEN n.dev THEN 'dev' ELSE 'internal' END) AS boundary
FROM after_walk w JOIN node n ON n.node = w.last WHERE w.fresh AND n.sensitive""",
    "judged": """
SELECT p.*, p.source = '0.0.0.0/0' AS internet, coalesce(dn.sensitive, false) AS sensitive,
  CASE p.service WHEN 'any' THEN 1.0 WHEN 'tcp/3389' THEN 1.0 ELSE 0.4 END AS pp,
  CASE WHEN p.source = '0.0.0.0/0' THEN 1.0 WHEN p.source LIKE '%/24' THEN 0.3 ELSE 0.1 END AS ee,
  CASE WHEN p.source = '0.0.0.0/0' THEN 'internet' WHEN sn.dmz THEN 'dmz' WHEN sn.dev THEN 'dev' ELSE 'internal' END AS sz,
  CASE WHEN dn.dmz THEN 'dmz' WHEN dn.dev THEN 'dev' ELSE 'internal' END AS dz
FROM prop p LEFT JOIN node sn ON sn.node = p.source LEFT JOIN node dn ON dn.node = p.destination""",
    "delta": """
SELECT j.change_id, coalesce(o.n, 0) AS n_new_paths, coalesce(o.exposed, []) AS exposed,
  list_sort(list_distinct(list_concat(coalesce(o.bounds, []),
    CASE WHEN dz = 'internal' AND sz IN ('internet', 'dmz', 'dev') THEN [concat(sz, '->', dz)] ELSE [] END))) AS bounds,
  list_filter([CASE WHEN service = 'any' THEN 'allows every protocol and port (any/any)' END,
    CASE WHEN internet AND (pp >= 0.85 OR sensitive) THEN 'exposed directly to the internet' END,
    CASE WHEN sensitive AND ee >= 0.3 THEN 'regulated destination reachable from more than a single host' END,
    CASE WHEN pp >= 0.85 AND ee >= 0.5 THEN 'admin/data port open to a broad source range' END], lambda x: x IS NOT NULL) AS patterns,
  concat(sz, '->', dz) AS proposed_boundary, dz = 'internal' AND sz IN ('internet', 'dmz', 'dev') AS crosses,
  list_filter([CASE WHEN o.n > 0 THEN concat('opens ', cast(o.n AS VARCHAR),
      ' new internet path(s) reaching sensitive asset(s): ', cast(len(o.exposed) AS VARCHAR)) END,
    CASE WHEN internet AND service = 'any' THEN 'internet any/any' END,
    CASE WHEN internet AND service = 'tcp/3389' THEN 'admin/lateral-movement port exposed to the internet' END,
    CASE WHEN internet AND sensitive THEN 'regulated/crown-jewel asset reachable from the internet' END,
    CASE WHEN service = 'any' THEN 'introduces an any/any rule' END,
    CASE WHEN internet AND dz = 'internal' THEN 'creates new internet->internal exposure' END], lambda x: x IS NOT NULL) AS forced
FROM judged j LEFT JOIN (SELECT change_id, count(*) AS n, list_sort(list(DISTINCT terminal)) AS exposed,
    list_sort(list(DISTINCT boundary) FILTER (WHERE boundary = 'internet->internal')) AS bounds FROM opened GROUP BY 1) o
  ON o.change_id = j.change_id""",
}


def _opened(e):
    placed = cut(change.propose(e.derived(PROPOSAL_SQL, "supplier", "customer"), e.view.names, e.view.nodes))
    return placed, cut(change.new_paths(placed, e.view.passing, e.view.nodes, e.view.grants))


@query("""SELECT change_id, array_to_string(path, '>') AS path, terminal, array_to_string(tools, ',') AS tools, boundary FROM opened""",
       **_CHANGE_CTES)
def change_new_paths(spark, sf_dir):
    _, opened = _opened(estate(spark, sf_dir))
    return opened.select("change_id", csv("path", ">"), "terminal", csv("tools"), "boundary")


@query("""SELECT change_id, n_new_paths, CAST(len(exposed) AS BIGINT) AS n_exposed, array_to_string(bounds, ',') AS boundaries_crossed,
          array_to_string(patterns, ';') AS new_over_permissive, proposed_boundary, len(forced) > 0 AS forced_escalate,
          array_to_string(forced, ';') AS forced_reasons FROM delta""", **_CHANGE_CTES)
def change_delta(spark, sf_dir):
    return change.change_delta(*_opened(estate(spark, sf_dir))).select(
        "change_id", "n_new_paths", "n_exposed", csv("boundaries_crossed"), csv("new_over_permissive", ";"),
        "proposed_boundary", "forced_escalate", csv("forced_reasons", ";"))


_GATE = """
SELECT *, len(forced) > 0 AS f, n_new_paths = 0 AND len(bounds) = 0 AND len(patterns) = 0 AS clean FROM delta"""


@query("""SELECT change_id, CASE WHEN NOT f AND clean AND service <> 'udp/443' THEN 'auto_approve' ELSE 'escalate' END AS decision,
          len(patterns) = 0 AND NOT crosses AS standard_template, n_new_paths = 0 AS no_new_sensitive_reachability,
          len(bounds) = 0 AS no_new_boundary_crossing, len(patterns) = 0 AS no_over_permissive_pattern, clean AND NOT f AS eligible,
          f AS forced_escalate, CASE WHEN f THEN array_to_string(forced, '; ') WHEN service = 'udp/443' THEN 'unparseable classifier output'
            WHEN NOT clean THEN 'engine override: delta is not clean' END AS triggering_reason
          FROM gated JOIN prop USING (change_id)""", **_CHANGE_CTES, gated=_GATE)
def change_gate(spark, sf_dir):
    """Verdicts approve everything except QUIC requests, which get none."""
    e = estate(spark, sf_dir)
    delta = change.change_delta(*_opened(e))
    verdicts = e.derived(PROPOSAL_SQL, "supplier", "customer").filter("service <> 'udp/443'").select(
        "change_id", F.lit("auto_approve").alias("verdict"), F.lit(0.9).alias("confidence"), F.lit("fits").alias("rationale"))
    return change.gate(delta, verdicts).select(
        "change_id", "decision", "standard_template", "no_new_sensitive_reachability", "no_new_boundary_crossing",
        "no_over_permissive_pattern", "eligible", "forced_escalate", "triggering_reason")


# ---- overlay -----------------------------------------------------------------

EDIT_SQL = f"""
SELECT s_suppkey AS n, CASE WHEN s_nationkey = 0 THEN 'add_allow' ELSE 'remediation' END AS kind,
  CASE WHEN s_nationkey < 8 THEN 'scope_source' WHEN s_nationkey < 14 THEN 'restrict_service'
    WHEN s_nationkey < 22 THEN 'reorder_before' ELSE 'remove' END AS op,
  concat('R-', cast(((s_suppkey * s_suppkey) % 41) * 37 AS string)) AS target_ref,
  concat('10.9.', cast(s_suppkey % 256 AS string), '.0/24') AS new_source,
  CASE WHEN s_acctbal < 5000 THEN 'tcp/8443' ELSE 'quic' END AS new_service,
  concat('R-', cast(((s_suppkey * 7) % 41) * 37 AS string)) AS shadowing_ref,
  concat('host-', cast(s_suppkey % {_COUNT_C} AS string)) AS added_destination
FROM {{supplier}}"""


@query("""SELECT raw_ref, source, service, cast("order" AS BIGINT) AS rule_order FROM (
            SELECT ref AS raw_ref, source, service, seq AS "order" FROM rec WHERE ref NOT IN (SELECT ref FROM fold_start)
            UNION ALL SELECT ref, source, service, ord FROM fold WHERE k = (SELECT max(rn) FROM edit) AND NOT gone
            UNION ALL SELECT concat('ADD-', cast(n AS VARCHAR)), new_source, 'tcp/22', 9999 FROM edit WHERE kind = 'add_allow')""",
       edit=f"SELECT *, row_number() OVER (ORDER BY n) AS rn FROM ({_duck(EDIT_SQL)})",
       fold_start="SELECT ref, source, service, seq AS ord FROM rec WHERE ref IN (SELECT target_ref FROM edit UNION SELECT shadowing_ref FROM edit)",
       fold="""SELECT CAST(0 AS BIGINT) AS k, ref, source, service, ord, false AS gone FROM fold_start
               UNION ALL
               SELECT f.k + 1, f.ref, CASE WHEN hit AND e.op = 'scope_source' THEN e.new_source ELSE f.source END,
                 CASE WHEN hit AND e.op = 'restrict_service' THEN e.new_service ELSE f.service END,
                 CASE WHEN hit AND e.op = 'reorder_before' AND shadow_ord IS NOT NULL THEN shadow_ord - 1 ELSE f.ord END,
                 f.gone OR (hit AND e.op = 'remove')
               FROM (SELECT f.*, e.*, e.kind <> 'add_allow' AND e.target_ref = f.ref AS hit,
                       max(CASE WHEN f.ref = e.shadowing_ref AND NOT f.gone THEN f.ord END) OVER () AS shadow_ord
                     FROM fold f JOIN edit e ON e.rn = f.k + 1) AS x(k, ref, source, service, ord, gone, n, kind, op, target_ref,
                       new_source, new_service, shadowing_ref, added_destination, rn, hit, shadow_ord),
                 LATERAL (SELECT x.k, x.ref, x.source, x.service, x.ord, x.gone) f(k, ref, source, service, ord, gone),
                 LATERAL (SELECT x.op, x.new_source, x.new_service) e(op, new_source, new_service)""")
def overlay_apply(spark, sf_dir):
    e = estate(spark, sf_dir)
    changes = e.derived(EDIT_SQL, "supplier", "customer").withColumns({
        "at": F.struct(F.col("n")),
        "added": F.when(F.col("kind") == "add_allow", F.struct(
            F.lit("cloud").alias("source_tool"), F.concat(F.lit("ADD-"), F.col("n").cast("string")).alias("raw_ref"),
            F.col("new_source").alias("source"), F.lit("cidr").alias("source_kind"),
            F.col("added_destination").alias("destination"), F.lit("identity").alias("destination_kind"),
            F.lit("tcp/22").alias("service"), F.lit("tcp").alias("protocol"), F.lit(22).alias("port"),
            F.lit("allow").alias("action"), F.lit(9999).alias("order")))})
    return change.apply_overlay(e.normalized.records, changes).select(
        "raw_ref", "source", "service", F.col("order").cast("bigint").alias("rule_order"))


# ---- fixes -------------------------------------------------------------------

@query("""SELECT local_key AS fix_id, 'remove' AS op, raw_refs AS target_ref, NULL AS shadowing_ref FROM f_over
          UNION ALL SELECT local_key, 'remove', raw_refs, NULL FROM f_blind
          UNION ALL SELECT local_key, 'remove', split_part(raw_refs, '>', -1), NULL FROM f_chain
          UNION ALL SELECT local_key, 'reorder_before', split_part(local_key, '|', 3), shadowing_ref FROM f_shadow
          UNION ALL SELECT local_key, 'remove', (SELECT min(ref) FROM rec r WHERE r.action = 'allow' AND r.destination = f.involved
            AND r.protocol = 'udp' AND r.port = 443), NULL FROM f_fallback f
          UNION ALL SELECT f.local_key, 'remove', arg_min(r.ref, r.seq), NULL FROM f_overlap f JOIN rec r ON r.destination = f.involved
            AND r.source = split_part(f.title, ' already covers ', 2)
            AND r.service = split_part(split_part(f.title, '(', 2), ')', 1) GROUP BY f.local_key""", **FINDING_CTES)
def default_fixes(spark, sf_dir):
    e = estate(spark, sf_dir)
    return fixes.default_fixes(e.findings, e.view.records).select("fix_id", "op", "target_ref", "shadowing_ref")


def _validated(spark, sf_dir) -> DataFrame:
    e = estate(spark, sf_dir)
    wanted = cut(fixes.default_fixes(e.findings, e.view.records))
    return fixes.validate_fixes(wanted, e.view, e.findings, e.internet_paths)


@query()
def fix_validation(spark, sf_dir):
    """Every finding's default fix, proved; tested against re-running all detectors on a small estate."""
    return _validated(spark, sf_dir).withColumn("introduces_new_criticals", F.array_join("introduces_new_criticals", ";"))


@query()
def fix_gate(spark, sf_dir):
    return fixes.fix_gate(_validated(spark, sf_dir))


# ---- staging -----------------------------------------------------------------

STAGED_SQL = f"""
SELECT concat('stage-', cast(s_suppkey AS string)) AS staged_id,
  CASE WHEN s_nationkey < 20 THEN 'add_allow' ELSE 'remediation' END AS kind,
  CASE s_suppkey % 3 WHEN 0 THEN 'firewall' WHEN 1 THEN 'microseg' ELSE 'cloud' END AS target_tool,
  CASE WHEN s_acctbal < 8000 THEN 'staged' ELSE 'conflict' END AS status,
  CASE WHEN s_nationkey < 3 THEN '0.0.0.0/0' WHEN s_nationkey < 6 THEN concat('host-', cast((s_suppkey * 13) % {_COUNT_C} AS string))
    ELSE concat('10.', cast(s_suppkey % 4 AS string), '.', cast(s_suppkey % 8 AS string), '.0/',
      CASE WHEN s_nationkey < 10 THEN '8' WHEN s_nationkey < 14 THEN '16' ELSE '24' END) END AS source,
  concat('host-', cast((s_suppkey * 5) % 61 AS string)) AS destination,
  CASE WHEN s_acctbal < 1000 THEN 'any' WHEN s_acctbal < 3000 THEN 'tcp/3389' WHEN s_acctbal < 5000 THEN 'tcp/443'
    ELSE 'udp/443' END AS service,
  CASE WHEN s_acctbal < 5000 THEN concat('R-', cast(s_suppkey AS string)) ELSE concat('gone-', cast(s_suppkey AS string)) END AS target_ref
FROM {{supplier}}"""

_STAGED_CTES = {
    "staged": _duck(STAGED_SQL),
    "wanted": """
SELECT *, CASE service WHEN 'any' THEN 'any' ELSE split_part(service, '/', 1) END AS protocol,
  CASE service WHEN 'any' THEN NULL ELSE cast(split_part(service, '/', 2) AS INTEGER) END AS port,
  CASE WHEN source LIKE '%/%' THEN base // width * width END AS lo, CASE WHEN source LIKE '%/%' THEN base // width * width + width - 1 END AS hi
FROM (SELECT *, CASE WHEN source LIKE '%/%' THEN cast(pow(2, 32 - cast(split_part(source, '/', 2) AS INTEGER)) AS BIGINT) END AS width,
        CASE WHEN source LIKE '%/%' THEN cast(split_part(source, '.', 1) AS BIGINT) * 16777216
          + cast(split_part(source, '.', 2) AS BIGINT) * 65536 + cast(split_part(source, '.', 3) AS BIGINT) * 256 END AS base
      FROM staged WHERE kind = 'add_allow')""",
    "conflict": """
SELECT w.staged_id, CASE WHEN r.action = 'deny' THEN 'contradiction' WHEN r.source = w.source THEN 'duplicate' ELSE 'overlap' END AS kind,
  r.ref AS against
FROM wanted w JOIN rec r ON r.destination = w.destination
  AND (w.protocol = 'any' OR r.protocol = 'any' OR w.protocol = r.protocol) AND (w.port IS NULL OR r.port IS NULL OR w.port = r.port)
  AND (r.source = w.source OR (w.lo <= r.hi AND r.lo <= w.hi))
UNION ALL SELECT a.staged_id, 'duplicate_staged', b.staged_id FROM wanted a JOIN wanted b ON a.target_tool = b.target_tool
  AND a.destination = b.destination AND a.source = b.source AND a.staged_id <> b.staged_id AND b.status IN ('staged', 'pushed')
UNION ALL SELECT staged_id, 'stale_target', target_ref FROM staged WHERE kind <> 'add_allow' AND target_ref NOT IN (SELECT ref FROM rec)""",
}


def _staged(e) -> DataFrame:
    return e.derived(STAGED_SQL, "supplier", "customer")


# every line item as a staged change, so that many meet on a flow
LINE_SQL = """SELECT concat('line-', cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-', cast(l_partkey AS string), '-',
    cast(l_suppkey AS string)) AS staged_id, 'add_allow' AS kind, l_linestatus AS target_tool,
  CASE l_returnflag WHEN 'A' THEN 'staged' WHEN 'N' THEN 'pushed' ELSE 'rolled_back' END AS status,
  concat('app-', cast(l_suppkey % 20 AS string)) AS source, concat('svc-', cast(l_partkey % 30 AS string)) AS destination,
  'tcp/443' AS service, CAST(NULL AS string) AS target_ref FROM {lineitem}"""
_LINES = LINE_SQL.format(lineitem="lineitem").replace("AS string", "AS VARCHAR")


@query("""SELECT target_tool, destination AS d, source AS w_source, count(*) AS n_staged,
            count(*) FILTER (WHERE status IN ('staged', 'pushed')) AS n_live,
            min(CASE WHEN status IN ('staged', 'pushed') THEN staged_id END) AS first_live
          FROM line GROUP BY 1, 2, 3 HAVING count(*) > 1 AND count(*) FILTER (WHERE status IN ('staged', 'pushed')) > 0""", line=_LINES)
def sibling_classes(spark, sf_dir):
    """Flows that several staged changes target."""
    e = estate(spark, sf_dir)
    return staging.sibling_classes(e.derived(LINE_SQL, "lineitem"), e.view.names)


@query("""SELECT staged_id, n AS n_siblings FROM (SELECT staged_id, count(*) FILTER (WHERE status IN ('staged', 'pushed'))
            OVER (PARTITION BY target_tool, destination, source) - CAST(status IN ('staged', 'pushed') AS INTEGER) AS n FROM line) WHERE n > 0""", line=_LINES)
def sibling_members(spark, sf_dir):
    """Changes with live siblings, and how many."""
    e = estate(spark, sf_dir)
    return staging.sibling_members(e.derived(LINE_SQL, "lineitem"), e.view.names).select("staged_id", "n_siblings")


@query("SELECT staged_id, kind, against FROM conflict", **_STAGED_CTES)
def staged_conflicts(spark, sf_dir):
    e = estate(spark, sf_dir)
    return staging.detect_conflicts(_staged(e), e.view.placed, e.view.names).select("staged_id", "kind", "against")


@query("""SELECT s.staged_id, count(c.kind) FILTER (WHERE c.kind NOT IN ('contradiction', 'stale_target')) AS n_resolved,
          count(c.kind) FILTER (WHERE c.kind IN ('contradiction', 'stale_target')) AS n_unresolved,
          CASE WHEN count(c.kind) FILTER (WHERE c.kind IN ('contradiction', 'stale_target')) > 0 THEN 'conflict' ELSE 'pushed' END AS status
          FROM staged s LEFT JOIN conflict c ON c.staged_id = s.staged_id GROUP BY 1""", **_STAGED_CTES)
def push_outcomes(spark, sf_dir):
    e = estate(spark, sf_dir)
    return staging.push_outcomes(_staged(e), staging.conflict_counts(_staged(e), e.view.placed, e.view.names))
