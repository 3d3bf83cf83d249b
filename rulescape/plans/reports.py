"""Grouping, posture, listings and usage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from .snapshot import finding_order

BANDS = ["critical", "high", "medium", "low"]

# fixed values: published action titles and rationales, in bucket order
ACTIONS = [
    ("internet", "Close internet-exposed access to critical assets",
     "Internet-facing grants reach admin ports or regulated data -- fix first."),
    ("path", "Cut the cross-tool path to regulated data",
     "A chain across tools reaches a sensitive asset that no single tool reveals."),
    ("broad", "Tighten broad admin/data access",
     "Admin/data ports are open to wide source ranges -- scope them down."),
    ("hygiene", "Clean up redundant and dead rules",
     "Redundant and shadowed rules create false confidence and clutter."),
]
LEFTOVER = ("rest", "Review remaining findings", "Findings the grouping did not assign.")


# ---- ranked actions -----------------------------------------------------------

def action_members(findings: DataFrame, leftover: bool = False) -> DataFrame:
    """(bucket, title, rationale, finding columns): one row per finding that a bucket takes.

    Transport findings have no bucket; `leftover` puts what is left into one of its own.
    """
    bucket = (F.when((F.col("type") == "over_permissive") & F.col("forced_critical"), "internet")
              .when(F.col("type") == "cross_tool_path", "path").when(F.col("type") == "over_permissive", "broad")
              .when(F.col("type").isin("cidr_overlap", "shadowed_rule"), "hygiene"))
    if leftover:
        bucket = F.coalesce(bucket, F.lit(LEFTOVER[0]))
    texts = [*ACTIONS, LEFTOVER]
    return findings.withColumn("bucket", bucket).filter("bucket IS NOT NULL").withColumns({
        "title": L.pick({k: t for k, t, _ in texts}, "bucket"), "rationale": L.pick({k: r for k, _, r in texts}, "bucket")})


def rank_actions(members: DataFrame) -> DataFrame:
    """One row per action, worst first: forced ones lead, then band, severity, first finding.

    The findings of an action stay rows of `members`; here they are only counted.
    """
    order = F.struct((~F.col("forced_critical")).alias("a"), (-F.col("severity")).alias("b"),
                     L.band_rank("severity_band").alias("c"), F.col("type"), F.col("finding_id"))
    acts = members.groupBy("bucket").agg(
        F.first("title").alias("title"), F.first("rationale").alias("rationale"), F.count(F.lit(1)).alias("n_findings"),
        F.bool_or("forced_critical").alias("any_forced"), F.min(L.band_rank("severity_band")).alias("worst"),
        F.max("severity").alias("max_severity"), F.min_by("finding_id", order).alias("first_finding"))
    nth = F.row_number().over(Window.orderBy(F.desc("any_forced"), "worst", F.desc("max_severity"), "first_finding"))
    band = F.element_at(F.array(*[F.lit(b) for b in BANDS]), F.col("worst") + 1)
    return acts.withColumn("priority", nth).select(
        F.concat(F.lit("A"), F.col("priority").cast("string")).alias("action_id"), "bucket", "title", "rationale", "priority",
        band.alias("severity_band"), "n_findings", "max_severity", "any_forced", "first_finding")


def group_actions(groups: DataFrame, findings: DataFrame) -> DataFrame:
    """Members of a supplied grouping (bucket, title, rationale, finding_id); unknown ids drop out
    and findings no group took are added under the leftover title."""
    known = groups.join(findings.drop("title", "rationale"), "finding_id")
    rest = findings.join(groups.select("finding_id").distinct(), "finding_id", "left_anti").withColumns({
        c: F.lit(v) for c, v in zip(("bucket", "title", "rationale"), LEFTOVER)})
    return known.unionByName(rest.select(*known.columns))


# ---- posture ----------------------------------------------------------------

def posture_summary(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """One row of totals, from one pass over findings and one over assets."""
    tagged = F.coalesce(F.expr(L.overlap_sql("from_json(signals, 'dest_tags array<string>').dest_tags", L.SENSITIVE_TAGS)),
                        F.lit(False))
    reaches = F.coalesce(F.get_json_object("signals", "$.reaches_sensitive") == "true", F.lit(False))
    of_type = [F.count_if(F.col("type") == t).alias(t) for t in L.FINDING_TYPES]
    of_band = [F.count_if(F.col("severity_band") == b).alias(b) for b in BANDS]
    totals = findings.agg(
        F.count(F.lit(1)).alias("total_findings"), *of_band, *of_type,
        F.count_if("forced_critical").alias("forced_critical"),
        F.coalesce(F.bool_or(((F.col("type") == "cross_tool_path") & reaches)
                             | ((F.col("type") == "over_permissive") & F.col("forced_critical") & tagged)),
                   F.lit(False)).alias("internet_reaches_regulated_data"))
    owned = assets.agg(F.count_if(L.is_sensitive("tags")))
    return totals.withColumn("sensitive_assets", owned.scalar())


def sensitive_assets(assets: DataFrame) -> DataFrame:
    return assets.filter(L.is_sensitive("tags")).select("asset_key").orderBy("asset_key")


def top_findings(findings: DataFrame, n: int = 5) -> DataFrame:
    return findings.orderBy(*finding_order()).limit(n).select("title", F.col("severity_band").alias("band"), "severity")


def narrative(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """The deterministic report text (fixed wording), one row. Regulated assets are counted; `sensitive_assets` names them."""
    s = posture_summary(findings, assets)
    nth = F.row_number().over(Window.orderBy(F.desc("severity"), "title"))
    top = top_findings(findings).withColumn("n", nth).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(
        F.lit("- "), "title", F.lit(" ("), "band", F.lit(")\n")).alias("t")))), lambda x: x["t"]), "").alias("top"))
    names = F.when(F.col("sensitive_assets") == 0, "none tagged").otherwise(
        F.concat(F.col("sensitive_assets").cast("string"), F.lit(" assets")))
    count = {b: F.concat(F.col(b).cast("string"), F.lit(f" {b}")) for b in BANDS}
    text = F.concat(
        F.lit("## Executive summary\nThe current snapshot surfaced "), F.col("total_findings").cast("string"),
        F.lit(" policy risks across the estate ("), F.concat_ws(", ", *count.values()), F.lit("). "),
        F.when(F.col("internet_reaches_regulated_data"), "A cross-tool attack path reaches regulated data from the internet, "
               "which no single tool reveals. ").otherwise(""),
        F.col("forced_critical").cast("string"),
        F.lit(" findings are categorically unacceptable and were force-flagged critical.\n\n## Top risks\n"), "top",
        F.lit("\n## Compliance posture\nRegulated assets in scope: "), names,
        F.lit(". Internet-exposed access to PCI/customer-data assets is a PCI-DSS segmentation gap (Req. 1) and a "
              "Zero-Trust violation; closing the flagged criticals moves the estate toward an enforced-segmentation "
              "maturity level."))
    return s.withColumn("top", top.scalar()).select(text.alias("narrative"))


def explanation() -> Column:
    """Published explanation of a finding (fixed wording), from its row."""
    def s(name: str) -> Column:
        return F.coalesce(F.get_json_object("signals", f"$.{name}"), F.lit("None"))

    def listed(name: str, sep: str) -> Column:
        return F.array_join(F.from_json(F.get_json_object("signals", f"$.{name}"), "array<string>"), sep)

    refs = F.array_join("raw_refs", ", ")
    access = F.when(s("protocol") == "any", "any protocol/port").otherwise(
        F.coalesce(F.get_json_object("signals", "$.port_name"), s("service")))
    src = F.when(s("source") == L.INTERNET, f"the internet ({L.INTERNET})").otherwise(s("source"))
    tags = F.coalesce(F.nullif(listed("dest_tags", ", "), F.lit("")), F.lit("internal"))
    why = F.coalesce(F.nullif(listed("reasons", "; "), F.lit("")), F.lit("the grant is broader than necessary"))
    path = F.from_json(F.get_json_object("signals", "$.display_path"), "array<string>")
    return (F.when(F.col("type") == "over_permissive", F.concat(
                F.lit("Rule "), refs, F.lit(" allows "), access, F.lit(" from "), src, F.lit(" to "), s("dest_display"),
                F.lit(" ("), tags, F.lit("). This is over-permissive because "), why,
                F.lit(". Suggested fix: scope the source to only the hosts that genuinely need "), access,
                F.lit(", and remove any internet exposure.")))
            .when(F.col("type") == "cross_tool_path", F.concat(
                F.lit("A reachability chain crosses "), F.size("source_tools").cast("string"), F.lit(" tools ("),
                F.array_join("source_tools", ", "), F.lit(") from "), F.try_element_at(path, F.lit(1)), F.lit(" to "),
                F.try_element_at(path, F.lit(-1)), F.lit(" ("), listed("terminal_tags", ", "), F.lit(") -- a "),
                s("boundary"), F.lit(" crossing that no single tool reveals. Break one hop (e.g. rule "),
                F.try_element_at("raw_refs", F.lit(1)), F.lit(") to cut the chain.")))
            .when(F.col("type") == "cidr_overlap", F.concat(
                F.lit("Rules "), refs, F.lit(" are redundant: "), s("outer"), F.lit(" already covers "), s("inner"),
                F.lit(" for "), s("dest"), F.lit(" ("), s("service"),
                F.lit("). Remove the narrower rule to cut policy clutter.")))
            .when(F.col("type") == "shadowed_rule", F.concat(
                s("reason"), F.lit(" Reorder or remove rule "), s("shadowed_ref"),
                F.lit(" so the intended policy is actually enforced.")))
            .otherwise(F.concat("title", F.lit(" (refs: "), F.coalesce(refs, F.lit("")), F.lit(")."))))


def suggested_questions(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """Up to four questions (n, question) raised by this snapshot's facts; wording is fixed."""
    def first(df: DataFrame, n: int, text: Column) -> DataFrame:
        return df.limit(1).select(F.lit(n).alias("n"), text.alias("question"))

    ordered = findings.orderBy(*finding_order())

    def s(name: str) -> Column:
        return F.get_json_object("signals", f"$.{name}")

    path = ordered.filter("type = 'cross_tool_path'")
    broad = ordered.filter("type = 'over_permissive'")
    spark = findings.sparkSession
    parts = [
        first(path, 1, F.concat(F.lit("Can the internet reach "), s("terminal"), F.lit(", and through which path and tools?"))),
        first(sensitive_assets(assets), 2, F.concat(F.lit("What can reach "), "asset_key", F.lit("?"))),
        first(broad, 3, F.concat(F.lit("What would happen if I open "), F.coalesce(s("service"), F.lit("tcp/22")), F.lit(" from "),
                                 s("source"), F.lit(" to "), F.coalesce(s("dest_display"), s("dest")), F.lit("?"))),
        first(findings.filter("forced_critical"), 4, F.lit("Which findings are forced-critical, and why?")),
        spark.range(1).select(F.lit(5).alias("n"), F.lit("Summarize the riskiest exposure in this snapshot.").alias("question")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("n").limit(4)


# ---- listings ---------------------------------------------------------------

def snapshot_counts(snapshots: DataFrame, assets: DataFrame, rules: DataFrame, findings: DataFrame) -> DataFrame:
    """Snapshots, newest first, with how much each holds."""
    def per(df: DataFrame, *aggs: Column) -> DataFrame:
        return df.groupBy("snapshot_id").agg(*aggs)

    zero = F.lit(0).cast("bigint")
    n = F.count(F.lit(1))
    df = (snapshots.join(per(assets, n.alias("assets")), "snapshot_id", "left")
          .join(per(rules, n.alias("rules")), "snapshot_id", "left")
          .join(per(findings, n.alias("findings"), F.count_if(F.col("type") == "cross_tool_path").alias("paths"),
                    F.count_if(F.col("severity_band") == "critical").alias("critical")), "snapshot_id", "left"))
    return df.withColumns({c: F.coalesce(c, zero) for c in ("assets", "rules", "findings", "paths", "critical")}).orderBy(
        F.desc("created_at"), "snapshot_id")


def table_counts(tables: dict[str, DataFrame], snapshot_id: str | None = None) -> DataFrame:
    """(snapshot_id, table, n) over the given tables."""
    out = None
    for name, df in tables.items():
        if snapshot_id is not None:
            df = df.filter(F.col("snapshot_id") == snapshot_id)
        part = df.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n")).select("snapshot_id", F.lit(name).alias("table"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def finding_listing(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("forced_critical"), F.desc("severity"), "type", "finding_id")


def finding(findings: DataFrame, finding_id: str | Column) -> DataFrame:
    """The finding of that id; no row if there is none."""
    return findings.filter(F.col("finding_id") == finding_id)


def decision_log(decisions: DataFrame, requests: DataFrame, staged: DataFrame, limit: int = 25) -> DataFrame:
    """Latest decisions with their request and, if any, staged change; undated ones last."""
    d = decisions.select("decision_id", "request_id", "decision", "forced_escalate", "confidence", "decided_at")
    r = requests.select("request_id", "kind", "origin", "requested_by", F.col("status").alias("request_status"))
    s = staged.select("request_id", "staged_id", F.col("status").alias("staged_status"))
    return d.join(r, "request_id").join(s, "request_id", "left").orderBy(
        F.desc_nulls_last("decided_at"), "decision_id").limit(limit)


def open_or_done(log: DataFrame) -> DataFrame:
    """Add `tab`: a decision is done once staged or rejected."""
    done = F.col("staged_id").isNotNull() | (F.coalesce(F.col("request_status"), F.lit("open")) == "rejected")
    return log.withColumn("tab", F.when(done, "done").otherwise("pending"))


def staging_list(staged: DataFrame, requests: DataFrame) -> DataFrame:
    return staged.join(requests.select("request_id", "justification", "requested_by"), "request_id", "left").orderBy(
        F.desc("created_at"), "staged_id")


def siblings(staged: DataFrame, staged_id: str | Column) -> DataFrame:
    """Other live changes for the same tool."""
    tool = staged.filter(F.col("staged_id") == staged_id).select("target_tool")
    return staged.filter(F.col("status").isin("staged", "pushed") & (F.col("staged_id") != staged_id)).join(
        tool, "target_tool", "left_semi")


def rule_by_ref(rules: DataFrame, ref: str) -> DataFrame:
    return rules.filter(F.col("raw_rule_id") == ref)


def ingest_inspection(rules: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct sources, resolved objects and rules of a snapshot, ordered."""
    return (rules.select(F.col("source_tool").alias("tool"), F.col("source_device").alias("device")).distinct().orderBy("tool"),
            resolved.orderBy("source_tool", "object_name"), rules.orderBy("source_tool", "rule_order"))


def last_audit(log: DataFrame, n: int = 50, key: str = "id") -> DataFrame:
    """The newest rows; `key` settles ties of time."""
    return log.orderBy(F.desc("ts"), key).limit(n)


def thread(revisions: DataFrame, thread_id: str) -> DataFrame:
    return revisions.filter(F.col("thread_id") == thread_id).orderBy("seq")


def search(df: DataFrame, needle: str, *haystack: Column) -> DataFrame:
    """Rows whose joined, lower-cased texts contain the needle; an empty needle keeps all."""
    text = needle.strip().lower()
    return df.filter(F.contains(F.lower(F.concat_ws(" ", *haystack)), F.lit(text))) if text else df


def sort_rows(df: DataFrame, key: str, descending: bool = False, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(key) if descending else F.asc(key), *ties)


# ---- usage metrics ------------------------------------------------------------

def last_days(metrics: DataFrame, days: int, now: Column) -> DataFrame:
    """Calls of the last `days` (1-365) before `now`, an explicit timestamp."""
    days = max(1, min(days, 365))
    return metrics.filter(F.col("ts") > now - F.make_dt_interval(F.lit(days)))


def _usage(*extra: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), *extra]


def _cost() -> Column:
    return F.coalesce(F.sum("est_cost_usd"), F.lit(0)).alias("cost")


def _mean() -> Column:
    return F.coalesce(F.round(F.avg("latency_ms")), F.lit(0)).cast("bigint").alias("avg_latency")


def _errors() -> Column:
    return F.coalesce(F.sum(F.when(F.col("ok"), 0).otherwise(1)), F.lit(0)).alias("errors")


def metric_totals(m: DataFrame) -> DataFrame:
    return m.agg(*_usage(_cost(), _mean(), _errors()))


def latency_percentiles(m: DataFrame, levels: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Discrete percentiles p50, p95 of whole-millisecond latency.

    Calls are first counted per latency, so what is ordered is bounded by the range of
    latencies, not by the number of calls.
    """
    counts = m.filter("latency_ms IS NOT NULL").groupBy("latency_ms").agg(F.count(F.lit(1)).alias("n"))
    in_order = Window.orderBy("latency_ms")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = counts.withColumns({"upto": F.sum("n").over(in_order), "total": F.sum("n").over(whole)})
    return marked.agg(*[F.coalesce(F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p), F.col("latency_ms"))),
                                   F.lit(0)).alias(f"p{round(p * 100)}") for p in levels])


def by_provider(m: DataFrame) -> DataFrame:
    return m.groupBy("provider", "model").agg(*_usage(_cost())).orderBy(F.desc("calls"), "provider", "model")


def by_capability(m: DataFrame) -> DataFrame:
    return m.groupBy("capability").agg(*_usage(_cost(), _mean())).orderBy(F.desc("calls"), "capability")


def by_role(m: DataFrame) -> DataFrame:
    return m.groupBy("role").agg(*_usage()).orderBy(F.desc("calls"), "role")


def daily(m: DataFrame) -> DataFrame:
    day = F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd")
    return m.groupBy(day.alias("day")).agg(*_usage(_cost())).orderBy("day")


def top_tools(m: DataFrame, n: int = 8) -> DataFrame:
    return m.groupBy("tool_name").agg(F.count(F.lit(1)).alias("uses"),
                                      F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens")).orderBy(
        F.desc("uses"), "tool_name").limit(n)


def tool_registry(registry: DataFrame, settings: DataFrame, m: DataFrame, all_roles: list[str]) -> DataFrame:
    """Every registered tool with its enabled roles and usage; unused ones show zeros."""
    used = m.groupBy("tool_name").agg(
        F.count(F.lit(1)).alias("uses"), F.round(F.avg("latency_ms")).cast("bigint").alias("avg_latency_ms"),
        F.sum("total_tokens").alias("total_tokens"), F.sum("est_cost_usd").alias("est_cost_usd"), _errors(),
        F.max("ts").alias("last_used")).withColumnRenamed("tool_name", "tool_key")
    df = registry.join(settings.select("tool_key", "enabled_roles"), "tool_key", "left").join(used, "tool_key", "left")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("uses", "avg_latency_ms", "total_tokens", "est_cost_usd", "errors")}
    return df.withColumns({"enabled_roles": F.coalesce("enabled_roles", L.strings(all_roles)), **zeros})


def status_counts(decisions: DataFrame, staged: DataFrame, findings: DataFrame) -> DataFrame:
    """(measure, value, n): decisions, staged changes, findings and critical findings."""
    def per(df: DataFrame, measure: str, column: str) -> DataFrame:
        return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(measure).alias("measure"), "value", "n")

    crit = findings.agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity_band") == "critical").alias("critical"))
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(v).alias("n")) for v in ("findings", "critical")]))
    return per(decisions, "decision", "decision").unionByName(per(staged, "staging", "status")).unionByName(
        crit.select(pairs.alias("x")).select(F.lit("findings").alias("measure"), "x.*"))
