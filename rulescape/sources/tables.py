"""Tables at rest: snapshot projections, partitioned writes, upserts, logs and domain checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import lookups as L
from ..functions.score import token_cost
from ..operators.scratch import write_table
from .exports import CLOUD, FIREWALL, MICROSEG

# fixed values: the device each connector reports for
DEVICES = {FIREWALL: "afa-edge-fw-01", MICROSEG: "guardicore-mgmt", CLOUD: "wiz-cloud-connector"}


# ---- projections of one snapshot --------------------------------------------

def _asset_id(sid: str, key: str) -> Column:
    return ids.stable_id("asset", F.lit(sid), F.col(key))


def _rule_uid(sid: str) -> Column:
    return ids.stable_id("rule", F.lit(sid), F.col("source_tool"), F.col("raw_ref"))


def stored_ports() -> Column:
    return F.expr("""CASE WHEN protocol = 'any' OR port IS NULL
        THEN CAST(array() AS array<struct<proto:string,port_start:int,port_end:int>>)
        ELSE array(named_struct('proto', protocol, 'port_start', port, 'port_end', coalesce(port_end, port))) END""")


def stored_value(side: str) -> Column:
    text = ids.json_text(F.col(side))
    return F.when(F.col(f"{side}_kind") == "cidr", F.concat(F.lit('{"cidrs":['), text, F.lit("]}"))).otherwise(
        F.concat(F.lit('{"identity":'), text, F.lit("}")))


def canonical_rules(placed: DataFrame, sid: str) -> DataFrame:
    return placed.select(
        _rule_uid(sid).alias("rule_uid"), "source_tool", L.pick(DEVICES, "source_tool").alias("source_device"),
        F.col("raw_ref").alias("raw_rule_id"), F.col("order").alias("rule_order"), "action",
        F.col("source_kind").alias("src_kind"), stored_value("source").alias("src_value"),
        F.col("destination_kind").alias("dst_kind"), stored_value("destination").alias("dst_value"), "protocol",
        stored_ports().alias("ports"), "l7_app", F.col("dest_tags").alias("tags"), F.lit(True).alias("enabled"),
        F.array(_asset_id(sid, "s")).alias("src_asset_refs"), F.array(_asset_id(sid, "d")).alias("dst_asset_refs"),
        F.lit(sid).alias("snapshot_id"))


def graph_node_rows(nodes: DataFrame, sid: str) -> DataFrame:
    kind = F.when(F.col("node") == L.INTERNET, "internet").when(F.col("kind") == "abstract", "subnet").otherwise("asset")
    return nodes.select(F.col("node").alias("node_id"), kind.alias("kind"), F.col("display").alias("label"),
                        _asset_id(sid, "node").alias("asset_id"), "tags", "ip_set", F.lit(sid).alias("snapshot_id"))


def graph_edge_rows(placed: DataFrame, sid: str) -> DataFrame:
    """One row per allow rule, between canonical ends."""
    return placed.filter("action = 'allow'").select(
        ids.stable_id("edge", F.lit(sid), F.col("source_tool"), F.col("raw_ref")).alias("edge_id"),
        F.col("s").alias("src_node"), F.col("d").alias("dst_node"), "action", stored_ports().alias("ports"), "l7_app",
        _rule_uid(sid).alias("rule_uid"), "source_tool", L.pick(DEVICES, "source_tool").alias("enforcement_point"),
        F.lit(sid).alias("snapshot_id"))


def source_rows(records: DataFrame) -> DataFrame:
    """Registry of connectors, one per tool (not per snapshot)."""
    return records.select("source_tool").distinct().select(
        ids.stable_id("src", F.col("source_tool")).alias("source_id"), F.col("source_tool").alias("tool"),
        F.coalesce(L.pick(DEVICES, "source_tool"), "source_tool").alias("device"),
        F.lit('{"mode":"simulated_export"}').alias("config"))


def asset_rows(assets: DataFrame, sid: str) -> DataFrame:
    return assets.select(_asset_id(sid, "asset_key").alias("asset_id"), "asset_key", "kind", "context", "identifiers",
                         "ip_set", "tags", "source_tools", F.lit(sid).alias("snapshot_id"))


def correlation_rows(correlations: DataFrame, sid: str) -> DataFrame:
    return correlations.select(
        ids.stable_id("corr", F.lit(sid), F.col("asset_key"), F.col("match_key"), F.col("evidence")).alias("id"),
        _asset_id(sid, "asset_key").alias("asset_id"), "match_key",
        F.col("confidence").cast("decimal(4,3)").alias("confidence"), "evidence", F.lit(sid).alias("snapshot_id"))


def resolved_object_rows(resolved: DataFrame, sid: str) -> DataFrame:
    return resolved.select(
        ids.stable_id("ro", F.lit(sid), F.col("source_tool"), F.coalesce("source_device", F.lit("")), F.col("object_name"),
                      F.col("object_kind")).alias("id"), *resolved.columns, F.lit(sid).alias("snapshot_id"))


def finding_rows(findings: DataFrame, sid: str) -> DataFrame:
    """Findings at rest; the title is kept among the signals as well."""
    signals = F.concat(F.expr("left(signals, length(signals) - 1)"), F.lit(',"title":'), ids.json_text(F.col("title")), F.lit("}"))
    return findings.select(
        "finding_id", "type", "severity", "severity_band", "forced_critical", "title", signals.alias("signals"), "involved",
        "raw_refs", "source_tools", F.lit(None).cast("string").alias("explanation"), F.lit(sid).alias("snapshot_id"))


def snapshot_tables(snap) -> dict[str, DataFrame]:
    """The child tables of a `plans.snapshot.Snapshot`, ready to write."""
    v, sid = snap.view, snap.snapshot_id
    return {
        "resolved_objects": resolved_object_rows(snap.resolved, sid), "assets": asset_rows(v.identities.assets, sid),
        "asset_correlations": correlation_rows(v.identities.correlations, sid),
        "canonical_rules": canonical_rules(v.placed, sid), "graph_nodes": graph_node_rows(v.nodes, sid),
        "graph_edges": graph_edge_rows(v.placed, sid), "findings": finding_rows(snap.findings, sid),
    }


CHILD_TABLES = ["resolved_objects", "assets", "asset_correlations", "canonical_rules", "graph_nodes", "graph_edges",
                "findings", "ranked_actions"]
CHANGE_TABLES = ["staged_changes", "change_decisions", "change_requests", "remediation_revisions"]


# ---- files ------------------------------------------------------------------

def _remove(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def write_snapshot(snap, base: str, created_at: str | None = None) -> None:
    """Replace the snapshot's partition of every table, and upsert the snapshot and source rows."""
    spark = snap.findings.sparkSession
    for name, df in snapshot_tables(snap).items():
        keys = {"resolved_objects": ["id"], "assets": ["asset_id"], "asset_correlations": ["id"],
                "canonical_rules": ["rule_uid"], "graph_nodes": ["node_id"], "graph_edges": ["edge_id"],
                "findings": ["finding_id"]}[name]
        # rows first: the partition of an earlier run stays until the new one is complete
        rows, seen = write_table(last_of_batch(df, keys))
        if seen["rows"]:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{base}/{name}")
        else:
            rows.limit(0).write.mode("append").partitionBy("snapshot_id").parquet(f"{base}/{name}")
            _remove(spark, f"{base}/{name}/snapshot_id={snap.snapshot_id}")
    stamp = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    row = spark.range(1).select(F.lit(snap.snapshot_id).alias("snapshot_id"), F.lit(snap.label).alias("label"),
                                F.lit("complete").alias("status"), stamp.alias("created_at"))
    upsert_table(row, f"{base}/snapshots", ["snapshot_id"])
    upsert_table(source_rows(snap.view.records), f"{base}/sources", ["source_id"])


def read_table(spark: SparkSession, base: str, name: str, snapshot_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{base}/{name}")
    return df if snapshot_id is None else df.filter(F.col("snapshot_id") == snapshot_id)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def drop_snapshot(spark: SparkSession, base: str, snapshot_id: str, active: str) -> None:
    """Delete a snapshot's partitions and its row; the active one is protected."""
    if snapshot_id == active:
        raise ValueError("the active snapshot cannot be deleted")
    for name in CHILD_TABLES:
        _remove(spark, f"{base}/{name}/snapshot_id={snapshot_id}")
    replace_table(read_table(spark, base, "snapshots").filter(F.col("snapshot_id") != snapshot_id), f"{base}/snapshots")


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a table, also with rows that were read from it: write beside it, then swap the folders."""
    spark = df.sparkSession
    beside, before = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    files = as_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(as_path(path)):
        files.rename(as_path(path), as_path(before))
    files.rename(as_path(beside), as_path(path))
    files.delete(as_path(before), True)
    spark.catalog.refreshByPath(path)


def clear_tables(spark: SparkSession, base: str, names: Iterable[str] = CHANGE_TABLES) -> None:
    for name in names:
        if exists(spark, f"{base}/{name}"):
            replace_table(read_table(spark, base, name).limit(0), f"{base}/{name}")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


# ---- keyed rows ---------------------------------------------------------------

def last_of_batch(df: DataFrame, keys: list[str], seq: Column | None = None) -> DataFrame:
    """One row per key: the last by `seq` (an aggregate, so a repeated key needs no sort).

    Ties, and batches without an order, are settled by the rows' own content, so reruns agree.
    """
    rest = [c for c in df.columns if c not in keys]
    content = F.to_json(F.struct(*rest))
    order = content if seq is None else F.struct(seq.alias("seq"), content.alias("content"))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], seq: Column | None = None) -> DataFrame:
    """Rows of `batch` replace rows of `existing` with the same keys; columns the batch lacks are kept."""
    new = last_of_batch(batch, keys, seq)
    kept = [c for c in existing.columns if c not in new.columns]
    if kept:
        new = new.join(existing.select(*keys, *kept), keys, "left")
    untouched = existing.join(new.select(*keys), keys, "left_anti")
    return untouched.unionByName(new, allowMissingColumns=True)


def upsert_table(batch: DataFrame, path: str, keys: list[str], seq: Column | None = None) -> None:
    spark = batch.sparkSession
    if exists(spark, path):
        replace_table(upsert(spark.read.parquet(path), batch, keys, seq), path)
    else:
        last_of_batch(batch, keys, seq).write.parquet(path)


def update_status(existing: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Set the columns of `updates` on the rows it names; unknown keys are ignored."""
    known = updates.join(existing.select(key), key, "left_semi")
    return upsert(existing, known, [key])


def reject(requests: DataFrame, rejected: DataFrame) -> DataFrame:
    """`rejected`: request_id, rejected_by, reject_reason."""
    return update_status(requests, rejected.withColumn("status", F.lit("rejected")), "request_id")


def accept_revisions(revisions: DataFrame, accepted: DataFrame) -> DataFrame:
    """`accepted`: revision_id."""
    return update_status(revisions, accepted.select("revision_id", F.lit("accepted").alias("status")), "revision_id")


# ---- confirmed merges ---------------------------------------------------------

def _merge_rows(pairs: DataFrame) -> DataFrame:
    df = pairs.withColumns({"__a": F.least("name_a", "name_b"), "__b": F.greatest("name_a", "name_b")})
    return df.withColumns({"name_a": F.col("__a"), "name_b": F.col("__b")}).drop("__a", "__b").withColumn(
        "merge_id", ids.stable_id("merge", F.col("name_a"), F.col("name_b")))


def add_merges(existing: DataFrame, pairs: DataFrame) -> DataFrame:
    """Insert confirmed pairs that are not there yet (the first confirmation stays)."""
    new = last_of_batch(_merge_rows(pairs), ["merge_id"])
    return existing.unionByName(new.join(existing.select("merge_id"), "merge_id", "left_anti"), allowMissingColumns=True)


def remove_merges(existing: DataFrame, pairs: DataFrame) -> DataFrame:
    return existing.join(_merge_rows(pairs).select("merge_id"), "merge_id", "left_anti")


# ---- revision threads -----------------------------------------------------------

def thread_id(snapshot_id: str = "snapshot_id", finding_id: str = "finding_id") -> Column:
    return ids.stable_id("rthread", F.coalesce(F.col(snapshot_id), F.lit("")), F.col(finding_id))


def next_revisions(existing: DataFrame, drafts: DataFrame, order: str) -> DataFrame:
    """Number drafts (snapshot_id, finding_id, ...) on from the last revision of their thread."""
    df = drafts.withColumn("thread_id", thread_id())
    last = existing.groupBy("thread_id").agg(F.max("seq").alias("__last"))
    nth = F.row_number().over(Window.partitionBy("thread_id").orderBy(order))
    df = df.join(last, "thread_id", "left").withColumn("seq", (F.coalesce("__last", F.lit(-1)) + nth).cast("int"))
    return df.withColumns({
        "revision_id": ids.stable_id("rev", F.col("thread_id"), F.col("seq").cast("string")),
        "status": F.lit("draft")}).drop("__last")


# ---- event logs -----------------------------------------------------------------

def audit_rows(events: DataFrame) -> DataFrame:
    """Append-ready rows from actor, action and optional subject, snapshot_id, detail (JSON)."""
    for name, default in (("subject", None), ("snapshot_id", None), ("detail", "{}")):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(default).cast("string"))
    return events.select(F.uuid().alias("id"), F.current_timestamp().alias("ts"), "actor", "action", "subject",
                         "snapshot_id", F.coalesce("detail", F.lit("{}")).alias("detail"))


def metric_rows(calls: DataFrame) -> DataFrame:
    """Add total tokens, cost and tool name to measured calls; error texts stay whole, an empty one is none."""
    zero = F.lit(0)
    return calls.withColumns({
        "prompt_tokens": F.coalesce("prompt_tokens", zero), "completion_tokens": F.coalesce("completion_tokens", zero),
    }).withColumns({
        "total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"),
        "est_cost_usd": token_cost("coalesce(provider, '')", "coalesce(model, '')", "prompt_tokens",
                                   "completion_tokens").cast("decimal(12,6)"),
        "tool_name": F.coalesce("tool_name", "capability"),
        "error": F.nullif("error", F.lit("")),
    })


# ---- domain checks ----------------------------------------------------------------

ALLOWED = {   # fixed values: the domains of coded columns
    ("snapshots", "status"): ["running", "complete", "failed"],
    ("assets", "kind"): ["concrete", "abstract"],
    ("asset_correlations", "match_key"): ["cloud_id", "hostname", "mac", "context_ip", "manual_review"],
    ("resolved_objects", "object_kind"): ["address", "service", "zone", "application", "user", "tag_group"],
    ("canonical_rules", "action"): ["allow", "deny"],
    ("canonical_rules", "src_kind"): ["cidr", "identity"],
    ("canonical_rules", "dst_kind"): ["cidr", "identity"],
    ("graph_nodes", "kind"): ["asset", "zone", "subnet", "internet", "enforcement_point"],
    ("graph_edges", "action"): ["allow", "deny"],
    ("findings", "type"): L.FINDING_TYPES,
    ("findings", "severity_band"): ["low", "medium", "high", "critical"],
    ("change_decisions", "decision"): ["auto_approve", "escalate"],
    ("audit_log", "actor"): ["agent", "user", "system"],
    ("sources", "tool"): ["algosec", "guardicore", "wiz", "sd_wan", "sd_lan"],
}
BETWEEN = {("findings", "severity"): (0, 100), ("asset_correlations", "confidence"): (0, 1),
           ("change_decisions", "confidence"): (0, 1)}
UNIQUE = {
    "snapshots": ["snapshot_id"], "sources": ["source_id"], "resolved_objects": ["snapshot_id", "source_device", "object_name", "object_kind"],
    "assets": ["asset_id"], "asset_correlations": ["id"], "canonical_rules": ["rule_uid"],
    "graph_nodes": ["snapshot_id", "node_id"], "graph_edges": ["snapshot_id", "edge_id"], "findings": ["finding_id"],
    "ranked_actions": ["snapshot_id", "action_id"], "change_requests": ["request_id"], "change_decisions": ["decision_id"],
    "remediation_revisions": ["thread_id", "seq"],
}
REFERENCES = [("asset_correlations", "asset_id", "assets", "asset_id"), ("graph_nodes", "asset_id", "assets", "asset_id"),
              ("change_decisions", "request_id", "change_requests", "request_id")]


def domain_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, violations) for every rule that applies to the given tables.

    All value rules of a table share one scan.
    """
    out = []
    for name, df in tables.items():
        rules = {f"{c} in domain": ~F.col(c).isin(v) for (t, c), v in ALLOWED.items() if t == name and c in df.columns}
        rules |= {f"{c} in range": ~F.col(c).between(*v) for (t, c), v in BETWEEN.items() if t == name and c in df.columns}
        if rules:
            counted = df.agg(*[F.count_if(bad).alias(r) for r, bad in rules.items()])
            pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("violations")) for r in rules]))
            out.append(counted.select(pairs.alias("x")).select(F.lit(name).alias("table"), "x.*"))
        keys = UNIQUE.get(name)
        if keys and set(keys) <= set(df.columns):
            # NULLs never clash, as in a unique constraint
            whole = df.dropna(subset=keys).groupBy(*keys).count().filter("count > 1")
            out.append(whole.agg(F.count(F.lit(1)).alias("violations")).select(
                F.lit(name).alias("table"), F.lit("unique " + ", ".join(keys)).alias("rule"), "violations"))
    for child, col, parent, key in REFERENCES:
        if child in tables and parent in tables:
            c = tables[child].filter(F.col(col).isNotNull()).select(F.col(col).alias(key))
            lost = c.join(tables[parent].select(key), key, "left_anti")
            out.append(lost.agg(F.count(F.lit(1)).alias("violations")).select(
                F.lit(child).alias("table"), F.lit(f"{col} exists in {parent}").alias("rule"), "violations"))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def require_clean(tables: dict[str, DataFrame]) -> None:
    broken = domain_checks(tables).filter("violations > 0").collect()      # at most one row per rule
    if broken:
        raise ValueError("; ".join(f"{r['table']}: {r['rule']} ({r['violations']})" for r in broken))
