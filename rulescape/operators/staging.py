"""Conflicts of staged changes with current rules and with each other, and push outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.service import same_traffic, with_service
from ..sources.normalize import with_endpoint
from .detect.nesting import NET_KEY, enclosing, group_lengths
from .joins import lookup
from .scratch import cut

BLOCKING = ["contradiction", "stale_target"]


def _staged_allows(staged: DataFrame, names: DataFrame) -> DataFrame:
    df = staged.filter("kind = 'add_allow'").withColumn("__svc", F.expr("coalesce(service, 'any')")).drop("service")
    df = with_service(with_endpoint(df, "source", "__s"), "__svc")
    df = lookup(df, F.col("destination"), names, "name", {"__node": "node"}, F.col("staged_id"))
    return df.select("staged_id", "target_tool", "status", F.col("source").alias("w_source"),
                     F.coalesce("__node", "destination").alias("d"), F.col("__s_net").alias("src_net"),
                     F.col("protocol").alias("w_protocol"), F.col("port").alias("w_port"))


def _meetings(want: DataFrame, placed: DataFrame) -> DataFrame:
    """Rules into the same destination whose source equals or nests with the staged one.

    Three hash joins - same text, staged inside rule, rule inside staged - so a busy
    destination is never paired up whole.
    """
    rule = placed.select("d", "source", "action", "raw_ref", "record_seq", "src_net", F.col("protocol").alias("r_protocol"),
                         F.col("port").alias("r_port"))
    busy = want.select("d").distinct()
    near = cut(rule.join(busy, "d", "left_semi"))
    w = want.drop("status", "target_tool")
    same = w.join(near.drop("src_net"), (F.col("w_source") == F.col("source")) & (w["d"] == near["d"])).drop(near["d"])
    nets = near.filter("src_net IS NOT NULL")

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({k: F.col(f"src_net.{k}") for k in NET_KEY}).drop("src_net")

    wn = w.filter("src_net IS NOT NULL")
    inside = enclosing(wn, group_lengths(nets, ["d"], 1), ["d"]).drop("src_net").join(keyed(nets), ["d", *NET_KEY])
    around = enclosing(nets.withColumn("own", F.col("src_net.plen")), group_lengths(wn, ["d"], 1), ["d"]).drop("src_net").join(
        keyed(wn), ["d", *NET_KEY]).filter(F.col("own") > F.col("plen")).drop("own")
    nested = inside.unionByName(around).filter("w_source <> source").drop(*NET_KEY)
    return same.drop("src_net").unionByName(nested).filter(same_traffic("w", "r"))


_FLOW = ["target_tool", "d", "w_source"]


def _live() -> Column:
    return F.col("status").isin("staged", "pushed")


def sibling_classes(staged: DataFrame, names: DataFrame) -> DataFrame:
    """Staged changes of one flow as one row: `target_tool, d, w_source, n_staged, n_live, first_live`.

    Only flows on which some change meets a live sibling. A flow that a third of all changes share is one row,
    counted by partial sums.
    """
    return _classes(_staged_allows(staged, names)).filter(F.col("n_staged") > 1)


def _classes(want: DataFrame) -> DataFrame:
    return want.groupBy(*_FLOW).agg(
        F.count(F.lit(1)).alias("n_staged"), F.count_if(_live()).alias("n_live"),
        F.min(F.when(_live(), F.col("staged_id"))).alias("first_live")).filter("n_live > 0")


def sibling_members(staged: DataFrame, names: DataFrame) -> DataFrame:
    """Members of the classes: `target_tool, d, w_source, staged_id, n_siblings`, the live changes beside each one.

    The pairs of `detect_conflicts` are these rows joined with the live members of their class; rows here
    are linear in the changes.
    """
    return _members(cut(_staged_allows(staged, names)))


def _members(want: DataFrame) -> DataFrame:
    own = F.when(_live(), 1).otherwise(0)
    return want.join(_classes(want), _FLOW).withColumn("n_siblings", F.col("n_live") - own).filter("n_siblings > 0").select(
        *_FLOW, "staged_id", "n_siblings")


def detect_conflicts(staged: DataFrame, placed: DataFrame, names: DataFrame) -> DataFrame:
    """(staged_id, kind, against, detail, resolution); texts are the published ones (fixed values).

    `staged`: staged_id, kind, target_tool, status, source, destination, service, target_ref. Every sibling
    is named, so the result is quadratic in the changes of one flow; `conflict_counts` is not.
    """
    want = cut(_staged_allows(staged, names))
    other = want.filter(_live()).select(*_FLOW, F.col("staged_id").alias("other_id"))
    siblings = want.join(other, _FLOW).filter("other_id <> staged_id").select(
        "staged_id", F.lit("duplicate_staged").alias("kind"), F.col("other_id").alias("against"),
        F.concat(F.lit("another staged change targets the same flow ("), "other_id", F.lit(")")).alias("detail"),
        F.lit("Skip: a sibling staged change already covers this flow.").alias("resolution"))
    return _rule_conflicts(want, staged, placed).unionByName(siblings)


def conflict_counts(staged: DataFrame, placed: DataFrame, names: DataFrame) -> DataFrame:
    """(staged_id, kind, n): how many conflicts of each kind a change has; siblings are counted, never paired."""
    want = cut(_staged_allows(staged, names))
    n = F.count(F.lit(1)).alias("n")
    beside = _members(want).select("staged_id", F.lit("duplicate_staged").alias("kind"), F.col("n_siblings").alias("n"))
    return _rule_conflicts(want, staged, placed).groupBy("staged_id", "kind").agg(n).unionByName(beside)


def _rule_conflicts(want: DataFrame, staged: DataFrame, placed: DataFrame) -> DataFrame:
    """Conflicts with rules of the snapshot."""
    ref, src = F.col("raw_ref"), F.col("source")
    met = _meetings(want, placed)
    kind = (F.when((F.col("action") == "allow") & (src == F.col("w_source")), "duplicate")
            .when(F.col("action") == "allow", "overlap").otherwise("contradiction"))
    against_rules = met.withColumn("conflict", kind).select(
        "staged_id", F.col("conflict").alias("kind"), ref.alias("against"),
        _by_kind("conflict", {
            "duplicate": F.concat(F.lit("an identical allow already exists ("), ref, F.lit(")")),
            "overlap": F.concat(F.lit("source overlaps existing allow "), ref, F.lit(" ("), src, F.lit(")")),
            "contradiction": F.concat(F.lit("an existing deny "), ref, F.lit(" blocks this flow"))}).alias("detail"),
        _by_kind("conflict", {
            "duplicate": F.lit("Skip: this flow is already permitted (no-op)."),
            "overlap": F.concat(F.lit("Merge: fold into the broader rule "), ref,
                                F.lit(" instead of adding a redundant one.")),
            "contradiction": F.lit("Needs human review: an explicit deny contradicts this allow.")}).alias("resolution"))
    edits = staged.filter("kind <> 'add_allow' AND length(target_ref) > 0").select(
        "staged_id", F.col("target_ref").alias("against"))
    stale = edits.join(placed.select(ref.alias("against")).distinct(), "against", "left_anti").select(
        "staged_id", F.lit("stale_target").alias("kind"), "against",
        F.concat(F.lit("rule "), "against", F.lit(" no longer exists in this snapshot")).alias("detail"),
        F.lit("Re-derive the fix against the current snapshot before applying.").alias("resolution"))
    return against_rules.unionByName(stale)


def _by_kind(column: str, texts: dict[str, Column]) -> Column:
    out = None
    for name, text in texts.items():
        out = F.when(F.col(column) == name, text) if out is None else out.when(F.col(column) == name, text)
    return out


def push_outcomes(staged: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Status of pushing each staged change: `conflict` if anything needs a person, else `pushed`.

    `conflicts` is the result of `detect_conflicts` or of `conflict_counts`.
    """
    n = F.col("n") if "n" in conflicts.columns else F.lit(1)
    blocks = F.col("kind").isin(BLOCKING)
    counts = conflicts.groupBy("staged_id").agg(
        F.sum(F.when(blocks, n).otherwise(0)).cast("bigint").alias("n_unresolved"),
        F.sum(F.when(blocks, 0).otherwise(n)).cast("bigint").alias("n_resolved"))
    zero = F.lit(0).cast("bigint")
    return staged.select("staged_id").join(counts, "staged_id", "left").select(
        "staged_id", F.coalesce("n_resolved", zero).alias("n_resolved"),
        F.coalesce("n_unresolved", zero).alias("n_unresolved"),
        F.when(F.coalesce("n_unresolved", zero) > 0, "conflict").otherwise("pushed").alias("status"))


def stage(requests: DataFrame, change_requests: DataFrame, decisions: DataFrame,
          default_tool: str = "algosec") -> DataFrame:
    """Staged rows for the requests (request_id, target_tool, manual_approve) that may be staged.

    Rejected requests are out; escalated ones need a manual approval.
    """
    df = (requests.join(decisions.select("request_id", F.col("decision").alias("__decision")), "request_id")
          .join(change_requests.select("request_id", "kind", "origin", "snapshot_id", F.col("status").alias("__status"),
                                       F.col("target_tool").alias("__tool")), "request_id"))
    escalated = F.col("__decision") == "escalate"
    allowed = (F.coalesce(F.col("__status"), F.lit("open")) != "rejected") & (
        ~escalated | F.coalesce("manual_approve", F.lit(False)))
    return df.filter(allowed).select(
        ids.stable_id("stage", F.col("request_id")).alias("staged_id"), "request_id", "snapshot_id",
        F.coalesce("origin", F.lit("change_gate")).alias("origin"), F.coalesce("kind", F.lit("add_allow")).alias("kind"),
        F.coalesce("target_tool", "__tool", F.lit(default_tool)).alias("target_tool"),
        F.when(escalated, "manual_approved").otherwise("auto_approve").alias("decision"), F.lit("staged").alias("status"))
