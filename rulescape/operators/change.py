"""What a proposed change would open, whether it may pass, and the overlay of pushed changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, score
from ..functions import lookups as L
from ..functions.service import SERVICE_COLUMNS, with_service
from ..schemas import RECORD
from ..sources.normalize import optional, with_endpoint
from .detect.rules import broad_reasons, forced_reasons, scored
from .graph import passing, place
from .joins import lookup
from .paths import MAX_HOPS, hop_edges, path_tools, simple_paths, with_hops
from .scratch import cut, write_table


def change_id() -> Column:
    """Id of an ad-hoc request: the same flow always gets the same id."""
    return ids.stable_id("cr", F.col("source"), F.col("destination"), F.col("service"))


def propose(requests: DataFrame, names: DataFrame, node_table: DataFrame) -> DataFrame:
    """Requests (change_id, source, destination, service, action) as placed records.

    Without a `dest_tags` column the destination's tags come from the graph.
    """
    df = optional(optional(requests, "source_tool", "string"), "dest_tags", "array<string>")
    df = df.withColumnsRenamed({"source": "__src", "destination": "__dst", "service": "__service"})
    df = with_service(with_endpoint(with_endpoint(df, "__src", "__s"), "__dst", "__d"), "__service")
    # the request's own text names the rule; only its network is canonical
    df = df.withColumnsRenamed({"__s_kind": "source_kind", "__s_net": "src_net", "__d_kind": "destination_kind"}).withColumns({
        "source": F.col("__src"), "destination": F.col("__dst"), "record_seq": F.xxhash64("change_id"),
        "source_tool": F.coalesce("source_tool", F.lit("algosec")), "raw_ref": F.col("change_id"),
    }).drop("__src", "__dst", "__s", "__d", "__d_net", "__service")
    canonical = lookup(df, F.col("destination"), names, "name", {"__node": "node"}, F.col("record_seq"))
    tagged = lookup(canonical, F.coalesce("__node", "destination"), node_table, "node", {"__tags": "tags"},
                    F.col("record_seq"))
    tagged = tagged.withColumn("dest_tags", F.coalesce("dest_tags", "__tags", L.empty_strings())).drop("__tags", "__node")
    return place(tagged, names)


def joined_paths(pairs: DataFrame, edges: DataFrame, node_table: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(s, d, head, tail): internet-to-sensitive paths that pass through each new pair (s, d).

    A path is a simple path to s, the new hop, and a simple path from d, together simple and
    short enough. Heads and tails are searched once for all pairs. `node_table` holds the ends of
    the pairs as well (`with_ends`); the internet starts every head, whether a rule names it or not.
    """
    hops = hop_edges(passing(edges))
    everything = F.lit("*").alias("goal")
    concrete = node_table.filter("kind = 'concrete'").select("node")
    internet = pairs.sparkSession.createDataFrame([(L.INTERNET,)], "node string")
    into = pairs.select(F.col("s").alias("node")).distinct().join(concrete, "node", "left_semi")
    heads = with_hops(simple_paths(hops, internet.select(everything, "node"), into.select(everything, "node"), True,
                                   max_hops - 1), hops).select(F.element_at("path", -1).alias("s"), F.col("path").alias("head"),
                                              F.col("hops").alias("head_hops"))
    kind = heads.schema["head_hops"].dataType.simpleString()
    no_hops = F.array().cast(kind)
    heads = heads.unionByName(internet.select(
        F.col("node").alias("s"), F.array("node").alias("head"), no_hops.alias("head_hops")))
    sensitive = node_table.filter(L.is_sensitive("tags")).select("node")
    out_of = pairs.select(F.col("d").alias("node")).distinct()
    tails = with_hops(simple_paths(hops, out_of.join(concrete, "node", "left_semi").select(everything, "node"),
                                   sensitive.select(everything, "node"), True, max_hops - 1), hops).select(
        F.col("path").getItem(0).alias("d"), F.col("path").alias("tail"), F.col("hops").alias("tail_hops"))
    tails = tails.unionByName(out_of.join(sensitive, "node", "left_semi").select(
        F.col("node").alias("d"), F.array("node").alias("tail"), no_hops.alias("tail_hops")))
    fits = (F.size("head") + F.size("tail") <= max_hops + 1) & ~F.arrays_overlap("head", "tail")
    return pairs.join(heads, "s").join(tails, "d").filter(fits)


def with_ends(node_table: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes, and each of `ends` (one column, `node`) that is none yet as an abstract node without tags."""
    new = ends.distinct().join(node_table.select("node"), "node", "left_anti")
    made = new
    for f in node_table.schema.fields:
        if f.name != "node":
            value = {"kind": F.lit("abstract"), "display": F.col("node"), "zone": score.zone("node"), "tags": L.empty_strings(),
                     "ip_set": L.empty_strings(), "tools": L.empty_strings()}.get(f.name, F.lit(None))
            made = made.withColumn(f.name, value.cast(f.dataType))
    return node_table.unionByName(made)


def new_paths(placed: DataFrame, edges: DataFrame, node_table: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(change_id, path, terminal, tools, terminal_tags, boundary, boundary_crossed) newly opened.

    `known` holds every permitted pair (s, d), in case `edges` are only those that a path can use.
    """
    known = edges if known is None else known
    node_table = with_ends(node_table, placed.select(F.explode(F.array("s", "d")).alias("node")))
    opened = placed.filter("action = 'allow' AND s <> d").select("change_id", "s", "d", "source_tool")
    fresh = cut(opened.join(known.select("s", "d"), ["s", "d"], "left_anti"))
    joined = joined_paths(fresh.select("s", "d").distinct(), edges, node_table)
    out = fresh.join(joined, ["s", "d"]).select(
        "change_id", F.concat("head", "tail").alias("path"), F.element_at("tail", -1).alias("terminal"),
        F.array_sort(F.array_union(F.array("source_tool"), path_tools(F.concat("head_hops", "tail_hops")))).alias("tools"))
    out = lookup(out, F.col("terminal"), node_table, "node", {"__zone": "zone", "terminal_tags": "tags"}, F.col("path"))
    return out.withColumns({"terminal_tags": F.array_sort("terminal_tags"),
                            "boundary": score.boundary("'internet'", "__zone"),
                            "boundary_crossed": score.crosses("'internet'", "__zone")}).drop("__zone")


def exposed_assets(opened: DataFrame) -> DataFrame:
    """(change_id, terminal): every sensitive asset that a proposal newly exposes."""
    return opened.select("change_id", "terminal").distinct()


def change_delta(placed: DataFrame, opened: DataFrame) -> DataFrame:
    """One row per proposal: what it opens, what it crosses and why it must escalate.

    `placed` from `propose`, `opened` from `new_paths`.
    """
    totals = opened.groupBy("change_id").agg(
        F.count(F.lit(1)).alias("n_new_paths"),
        F.array_sort(F.collect_set(F.when(F.col("boundary_crossed"), F.col("boundary")))).alias("path_boundaries"))
    exposed = exposed_assets(opened).groupBy("change_id").agg(F.count(F.lit(1)).alias("n_exposed"))
    df = scored(placed).join(totals, "change_id", "left").join(exposed, "change_id", "left").withColumns({
        "n_new_paths": F.coalesce("n_new_paths", F.lit(0).cast("bigint")),
        "n_exposed": F.coalesce("n_exposed", F.lit(0).cast("bigint"))})
    own = score.boundary("src_zone", "dst_zone")
    crossing = score.crosses("src_zone", "dst_zone")
    opens = F.concat(F.lit("opens "), F.col("n_new_paths").cast("string"),
                     F.lit(" new internet path(s) reaching sensitive asset(s): "), F.col("n_exposed").cast("string"))
    df = df.withColumns({
        "boundaries_crossed": F.array_sort(F.array_union(
            F.coalesce("path_boundaries", L.empty_strings()),
            F.when(crossing, F.array(own)).otherwise(L.empty_strings()))),
        "new_over_permissive": broad_reasons(), "proposed_boundary": own, "proposed_crosses_boundary": crossing,
        "forced_reasons": F.array_distinct(F.concat(
            score.compact(F.when(F.col("n_new_paths") > 0, opens)), forced_reasons(), score.compact(
                F.when(F.col("protocol") == "any", "introduces an any/any rule"),
                F.when(F.col("internet") & (F.col("dst_zone") == "internal"),
                       "creates new internet->internal exposure")))),
    }).withColumn("forced_escalate", F.size("forced_reasons") > 0)
    return df.select("change_id", "source", "source_kind", "destination", "service", "protocol", "action", "n_new_paths",
                     "n_exposed", "boundaries_crossed", "new_over_permissive", "proposed_boundary",
                     "proposed_crosses_boundary", "forced_escalate", "forced_reasons")


def gate(delta: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Decision per proposal. `verdicts` (change_id, verdict, confidence, rationale) are optional.

    Forced proposals escalate whatever the verdict; without a usable verdict the gate fails
    closed; an approval only stands for a clean delta. `eligible` tells clean and not forced.
    """
    if verdicts is None:
        none = delta.sparkSession.sql("SELECT CAST(NULL AS string) change_id, CAST(NULL AS string) verdict, "
                                      "CAST(NULL AS double) confidence, CAST(NULL AS string) rationale").limit(0)
        verdicts = none
    no_patterns = F.size("new_over_permissive") == 0
    no_reach = (F.col("n_new_paths") == 0) & (F.col("n_exposed") == 0)
    no_cross = F.size("boundaries_crossed") == 0
    df = delta.join(verdicts.select("change_id", F.col("verdict"), F.col("confidence").alias("__conf"),
                                    F.col("rationale").alias("__why")), "change_id", "left").withColumns({
        "standard_template": no_patterns & ~F.col("proposed_crosses_boundary"),
        "no_new_sensitive_reachability": no_reach, "no_new_boundary_crossing": no_cross,
        "no_over_permissive_pattern": no_patterns, "clean": no_reach & no_cross & no_patterns,
        "given": F.coalesce(F.col("verdict").isin("auto_approve", "escalate"), F.lit(False)),
        "reasons": F.array_join("forced_reasons", "; ")})
    forced, clean, given = F.col("forced_escalate"), F.col("clean"), F.col("given")
    overruled = ~forced & given & (F.col("verdict") == "auto_approve") & ~clean
    note = (" | Engine override: the delta opened new reachability, a boundary crossing, or an over-permissive pattern.")
    return df.withColumns({
        "decision": F.when(~forced & given & ~overruled, F.col("verdict")).otherwise("escalate"),
        "triggering_reason": F.when(forced, F.col("reasons")).when(~given, "unparseable classifier output")
                              .when(overruled, "engine override: delta is not clean"),
        "confidence": F.when(forced, F.lit(0.99)).when(~given, F.lit(0.0)).otherwise(F.coalesce("__conf", F.lit(0.7))),
        "decided_by": F.when(~forced & given & ~overruled, "llm").otherwise("engine_fallback"),
        "rationale": F.when(forced, F.concat(
            F.lit("Engine guardrail force-escalated before model consultation: "), "reasons", F.lit(".")))
        .when(~given, "Classifier output could not be validated; failing closed to escalate.")
        .when(overruled, F.concat(F.coalesce("__why", F.lit("")), F.lit(note))).otherwise(F.coalesce("__why", F.lit(""))),
        "eligible": clean & ~forced,
    }).select("change_id", "decision", "standard_template", "no_new_sensitive_reachability", "no_new_boundary_crossing",
              "no_over_permissive_pattern", "clean", "eligible", "forced_escalate", "triggering_reason", "confidence",
              "rationale", "decided_by")


# ---- overlay of pushed changes ----------------------------------------------

EDIT = {"op": "string", "target_ref": "string", "new_source": "string", "new_service": "string", "shadowing_ref": "string"}


def load_pushed(staged: DataFrame) -> DataFrame:
    """Pushed changes in order: `at` sorts by creation time, then id."""
    return staged.filter("status = 'pushed'").withColumn("at", F.struct("created_at", "staged_id"))


def _edits(changes: DataFrame) -> DataFrame:
    df = changes.filter(F.coalesce(F.col("kind") != "add_allow", F.lit(True)))
    for name, kind in EDIT.items():
        df = optional(df, name, kind)
    return df.select("at", *EDIT)


def decoded_edits(edits: DataFrame) -> DataFrame:
    """Add `src` (text, kind, network) and `svc` (decoded service) of what an edit sets."""
    df = with_service(with_endpoint(edits, "new_source", "__n"), "new_service")
    return df.withColumns({
        "src": F.when((F.col("op") == "scope_source") & (F.length("new_source") > 0), F.struct(
            F.col("new_source").alias("source"), F.col("__n_kind").alias("source_kind"), F.col("__n_net").alias("src_net"))),
        "svc": F.when((F.col("op") == "restrict_service") & (F.length("new_service") > 0), F.struct(*SERVICE_COLUMNS)),
    }).drop("__n", "__n_kind", "__n_net", *SERVICE_COLUMNS)


def _orders(edits: DataFrame, orders: DataFrame) -> DataFrame:
    """(at, new_order) of every reorder that takes effect.

    A rule goes one before the order its shadowing rule has at that moment: its own, or what the
    last effective reorder before gave it. A reorder has no effect if its shadowing rule is missing
    or was removed by then. The links form chains; each round doubles the distance they reach, so a
    chain of any length takes a logarithmic number of rounds.
    """
    moves = edits.filter("op = 'reorder_before'").select("at", "target_ref", "shadowing_ref")
    gone = edits.filter("op = 'remove'").groupBy("target_ref").agg(F.min("at").alias("gone_at")).withColumnRenamed(
        "target_ref", "shadowing_ref")
    effective = cut(moves.join(gone, "shadowing_ref", "left").filter("gone_at IS NULL OR gone_at > at")
                    .join(orders.select(F.col("raw_ref").alias("shadowing_ref"), F.col("order").alias("base")), "shadowing_ref")
                    .select("at", "target_ref", "shadowing_ref", "base"))
    prior = effective.select(F.col("target_ref").alias("shadowing_ref"), F.col("at").alias("prior_at"))
    linked = (effective.join(prior, "shadowing_ref", "left")
              .groupBy("at").agg(F.first("base").alias("base"),
                                 F.max(F.when(F.col("prior_at") < F.col("at"), F.col("prior_at"))).alias("jump")))
    steps = F.when(F.col("jump").isNull(), 0).otherwise(1)
    chain, seen = write_table(linked.withColumn("steps", steps), F.count("jump").alias("open"))
    while seen["open"]:
        ahead = chain.select(F.col("at").alias("jump"), F.col("jump").alias("next"), F.col("steps").alias("more"), F.col("base").alias("far"))
        chain, seen = write_table(chain.join(ahead, "jump", "left").select(
            "at", F.coalesce("far", "base").alias("base"), F.col("next").alias("jump"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), F.count("jump").alias("open"))
    return chain.select("at", (F.col("base") - 1 - F.col("steps")).alias("new_order"))


def _net_effect(df: DataFrame, by: list[str]) -> DataFrame:
    """Per rule, what its edits leave: the last value set for each part, or removal."""
    return df.groupBy(*by).agg(
        F.bool_or(F.col("op") == "remove").alias("gone"),
        F.max_by("src", F.when(F.col("src").isNotNull(), F.col("at"))).alias("set_src"),
        F.max_by("svc", F.when(F.col("svc").isNotNull(), F.col("at"))).alias("set_svc"),
        F.max_by("new_order", F.when(F.col("new_order").isNotNull(), F.col("at"))).alias("set_order"))


def edited(df: DataFrame) -> DataFrame:
    """Apply `set_src`, `set_svc` and `set_order` to record columns."""
    return df.withColumns({
        **{c: F.when(F.col("set_src").isNotNull(), F.col(f"set_src.{c}")).otherwise(F.col(c))
           for c in ("source", "source_kind", "src_net")},
        **{c: F.when(F.col("set_svc").isNotNull(), F.col(f"set_svc.{c}")).otherwise(F.col(c)) for c in SERVICE_COLUMNS},
        "order": F.coalesce("set_order", "order"),
    }).drop("set_src", "set_svc", "set_order")


def apply_overlay(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Records after all `changes` (at, kind, EDIT columns, `added` record struct), in order of `at`.

    Edits of one rule are reduced to their net effect with aggregates, so one join applies any
    number of changes. A rule that a change adds is only touched by later changes.
    """
    edits = decoded_edits(_edits(changes))
    added = changes.filter("kind = 'add_allow'")
    if "added" in changes.columns:
        have = set(changes.schema["added"].dataType.fieldNames())
        adds = added.filter("added IS NOT NULL").select("at", "added.*").withColumn(
            "record_seq", F.expr("4611686018427387904L + (xxhash64(at) & 2305843009213693951L)"))
        if "src_net" not in have:
            adds = with_endpoint(adds, "source", "__s").withColumn("src_net", F.expr(
                "CASE WHEN source_kind = 'cidr' THEN __s_net END")).drop("__s", "__s_kind", "__s_net")
        for f in records.schema.fields:
            adds = optional(adds, f.name, f.dataType.simpleString()).withColumn(f.name, F.col(f.name).cast(f.dataType))
        adds = adds.select("at", *RECORD)
    else:
        adds = None
    orders = records if adds is None else records.unionByName(adds.select(*RECORD))
    named = edits.filter("op = 'reorder_before'").select(F.col("shadowing_ref").alias("raw_ref")).distinct()
    orders = orders.filter("`order` IS NOT NULL").join(named, "raw_ref", "left_semi").groupBy("raw_ref").agg(
        F.max_by("order", "record_seq").alias("order"))
    edits = edits.join(_orders(edits, orders), "at", "left")
    effect = _net_effect(edits, ["target_ref"])
    keep = F.coalesce(~F.col("gone"), F.lit(True))
    out = edited(lookup(records, F.col("raw_ref"), effect, "target_ref", {
        "gone": "gone", "set_src": "set_src", "set_svc": "set_svc", "set_order": "set_order"},
        F.col("record_seq")).filter(keep)).select(*RECORD)
    if adds is None:
        return out
    later = adds.select(F.col("at").alias("born"), F.col("raw_ref").alias("target_ref"), "record_seq").join(
        edits, "target_ref").filter("at > born")
    tail = adds.join(_net_effect(later, ["record_seq"]), "record_seq", "left").filter(keep)
    return out.unionByName(edited(tail).select(*RECORD))
