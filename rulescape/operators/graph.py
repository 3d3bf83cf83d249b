"""Nodes and edges of permitted flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import score
from .identity import Identities
from .joins import lookup

GRANT = ["source_tool", "raw_ref", "service", "protocol", "port", "port_end", "l7_app", "l7_source"]


def directory(found: Identities) -> DataFrame:
    """Every observed name with the facts of its asset: one row per name."""
    facts = found.assets.select(
        F.col("asset_key").alias("node"), "kind", "tags", F.col("display_name").alias("display"),
        score.zone("asset_key", "tags").alias("zone"))
    return found.alias_map.withColumnRenamed("asset_key", "node").join(facts, "node")


NODE_FACTS = ["node", "zone", "display", "kind", "tags"]


def with_node(records: DataFrame, side: str, token: str, names: DataFrame, more: dict[str, str] | None = None) -> DataFrame:
    """Look up the end `token`: NODE_FACTS as `side`_*, and `more` (new name -> column of `names`)."""
    return lookup(records, F.col(token), names, "name", {f"{side}_{c}": c for c in NODE_FACTS} | (more or {}),
                  spread=F.col("record_seq"))


def place(records: DataFrame, names: DataFrame) -> DataFrame:
    """Records with canonical ends `s`, `d` and the zone, tags, kind and label of each."""
    for side, token in (("s", "source"), ("d", "destination")):
        records = with_node(records, side, token, names)
    return settled(records)


def settled(records: DataFrame) -> DataFrame:
    """Records whose ends were looked up, with defaults for ends that no name covers."""
    return records.withColumns({
        "s": F.coalesce("s_node", "source"), "d": F.coalesce("d_node", "destination"),
        "s_known": F.col("s_node").isNotNull(), "d_known": F.col("d_node").isNotNull(),
        "src_zone": F.coalesce("s_zone", score.zone("source")),
        "dst_zone": F.coalesce("d_zone", F.when(is_allow(), score.zone("destination")).otherwise(score.zone("destination", "dest_tags"))),
        "s_display": F.coalesce("s_display", "source"), "d_display": F.coalesce("d_display", "destination"),
        "s_kind": F.coalesce("s_kind", F.lit("abstract")), "d_kind": F.coalesce("d_kind", F.lit("abstract")),
        "s_tags": F.coalesce("s_tags", L.empty_strings()), "d_tags": F.coalesce("d_tags", L.empty_strings()),
    }).drop("s_node", "d_node", "s_zone", "d_zone")


def is_allow() -> Column:
    return F.col("action") == "allow"


def nodes(assets: DataFrame, placed: DataFrame) -> DataFrame:
    """Assets, plus endpoints of allow rules that no asset covers (abstract, untagged)."""
    listed = assets.select(
        F.col("asset_key").alias("node"), "kind", "tags", "ip_set", F.col("display_name").alias("display"),
        score.zone("asset_key", "tags").alias("zone"), F.col("source_tools").alias("tools"))
    loose = placed.filter(is_allow()).select(F.explode(F.array(
        F.when(~F.col("s_known"), F.col("s")), F.when(~F.col("d_known"), F.col("d")))).alias("node")).filter(
        "node IS NOT NULL").distinct()
    none = L.empty_strings()
    return listed.unionByName(loose.select(
        "node", F.lit("abstract").alias("kind"), none.alias("tags"), none.alias("ip_set"),
        F.col("node").alias("display"), score.zone("node").alias("zone"), none.alias("tools")))


def grants(placed: DataFrame) -> DataFrame:
    """Every grant of every pair, one row each (parallel grants are kept)."""
    return placed.filter(is_allow()).select("s", "d", *GRANT)


def edges(placed: DataFrame) -> DataFrame:
    """One row per pair: sorted tool, service and application sets, and the first grant.

    The representative grant is the smallest by (tool, ref). The grants themselves stay
    rows of `grants`, so a pair with very many of them is never gathered.
    """
    facts = ["s", "d", "s_kind", "d_kind", "s_display", "d_display"]
    return placed.filter(is_allow()).groupBy("s", "d").agg(
        *[F.first(c).alias(c) for c in facts[2:]],
        F.array_sort(F.collect_set("source_tool")).alias("tools"),
        F.array_sort(F.collect_set("service")).alias("services"),
        F.array_sort(F.collect_set("l7_app")).alias("apps"),
        F.min_by(F.struct(*GRANT), F.struct("source_tool", F.coalesce("raw_ref", F.lit("")), "record_seq")).alias("rep"),
        F.count(F.lit(1)).alias("n_grants"))


def pairs(placed: DataFrame) -> DataFrame:
    """The edges without what they tell: names and kinds of their ends, one row per pair."""
    return placed.filter(is_allow()).groupBy("s", "d").agg(F.first("s_kind").alias("s_kind"), F.first("d_kind").alias("d_kind"))


def passing(df: DataFrame, start: str = L.INTERNET) -> DataFrame:
    """Of placed rules or edges, those that a path from `start`, or from a concrete node, can use.

    Paths pass through concrete nodes only, so what leaves another abstract node is on none of them.
    """
    return df.filter((F.col("s_kind") == "concrete") | (F.col("s") == start))


def sensitive_nodes(node_table: DataFrame) -> DataFrame:
    return node_table.filter(L.is_sensitive("tags")).select("node").orderBy("node")


def port_label(ports: Column) -> Column:
    """Display labels of stored port ranges: proto/start[-end]; `any` for none."""
    def one(p: Column) -> Column:
        start, end = p["port_start"].cast("string"), p["port_end"].cast("string")
        open_end = p["port_end"].isNull() | (p["port_end"] == p["port_start"])
        return F.concat(p["proto"], F.lit("/"), start, F.when(open_end, "").otherwise(F.concat(F.lit("-"), end)))

    return F.when(F.coalesce(F.size(ports), F.lit(0)) < 1, F.array(F.lit("any"))).otherwise(F.transform(ports, one))


def rollup(edge_rows: DataFrame) -> DataFrame:
    """Dashboard edges from stored edge rows: tools, services and applications per pair."""
    return (edge_rows.withColumn("label", F.explode(port_label(F.col("ports"))))
            .groupBy("src_node", "dst_node").agg(
                F.array_sort(F.collect_set("source_tool")).alias("tools"),
                F.array_sort(F.collect_set("label")).alias("services"),
                F.array_sort(F.collect_set("l7_app")).alias("apps")))


def degrees(pairs: DataFrame) -> DataFrame:
    """(node, degree) over distinct pairs, both directions."""
    return pairs.select(F.explode(F.array("s", "d")).alias("node")).groupBy("node").agg(
        F.count(F.lit(1)).alias("degree"))


def busiest(node_table: DataFrame, pairs: DataFrame, n: int = 90) -> DataFrame:
    """The `n` nodes of highest degree (ties by name)."""
    return (node_table.select("node").join(degrees(pairs), "node", "left")
            .withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))
            .orderBy(F.desc("degree"), "node").limit(n))


def focus(node_table: DataFrame, pairs: DataFrame, path_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes on paths, the internet and sensitive nodes, with their neighbours; and the edges among them."""
    seeds = (path_nodes.select("node").unionByName(node_table.filter(
        L.is_sensitive("tags") | (F.col("node") == L.INTERNET)).select("node")).distinct())
    near = (pairs.join(seeds.withColumnRenamed("node", "s"), "s", "left_semi").select(F.col("d").alias("node"))
            .unionByName(pairs.join(seeds.withColumnRenamed("node", "d"), "d", "left_semi").select(F.col("s").alias("node"))))
    kept = seeds.unionByName(near).distinct().join(node_table.select("node"), "node", "left_semi")
    inside = (pairs.join(kept.withColumnRenamed("node", "s"), "s", "left_semi")
              .join(kept.withColumnRenamed("node", "d"), "d", "left_semi"))
    return kept, inside
