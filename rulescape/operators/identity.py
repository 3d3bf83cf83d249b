"""One asset per machine: names unified by shared host address or confirmed merge."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import lookups as L
from ..schemas import ENTITY
from .components import components


class Identities(NamedTuple):
    assets: DataFrame         # asset_key, kind, context, identifiers, ip_set, tags, source_tools, display_name
    alias_map: DataFrame      # name, asset_key
    correlations: DataFrame   # asset_key, match_key, confidence, evidence (JSON), n_names
    shared_names: DataFrame   # ip, name: every name of an address that carries several


def _address_names(entities: DataFrame) -> DataFrame:
    """(ip, name) of every address that carries more than one name, with its smallest name."""
    pairs = entities.filter(F.length("ip") > 0).select("ip", "name").distinct()
    several = pairs.groupBy("ip").agg(F.min("name").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return pairs.join(several, "ip")


def _observed_merges(names: DataFrame, merges: DataFrame | None) -> DataFrame | None:
    if merges is None:
        return None
    a, b = (names.select(F.col("name").alias(c)) for c in ("name_a", "name_b"))
    return merges.select("name_a", "name_b").join(a, "name_a", "left_semi").join(b, "name_b", "left_semi")


def resolve_identities(entities: DataFrame, merges: DataFrame | None = None) -> Identities:
    """`entities` as in schemas.ENTITY; `merges` has name_a, name_b (confirmed by a person)."""
    names = entities.groupBy("name").agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    shared = _address_names(entities)
    confirmed = _observed_merges(names, merges)
    links = shared.filter("name <> first").select(F.col("name").alias("a"), F.col("first").alias("b"))
    if confirmed is not None:
        links = links.unionByName(confirmed.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")))
    member = components(links)
    # canonical name of a component: seen by most tools, then first in text order
    chosen = member.join(names, "name").groupBy("root").agg(
        F.min(F.struct((-F.size("tools")).alias("rank"), "name")).getField("name").alias("asset_key"))
    linked = member.join(chosen, "root").select("name", "asset_key")
    named = names.join(linked, "name", "left").withColumn("asset_key", F.coalesce("asset_key", "name"))
    alias_map = named.select("name", "asset_key")
    assets = _assets(entities.join(linked, "name", "left").withColumn("asset_key", F.coalesce("asset_key", "name")))
    correlations = _correlations(named, shared, linked, assets, confirmed)
    return Identities(assets, alias_map, correlations, shared.select("ip", "name"))


def _assets(seen: DataFrame) -> DataFrame:
    base = seen.groupBy("asset_key").agg(
        F.when(F.bool_and("abstract"), "abstract").otherwise("concrete").alias("kind"),
        F.array_sort(F.array_union(
            F.collect_set(F.when(F.length("ip") > 0, F.concat("ip", F.lit("/32")))),
            F.collect_set(F.when(F.length("cidr") > 0, F.col("cidr"))))).alias("ip_set"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
        F.array_sort(F.collect_set("tool")).alias("source_tools"))
    # later observations (by name, then tool) overwrite earlier ones key by key
    facts = (seen.filter(F.coalesce(F.size("identifiers"), F.lit(0)) > 0)
             .select("asset_key", "name", "tool_rank", F.explode("identifiers").alias("key", "value"))
             .filter("value IS NOT NULL")
             .groupBy("asset_key", "key").agg(F.max_by("value", F.struct("name", "tool_rank")).alias("value"))
             .groupBy("asset_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("identifiers")))
    known = F.col("identifiers")
    return base.join(facts, "asset_key", "left").withColumns({
        "identifiers": F.coalesce(known, F.create_map().cast("map<string,string>")),
        "context": F.coalesce(F.nullif(F.try_element_at(known, F.lit("env")), F.lit("")),
                              F.try_element_at(known, F.lit("cloud"))),
        "display_name": F.when(F.col("asset_key") == L.INTERNET, "Internet").otherwise(F.col("asset_key")),
    }).select("asset_key", "kind", "context", "identifiers", "ip_set", "tags", "source_tools", "display_name")


def _correlations(named: DataFrame, shared: DataFrame, linked: DataFrame, assets: DataFrame,
                  confirmed: DataFrame | None) -> DataFrame:
    abstract = assets.filter("kind = 'abstract'").select("asset_key")
    hostname = named.filter(F.size("tools") > 1).select(
        "asset_key", F.lit("hostname").alias("match_key"), F.lit(1.0).alias("confidence"),
        F.concat(F.lit('{"name":'), ids.json_text(F.col("name")), F.lit(',"tools":'), ids.json_list(F.col("tools")),
                 F.lit("}")).alias("evidence"), F.lit(1).cast("bigint").alias("n_names"))
    addresses = shared.filter("name = first").select("ip", F.col("first").alias("name"), "n").join(linked, "name")
    # the names themselves are rows of `shared_names`, however few or many they are
    context = addresses.select(
        "asset_key", F.lit("context_ip").alias("match_key"), F.lit(0.95).alias("confidence"),
        F.concat(F.lit('{"ip":'), ids.json_text(F.col("ip")), F.lit(',"n_names":'), F.col("n").cast("string"),
                 F.lit("}")).alias("evidence"),
        F.col("n").alias("n_names"))
    out = hostname.unionByName(context).join(abstract, "asset_key", "left_anti")
    if confirmed is not None:
        key = named.select("name", "asset_key")
        manual = (confirmed.join(key.withColumnsRenamed({"name": "name_a"}), "name_a").select(
            "asset_key", F.lit("manual_review").alias("match_key"), F.lit(1.0).alias("confidence"),
            F.concat(F.lit('{"by":"human-confirmed","names":'),
                     ids.json_list(F.array_sort(F.array_distinct(F.array("name_a", "name_b")))),
                     F.lit("}")).alias("evidence"),
            F.lit(2).cast("bigint").alias("n_names")))
        out = out.unionByName(manual)
    return out


def fill_missing_entities(entities: DataFrame, records: DataFrame) -> DataFrame:
    """Add an entity for every endpoint that only the (changed) records name.

    Known names stay as they are; a new name takes its facts from its first mention.
    """
    ends = records.select("record_seq", "source_tool", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("source").alias("name"), F.col("source_kind").alias("kind"),
                 F.col("source_ip").alias("ip"), L.empty_strings().alias("tags")),
        F.struct(F.lit(1).alias("side"), F.col("destination").alias("name"), F.col("destination_kind").alias("kind"),
                 F.col("dest_ip").alias("ip"), F.col("dest_tags").alias("tags")))).alias("e")).select(
        "record_seq", "source_tool", "e.*").filter(F.length("name") > 0)
    new = ends.join(entities.select("name").distinct(), "name", "left_anti")
    first = new.groupBy("name").agg(F.min_by(F.struct("source_tool", "kind", "ip", "tags"),
                                             F.struct("record_seq", "side")).alias("f")).select("name", "f.*")
    cidr = F.col("kind") == "cidr"
    extra = first.select(
        "name", "kind", F.col("source_tool").alias("tool"), F.lit(1000).alias("tool_rank"),
        F.when(~cidr, F.col("ip")).alias("ip"), F.when(cidr, F.col("name")).alias("cidr"),
        F.when(cidr, L.empty_strings()).otherwise(F.coalesce("tags", L.empty_strings())).alias("tags"),
        F.lit(None).cast("map<string,string>").alias("identifiers"), cidr.alias("abstract"))
    return entities.select(*ENTITY).unionByName(extra.select(*ENTITY))
