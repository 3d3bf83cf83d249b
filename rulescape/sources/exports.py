"""The three built-in export shapes, read as JSON and normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .. import schemas
from ..functions import lookups as L
from .normalize import CATALOG, RULE, SEEN, Normalized, Parsed, normalize, resolved_rows, shaped, union_parsed

FIREWALL, MICROSEG, CLOUD = "algosec", "guardicore", "wiz"
TOOL_RANK = {FIREWALL: 0, MICROSEG: 1, CLOUD: 2}


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents; a folder with one document per device reads in parallel."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _ordered_maps(export: DataFrame) -> list[Column]:
    """The columns of an export with every map as its sorted entries: the order in which a map was built says nothing."""
    return [F.array_sort(F.map_entries(f.name)).alias(f.name) if isinstance(f.dataType, MapType) else F.col(f.name)
            for f in export.schema.fields]


def numbered(export: DataFrame) -> DataFrame:
    """Add `document`: a number for each different document; one that is read twice counts once.

    The number is the same whenever the export is read again, so rules and objects of a document meet.
    """
    keyed = export.withColumn("__key", F.xxhash64(F.to_json(F.struct(*_ordered_maps(export))))).dropDuplicates(["__key"])
    numbers = keyed.select("__key", (F.row_number().over(Window.orderBy("__key")) - 1).cast("bigint").alias("document"))
    return keyed.join(numbers, "__key").drop("__key")


def record_key(rank: int) -> str:
    """`record_seq` from `document` and `pos`: unique and in source order within a tool of this rank."""
    return f"{rank << 56}L + shiftleft(document, 28) + pos"


def _rules(export: DataFrame, field: str, tool: str, device: str = "''", **given: str) -> DataFrame:
    """Rule rows in source order: tool, then document, then position."""
    rows = export.selectExpr(f"{device} AS device", "document", f"posexplode({field}) AS (pos, r)").select("device", "document", "pos", "r.*")
    rank = TOOL_RANK[tool]
    seq = record_key(rank)
    return shaped(rows, RULE, source_tool=f"'{tool}'", tool_rank=str(rank), record_seq=seq, **given)


def _catalog(export: DataFrame, field: str, device: str = "''") -> DataFrame:
    return export.selectExpr(f"{device} AS device", "document", f"explode({field}) AS (name, v)").select(
        "device", "document", "name", "v.*").withColumn("tags", F.coalesce("tags", L.empty_strings()))


def _listed(catalog: DataFrame, tool: str, identifiers: str) -> DataFrame:
    return shaped(catalog, SEEN, tool=f"'{tool}'", tool_rank=str(TOOL_RANK[tool]), kind="'identity'",
                  identifiers=identifiers, abstract="false", record_seq="-1")


def parse_firewall(export: DataFrame) -> Parsed:
    device, export = "coalesce(device, '')", numbered(export)
    objects = _catalog(export, "objects", "device")
    host = "coalesce(type = 'host', false)"
    return Parsed(
        _rules(export, "rules", FIREWALL, device, raw_ref="rule_id", note="comment"),
        shaped(objects, CATALOG, source_tool=f"'{FIREWALL}'", ip=f"CASE WHEN {host} THEN value END",
               cidr=f"CASE WHEN NOT {host} THEN value END"),
        shaped(objects.filter("false"), SEEN),
        resolved_rows(objects, FIREWALL, ["value", "type", "tags"], device="device"))


def parse_microseg(export: DataFrame) -> Parsed:
    export = numbered(export)
    labels = _catalog(export, "labels")
    return Parsed(
        _rules(export, "policies", MICROSEG, raw_ref="policy_id", src="src_label", dst="dst_label", src_named="true",
               dst_named="true", order="(pos + 1) * 10", note="ruleset"),
        shaped(labels, CATALOG, source_tool=f"'{MICROSEG}'"),
        _listed(labels, MICROSEG, "map('role', role, 'env', env)"),
        resolved_rows(labels, MICROSEG, ["role", "env", "tags"],
                      kind="CASE WHEN role = 'segment' THEN 'zone' ELSE 'application' END"))


def parse_cloud(export: DataFrame) -> Parsed:
    export = numbered(export)
    assets = _catalog(export, "assets")
    ingress = "kind = 'internet_ingress'"
    internet = shaped(export.limit(1), SEEN, name=f"'{L.INTERNET}'", kind="'cidr'", tool=f"'{CLOUD}'",
                      tool_rank=str(TOOL_RANK[CLOUD]), cidr=f"'{L.INTERNET}'", tags="array()", abstract="true",
                      record_seq="-2")
    return Parsed(
        _rules(export, "exposures", CLOUD, raw_ref="exposure_id", action="'allow'", note="kind",
               src=f"CASE WHEN {ingress} THEN '{L.INTERNET}' ELSE src END", src_named=f"NOT ({ingress})",
               dst_named="true"),
        shaped(assets, CATALOG, source_tool=f"'{CLOUD}'"),
        _listed(assets, CLOUD, "map('cloud', cloud, 'type', type, 'internet_facing', CAST(internet_facing AS string))")
        .unionByName(internet),
        resolved_rows(assets, CLOUD, ["ip", "type", "cloud", "tags", "internet_facing"], dynamic="internet_facing"))


def normalize_firewall(export: DataFrame) -> Normalized:
    return normalize(parse_firewall(export))


def normalize_microseg(export: DataFrame) -> Normalized:
    return normalize(parse_microseg(export))


def normalize_cloud(export: DataFrame) -> Normalized:
    return normalize(parse_cloud(export))


def load_exports(spark: SparkSession, firewall: str, microseg: str, cloud: str, materialize: bool = False) -> Normalized:
    """All three exports as one set of tables, resolved in one pass."""
    return normalize(union_parsed([
        parse_firewall(read_export(spark, firewall, schemas.FIREWALL_EXPORT)),
        parse_microseg(read_export(spark, microseg, schemas.MICROSEG_EXPORT)),
        parse_cloud(read_export(spark, cloud, schemas.CLOUD_EXPORT)),
    ]), materialize=materialize)
