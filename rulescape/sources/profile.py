"""Sources described by a mapping instead of code.

A profile names where a JSON export keeps its rules and which field means what. Fields
are read from a VARIANT by path, so no schema for the export has to be written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lookups as L
from .exports import numbered, record_key
from .normalize import CATALOG, RULE, SEEN, Normalized, Parsed, normalize, resolved_rows, shaped


@dataclass(frozen=True)
class FieldMap:
    src: str
    dst: str
    action: str | None = None
    default_action: str = "allow"
    service: str | None = None
    port: str | None = None
    protocol: str | None = None
    app: str | None = None
    order: str | None = None
    ref: str | None = None


@dataclass(frozen=True)
class SourceProfile:
    tool: str
    rules_path: str
    fields: FieldMap
    objects_path: str | None = None
    object_value_key: str = "value"
    object_tags_key: str = "tags"
    object_type_key: str = "type"
    device: str | None = None
    tool_rank: int = 100


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row `doc` (VARIANT) per JSON file."""
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))


def _path(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def _field(name: str | None, kind: str = "string") -> Column:
    if name is None:
        return F.lit(None).cast(kind)
    return F.try_variant_get("value", _path(name), kind)


def _items(docs: DataFrame, path: str) -> DataFrame:
    return docs.sparkSession.sql(
        "SELECT document, x.pos, x.key, x.value FROM {docs}, LATERAL variant_explode_outer(try_variant_get(doc, :path, 'variant')) x",
        args={"path": _path(path)}, docs=docs).filter("value IS NOT NULL")


def _objects(docs: DataFrame, p: SourceProfile) -> DataFrame:
    if p.objects_path is None:
        none = docs.sparkSession.range(0)
        return none.select(F.col("id").alias("document"), *[F.lit(None).cast("string").alias(c) for c in ("name", "value", "type")],
                           L.empty_strings().alias("tags"))
    return _items(docs, p.objects_path).select(
        "document", F.col("key").alias("name"), _field(p.object_value_key).alias("value"), _field(p.object_type_key).alias("type"),
        F.coalesce(_field(p.object_tags_key, "array<string>"), L.empty_strings()).alias("tags"))


def apply_profile(docs: DataFrame, p: SourceProfile) -> Normalized:
    """Records, entities and resolved objects of documents with one VARIANT column `doc`."""
    fm = p.fields
    # profiles that are loaded together need ranks of their own: a record's key holds rank, document and position
    docs = numbered(docs.select(F.to_json("doc").alias("text"))).select("document", F.parse_json("text").alias("doc"))
    objects = _objects(docs, p)
    nth = F.col("pos") + 1
    action = _field(fm.action) if fm.action else F.lit(fm.default_action)
    none = F.lit(None).cast("string")
    rules = _items(docs, p.rules_path).select(
        F.coalesce(_field(fm.ref), F.concat(F.lit(p.tool.upper() + "-"), nth.cast("string"))).alias("raw_ref"),
        F.coalesce(_field(fm.src), F.lit("None")).alias("src"), F.coalesce(_field(fm.dst), F.lit("None")).alias("dst"),
        _field(fm.service).alias("service"),
        (none if fm.service else _field(fm.port, "int")).alias("port"),
        (none if fm.service else _field(fm.protocol)).alias("protocol"), _field(fm.app).alias("app"),
        F.when(action.isin("allow", "deny"), action).otherwise("allow").alias("action"),
        (_field(fm.order, "int") if fm.order else nth * 10).alias("order"),
        F.expr(record_key(p.tool_rank)).alias("record_seq"), "document")
    tool = L.literal(p.tool)
    out = normalize(Parsed(
        shaped(rules, RULE, source_tool=tool, tool_rank=str(p.tool_rank)),
        shaped(objects, CATALOG, source_tool=tool, ip="CASE WHEN type = 'host' THEN value END",
               cidr="CASE WHEN type <> 'host' THEN value END"),
        shaped(objects.filter("false"), SEEN),
        resolved_rows(objects, p.tool, ["value", "type", "tags"], device=L.literal(p.device) if p.device else "NULL")))
    return out._replace(records=out.records.withColumns({"source_ip": none, "dest_ip": none}))


def validate_profile(docs: DataFrame, p: SourceProfile) -> tuple[DataFrame, DataFrame]:
    """One row `(valid, records, entities)` and the first four mapped rows.

    Valid means at least one rule, and every rule has a source, destination and service.
    """
    out = apply_profile(docs, p)
    whole = F.bool_and((F.length("source") > 0) & (F.length("destination") > 0) & (F.length("service") > 0))
    checked = out.records.agg((F.coalesce(whole, F.lit(False))).alias("valid"), F.count(F.lit(1)).alias("records"))
    counted = out.entities.agg(F.count(F.lit(1)))
    sample = out.records.orderBy("record_seq").limit(4).select("source", "destination", "service", "action")
    return checked.withColumn("entities", counted.scalar()), sample
