"""Canonical records, observed entities and resolved objects from flat rule tables."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..functions.service import with_service
from ..operators import graph
from ..operators.joins import lookup
from ..operators.scratch import cut
from ..schemas import ENTITY, RECORD


class Normalized(NamedTuple):
    records: DataFrame
    entities: DataFrame
    resolved: DataFrame


class Parsed(NamedTuple):
    """A source flattened to tables, before names are resolved."""

    rules: DataFrame      # RULE columns
    catalog: DataFrame    # source_tool, document, name, ip, cidr, tags: one row per name of a document
    listed: DataFrame     # SEEN columns: entities the source lists whether or not a rule names them
    resolved: DataFrame   # schemas.RESOLVED


RULE = {
    "source_tool": "string", "tool_rank": "int", "raw_ref": "string", "src": "string", "dst": "string",
    "src_named": "boolean", "dst_named": "boolean", "service": "string", "port": "int", "protocol": "string",
    "app": "string", "action": "string", "order": "int", "note": "string", "record_seq": "bigint",
    "document": "bigint",
}
CATALOG = {"source_tool": "string", "document": "bigint", "name": "string", "ip": "string", "cidr": "string", "tags": "array<string>"}
SEEN = {
    "name": "string", "kind": "string", "tool": "string", "tool_rank": "int", "ip": "string", "cidr": "string",
    "tags": "array<string>", "identifiers": "map<string,string>", "abstract": "boolean", "record_seq": "bigint",
}


def optional(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def shaped(df: DataFrame, columns: dict[str, str], **given: str) -> DataFrame:
    """Select `columns` with their types: SQL from `given`, else the same-named column, else NULL."""
    def source(name: str) -> str:
        return given.get(name) or (f"`{name}`" if name in df.columns else "NULL")

    return df.selectExpr(*[f"CAST({source(n)} AS {t}) AS `{n}`" for n, t in columns.items()])


def with_endpoint(df: DataFrame, token: str, out: str, named: str = "false") -> DataFrame:
    """Add `out`, `out`_kind and `out`_net: a canonical network, or the name itself.

    `named` (SQL) marks tokens that are names even when they look like a network.
    """
    text = f"__{out}_token"
    df = net.with_network(df.withColumn(text, F.expr(f"CASE WHEN NOT coalesce({named}, false) THEN {token} END")),
                          text, f"{out}_net")
    cidr = net.is_cidr(text, f"{out}_net")
    return df.withColumn(f"{out}_kind", F.when(cidr, "cidr").otherwise("identity")).withColumns({
        f"{out}_net": F.expr(f"CASE WHEN {out}_kind = 'cidr' THEN {out}_net END"),
        out: F.when(F.col(f"{out}_kind") == "cidr", net.network_text(f"{out}_net")).otherwise(F.col(token)),
    }).drop(text)


_NONE = "CAST(array() AS array<string>)"


def _bare(parsed: Parsed) -> DataFrame:
    """Rules with canonical ends, before the catalog is asked."""
    rules = with_endpoint(with_endpoint(parsed.rules, "src", "source", "src_named"), "dst", "destination", "dst_named")
    # names as given and the destination's network are not asked for again: rows are shuffled without them
    return rules.drop("src", "dst", "src_named", "dst_named", "destination_net")


def _records(resolved: DataFrame, *more: str) -> DataFrame:
    """schemas.RECORD of rules with the facts of their ends."""
    return with_service(resolved, "service", "port", "protocol", "app").withColumns({
        "id": F.col("raw_ref"), "dest_tags": F.expr(f"coalesce(destination_tags, {_NONE})"),
        "dest_ip": F.col("destination_ip"), "src_net": F.col("source_net")}).select(*RECORD, *more)


def normalize(parsed: Parsed, by_tool: bool = True, materialize: bool = False) -> Normalized:
    """Resolve rule ends against the catalog and decode services.

    With `by_tool` a rule sees only the catalog of its own tool and document. With `materialize` the resolved
    rules are written once and shared by records and entities, instead of resolved for each.
    """
    rules = _bare(parsed)
    key = "concat_ws('\\u001f', source_tool, CAST(document AS string), {0})" if by_tool else "{0}"
    dim = parsed.catalog.withColumn("__k", F.expr(key.format("name")))
    for side in ("source", "destination"):
        wanted = F.expr(f"CASE WHEN {side}_kind = 'identity' THEN {key.format(side)} END")
        rules = lookup(rules, wanted, dim, "__k", {f"{side}_ip": "ip", f"{side}_cidr": "cidr", f"{side}_tags": "tags"},
                       spread=F.col("record_seq"))
    rules = cut(rules) if materialize else rules
    ends = ", ".join(
        f"named_struct('name', {s}, 'kind', {s}_kind, 'ip', {s}_ip, 'cidr', CASE WHEN {s}_kind = 'cidr' THEN {s} "
        f"ELSE {s}_cidr END, 'tags', coalesce({s}_tags, {_NONE}))" for s in ("source", "destination"))
    seen = shaped(rules.selectExpr("source_tool AS tool", "tool_rank", "record_seq", f"explode(array({ends})) AS e")
                  .select("tool", "tool_rank", "record_seq", "e.*"), SEEN)
    return Normalized(_records(rules), merge_entities(seen.unionByName(parsed.listed)), parsed.resolved)


def shared_entities(parsed: Parsed) -> DataFrame:
    """The entities of `normalize` where all tools share one catalog (one row per name).

    Facts hang on the name alone, so the catalog is asked once per name and tool, not per rule.
    """
    ends = ", ".join(f"named_struct('name', {s}, 'kind', {s}_kind)" for s in ("source", "destination"))
    named = (_bare(parsed).selectExpr("source_tool AS tool", "tool_rank", "record_seq", f"explode(array({ends})) AS e")
             .groupBy("tool", "e.name", "e.kind").agg(F.min("tool_rank").alias("tool_rank"), F.min("record_seq").alias("record_seq")))
    facts = lookup(named, F.expr("CASE WHEN kind = 'identity' THEN name END"), parsed.catalog, "name",
                   {"ip": "ip", "__cidr": "cidr", "__tags": "tags"}, spread=F.col("record_seq"))
    seen = shaped(facts, SEEN, cidr="CASE WHEN kind = 'cidr' THEN name ELSE __cidr END", tags=f"coalesce(__tags, {_NONE})")
    return merge_entities(seen.unionByName(parsed.listed))


def shared_placed(parsed: Parsed, names: DataFrame) -> DataFrame:
    """`graph.place` of the records of `normalize`, where all tools share one catalog (one row per name).

    What the catalog and `names` tell of an end is joined once, by name, so a rule is moved once per end; resolving
    it first and placing it then moves it twice.
    """
    catalog = parsed.catalog.select("name", F.col("ip").alias("__ip"), F.col("tags").alias("__tags"))
    told = names.join(catalog, "name", "full")
    rules = _bare(parsed)
    for side in ("source", "destination"):
        facts = {f"{side}_ip": "__ip"} | ({"destination_tags": "__tags"} if side == "destination" else {})
        rules = graph.with_node(rules, side[0], side, told, facts)
        # a network is no name of the catalog
        rules = rules.withColumns({c: F.expr(f"CASE WHEN {side}_kind = 'identity' THEN {c} END") for c in facts})
    own = [f"{side}_{c}" for side in ("s", "d") for c in graph.NODE_FACTS]
    return graph.settled(_records(rules, *own))


def merge_entities(seen: DataFrame) -> DataFrame:
    """One row per (tool, name): union of tags, first address seen, abstract if all are."""
    return seen.groupBy("tool", "name").agg(
        F.expr("min_by(kind, record_seq)").alias("kind"), F.expr("min(tool_rank)").alias("tool_rank"),
        F.expr("min_by(ip, CASE WHEN ip IS NOT NULL THEN record_seq END)").alias("ip"),
        F.expr("min_by(cidr, CASE WHEN cidr IS NOT NULL THEN record_seq END)").alias("cidr"),
        F.expr("array_sort(array_distinct(flatten(collect_set(tags))))").alias("tags"),
        F.expr("min_by(identifiers, CASE WHEN identifiers IS NOT NULL THEN record_seq END)").alias("identifiers"),
        F.expr("bool_and(coalesce(abstract, kind = 'cidr'))").alias("abstract"),
    ).select(*ENTITY)


def union_parsed(parts: list[Parsed]) -> Parsed:
    return Parsed(*[reduce(DataFrame.unionByName, column) for column in zip(*parts)])


def resolved_rows(catalog: DataFrame, tool: str, fields: list[str], device: str = "NULL", kind: str = "'address'",
                  dynamic: str = "false") -> DataFrame:
    """Name -> value audit rows; the value is JSON with its fields in alphabetical order."""
    body = ", ".join(f"'{f}', `{f}`" for f in sorted(fields))
    return catalog.selectExpr(
        f"'{tool}' AS source_tool", f"CAST({device} AS string) AS source_device", "name AS object_name",
        f"{kind} AS object_kind", f"to_json(named_struct({body}), map('ignoreNullFields', 'false')) AS resolved",
        f"coalesce({dynamic}, false) AS is_dynamic")
