"""The snapshot plan: records to identities, graph, findings and ranked order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import lookups as L
from ..operators import graph, paths
from ..operators.detect import chains, nesting, rules
from ..operators.identity import Identities, fill_missing_entities, resolve_identities
from ..operators.scratch import cut
from ..schemas import RECORD
from ..sources.normalize import Normalized, Parsed, shared_placed


@dataclass(frozen=True)
class View:
    """Placed records with the tables every detector and question reads."""

    records: DataFrame
    identities: Identities
    names: DataFrame
    placed: DataFrame
    nodes: DataFrame
    edges: DataFrame
    grants: DataFrame

    @property
    def pairs(self) -> DataFrame:
        """The edges by name alone."""
        return self.edges

    @property
    def passing(self) -> DataFrame:
        """The edges that paths from the internet can use."""
        return graph.passing(self.edges)


class BuiltView(View):
    """A view whose edges and nodes are found, and written, when first asked for: some reports and detectors need none."""

    def __init__(self, keep: Callable[[DataFrame], DataFrame], **tables):
        self.__dict__.update(tables, keep=keep)

    @cached_property
    def nodes(self) -> DataFrame:
        # searches and every end of a path ask the nodes
        return self.keep(graph.nodes(self.identities.assets, self.placed))

    @cached_property
    def edges(self) -> DataFrame:
        return self.keep(graph.edges(self.placed))

    @property
    def pairs(self) -> DataFrame:
        return self.edges if "edges" in self.__dict__ else graph.pairs(self.placed)

    @cached_property
    def passing(self) -> DataFrame:
        # few rules leave a concrete node: no more than those are grouped, unless all were asked for before
        return graph.passing(self.edges) if "edges" in self.__dict__ else self.keep(graph.edges(graph.passing(self.placed)))


def build_view(records: DataFrame | Parsed, entities: DataFrame, merges: DataFrame | None = None,
               materialize: bool = False) -> View:
    """Resolve identities and place every record; with `materialize`, write the shared tables once.

    Instead of records, the rules of tools that share one catalog may be given: they are resolved and placed at once.
    """
    keep = cut if materialize else (lambda df: df)
    found = resolve_identities(entities, merges)
    names = keep(graph.directory(found))
    if isinstance(records, Parsed):
        placed = keep(shared_placed(records, names))
        records = placed.select(*RECORD)
    else:
        placed = keep(graph.place(records, names))
    return BuiltView(keep, records=records, identities=found, names=names, placed=placed, grants=graph.grants(placed))


def rule_findings(placed: DataFrame) -> DataFrame:
    """Findings of the four detectors that need no path search."""
    return (rules.over_permissive(placed).unionByName(nesting.cidr_overlap(placed))
            .unionByName(nesting.shadowed_rules(placed)).unionByName(rules.blind_spots(placed))
            .unionByName(rules.tls_fallback(placed)))


def detect(view: View) -> DataFrame:
    chained = chains.path_findings(paths.cross_tool_paths(view.passing, view.nodes))
    return rule_findings(view.placed).unionByName(chained)


def finding_order() -> list[Column]:
    """Total order of findings: forced, severity, band, type, id."""
    return [F.desc("forced_critical"), F.desc("severity"), L.band_rank("severity_band"), F.asc("type"),
            F.asc("finding_id")]


def finalize(findings: DataFrame, snapshot_id: str) -> DataFrame:
    """Snapshot-scoped ids instead of local keys."""
    return findings.withColumn("finding_id", ids.stable_id("F", F.lit(snapshot_id), F.col("local_key"))).drop("local_key")


@dataclass(frozen=True)
class Snapshot:
    snapshot_id: str
    label: str
    view: View
    resolved: DataFrame
    findings: DataFrame


def run_snapshot(source: Normalized, label: str, merges: DataFrame | None = None, changes: DataFrame | None = None,
                 materialize: bool = True) -> Snapshot:
    """Everything of one snapshot, as DataFrames. `changes` are pushed changes to fold in first."""
    records, entities = source.records, source.entities
    if changes is not None:
        from ..operators.change import apply_overlay

        records = apply_overlay(records, changes)
        entities = fill_missing_entities(entities, records)
    if materialize:
        records, entities = cut(records), cut(entities)
    view = build_view(records, entities, merges, materialize)
    sid = ids.snapshot_id(label, ids.fingerprint(records).first()["fingerprint"])
    findings = finalize(detect(view), sid)
    return Snapshot(sid, label, view, source.resolved, cut(findings) if materialize else findings)


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*finding_order())


def ranked(findings: DataFrame) -> DataFrame:
    """Add `position`, from 1, in the total order.

    The rows are dealt into ranges of the order and written; each range is numbered by itself and
    starts after the rows of the ranges before it, so no task sees them all.
    """
    parts = cut(findings.repartitionByRange(*finding_order()).withColumn("_range", F.spark_partition_id()))
    sizes = parts.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*finding_order()))
    return (parts.withColumn("_i", inside).join(sizes.select("_range", before.alias("_before")), "_range")
            .withColumn("position", (F.col("_before") + F.col("_i")).cast("bigint")).drop("_range", "_i", "_before"))


def filter_findings(findings: DataFrame, kind: str | None = None, min_severity: int = 0) -> DataFrame:
    out = findings.filter(F.col("severity") >= min_severity)
    return out.filter(F.col("type") == kind) if kind else out
