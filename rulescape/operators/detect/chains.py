"""Findings for paths that cross tools and end at a sensitive asset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import lookups as L
from ...functions import net, score
from ...functions.service import with_service
from .rules import FACTORS, as_findings, signals_json, vector


def path_scores(paths: DataFrame) -> DataFrame:
    """Add the factors, severity, forced and band to described paths."""
    c = F.col
    decoded = with_service(paths, "terminal_service").withColumn("entry_kind", F.when(
        c("entry").contains("/"), "cidr").otherwise("identity"))
    out = net.with_network(decoded, "entry", "entry_net").withColumns({
        "fe": score.exposure("entry_kind", "entry_net.plen"),
        "fp": score.port_sensitivity("protocol", "port"),
        "port_class": score.port_class("protocol", "port"),
        "fd": score.dest_sensitivity("terminal_tags"), "fb": c("boundary_multiplier"),
        "reaches_sensitive": L.is_sensitive("terminal_tags"),
    }).withColumns({
        "severity": score.severity(*FACTORS),
        "forced_critical": (c("boundary") == "internet->internal") & c("reaches_sensitive"),
    })
    return out.withColumn("severity_band", F.when(c("forced_critical"), "critical").otherwise(
        score.band("severity"))).drop("protocol", "port", "port_end", "service", "l7_app", "l7_source",
                                         "entry_kind", "entry_net")


def path_findings(paths: DataFrame) -> DataFrame:
    c = F.col
    out = path_scores(paths)
    shown = F.element_at("display_path", 1), F.element_at("display_path", -1)
    return as_findings(out.withColumns({
        "local_key": F.concat(F.lit("cross_tool_path|"), F.array_join("path", ">")),
        "type": F.lit("cross_tool_path"),
        "title": F.concat(F.lit("Cross-tool path: "), shown[0], F.lit(" can reach "), shown[1], F.lit(" through "),
                          F.size("tools").cast("string"), F.lit(" tools")),
        "signals": signals_json(
            path=c("path"), display_path=c("display_path"), hops=c("hops"), hops_tools=c("hops_tools"),
            tools=c("tools"), reaches_sensitive=c("reaches_sensitive"), boundary=c("boundary"),
            boundary_crossed=c("boundary_crossed"), terminal=c("terminal"), terminal_tags=c("terminal_tags"),
            terminal_service=c("terminal_service"), entry=c("entry"),
            severity_vector=vector(), port_class=c("port_class")),
        "involved": c("path"), "raw_refs": F.transform("hops", lambda h: h["ref"]), "source_tools": c("tools"),
    }))
