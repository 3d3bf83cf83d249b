"""Findings that one rule, or the rules into one destination, decide.

Each detector takes the placed records and returns schemas.FINDING rows. Texts below
are the published finding texts (fixed values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import lookups as L
from ...functions import score
from ...functions.score import compact
from ...schemas import FINDING
from ..graph import is_allow

# columns of the factors exposure, port, destination, boundary
FACTORS = ["fe", "fp", "fd", "fb"]


def scored(placed: DataFrame) -> DataFrame:
    """Add the factors E, P, D, B (FACTORS) and what detectors derive from them."""
    out = placed.withColumns({
        "fe": score.exposure("source_kind", "src_net.plen"),
        "fp": score.port_sensitivity("protocol", "port"),
        "fd": score.dest_sensitivity("dest_tags"),
        "fb": score.boundary_factor("src_zone", "dst_zone"),
        "sensitive": L.is_sensitive("dest_tags"),
    })
    return out.withColumn("internet", F.col("fe") >= 1.0)


def formula() -> Column:
    return score.severity(*FACTORS)


def as_findings(df: DataFrame) -> DataFrame:
    """Finding columns; rows computed for a what-if keep their `edit`."""
    return df.select(*FINDING, *[c for c in ("edit",) if c in df.columns])


def signals_json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def vector() -> Column:
    return F.expr("named_struct('E', fe, 'P', fp, 'D', fd, 'B', fb)")


def broad_reasons() -> Column:
    """Why a grant is over-permissive; empty when it is not. Needs the `scored` columns."""
    c = F.col
    return compact(
        F.when(c("protocol") == "any", "allows every protocol and port (any/any)"),
        F.when(c("internet") & ((c("fp") >= L.ADMIN_DATA_P) | c("sensitive")), "exposed directly to the internet"),
        F.when(c("sensitive") & (c("fe") >= L.SENSITIVE_DEST_E),
               "regulated destination reachable from more than a single host"),
        F.when((c("fp") >= L.ADMIN_DATA_P) & (c("fe") >= L.BROAD_SOURCE_E), "admin/data port open to a broad source range"))


def forced_reasons() -> Column:
    """Patterns that are critical whatever the score. Needs the `scored` columns."""
    c = F.col
    return compact(
        F.when(c("internet") & (c("protocol") == "any"), "internet any/any"),
        F.when(c("internet") & F.coalesce(c("port").isin(L.ADMIN_PORTS), F.lit(False)),
               "admin/lateral-movement port exposed to the internet"),
        F.when(c("internet") & c("sensitive"), "regulated/crown-jewel asset reachable from the internet"))


def source_label() -> Column:
    return F.when(F.col("internet"), "the internet").otherwise(F.col("source"))


def over_permissive(placed: DataFrame) -> DataFrame:
    c = F.col
    hit = scored(placed.filter(is_allow())).withColumn("reasons", broad_reasons()).filter(F.size("reasons") > 0)
    port_name = L.pick(L.PORT_NAMES, "port")
    access = F.when(c("protocol") == "any", "any protocol/port").otherwise(F.coalesce(port_name, c("service")))
    hit = hit.withColumns({"severity": formula(), "forced": forced_reasons()})
    return as_findings(hit.withColumns({
        "local_key": F.concat_ws("|", F.lit("over_permissive"), "source_tool", "raw_ref"),
        "type": F.lit("over_permissive"),
        "title": F.concat(access, F.lit(" open from "), source_label(), F.lit(" to "), c("d_display")),
        "forced_critical": F.size("forced") > 0,
        "severity_band": F.when(F.size("forced") > 0, "critical").otherwise(score.band("severity")),
        "signals": signals_json(
            exposed_port=c("port"), port_name=port_name, service=c("service"), protocol=c("protocol"),
            source=c("source"), source_kind=c("source_kind"),
            source_scope=F.when(c("source_kind") == "cidr", c("source")).otherwise("identity"),
            source_prefixlen=c("src_net.plen"), dest=c("d"), dest_display=c("d_display"),
            dest_tags=F.array_sort("dest_tags"), src_zone=c("src_zone"), dst_zone=c("dst_zone"),
            boundary_crossed=score.crosses("src_zone", "dst_zone"),
            port_class=score.port_class("protocol", "port"), reasons=c("reasons"),
            forced_reasons=c("forced"), severity_vector=vector(), tool=c("source_tool"), raw_ref=c("raw_ref")),
        "involved": F.array("s", "d"), "raw_refs": F.array("raw_ref"), "source_tools": F.array("source_tool"),
    }))


def blind_spots(placed: DataFrame) -> DataFrame:
    """Allow rules on applications that cannot be inspected."""
    c = F.col
    hit = scored(placed.filter(is_allow() & c("l7_app").isin(L.UNINSPECTABLE_APPS)))
    exposed = c("internet") & ((c("fb") > L.SAME_ZONE_FACTOR) | c("sensitive"))
    target = F.when(c("sensitive"), "a regulated/crown-jewel asset").otherwise("an internal asset")
    hit = hit.withColumns({
        "severity": F.least(formula() + L.BLIND_SPOT_BUMP, F.lit(100)),
        "forced": compact(F.when(exposed, F.concat(
            F.lit("uninspectable app ("), c("l7_app"), F.lit(") reachable from the internet to "), target)))})
    return as_findings(hit.withColumns({
        "local_key": F.concat_ws("|", F.lit("transport_exposure|blind"), "source_tool", "raw_ref"),
        "type": F.lit("transport_exposure"),
        "title": F.concat(F.upper("l7_app"), F.lit(" ("), c("service"), F.lit(") reachable from "), source_label(),
                          F.lit(" to "), c("d_display"), F.lit(" — likely uninspected")),
        "forced_critical": F.size("forced") > 0,
        "severity_band": F.when(F.size("forced") > 0, "critical").otherwise(score.band("severity")),
        "signals": signals_json(
            subtype=F.lit("quic_blind_spot"), l7_app=c("l7_app"), l7_source=c("l7_source"), protocol=c("protocol"),
            exposed_port=c("port"), service=c("service"), source=c("source"), source_kind=c("source_kind"),
            dest=c("d"), dest_display=c("d_display"), dest_tags=F.array_sort("dest_tags"), src_zone=c("src_zone"),
            dst_zone=c("dst_zone"), boundary_crossed=score.crosses("src_zone", "dst_zone"),
            uninspectable=F.lit(True), port_class=score.port_class("protocol", "port"),
            forced_reasons=c("forced"), severity_vector=vector(), tool=c("source_tool"), raw_ref=c("raw_ref"),
            remediation_hint=F.lit("Block UDP/443 (force the TLS fallback) or route QUIC through "
                                   "an inspection-capable enforcement point.")),
        "involved": F.array("s", "d"), "raw_refs": F.array("raw_ref"), "source_tools": F.array("source_tool"),
    }))


def fallback_side() -> Column:
    """`tcp` or `udp` for the two sides of the TLS/QUIC pair, else NULL."""
    transport = F.concat_ws("/", "protocol", F.col("port").cast("string"))
    return F.when(F.col("port").isNotNull(),
                  F.when(transport == L.FALLBACK_TCP, "tcp").when(transport == L.FALLBACK_UDP, "udp"))


def fallback_hits(placed: DataFrame) -> DataFrame:
    return placed.filter(is_allow()).withColumn("side", fallback_side()).filter("side IS NOT NULL")


def fallback_refs(placed: DataFrame) -> DataFrame:
    """(d, side, source_tool, raw_ref) of every rule behind a fallback finding."""
    hits = fallback_hits(placed).select("d", "side", "source_tool", "raw_ref").distinct()
    both = hits.groupBy("d").agg(F.count_distinct("side").alias("n")).filter("n = 2").select("d")
    return hits.join(both, "d", "left_semi")


def tls_fallback(placed: DataFrame) -> DataFrame:
    """Destinations open on both sides of the pair: inspection cannot be forced.

    Counts, tools, the representative (first udp rule) and the smallest reference of each side
    come from one bounded aggregate; every reference is a row of `fallback_refs`.
    """
    c = F.col
    hits = fallback_hits(placed)
    udp = F.when(c("side") == "udp", c("record_seq"))
    rep = F.struct("source", "source_kind", "src_net", "protocol", "port", "dest_tags", "src_zone", "dst_zone", "d_display")
    found = hits.groupBy("d").agg(
        F.count_if(c("side") == "tcp").alias("n_tcp"), F.count_if(c("side") == "udp").alias("n_udp"),
        F.array_sort(F.collect_set("source_tool")).alias("source_tools"), F.min_by(rep, udp).alias("r"),
        F.min(F.when(c("side") == "tcp", c("raw_ref"))).alias("tcp_ref"),
        F.min(F.when(c("side") == "udp", c("raw_ref"))).alias("udp_ref"),
    ).filter("n_tcp > 0 AND n_udp > 0")
    out = scored(found.select("d", "n_tcp", "n_udp", "source_tools", "tcp_ref", "udp_ref", "r.*"))
    out = out.withColumn("raw_refs", F.array_sort(F.array_distinct(F.array("tcp_ref", "udp_ref"))))
    out = out.withColumn("severity", L.FALLBACK_BASE + F.when(c("sensitive"), L.FALLBACK_BUMP).otherwise(0))
    tcp, udp_ = L.FALLBACK_TCP, L.FALLBACK_UDP
    return as_findings(out.withColumns({
        "local_key": F.concat(F.lit("transport_exposure|fallback|"), c("d"),
                              F.lit(f"|{tcp}-{udp_}".replace("/", ""))),
        "type": F.lit("transport_exposure"),
        "title": F.concat(c("d_display"), F.lit(f" is reachable on both {tcp} and {udp_} "
                                                "— QUIC cannot be forced to the inspectable path")),
        "forced_critical": F.lit(False), "severity_band": score.band("severity"),
        "signals": signals_json(
            subtype=F.lit("tls_fallback_not_blocked"), dest=c("d"), dest_display=c("d_display"),
            dest_tags=F.array_sort("dest_tags"), pair=L.strings([tcp, udp_]), tcp_ref=c("tcp_ref"),
            udp_ref=c("udp_ref"), n_tcp=c("n_tcp"), n_udp=c("n_udp"),
            port_class=score.port_class("protocol", "port"), severity_vector=vector(),
            remediation_hint=F.lit(f"Block {udp_} so traffic falls back to the inspectable {tcp} path, "
                                   "or inspect QUIC explicitly.")),
        "involved": F.array("d"),
    }))
