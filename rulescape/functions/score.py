"""Severity model: exposure, port, destination and boundary factors.

Arguments are SQL expressions over the row (usually column names).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L


def exposure(source_kind: str, plen: str) -> Column:
    """E from the prefix length of a network source."""
    bands = " ".join(f"WHEN {plen} <= {n} THEN {e}D" for n, e in L.EXPOSURE_BANDS)
    floor = f"{L.IDENTITY_EXPOSURE}D"
    return F.expr(f"CASE WHEN {source_kind} = 'identity' OR {plen} IS NULL THEN {floor} {bands} ELSE {floor} END")


def _port_ladder(protocol: str, port: str, field: int) -> Column:
    value = {name: L.literal(pair[field]) for name, pair in L.PORT_CLASSES.items()}
    sets = {"admin": L.ADMIN_PORTS, "data_store": L.DATA_STORE_PORTS, "control_plane": L.CONTROL_PLANE_PORTS,
            "general": L.GENERAL_PORTS}
    steps = " ".join(f"WHEN {port} IN ({L.listing(ports)}) THEN {value[name]}" for name, ports in sets.items())
    return F.expr(f"CASE WHEN {protocol} = 'any' THEN {L.literal(L.ANY_PORT[field])} {steps} ELSE {value['unknown']} END")


def port_sensitivity(protocol: str, port: str) -> Column:
    return _port_ladder(protocol, port, 0)


def port_class(protocol: str, port: str) -> Column:
    return _port_ladder(protocol, port, 1)


def dest_sensitivity(tags: str) -> Column:
    """D: the highest sensitivity among the tags; unknown or no tags score the default."""
    default = f"{L.UNTAGGED_SENSITIVITY}D"
    scored = f"transform({tags}, t -> coalesce({L.pick_sql(L.TAG_SENSITIVITY, 't')}, {default}))"
    return F.expr(f"coalesce(array_max({scored}), {default})")


def zone(node: str, tags: str | None = None) -> Column:
    """Zone of a node by its tags (none: only the internet node stands out)."""
    tagged = "" if tags is None else (f"WHEN {L.overlap_sql(tags, L.DMZ_TAGS)} THEN 'dmz' "
                                      f"WHEN {L.overlap_sql(tags, L.DEV_TAGS)} THEN 'dev'")
    return F.expr(f"CASE WHEN {node} = '{L.INTERNET}' THEN 'internet' {tagged} ELSE 'internal' END")


def boundary(src_zone: str, dst_zone: str) -> Column:
    return F.expr(f"concat({src_zone}, '->', {dst_zone})")


def _factor(src_zone: str, dst_zone: str) -> str:
    key = f"concat({src_zone}, '->', {dst_zone})"
    return f"coalesce({L.pick_sql(L.BOUNDARY_FACTORS, key)}, {L.SAME_ZONE_FACTOR}D)"


def boundary_factor(src_zone: str, dst_zone: str) -> Column:
    return F.expr(_factor(src_zone, dst_zone))


def crosses(src_zone: str, dst_zone: str) -> Column:
    return F.expr(f"{_factor(src_zone, dst_zone)} > {L.SAME_ZONE_FACTOR}D")


def severity(E: str, P: str, D: str, B: str) -> Column:
    """0-100. Doubles combined in this order and rounded half to even."""
    raw = f"({D} * (0.5D + 0.5D * {P})) * (0.4D + 0.6D * {E}) * {B}"
    return F.expr(f"CAST(rint(100 * least({raw}, 1.0D)) AS int)")


def band(value: str) -> Column:
    steps = " ".join(f"WHEN {value} >= {floor} THEN '{name}'" for floor, name in L.BAND_FLOORS)
    return F.expr(f"CASE {steps} ELSE 'low' END")


def compact(*items: Column) -> Column:
    """Array of the items that are not NULL, in order."""
    return F.array_compact(F.array(*items))


def token_cost(provider: str, model: str, prompt_tokens: str, completion_tokens: str) -> Column:
    key = f"concat_ws(':', {provider}, {model})"
    rate = [f"coalesce({L.pick_sql({k: p[i] for k, p in L.TOKEN_PRICES.items()}, key)}, 0D)" for i in (0, 1)]
    cost = f"({prompt_tokens} / 1000000D) * {rate[0]} + ({completion_tokens} / 1000000D) * {rate[1]}"
    return F.expr(f"CASE WHEN {provider} = '{L.FREE_PROVIDER}' THEN 0D ELSE bround({cost}, 6) END")
