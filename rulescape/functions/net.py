"""IP networks as four integer columns.

A network is `struct<version int, plen int, hi bigint, lo bigint>`: the address is
left-aligned in 128 bits (an IPv4 address fills the top 32), host bits cleared. Two
networks nest exactly when the wider one equals the narrower one cut to its length,
so containment is an equality on these integers and can be hash-joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = f"{_OCTET}([.]{_OCTET}){{3}}"
_GROUPS = "^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$"

NET_TYPE = "struct<version:int,plen:int,hi:bigint,lo:bigint>"


def cut_hi(hi: str, n: str) -> str:
    return (f"CASE WHEN {n} <= 0 THEN 0L WHEN {n} >= 64 THEN {hi} "
            f"ELSE {hi} & shiftleft(-1L, 64 - {n}) END")


def cut_lo(lo: str, n: str) -> str:
    return (f"CASE WHEN {n} <= 64 THEN 0L WHEN {n} >= 128 THEN {lo} "
            f"ELSE {lo} & shiftleft(-1L, 128 - {n}) END")


def _quad_value(addr: str) -> str:
    octet = [f"try_cast(split_part({addr}, '.', {i}) AS bigint)" for i in (1, 2, 3, 4)]
    return f"({octet[0]} * 16777216 + {octet[1]} * 65536 + {octet[2]} * 256 + {octet[3]})"


def _hex128(addr: str) -> str:
    """32 hex digits of an IPv6 text, NULL when malformed."""
    tail = f"regexp_extract({addr}, ':([^:]*)$', 1)"
    quad = _quad_value(tail)
    flat = (f"CASE WHEN {tail} RLIKE '^{_QUAD}$' THEN concat(regexp_extract({addr}, '^(.*:)[^:]*$', 1), "
            f"lower(hex({quad} div 65536)), ':', lower(hex({quad} % 65536))) ELSE {addr} END")
    body = f"""
      aggregate(array({flat}), CAST(NULL AS string), (acc, a) ->
        CASE WHEN instr(a, '::') = 0 THEN
               CASE WHEN a RLIKE '{_GROUPS}' AND size(split(a, ':')) = 8
                    THEN array_join(transform(split(a, ':'), g -> lpad(g, 4, '0')), '') END
             WHEN size(split(a, '::')) = 2
                  AND split_part(a, '::', 1) RLIKE '{_GROUPS}' AND split_part(a, '::', 2) RLIKE '{_GROUPS}'
             THEN aggregate(
                    array(struct(
                      filter(split(split_part(a, '::', 1), ':'), g -> g <> '') AS l,
                      filter(split(split_part(a, '::', 2), ':'), g -> g <> '') AS r)),
                    CAST(NULL AS string),
                    (x, p) -> CASE WHEN size(p.l) + size(p.r) <= 7 THEN array_join(transform(
                      concat(p.l, array_repeat('0', 8 - size(p.l) - size(p.r)), p.r),
                      g -> lpad(g, 4, '0')), '') END)
        END)"""
    return body


def with_network(df: DataFrame, token: str, out: str) -> DataFrame:
    """Add network struct `out` for text column `token` (NULL when it is not one).

    Accepts address/length, address/netmask, address/hostmask and a bare address
    (full length). Host bits are cleared.
    """
    a, p, v6, x, n = (f"__{out}_{s}" for s in ("a", "p", "v6", "x", "n"))
    mask = _quad_value(p)
    quad_len = f"""CASE
        WHEN {p} IS NULL THEN 32
        WHEN {p} RLIKE '^[0-9]+$' THEN CASE WHEN try_cast({p} AS bigint) <= 32 THEN try_cast({p} AS int) END
        WHEN {p} RLIKE '^{_QUAD}$' THEN CASE
          WHEN ((4294967295L - {mask}) & (4294967296L - {mask})) = 0 THEN 32 - bit_count(4294967295L - {mask})
          WHEN ({mask} & ({mask} + 1)) = 0 THEN 32 - bit_count({mask}) END
      END"""
    six_len = f"""CASE
        WHEN {p} IS NULL THEN 128
        WHEN {p} RLIKE '^[0-9]+$' AND try_cast({p} AS bigint) <= 128 THEN try_cast({p} AS int)
      END"""
    wide = f"conv(substring({x}, {{0}}, 16), 16, -10)"
    df = df.withColumns({
        a: F.expr(f"lower(substring_index({token}, '/', 1))"),
        p: F.expr(f"CASE WHEN instr({token}, '/') > 0 THEN substring({token}, instr({token}, '/') + 1) END"),
    }).withColumns({
        v6: F.expr(f"instr({a}, ':') > 0"),
        x: F.expr(f"CASE WHEN instr({a}, ':') > 0 THEN {_hex128(a)} END"),
        n: F.expr(f"CASE WHEN instr({a}, ':') > 0 THEN {six_len} "
                  f"WHEN {a} RLIKE '^{_QUAD}$' THEN {quad_len} END"),
    }).withColumns({
        f"{a}h": F.expr(f"CASE WHEN {v6} THEN try_cast({wide.format(1)} AS bigint) "
                        f"WHEN {n} IS NOT NULL THEN shiftleft({_quad_value(a)}, 32) END"),
        f"{a}l": F.expr(f"CASE WHEN {v6} THEN try_cast({wide.format(17)} AS bigint) ELSE 0L END"),
    })
    return df.withColumn(out, F.expr(
        f"CASE WHEN {n} IS NOT NULL AND {a}h IS NOT NULL THEN named_struct("
        f"'version', CASE WHEN {v6} THEN 6 ELSE 4 END, 'plen', CAST({n} AS int), "
        f"'hi', {cut_hi(a + 'h', n)}, 'lo', {cut_lo(a + 'l', n)}) END"
    )).drop(a, p, v6, x, n, f"{a}h", f"{a}l")


def is_cidr(token: str, net: str) -> Column:
    """True for explicit network notation (a slash and a parsable network)."""
    return F.expr(f"coalesce(instr({token}, '/') > 0 AND {net} IS NOT NULL, false)")


def network_text(net: str) -> Column:
    """Canonical `address/length` text of a network struct."""
    quad = ", ".join(f"shiftrightunsigned({net}.hi, {s}) & 255" for s in (56, 48, 40, 32))
    group = ("lower(hex(shiftrightunsigned(CASE WHEN i < 4 THEN {net}.hi ELSE {net}.lo END, "
             "48 - 16 * (i % 4)) & 65535))").format(net=net)
    # the leftmost longest run of two or more zero groups collapses to '::'
    runs = " ".join(
        f"WHEN t RLIKE '(^|:)0(:0){{{k - 1}}}(:|$)' THEN "
        f"regexp_replace(t, '^(.*?)(^|:)0(:0){{{k - 1}}}(:|$)(.*)$', '$1::$5')"
        for k in range(8, 1, -1))
    six = (f"aggregate(array(array_join(transform(sequence(0, 7), i -> {group}), ':')), "
           f"'', (acc, t) -> CASE {runs} ELSE t END)")
    return F.expr(f"CASE WHEN {net}.version = 4 THEN concat(concat_ws('.', {quad}), '/', {net}.plen) "
                  f"WHEN {net}.version = 6 THEN concat({six}, '/', {net}.plen) END")


def parent_at(net: str, level: str) -> Column:
    """The enclosing network of `net` at prefix length `level`."""
    return F.expr(f"named_struct('version', {net}.version, 'plen', {level}, "
                  f"'hi', {cut_hi(net + '.hi', level)}, 'lo', {cut_lo(net + '.lo', level)})")


# Prefix lengths present in a group travel as a 129-bit set held in three longs.
_WORD = 43


def length_bits(net: str) -> list[Column]:
    """Three OR-able words that mark the prefix length of `net`."""
    return [F.expr(f"CASE WHEN {net}.plen div {_WORD} = {w} THEN shiftleft(1L, {net}.plen % {_WORD}) ELSE 0L END")
            for w in range(3)]


def lengths_up_to(words: list[str], plen: str) -> Column:
    """Prefix lengths of a set that are no longer than `plen`."""
    w0, w1, w2 = words
    return F.expr(
        f"filter(sequence(0, {plen}), n -> (CASE n div {_WORD} WHEN 0 THEN {w0} WHEN 1 THEN {w1} ELSE {w2} END "
        f"& shiftleft(1L, n % {_WORD})) <> 0)")
