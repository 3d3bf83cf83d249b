"""Content-derived identifiers (SHA-1 over parts joined by the unit separator)."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEP = "\x1f"


def digest(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha1(F.concat_ws(_SEP, *parts)), 1, length)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), digest(*parts))


def json_text(text: Column) -> Column:
    """A string as an ASCII JSON literal (other characters as UTF-16 escapes)."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    named = {"0022": '\\"', "005C": "\\\\", "000A": "\\n", "000D": "\\r", "0009": "\\t",
             "0008": "\\b", "000C": "\\f"}

    def one(u: Column) -> Column:
        cases = reduce(lambda acc, kv: acc.when(u == kv[0], F.lit(kv[1])), named.items(), F.when(F.lit(False), ""))
        plain = (u >= "0020") & (u <= "007E")
        return cases.when(plain, F.chr(F.conv(u, 16, 10).cast("int"))) \
                    .otherwise(F.concat(F.lit("\\u"), F.lower(u)))

    escaped = F.array_join(F.transform(units, one), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r"^[ !#-\[\]-~]*$"), text).otherwise(escaped), F.lit('"'))


def json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, json_text), ","), F.lit("]"))


def fingerprint_line(order: str = "order") -> Column:
    return F.concat_ws("|", "source_tool", "raw_ref", "source", "destination", "service", "action",
                       F.coalesce(F.col(order).cast("string"), F.lit("None")))


def fingerprint(records: DataFrame) -> DataFrame:
    """One row, `fingerprint`: a digest of the rules that ignores their order, the same at every size.

    Four 60-bit words of each line's SHA-256 are summed (partial sums on every task, constant
    state), so nothing is gathered. The published id hashes one sorted list of all lines instead,
    which one task would have to hold; the two ids of one rule set differ.
    """
    lines = records.select(fingerprint_line().alias("line"))
    word = [F.conv(F.substring(F.sha2("line", 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = lines.select(*[w.alias(f"w{i}") for i, w in enumerate(word)]).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(4)])
    return sums.select(F.concat(F.lit("sum:"), F.sha1(F.concat_ws(
        "|", *[F.col(c).cast("string") for c in ("n", "w0", "w1", "w2", "w3")]))).alias("fingerprint"))


def snapshot_id(label: str, fingerprint_: str) -> str:
    """`snap_` plus twelve hex digits of label and fingerprint."""
    return "snap_" + hashlib.sha1(_SEP.join([label, fingerprint_]).encode()).hexdigest()[:12]
