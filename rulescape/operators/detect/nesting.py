"""Findings about rules whose sources nest: redundant pairs and rules that never fire.

Nesting is found by equality, never by comparing all pairs: a rule's network is cut to
each prefix length its group uses and looked up among the group's networks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import lookups as L
from ...functions import net, score
from ..graph import is_allow
from ..scratch import cut
from .rules import as_findings, formula, scored, signals_json, vector

NET_KEY = ["version", "plen", "hi", "lo"]
_WORDS = ["w0", "w1", "w2"]


def _flat(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({k: F.col(f"{column}.{k}") for k in NET_KEY})


def group_lengths(df: DataFrame, group: list[str], at_least: int = 2) -> DataFrame:
    """Prefix lengths in use per group and IP version; groups of one rule drop out."""
    bits = [F.bit_or(b).alias(w) for b, w in zip(net.length_bits("src_net"), _WORDS)]
    return df.groupBy(*group, F.col("src_net.version").alias("version")).agg(
        F.count(F.lit(1)).alias("members"), *bits).filter(F.col("members") >= at_least).drop("members")


def enclosing(df: DataFrame, lengths: DataFrame, group: list[str]) -> DataFrame:
    """One row per rule and enclosing network (itself included) at a length its group uses."""
    return _levels(df.withColumn("version", F.col("src_net.version")).join(lengths, [*group, "version"]).drop("version"))


def _levels(df: DataFrame) -> DataFrame:
    """The enclosing networks of rules that carry the prefix lengths of their group."""
    out = df.withColumn("level", F.explode(net.lengths_up_to(_WORDS, "src_net.plen"))).withColumn(
        "up", net.parent_at("src_net", "level"))
    return _flat(out.drop(*_WORDS), "up").drop("up", "level")


_PAIR = ["raw_ref", "record_seq", "source", "sensitive", "plen0"]


def nested_pairs(inner_rules: DataFrame, outer_rules: DataFrame, group: list[str], lengths: DataFrame,
                 *carry: str) -> DataFrame:
    """Pairs of one group in which an outer rule's network contains the inner rule's: `o_*` and `i_*`.

    Of two equal networks the one with the later (raw_ref, record_seq) is the outer one.
    `lengths` are the outer rules' prefix lengths; `carry` are further columns of either side.
    """
    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.withColumn("plen0", F.col("src_net.plen")).select(
            *group, "src_net", *[F.col(c).alias(f"{prefix}_{c}") for c in _PAIR], *[c for c in carry if c in df.columns])

    inner = enclosing(side(inner_rules, "i"), lengths, group).drop("src_net")
    outer = _flat(side(outer_rules, "o"), "src_net").drop("src_net")
    later = F.struct("o_raw_ref", "o_record_seq") > F.struct("i_raw_ref", "i_record_seq")
    return inner.join(outer, [*group, *NET_KEY]).filter((F.col("o_plen0") < F.col("i_plen0")) | later).drop(*NET_KEY)


OVERLAP_GROUP = ["source_tool", "destination", "service"]


def overlap_rules(placed: DataFrame) -> DataFrame:
    return placed.filter(is_allow() & F.col("src_net").isNotNull()).withColumn(
        "sensitive", L.is_sensitive("dest_tags"))


def overlap_findings(pairs: DataFrame) -> DataFrame:
    c = F.col
    first = F.struct("o_raw_ref", "o_record_seq") < F.struct("i_raw_ref", "i_record_seq")
    broad = (F.least("o_plen0", "i_plen0") <= L.OVERLAP_BROAD_PREFIX) | c("o_sensitive") | c("i_sensitive")
    out = pairs.withColumns({
        "severity": L.OVERLAP_BASE + F.when(broad, L.OVERLAP_BUMP).otherwise(0),
        "refs": F.when(first, F.array("o_raw_ref", "i_raw_ref")).otherwise(F.array("i_raw_ref", "o_raw_ref")),
        "cidr_a": F.when(first, c("o_source")).otherwise(c("i_source")),
        "cidr_b": F.when(first, c("i_source")).otherwise(c("o_source")),
    })
    return as_findings(out.withColumns({
        "local_key": F.concat_ws("|", F.lit("cidr_overlap"), "source_tool", F.array_join("refs", "|")),
        "type": F.lit("cidr_overlap"),
        "title": F.concat(F.lit("Redundant rules to "), c("destination"), F.lit(" ("), c("service"), F.lit("): "),
                          c("o_source"), F.lit(" already covers "), c("i_source")),
        "severity_band": score.band("severity"), "forced_critical": F.lit(False),
        "signals": signals_json(
            cidr_a=c("cidr_a"), cidr_b=c("cidr_b"), relation=F.lit("contains"), refs=c("refs"), dest=c("destination"),
            service=c("service"), tool=c("source_tool"), outer=c("o_source"), inner=c("i_source"),
            severity_vector=F.create_map().cast("map<string,double>")),
        "involved": F.array("destination"), "raw_refs": c("refs"), "source_tools": F.array("source_tool"),
    }))


def cidr_overlap(placed: DataFrame) -> DataFrame:
    """Allow rules of one tool, destination and service whose sources contain one another."""
    found = overlap_rules(placed)
    return overlap_findings(nested_pairs(found, found, OVERLAP_GROUP, group_lengths(found, OVERLAP_GROUP)))


def network_forest(placed: DataFrame) -> DataFrame:
    """The overlaps of `cidr_overlap` as classes: one row per network of a tool, destination and service.

    `source, n_rules, first_ref`; `parent`, the nearest network of the same group that encloses it (null for a
    root); `n_above`, the rules on all enclosing networks; `n_pairs`, the pairs in which a rule of the class
    is the inner one. Rows and work are linear in the classes times the prefix lengths in use, however many rules
    one network has: equal networks are counted before anything is joined. `nested_pairs` spells pairs out.
    """
    classes = overlap_rules(placed).groupBy(*OVERLAP_GROUP, "src_net").agg(
        F.count(F.lit(1)).alias("n_rules"), F.min("raw_ref").alias("first_ref"), F.min("source").alias("source"))
    classes = _flat(classes, "src_net")
    inner = enclosing(classes.select(*OVERLAP_GROUP, "src_net", F.col("plen").alias("plen0")), group_lengths(classes, OVERLAP_GROUP), OVERLAP_GROUP)
    outer = classes.select(*OVERLAP_GROUP, *NET_KEY, F.col("n_rules").alias("o_rules"), F.col("source").alias("o_source"))
    above = inner.filter("plen < plen0").join(outer, [*OVERLAP_GROUP, *NET_KEY]).groupBy(*OVERLAP_GROUP, "src_net").agg(
        F.sum("o_rules").alias("n_above"), F.max_by("o_source", "plen").alias("parent"))
    return classes.join(above, [*OVERLAP_GROUP, "src_net"], "left").withColumn("n_above", F.coalesce("n_above", F.lit(0).cast("bigint"))).select(
        *OVERLAP_GROUP, "source", "n_rules", "first_ref", "parent", "n_above",
        F.expr("n_rules * (n_rules - 1) div 2 + n_rules * n_above").alias("n_pairs"))


SHADOW_GROUP = ["source_tool", "d"]
_SOURCE_KEY = [*NET_KEY, "who"]
_KEY = [*SHADOW_GROUP, "svc", *_SOURCE_KEY]


def position() -> Column:
    return F.struct(F.col("order").alias("order"), F.col("raw_ref").alias("raw_ref"),
                    F.col("record_seq").alias("record_seq"))


def ordered_rules(placed: DataFrame) -> DataFrame:
    """Rules that take part in shadowing, with a network key or (identities) a name key."""
    usable = F.col("order").isNotNull() & ((F.col("source_kind") == "identity") | F.col("src_net").isNotNull())
    named = F.col("source_kind") == "identity"
    return placed.filter(usable).withColumns({
        "who": F.when(named, F.col("source")).otherwise(""), "open": F.col("protocol") == "any",
        "src_net": F.when(~named, F.col("src_net"))})


def _own_key(rules: DataFrame) -> DataFrame:
    return rules.withColumns({k: F.coalesce(F.col(f"src_net.{k}"), F.lit(0)) for k in NET_KEY})


def covering_keys(rules: DataFrame) -> DataFrame:
    """Keys under which a rule can shadow others: by label, and among open rules, and among all."""
    return _own_key(rules).withColumn("svc", F.explode(F.when(F.col("open"), F.array(
        F.lit("*"), F.concat(F.lit("="), "service"), F.lit("any"))).otherwise(
        F.array(F.lit("*"), F.concat(F.lit("="), "service")))))


def probing_keys(rules: DataFrame, lengths: DataFrame, *carry: str) -> DataFrame:
    """Keys under which a rule looks for rules that cover it."""
    slim = rules.select(*SHADOW_GROUP, "src_net", "who", "open", "service", "order", "raw_ref", "record_seq", *carry)
    networks = enclosing(slim.filter("src_net IS NOT NULL"), lengths, SHADOW_GROUP)
    identities = _own_key(slim.filter("src_net IS NULL"))
    return _probes(networks.drop("src_net"), identities.drop("src_net")).drop("service", "open")


def _probes(networks: DataFrame, identities: DataFrame) -> DataFrame:
    svc = F.when(F.col("open"), F.array(F.lit("*"))).otherwise(
        F.array(F.concat(F.lit("="), "service"), F.lit("any")))
    return networks.unionByName(identities).withColumn("svc", F.explode(svc))


def _first(keys: DataFrame) -> DataFrame:
    return keys.groupBy(*_KEY).agg(F.min_by(
        F.struct(position().alias("pos"), "source", "action"), position()).alias("cover"))


def first_covering(rules: DataFrame) -> DataFrame:
    """The earliest rule under each key: a partial minimum, whatever the group's size."""
    return _first(covering_keys(rules))


#: Services are counted in so many slots by hash; rules of one service are in one slot.
_SLOTS = 8


def rivals(rules: DataFrame, carry: tuple[str, ...] = ("source", "action"), area: DataFrame | None = None) -> DataFrame:
    """The rules that may cover another one or be covered, with the prefix lengths of their group.

    Both rules are of one tool, destination and IP version (or source name), and have one service or one of them
    is open. A few counts per group leave out most rules before any key is spelled out. `carry` are further columns
    to keep; with `area` (SHADOW_GROUP) only rules of those groups are looked at.
    """
    slim = rules.select(*SHADOW_GROUP, F.coalesce("src_net.version", F.lit(0)).alias("version"), "who", "src_net", "open", "service",
                        "order", "raw_ref", "record_seq", *carry,
                        F.coalesce(F.pmod(F.xxhash64("service"), F.lit(_SLOTS)), F.lit(0)).alias("slot"))
    group = [*SHADOW_GROUP, "version", "who"]
    bits = [F.bit_or(b).alias(w) for b, w in zip(net.length_bits("src_net"), _WORDS)]
    counts = slim.groupBy(*group).agg(F.count(F.lit(1)).alias("members"), F.count_if("open").alias("n_open"), *bits,
                                      *[F.count_if(F.col("slot") == i).alias(f"n{i}") for i in range(_SLOTS)]).filter("members > 1")
    if area is not None:
        counts = counts.join(area, SHADOW_GROUP, "left_semi")
    like = F.element_at(F.array(*[f"n{i}" for i in range(_SLOTS)]), F.col("slot").cast("int") + 1)
    return (slim.join(counts, group).filter(F.col("open") | (F.col("n_open") > 0) | (like > 1))
            .drop("version", "slot", "members", *[f"n{i}" for i in range(_SLOTS)]))


def rival_covers(some: DataFrame) -> DataFrame:
    """Of `rivals`, the keys under which each can shadow others.

    Without an open rule in the group, nobody asks for `any` or for all services.
    """
    return covering_keys(some).filter((F.col("n_open") > 0) | (F.col("svc") == F.concat(F.lit("="), "service")))


def rival_probes(some: DataFrame, *carry: str) -> DataFrame:
    """Of `rivals`, the keys under which each looks for rules that cover it."""
    networks = some.filter("src_net IS NOT NULL")
    probes = _probes(_levels(networks).drop("src_net"), _own_key(some.filter("src_net IS NULL")).drop("src_net", *_WORDS))
    return probes.filter((F.col("n_open") > 0) | (F.col("svc") != "any")).select(*_KEY, "order", "raw_ref", "record_seq", *carry)


def shadowers(rules: DataFrame) -> DataFrame:
    """(record_seq, cover): each shadowed rule with the earliest earlier rule that covers it.

    The earliest rule under a key precedes this one or nothing under that key does, so one
    minimum per key decides; rules are never paired with each other.
    """
    some = cut(rivals(rules))
    hit = rival_probes(some).join(_first(rival_covers(some)), _KEY).filter(F.col("cover.pos") < position())
    return hit.groupBy("record_seq").agg(F.min_by("cover", F.col("cover.pos")).alias("cover"))


def shadow_scored(placed: DataFrame) -> DataFrame:
    """Rules with the severity they have as shadowed rules."""
    return scored(placed).withColumn("severity", F.when(
        is_allow(), F.lit(L.SHADOWED_ALLOW_SEVERITY)).otherwise(formula()))


def shadow_findings(shadowed: DataFrame) -> DataFrame:
    """Findings from placed rules that carry their `cover`."""
    c = F.col
    deny = c("action") == "deny"
    out = shadow_scored(shadowed)
    flow = F.concat(c("source"), F.lit(" -> "), c("d_display"), F.lit(" ("), c("service"), F.lit(")"))
    ref, src = c("cover.pos.raw_ref"), c("cover.source")
    reason = F.when(deny, F.concat(
        F.lit("deny "), flow, F.lit(" never fires; earlier allow "), ref, F.lit(" ("), src,
        F.lit(") already permits it"))).otherwise(F.concat(
            F.lit("allow "), flow, F.lit(" is redundant; earlier rule "), ref, F.lit(" ("), src,
            F.lit(") already covers it")))
    title = F.when(deny, F.concat(F.lit("Dead deny on "), c("d_display"),
                                  F.lit(": blocked traffic is actually allowed"))).otherwise(
        F.concat(F.lit("Dead allow on "), c("d_display"), F.lit(": redundant rule never adds anything")))
    return as_findings(out.withColumns({
        "local_key": F.concat_ws("|", F.lit("shadowed_rule"), "source_tool", "raw_ref"),
        "type": F.lit("shadowed_rule"), "title": title,
        "severity_band": score.band("severity"), "forced_critical": F.lit(False),
        "signals": signals_json(
            shadowed_ref=c("raw_ref"), shadowing_ref=ref, reason=reason, shadowed_action=c("action"),
            shadowing_action=c("cover.action"), dest=c("d"), service=c("service"), tool=c("source_tool"),
            severity_vector=F.when(c("action") != "allow", vector())),
        "involved": F.array("s", "d"), "raw_refs": F.array_sort(F.array(ref, c("raw_ref"))),
        "source_tools": F.array("source_tool"),
    }))


def shadowed_rules(placed: DataFrame) -> DataFrame:
    """Rules that can never fire because an earlier one covers them."""
    return shadow_findings(placed.join(shadowers(ordered_rules(placed)), "record_seq"))
