"""Strongly connected components of a directed graph, and reach over the graph of components.

A component is named by its smallest node. Nodes with one way out (or in) carry no choice: they are bypassed
by pointer doubling, so a chain or a cycle of n nodes takes log2(n) rounds. Nodes without a way in or out are
components of their own. What is left is coloured: every node takes the smallest name that reaches it, and
those from which their colour's own node can be reached back are one component.

A hub may hold a third of all edges: every step is a join on a node whose repeated side is the probe side of a
table with one row per node, or a partial minimum; no neighbourhood is gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import write_table

_MERGED = 8


def _turned(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("d").alias("s"), F.col("s").alias("d"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("s", "d")).alias("node")).distinct()


def _trim(pairs: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Drop the edges of nodes without a way in or out, until none is left."""
    while rows:
        rest, seen = write_table(pairs.join(_turned(pairs).select("s").distinct(), "s", "left_semi")
                                 .join(pairs.select(F.col("s").alias("d")).distinct(), "d", "left_semi").select("s", "d"))
        pairs = rest
        # a chain is bypassed faster than it is trimmed
        if rows - seen["rows"] <= rows // 8:
            return pairs, seen["rows"]
        rows = seen["rows"]
    return pairs, 0


def _bypass(pairs: DataFrame) -> tuple[DataFrame, int, list[DataFrame], DataFrame, DataFrame]:
    """Take out every node with one way out.

    `(edges among the others, rows, jumps, ends, cycles)`: `jumps[j]` leads 2^j nodes on, `ends` tells where the way of a node
    leaves them (`node, last`), and `cycles` names the nodes that only go round (`node, component`).
    """
    single = pairs.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("to")).filter("n = 1").select(
        F.col("s").alias("node"), "to")
    single, info = write_table(single)
    n = info["rows"]
    names = single.select(F.col("node").alias("to"), F.lit(True).alias("inside"))
    jump, info = write_table(single.join(names, "to", "left").select(
        "node", "to", F.coalesce("inside", F.lit(False)).alias("inside"), F.col("node").alias("least")), F.count_if("inside").alias("inside"))
    jumps, reach = [jump], 1
    while info["inside"] and reach < n:
        ahead = jump.select(F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("inside").alias("on"), F.col("least").alias("least2"))
        jump, info = write_table(jump.join(ahead, "to", "left").select(
            "node", F.when(F.col("inside"), F.col("beyond")).otherwise(F.col("to")).alias("to"),
            F.when(F.col("inside"), F.col("on")).otherwise(F.lit(False)).alias("inside"),
            F.when(F.col("inside"), F.least("least", "least2")).otherwise(F.col("least")).alias("least")),
            F.count_if("inside").alias("inside"))
        jumps.append(jump)
        reach *= 2
    ends = jump.filter("NOT inside").select("node", F.col("to").alias("last"))
    # whoever is still inside after as many steps as there are nodes goes round; where they stand is the cycle
    round_ = jump.filter("inside")
    cycles = round_.join(round_.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select("node", F.col("least").alias("component"))
    others = pairs.join(single.select(F.col("node").alias("s")), "s", "left_anti")
    to_end = others.join(ends.select(F.col("node").alias("d"), "last"), "d", "left")
    lost = round_.select(F.col("node").alias("d"))  # a way into a cycle never comes back
    rest, info = write_table(to_end.join(lost, "d", "left_anti").select("s", F.coalesce("last", "d").alias("d")).filter("s <> d").distinct())
    return rest, info["rows"], jumps, ends, cycles


def _restored(pairs: DataFrame, jumps: list[DataFrame], ends: DataFrame, found: DataFrame) -> DataFrame:
    """Components of bypassed nodes: those on a way from a component of the others back into it.

    `found` has the components of more than one of the other nodes; any other node is its own.
    """
    singles = jumps[0].select("node")
    own = pairs.join(singles.select(F.col("node").alias("s")), "s", "left_anti").join(ends.select(F.col("node").alias("d"), "last"), "d")
    own = own.join(found.select(F.col("node").alias("s"), F.col("component").alias("cs")), "s", "left")
    own = own.join(found.select(F.col("node").alias("last"), F.col("component").alias("cl")), "last", "left")
    marked, info = write_table(own.select("d", F.coalesce("cs", "s").alias("cs"), F.coalesce("cl", "last").alias("component")).filter(
        "cs = component").select(F.col("d").alias("node"), "component").distinct())
    if info["rows"]:
        for jump in jumps:  # steps of 1, 2, 4 ... nodes reach every node further on
            further = marked.join(jump.filter("inside").select("node", "to"), "node").select(F.col("to").alias("node"), "component")
            marked, _ = write_table(marked.unionByName(further).distinct())
    return marked


def _coloured(pairs: DataFrame, rows: int) -> DataFrame:
    """Components of what has no chains: colour forwards, then look back within a colour; the rest goes round again."""
    found = []
    while rows:
        colour, _ = write_table(_nodes(pairs).select("node", F.col("node").alias("colour")))
        moved = True
        while moved:
            met = pairs.join(colour.withColumnRenamed("node", "s"), "s").groupBy(F.col("d").alias("node")).agg(F.min("colour").alias("met"))
            colour, info = write_table(colour.join(met, "node", "left").select(
                "node", F.least("colour", "met").alias("colour"), (F.col("met") < F.col("colour")).alias("moved")), F.count_if("moved").alias("moved"))
            colour, moved = colour.drop("moved"), info["moved"]
        inner = pairs.join(colour.withColumnRenamed("node", "s"), "s").join(
            colour.select(F.col("node").alias("d"), F.col("colour").alias("other")), "d").filter("colour = other").select("s", "d", "colour")
        inner, _ = write_table(inner)
        ring, info = write_table(colour.filter("node = colour").select("node", F.col("colour").alias("component")))
        seen = [ring]
        while info["rows"]:
            back = inner.join(ring.select(F.col("node").alias("d"), "component"), "d").select(F.col("s").alias("node"), "component").distinct()
            ring, info = write_table(back.join(_union(seen), "node", "left_anti"))
            seen.append(ring)
        done, _ = write_table(_union(seen))
        found.append(done)
        gone = done.select(F.col("node").alias("s"))
        pairs, info = write_table(pairs.join(gone, "s", "left_anti").join(gone.withColumnRenamed("s", "d"), "d", "left_anti").select("s", "d"))
        pairs, rows = _trim(pairs, info["rows"])
    return _union(found)


def _components(pairs: DataFrame, rows: int) -> DataFrame:
    """(node, component) of every node of a component of two or more; single nodes may be listed as well."""
    stack: list[tuple] = []
    cycles = [pairs.select(F.col("s").alias("node"), F.col("s").alias("component")).filter("false")]
    pairs, rows = _trim(pairs, rows)
    idle = 0
    while rows and idle < 2:
        rest, left, jumps, ends, round_ = _bypass(pairs)
        cycles.append(round_)  # a cycle is one in both directions
        stack.append((pairs, jumps, ends))
        rest, left = _trim(rest, left)
        idle = idle + 1 if left >= rows - rows // 8 else 0
        # the next pass takes out nodes with one way in
        pairs, rows = _turned(rest), left
    found = _union([*cycles, _coloured(pairs, rows)] if rows else cycles)
    for before, jumps, ends in reversed(stack):
        found, _ = write_table(found)
        found = found.unionByName(_restored(before, jumps, ends, found)).distinct()
    return found


def strong_components(pairs: DataFrame) -> DataFrame:
    """(node, component) of every node of `pairs` (s, d); the component is its smallest node.

    Repeated pairs and loops count once and not at all; a pair with a null end is no edge.
    """
    edges, info = write_table(pairs.select("s", "d").filter("s <> d").distinct())
    found = _components(edges, info["rows"])
    found, _ = write_table(found.unionByName(found.select(F.col("component").alias("node"), "component")).distinct())
    # bypassed nodes may be smaller than the name their component had
    least = found.groupBy("component").agg(F.min(F.least("node", "component")).alias("least"))
    named = found.join(least, "component").select("node", "least").distinct()
    every = _nodes(pairs.select("s", "d")).filter("node IS NOT NULL")
    return every.join(named, "node", "left").select("node", F.coalesce("least", "node").alias("component"))


def _back(links: DataFrame, ring: DataFrame) -> DataFrame:
    """(goal, component) one link before the components of `ring`."""
    return links.join(ring.withColumnRenamed("component", "cd"), "cd").select("goal", F.col("cs").alias("component")).distinct()


class Reach:
    """Which components reach the component of each target.

    `members` (node, component), `sizes` (component, size), and `reach` (goal, component): each component with a way
    to the goal component, itself included. Any number of targets in one component share its rows.
    """

    def __init__(self, targets: DataFrame, pairs: DataFrame):
        pairs = pairs.select("s", "d").filter("s <> d")
        self.members, _ = write_table(strong_components(pairs))
        of = self.members
        self.sizes = of.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        asked = targets.select("target").filter("target IS NOT NULL").distinct()
        # a target without any edge is alone
        self.goals, _ = write_table(asked.join(of.withColumnRenamed("node", "target"), "target", "left").select(
            "target", F.coalesce("component", "target").alias("goal")))
        links, _ = write_table(
            pairs.join(of.select(F.col("node").alias("s"), F.col("component").alias("cs")), "s")
            .join(of.select(F.col("node").alias("d"), F.col("component").alias("cd")), "d")
            .filter("cs <> cd").select("cs", "cd").distinct())
        # components without a way in end every way back; they are most of a graph's, and are looked up once at the end
        entered = links.select(F.col("cd").alias("cs")).distinct()
        inner, _ = write_table(links.join(entered, "cs", "left_semi").select("cs", "cd"))
        ring, info = write_table(self.goals.select("goal", F.col("goal").alias("component")).distinct())
        rings = [ring]
        while info["rows"]:
            step, info = write_table(_back(inner, ring))
            if not info["rows"]:
                break
            # what a step meets again: the rings are read past the step, which is small in all but the first rounds
            known = _union(rings).join(step, ["goal", "component"], "left_semi")
            ring, info = write_table(step.join(known, ["goal", "component"], "left_anti"))
            rings.append(ring)
            if len(rings) % _MERGED == 0:  # short rings share one table, so a round reads few
                rings[1 - _MERGED:] = [write_table(_union(rings[1 - _MERGED:]).coalesce(_MERGED))[0]]
        ends, _ = write_table(_back(links.join(entered, "cs", "left_anti"), _union(rings)))
        self.reach = _union([*rings, ends])

    def counts(self) -> DataFrame:
        """(target, n_sources): how many other nodes reach each target, from component sizes alone."""
        per = self.reach.join(self.sizes, "component", "left").groupBy("goal").agg(F.sum(F.coalesce("size", F.lit(1))).alias("size"))
        return self.goals.join(per, "goal").select("target", (F.col("size") - 1).alias("n_sources"))

    def from_node(self, node: str) -> DataFrame:
        """(target): the targets that `node` reaches, itself left out."""
        start = self.members.filter(F.col("node") == node).select("component")
        return self.goals.join(self.reach.join(start, "component", "left_semi").select("goal"), "goal", "left_semi").filter(
            F.col("target") != node).select("target")

    def pairs(self) -> DataFrame:
        """(target, source): all of them, each once."""
        wide = self.goals.join(self.reach, "goal").join(self.members, "component")
        return wide.filter("node <> target").select("target", F.col("node").alias("source"))
