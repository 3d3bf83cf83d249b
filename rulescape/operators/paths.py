"""Simple paths and reachability over the permitted-flow graph.

Paths have at most `MAX_HOPS` edges, repeat no node, and pass only through concrete
nodes; ends may be abstract. Every such path is returned, none is capped. A frontier
grows one hop per round and keeps only nodes from which a goal is still near enough.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import score
from ..functions.service import grant_answers
from .condense import Reach
from .graph import passing
from .joins import lookup
from .scratch import cut, write_table

MAX_HOPS = 8


def hop() -> Column:
    """What a path tells of an edge, from the edge table's columns."""
    rep = {"tool": "source_tool", "service": "service", "ref": "raw_ref", "l7_app": "l7_app", "l7_source": "l7_source"}
    return F.struct(
        F.col("s").alias("src"), F.col("d").alias("dst"), F.col("s_display").alias("src_display"),
        F.col("d_display").alias("dst_display"), *[F.col(f"rep.{c}").alias(n) for n, c in rep.items()],
        "tools", "services", "apps").alias("hop")


def bare_edges(edges: DataFrame) -> DataFrame:
    """(s, d, s_concrete, d_concrete): what a traversal needs of an edge; `edges` are edges or `graph.pairs`."""
    return edges.select("s", "d", (F.col("s_kind") == "concrete").alias("s_concrete"), (F.col("d_kind") == "concrete").alias("d_concrete"))


def hop_edges(edges: DataFrame) -> DataFrame:
    """(s, d, s_concrete, d_concrete, hop): what a traversal needs of an edge, and what it tells at the end."""
    return edges.select("s", "d", (F.col("s_kind") == "concrete").alias("s_concrete"),
                        (F.col("d_kind") == "concrete").alias("d_concrete"), hop())


def with_hops(found: DataFrame, hops: DataFrame) -> DataFrame:
    """`found` (goal, start, path; each once) with `hops`, the facts of its edges in order.

    A search moves names only; the facts are looked up once per edge of a finished path. A path has
    at most `MAX_HOPS` of them, so a row stays bounded.
    """
    kind = hops.schema["hop"].dataType.simpleString()
    steps = found.filter(F.size("path") > 1).select(
        "goal", "start", "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("i"))
    ends = steps.withColumns({"s": F.element_at("path", F.col("i")), "d": F.element_at("path", F.col("i") + 1)})
    told = ends.join(hops.select("s", "d", "hop"), ["s", "d"]).groupBy("goal", "start", "path").agg(
        F.array_sort(F.collect_list(F.struct("i", "hop"))).alias("steps"))
    return told.select("goal", "start", "path", F.transform("steps", lambda x: x["hop"]).alias("hops")).unionByName(
        found.filter(F.size("path") < 2).select("goal", "start", "path", F.array().cast(f"array<{kind}>").alias("hops")))


def usable(hops: DataFrame, starts: DataFrame) -> DataFrame:
    """Drop edges that leave an abstract node nobody starts from: no path can use them."""
    first = starts.select(F.col("node").alias("s")).distinct()
    return hops.filter("s_concrete").unionByName(hops.filter("NOT s_concrete").join(first, "s", "left_semi"))


def distances(hops: DataFrame, goals: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(goal, node, dist): hops still needed at least to reach a goal from a node.

    `goals` has goal (an id) and node; several nodes may share one id.
    """
    pairs = cut(hops.select("s", "d", "d_concrete"))
    ring = goals.select("goal", "node", F.lit(0).alias("dist"))
    rings, seen = [], None
    for k in range(max_hops + 1):
        ring, info = write_table(ring)
        if not info["rows"]:
            break
        rings.append(ring)
        seen = reduce(DataFrame.unionByName, [r.select("goal", "node") for r in rings])
        through = pairs if k == 0 else pairs.filter("d_concrete")
        ring = (through.join(ring, F.col("d") == F.col("node")).select("goal", F.col("s").alias("node")).distinct()
                .join(seen, ["goal", "node"], "left_anti").withColumn("dist", F.lit(k + 1)))
    if not rings:
        return ring
    return reduce(DataFrame.unionByName, rings)


def simple_paths(hops: DataFrame, starts: DataFrame, goals: DataFrame, through_goals: bool,
                 max_hops: int = MAX_HOPS, prune: DataFrame | None = None) -> DataFrame:
    """(goal, start, path): every simple path from a start to a node of its goal; `with_hops` adds the facts of its edges.

    `starts` and `goals` have goal and node. With `through_goals` a path that reached a goal
    node also runs on to others; without it, a start that is its own goal yields the empty path.
    """
    edges = cut(usable(hops.select("s", "d", "s_concrete", "d_concrete"), starts))
    near = distances(edges, goals, max_hops) if prune is None else prune
    near = cut(near)
    front = starts.select("goal", F.col("node").alias("last")).join(
        near.withColumnRenamed("node", "last"), ["goal", "last"]).select(
        "goal", F.col("last").alias("start"), "last", F.lit(True).alias("d_concrete"), "dist",
        F.array("last").alias("path"))
    done = []
    go_on = F.lit(True) if through_goals else F.col("dist") > 0
    if not through_goals:
        done.append(front.filter("dist = 0"))
    front = front.filter(go_on)
    ahead = near.select("goal", F.col("node").alias("d"), "dist")
    for k in range(1, max_hops + 1):
        step = (front.drop("dist", "d_concrete").join(edges.drop("s_concrete"), F.col("last") == F.col("s"))
                .filter(~F.array_contains("path", F.col("d")))
                .join(ahead, ["goal", "d"]).filter(F.col("dist") + k <= max_hops)
                .select("goal", "start", F.col("d").alias("last"), "d_concrete", "dist",
                        F.array_append("path", F.col("d")).alias("path")))
        open_end = F.col("d_concrete") & go_on
        step, info = write_table(step, F.count_if(open_end).alias("open"))
        if not info["rows"]:
            break
        done.append(step.filter("dist = 0"))
        if not info["open"]:
            break
        front = step.filter(open_end)
    if not done:
        done = [front.filter(F.lit(False))]
    return reduce(DataFrame.unionByName, done).select("goal", "start", "path")


def path_tools(hops: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hops, lambda h: h["tools"]))))


def describe(paths: DataFrame, node_table: DataFrame) -> DataFrame:
    """Entry, terminal, tools, displays and boundary facts of each path."""
    spread = F.element_at("path", -1)
    paths = paths.withColumns({"entry": F.element_at("path", 1), "terminal": F.element_at("path", -1),
                               "length": F.size("hops")})
    paths = lookup(paths, F.col("entry"), node_table, "node",
                   {"entry_zone": "zone", "entry_display": "display"}, spread)
    paths = lookup(paths, F.col("terminal"), node_table, "node",
                   {"terminal_zone": "zone", "terminal_node_tags": "tags"}, spread)
    zones = "coalesce(entry_zone, 'internal')", "coalesce(terminal_zone, 'internal')"
    last = F.try_element_at("hops", F.lit(-1))
    return paths.withColumns({
        "display_path": F.concat(F.array(F.coalesce("entry_display", "entry")),
                                 F.transform("hops", lambda h: h["dst_display"])),
        "hops_tools": F.transform("hops", lambda h: h["tool"]), "tools": path_tools(F.col("hops")),
        "terminal_tags": F.array_sort(F.coalesce("terminal_node_tags", L.empty_strings())),
        "terminal_service": last["service"], "terminal_apps": F.coalesce(last["apps"], L.empty_strings()),
        "boundary": score.boundary(*zones), "boundary_crossed": score.crosses(*zones),
        "boundary_multiplier": score.boundary_factor(*zones),
    }).drop("entry_zone", "entry_display", "terminal_zone", "terminal_node_tags")


def internet_paths(edges: DataFrame, node_table: DataFrame, source: str = L.INTERNET,
                   max_hops: int = MAX_HOPS) -> DataFrame:
    """All simple paths from `source` to sensitive nodes, not yet described."""
    all_goals = F.lit("*").alias("goal")
    goals = node_table.filter(L.is_sensitive("tags") & (F.col("node") != source)).select(all_goals, "node")
    starts = node_table.filter(F.col("node") == source).select(all_goals, "node")
    hops = hop_edges(passing(edges, source))
    return with_hops(simple_paths(hops, starts, goals, through_goals=True, max_hops=max_hops), hops)


def cross_tool(paths: DataFrame) -> DataFrame:
    return paths.filter(F.size(path_tools(F.col("hops"))) >= 2)


def cross_tool_paths(edges: DataFrame, node_table: DataFrame) -> DataFrame:
    """Paths from the internet to sensitive nodes that no single tool shows."""
    return describe(cross_tool(internet_paths(edges, node_table)), node_table)


def _asked(queries: DataFrame, names: DataFrame) -> DataFrame:
    for side in ("src", "dst"):
        queries = lookup(queries, F.col(side), names, "name", {f"__{side}": "node"}, F.col("query_id"))
        queries = queries.withColumn(side, F.coalesce(f"__{side}", side)).drop(f"__{side}")
    return queries


def paths_between(queries: DataFrame, names: DataFrame, edges: DataFrame, grants: DataFrame | None = None,
                  max_hops: int = MAX_HOPS) -> DataFrame:
    """(query_id, src, dst, path) for a table of questions (query_id, src, dst).

    With `grants`, questions may carry port, protocol and app: the last hop must then hold a
    grant that answers them. Ends are asset names or aliases. Of `edges` only the pairs are asked for (`graph.pairs`).
    """
    asked = cut(_asked(queries, names))
    pair = asked.select("src", "dst").distinct()
    paths = simple_paths(
        bare_edges(edges), pair.select(F.col("dst").alias("goal"), F.col("src").alias("node")),
        pair.select(F.col("dst").alias("goal"), F.col("dst").alias("node")).distinct(), through_goals=False,
        max_hops=max_hops).withColumnsRenamed({"goal": "dst", "start": "src"})
    found = asked.join(paths, ["src", "dst"])
    if grants is not None:
        filtered = F.col("port").isNotNull() | F.col("protocol").isNotNull() | F.col("app").isNotNull()
        free = ~filtered | (F.size("path") < 2)
        strict = found.filter(~free).withColumns({"ls": F.element_at("path", -2), "ld": F.element_at("path", -1)})
        wanted = strict.select("query_id", "ls", "ld", "port", "protocol", "app").distinct()
        g = grants.select(F.col("s").alias("ls"), F.col("d").alias("ld"), F.col("protocol").alias("gp"),
                          F.col("port").alias("gs"), F.col("port_end").alias("ge"), F.col("l7_app").alias("ga"))
        answered = wanted.join(g, ["ls", "ld"]).filter(grant_answers(
            "protocol", "port", "app", "gp", "gs", "ge", "ga")).select(
            "query_id", "ls", "ld").distinct()
        found = found.filter(free).unionByName(
            strict.join(answered, ["query_id", "ls", "ld"], "left_semi").drop("ls", "ld"))
    return found


def reachable(queries: DataFrame, names: DataFrame, edges: DataFrame, grants: DataFrame) -> DataFrame:
    """One row per question: reachable or not, how many paths, and the shortest."""
    found = paths_between(queries, names, edges, grants)
    best = found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_paths"), F.min(F.struct(F.size("path").alias("length"), "path")).alias("best"))
    return _asked(queries, names).join(best, "query_id", "left").withColumns({
        "reachable": F.col("n_paths").isNotNull(), "n_paths": F.coalesce("n_paths", F.lit(0).cast("bigint")),
        "shortest": F.col("best.path")}).drop("best")


def who_can_reach(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, source): every node with a directed path of any length, through any node.

    Reach is found between strongly connected components and spelled out last; `condense.Reach` has it
    without the pairs.
    """
    return Reach(targets, edges).pairs()


def effective_policy(targets: DataFrame, names: DataFrame, edges: DataFrame, node_table: DataFrame) -> DataFrame:
    """One row per asked target: found, tags, number of sources, and whether the internet is one; no pair is listed."""
    asked = lookup(targets.withColumnRenamed("target", "asked"), F.col("asked"), names, "name", {"node": "node"},
                   F.col("asked")).withColumn("target", F.coalesce("node", "asked")).drop("node")
    known = node_table.select(F.col("node").alias("target"), F.array_sort("tags").alias("target_tags"))
    reach = Reach(asked.join(known, "target", "left_semi").select("target"), edges)
    counts = reach.counts().join(reach.from_node(L.INTERNET).withColumn("exposed", F.lit(True)), "target", "left")
    return asked.join(known, "target", "left").join(counts, "target", "left").select(
        "asked", "target", "target_tags", F.coalesce("n_sources", F.lit(0).cast("bigint")).alias("n_sources"),
        F.coalesce("exposed", F.lit(False)).alias("internet_exposed"))
