"""Graph traversals as frontier joins: reachability, depth, neighbours, paths, impact."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.schemas import FLOW_TYPES, IMPACT_TYPES
from strandline.storage import materialize as _materialize

#: A hop's level may be small beside the edges; a hint on these would exchange them at every hop.
materialize = partial(_materialize, exchange=False)


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst) pairs to walk along: down as they are, up reversed, both undirected."""
    down = edges.select("src", "dst")
    up = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction == "both":
        return down.unionByName(up).distinct()
    if direction not in ("up", "down"):
        raise ValueError(f"no such direction: {direction}")
    return (down if direction == "down" else up).distinct()


#: Hops of a walk that ends by itself, when a level is empty.
UNTIL_EMPTY = 1 << 30


def frontier(edges: DataFrame, seeds: DataFrame, max_hops: int, direction: str = "down") -> DataFrame:
    """Breadth-first levels: seeds' columns and hop, one row for each node at its first level.

    seeds has `id`, and any other columns name independent walks that share the
    joins. Each hop joins the last level alone with the edges, drops what any
    level has, and is written out, so the plan of hop n does not hold hop n - 1.
    Stops when a level is empty.
    """
    walk = materialize(directed(edges, direction), "walk-edges")
    keys = seeds.columns
    others = [c for c in keys if c != "id"]
    level = materialize(seeds.distinct().withColumn("hop", F.lit(0)), "level")
    seen = level
    for hop in range(1, max_hops + 1):
        step = (
            level.join(walk, F.col("id") == F.col("src"))
            .select(*others, F.col("dst").alias("id"))
            .distinct()
            .join(seen.select(*keys), keys, "left_anti")
        )
        level = materialize(step.select(*keys).withColumn("hop", F.lit(hop)), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def nearest_sources(edges: DataFrame, seeds: DataFrame, max_hops: int, direction: str = "up", keep: int = 2) -> DataFrame:
    """(source, id, hop): the nearest sources of each node, at most `keep` of them, ties to the smaller source.

    seeds: id, its own source at hop 0. A source among a node's nearest is among its
    predecessor's, so levels need no more than that: rows never exceed keep times the
    nodes, however many seeds there are.
    """
    walk = materialize(directed(edges, direction), "walk-edges")
    level = materialize(seeds.select("id").distinct().select(F.col("id").alias("source"), "id", F.lit(0).alias("hop")), "level")
    seen = level
    for hop in range(1, max_hops + 1):
        step = level.join(walk, F.col("id") == F.col("src")).select("source", F.col("dst").alias("id")).distinct().join(seen.select("source", "id"), ["source", "id"], "left_anti")
        held = seen.groupBy("id").agg(F.count("*").alias("held"))
        ranked = step.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("source"))).filter(F.col("r") <= keep)
        level = materialize(ranked.join(held, "id", "left").filter(F.col("r") + F.coalesce("held", F.lit(0)) <= keep).select("source", "id", F.lit(hop).alias("hop")), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def flow_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) over imports and calls."""
    return edges.filter(F.col("type").isin(*FLOW_TYPES)).select("src", "dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out): distinct neighbours on either side, zero for lone nodes."""
    flow = edges.select("src", "dst").distinct()
    ends = flow.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        flow.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    counted = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    zero = F.lit(0).cast("long")
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("n_in", zero).alias("n_in"), F.coalesce("n_out", zero).alias("n_out"))


def flow_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of live flow nodes that are entries, or have successors and no predecessor.

    nodes: id, t and optionally st.
    """
    live = F.coalesce(F.col("st"), F.lit("ok")) != "dead" if "st" in nodes.columns else F.lit(True)
    kind = nodes.filter(live & F.col("t").isin("file", "entry", "adr", "mod"))
    d = degrees(kind, edges)
    return kind.select("id", "t").join(d, "id").filter((F.col("t") == "entry") | ((F.col("n_in") == 0) & (F.col("n_out") > 0))).select("id")


def flow_depth(nodes: DataFrame, edges: DataFrame, max_hops: int = 64) -> DataFrame:
    """(id, depth): hops from the nearest root, null where no root leads."""
    levels = frontier(edges, flow_roots(nodes, edges), max_hops)
    return nodes.select("id").join(levels.select("id", F.col("hop").alias("depth")), "id", "left")


def reachable(edges: DataFrame, seeds: DataFrame, direction: str, max_hops: int = 64) -> DataFrame:
    """(…, id, hop) of what seeds reach, themselves excluded. No size limit: display code has one."""
    return frontier(edges, seeds, max_hops, direction).filter("hop > 0")


def neighbors(edges: DataFrame, seeds: DataFrame, depth: int = 1, direction: str = "both", types: tuple[str, ...] | None = None) -> DataFrame:
    """(id, hop, via, type, dir): each neighbour once, at its first level, outgoing edges before incoming.

    edges: src, dst, type. Among equal levels and directions the smallest (via, type) stands.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth is 1 to 3")
    own = edges if types is None else edges.filter(F.col("type").isin(*types))
    sides = []
    if direction in ("out", "both"):
        sides.append(own.select(F.col("src").alias("via"), F.col("dst").alias("id"), "type", F.lit("out").alias("dir"), F.lit(0).alias("ord")))
    if direction in ("in", "both"):
        sides.append(own.select(F.col("dst").alias("via"), F.col("src").alias("id"), "type", F.lit("in").alias("dir"), F.lit(1).alias("ord")))
    steps = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    steps = materialize(steps, "neighbor-steps")
    level = seeds.select("id").distinct()
    seen, found = level, None
    for hop in range(1, depth + 1):
        first = F.min(F.struct("ord", "via", "type", "dir")).alias("m")
        step = steps.join(level.select(F.col("id").alias("via")), "via").groupBy("id").agg(first).join(seen, "id", "left_anti")
        part = materialize(step.select("id", F.lit(hop).alias("hop"), "m.via", "m.type", "m.dir"), "neighbor-level")
        found = part if found is None else found.unionByName(part)
        level = part.select("id")
        seen = seen.unionByName(level)
    return found


def shortest_path(edges: DataFrame, start, goal, max_edges: int = 12) -> DataFrame:
    """(step, id) of a shortest undirected path of at most max_edges, ties by the smallest id sequence.

    Two half-length searches give distances from both ends; only nodes on some
    shortest path are then walked with their path so far. Equal ends: one step.
    No path: no rows.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    one = lambda x: spark.range(1).select(F.lit(x).cast(kind).alias("id"))
    half = (max_edges + 1) // 2
    a = frontier(edges, one(start), half, "both").withColumnRenamed("hop", "da")
    b = frontier(edges, one(goal), max_edges - half, "both").withColumnRenamed("hop", "db")
    length = a.join(b, "id").agg(F.min(F.col("da") + F.col("db"))).first()[0]
    if length is None:
        return one(start).limit(0).select(F.lit(0).alias("step"), "id")
    walk = materialize(directed(edges, "both"), "path-edges")
    paths = one(start).select("id", F.array("id").alias("path"))
    for step in range(1, length + 1):
        grown = paths.join(walk, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "path").filter(~F.array_contains("path", F.col("id")))
        left = length - step
        if left <= max_edges - half:  # beyond the meeting point, the distance to the goal is known
            grown = grown.join(b.filter(F.col("db") == left).select("id"), "id")
        else:
            grown = grown.join(a.filter(F.col("da") == step).select("id"), "id")
        paths = materialize(grown.groupBy("id").agg(F.min(F.concat("path", F.array("id"))).alias("path")), "paths")
    return paths.select(F.posexplode("path").alias("step", "id"))


def longest_up_path(edges: DataFrame, target, entries: DataFrame, max_nodes: int = 12) -> DataFrame:
    """(score, path): the best chain of callers that ends at the target, path from its top.

    A chain scores its number of nodes, and 1000 more if it starts at an entry; ties
    go to the smallest path. Chains are simple and of at most max_nodes nodes. Sets of
    nodes from which walks of each length lead to the target are joined level by level;
    one path at a time then grows within them, smallest node first, so no table of paths
    is made. Where walks of a length exist and simple paths do not, the search tries
    every walk.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    up = materialize(edges.select("src", "dst").filter("src != dst").distinct(), "chain-edges")
    tops = materialize(entries.select("id").distinct(), "chain-entries")
    levels = [materialize(spark.range(1).select(F.lit(target).cast(kind).alias("id")), "chain-level")]
    for _ in range(max_nodes - 1):
        last = levels[-1].select(F.col("id").alias("dst"))
        levels.append(materialize(up.join(last, "dst", "left_semi").filter(F.col("src") != F.lit(target)).select(F.col("src").alias("id")).distinct(), "chain-level"))

    def ascending(ids):
        """Ids in order, fetched one at a time: no list of a node's neighbours is collected."""
        last = None
        while (last := (ids if last is None else ids.filter(F.col("id") > F.lit(last))).agg(F.min("id")).first()[0]) is not None:
            yield last

    def starts(left, rooted):
        return ascending(levels[left].join(tops, "id", "left_semi") if rooted else levels[left])

    def steps(x, left):
        return ascending(up.filter(F.col("src") == F.lit(x)).select(F.col("dst").alias("id")).join(levels[left - 1], "id", "left_semi"))

    def grow(path, left):
        if left == 0:
            return path
        for d in steps(path[-1], left):
            if d not in path and (found := grow([*path, d], left - 1)):
                return found
        return None

    for bonus in (1000, 0):
        for n in range(max_nodes, 0, -1):
            for first in starts(n - 1, bonus > 0):
                if best := grow([first], n - 1):
                    return spark.range(1).select(F.lit(bonus + n).alias("score"), F.array(*[F.lit(x).cast(kind) for x in best]).alias("path"))
    raise ValueError("max_nodes is at least 1")


def confidence_rank(column: str | Column) -> Column:
    """exact 2, anything else 1."""
    return F.when(F.col(column) == "exact" if isinstance(column, str) else column == "exact", 2).otherwise(1)


def adjacency_order(edges: DataFrame) -> DataFrame:
    """(node, id, place, type, confidence): the neighbours that point at each node, the surer first, then by type and id."""
    order = Window.partitionBy("dst").orderBy(F.desc(confidence_rank("confidence")), "type", "src")
    return edges.select(F.col("dst").alias("node"), F.col("src").alias("id"), F.row_number().over(order).alias("place"), "type", "confidence")


def impact(edges: DataFrame, seeds: DataFrame, direction: str = "up", depth: int = 32) -> DataFrame:
    """(…, id, hop, confidence): what a change of the seeds can touch.

    edges: src, dst, type, confidence. A path is as strong as its weakest edge and
    a node as its strongest path: exact if an all-exact path of at most depth
    hops leads to it, else heuristic. Hop 1 is direct, the rest transitive.
    """
    own = edges.filter(F.col("type").isin(*IMPACT_TYPES))
    keys = seeds.columns
    hops = reachable(own, seeds, direction, depth)
    exact = reachable(own.filter("confidence = 'exact'"), seeds, direction, depth).select(*keys, F.lit(True).alias("sure"))
    return hops.join(exact, keys, "left").select(*keys, "hop", F.when(F.col("sure"), "exact").otherwise("heuristic").alias("confidence"))


def impacted_tests(edges: DataFrame, affected: DataFrame) -> DataFrame:
    """(path, confidence): tests that point at an affected module id, the strongest edge of each.

    edges: src, dst, type, confidence; affected: id.
    """
    tests = edges.filter("type = 'tests'").join(affected.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    best = tests.groupBy(F.col("src").alias("path")).agg(F.max(confidence_rank("confidence")).alias("r"))
    return best.select("path", F.when(F.col("r") == 2, "exact").otherwise("heuristic").alias("confidence"))


def cross_check(importers: DataFrame, covered: DataFrame, target: str) -> DataFrame:
    """Paths that import the target by the file graph and that the impact result does not cover.

    importers, covered: path. The target itself never counts.
    """
    return importers.select("path").distinct().filter(F.col("path") != target).join(covered.select("path").distinct(), "path", "left_anti")


def importers_by_hop(edges: DataFrame, seeds: DataFrame, depth: int = 32) -> DataFrame:
    """File-only impact: importers level by level."""
    return reachable(edges.filter("type = 'imports'"), seeds, "up", depth)


def two_tier_impact(edges: DataFrame, seeds: DataFrame, depth: int = 32) -> DataFrame:
    """Impact over files and symbols: a symbol's change reaches its file (part-of), and that file's importers.

    edges: src, dst, type of the folded graph.
    """
    up = edges.filter(F.col("type").isin("imports", "calls", "implements")).select("src", "dst")
    lift = edges.filter("type = 'part-of'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(up.unionByName(lift), seeds, "up", depth)


def mutual_reach_layers(edges: DataFrame, nodes: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, layer): longest-path layers; nodes left on or behind cycles share the last layer.

    Layer by layer, nodes whose predecessors all have a layer are placed (Kahn's order),
    until none is free; rounds ends that sooner. The number of joins is that of layers.
    """
    left = materialize(nodes.select("id").distinct(), "layer-nodes")
    own = materialize(edges.filter("src != dst").select("src", "dst").distinct(), "layer-edges")
    out, layer = None, 0
    while rounds is None or layer < rounds:
        held = own.select(F.col("dst").alias("id")).distinct()
        free = materialize(left.join(held, "id", "left_anti").withColumn("layer", F.lit(layer)), "layer")
        if free.isEmpty():
            break
        out = free if out is None else out.unionByName(free)
        left = materialize(left.join(free, "id", "left_anti"), "layer-nodes")
        own = materialize(own.join(free.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst"), "layer-edges")
        layer += 1
    rest = left.withColumn("layer", F.lit(layer))
    return rest if out is None else out.unionByName(rest)


def first_parents(edges: DataFrame) -> DataFrame:
    """(id, parent): the first contains edge of each node, by its place `seq`."""
    own = Window.partitionBy("dst").orderBy("seq", "src")
    return edges.filter("type = 'contains'").withColumn("r", F.row_number().over(own)).filter("r = 1").select(F.col("dst").alias("id"), F.col("src").alias("parent"))
