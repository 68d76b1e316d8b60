"""Node and edge tables: validation, ownership, reconciliation, counts and budgets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import tokens_ceiled
from strandline.schemas import CHECK_RANK, FILE_EDGE_TYPES, GIT_RANK, SCAN_OWNED
from strandline.storage import materialize


def rank_of(column, ranks: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, r in ranks.items():
        out = F.when(F.col(column) == name, r).otherwise(out)
    return out


def valid_edges(edges: DataFrame, types: tuple[str, ...] = FILE_EDGE_TYPES) -> DataFrame:
    """Edges of known types between two different nodes, one a (src, type, dst)."""
    return edges.filter(F.col("type").isin(*types) & (F.col("src") != F.col("dst"))).dropDuplicates(["src", "type", "dst"])


def replace_owned(old: DataFrame, new: DataFrame, types: tuple[str, ...] = SCAN_OWNED, sources: Column | None = None) -> DataFrame:
    """Edges of the owned types (and sources) give way to the new ones; the rest stay."""
    owned = F.col("type").isin(*types)
    if sources is not None:
        owned = owned & sources
    return old.filter(~owned).unionByName(new).dropDuplicates(["src", "type", "dst"])


def dedupe_confidence(edges: DataFrame) -> DataFrame:
    """One edge a (src, dst, type, label): the first writer's f by seq, exact if any writer is."""
    return edges.groupBy("src", "dst", "type", "label").agg(
        F.when(F.max(F.col("confidence") == "exact"), "exact").otherwise("heuristic").alias("confidence"), F.min_by("f", "seq").alias("f")
    )


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an endpoint that no node has, found in one pass over the edges."""
    ids = nodes.select("id").distinct()
    known = lambda side: ids.select(F.col("id").alias(side), F.lit(True).alias(f"has_{side}"))
    both = edges.join(known("src"), "src", "left").join(known("dst"), "dst", "left")
    return both.filter("has_src IS NULL OR has_dst IS NULL").select(*edges.columns).distinct()


def prune(nodes: DataFrame, edges: DataFrame, summary_max: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept nodes, kept edges, report by reason): dead nodes and orphan edges go, long summaries are reported."""
    live = nodes.filter(F.coalesce("st", F.lit("ok")) != "dead")
    gone = orphan_edges(edges, live)
    report = (
        nodes.filter("st = 'dead'").select(F.lit("dead").alias("reason"), "id")
        .unionByName(gone.select(F.lit("orphan-edge").alias("reason"), F.concat_ws("|", "src", "type", "dst").alias("id")))
        .unionByName(live.filter(F.length("s") > summary_max).select(F.lit("oversized").alias("reason"), "id"))
    )
    return live, edges.join(gone.select("src", "type", "dst"), ["src", "type", "dst"], "left_anti"), report


def assign_ids(nodes: DataFrame) -> DataFrame:
    """(t, k, id) with collisions resolved: the first key keeps 6 hex digits, others grow until they differ.

    Among nodes of one type and 6-digit prefix, keys in order take the shortest
    prefix of 6 to 20 digits that no earlier key of the group has.
    """
    from strandline.functions.text import file_id

    # a key's mates are those of its letter and six digits; the rest of 20 digits is a number, so the nearest mate is that of the smallest XOR
    rest = F.conv(F.substring(F.sha2(F.concat_ws(":", "t", "k").cast("string"), 256), 7, 14), 16, 10).cast("long")
    keyed = nodes.select("t", "k", file_id("t", "k").alias("id6"), rest.alias("rest")).repartition("id6").distinct()
    earlier = F.collect_list("rest").over(Window.partitionBy("id6").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    near = F.array_min(F.transform("earlier", lambda x: x.bitwiseXOR(F.col("rest"))))
    more = F.when(near.isNull() | (F.col("t") == "issue"), 0).when(near == 0, 14).otherwise(15 - F.length(F.hex(near)))
    digits = F.lpad(F.lower(F.hex("rest")), 14, "0")
    return keyed.withColumn("earlier", earlier).select("t", "k", F.concat("id6", F.substr(digits, F.lit(1), more)).alias("id"))


def worst_state(states: DataFrame, ranks: dict[str, int] = GIT_RANK, key: str = "path") -> DataFrame:
    """(key, state): the worst state of each key."""
    return states.groupBy(key).agg(F.max_by("state", rank_of("state", ranks)).alias("state"))


def worst_check(findings: DataFrame) -> DataFrame:
    """(path, state, n): the worst check state of each path and the number of its findings."""
    return findings.groupBy("path").agg(F.max_by("state", F.struct(rank_of("state", CHECK_RANK), "state")).alias("state"), F.count("*").alias("n"))


def state_counters(states: DataFrame, tracked: int) -> DataFrame:
    """(state, n), pushed being the tracked files that no other state but untracked lists."""
    counted = states.groupBy("state").agg(F.count("*").alias("n"))
    listed = states.filter("state != 'untracked'").agg(F.greatest(F.lit(0).cast("long"), F.lit(tracked) - F.count("*")).alias("n")).select(F.lit("pushed").alias("state"), "n")
    return counted.filter("state != 'pushed'").unionByName(listed)


def reconcile(old: DataFrame, now: DataFrame) -> DataFrame:
    """(id, st, h): two-phase death, staleness of agents' summaries, and pinned hashes.

    old: id, h, st, by; now: id, h. A node that vanished is dead, one that was
    dead already is deleted. A changed node is stale and keeps its hash if an
    agent wrote it, else it takes the new hash.
    """
    o = old.select("id", F.col("h").alias("old_h"), "st", "by")
    n = now.select("id", F.col("h").alias("new_h"))
    both = o.join(n, "id", "full")
    agent = (F.col("by") == "agent") & (F.col("old_h") != F.col("new_h"))
    st = F.when(F.col("new_h").isNull(), "dead").when(F.col("old_h").isNull(), "ok").when(agent, "stale").otherwise(
        F.when(F.col("st").isin("dead"), "ok").otherwise(F.coalesce("st", F.lit("ok")))
    )
    h = F.when(F.col("new_h").isNull() | agent, F.col("old_h")).otherwise(F.col("new_h"))
    return both.filter(~(F.col("new_h").isNull() & (F.coalesce("st", F.lit("ok")) == "dead"))).select("id", st.alias("st"), h.alias("h"))


def verify(nodes: DataFrame, current: DataFrame) -> DataFrame:
    """(id, st): dead where the file is gone, stale where its hash differs, else ok."""
    now = current.select("k", F.col("h").alias("now_h"))
    return nodes.select("id", "k", "h").join(now, "k", "left").select(
        "id", F.when(F.col("now_h").isNull(), "dead").when(F.col("now_h") != F.col("h"), "stale").otherwise("ok").alias("st")
    )


def fan_in_weights(deg: DataFrame) -> DataFrame:
    """(id, w): min(5, 1 + floor(5 * cume_dist)) over nodes with a predecessor, else 1.

    deg: id, n_in. The rank is taken over the histogram of degrees, so the
    unpartitioned window sees a row a degree, not a row a node.
    """
    some = deg.filter("n_in > 0")
    hist = some.groupBy("n_in").agg(F.count("*").alias("n"))
    share = F.sum("n").over(Window.orderBy("n_in").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy())
    weights = hist.select("n_in", F.least(F.lit(5), 1 + F.floor(share * 5)).cast("int").alias("w"))
    return deg.join(weights, "n_in", "left").select("id", F.coalesce("w", F.lit(1)).alias("w"))


def prefix_budget(rows: DataFrame, order: list[Column], cost: str, ceiling: float, group: list[str] | None = None) -> DataFrame:
    """Ranked rows while their running cost is within the ceiling (it ends at the first overflow).

    Without a group, one ordered pass over the table is needed; callers cut to the
    rows that can fit first.
    """
    w = Window.partitionBy(*(group or [])).orderBy(*order)
    return rows.withColumn("spent", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("spent") <= ceiling)


def greedy_budget(rows: DataFrame, group: str, order: list[str], cost: str, ceiling: int) -> DataFrame:
    """(group, order, cost): ranked rows of each group that still fit when they come up; a row too large is skipped, not the end.

    What fits depends on all that came before, so a group is one sorted stream; it
    is read batch by batch and only its running sum is held. Rows that can never
    fit do not move. Null costs never fit.
    """
    names = list(dict.fromkeys([group, *order, cost]))
    narrow = rows.select(*names).filter(F.col(cost) <= ceiling)

    def run(batches):
        now, spent = object(), 0
        for batch in batches:
            keep = []
            for g, c in zip(batch.column(0).to_pylist(), batch.column(names.index(cost)).to_pylist()):
                if g != now:
                    now, spent = g, 0
                fits = spent + c <= ceiling
                spent += c if fits else 0
                keep.append(fits)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return narrow.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, narrow.schema)


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def unique_only(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key no other row has: an ambiguous link links nowhere."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(key))).filter("_n = 1").drop("_n")


def count_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, n), ? for null keys, in order of key."""
    return rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("?")).alias(key)).agg(F.count("*").alias("n")).orderBy(key)


def symbol_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(lang, files, nodes, edges, exact, heuristic, rough): edges count at the language of their origin file f."""
    n = nodes.groupBy("lang").agg(F.countDistinct("path").alias("files"), F.count("*").alias("nodes"), F.count_if(F.col("confidence") == "rough").alias("rough"))
    origin = nodes.select(F.col("path").alias("f"), "lang").distinct()
    e = edges.join(origin, "f").groupBy("lang").agg(
        F.count("*").alias("edges"), F.count_if(F.col("confidence") == "exact").alias("exact"), F.count_if(F.col("confidence") == "heuristic").alias("heuristic")
    )
    zero = F.lit(0).cast("long")
    return n.join(e, "lang", "left").select("lang", "files", "nodes", *[F.coalesce(c, zero).alias(c) for c in ("edges", "exact", "heuristic")], "rough")


def overview(nodes: DataFrame, edges: DataFrame, top: int = 6) -> DataFrame:
    """(section, key, n): node and edge counts by type, states, top modules by files and entries by fan-out."""
    member = edges.filter("type = 'part-of'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    fan = edges.filter("type = 'imports'").groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n"))
    named = lambda d, kind: d.join(nodes.filter(F.col("t") == kind).select("id", "k"), "id").orderBy(F.desc("n"), "k").limit(top)
    parts = [
        nodes.groupBy(F.lit("node").alias("section"), F.col("t").alias("key")).agg(F.count("*").alias("n")),
        edges.groupBy(F.lit("edge").alias("section"), F.col("type").alias("key")).agg(F.count("*").alias("n")),
        nodes.filter(F.col("st").isin("stale", "dead")).groupBy(F.lit("state").alias("section"), F.col("st").alias("key")).agg(F.count("*").alias("n")),
        named(member, "mod").select(F.lit("module").alias("section"), F.col("k").alias("key"), "n"),
        named(fan, "entry").select(F.lit("entry").alias("section"), F.col("k").alias("key"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def token_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """(layer, bytes, tokens) of tables as JSON lines."""
    out = None
    for name, df in layers.items():
        size = F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1)
        row = df.agg(F.coalesce(size, F.lit(0)).alias("bytes")).select(F.lit(name).alias("layer"), "bytes", tokens_ceiled("bytes").alias("tokens"))
        out = row if out is None else out.unionByName(row)
    return out


def enrich_next(nodes: DataFrame, deg: DataFrame, k: int = 8) -> DataFrame:
    """The k most depended-on files whose summary no agent wrote, barrels left out."""
    barrel = F.col("k").rlike(r"(^|/)index\.[a-z]+$")
    todo = nodes.filter(F.col("t").isin("file", "entry") & (F.coalesce("by", F.lit("scan")) != "agent") & ~barrel)
    return todo.join(deg, "id").filter("n_in > 0").orderBy(F.desc("n_in"), "id").limit(k).select("id", "k", "n_in")


def top_fan_in(edges: DataFrame, k: int = 8) -> DataFrame:
    """(id, n_in) of the k nodes that most distinct sources point at, ties by id."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n_in")).orderBy(F.desc("n_in"), "id").limit(k)


def infer_modules(files: DataFrame, max_depth: int = 64) -> DataFrame:
    """(dir, direct, nested, child_modules) of directories that are modules, decided from the deepest up.

    files: path. A directory is a module if it holds 2 files or more at any depth,
    and 1 directly or 2 child modules, which are its own subdirectories alone. So
    modules are settled depth by depth; the loop is as long as the deepest path.
    """
    from strandline.functions.paths import ancestors, dirname, has_parent

    counts = materialize(
        files.filter(has_parent("path")).select(F.explode(ancestors("path")).alias("dir"), dirname("path").alias("own"))
        .groupBy("dir").agg(F.count_if(F.col("dir") == F.col("own")).alias("direct"), F.count("*").alias("nested"))
        .withColumn("depth", F.size(F.split("dir", "/"))),
        "dir-counts",
    )
    deepest = counts.agg(F.max("depth")).first()[0] or 0
    if deepest > max_depth:
        raise ValueError(f"paths are {deepest} directories deep")
    below = counts.limit(0).select(F.col("dir"), F.lit(0).cast("long").alias("tops"))
    found = None
    for depth in range(deepest, 0, -1):
        level = counts.filter(F.col("depth") == depth).join(below, "dir", "left").withColumn("child_modules", F.coalesce("tops", F.lit(0).cast("long")))
        is_module = (F.col("nested") >= 2) & ((F.col("direct") >= 1) | (F.col("child_modules") >= 2))
        level = materialize(level.select("dir", "direct", "nested", "child_modules", is_module.alias("is_module")), "dir-level")
        part = level.filter("is_module").drop("is_module")
        found = part if found is None else found.unionByName(part)
        below = part.groupBy(dirname("dir").alias("dir")).agg(F.count("*").alias("tops")).filter("dir != ''")
    return found if found is not None else counts.select("dir", "direct", "nested", F.lit(0).cast("long").alias("child_modules")).limit(0)


def nearest_module(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, module): the deepest ancestor directory that is a module, null if none is.

    paths: path; modules: dir. Prefixes are exploded and equi-joined: a longest-prefix join.
    """
    from strandline.functions.paths import ancestors

    own = paths.select("path", F.explode_outer(F.when(F.contains("path", F.lit("/")), ancestors("path"))).alias("dir"))
    return own.join(modules.select("dir", F.col("dir").alias("module")), "dir", "left").groupBy("path").agg(F.max_by("module", F.length("module")).alias("module"))


def collapse_pass_through(modules: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, parent): modules left after those with no file and exactly one child module went.

    modules: id, parent, n_files. Children of a removed module move to its nearest
    ancestor that stays (the documented intent), round by round until none is left.
    """
    now = materialize(modules.select("id", "parent", "n_files"), "modules")
    for _ in range(max_rounds):
        kids = now.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
        thin = materialize(now.join(kids, "id").filter("n_files = 0 AND kids = 1").select("id", F.col("parent").alias("up")), "thin")
        # of a chain of thin modules, the lowest ones go first: parents that are thin themselves wait a round
        ready = materialize(thin.join(thin.select(F.col("up").alias("id")).filter("id IS NOT NULL").distinct(), "id", "left_anti"), "thin-ready")
        if ready.isEmpty():
            break
        moved = now.join(ready.select("id"), "id", "left_anti").join(ready.select(F.col("id").alias("parent"), F.lit(True).alias("hit"), "up"), "parent", "left")
        now = materialize(moved.select("id", F.when(F.col("hit"), F.col("up")).otherwise(F.col("parent")).alias("parent"), "n_files"), "modules")
    return now
