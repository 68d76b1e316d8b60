"""Embedding near-duplicates by cross-polytope hashing, and exact top-k inner products by MaxScore."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import materialize
from strandline.llm.components import Forest, components

COSINE = 0.93
#: Rotations that make one bucket key -> tables, and probes of a vector in each. At cosine
#: 0.93 and 64 dimensions a random pair shares no bucket with probability under 0.001 with
#: two rotations and under 0.01 with three, which cut buckets to a hundredth. The number of
#: rotations is the caller's choice; it never follows from the input.
SETTINGS = {2: (8, 2), 3: (12, 4)}
ROTATIONS = 2
#: Entries of one bucket beyond which it is dealt to several tasks in blocks.
HOT_BUCKET = 8192


def usable(vec: str = "embedding"):
    """True for vectors that are not null, not empty and hold finite components only."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & ~bad


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0), dtype)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def cross_polytope_codes(x: np.ndarray, tables: int, probes: int, rotations: int, seed: int = 7) -> np.ndarray:
    """(rows, tables * probes) bucket codes, a table's best bucket first.

    A rotation is three rounds of random signs and a Hadamard transform; its hash
    is the signed axis of largest magnitude. The other probes of a table are the
    axis choices that give up least magnitude.
    """
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, width - d)))
    rng, m, out = np.random.RandomState(seed), min(probes, width), []
    for _ in range(tables):
        code, loss = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for _ in range(rotations):
            r = x
            for _ in range(3):
                r = hadamard(r * rng.choice([-1.0, 1.0], width))
            size = np.abs(r)
            axis = np.argsort(-size, axis=1, kind="stable")[:, :m]
            value = np.take_along_axis(r, axis, 1)
            signed = axis * 2 + (value < 0)
            lost = np.abs(value[:, :1]) - np.abs(value)
            code = (code[:, :, None] * (2 * width) + signed[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + lost[:, None, :]).reshape(n, -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            code, loss = np.take_along_axis(code, best, 1), np.take_along_axis(loss, best, 1)
        out.append(np.pad(code, ((0, 0), (0, probes - code.shape[1])), constant_values=-1))
    return np.concatenate(out, axis=1)


def _with_codes(rotations: int):
    tables, probes = SETTINGS[rotations]

    def run(batches):
        for batch in batches:
            x = batch.column(4)
            widths = np.diff(x.offsets.to_numpy())
            codes = np.zeros((batch.num_rows, tables * probes), np.int32)
            for w in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == w)
                wide = cross_polytope_codes(_matrix(x.take(pa.array(rows))), tables, probes, rotations)
                codes[rows] = np.where(wide < 0, -1, wide % 2147483647)  # codes that fall together are verified apart
            lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32), codes.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["k1", "k2", "rep", "n", "vec", "label", "codes"])

    return run


def _tally(i, j, at: dict[str, np.ndarray], links: np.ndarray, forest: Forest) -> None:
    """Count verified pairs of rows, each only in the first bucket that its vectors share.

    at: rep, n, codes (rows, tables, probes), table, code and side of each row. A side
    of 2 pairs with all rows of its bucket; 0 and 1 are the blocks of a block pair.
    """
    side, codes = at["side"], at["codes"]
    keep = (side[i] != side[j]) | (side[i] == 2)
    i, j = i[keep], j[keep]
    for k in range(0, len(i), 50_000):  # bounded memory however dense the bucket
        a, b = i[k : k + 50_000], j[k : k + 50_000]
        table, code, earlier = at["table"][a], at["code"][a], np.zeros(len(a), bool)
        for t in range(int(table.max()) + 1):
            for p in range(codes.shape[2]):
                own = codes[a, t, p]
                shared = (codes[b, t] == own[:, None]).any(1) & (own >= 0)
                earlier |= shared & ((t < table) | ((t == table) & (own < code)))
        a, b = a[~earlier], b[~earlier]
        np.add.at(links, a, at["n"][b])
        np.add.at(links, b, at["n"][a])
        for u, v in zip(at["rep"][a].tolist(), at["rep"][b].tolist()):
            forest.union(u, v)


def _verify(threshold: float, rotations: int):
    tables, probes = SETTINGS[rotations]

    def flush(rows: pa.Table, forest, totals):
        """Whole buckets: small ones step by step over all of them at once, larger ones by blocks of products."""
        vec = rows["vec"].combine_chunks()
        widths = np.diff(vec.offsets.to_numpy())
        for w in np.unique(widths).tolist():
            pick = np.flatnonzero(widths == w)
            x = _matrix(vec.take(pa.array(pick)))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            at = {name: rows[c].to_numpy()[pick] for name, c in (("rep", "rep"), ("n", "n"), ("table", "tbl"), ("code", "code"), ("side", "side"))}
            at["codes"] = _matrix(rows["codes"].combine_chunks().take(pa.array(pick)), np.int32).reshape(len(pick), tables, probes)
            bucket = [rows[c].to_numpy()[pick] for c in ("label", "tbl", "code", "part")]
            edge = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in bucket], axis=0), True])
            size = np.diff(edge)
            end, links = np.repeat(edge[1:], size), np.zeros(len(pick), np.int64)
            here, step = np.flatnonzero(np.repeat(size <= 64, size) & (np.arange(len(pick)) + 1 < end)), 1
            while len(here):
                near = here[np.einsum("ij,ij->i", x[here], x[here + step]) >= threshold]
                if len(near):
                    _tally(near, near + step, at, links, forest)
                step += 1
                here = here[here + step < end[here]]
            for a, n in zip(edge[:-1][size > 64].tolist(), size[size > 64].tolist()):
                for lo in range(a, a + n, 2048):
                    i, j = np.nonzero(x[lo : min(a + n, lo + 2048)] @ x[lo : a + n].T >= threshold)
                    upper = i < j
                    _tally(i[upper] + lo, j[upper] + lo, at, links, forest)
            for r, k in zip(at["rep"][links > 0].tolist(), links[links > 0].tolist()):
                totals[r] = totals.get(r, 0) + k

    def run(batches):
        forest, totals, held = Forest(), {}, []
        key = lambda t, i: tuple(t[c][i].as_py() for c in ("label", "tbl", "code", "part"))
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held.append(t)
            if key(held[0], 0) == key(t, -1):
                continue
            last, cut = key(t, -1), t.num_rows - 1
            while cut and key(t, cut - 1) == last:
                cut -= 1
            flush(pa.concat_tables([*held[:-1], t.slice(0, cut)]), forest, totals)
            held = [t.slice(cut)]
        if held:
            flush(pa.concat_tables(held), forest, totals)
        rows = [(0, r, k) for r, k in totals.items()] + [(1, a, b) for a, b in forest.edges()]
        for i in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 100_000])], ["kind", "x", "y"])

    return run


def embedding_duplicates(
    vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rotations: int = ROTATIONS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Pairs of equal, non-null labels link at the given cosine in double precision.
    Null, empty, zero and non-finite vectors, and rows with a null label, link
    with nothing and are their own component. A row with a null vec_id takes no
    part: 0 links, null component, not kept. Labels may be of any type that
    compares. Vectors of different widths never link. Rows that repeat a vec_id count as copies of that vector if their
    embedding and label agree. Equal vectors collapse to one class first, which
    counts its members; links of a class are those of each member. Extra columns
    are ignored; an empty table gives an empty result.
    """
    ok = usable("vec") & F.col("label").isNotNull() & F.exists("vec", lambda x: x != 0)
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"  # floats stay narrow in shuffles
    label_kind = "long" if vectors.schema[label_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"), F.col(label_col).cast(label_kind).alias("label"))
    keys = [F.when(ok & F.col("vec_id").isNotNull(), F.xxhash64(F.lit(s), "label", "vec")) for s in (1, 2)]
    base = base.withColumns({"k1": keys[0], "k2": keys[1]})
    classes = (
        base.filter(F.col("k1").isNotNull())
        .groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"), F.first("label").alias("label"))
    )
    tables, probes = SETTINGS[rotations]
    coded = materialize(
        classes.mapInArrow(_with_codes(rotations), f"k1 long, k2 long, rep long, n long, vec {kind}, label {label_kind}, codes array<int>"),
        "vec-classes",
    )
    slots = coded.select("*", F.posexplode("codes").alias("slot", "code")).filter("code >= 0").withColumn("tbl", (F.col("slot") / probes).cast("long"))
    hot = materialize(  # its size is known when the next join is planned, so the wide side need not move for it
        slots.groupBy("label", "tbl", "code").count().filter(F.col("count") > HOT_BUCKET)
        .select("label", "tbl", "code", F.ceil(F.col("count") / HOT_BUCKET * 2).cast("int").alias("blocks")),
        "vec-hot",
    )
    entries = slots.join(hot, ["label", "tbl", "code"], "left")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(
            (F.least(o, mine) * F.col("blocks") + F.greatest(o, mine)).cast("long").alias("part"),
            F.when(o == mine, 2).when(mine < o, 0).otherwise(1).cast("long").alias("side"),
        ),
    )
    alone = F.array(F.struct(F.lit(-1).cast("long").alias("part"), F.lit(2).cast("long").alias("side")))
    dealt = entries.select(
        "label", F.col("tbl"), "code", "rep", "n", "vec", "codes", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(others)).alias("at")
    ).select("label", "tbl", "code", "at.part", "at.side", "rep", "n", "vec", "codes")
    by = ["label", "tbl", "code", "part"]
    found = materialize(
        dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_verify(cosine, rotations), "kind long, x long, y long"), "vec-found"
    )
    labels = components(found.filter("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")))
    counts = found.filter("kind = 0").groupBy(F.col("x").alias("rep")).agg(F.sum("y").alias("more"))
    by_class = materialize(
        coded.select("k1", "k2", "rep", "n").join(counts, "rep", "left").join(labels, F.col("rep") == labels.node, "left")
        .select("k1", "k2", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")),
        "vec-groups",
    )
    return (
        base.select("vec_id", "k1", "k2")
        .join(by_class, ["k1", "k2"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


QUERY_BLOCK = 1024
SHARD_ROWS = 8192
#: Rows whose bounds hold together, and terms traversed or probed before rows are tested again.
CHUNK_ROWS, STEP = 4096, 8


class Shard:
    """Postings of a shard's rows in chunks, a term being a dimension, with the bounds of each chunk.

    Values are integers held exactly: as doubles where no sum can leave 53 bits,
    else as 64-bit integers, else as Python's. Rows of like direction share a
    chunk, which keeps its bounds close.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, largest: int) -> None:
        most = x.shape[1] * int(np.abs(x.astype(object)).max(initial=0)) * largest
        kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
        lead = np.abs(x.astype(np.float64)).argmax(1)
        order = np.lexsort((ids, np.take_along_axis(x, lead[:, None], 1)[:, 0] < 0, lead))
        self.kind, self.width, self.chunks = kind, x.shape[1], []
        for i in range(0, len(order), CHUNK_ROWS):
            own = x[order[i : i + CHUNK_ROWS]].T
            squares = own.astype(np.float64) ** 2
            self.chunks.append((np.ascontiguousarray(own.astype(kind)), ids[order[i : i + CHUNK_ROWS]], own.min(1).astype(kind), own.max(1).astype(kind), squares, squares.sum(0)))


def maxscore(q: np.ndarray, shard: Shard, own: int, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, multiplications done) of one query's k best rows in a shard, exactly.

    floor is a score that the final k-th best is known to reach. In each chunk the
    score bounds split the terms by the threshold so far: those that together,
    were all others at their least, cannot lift a row to it are non-essential.
    Essential terms are traversed for all rows, and none are where even all
    terms' bounds fall short. The others are probed, widest first, only for rows
    still competitive: what is left of a row is at most the sum of its terms'
    bounds, and at most the product of the norms of what is left.
    """
    q = q.astype(shard.kind)
    best_ids, best, work = np.zeros(0, np.int64), np.zeros(0, shard.kind), 0
    for x, ids, low, high, squares, norms in shard.chunks:
        need = floor
        if len(best) >= k and (need is None or best[-1] > need):
            need = best[-1]
        a, b = q * low, q * high
        upper, lower = np.maximum(a, b), np.minimum(a, b)
        order = np.argsort((upper - lower).astype(np.float64), kind="stable")  # narrowest first
        cut = 0
        if need is not None:
            # reach[n]: the highest score when all but the n narrowest terms are at their least
            reach = np.concatenate([[0], np.cumsum((upper - lower)[order])]) + lower.sum()
            cut = int((reach < need).sum()) - 1  # terms that cannot lift a row to the threshold
            if cut == len(q):
                continue
            cut = max(cut, 0)
        essential, others, slack = order[cut:], order[:cut][::-1], 1e-13 * norms.max(initial=0.0)  # for the rounding of what is left
        if len(others) == 0 and need is not None:  # no term can be left out at once: traverse the widest half
            essential, others = order[len(q) // 2 :], order[: len(q) // 2][::-1]
        rows = np.flatnonzero(ids != own)
        score = (q[essential] @ x[essential])[rows]
        work += len(essential) * len(ids)
        left = (norms - squares[essential].sum(0))[rows]
        for i in range(0, len(others), STEP):
            if need is not None:
                rest = others[i:]
                by_norm = np.sqrt((np.maximum(left, 0.0) + slack) * (q[rest].astype(np.float64) ** 2).sum()) * (1 + 1e-9) + 1.0
                most = np.minimum(by_norm, float(upper[rest].sum()) + 1.0)
                keep = score.astype(np.float64) + most + np.abs(score.astype(np.float64)) * 1e-12 >= float(need)
                if not keep.any():
                    rows = rows[:0]
                    break
                rows, score, left = rows[keep], score[keep], left[keep]
            step = others[i : i + STEP]
            part = x[np.ix_(step, rows)]
            score = score + q[step] @ part
            left = left - squares[np.ix_(step, rows)].sum(0)
            work += len(step) * len(rows)
        if need is not None:
            keep = score[: len(rows)] >= need
            rows, score = rows[keep], score[: len(keep)][keep]
        if len(rows):
            best_ids, best = np.concatenate([best_ids, ids[rows]]), np.concatenate([best, score])
            first = np.lexsort((best_ids, -best.astype(object) if shard.kind is object else -best))
            best_ids, best = best_ids[first], best[first]
            if len(best) > 1:  # rows may repeat an id: its best stands
                seen = np.sort(np.unique(best_ids, return_index=True)[1])[:k]
                best_ids, best = best_ids[seen], best[seen]
    return best_ids, best, work


def _score_blocks(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of each query's k best rows in each shard it meets."""

    def run(qs: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[], [], []]
        if qs.num_rows and rows.num_rows:
            one = lambda t: t["q"].combine_chunks() if t["q"].num_chunks != 1 else t["q"].chunk(0)
            q, x = _matrix(one(qs), np.int64), _matrix(one(rows), np.int64)
            shard = Shard(x, rows["vec_id"].to_numpy(), int(np.abs(q.astype(object)).max(initial=0)))
            qid, floor = qs["vec_id"].to_numpy(), qs["floor"].to_pylist()
            for i in np.argsort(qid, kind="stable").tolist():
                ids, score, _ = maxscore(q[i], shard, qid[i], k, floor[i])
                for col, values in zip(out, ([int(qid[i])] * len(ids), ids.tolist(), [int(s) for s in score])):
                    col.extend(values)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    by = ["blk", "width", "shard"]
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides come from one table
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, score long")


def top_inner_products(
    vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query.

    Components become floor(scale * x), saturated at 64 bits; a score beyond 64
    bits raises. Candidates are all rows but those of the query's own id; ties go
    to the smaller vec_id, and repeated ids to the best of their rows. Null,
    empty or non-finite vectors and null ids take no part; vectors only meet
    others of their width. Shards and query blocks have fixed sizes and meet on a
    block number, so neither side is broadcast and each task holds one block of
    each. All queries meet the first shard first; the k-th score found there is
    their threshold in all others. Fewer than k candidates give fewer rows; no
    query, no rows.
    """
    whole = vectors.withColumns({"_id": F.col(id_col).cast("long"), "vec": F.col(vec_col).cast("array<double>")}).filter(F.col("_id").isNotNull() & usable("vec"))
    base = materialize(
        whole.select(F.col("_id").alias("vec_id"), F.transform("vec", lambda x: F.floor(x * scale)).alias("q"), is_query.alias("is_query")).dropDuplicates(), "topk-rows"
    )
    n, nq = base.agg(F.count("*"), F.count_if("is_query")).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-nq // QUERY_BLOCK))
    queries = base.filter("is_query").select(F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).alias("blk"), F.size("q").alias("width"), "vec_id", "q")
    everyone = base.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("blk"), F.size("q").alias("width"), F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(shards)).alias("shard"), "vec_id", "q"
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    hits = _score_blocks(queries.select("blk", "width", zero.alias("shard"), "vec_id", "q", none.alias("floor")), everyone.filter("shard = 0"), k)
    if shards > 1:
        hits = materialize(hits, "topk-first")
        found = hits.groupBy(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("hit")).agg(F.max("score").alias("score"))
        floors = found.groupBy("vec_id").agg(F.sort_array(F.collect_list("score"), False).alias("scores"))  # at most k a query vector
        floors = floors.filter(F.size("scores") >= k).select("vec_id", F.element_at("scores", k).alias("floor"))
        spread = queries.join(floors, "vec_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(shards - 1).cast("long"))))
        hits = hits.unionByName(_score_blocks(spread.select("blk", "width", "shard", "vec_id", "q", "floor"), everyone.filter("shard > 0"), k))
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
