"""SimHash fingerprints and near-duplicate groups by pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize, worker_cache
from strandline.llm.components import Forest, components

SEED = 42
SHINGLE = 4
DISTANCE = 4
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit majority vote over the XXH64 of word shingles; 0 when there is no word.

    Words are maximal runs without ASCII white space, after lower-casing A-Z
    only; repeats count. Fewer words than a shingle make one short shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        h = np.array(
            [digest(joined[i:j], SEED) for i, j in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])],
            dtype="<u8",
        )
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long: the fingerprint's two's complement) for each row; null text is as no words."""

    def run(batches):
        worker_cache("simhash", dict)
        for batch in batches:
            fps = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """docs with the fingerprint of each text in a further column of that name (long, two's complement)."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        worker_cache("simhash", dict)
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], [*names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{name}` long")


def block_count(rows: int, distance: int = DISTANCE) -> int:
    """Blocks so that a bucket of unrelated fingerprints holds few rows on average.

    Fingerprints within the distance share b - distance of b blocks for any b,
    so every b gives the same links; b only trades keys a row for bucket size.
    """
    for b in range(distance + 1, distance + 5):
        if rows <= 4 << (64 * (b - distance) // b):
            return b
    return distance + 5


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """Bit masks of every choice of blocks - distance out of the blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(parts[i] for i in pick) for pick in combinations(range(blocks), blocks - distance)]
    assert len(masks) == comb(blocks, distance)
    return masks


def _runs(batches, columns):
    """Yield arrays over whole runs of equal keys (column 0) from key-sorted batches."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        arrays = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if not len(arrays[0]):
            continue
        change = np.flatnonzero((arrays[0][1:] != arrays[0][:-1]) | (arrays[1][1:] != arrays[1][:-1]))
        held.append(arrays)
        same = held[0][0][0] == arrays[0][-1] and held[0][1][0] == arrays[1][-1]
        if same:
            continue
        cut = int(change[-1]) + 1 if len(change) else 0
        done = [np.concatenate([h[i] for h in held[:-1]] + [arrays[i][:cut]]) for i in range(columns)]
        if len(done[0]):
            yield done
        held = [[a[cut:] for a in arrays]]
    if held:
        yield [np.concatenate([h[i] for h in held]) for i in range(columns)]


def _spread(fp: np.ndarray, rep: np.ndarray, forest: Forest, distance: int) -> None:
    """Link one large bucket: grow each group from a seed and never look at its members again.

    A dense group costs one pass over the bucket, and no pair is stored.
    """
    left_fp, left_rep = fp, rep
    while len(left_fp):
        queue, left_fp, left_rep = [(left_fp[0], left_rep[0])], left_fp[1:], left_rep[1:]
        while queue and len(left_fp):
            f, r = queue.pop()
            near = np.bitwise_count(left_fp ^ f) <= distance
            if near.any():
                for other in left_rep[near].tolist():
                    forest.union(int(r), other)
                queue.extend(zip(left_fp[near], left_rep[near]))
                left_fp, left_rep = left_fp[~near], left_rep[~near]


def _subdivide(fp: np.ndarray, rep: np.ndarray, forest: Forest, distance: int, most: int = 50_000) -> None:
    """Split a very large bucket by pigeonhole blocks over the bits that still vary in it."""
    if len(fp) <= most:
        return _spread(fp, rep, forest, distance)
    varies = int(np.bitwise_or.reduce(fp) & ~np.bitwise_and.reduce(fp))
    bits = [b for b in range(64) if varies >> b & 1]
    for part in np.array_split(np.array(bits), distance + 1):
        mask = np.uint64(sum(1 << int(b) for b in part))
        order = np.argsort(fp & mask, kind="stable")
        key = (fp & mask)[order]
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            pick = order[a:b]
            if b - a > 0.5 * len(fp):
                _spread(fp[pick], rep[pick], forest, distance)
            elif b - a > 1:
                _subdivide(fp[pick], rep[pick], forest, distance, most)


def _link_buckets(distance: int):
    def run(batches):
        forest = Forest()
        for table, block, fp, rep in _runs(batches, 4):
            fp = fp.view(np.uint64)
            edge = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (block[1:] != block[:-1]), True])
            size = np.diff(edge)
            run_end = np.repeat(edge[1:], size)
            small = np.repeat(size <= 48, size)
            at = np.flatnonzero(small & (np.arange(len(fp)) + 1 < run_end))
            step = 1
            while len(at):
                near = np.bitwise_count(fp[at] ^ fp[at + step]) <= distance
                for i in at[near].tolist():
                    forest.union(int(rep[i]), int(rep[i + step]))
                step += 1
                at = at[at + step < run_end[at]]
            for a, n in zip(edge[:-1][size > 48].tolist(), size[size > 48].tolist()):
                _subdivide(fp[a : a + n], rep[a : a + n], forest, distance)
        pairs = list(forest.edges())
        for i in range(0, len(pairs), 100_000):
            a, b = zip(*pairs[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def fingerprint_groups(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of (doc_id, fp): the smallest doc_id reachable by links.

    Equal fingerprints collapse to one node before any join, so copies cost no
    pairs. Nodes meet on block keys, are verified by Hamming distance inside the
    task, and leave it as a spanning forest: edges never outnumber the nodes.
    """
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-nodes")
    masks = block_masks(block_count(nodes.count(), distance), distance)
    keyed = nodes.select(
        "fp",
        "rep",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias("tbl", "block"),
    ).select("tbl", "block", "fp", "rep")
    edges = (
        keyed.repartition("tbl", "block").sortWithinPartitions("tbl", "block").mapInArrow(_link_buckets(distance), "a long, b long")
    )
    labels = components(edges)
    grouped = materialize(
        nodes.join(labels, nodes.rep == labels.node, "left")
        .filter(F.col("node").isNotNull() | (F.col("n") > 1))
        .select("fp", F.coalesce("component", "rep").alias("component")),
        "simhash-groups",
    )
    return fps.join(grouped, "fp", "left").select(
        "doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id")
    )


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) for each row of docs(doc_id, text, ...).

    Null and blank texts have fingerprint zero and link like any other. Repeated
    rows come out as often as they went in; a null doc_id keeps its fingerprint
    and takes the smallest doc_id of its group (null if there is none). Extra
    columns are ignored; an empty table gives an empty result.
    """
    groups = fingerprint_groups(materialize(fingerprints(docs), "simhash-fps"), distance)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each near-duplicate group: of the smallest doc_id, then the smallest fingerprint.

    Groups are of texts, so rows that share a doc_id and have other texts stand
    apart: each belongs to the group of its own text. Of rows alike in doc_id and
    fingerprint the least in (text, other columns) stays, which no rerun changes.
    Rows with a null doc_id belong to no group and stay.
    """
    columns, own = docs.columns, "__simhash_fp"
    marked = materialize(with_fingerprint(docs, own), "simhash-docs")
    named = marked.filter(F.col("doc_id").isNotNull())
    groups = fingerprint_groups(named.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(own).alias("fp")), distance)
    heads = materialize(  # of doc_id and fingerprint, with the number of rows that share both
        groups.groupBy("component_id", "doc_id", "fp").agg(F.count("*").alias("rows"))
        .groupBy("component_id").agg(F.min(F.struct("doc_id", "fp", "rows")).alias("head"))
        .select(F.col("head.doc_id").alias("__simhash_id"), F.col("head.fp").alias("__simhash_own"), F.col("head.rows").alias("__simhash_rows")),
        "simhash-heads",
    )
    match = (F.col("doc_id").cast("long") == F.col("__simhash_id")) & (F.col(own) == F.col("__simhash_own"))
    alone = named.join(heads.filter("__simhash_rows = 1"), match, "left_semi").select(*columns)
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    least = F.min_by(row, F.struct(F.col("text").cast("string"), F.to_json(row)))
    several = named.join(heads.filter("__simhash_rows > 1"), match).groupBy("__simhash_id", "__simhash_own").agg(least.alias("row")).select("row.*")
    return alone.unionByName(several).unionByName(marked.filter(F.col("doc_id").isNull()).select(*columns))
