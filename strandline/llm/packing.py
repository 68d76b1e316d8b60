"""Sequence packing: best-fit decreasing with lower-bound certificates and repacking of gaps."""

from __future__ import annotations

import logging
import os
import re
import struct
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize, worker_cache

CAPACITY = 4096
END_ID = 1
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Rows that one task packs at once; a partition's memory is in proportion to it.
GROUP_ROWS = 4000
#: Rounds in a row without fewer sequences or a smaller pool, after which the packing ends uncertified.
STALE_ROUNDS = 2
_CACHE_ROWS = 600_000
#: Letters of Latin-1 and Latin Extended-A, which stand for themselves in NFC; lower() must not leave them.
_WORD, _LOWER_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ſ]+").fullmatch, re.compile("[a-zß-öø-ſ]+").fullmatch
#: The character that a byte-level vocabulary has for each byte, by the byte's Latin-1 character.
_BYTE_CHARS = dict(zip((b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)), range(256, 512)))
#: ASCII punctuation that can end a chunk without being part of a special token.
_TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
_log = logging.getLogger(__name__)


def _tokenizer(vocabulary: str):
    """(tokenizer, cache of white-space-delimited chunks), kept by the worker between tasks."""

    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(vocabulary), {}

    return worker_cache(f"packing {vocabulary}", load)


def _plain(chunk: bytes) -> tuple[bytes, bytes]:
    """(core, tail): a chunk with the same ids as core + tail, which many chunks share."""
    core = chunk.rstrip(_TAIL)
    if not core[-1:].isalnum():  # the tail would merge with what stands before it
        core = chunk
    return (core.lower() if core.isascii() and b"<|" not in core else core), chunk[len(core) :]


def _byte_word(chunk: bytes) -> str | None:
    """A chunk of Latin letters alone as its one pre-token, None for any other chunk."""
    word = chunk.decode("utf-8")
    if not _WORD(word) or not _LOWER_WORD(word := word.lower()):
        return None
    return word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(_BYTE_CHARS)


def _encode_chunks(chunks: list[bytes], tok) -> dict[bytes, bytes]:
    """Ids of chunks. Words of Latin letters go to the merges at once, others many to a call: a lone control character, always one token, parts them."""
    found, (mark,), merge, together = {}, tok.encode("\x01", add_special_tokens=False).ids, tok.model.tokenize, []
    for c in chunks:
        if (word := _byte_word(c)) is not None:
            ids = [t.id for t in merge(word)]
            found[c] = struct.pack(f"<{len(ids)}I", *ids)
        elif b"\x01" in c:
            found[c] = np.array(tok.encode(c.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()
        else:
            together.append(c)
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
    for i in range(0, len(together), 500):
        part = together[i : i + 500]
        ids = np.array(encode([b" \x01 ".join(part).decode("utf-8")], add_special_tokens=False)[0].ids, "<u4")
        ends, raw, at = np.append(np.flatnonzero(ids == mark), len(ids)).tolist(), ids.tobytes(), 0
        for c, end in zip(part, ends, strict=True):
            found[c], at = raw[4 * at : 4 * end], end + 1
    return found


def encode_texts(texts: list[str | None], vocabulary: str = VOCABULARY) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit bytes, without an end id.

    This vocabulary's pre-tokeniser never crosses white space and its normaliser
    does not compose across it, so the ids of a text are those of its chunks.
    Frequent chunks are looked up; the cache stops growing at a fixed size.
    """
    tok, cache = _tokenizer(vocabulary)
    split = [(t or "").encode("utf-8").split() for t in texts]
    got = [list(map(cache.get, chunks)) for chunks in split]
    gaps = [[i for i, ids in enumerate(found) if ids is None] for found in got]
    unseen = {chunks[i]: None for chunks, at in zip(split, gaps) for i in at}
    if unseen:
        pairs = {c: _plain(c) for c in unseen}
        cores = _encode_chunks(list({x for pair in pairs.values() for x in pair if x and x not in cache}), tok)
        for c, pair in pairs.items():
            unseen[c] = b"".join([cores[x] if x in cores else cache.get(x, b"") for x in pair])
        if len(cache) < _CACHE_ROWS:
            cache.update(cores)
            cache.update(unseen)
        for chunks, found, at in zip(split, got, gaps):
            for i in at:
                found[i] = unseen[chunks[i]]
    return [b"".join(found) for found in got]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids binary) for docs(doc_id, text, ...).

    A document is its ids and END_ID; null text counts as empty, so it is one
    piece of length 1. Only documents over the capacity are cut, into pieces of
    the capacity and a last, shorter one. Ids are little-endian unsigned 32-bit.
    """
    end = np.array([END_ID], "<u4").tobytes()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    )

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [[], [], [], [], []]
                for doc, ids in zip(part.column(0).to_pylist(), encode_texts(part.column(1).to_pylist(), vocabulary)):
                    ids += end
                    for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[i : i + 4 * capacity]
                        for col, value in zip(rows, (doc, k, i // 4, len(own) // 4, own)):
                            col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary"
    )


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, and the tokens in each bin; ties go to earlier rows."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    room: list[int] = []  # distinct free spaces, ascending
    holders: dict[int, list[int]] = {}
    for i in order.tolist():
        w = int(lengths[i])
        at = bisect_left(room, w)
        if at < len(room):
            free = room[at]
            b = holders[free].pop()
            if not holders[free]:
                del holders[free], room[at]
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += w
        if free > w:
            if free - w not in holders:
                holders[free - w] = []
                insort(room, free - w)
            holders[free - w].append(b)
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(histogram: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, from dual feasible functions over all thresholds.

    histogram[w] is the number of items of length w. For a threshold k, items
    over capacity - k count as whole bins, items under k as nothing, and those
    between by length; the bound is the best over k of at most half the capacity.
    """
    h = np.asarray(histogram, np.int64)
    count, mass = np.r_[0, np.cumsum(h)], np.r_[0, np.cumsum(h * np.arange(len(h)))]  # [w]: of lengths below w
    half, k = capacity // 2, np.arange(0, capacity // 2 + 1)
    whole = count[-1] - count[capacity - k + 1]
    large = count[capacity - k + 1] - count[half + 1]
    large_mass = mass[capacity - k + 1] - mass[half + 1]
    small_mass = mass[half + 1] - mass[k]
    extra = np.maximum(0, -(-(small_mass - (large * capacity - large_mass)) // capacity))
    return int(max((whole + large + extra).max(), -(-int(mass[-1]) // capacity)))


def _pack_groups(items: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """Pack each hash group by best-fit decreasing; every row tells whether its bin is final.

    Full bins are. A group whose bin count meets its dual-feasible-function bound
    is certified: all its bins are final but the least filled, whose items go on,
    so that what groups lose by rounding does not add up. A group with a gap keeps
    its full bins only.
    """
    kind = "uid long, length long, seq long, offset long, final boolean, certified boolean"

    def run(table: pa.Table) -> pa.Table:
        uid, length = table["uid"].to_numpy(), table["length"].to_numpy()
        order = np.argsort(uid, kind="stable")
        uid, length = uid[order], length[order]
        b, offset, fill = best_fit_decreasing(length, capacity)
        certified = len(fill) == lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
        final = np.full(len(fill), certified)
        final[fill.argmin()] = False
        final |= fill == capacity
        group = int(table["grp"][0].as_py())
        seq = (turn << 56) + (group << 24) + b
        return pa.table([uid, length, seq, offset, final[b], np.full(len(uid), certified)], names=["uid", "length", "seq", "offset", "final", "certified"])

    grouped = items.withColumn("grp", F.pmod(F.xxhash64(F.lit(turn), "uid"), F.lit(groups)))
    return grouped.select("grp", "uid", "length").groupBy("grp").applyInArrow(run, kind)


def pack(items: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(uid, sequence_id, offset) for items(uid long, length long in 1..capacity); see pack_certified()."""
    return pack_certified(items, capacity, group_rows)[0]


def pack_certified(items: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, int, int]:
    """((uid, sequence_id, offset), sequences, lower bound of the whole input).

    Groups of a bounded size are packed apart. Groups that meet their lower bound
    are frozen (but for their least filled bin); those with gaps give back what
    lies in bins with space left. All given back is dealt anew, in fewer groups,
    and packed again. It ends when the total meets the bound of the whole input
    (then it is certified as least), when one group holds the rest, or when
    rounds bring neither fewer sequences nor a smaller pool. The outcome is
    logged. Empty input: empty result.
    """
    items = materialize(items.select("uid", "length"), "pack-items")
    hist = np.zeros(capacity + 1, np.int64)
    for w, n in items.groupBy("length").count().collect():  # at most one row a length
        hist[w] = n
    bound, open_rows = lower_bound(hist, capacity), int(hist.sum())
    done, closed, turn, stale, least, here = [], 0, 0, 0, None, None
    while True:
        groups = max(1, -(-open_rows // group_rows))
        packed = materialize(_pack_groups(items, groups, turn, capacity), "pack-round")
        bins = packed.groupBy("seq").agg(F.first("final").alias("final"), F.count("*").alias("n"))
        n_bins, n_final, kept_rows = (x or 0 for x in bins.agg(F.count("*"), F.count_if("final"), F.sum(F.when(F.col("final"), F.col("n")))).first())
        total = closed + n_bins
        stale = 0 if least is None or total < least or kept_rows > open_rows // 100 else stale + 1
        least = total if least is None else min(least, total)
        if here is None or total < here[0]:  # the best packing of the present pool
            here = (total, packed)
        if total <= bound or groups == 1 or stale >= STALE_ROUNDS:
            total = here[0]
            done.append(here[1])
            break
        if kept_rows:
            done.append(packed.filter("final"))
            closed += n_final
            items, here = materialize(packed.filter("NOT final").select("uid", "length"), "pack-items"), None
            open_rows -= kept_rows
            if not open_rows:
                break
        turn += 1
    _log.info("%d sequences, lower bound %d: %s", total, bound, "certified" if total == bound else "not certified")
    columns = ["uid", F.col("seq").alias("sequence_id"), "offset"]
    out = done[0].select(*columns)
    for more in done[1:]:
        out = out.unionByName(more.select(*columns))
    return out, total, bound


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of docs(doc_id, text, ...) with their ids and places in sequences.

    (doc_id, piece, start, length, ids, sequence_id, offset). Each row of docs is
    packed, repeated rows and null doc_ids too; extra columns are ignored; an
    empty table gives an empty result.
    """
    return _placed(token_pieces(docs, capacity, vocabulary), capacity)


def _placed(pieces: DataFrame, capacity: int) -> DataFrame:
    kept = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    return kept.join(pack(kept, capacity), "uid").drop("uid")


def packing_digest(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """pack_documents with a CRC-32 of the ids instead of the ids, which then never shuffle."""
    pieces = token_pieces(docs, capacity, vocabulary)
    return _placed(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
