import random

import numpy as np
import pyarrow as pa
import xxhash

from strandline.llm import simhash as S
from strandline.llm.components import Forest, components


def brute_fingerprint(text):
    raw = (text or "").encode()
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    words = [w for w in raw.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, distance=4):
    """Smallest id of each connected class, by comparing all pairs."""
    parent = {i: i for i, _ in fps}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, f in fps:
        for b, g in fps:
            if a < b and (f ^ g).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def test_fingerprint_is_the_majority_vote():
    rng = random.Random(3)
    for n in (0, 1, 3, 4, 5, 40, 300):
        text = " ".join(rng.choice(["Aa", "b", "ç\xa0x", "d\x0be", "F"]) for _ in range(n))
        assert S.fingerprint(text) == brute_fingerprint(text)
    assert S.fingerprint(None) == 0


def test_chunks_add_up(monkeypatch):
    text = " ".join(str(i * i) for i in range(500))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "_CHUNK", 7)
    assert S.fingerprint(text) == whole


def test_blocks_meet_every_close_pair():
    rng = random.Random(5)
    for blocks in range(5, 10):
        masks = S.block_masks(blocks)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_groups_match_brute_force(spark):
    rng = random.Random(9)
    fps = []
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            f ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.append(f)
    rows = [(i, f) for i, f in enumerate(rng.sample(fps, len(fps)))] + [(1000 + i, fps[0]) for i in range(5)]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in S.fingerprint_groups(df).collect()}
    assert got == brute_groups(rows)


def test_large_buckets(monkeypatch):
    rng = np.random.default_rng(1)
    fp = np.concatenate([np.uint64(1 << 40) ^ (np.uint64(1) << rng.integers(0, 30, 400).astype(np.uint64)), rng.integers(0, 1 << 62, 400).astype(np.uint64)])
    fp = np.unique(fp)
    rep = np.arange(len(fp), dtype=np.int64)
    want = brute_groups([(int(r), int(f)) for r, f in zip(rep, fp)])
    for most in (10**6, 40):
        forest = Forest()
        S._subdivide(fp, rep, forest, 4, most)
        assert {int(r): forest.find(int(r)) for r in rep} == want


def test_runs_span_batches():
    keys = [1, 1, 2, 2, 2, 2, 2, 3]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 2]), pa.array([0, 0])], ["a", "b"]) for i in range(0, 8, 2)]
    seen = [part[0].tolist() for part in S._runs(batches, 2)]
    assert sum(seen, []) == keys
    assert all(k not in a for i, a in enumerate(seen) for b in seen[i + 1 :] for k in b)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = S.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == 1
    assert by[3].fingerprint == by[4].fingerprint == by[5].fingerprint == "0" * 16
    assert {by[i].component_id for i in (3, 4, 5)} == {3}
    assert S.near_duplicates(no_docs).count() == 0
    kept = [r.doc_id for r in S.keep_one(odd_docs).collect()]
    assert kept.count(1) == 1 and 2 not in kept and 4 not in kept and kept.count(None) == 1


def test_documents_match_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    want = brute_groups(fps)
    for r in S.near_duplicates(documents).collect():
        assert int(r.fingerprint, 16) == dict(fps)[r.doc_id]
        assert r.component_id == want[r.doc_id]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(101, 140)) and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_goes_by_text(spark):
    a, b = "one text of a good many words that stands here", "another thing altogether with no word in common at all"
    rows = [(3, a, "x"), (5, a, "y"), (5, b, "z"), (5, b, "w"), (None, a, "n"), (7, None, "o"), (8, "", "p")]
    for order in (rows, rows[::-1]):
        out = S.keep_one(spark.createDataFrame(order, "doc_id long, text string, fp string").repartition(3)).collect()
        assert sorted((r.doc_id or 0, r.text or "", r.fp) for r in out) == sorted([(3, a, "x"), (5, b, "w"), (0, a, "n"), (7, "", "o")])
