import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, n string, rep string"


def brute(rows, cosine=0.93):
    ok = {i: np.array(v, float) / np.linalg.norm(v) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: lab for i, _, lab in rows}
    links = {i: set() for i, _, _ in rows}
    for a in ok:
        for b in ok:
            if a != b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine:
                links[a].add(b)
    comp = {i: i for i in links}
    for _ in links:
        comp = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in links}
    return {i: (len(links[i]), comp[i]) for i in links}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out, i = [], 0
    for label in (0, 1, 2):
        for _ in range(12):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 9)):
                out.append((i, (base + rng.normal(size=16) * 0.15).astype(np.float32).tolist(), label))
                i += 1
    out += [(i + k, out[0][1], 0) for k in range(6)]
    out += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, out[0][1], None), (1005, [], 0), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_duplicates_match_brute_force(spark, rows):
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.embedding_duplicates(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_hot_buckets_are_dealt_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(V, "HOT_BUCKET", 3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.embedding_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(rows).items()}


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    for rotations, (tables, probes) in V.SETTINGS.items():
        x, y = (V.cross_polytope_codes(z, tables, probes, rotations).reshape(2000, tables, probes) for z in (a, 0.93 * a + np.sqrt(1 - 0.93**2) * b))
        met = (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3))
        assert met.mean() > 0.99


def test_hadamard_is_orthogonal():
    h = V.hadamard(np.eye(32))
    assert np.allclose(h @ h.T, np.eye(32))


def test_top_k_matches_brute_force(spark, rows):
    good = [(i, v) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    got = V.top_inner_products(frame(spark, rows + rows[:3]), F.col("vec_id") % 10 == 0, k=4).collect()
    want = set()
    for i, v in good:
        if i % 10 == 0:
            scores = [(-int(np.floor(1024 * np.float64(np.float32(v))) @ np.floor(1024 * np.float64(np.float32(w)))), j) for j, w in good if j != i and len(w) == len(v)]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:4])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want


def search(x, q, k, shard_rows=1000):
    """Ids and scores of a query over shards that pass a threshold on, and the share of multiplications done."""
    ids, floor, found, work = np.arange(len(x)), None, [], 0
    for at in range(0, len(x), shard_rows):
        shard = V.Shard(x[at : at + shard_rows], ids[at : at + shard_rows], int(np.abs(x).max()))
        own, score, done = V.maxscore(x[q], shard, q, k, floor)
        work += done
        found += [(-int(s), int(i)) for s, i in zip(score, own)]
        if at == 0 and len(score) >= k:
            floor = int(score[-1])
    return sorted(found)[:k], work / x.size


def exact(x, q, k):
    y = x.astype(object)
    return sorted((-int(s), i) for i, s in enumerate(y @ y[q]) if i != q)[:k]


def test_max_score_is_exact_and_skips_work():
    rng = np.random.default_rng(8)
    random = np.floor(rng.normal(size=(12_000, 64)) * 1024).astype(np.int64)
    centres = rng.normal(size=(50, 64))
    grouped = np.floor((centres[rng.integers(0, 50, 12_000)] + rng.normal(size=(12_000, 64)) * 0.4) * 1024).astype(np.int64)
    for x, most in ((random, 0.7), (grouped, 0.45)):
        shares = []
        for q in range(12):
            found, share = search(x, q, 10)
            assert found == exact(x, q, 10)
            shares.append(share)
        assert np.mean(shares) < most, np.mean(shares)


def test_max_score_of_large_values_and_ties():
    rng = np.random.default_rng(3)
    for size, kind in ((1e6, np.float64), (1e8, np.int64), (9e8, object)):
        x = (rng.normal(size=(300, 16)) * size).astype(np.int64)
        assert V.Shard(x, np.arange(300), int(np.abs(x).max())).kind is kind
        for q in range(5):
            assert search(x, q, 7, 100)[0] == exact(x, q, 7)
    ties = np.repeat(rng.integers(-3, 4, size=(40, 8)), 30, axis=0)
    for q in range(0, 1200, 100):
        assert search(ties, q, 10, 128)[0] == exact(ties, q, 10)


def test_large_components_are_exact(spark):
    rows = [(i, [1e6 + i, -1e6, 9e5 - i], 1) for i in range(6)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in V.top_inner_products(frame(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>")), F.lit(True), k=2).collect()}
    y = [[int(np.floor(1024 * v)) for v in r[1]] for r in rows]
    for q in range(6):
        want = sorted((-sum(a * b for a, b in zip(y[q], y[j])), j) for j in range(6) if j != q)[:2]
        assert [got[q, n + 1] for n in range(2)] == [(j, -s) for s, j in want]


def test_scores_beyond_64_bits_raise(spark):
    rows = [(i, [4e6, 4e6], 1) for i in range(2)]
    with pytest.raises(Exception, match="too large"):
        V.top_inner_products(frame(spark, rows), F.lit(True)).collect()


def test_several_shards_and_repeated_ids(spark, rows, monkeypatch):
    monkeypatch.setattr(V, "SHARD_ROWS", 16)
    good = [(i, v, 0) for i, v, _ in rows if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v)]
    twice = good + [(good[0][0], good[5][1], 0), (good[7][0], good[3][1], 0)]
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in V.top_inner_products(frame(spark, twice), F.col("vec_id") % 10 == 0, k=4).collect()}
    ints = [(i, np.floor(1024 * np.float64(np.float32(v))).astype(int)) for i, v, _ in twice]
    want = set()
    for q in {i for i, _ in ints if i % 10 == 0}:
        best = {}
        for i, a in ints:
            if i == q:
                for j, b in ints:
                    if j != q:
                        best[j] = max(best.get(j, -(10**18)), int(a @ b))
        want |= {(q, n + 1, j, s) for n, (j, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:4])}
    assert got == want


def test_null_ids_and_labels_of_text(spark, rows):
    some = [(None, rows[0][1], 0), *rows[:30]]
    got = V.embedding_duplicates(frame(spark, some)).collect()
    alone = [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None]
    assert alone == [(0, None, False)]
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == brute(rows[:30])
    named = frame(spark, rows[:30]).withColumn("label", F.concat(F.lit("class "), F.col("label")))
    assert {r.vec_id: (r.n_links, r.component_id) for r in V.embedding_duplicates(named).collect()} == brute(rows[:30])


@pytest.mark.parametrize("rotations", sorted(V.SETTINGS))
def test_recall_at_table_size(spark, rotations):
    """Planted pairs at and above the threshold, a third of the rows in one label and a dense group: links found against brute force."""
    rng, rows = np.random.default_rng(11), []
    unit = lambda z: z / np.linalg.norm(z, axis=-1, keepdims=True)
    base = unit(rng.normal(size=(6000, 64)))
    rows += [(b, 0 if i % 3 == 0 else 1 + i % 7) for i, b in enumerate(base)]
    for i in range(0, 3000):
        away = rng.normal(size=64)
        away = unit(away - (away @ base[i]) * base[i])
        c = rng.uniform(0.93, 0.96)
        rows.append((c * base[i] + np.sqrt(1 - c * c) * away, 0 if i % 3 == 0 else 1 + i % 7))
    rows += [(unit(base[0] + rng.normal(size=64) * 0.02), 0) for _ in range(500)]
    x, label = np.array([r[0] for r in rows]).astype(np.float32).astype(float), np.array([r[1] for r in rows])
    x = unit(x)
    want = 0
    for k in np.unique(label):
        own = x[label == k]
        want += int((own @ own.T >= 0.93).sum()) - len(own)
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist(), int(k)) for i, (v, k) in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    got = V.embedding_duplicates(df, rotations=rotations).agg(F.sum("n_links")).first()[0]
    assert want > 250_000 and 0.98 * want < got <= want


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert V.embedding_duplicates(none).count() == 0
    assert V.top_inner_products(none, F.col("vec_id") % 2 == 0).count() == 0
