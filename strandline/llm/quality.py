"""Document quality from weak labels: EM over heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize, worker_cache

#: Documents that the scorer is fitted on, at most, chosen by a hash of doc_id.
TRAIN_DOCS = 6000
BITS = 18
EM_ROUNDS = 60
_CACHE_WORDS = 300_000

#: Function words of the languages in scope; their absence is typical of lists and noise.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it was for on are with as be this have from or by not an at which but "
    "der die das und ist in den von zu mit sich auf für im dem nicht ein eine als auch des "
    "de la el en y a los se del las un por con no una su para es al lo como que "
    "le les et des est une du que dans qui par pour pas sur au avec il ce on "
    "di che il per è della sono con gli alla nel anche come più "
    "o os da em um uma não com dos na mais ao pelo "
    "van een het niet zijn voor aan met ook er "
    "och att det som på av för inte med til af ikke har "
    "i w na z się nie do jest że jak".split()
)
_RUNS = re.compile(r"(.)\1+")
LABELLERS = ("symbols", "decorated", "bare_signs", "capitals", "exclaiming", "repeated_lines", "repeated_words", "stutter", "repeated_sentences", "function_words", "word_length")
SIGNS = "*%$&#|<>{}[]\\^~=+_@"
GOOD, BAD, NONE = 1, 0, -1


def votes(text: str | None) -> list[int]:
    """GOOD, BAD or NONE from each labeller, over the whole text."""
    return _votes(text or "", (text or "").split())


def _votes(text: str, words: list[str]) -> list[int]:
    n = len(words)
    if not n:
        return [NONE] * len(LABELLERS)
    # labellers of words know scripts that part words by spaces and, for function words, Latin ones
    latin = text.isascii() or len(text.encode("ascii", "ignore")) > 0.7 * len(text)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SIGNS)) / chars
    decorated = sum(w[-1] in SIGNS or w[0] in SIGNS for w in words) / n
    bare = sum(not any(map(str.isalnum, w)) for w in words if not w[0].isalpha()) / n
    upper = sum(map(str.isupper, words)) / n
    shouting = text.count("!") / n
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    distinct = len(set(words)) / n
    stutter = sum(map(str.__eq__, words, words[1:])) / n
    sentences = [x for x in (y.strip() for y in re.split(r"[.!?\n]", text)) if x]
    again = 1 - len(set(sentences)) / len(sentences) if sentences else 0.0
    stop = sum(map(FUNCTION_WORDS.__contains__, words)) / n
    mean = chars / n
    return [
        BAD if symbols > 0.05 else GOOD if symbols < 0.01 else NONE,
        BAD if decorated > 0.15 else GOOD if decorated < 0.03 else NONE,
        BAD if bare > 0.1 else GOOD if bare < 0.02 else NONE,
        BAD if upper > 0.5 else GOOD if upper < 0.1 else NONE,
        BAD if shouting > 0.2 else GOOD if shouting < 0.02 else NONE,
        NONE if len(lines) < 3 else BAD if repeated > 0.3 else GOOD if repeated < 0.05 else NONE,
        NONE if n < 60 else BAD if distinct < 0.2 else GOOD if distinct > 0.35 else NONE,
        NONE if n < 10 else BAD if stutter > 0.1 else GOOD if stutter < 0.03 else NONE,
        NONE if len(sentences) < 5 else BAD if again > 0.4 else GOOD if again < 0.1 else NONE,
        NONE if n < 20 or not latin else BAD if stop < 0.03 else GOOD if stop > 0.1 else NONE,
        NONE if not latin else BAD if mean < 2.5 or mean > 14 else GOOD if 3.5 <= mean <= 9 else NONE,
    ]


def pattern_code(v: list[int]) -> int:
    code = 0
    for x in v:
        code = code * 3 + x + 1
    return code


def pattern_votes(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        code, r = divmod(code, 3)
        out.append(r - 1)
    return out[::-1]


def fit_labellers(counts: dict[int, int], rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray, dict[int, float]]:
    """(share of good documents, P(GOOD vote | class, not abstaining) as [class, labeller], P(good) of each pattern).

    Expectation-maximisation with two rates a labeller, one for each class; an
    abstaining labeller says nothing. It starts from the number of BAD votes and
    keeps the classes in order: a labeller is held to vote GOOD no more often on
    bad documents than on good ones. Input is the number of documents of each
    vote pattern, at most 3 to the power of labellers.
    """
    codes = sorted(counts)
    v = np.array([pattern_votes(c) for c in codes])
    n = np.array([counts[c] for c in codes], float)
    good, cast = (v == GOOD).astype(float), (v != NONE).astype(float)
    post = np.array([0.97, 0.3, 0.02])[np.minimum((v == BAD).sum(1), 2)]
    prior, rates = 0.5, np.zeros((2, len(LABELLERS)))
    for _ in range(rounds):
        rates = np.stack([((w * n) @ good + p) / ((w * n) @ cast + 2.0) for w, p in ((1 - post, 0.8), (post, 1.8))])
        rates[0] = np.minimum(rates[0], rates[1])
        prior = float(np.clip((post * n).sum() / n.sum(), 0.02, 0.98))
        logs = [good @ np.log(r) + (cast - good) @ np.log1p(-r) for r in rates]
        odds = logs[1] - logs[0] + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return prior, rates, dict(zip(codes, post.tolist()))


class _Buckets(dict):
    """Word -> bucket of the word, and above it the bucket of its shape (runs of letters, digits and signs)."""

    def __missing__(self, word: str) -> int:
        shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
        shape = _RUNS.sub(r"\1\1", shape)
        low = (crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in (word.lower(), "shape:" + shape))
        found = next(low) | next(low) << BITS
        if len(self) < _CACHE_WORDS:
            self[word] = found
        return found


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text, nothing for a blank one.

    Features are words, word shapes, and bands of length, of the share of
    distinct words and of words equal to their predecessor; a band counts as
    much as a quarter of the words.
    """
    return _features((text or "").split())


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, cache = len(words), worker_cache("quality", _Buckets)
    stats = (b"distinct:%d" % (10 * len(set(words)) // n), b"stutter:%d" % (10 * sum(map(str.__eq__, words, words[1:])) // n), b"length:%d" % n.bit_length())
    both = np.fromiter(map(cache.__getitem__, words), np.int64, n)
    pairs = np.concatenate([both & ((1 << BITS) - 1), both >> BITS])
    whole = np.array([crc32(x) & ((1 << BITS) - 1) for x in stats], np.int64)
    return np.unique(np.concatenate([pairs, np.repeat(whole, max(1, n // 4))]), return_counts=True)


def _weights(counts: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Square roots of counts, each row scaled to length one; its squares are the counts."""
    return np.sqrt(counts / np.maximum(1, np.bincount(row, counts, rows))[row])


def fit_scorer(bucket: np.ndarray, counts: np.ndarray, row: np.ndarray, target: np.ndarray, rounds: int = 80) -> np.ndarray:
    """Logistic weights (the last is the bias) by Adagrad on soft targets, full batches, fixed order."""
    rows, value = len(target), _weights(counts, row, len(target))
    w, g2 = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, value * w[bucket], rows) + w[-1]
        err = (1 / (1 + np.exp(-z)) - target) / max(1, rows)
        grad = np.append(np.bincount(bucket, value * err[row], 1 << BITS), err.sum()) + 1e-7 * w
        g2 += grad * grad
        w -= 0.3 * grad / np.sqrt(g2)
    return w


def score_rows(bucket: np.ndarray, counts: np.ndarray, row: np.ndarray, rows: int, w: np.ndarray) -> np.ndarray:
    """Scores of rows whose features stand one after another; a row without features scores 0."""
    z = np.bincount(row, _weights(counts, row, rows) * w[bucket], rows) + w[-1]
    return np.where(np.bincount(row, minlength=rows) > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)


def _ragged(bucket: pa.ListArray, counts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, counts, row) of two list columns."""
    size = np.diff(bucket.offsets.to_numpy())
    return bucket.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.float64), np.repeat(np.arange(len(size)), size)


#: Code of a text without a word, which is no vote pattern.
BLANK = -1


def quality(docs: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = 0.5) -> DataFrame:
    """(doc_id, votes array<int>, weak_posterior, score, kept) for each row of docs(doc_id, text, ...).

    One pass over the texts gives votes and features, which are written out; all
    the rest reads those. Labellers' accuracies come from the vote patterns of
    all documents with a word. The scorer learns the patterns' posteriors on a
    bounded sample and scores every text; kept is score >= threshold. No labelled
    data take part. Null and blank texts are rejected: posterior and score 0, no
    vote, not kept. A null doc_id never trains. Repeated rows come out as often
    as they went in; extra columns are ignored; an empty table gives an empty
    result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def read(batches):
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [part.column(0).to_pylist(), [], [], []]
                for t in part.column(1).to_pylist():
                    words = (t or "").split()
                    b, n = _features(words)
                    for col, x in zip(out[1:], (pattern_code(_votes(t, words)) if words else BLANK, b.astype(np.int32), n.astype(np.int32))):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "code", "b", "n"])

    seen = materialize(rows.mapInArrow(read, "doc_id long, code long, b array<int>, n array<int>"), "quality-features")
    # at most 3 ** len(LABELLERS) rows, in practice a few hundred
    counts = dict(map(tuple, seen.filter(F.col("code") != BLANK).groupBy("code").count().collect()))
    _, _, posterior = fit_labellers(counts) if counts else (0.5, None, {})
    share = min(1.0, train_docs / max(1, sum(counts.values())))
    chosen = seen.filter((F.col("code") != BLANK) & F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) < share * 1_000_000))
    got = chosen.toArrow().sort_by([("doc_id", "ascending"), ("code", "ascending")]).combine_chunks()
    w = np.zeros((1 << BITS) + 1)
    if got.num_rows:
        w = fit_scorer(*_ragged(*(got[c].chunk(0) for c in ("b", "n"))), np.array([posterior[c] for c in got["code"].to_pylist()]))
    weights = docs.sparkSession.sparkContext.broadcast(w)  # 2 MB whatever the input
    known = {BLANK: ([NONE] * len(LABELLERS), 0.0)} | {c: (pattern_votes(c), p) for c, p in posterior.items()}

    def score(batches):
        for batch in batches:
            s = score_rows(*_ragged(batch.column(2), batch.column(3)), batch.num_rows, weights.value)
            codes = [known[c] for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v for v, _ in codes], pa.list_(pa.int32())), pa.array([p for _, p in codes], pa.float64()), pa.array(s, pa.float64()),
                 pa.array((s >= threshold) & (batch.column(1).to_numpy() != BLANK))],
                ["doc_id", "votes", "weak_posterior", "score", "kept"],
            )

    return seen.mapInArrow(score, "doc_id long, votes array<int>, weak_posterior double, score double, kept boolean")
