"""Language ID by segmentation-marginalised unigram models over a fixed public vocabulary."""

from __future__ import annotations

import re
import uuid
from collections import ChainMap, Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import worker_cache

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
UNDETERMINED = "und"
START = "▁"
#: Labelled documents a language is learned from, at most.
TRAIN_DOCS = 1500
EM_ROUNDS = 4
_FLOOR = 1e-7
_CACHE_WORDS = 500_000
#: Characters of the words that are scored together, padding included: bounds memory, changes no result.
_BATCH_CHARS = 400_000
#: Places of words whose pieces are held at once: bounds memory where words are long, changes no result.
_SPAN = 4096
_WORD = re.compile(r"[^\W\d_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_NO_ROWS = np.zeros(0, np.int64)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters of a whole text; runs without any letter do not count."""
    return [w for w in _WORD.findall((text or "").lower()) if w[0].isalpha() or any(c.isalpha() for c in w)]


def pieces(vocabulary: str = VOCABULARY) -> list[str]:
    """Letter pieces of the vocabulary, in a fixed order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    keep = {p for p in found if p and p == p.lower() and all(c.isalpha() or c == START for c in p) and START not in p[1:]}
    return sorted(keep)


def _hashes(codes: np.ndarray, most: int) -> list[np.ndarray]:
    """[l]: hash of the l + 1 characters from each place, for every row of a code matrix, up to most characters."""
    n, m = codes.shape
    out, h = [], np.zeros((n, m), np.uint64)
    for length in range(1, min(most, m) + 1):
        h = (h[:, : m - length + 1] + codes[:, length - 1 :].astype(np.uint64) + np.uint64(1)) * _MULT
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


class UnigramModel:
    """Piece probabilities of each language. Characters outside the vocabulary have a floor probability.

    All sums over segmentations are of logarithms, so words of any length are scored whole.
    """

    def __init__(self, langs: list[str], keys: np.ndarray, prob: np.ndarray, longest: int) -> None:
        self.langs, self.keys, self.prob, self.longest, self.id = langs, keys, prob, longest, uuid.uuid4().hex

    @classmethod
    def empty(cls, langs: list[str], vocabulary: str = VOCABULARY) -> UnigramModel:
        known = pieces(vocabulary)
        longest = max(map(len, known), default=1)
        all_keys = [_hashes(np.array([[ord(c) for c in p]], np.uint32), len(p))[-1][0, 0] for p in known]
        keys = np.unique(np.array(all_keys, np.uint64))
        assert len(keys) == len(all_keys), "two pieces share a hash"
        # the last row: a character outside the vocabulary
        prob = np.full((len(keys) + 1, len(langs)), 1.0 / max(1, len(keys)))
        prob[-1] = _FLOOR
        return cls(langs, keys, prob, longest)

    def _places(self, codes: np.ndarray) -> list[list[tuple[np.ndarray | slice, np.ndarray]]]:
        """[l][i]: (rows, piece ids) of the pieces of l + 1 characters from place i; single characters always count."""
        out, n = [], len(self.keys)
        for length, h in enumerate(_hashes(codes, self.longest)):
            at = np.minimum(np.searchsorted(self.keys, h), n - 1)
            hit = self.keys[at] == h
            if length == 0:
                ids = np.where(hit, at, n)
                out.append([(slice(None), ids[:, i]) for i in range(h.shape[1])])
                continue
            some = hit.any(0)
            out.append([(r := np.flatnonzero(hit[:, i]), at[r, i]) if some[i] else (_NO_ROWS, _NO_ROWS) for i in range(h.shape[1])])
        return out

    def _forward(self, places, n: int, m: int, log_prob: np.ndarray, first: np.ndarray | float = 0.0, steps: int | None = None) -> np.ndarray:
        """alpha[:, j]: log probability of the first j characters, summed over all their segmentations.

        first: the columns from 0 as far as pieces from before have filled them; steps: places that pieces start from, all if None.
        """
        alpha = np.full((n, m + 1, log_prob.shape[1]), -np.inf)
        if isinstance(first, float):
            alpha[:, 0] = first
        else:
            alpha[:, : first.shape[1]] = first
        for i in range(m if steps is None else steps):
            for length in range(1, min(len(places), m - i) + 1):
                rows, ids = places[length - 1][i]
                if len(ids):
                    alpha[rows, i + length] = np.logaddexp(alpha[rows, i + length], alpha[rows, i] + log_prob[ids])
        return alpha

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """(words, languages) natural logs of whole words."""
        out, log_prob = np.zeros((len(words), len(self.langs))), np.log(self.prob)
        for at, codes, ends in _by_length(words):
            codes, alpha = codes[:, : ends.max()], np.zeros((len(at), 1, len(self.langs)))
            for start in range(0, codes.shape[1], _SPAN):  # of what went before, only the sums that a piece can still reach are kept
                part, steps = codes[:, start : start + _SPAN + self.longest - 1], min(_SPAN, codes.shape[1] - start)
                alpha = self._forward(self._places(part), *part.shape, log_prob, alpha, steps)
                here = (ends > start) & (ends <= start + steps)
                out[at[here]] = alpha[here, ends[here] - start]
                alpha = alpha[:, steps:].copy()
        return out

    def fit(self, words: list[str], counts: np.ndarray, rounds: int = EM_ROUNDS) -> None:
        """Expectation-maximisation from counts of (word, language), a language at a time over its own words."""
        for k in range(len(self.langs)):
            own = np.flatnonzero(counts[:, k] > 0)
            groups = [(counts[own[at], k : k + 1], codes.shape, ends, self._places(codes)) for at, codes, ends in _by_length([words[i] for i in own.tolist()])]
            for _ in range(rounds):
                expected, log_prob = np.zeros(len(self.prob)), np.log(self.prob[:, k : k + 1])
                for times, (n, m), ends, places in groups:
                    alpha, every = self._forward(places, n, m, log_prob), np.arange(n)
                    beta = np.full_like(alpha, -np.inf)
                    beta[every, ends] = 0.0
                    share = np.log(times) - alpha[every, ends]
                    for i in range(m - 1, -1, -1):
                        for length in range(1, min(len(places), m - i) + 1):
                            rows, ids = places[length - 1][i]
                            if len(ids):
                                use = log_prob[ids] + beta[rows, i + length]
                                beta[rows, i] = np.logaddexp(beta[rows, i], use)
                                expected += np.bincount(ids, np.exp(alpha[rows, i] + use + share[rows])[:, 0], len(expected))
                p = expected[:-1] + 0.01
                self.prob[:-1, k] = np.maximum(p / p.sum(), _FLOOR / 10)


def _by_length(words: list[str]):
    """Yield (row numbers, code matrix, lengths) of START + word, words of like lengths together, padded with zeros."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        n = len(w) + 1
        groups.setdefault(n if n <= 24 else 1 << (n - 1).bit_length(), []).append(i)
    for width, rows in sorted(groups.items()):
        most = max(1, _BATCH_CHARS // width)
        for at in range(0, len(rows), most):
            own = rows[at : at + most]
            raw = np.frombuffer("".join((START + words[i]).ljust(width, "\0") for i in own).encode("utf-32-le", "surrogatepass"), "<u4")
            yield np.array(own), raw.reshape(len(own), width), np.array([len(words[i]) + 1 for i in own])


def held_out():
    """True for documents that training never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, vocabulary: str = VOCABULARY, train_docs: int = TRAIN_DOCS) -> UnigramModel | None:
    """Learn from docs with a language, outside the held-out part, up to train_docs of each language.

    The documents of a language are chosen by a hash of doc_id. Only word counts
    of that bounded sample reach the driver. None if there is nothing to learn from.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = rows.groupBy("lang").count().collect()  # one row a language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, train_docs / r["count"]))])
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches):
        worker_cache("langid counts", dict)
        total: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.setdefault(lang, Counter()).update(words_of(text))
        for lang, c in total.items():
            items = list(c.items())
            for i in range(0, len(items), 50_000):
                w, n = zip(*items[i : i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(w)), pa.array(w), pa.array(n, pa.int64())], ["lang", "word", "n"])

    counted = chosen.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    langs = sorted({r["lang"] for r in sizes})
    words, at = np.unique(np.array(table["word"].to_pylist(), object), return_inverse=True)
    counts = np.zeros((len(words), len(langs)))
    if len(words):
        lang_at = np.array([langs.index(x) for x in table["lang"].to_pylist()])
        np.add.at(counts, (at, lang_at), table["n"].to_numpy())
    model = UnigramModel.empty(langs, vocabulary)
    if len(words):
        model.fit(words.tolist(), counts)
    return model


def score_texts(texts: list[str | None], model: UnigramModel) -> tuple[list[str], list[float]]:
    """Best language of each whole text and its posterior under equal priors."""
    held = worker_cache(f"langid {model.id}", lambda: [{}, np.zeros((0, len(model.langs)))])
    known, logs = held
    split = [words_of(t) for t in texts]
    fresh = list({w for ws in split for w in ws if w not in known})
    if fresh:
        logs = np.concatenate([logs, model.log_likelihoods(fresh)])
        rows = dict(zip(fresh, range(len(known), len(logs))))
        if len(logs) <= _CACHE_WORDS:
            known.update(rows)
            held[1] = logs
        else:  # the cache is full: these words hold for this call
            known = ChainMap(rows, known)
    langs, scores = [], []
    for ws in split:
        if not ws:
            langs.append(UNDETERMINED)
            scores.append(0.0)
            continue
        total = logs[np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))].sum(0)
        best = int(total.argmax())
        langs.append(model.langs[best])
        scores.append(float(1.0 / np.exp(total - total[best]).sum()))
    return langs, scores


def tag(docs: DataFrame, model: UnigramModel | None) -> DataFrame:
    """docs with held_out, lang_pred and score added (columns of those names are replaced).

    Predictions use the whole text alone. Null text, or text without a letter, is
    `und` with score 0, and so is every text without a model. Ties go to the first
    language by name. Rows with a null doc_id are predicted but never learned from;
    repeated rows come out as often as they went in; an empty table gives an empty
    result.
    """
    rows = docs.drop("held_out", "lang_pred", "score").withColumn("held_out", held_out())
    at = rows.columns.index("text")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = part.column(at).to_pylist()
                langs, scores = score_texts(texts, model) if model else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, "lang_pred", "score"]
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary: str = VOCABULARY, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs(doc_id, text, lang, ...); see tag()."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return tag(narrow, train(narrow, vocabulary, train_docs)).select("doc_id", "held_out", "lang_pred", "score")
