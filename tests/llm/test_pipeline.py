"""The five stages against brute-force versions of themselves, each on its own input."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from strandline.llm import langid, mixing, packing, pii
from strandline.llm.common import materialize
from tests.llm.test_simhash import brute_fingerprint, brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), name))
    return [d.collect() for d in out]


def test_names():
    assert [n for n, _ in C.STAGES] == ["language", "near_dedup", "pii", "mixing", "packing"]


def test_language_keeps_clean_documents(spark, stages):
    """Against posteriors summed word by word in plain Python, by a model that the test reads but does not run."""
    from tests.llm.test_text_ops import plain_probabilities, step_segmentations

    before, after = stages[0], stages[1]
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    prob = [plain_probabilities(model, k) for k in range(len(model.langs))]
    after_lang, seen = {r.doc_id: r.lang for r in after}, {}
    for r in before[:30]:
        words = langid.words_of(r.text)
        for w in words:
            if w not in seen:
                seen[w] = np.array([step_segmentations(langid.START + w, p, langid._FLOOR, model.longest) for p in prob])
        if not words:
            assert r.doc_id not in after_lang
            continue
        total = sum(seen[w] for w in words)
        share = 1 / np.exp(total - total.max()).sum()
        assert (r.doc_id in after_lang) == (share >= C.LEAST_SCORE)
        assert after_lang.get(r.doc_id, model.langs[int(total.argmax())]) == model.langs[int(total.argmax())]
    text = {r.doc_id: r.text for r in before}
    assert all(r.text == text[r.doc_id] for r in after)
    assert len(after) > 0.97 * len(before)


def test_documents_stay_where_no_language_is_known(spark, odd_docs):
    docs = odd_docs.select(*C.COLUMNS).withColumn("lang", F.lit(None).cast("string"))
    kept = C.language(spark, docs, SF).collect()
    assert sorted(r.doc_id or 0 for r in kept) == sorted(r.doc_id or 0 for r in docs.collect() if langid.words_of(r.text))
    assert {r.lang for r in kept} == {None}


def test_one_of_each_group(stages):
    group = brute_groups([(r.doc_id, brute_fingerprint(r.text)) for r in stages[1]])
    assert sorted(r.doc_id for r in stages[2]) == sorted({g for g in group.values()})
    text = {r.doc_id: r.text for r in stages[1]}
    assert all(r.text == text[r.doc_id] for r in stages[2])


def test_pseudonyms(spark, stages):
    """Texts differ only in values that invert under the session's key, found by patterns of the test's own."""
    import re

    back, text = pii.Pseudonymizer(pii.session_key(spark), back=True), {r.doc_id: r.text for r in stages[2]}
    shapes = {"email": r"[\w.]+@[\w.]+\.[a-z]+", "ssn": r"\b\d{3}-\d{2}-\d{4}\b", "card": r"\b(?:\d{4}[ -]?){3}\d{4}\b", "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}\b"}
    hits = 0
    for r in stages[3]:
        for kind, shape in shapes.items():
            olds, news = re.findall(shape, text[r.doc_id]), re.findall(shape, r.text)
            valid = [o for o in olds if pii.Pseudonymizer(b"any").replace(kind, o) is not None]
            if len(olds) == len(news) and valid:
                hits += len(valid)
                assert all(n == o or back.replace(kind, n) == o for o, n in zip(olds, news))
                assert not set(valid) & set(news)
        assert r.n_chars == len(r.text)
    assert hits > 5 and {r.doc_id for r in stages[3]} == set(text)


def test_mixture_counts(stages):
    import hashlib
    import math

    size, want = {}, []
    for r in stages[3]:
        size[r.source] = size.get(r.source, 0) + 1
    weight = {s: n**mixing.TEMPERATURE for s, n in size.items()}
    for r in stages[3]:
        rate = weight[r.source] / sum(weight.values()) * len(stages[3]) / size[r.source]
        u = int(hashlib.md5(f"{mixing.SEED}|{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        n, p, upto = 0, math.exp(-rate), math.exp(-rate)
        while u >= upto:
            n += 1
            p *= rate / n
            upto += p
        want += [r.doc_id] * n
    assert sorted(r.doc_id for r in stages[4]) == sorted(want)


def test_packing_round_trip(stages):
    tok = Tokenizer.from_file(packing.VOCABULARY)
    texts = {r.doc_id: r.text for r in stages[4]}
    copies = {}
    for r in stages[4]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    spans, seen = {}, {}
    for r in stages[5]:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault(r.doc_id, {}).setdefault(r.start, []).append(np.frombuffer(r.ids, "<u4").tolist())
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= packing.CAPACITY
    assert set(seen) == set(texts)
    for doc, parts in seen.items():
        assert all(len(p) == copies[doc] for p in parts.values())
        ids = [x for s in sorted(parts) for x in parts[s][0]]
        assert ids == tok.encode(texts[doc], add_special_tokens=False).ids + [packing.END_ID]


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.select(*C.COLUMNS)
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, odd_docs, SF)
        assert out.columns == C.COLUMNS
        assert stage(spark, no_docs, SF).count() == 0
        out.count()
    assert C.pseudonyms(spark, docs, SF).count() == docs.count()
    assert C.language(spark, docs, SF).filter(F.col("doc_id").isin(3, 4, 5, 7)).count() == 0
    assert C.pack(spark, no_docs, SF).count() == 0 and C.pack(spark, odd_docs, SF).count() >= docs.count()
