import random
import re
import tracemalloc

import numpy as np
import pytest

from strandline.llm import langid as L
from strandline.llm import common, licenses, mixing, pii, quality
from tests.compare import check, tables

SF = "/root/testdata/sf0.001"


def brute_segmentations(word, prob, floor):
    """Sum over all cuts of a word into pieces, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        p = prob.get(word[:n], floor if n == 1 else 0.0)
        total += p * brute_segmentations(word[n:], prob, floor) if p else 0.0
    return total


def step_segmentations(word, prob, floor, longest):
    """The log of the same sum, character by character in plain Python."""
    import math

    logs = [0.0]
    for j in range(1, len(word) + 1):
        terms = []
        for n in range(1, min(longest, j) + 1):
            p = prob.get(word[j - n : j], floor if n == 1 else 0.0)
            if p:
                terms.append(logs[j - n] + math.log(p))
        top = max(terms)
        logs.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return logs[-1]


@pytest.fixture(scope="module")
def model():
    m = L.UnigramModel.empty(["a", "b"])
    rng = np.random.default_rng(0)
    m.prob[:-1] = rng.random(m.prob[:-1].shape) / 1e4
    return m


def plain_probabilities(model, k):
    names = {L._hashes(np.array([[ord(c) for c in p]], np.uint32), len(p))[-1][0, 0]: p for p in L.pieces()}
    return {names[h]: model.prob[i, k] for i, h in enumerate(model.keys)}


def test_forward_sums_all_segmentations(model):
    assert model.longest == max(map(len, L.pieces())) > 8
    for k in range(2):
        prob = plain_probabilities(model, k)
        for word in ("the", "chat", "überß", "xq日z", "international"):
            want = np.log(brute_segmentations(L.START + word, prob, model.prob[-1, k]))
            assert np.isclose(model.log_likelihoods([word])[0, k], want)


def test_long_words_are_scored_whole(model):
    words = ["internationalisation" * 4, "x" * 3000, "日本語" * 30, "a", "functional" * 7]
    got = model.log_likelihoods(words)
    for k in range(2):
        prob = plain_probabilities(model, k)
        for word, own in zip(words, got[:, k]):
            assert np.isclose(own, step_segmentations(L.START + word, prob, model.prob[-1, k], model.longest))


def test_predictions_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(docs)
    rows = {r.doc_id: r for r in L.identify(docs).collect()}
    prob = [plain_probabilities(model, k) for k in range(len(model.langs))]
    seen = {}
    for r in docs.limit(25).collect():
        words = L.words_of(r.text)
        for w in words:
            if w not in seen:
                seen[w] = np.array([step_segmentations(L.START + w, p, L._FLOOR, model.longest) for p in prob])
        if not words:
            assert rows[r.doc_id].lang_pred == "und"
            continue
        total = sum(seen[w] for w in words)
        assert rows[r.doc_id].lang_pred == model.langs[int(total.argmax())]
        assert np.isclose(rows[r.doc_id].score, 1 / np.exp(total - total.max()).sum(), atol=1e-6)


def test_em_raises_the_likelihood():
    words, counts = ["hello", "help", "helmet", "hola", "holanda"], np.array([[5, 0], [3, 0], [2, 0], [0, 6], [0, 2.0]])
    m = L.UnigramModel.empty(["x", "y"])
    seen = []
    for _ in range(4):
        m.fit(words, counts, 1)
        seen.append((m.log_likelihoods(words) * counts).sum())
    assert seen == sorted(seen)


def test_words():
    assert L.words_of("Hé2llo ²³ _x_ 12 日本") == ["hé", "llo", "x", "日本"]
    assert L.words_of(None) == [] and L.words_of("123 ²") == []


def test_full_cache_gives_the_same(model, monkeypatch):
    texts = ["the cat", "the dog and the cat", None, "xyz zyx"]
    want = L.score_texts(texts, model)
    common._held.clear()
    monkeypatch.setattr(L, "_CACHE_WORDS", 1)
    assert L.score_texts(texts, model) == want
    common._held.clear()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    rows = L.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5, 7))
    assert by[1].lang_pred in ("en", "es", "fr") and by[None].held_out is False
    assert L.identify(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", odd_docs.lang.substr(9, 1)).replace("", None, ["lang"])
    assert {r.lang_pred for r in L.identify(unlabelled).collect()} == {"und"}


@pytest.mark.parametrize("kind,value", [
    ("card", "4845168114407329"), ("card", "4111-1111-1111-1111"), ("phone", "+1 (243) 555-5526"), ("phone", "+44 20 7946 0958"), ("ssn", "123-45-6789"),
    ("ip", "129.38.82.176"), ("day", "2024-02-29"), ("day", "12/25/2020"), ("day", "25.12.2020"), ("email", "the.9@mail9.example.com"),
    ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"), ("secret", "Ab9_xY-zzz01234567"), ("iban", "DE89 3704 0044 0532 0130 00"),
])
def test_pseudonyms_keep_format_and_invert(kind, value):
    to, back = pii.Pseudonymizer(b"k"), pii.Pseudonymizer(b"k", back=True)
    new = to.replace(kind, value)
    assert new != value and len(new) == len(value) and back.replace(kind, new) == value
    if kind not in ("ip",):
        assert re.sub(r"[0-9a-zA-Z]", "9", new) == re.sub(r"[0-9a-zA-Z]", "9", value)
    assert pii.Pseudonymizer(b"other").replace(kind, value) != new


def test_invalid_values_stay():
    to = pii.Pseudonymizer(b"k")
    for kind, value in (("card", "9807915762804490"), ("day", "2024-02-30"), ("ip", "300.1.1.1"), ("ssn", "000-12-3456"), ("iban", "DE00370400440532013000"), ("card", "0000000000000000")):
        assert to.replace(kind, value) is None
    text = "v1.2.3.4 costs 2024-02-30 or 9807915762804490 and 3.14 in 2020"
    assert pii.pseudonymize(text, to) == (text, {})


def test_feistel_is_a_permutation():
    net = pii.Feistel(b"key")
    for size in (1, 2, 10, 97, 1000):
        assert sorted(net.permute(x, size, b"t") for x in range(size)) == list(range(size))


def test_pii_links_equal_values(spark, odd_docs, no_docs):
    rows = [(1, "card 4111 1111 1111 1111 mail a.b9@x.org"), (2, "again 4111-1111-1111-1111, a.b9@x.org"), (3, None), (4, "")]
    got = {r.doc_id: r for r in pii.pseudonyms(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    digits = lambda s: re.sub(r"\D", "", s.split("mail")[0].split(",")[0])
    assert digits(got[1].text) == digits(got[2].text) != "4111111111111111"
    assert got[1].text.split()[-1] == got[2].text.split()[-1] != "a.b9@x.org"
    assert got[3].text is None and got[4].text == "" and got[1].n_pii == 2 and got[1].pii_counts == {"card": 1, "email": 1}
    out = pii.pseudonyms(odd_docs, b"k")
    assert out.count() == odd_docs.count() and out.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert pii.pseudonyms(no_docs, b"k").count() == 0


def test_documents_without_data_stay(spark, documents):
    before = {r.doc_id: r.text for r in documents.collect()}
    for r in pii.pseudonyms(documents, b"k").collect():
        assert (r.text == before[r.doc_id]) == (r.n_pii == 0)
        assert not re.search(r"token = \"[0-9a-f]{40}\"", r.text or "") or r.n_pii


def test_em_recovers_labeller_accuracies():
    rng = random.Random(1)
    counts = {}
    for _ in range(8000):
        good = rng.random() < 0.8
        v = [quality.NONE] * len(quality.LABELLERS)
        for k, acc in enumerate((0.98, 0.95, 0.9, 0.97)):
            if rng.random() < 0.9:
                v[k] = (quality.GOOD if good else quality.BAD) if rng.random() < acc else (quality.BAD if good else quality.GOOD)
        code = quality.pattern_code(v)
        counts[code] = counts.get(code, 0) + 1
    prior, rates, post = quality.fit_labellers(counts)
    assert abs(prior - 0.8) < 0.05 and np.allclose(rates[1, :4], (0.98, 0.95, 0.9, 0.97), atol=0.04)
    assert all(quality.pattern_code(quality.pattern_votes(c)) == c for c in post)


def test_quality_against_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs).join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) > 0.93 * len(rows)
    assert sum(r.kept for r in rows if r.quality) > 0.97 * sum(r.quality for r in rows)


def test_quality_of_odd_rows(odd_docs, no_docs):
    rows = quality.quality(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and 0 <= r.weak_posterior <= 1 for r in rows)
    assert quality.quality(no_docs).count() == 0
    by = {r.doc_id: r for r in rows}
    assert all((by[i].score, by[i].weak_posterior, by[i].kept, set(by[i].votes)) == (0.0, 0.0, False, {quality.NONE}) for i in (3, 4, 5))


def test_labellers_of_words_abstain_beyond_latin():
    kept = dict(zip(quality.LABELLERS, quality.votes("これは一つの長い日本語の文章です。空白がありません。 " * 30)))
    assert kept["word_length"] == kept["function_words"] == quality.NONE
    assert dict(zip(quality.LABELLERS, quality.votes("el perro de la casa y los gatos que por la noche " * 3)))["function_words"] == quality.GOOD


def brute_quality(rows, train_docs, share):
    """EM, hashed features and the scorer in plain Python and dense arrays."""
    from zlib import crc32

    codes = {i: tuple(quality.votes(t)) for i, t in rows if (t or "").split()}
    patterns = sorted(set(codes.values()))
    n = [sum(c == p for c in codes.values()) for p in patterns]
    post = [(0.97, 0.3, 0.02)[min(2, p.count(quality.BAD))] for p in patterns]
    for _ in range(quality.EM_ROUNDS):
        rates = []
        for good_class, extra in ((False, 0.8), (True, 1.8)):
            own = []
            for k in range(len(quality.LABELLERS)):
                weigh = [m * (q if good_class else 1 - q) for m, q in zip(n, post)]
                up = sum(w for w, p in zip(weigh, patterns) if p[k] == quality.GOOD) + extra
                own.append(up / (sum(w for w, p in zip(weigh, patterns) if p[k] != quality.NONE) + 2.0))
            rates.append(own)
        rates[0] = [min(a, b) for a, b in zip(*rates)]
        prior = min(max(sum(a * b for a, b in zip(n, post)) / sum(n), 0.02), 0.98)
        post = []
        for p in patterns:
            odds = np.log(prior / (1 - prior))
            for k, v in enumerate(p):
                if v != quality.NONE:
                    odds += np.log(rates[1][k] / rates[0][k]) if v == quality.GOOD else np.log((1 - rates[1][k]) / (1 - rates[0][k]))
            post.append(1 / (1 + np.exp(-odds)))
    by = dict(zip(patterns, post))

    def counted(text):
        words, out = text.split(), {}
        key = lambda s: crc32(s.encode()) % (1 << quality.BITS)
        for w in words:
            shape = re.sub(r"(.)\1+", r"\1\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in w))
            for k in (key(w.lower()), key("shape:" + shape)):
                out[k] = out.get(k, 0) + 1
        same = sum(a == b for a, b in zip(words, words[1:]))
        for s in (f"distinct:{10 * len(set(words)) // len(words)}", f"stutter:{10 * same // len(words)}", f"length:{len(words).bit_length()}"):
            out[key(s)] = out.get(key(s), 0) + max(1, len(words) // 4)
        size = sum(out.values())
        return {k: (v / size) ** 0.5 for k, v in out.items()}

    feats = {i: counted(t) for i, t in rows if i in codes}
    fit = sorted(i for i in codes if share(i))
    w, g2, bias, bias2 = {}, {}, 0.0, 1e-8
    for i in fit:
        for k in feats[i]:
            w[k], g2[k] = 0.0, 1e-8
    for _ in range(80):
        grad, bias_grad = {k: 1e-7 * x for k, x in w.items()}, 1e-7 * bias
        for i in fit:
            err = (1 / (1 + np.exp(-(bias + sum(v * w[k] for k, v in feats[i].items())))) - by[codes[i]]) / len(fit)
            bias_grad += err
            for k, v in feats[i].items():
                grad[k] += v * err
        for k, g in grad.items():
            g2[k] += g * g
            w[k] -= 0.3 * g / g2[k] ** 0.5
        bias2 += bias_grad**2
        bias -= 0.3 * bias_grad / bias2**0.5
    return {i: (by[codes[i]], 1 / (1 + np.exp(-(bias + sum(v * w.get(k, 0.0) for k, v in feats[i].items()))))) for i in codes}


def test_quality_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc_id: (r.weak_posterior, r.score) for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_quality(rows, quality.TRAIN_DOCS, lambda i: True)
    for i, pair in want.items():
        assert np.allclose(got[i], pair, atol=1e-4), i


def test_license_scan_oracle(spark):
    from strandline.llm.registry import op4_license_scan

    check(spark, tables(SF), SF, op4_license_scan, licenses.oracle())


def test_license_edges(spark, odd_docs, no_docs):
    gpl = licenses.NOTICES["gpl-3.0-header"]
    cut = gpl.split()
    rows = [(1, "x " * 500 + gpl.upper() + " y" * 100), (2, " ".join(cut[:20])), (3, " ".join(cut[:36] + ["oops"] + cut[37:])), (4, None), (5, "released under the"), (1, gpl), (6, "Released under the MIT License.")]
    got = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "gpl-3.0-header"].containment == 1.0 and (2, "gpl-3.0-header") not in got and got[3, "gpl-3.0-header"].containment >= 0.8
    assert (6, "mit") in got and {d for d, _ in got} == {1, 3, 6}
    assert licenses.scan(odd_docs).count() == 0 and licenses.scan(no_docs).count() == 0
    assert licenses.scan(odd_docs, {}).count() == 0


def brute_licenses(text, templates, containment=licenses.CONTAINMENT):
    """License -> (containment, matching windows, first place), from all windows of the text."""
    words, out = licenses.template_words(text), {}
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    for name, t in templates.items():
        known = set(licenses.template_shingles(t))
        c = licenses.class_of(len(known), containment)
        hits = []
        for a in range(0, len(grams), c.stride):
            own = grams[a : a + c.length]
            share = len(known & set(own)) / len(known)
            if share >= containment:
                hits.append((share, a + min(i for i, g in enumerate(own) if g in known)))
        if hits:
            out[name] = (round(max(h[0] for h in hits), 6), len(hits), min(h[1] for h in hits))
    return out


def test_whole_texts_and_edited_copies_match_brute_force(spark):
    rng, lib = random.Random(3), licenses.library()
    noise = lambda n: " ".join(rng.choice(("lorem", "ipsum", "dolor", "software", "license")) for _ in range(n))
    docs = []
    for name in ("mit-text", "bsd-3-clause-text", "isc-text", "apache-2.0-header", "zlib-text", "apache-2.0-text", "mit", "gpl-3.0", "apache-2.0"):
        words = lib[name].split()
        for edits in (0, len(words) // 60, len(words) // 25, len(words) // 8):
            own = list(words)
            for at in rng.sample(range(len(own)), edits):
                own[at] = rng.choice(("changed", "", "two words"))
            docs.append(noise(rng.randint(0, 300)) + " " + " ".join(own) + " " + noise(rng.randint(0, 300)))
    docs += [lib["mit-text"] + " " + lib["apache-2.0-header"] + " " + lib["mit-text"], noise(2000)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, {})[r.license] = (r.containment, r.n_windows, r.first_word)
    for i, text in enumerate(docs):
        assert got.get(i, {}) == brute_licenses(text, lib), i


def test_band_settings_guarantee():
    """Windows that just match a template of each class share a band with it, in all of many drawings."""
    rng = np.random.default_rng(6)
    for s in (1, 2, 3, 4, 5, 8, 9, 17, 33, 65, 129, 300):
        c, shared = licenses.class_of(s), int(np.ceil(licenses.CONTAINMENT * s))
        missed = 0
        for _ in range(3000):
            template = rng.integers(0, 1 << 62, s)
            window = np.concatenate([template[:shared], rng.integers(0, 1 << 62, c.length - shared)])
            least = lambda h: {int(b): int(h[(h >> (62 - licenses.BAND_BITS)) == b].min()) for b in np.unique(h >> (62 - licenses.BAND_BITS))}
            a, b = least(template), least(window)
            missed += not any(b.get(k) == v for k, v in a.items())
        assert missed <= (0 if s <= 4 else 1), s


def test_anchors_lose_no_match():
    sh = {n: licenses.template_shingles(t) for n, t in licenses.library().items()}
    picked = set(licenses.anchors(sh))
    assert len(picked) < 20 and all(len(w) >= 7 for w in picked)
    for s in sh.values():
        assert sum(not picked & set(x) for x in s) < np.ceil(licenses.CONTAINMENT * len(s))


def test_mixing_oracle(spark):
    from strandline.llm.registry import op6_mixing

    check(spark, tables(SF), SF, op6_mixing, mixing.ORACLE)


def test_mixing_rates(spark, odd_docs, no_docs):
    rows = [(i, "big" if i < 3000 else "small") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(df, {"big": 1, "small": 1}).groupBy("source").count().collect()
    assert all(abs(r["count"] - 2000) < 250 for r in got)
    assert mixing.mix(df, {"big": 1}).filter("source = 'small'").count() == 0
    out = mixing.mix(odd_docs)
    assert set(odd_docs.columns) < set(out.columns) and mixing.mix(no_docs).count() == 0
    keys = [r.mix_key for r in mixing.mix(df).collect()]
    assert keys == sorted(keys)


def test_mixing_meets_targets_of_small_sources(spark):
    df = spark.createDataFrame([(i, "big" if i < 3960 else "small") for i in range(4000)], "doc_id long, source string")
    got = {r["source"]: r["count"] for r in mixing.mix(df, {"big": 1, "small": 1}).groupBy("source").count().collect()}
    assert abs(got["small"] - 2000) < 250 and abs(got["big"] - 2000) < 250
    counts = [r["count"] for r in mixing.mix(df, {"big": 1, "small": 1}).filter("source = 'small'").groupBy("doc_id").count().collect()]
    assert 20 < np.var(counts) < 120  # a Poisson count of mean 50


@pytest.mark.parametrize("text,kind,value", [
    ("Card 4111 1111 1111 1111 12/25", "card", "4111 1111 1111 1111"), ("4111111111111111 12 items", "card", "4111111111111111"),
    ("order 12 4111 1111 1111 1111 ok", "card", "4111 1111 1111 1111"), ("7-4111-1111-1111-1111-9", "card", "4111-1111-1111-1111"),
    ("4111111111111111 300", "card", "4111111111111111"), ("+442079460958 2020", "phone", "+442079460958"), ("+442079460958 12", "phone", "+442079460958"),
    ("call +44 20 7946 0958 2020 12", "phone", "+44 20 7946 0958"), ("DE89370400440532013000 AB12", "iban", "DE89370400440532013000"),
    ("pay DE89 3704 0044 0532 0130 00 EUR now", "iban", "DE89 3704 0044 0532 0130 00"), ("to AB12 DE89370400440532013000 ok", "iban", "DE89370400440532013000"),
])
def test_values_beside_other_groups(text, kind, value):
    to = pii.Pseudonymizer(b"k")
    got, counts = pii.pseudonymize(text, to)
    assert got == text.replace(value, to.replace(kind, value)) != text and counts == {kind: 1}


def test_mixing_keeps_columns_of_clashing_names(spark):
    rows = [(i, "a", 7, 8, 9, 10, "u") for i in range(50)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, rate int, copy int, steps int, _n int, _u string"))
    assert set(out.columns) == {"doc_id", "source", "steps", "_n", "_u", "rate", "n_copies", "copy", "mix_key"}
    assert all((r.steps, r._n, r._u, r.rate) == (9, 10, "u", 1.0) for r in out.collect())


def test_no_rate_is_cut(spark):
    df = spark.createDataFrame([(i, "big" if i < 20000 else "tiny") for i in range(20050)], "doc_id long, source string")
    got = {r["source"]: r["count"] for r in mixing.mix(df, {"big": 1, "tiny": 1}).groupBy("source").count().collect()}
    assert abs(got["big"] - 10025) < 500 and abs(got["tiny"] - 10025) < 500


def test_mixing_oracle_with_rates_of_many_parts(spark, tmp_path):
    """The SQL inverts the same distributions where a rate is a sum of parts."""
    rows = [(i, f"text {i}", "en", "big" if i < 4000 else "tiny" if i < 4003 else None, 6) for i in range(4005)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    from strandline.llm.registry import op6_mixing

    check(spark, con, str(tmp_path), op6_mixing, mixing.ORACLE)
    assert mixing.source_rates(df).agg({"parts": "max"}).first()[0] > 1


def test_long_secrets_change_whole():
    to, back, rng = pii.Pseudonymizer(b"k"), pii.Pseudonymizer(b"k", back=True), random.Random(2)
    for n in (16, 128, 129, 210, 5000):
        for signs in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"):
            own = "g1" * (len(signs) > 16) + "".join(rng.choice(signs) for _ in range(n))
            new, counts = pii.pseudonymize(f'token = "{own}" end', to)
            new = new[9:-5]
            assert counts == {"secret": 1} and len(new) == len(own) and back.replace("secret", new) == own
            assert sum(a == b for a, b in zip(own, new) if a.isalnum()) < len(own) // 2
    assert pii.pseudonymize("a" * 90 + "@x.org", to)[1] == {"email": 1}


def test_values_link_across_formats():
    to, back = pii.Pseudonymizer(b"k"), pii.Pseudonymizer(b"k", back=True)
    from datetime import date

    iso, dmy, mdy = (to.replace("day", x) for x in ("2020-12-25", "25.12.2020", "12/25/2020"))
    assert date.fromisoformat(iso) == date(int(dmy[6:]), int(dmy[3:5]), int(dmy[:2])) == date(int(mdy[6:]), int(mdy[:2]), int(mdy[3:5]))
    digits = lambda x: re.sub(r"\D", "", x)
    ways = ("+44 20 7946 0958", "+442079460958", "+44-20-7946-0958")
    assert len({digits(to.replace("phone", x)) for x in ways}) == 1
    us = [digits(to.replace("phone", x)) for x in ("+1 (243) 555-5526", "(243) 555-5526", "243-555-5526", "243.555.5526")]
    assert {x[-10:] for x in us} == {us[1]}
    assert to.replace("email", "Ann.B9@x.org").lower() == to.replace("email", "ann.b9@x.org")
    for kind, x in [("day", v) for v in ("2020-12-25", "05/03/2020", "31.12.1999", "12/25/2020")] + [("phone", v) for v in ways]:
        assert back.replace(kind, to.replace(kind, x)) == x


def brute_find(text, to):
    """Pseudonyms by a scan that tries each kind at each place, for values set apart by commas."""
    kinds = {
        "email": r"\w(?:[\w.+-]*\w)?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}", "ip": r"\d{1,3}(?:\.\d{1,3}){3}", "ssn": r"\d{3}-\d{2}-\d{4}",
        "day": r"\d{4}-\d{2}-\d{2}|\d{2}([/.])\d{2}\1\d{4}", "card": r"\d{13,19}", "phone": r"\+\d{10,15}|\d{3}[.-]\d{3}[.-]\d{4}", "iban": r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}",
    }
    out = []
    for word in text.split(", "):
        new = word
        for kind, shape in kinds.items():
            if re.fullmatch(shape, word) and (found := to.replace(kind, word)) is not None:
                new = found
                break
        out.append(new)
    return ", ".join(out)


def test_texts_match_a_brute_force_scan():
    to, rng = pii.Pseudonymizer(b"k"), random.Random(4)
    values = ["ann@x.org", "10.0.0.255", "300.1.1.1", "123-45-6789", "000-12-3456", "2020-02-29", "2021-02-29", "25.12.2020", "4111111111111111", "4111111111111112", "+442079460958", "243-555-5526", "DE89370400440532013000", "DE88370400440532013000", "plain", "x9", "2020", "3.14"]
    for _ in range(300):
        text = ", ".join(rng.choice(values) for _ in range(rng.randint(1, 9)))
        assert pii.pseudonymize(text, to)[0] == brute_find(text, to), text


def test_keys_are_the_callers(spark):
    with pytest.raises(ValueError):
        pii.Pseudonymizer(b"")
    spark.conf.unset(pii.KEY_SETTING)
    first = pii.session_key(spark)
    assert len(first) == 64 and pii.session_key(spark) == first
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert pii.session_key(spark) == b"mine"
    spark.conf.unset(pii.KEY_SETTING)


def test_memory_of_a_very_long_word_is_bounded(monkeypatch):
    model = L.UnigramModel.empty(["a", "b", "c", "d"])
    model.prob[:-1] *= np.random.default_rng(3).random(model.prob[:-1].shape)
    words = ["".join(random.Random(n).choices("etaoinshrdlué", k=n)) for n in (1, 3, 39, 40, 41, 80, 95, 400, 20_000)]
    tracemalloc.start()
    got = model.log_likelihoods(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000
    for span in (7, 1 << 20):
        monkeypatch.setattr(L, "_SPAN", span)
        assert np.array_equal(model.log_likelihoods(words), got)
