import random

import numpy as np
from tokenizers import Tokenizer

from strandline.llm import common
from strandline.llm import packing as P


def test_ids_equal_the_tokenizers(documents):
    texts = [r.text for r in documents.select("text").limit(60).collect()]
    texts += ["Don't STOP,here's  é é ΣΑΣ", "<|endoftext|> x<|startoftext|>y", "a\x1cb \x01 c\x01d", "", None, "İI ²³ №5 “q”…", "word." * 50, "X.Y,Z;!?"]
    tok = Tokenizer.from_file(P.VOCABULARY)
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert P.encode_texts(texts) == want
    assert P.encode_texts(texts) == want  # from the cache


def test_words_and_tails_in_every_letter_have_the_tokenizers_ids():
    letters = [chr(c) for c in range(0x21, 0x600)] + ["ﬁ", "K", "Å", "ẞ", "ｗ"]
    texts = [f"{a} x{a} {a}x ab{a}cd AB{a}! {a}{a}" for a in letters]
    texts += [f"word{t} Wörd{t} x9{t}" for t in (*P._TAIL.decode(), "***", "$$$", "'", "'s", "|>", ").", "_a_", "e\u0301", "-'ll")] + ["<|endoftext|>. a<|endoftext|>&& <|endoftext|"]
    tok = Tokenizer.from_file(P.VOCABULARY)
    assert P.encode_texts(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_words_of_letters_go_to_the_merges_at_once():
    tok, seen = Tokenizer.from_file(P.VOCABULARY), []

    class Spy:
        model, encode, encode_batch = tok.model, tok.encode, None

        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return tok.encode_batch_fast(texts, **options)

    words = [b"sheratntha", "Straße".encode(), b"x1", "İx".encode()]
    got = P._encode_chunks(words, Spy())
    assert seen == ["x1 \x01 İx"]
    assert got == {w: np.array(tok.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in words}


def test_full_cache(documents, monkeypatch):
    texts = [r.text for r in documents.select("text").limit(20).collect()]
    want = P.encode_texts(texts)
    common._held.clear()
    monkeypatch.setattr(P, "_CACHE_ROWS", 0)
    assert P.encode_texts(texts) == want


def test_best_fit_and_bound():
    rng = random.Random(2)
    for _ in range(60):
        cap = 50
        w = np.array([rng.randint(1, cap) for _ in range(rng.randint(1, 60))])
        bins, offset, fill = P.best_fit_decreasing(w, cap)
        assert fill.max() <= cap and np.bincount(bins, w).tolist() == fill.tolist()
        for b in set(bins.tolist()):
            own = sorted(zip(offset[bins == b].tolist(), w[bins == b].tolist()))
            assert own[0][0] == 0 and all(a + n == c for (a, n), (c, _) in zip(own, own[1:]))
        assert P.lower_bound(np.bincount(w, minlength=cap + 1), cap) <= len(fill)


def test_bound_beats_the_sum():
    w = np.array([26] * 10)  # no two fit together
    assert P.lower_bound(np.bincount(w, minlength=51), 50) == 10


def pieces_of(rows):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    return seqs


def test_exchange_reaches_the_bound(spark, documents):
    items = P.token_pieces(documents, 4096).selectExpr("monotonically_increasing_id() uid", "length").collect()
    df = spark.createDataFrame([(r.uid, r.length) for r in items], "uid long, length long")
    got = P.pack(df, group_rows=60).collect()
    assert sorted(r.uid for r in got) == sorted(r.uid for r in items)
    bound = P.lower_bound(np.bincount([r.length for r in items], minlength=4097))
    assert bound <= len({r.sequence_id for r in got}) <= bound + 1


def test_round_trip(spark, odd_docs, no_docs):
    rows = P.pack_documents(odd_docs, 100).collect()
    tok = Tokenizer.from_file(P.VOCABULARY)
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = sorted(str((d, tok.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in texts)
    back = []
    one = {}
    for r in rows:
        one.setdefault(r.doc_id, []).append((r.start, list(np.frombuffer(r.ids, "<u4"))))
    for d, parts in one.items():
        copies = sum(1 for i, _ in texts if i == d)
        starts = sorted({s for s, _ in parts})
        ids = [int(x) for s in starts for x in next(p for q, p in parts if q == s)]
        back += [str((d, ids))] * copies
        assert len(parts) == copies * len(starts)
    assert sorted(back) == want
    for own in pieces_of(rows).values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= 100
    assert P.pack_documents(no_docs).count() == 0


def test_digest_is_of_the_ids(spark, documents):
    import zlib

    some = documents.limit(30)
    ids = {(r.doc_id, r.piece): zlib.crc32(bytes(r.ids)) for r in P.token_pieces(some).collect()}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in P.packing_digest(some).collect()} == ids


def totals(df, **options):
    out, sequences, bound = P.pack_certified(df, **options)
    rows = out.collect()
    assert len({r.sequence_id for r in rows}) == sequences
    return rows, sequences, bound


def test_certified_groups_freeze(spark, monkeypatch):
    """Groups that meet their bound give back one bin at most; only what gaps leave is packed again."""
    rng = np.random.default_rng(7)
    lengths = np.clip(rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1, 1, 4096)
    df = spark.createDataFrame([(i, int(w)) for i, w in enumerate(lengths)], "uid long, length long")
    seen, real = [], P._pack_groups

    def spy(items, groups, turn, capacity):
        out = real(items, groups, turn, capacity)
        seen.append((items.count(), groups, out.filter("certified AND NOT final").select("seq").distinct().count(), out.filter("certified").selectExpr("seq >> 24").distinct().count()))
        return out

    monkeypatch.setattr(P, "_pack_groups", spy)
    rows, sequences, bound = totals(df, group_rows=1000)
    assert sorted(r.uid for r in rows) == list(range(20_000)) and bound <= sequences <= bound + 5
    assert len(seen) > 1 and seen[1][0] < 0.3 * seen[0][0]
    assert all(loose <= certified for _, _, loose, certified in seen)


def test_a_packing_without_certificate_ends(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate([1400, 1400, 1300, 2000] * 300)], "uid long, length long")
    rows, sequences, bound = totals(df, group_rows=100)
    assert len(rows) == 1200 and bound <= sequences <= 560
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, [1400, 1400, 1300, 2000][r.uid % 4]))
    for own in fill.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 4096


def test_nothing_to_pack(spark):
    assert totals(spark.createDataFrame([], "uid long, length long")) == ([], 0, 0)
