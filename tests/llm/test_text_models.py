"""Quality, language and lattice models, and the tokenizer, against brute force and held-out rows."""

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacantia.llm import langid, lattice, pieces, quality
from vacantia.llm import queries as q
from vacantia.llm._util import text_buffer, word_spans


def prose(rnd, letters, n):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n)).capitalize() + "."


def test_word_spans():
    texts = ["a  b", "", None, "\tx\x0b", "é y", "z"]
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    starts, ends, per = word_spans(data, offsets)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == ["a", "b", "x", "é", "y", "z"]
    assert per.tolist() == [2, 0, 0, 1, 2, 1]


def test_quality_learns_passages(spark):
    rnd = random.Random(1)
    good = [prose(rnd, "abcdeiost", rnd.randint(20, 300)) for _ in range(150)]
    bad = [t[:200] + " " + " | ".join(prose(rnd, "abcd", 1) for _ in range(80)) for t in good[:70]]
    model = quality.fit(good[:100] + bad[:50], [1] * 100 + [0] * 50)
    data, offsets = text_buffer(pa.array(good[100:] + bad[50:]))
    y, n, a = model.score(data, offsets)
    assert ((y >= 0.5) == np.array([1] * 50 + [0] * 20)).mean() > 0.95
    assert (n >= 1).all()
    docs = spark.createDataFrame([(1, good[0], 9), (2, None, 9), (3, "", 9), (4, "x" * 100_000, 9), (4, "y", 9)], "doc_id long, text string, score int")
    got = quality.score_quality(docs, model)
    assert got.columns == ["doc_id", "text", "score", "predicted", "n_passages", "max_attention"]
    rows = got.collect()
    assert len(rows) == 5
    assert all(0 <= r.score <= 1 for r in rows)
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_passage_attention_sums_to_one():
    model = quality.fit(["a b", "c d | e"], [1, 0], epochs=5)
    x, counts = quality.passages(*text_buffer(pa.array(["w " * 500, "x", ""])))
    f = model.forward((x - model.mean) / model.std, counts)
    starts = np.cumsum(counts) - counts
    assert np.allclose(np.add.reduceat(f["a"], starts), 1)


def test_forward_and_gradient_against_plain_version():
    """One bag at a time by loops, and the first step's direction by differences."""
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["alpha", "Beta,", "| x", "9", "é"]) for _ in range(rnd.randint(0, 300))) for _ in range(8)]
    labels = [i % 2 for i in range(8)]
    model = quality.fit(texts, labels, epochs=3)
    x, counts = quality.passages(*text_buffer(pa.array(texts)))
    x = (x - model.mean) / model.std
    got = model.forward(x, counts)["y"]
    sig = lambda v: 1 / (1 + np.exp(-v))
    for i, (a, n) in enumerate(zip(np.cumsum(counts) - counts, counts, strict=True)):
        h = [np.tanh(r @ model.p["E"] + model.p["e"]) for r in x[a : a + n]]
        score = [float(np.tanh(v @ model.p["V"]) * sig(v @ model.p["U"]) @ model.p["w"]) for v in h]
        w = np.exp(score) / np.exp(score).sum()
        assert got[i] == pytest.approx(float(sig(sum(k * v for k, v in zip(w, h, strict=True)) @ model.p["c"] + model.p["b"])))
    # Adam's first step moves every weight by the rate against the sign of its gradient
    before, after = quality.fit(texts, labels, epochs=0), quality.fit(texts, labels, epochs=1, decay=0.0)
    y = np.array(labels)
    loss = lambda m: -np.mean(y * np.log(m.forward(x, counts)["y"]) + (1 - y) * np.log(1 - m.forward(x, counts)["y"]))
    for name in ("E", "V", "U", "w", "c"):
        flat, moved = before.p[name].reshape(-1), after.p[name].reshape(-1)
        for k in range(0, flat.size, max(1, flat.size // 6)):
            kept, eps = flat[k], 1e-5
            flat[k] = kept + eps
            up = loss(before)
            flat[k] = kept - eps
            slope, flat[k] = (up - loss(before)) / (2 * eps), kept
            if abs(slope) > 1e-6:
                assert moved[k] - kept == pytest.approx(-0.01 * np.sign(slope), rel=0.05)


def test_constant_labels():
    data, offsets = text_buffer(pa.array(["x"]))
    assert quality.fit(["a", "b"], [1, 1]).score(data, offsets)[0][0] > 0.9
    assert quality.fit([], []).score(data, offsets)[0][0] == pytest.approx(0.5)


def test_language_model_is_a_distribution():
    """Probabilities of all characters after a seen context sum to nearly one."""
    rnd = random.Random(2)
    texts = [prose(rnd, "abcde", 30) for _ in range(40)] + [prose(rnd, "fghab", 30) for _ in range(40)]
    model = langid.fit(texts, ["x"] * 40 + ["y"] * 40)
    alphabet = np.array([ord(c) for c in "abcdefgh "], np.uint64)
    for a, b in [("a", "b"), (" ", "a"), ("g", "h")]:
        total = np.zeros(2)
        for c in alphabet:
            total += np.exp(model.log_probs(np.array([ord(a), ord(b), c], np.uint64))[0])
        assert (total < 1.0001).all()
        assert (total > 0.98).all()


def test_kneser_ney_against_plain_version():
    """Interpolated Kneser-Ney by dictionaries, for one language's trigrams, seen and unseen."""
    rnd = random.Random(12)
    texts = [prose(rnd, "abcd", 12) for _ in range(30)] + [prose(rnd, "bcde", 12) for _ in range(30)]
    model = langid.fit(texts, ["x"] * 30 + ["y"] * 30, calibrate=0.5)
    train = [t for i, t in enumerate(texts[:30]) if i % 2 == 0]
    plain = ["  " + "".join(c if c.isalpha() else " " for c in t.lower()) + " " for t in train]
    plain = ["  " + re.sub(" +", " ", t.strip()) + " " for t in plain]
    tri = Counter(t[k : k + 3] for t in plain for k in range(len(t) - 2))
    other = {t[k : k + 3] for i, u in enumerate(texts[30:]) if i % 2 == 0 for t in ["  " + re.sub(" +", " ", re.sub(r"[^a-z]", " ", u.lower()).strip()) + " "] for k in range(len(t) - 2)}
    bi, d = Counter(g[1:] for g in tri), langid.DISCOUNT
    uni = Counter(g[1] for g in bi)
    alphabet = len({g[2] for g in set(tri) | other}) + 1

    def p1(c):
        return max(uni[c] - d, 0) / sum(uni.values()) + d * len(uni) / sum(uni.values()) / alphabet

    def p2(b, c):
        own = {g: n for g, n in bi.items() if g[0] == b}
        return max(bi[b + c] - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * p1(c) if own else p1(c)

    def p3(a, b, c):
        own = {g: n for g, n in tri.items() if g[:2] == a + b}
        return max(tri[a + b + c] - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * p2(b, c) if own else p2(b, c)

    for g in ("abc", "bca", " ab", "dd ", "aae", "eab", "cd "):
        got = model.log_probs(np.array([ord(c) for c in g], np.uint64))[0][0]
        assert got == pytest.approx(math.log(p3(*g)), abs=1e-4)


def test_language_held_out(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, ("abcde", "fghab", "abxyz")[i % 3], 25), "xyz"[i % 3], 0.5) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    texts, langs = langid.sample_labelled(docs, F.col("doc_id") % 2 == 0, "doc_id", "text", "lang", 60)
    assert set(langs) == set("xyz")
    got = langid.identify(docs, langid.fit(texts, langs)).where("doc_id % 2 = 1").collect()
    assert np.mean([r.lang_pred == "xyz"[r.doc_id % 3] for r in got]) > 0.95
    odd = spark.createDataFrame([(1, None, "x", 0.0), (2, "123 %%", None, 0.0), (3, "", "x", 0.0), (None, "abc" * 50_000, "x", 0.0)], docs.schema)
    found = {r.doc_id: r for r in langid.identify(odd, langid.fit(texts, langs)).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert [found[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert found[None].lang_pred in "xyz"
    none = langid.fit(*langid.sample_labelled(odd.limit(0), F.lit(True), "doc_id", "text", "lang", 5))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


def brute_marginal(names, logp, word):
    text = lattice.MARK + word
    alpha = [0.0] + [-math.inf] * len(text)
    table = dict(zip(names, logp, strict=True))
    for j in range(1, len(text) + 1):
        terms = [alpha[i] + table[text[i:j]] for i in range(j) if text[i:j] in table]
        alpha[j] = np.logaddexp.reduce(terms) if terms else -math.inf
    return alpha[-1]


def test_marginals_equal_brute_force():
    names, p = lattice.vocabulary(q.piece_model())
    assert p.sum() == pytest.approx(1)
    model = lattice.build(names, p, 0.01)
    words = [b"the", b"a", "naïve".encode(), b"|", b"zz\x00\xff", b"x" * 90, b"thntblere", b"w"]
    data, offsets = lattice._marked(words)
    got, expected = model.solve(data, offsets, np.ones(len(words)))
    logp = np.log(p * 0.99)
    assert got == pytest.approx([brute_marginal(names, logp, w) for w in words])
    # every byte is covered once by the expected pieces
    assert (expected * np.array([len(n) for n in names])).sum() == pytest.approx(sum(len(w) + 1 for w in words))


def test_long_words_in_blocks(monkeypatch):
    """A word solved block by block has the marginal and the expected pieces that it has whole."""
    rnd = random.Random(8)
    names, p = lattice.vocabulary(q.piece_model())
    model = lattice.build(names, p, 0.01)
    words = ["".join(rnd.choice("abcdeéñ") for _ in range(n)).encode() for n in (3, 400, 901, 256, 1500)] + [b"the" * 300]
    data, offsets = lattice._marked(words)
    weight = np.arange(1.0, len(words) + 1)
    want = model.solve(data, offsets, weight)
    monkeypatch.setattr(lattice, "LONG", 128)
    got = model.solve(data, offsets, weight)
    assert got[0] == pytest.approx(want[0])
    assert np.allclose(got[1], want[1])


def test_scores_equal_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i, prose(rnd, "abcde", rnd.randint(0, 40)), 1) for i in range(80)] + [(100, None, 1), (101, "", 1), (102, "NEW Words new", 1), (103, "q" * 50_000, 1), (104, "a\tb", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c int")
    got = {r.doc_id: r for r in lattice.score_texts(docs, q.piece_model(), F.col("doc_id") % 4 != 0).collect()}
    words = {i: (t or "").encode().lower().split() for i, t, _ in rows}
    count = Counter(w for i, ws in words.items() if i % 4 for w in ws)
    n_docs = sum(1 for i in words if i % 4)
    total, distinct = sum(count.values()) + n_docs, len(count) + 1
    score = lambda c: math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    for i, ws in words.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws) + 1, sum(w in count for w in ws) + 1, total)
        assert got[i].base_score == pytest.approx(sum(score(count[w]) for w in ws) + score(n_docs))
        assert got[i].score <= 0 and math.isfinite(got[i].score)
    by_words = lambda i: got[i].score - got[101].score
    assert got[101].score == pytest.approx(score(n_docs))
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values()) - 50_000 * 8
    # a word is its own edge and its pieces: all pieces fitted by one pass over the training words
    names, p = lattice.vocabulary(q.piece_model())
    known = sorted(count)
    fitted = lattice.build(names, p, 0.01).solve(*lattice._marked(known), np.array([count[w] for w in known], float))[1]
    p = (np.round(fitted, 6) + 100 * p) / (fitted.sum() + 100)
    model = lattice.build(names, p / p.sum(), n_docs / (n_docs + fitted.sum() + 1))
    for i in (3, 17, 102, 104):
        z = model.solve(*lattice._marked(words[i]))[0]
        want = sum(math.log10(count[w] / (total + distinct) + distinct / (total + distinct) * math.exp(x)) for w, x in zip(words[i], z, strict=True))
        assert by_words(i) == pytest.approx(want, rel=1e-5)
    assert by_words(104) < 0
    assert lattice.score_texts(docs.limit(0), q.piece_model(), F.lit(True)).count() == 0


def test_fragments_send_sums_of_documents_with_words_in_them(spark):
    """The sums follow the words of the documents, not their number times that of the fragments."""
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{rnd.randint(0, 3000)}" for _ in range(i % 6))) for i in range(600)]
    docs = spark.createDataFrame(rows, "row long, text string").coalesce(1)
    names, p = lattice.vocabulary(q.piece_model())
    words = lattice.count_words(docs.withColumn("train", F.col("row") % 3 != 0))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return lattice._join_fragment(1000, 700, batches)

    found = {}
    for fragments in (2, 500):
        packed = lattice._vocabulary_rows(words, lattice.build(names, p, 0.01), fragments).unionByName(lattice._document_rows(docs, fragments))
        joined = packed.groupBy("frag").applyInArrow(join, "owner long, ids binary, sums binary").cache()
        sent = joined.agg(F.sum(F.octet_length("sums"))).first()[0]
        assert sent <= 22 * sum(len(set(t.split())) for _, t in rows)
        found[fragments] = {r.row: (r.words, r.known, r.base, r.lattice) for r in joined.groupBy("owner").applyInArrow(lattice._add_up, "row long, words long, known long, base double, lattice double").collect()}
    assert len(found[2]) == len(rows)
    for i, t in rows:
        assert found[500][i] == pytest.approx(found[2][i]) and found[2][i][0] == len(t.split())


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id long, text string")
    got = lattice.score_texts(docs, q.piece_model(), F.lit(True)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 3), (1, 3)]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(q.piece_model())


def hard_texts():
    rnd = random.Random(8)
    alpha = " \n\t▁ab é😀中́.,  "
    return ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 14))) for _ in range(1500)] + ["", " ", "\n", "▁", "a ", "\n a", "x" * 30_000, "the quick  brown\n\nfox "]


def test_ids_equal_the_library(model):
    texts = hard_texts()
    ids, offsets = model.encode_batch(texts)
    want = [x + [model.eos] for x in model.sp.encode(texts)]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want


def test_small_cache(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 30)
    small = pieces.Pieces(q.piece_model())
    texts = hard_texts()[:400]
    for at in range(0, 400, 40):
        ids, offsets = small.encode_batch(texts[at : at + 40])
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [x + [2] for x in small.sp.encode(texts[at : at + 40])]


def test_spans_tile_the_source(model):
    for text in hard_texts():
        ids, _ = model.encode_batch([text])
        begins, ends = model.spans(text, ids)
        data, at = text.encode(), 0
        for i, (a, b) in zip(ids.tolist(), zip(begins.tolist(), ends.tolist(), strict=True), strict=True):
            assert a <= b
            assert a <= at
            at = b
            piece = model.sp.id_to_piece(i)
            if i > 258 and "▁" not in piece:
                assert data[a:b].decode() == piece
        assert at == len(data)


def test_character_map_against_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(normalizer.serialized_model_proto())
    table = pieces.CharsMap(proto.normalizer_spec.precompiled_charsmap)
    for text in ["ＡＢｃ①  x", "ｶﾞギ", "plain", "é", "ﬁne ½", "中文㍿", ""]:
        steps = list(table.steps(text.encode()))
        assert b"".join(s[0] for s in steps).decode() == normalizer.normalize(text)
        assert [s[1] for s in steps][1:] == [s[2] for s in steps][:-1]


def test_encode_frame(spark):
    docs = spark.createDataFrame([(1, "the fox", 5), (2, None, 5), (2, "", 5), (None, "x", 5)], "doc_id long, text string, ids int")
    got = pieces.encode(docs, q.piece_model())
    assert got.columns == ["doc_id", "ids", "begins", "ends"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[2].ids == [2]
    assert rows[1].ends[-1] == 7
    back = {r.doc_id: r.text for r in pieces.decode(got, q.piece_model()).collect()}
    assert back[1] == "the fox"
    assert q.token_digests(docs.limit(0)).count() == 0


def test_labelled_sample_is_bounded(spark):
    """An id in most of the rows, with several labels and texts, is one row of the sample."""
    docs = spark.createDataFrame([(1, f"copy {i:03d}") for i in range(300)] + [(2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    got = quality.sample_labelled(docs, labels, F.lit(True), "doc_id", "text", "quality", 10)
    assert got == (["copy 000", ""], [1, 0])
