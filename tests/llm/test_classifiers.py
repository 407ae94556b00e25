"""The three classifiers: exactness of the scoring shortcuts, held-out results, awkward rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from airsignal.llm import language, quality, toxicity
from airsignal.llm import queries as Q
from airsignal.llm.common import Powers, table
from tests.conftest import SF01
from tests.llm.conftest import EDGES


def auc(score, label):
    pos, neg = [s for s, y in zip(score, label) if y == 1], [s for s, y in zip(score, label) if y == 0]
    return np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])


def held(query, spark, truth):
    rows = [r for r in query(spark, SF01).collect() if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    return rows


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in table(spark, SF01, "labels").collect()}


# ---- toxicity -----------------------------------------------------------------------------------

INSULTS = ["idiot", "clown", "stupid", "scoundrel"]


@pytest.fixture(scope="module")
def toxic_model():
    rng = np.random.default_rng(0)
    syllables = ["an", "the", "ing", "or", "ti", "re", "nd", "es", "ou", "st", "ha", "wh", "le"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    texts, labels = [], []
    for k in range(400):
        words = [word() for _ in range(60)]
        if k % 4 == 0:
            words[int(rng.integers(60))] = INSULTS[k // 4 % 4]
        texts.append(" ".join(words) + ".")
        labels.append(int(k % 4 == 0))
    return toxicity.train(texts, labels, landmarks=128)


def kernel(a: bytes, b: bytes) -> float:
    """Subsequence kernel by definition: all common letter sequences with their spans."""
    def features(w):
        out, c = {}, toxicity.CODE[np.frombuffer(w, np.uint8)]
        from itertools import combinations
        for at in combinations(range(len(w)), toxicity.LETTERS):
            if at[-1] - at[0] <= toxicity.SPAN and all(c[i] for i in at):
                u = tuple(c[i] for i in at)
                out[u] = out.get(u, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out
    x, y = features(a), features(b)
    return sum(v * y.get(u, 0) for u, v in x.items()) / toxicity.REACH[len(a)] / toxicity.REACH[len(b)]


def test_kernel_and_folded_weights():
    marks = [b"idiot", b"stupid", b"wordless", b"abcabcabc"]
    lm = toxicity._Landmarks(marks)
    words = [b"idiot", b"id*iot", b"xxidiotxx", b"stupidity", b"abc", b"abcabc"]
    want = np.array([[kernel(w, m) for m in marks] for w in words])
    assert np.allclose(lm.against(words), want, atol=1e-5)
    alpha = np.array([0.5, -1.0, 2.0, 0.3])
    data = np.frombuffer(b" ".join(words), np.uint8)
    start, end, _ = toxicity.cut_words(data, np.array([0, len(data)]))
    assert np.allclose(toxicity.word_sums(data, start, end, lm.folded(alpha)), want @ alpha, atol=1e-4)


def test_gaps_and_inserted_characters(toxic_model):
    p = lambda t: float(toxicity.probabilities(toxicity.decisions(pa.array([t]), toxic_model), toxic_model)[0])
    clean = p("The other thing and one.")
    for w in INSULTS:
        assert p(f"The {w} and.") > 0.5 > clean
        assert p(f"The {' '.join(w)} and.") > 0.5, w  # spaced out
        assert p(f"The {w[:2] + w[1:]} and.") > 0.5, w  # a letter doubled
        for k in range(1, len(w)):
            assert p(f"The {w[:k]}*{w[k:]} and.") > 0.5, w  # a character inserted
        for form in (f"http://the.or/{w}-and.html", f"the-{w}_and", f"{'-'.join(w)}", f"theor{w}ingre" + "and" * 12 if len(w) < 7 else w):
            assert p(f"The {form} and.") > 0.5, form  # in a url, between signs, in a long run of letters


def test_production_model_finds_inserted_characters(spark):
    """The query's model on its own toxic words: with a character inserted anywhere they still pass 0.5, and clean words with signs in them do not."""
    from airsignal.llm.common import crc_mod

    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    model = toxicity.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    p = lambda t: float(toxicity.probabilities(toxicity.decisions(pa.array([t]), model), model)[0])
    known = [w for w in ("idiot", "stupid", "clown", "scoundrel", "moron", "loser") if p(f"the {w} and") > 0.5]
    assert len(known) >= 3
    missed = [(w, k) for w in known for k in range(1, len(w)) if p(f"the {w[:k]}*{w[k:]} and") <= 0.5]
    assert not missed, missed
    clean = [p(f"the {w[:2]}*{w[2:]} and-the.other/thing") for w in ("thing", "other", "nation", "there", "station", "within")]
    assert max(clean) < 0.5


def test_long_words_overlap():
    start, end, _ = toxicity.windowed(np.array([0, 5]), np.array([5, 105]), np.array([0, 0]))
    assert (end - start)[1:].tolist() == [toxicity.WINDOW] * (len(start) - 1) and end[-1] == 105
    for a in range(5, 105 - 9 + 1):  # every word of 9 letters is whole in one window
        assert any(s <= a and a + 9 <= e for s, e in zip(start, end))


def test_sums_of_overlapping_words():
    rng = np.random.default_rng(0)
    data = np.frombuffer(b"some words and a much longerwordthanothers i-s-h", np.uint8)
    weight = rng.normal(size=toxicity.SIZE).astype(np.float32)
    start, end, _ = toxicity.cut_words(data, np.array([0, len(data)]))
    assert np.allclose(toxicity.word_sums(data, start, end, weight), toxicity.word_sums_of(data, start, end, weight), atol=1e-4)


def test_toxicity_held_out(spark, labels):
    rows = held(Q.op6_toxicity, spark, labels)
    assert auc([r.score for r in rows], [labels[r.doc_id].toxic for r in rows]) > 0.75
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_edges(spark, edges, empty, toxic_model):
    rows = toxicity.score(edges, toxic_model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1 and len({r.score for r in rows if r.doc_id == 2}) == 1
    assert toxicity.score(empty, toxic_model).count() == 0 and toxicity.drop_toxic(empty, toxic_model).count() == 0
    kept = toxicity.drop_toxic(edges, toxic_model)
    assert kept.columns == edges.columns and kept.count() == sum(r.score < 0.5 for r in rows)
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 1e-9 for r in toxicity.score(edges, toxicity.fit(edges, no_labels)).collect())


def test_slices_do_not_change_scores(toxic_model, monkeypatch):
    texts = pa.array(["thing and " * 300 + "idiot " + "or the " * 300, "", None, "le re " * 100])
    whole = toxicity.decisions(texts, toxic_model)
    from airsignal.llm import common
    monkeypatch.setattr(common.byte_pieces, "__defaults__", (500,))
    assert np.allclose(toxicity.decisions(texts, toxic_model), whole, atol=1e-4)


# ---- quality ------------------------------------------------------------------------------------


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    x, m = rng.random((5, 12)), quality.Model(0.3, rng.normal(size=12), rng.normal(size=(12, 4)))
    pairs = [0.3 + r @ m.weight + sum(m.factor[i] @ m.factor[j] * r[i] * r[j] for i in range(12) for j in range(i + 1, 12)) for r in x]
    assert np.allclose(quality.decisions(x, m), pairs)


def test_quality_held_out(spark, labels):
    rows = held(Q.op7_quality, spark, labels)
    truth = [labels[r.doc_id].quality for r in rows]
    assert auc([r.score for r in rows], truth) > 0.95
    assert np.mean([r.predicted == y for r, y in zip(rows, truth)]) > 0.93
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_edges(spark, edges, empty):
    x = quality.features(pa.array([t for _, t, _ in EDGES], pa.string()), Powers())
    assert np.isfinite(x).all() and x.shape == (len(EDGES), quality.BUCKETS + len(quality.STATISTICS))
    labels = spark.createDataFrame([(1, 1), (6, 0), (8, 1), (9, 0)], "doc_id long, quality int")
    rows = quality.score(edges, quality.fit(edges, labels)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    one = quality.score(edges, quality.fit(edges, labels.where("quality = 1"))).collect()
    assert all(r.score > 0.99 for r in one)
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0


def test_quality_slices(monkeypatch):
    texts = pa.array(["One two THREE | four. " * 200, None, "word word " * 90])
    whole = quality.features(texts, Powers())
    from airsignal.llm import common
    monkeypatch.setattr(common.byte_pieces, "__defaults__", (700,))
    assert np.allclose(quality.features(texts, Powers())[:, quality.BUCKETS:], whole[:, quality.BUCKETS:], atol=0.05)


# ---- language -----------------------------------------------------------------------------------


def test_presence_kernel():
    def grams(t):
        c, out = language.FOLD[np.frombuffer(t.encode(), np.uint8)].tolist(), set()
        for i in range(len(c)):
            for n in range(1, language.LONGEST + 1):
                g = c[i:i + n]
                g = ((g[:g.index(0)] if 0 in g else g) + [0] * n)[:n]
                if g[0] and (n < 2 or g[1]):
                    out.add((n, *g))
        return out
    a, b = "the cat", "the hat"
    x = language.presence(pa.array([a, b]), 1 << 16)
    ga, gb = grams(a), grams(b)
    assert float(x[0] @ x[1]) == pytest.approx(len(ga & gb) / np.sqrt(len(ga) * len(gb)), abs=0.03)


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in table(spark, SF01, "documents").collect()}
    rows = [r for r in Q.op8_language(spark, SF01).collect()]
    assert len(rows) == len(truth)
    out = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.95


def test_seldom_and_long_languages_are_learned(spark):
    """At any size of the table: 4 rows among 20,000, and a language whose texts are all long."""
    rows = [(k, "the cat and the dog are in the house " * 2, "en") for k in range(20000)] + [(30000 + k, "il gatto e la casa sono nel giardino " * 2, "it") for k in range(4)]
    rows += [(40000 + k, "een hond het huis niet voor ook maar " * 400, "nl") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.langs == ["en", "it", "nl"]
    got, _ = language.predict(pa.array(["il gatto e la casa", "een hond het huis", "the dog"]), model)
    assert got == ["it", "nl", "en"]


def test_sparse_kernel_values():
    texts = pa.array(["the cat and the hat", "", None, "une maison", "x" * 50])
    z = np.random.default_rng(0).random((language.GRAMS, 7)).astype(np.float32)
    assert np.allclose(language.kernel_values(texts, z), language.presence(texts) @ z, atol=1e-5)


def test_long_texts_of_other_languages_stay_apart():
    """Tens of thousands of different words: presence does not fill the buckets."""
    rng = np.random.default_rng(1)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(3, 9)))
    long = {v: " ".join(word(a) for _ in range(15000)) for v, a in (("one", "abcdefghijklmn"), ("two", "ghijklmnopqrst"))}
    model = language.train([" ".join(t.split()[i:i + 40]) for t in long.values() for i in range(0, 2000, 40)], [v for v in long for _ in range(50)])
    got, _ = language.predict(pa.array(list(long.values())), model)
    assert got == ["one", "two"]


def test_language_edges(spark, edges, empty):
    model = language.train(["the cat and the dog " * 5, "der hund und die katze " * 5, "le chat et les chiens " * 5], ["en", "de", "fr"])
    rows = {r.doc_id: r for r in language.identify(edges, model).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 5, 9))
    assert rows[8].lang_pred == "de" and rows[1].lang_pred in ("en", "de", "fr")
    assert language.identify(empty, model).count() == 0
    none = language.fit(edges.where("lang is null"))
    assert {r.lang_pred for r in language.identify(edges, none).collect()} == {"und"}
