"""Mixing against numpy: features, posteriors, rates, totals at their targets, and the draw."""

import math
import re
import unicodedata

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from airsignal.llm import mixing
from airsignal.llm import queries as Q
from airsignal.llm.common import crc_mod, first_ids_per, table
from tests.conftest import SF, SF01
from tests.llm.conftest import EDGES


SPACES = re.compile(r"[ \t-\r]+")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def brute_features(text):
    """(tokens, buckets, statistics) of a text, by plain Python."""
    text = text or ""
    words = []
    for w in SPACES.split(text.lower()):
        words += [x for x in re.sub(f"({mixing.UNSPACED})", r"\1 ", w).split(" ") if x]
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in h]
    size = max(1, len(text))
    runs, run = 0, 0
    for c in text + "a":
        run, runs = (run + 1, runs) if c in PUNCTUATION else (0, runs + (run >= 2))
    share = lambda n: math.sqrt(n / size)
    stats = {"words": math.log1p(len(h)), "distinct": math.log1p(len(set(h))), "lines": math.log1p(len(text.split("\n"))),
             "distinct_lines": math.log1p(len(set(text.split("\n")))), "length": math.log(size / max(1, len(h))),
             "symbols": share(sum(c in "#$%&*+/<=>@[]\\^_`{|}~" for c in text)), "marks": share(runs),
             "capitals": share(sum(unicodedata.category(c) == "Lu" for c in text)), "digits": share(sum(c in "0123456789" for c in text))}
    return len([t for t in SPACES.split(text) if t]), [x % mixing.BUCKETS for x in signed], [stats[c] for c in mixing.STATISTICS]


def brute_posterior(text, model):
    tokens, b, stats = brute_features(text)
    if not b:
        return tokens, model.shares
    z = np.clip((np.array(stats) - model.mean) / model.scale, -mixing._FAR, mixing._FAR)
    per = min(1.0, len(set(brute_words(text))) / mixing.VARIED) / len(b)
    s = model.bias + model.words[:, b].sum(axis=1) * per + model.single @ z + model.pairs @ np.array([z[i] * z[j] for i, j in mixing._PAIRS])
    e = np.exp(s - s.max())
    return tokens, e / e.sum()


def brute_words(text):
    return [x for w in SPACES.split((text or "").lower()) for x in re.sub(f"({mixing.UNSPACED})", r"\1 ", w).split(" ") if x]


def brute_rates(p, t, targets, most=None):
    """Projected gradient steps in numpy."""
    natural = (p * t[:, None]).sum(axis=0)
    rate, now = np.ones(len(t)), natural
    for _ in range(mixing.STEPS):
        if (np.abs(now - targets) <= mixing.TOLERANCE * np.maximum(targets, 1)).all():
            break
        rate = np.clip(rate - p @ ((now - targets) / np.maximum(natural, 1e-9)), 0, most)
        before, now = now, (rate * t) @ p
        if (np.abs(now - before) <= mixing.STILL * np.maximum(before, 1)).all():
            break
    return rate


@pytest.mark.parametrize("most", [None, 1.0])
def test_against_numpy(spark, most):
    """Features, scores and rates of whole texts recomputed without Spark; only the learned weights are taken over."""
    docs = table(spark, SF, "documents")
    labelled = Q.domains(docs, table(spark, SF, "labels"))
    model = mixing.learn(docs, labelled)
    wanted = Q.MIX_TARGETS if most is None else {"low": 0.05}
    got = {r.doc_id: r for r in mixing.mix(docs, labelled, wanted, most=most, hold_rest=most is not None).collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = [brute_posterior(t, model) for _, t in rows]
    t, p = np.array([n for n, _ in found], float), np.array([q for _, q in found])
    for (i, _), (tokens, q) in zip(rows, found):
        assert got[i].tokens == tokens and got[i].posterior == pytest.approx(q.max(), rel=1e-4) and got[i].domain == model.domains[q.argmax()]
    targets = np.array(mixing.target_totals((p * t[:, None]).sum(axis=0).tolist(), model.domains, wanted, None, most is not None))
    rate = np.array([got[i].rate for i, _ in rows])
    assert rate == pytest.approx(brute_rates(p, t, targets, most), abs=2e-3) and (rate >= 0).all()
    if most is None:
        assert (rate * t) @ p == pytest.approx(targets, rel=0.02)
    else:
        assert rate.max() <= most


def test_features_by_definition(spark, edges):
    rows = mixing.word_features(edges.withColumn("text", F.coalesce("text", F.lit(None)))).select("*").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, text, _ in EDGES:
        tokens, b, stats = brute_features(text)
        assert any(r.tokens == tokens and list(r.b) == b and [r[c] for c in mixing.STATISTICS] == pytest.approx(stats) for r in by[i]), text


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word two three. " * 400_000), (2, "日本" * 300_000), (3, "x" * 3_000_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in mixing.mix(docs, spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, domain string"), {"a": 0.5}).collect()}
    assert rows[1].tokens == 1_200_000 and rows[2].tokens == rows[3].tokens == 1 and all(0 < r.posterior <= 1 for r in rows.values())


def test_targets():
    assert mixing.target_totals([10, 30, 60], ["a", "b", "c"], {"c": 0.1}, None) == pytest.approx([22.5, 67.5, 10])
    assert mixing.target_totals([10, 30], ["a", "b"], {"a": 1, "b": 3}, 80) == pytest.approx([20, 60])
    assert mixing.target_totals([10, 30, 60], ["a", "b", "c"], {"c": 0.2}, None, hold_rest=True) == pytest.approx([10, 30, 10])
    assert mixing.target_totals([0, 0], ["a", "b"], {}, None) == pytest.approx([0, 0])


def test_edges(spark, edges, empty):
    labelled = spark.createDataFrame([(1, "en"), (8, "de"), (2, "en"), (8, "fr"), (None, "en"), (9, None)], "doc_id long, domain string")
    rows = mixing.mix(edges, labelled, {"en": 0.5, "de": 0.5, "elsewhere": 1.0}).collect()
    assert len(rows) == len(EDGES) and all(r.rate >= 0 and 0 < r.posterior <= 1 and r.domain in ("en", "de") for r in rows)
    none = mixing.mix(edges, labelled.where("false"), {"en": 1.0}).collect()
    assert all(r.rate == 1 and r.domain is None for r in none) and len(none) == len(EDGES)
    assert mixing.mix(empty, labelled, {"en": 1.0}).count() == 0


def test_draw(spark, edges):
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text", "1 as rate", "2 as __copy_of")
    rates = spark.range(4000).selectExpr("id as doc_id", "case when id < 1000 then 0.0D when id < 2000 then 1.0D when id < 3000 then 2.0D else 0.5D end as rate")
    drawn = mixing.draw(docs, rates)
    assert drawn.columns == docs.columns
    n = {k: v for k, v in drawn.selectExpr("doc_id div 1000 as k").groupBy("k").count().collect()}
    assert 0 not in n and n[1] == 1000 and n[2] == 2000 and 400 < n[3] < 600
    assert mixing.draw(edges, rates.where("false")).count() == len(EDGES)


def test_labelled_shares_reach_the_targets(spark):
    """By words, learned without a fifth of the labels: low quality of any kind is found there, and the labels' tokens come to the targets."""
    docs = table(spark, SF01, "documents")
    labelled = Q.domains(docs, table(spark, SF01, "labels")).withColumn("held", crc_mod("doc_id", 5) == 0)
    true = {r.doc_id: r for r in labelled.collect()}
    got = mixing.mix(docs, labelled.where("not held"), Q.MIX_TARGETS).collect()
    own = [(true[r.doc_id], r) for r in got if r.doc_id in true]
    low = [r for t, r in own if t.held and t.domain == "low"]
    assert len(low) >= 5 and sum(r.domain == "low" for r in low) >= 0.9 * len(low)
    assert sum(t.domain == r.domain for t, r in own if t.held) >= 0.95 * sum(t.held for t, _ in own)
    share = sum(r.rate * r.tokens for t, r in own if t.domain == "low") / sum(r.rate * r.tokens for _, r in own)
    natural = sum(r.tokens for t, r in own if t.domain == "low") / sum(r.tokens for _, r in own)
    predicted = sum(r.tokens for r in got if r.domain == "low") / sum(r.tokens for r in got)
    # labels are a part of the table: their share is held against the target as the whole table's low share differs from theirs
    assert share == pytest.approx(Q.MIX_TARGETS["low"] * natural / predicted, rel=0.2)


def test_repeats_and_other_domains(spark):
    """Repeated words and lines are low whatever the word; domains that the probes do not know are told apart, spaces or not."""
    rng = np.random.default_rng(5)
    words = {"it": "il la che non per una sono anche della con".split(), "nl": "het een van niet dat zijn voor ook maar door".split()}
    chars = {"ja": "あいうえおかきくけこ日本語", "zh": "的一是不了人我在有他这中大来"}
    rows, known = [], []
    for k in range(400):
        kind = ["it", "nl", "ja", "zh", "low"][k % 5]
        base = kind if kind != "low" else ["it", "nl"][k // 5 % 2]
        if base in chars:
            text = "".join(rng.choice(list(chars[base]), 60)) + "。"
        else:
            fill = lambda n: [*rng.choice(words[base], n), *("".join(rng.choice(list("abcdefgilmnoprstuv"), 6)) for _ in range(n))]  # noqa: B023, E731
            text = " ".join(rng.permutation(fill(30))) if kind != "low" else [f"{rng.permutation(fill(1))[0]} " * 60, (" ".join(fill(3)) + "\n") * 10][k // 10 % 2]
        rows.append((k, text))
        known.append((k, kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([r for r in known if r[0] < 300], "doc_id long, domain string")
    got = {r.doc_id: r for r in mixing.mix(docs, labelled, {"low": 0.02}, hold_rest=True).collect()}
    wrong = [(k, d, got[k].domain, round(got[k].posterior, 2)) for k, d in known if got[k].domain != d]
    assert not wrong, wrong
    assert max(got[k].rate for k, d in known if d == "low") < 0.5


def test_sample_of_every_label(spark):
    ids = spark.range(30000).selectExpr("id as doc_id", "case when id % 10000 = 7 then 'few' else 'many' end as domain")
    rows, counts = first_ids_per(ids.unionByName(ids), 500, "domain")
    assert counts == {"few": 3, "many": 29997}
    assert {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()} == {"few": 3, "many": 500}
