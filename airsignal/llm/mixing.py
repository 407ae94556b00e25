"""Mixing to target weights with soft memberships. DataFrame functions only.

1. Features, of whole texts: the frequencies of the words in ``BUCKETS`` hash buckets, and statistics of words, distinct words, lines,
   distinct lines, symbols, runs of marks, capitals and digits with their products (``STATISTICS``).
2. Classifier from the labelled table (doc_id, domain): a softmax regression on up to ``SAMPLE_ROWS`` labelled rows of each domain, drawn by a
   hash of doc_id and weighted back to the domain's share of the labelled rows.
3. Rates: every document gets a rate >= 0 (and at most ``most``, if given), the expected number of times it is drawn. Rates minimise the squared
   differences between the expected tokens of each domain (sum of rate x tokens x posterior) and the domain's target, from rate 1
   on, by projected gradient steps: one distributed aggregation of as many numbers as there are domains per step,
   then every rate moves against the gradient (scaled by the document's tokens and the domain's natural total, which makes a step of 1 safe)
   and is cut at its bounds. Steps end at the targets, or where no total moves any more: with an upper bound the targets need not be in reach.

A rate depends on the posteriors and on the few gradients alone, so the table of posteriors is written once, and again only where there are many steps.

Results: null and empty texts have no tokens, posteriors equal to the domains' shares, and a rate like any other; repeated
rows get equal results; an empty table gives an empty result. Of equal posteriors the first domain in alphabetical order is named. Without any
labelled row all rates are 1 and the domain is null. Domains without a target share what the targets leave, in their own proportions. A label on several rows
of one doc_id counts on each; several labels of one doc_id count as the smallest. More than ``MOST_DOMAINS`` domains are refused (their
weights are part of the plan): join small ones first. A row's words are held as one array of hashes. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airsignal.llm.common import first_ids_per, saved, unused

TOKEN, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
#: Letters of scripts written without spaces: each is a word.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF]"
BUCKETS = 1024
#: Frequencies of texts with fewer distinct words are taken down in proportion, so that one repeated word does not outweigh the statistics.
VARIED = 20.0
#: Statistics of a text; their squares and products count too.
STATISTICS = ["words", "distinct", "lines", "distinct_lines", "length", "symbols", "marks", "capitals", "digits"]
#: Labelled rows of a domain, and of all domains together, that the regression sees.
SAMPLE_ROWS, ALL_ROWS = 1_000, 10_000
#: Penalties on the weights of words and of statistics, and steps of the regression.
RIDGES, FIT_STEPS = (2e-4, 2e-4), 600
#: Steps at most, the relative difference to the targets at which they end, and the relative change below which totals stand still (as
#: exact as the targets themselves); steps after which rates are written, so that the expression of a rate stays small.
STEPS, TOLERANCE, STILL, WRITE_EVERY = 40, 1e-3, 1e-3, 8
MOST_DOMAINS = 256


def _normalised(scored: DataFrame, n: int) -> DataFrame:
    """Table of doc_id, tokens and the posteriors p0, p1, ... of n scores s0, s1, ..."""
    best = F.greatest(*[F.col(f"s{k}") for k in range(n)]) if n > 1 else F.col("s0")
    scored = scored.withColumn("best", best)
    scored = scored.select("doc_id", "tokens", *[F.exp(F.col(f"s{k}") - F.col("best")).alias(f"e{k}") for k in range(n)])
    whole = sum((F.col(f"e{k}") for k in range(1, n)), F.col("e0"))
    return saved(scored.select("doc_id", "tokens", *[(F.col(f"e{k}") / whole).alias(f"p{k}") for k in range(n)]), "posteriors")


def word_features(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """doc_id, the columns ``extra``, tokens, b (the bucket of every word) and the statistics of every row."""
    extra = extra or []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("unspaced", (F.octet_length("text") > F.char_length("text")) & F.col("text").rlike(UNSPACED))
    spaced = F.when(F.col("unspaced"), F.regexp_replace("text", f"({UNSPACED})", "$1 ")).otherwise(F.col("text"))
    rows = rows.withColumns({"h": F.transform(F.array_remove(F.split(F.lower(spaced), SPACE), ""), lambda w: F.xxhash64(w)),
                             "lines": F.split("text", "\n"), "size": F.greatest(F.char_length("text"), F.lit(1))})
    share = lambda regex: F.sqrt(F.regexp_count("text", F.lit(regex)) / F.col("size"))
    of = {"words": F.log1p(F.size("h")), "distinct": F.log1p(F.size(F.array_distinct("h"))),
          "lines": F.log1p(F.size("lines")), "distinct_lines": F.log1p(F.size(F.array_distinct("lines"))),
          "length": F.log(F.col("size") / F.greatest(F.size("h"), F.lit(1))),
          "symbols": share(r"[#$%&*+/<=>@\[\]\\^_`{|}~]"), "marks": share(r"[!-/:-@\[-`{-~]{2,}"),
          "capitals": share(r"\p{Lu}"), "digits": share("[0-9]")}
    tokens = F.when(F.col("unspaced"), F.regexp_count("text", F.lit(TOKEN))).otherwise(F.size("h")).cast("long")
    return rows.select("doc_id", *extra, tokens.alias("tokens"),
                       F.transform("h", lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")).alias("b"), *[of[k].alias(k) for k in STATISTICS])


@dataclass
class Softmax:
    domains: list[str]
    shares: np.ndarray  # of the labelled rows
    mean: np.ndarray  # of the statistics
    scale: np.ndarray
    words: np.ndarray  # domains x buckets, for frequencies
    single: np.ndarray  # domains x statistics, for the scaled ones
    pairs: np.ndarray  # domains x pairs
    bias: np.ndarray


_PAIRS = [(i, j) for i in range(len(STATISTICS)) for j in range(i + 1)]
#: Scaled statistics are cut here.
_FAR = 5.0


def fit_softmax(x: np.ndarray, stats: np.ndarray, label: np.ndarray, weight: np.ndarray, domains: list[str], shares: np.ndarray) -> Softmax:
    """Ridge-penalised softmax regression on word frequencies ``x`` and statistics, by accelerated gradient steps."""
    mean, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    z = np.clip((stats - mean) / scale, -_FAR, _FAR)
    spread = np.sqrt((x ** 2).mean(axis=0).max()) / 4 + 1e-6  # one scale, so seldom words count less
    whole = np.hstack([x / spread, z, np.stack([z[:, i] * z[:, j] for i, j in _PAIRS], axis=1), np.ones((len(x), 1))]).astype(np.float32)
    ridge = np.repeat([*RIDGES, 0.0], [BUCKETS, whole.shape[1] - BUCKETS - 1, 1]).astype(np.float32)
    y = (label[:, None] == np.arange(len(domains))[None, :]).astype(np.float32)
    weight = (weight / weight.sum()).astype(np.float32)
    v = np.ones(whole.shape[1], np.float32)
    for _ in range(30):  # largest eigenvalue: the step that cannot overshoot
        v = whole.T @ (weight * (whole @ v))
        top = np.linalg.norm(v)
        v /= top
    step = np.float32(1.0 / (0.5 * 1.05 * top + ridge.max()))
    w = ahead = np.zeros((whole.shape[1], len(domains)), np.float32)
    for k in range(FIT_STEPS):
        s = whole @ ahead
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - step * (whole.T @ ((p - y) * weight[:, None]) + ridge[:, None] * ahead)
        ahead, w = new + np.float32(k / (k + 3)) * (new - w), new
    n = BUCKETS + len(STATISTICS)
    return Softmax(domains, shares, mean, scale, (w[:BUCKETS] / spread).T, w[BUCKETS:n].T, w[n:-1].T, w[-1])


def learn(docs: DataFrame, labelled: DataFrame) -> Softmax | None:
    """The regression on the labelled rows that ``docs`` has; None without any."""
    known = (labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain"))
             .where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain")))
    present = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(known, "doc_id")
    chosen, counts = first_ids_per(present, SAMPLE_ROWS, "domain", ALL_ROWS)
    if not counts:
        return None
    if len(counts) > MOST_DOMAINS:
        raise ValueError(f"{len(counts)} domains; at most {MOST_DOMAINS}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    table = saved(word_features(rows, ["domain"]), "sample")  # rows of one doc_id count as one text
    stats = table.groupBy("doc_id").agg(F.min("domain").alias("domain"), *[F.avg(c).alias(c) for c in STATISTICS]).toArrow().sort_by("doc_id")
    found = table.select("doc_id", F.explode("b").alias("k")).groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("n")).toArrow()
    ids, domains = stats["doc_id"].to_numpy(), sorted(counts)
    x = np.zeros((len(ids), BUCKETS), np.float32)
    x[np.searchsorted(ids, found["doc_id"].to_numpy()), found["k"].to_numpy()] = found["n"].to_numpy()
    x *= (np.minimum(1, np.expm1(stats["distinct"].to_numpy()) / VARIED) / np.maximum(x.sum(axis=1), 1))[:, None]
    label = np.searchsorted(np.array(domains), np.array(stats["domain"].to_pylist()))
    drawn = np.bincount(label, minlength=len(domains))
    total = np.array([counts[d] for d in domains], float)
    return fit_softmax(x, np.stack([stats[c].to_numpy() for c in STATISTICS], axis=1).astype(float), label,
                       (total / np.maximum(drawn, 1))[label], domains, total / total.sum())


def _numbers(values: np.ndarray) -> Column:
    return F.expr("cast(split('" + ",".join(f"{v:.7g}" for v in values) + "', ',') as array<double>)")


def _softmax_scores(features: DataFrame, model: Softmax) -> DataFrame:
    """doc_id, tokens and the scores s0, s1, ... of the domains; a text without any word has the domains' shares."""
    cut = [F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), (F.col(c) - F.lit(float(m))) / F.lit(float(s)))).alias(f"z{k}")
           for k, (c, m, s) in enumerate(zip(STATISTICS, model.mean, model.scale, strict=True))]

    def summed(weights: np.ndarray) -> Column:
        held = _numbers(weights)
        return F.aggregate("b", F.lit(0.0), lambda total, k: total + F.get(held, k))

    sums = [summed(w).alias(f"w{d}") for d, w in enumerate(model.words)]
    held = (F.least(F.lit(1.0), F.expm1("distinct") / F.lit(VARIED)) / F.greatest(F.size("b"), F.lit(1))).alias("per")
    rows = features.select("doc_id", "tokens", F.size("b").alias("n"), held, *cut, *sums)
    scores = []
    for d in range(len(model.domains)):
        terms = [f"{float(model.bias[d])!r}D", f"w{d} * per", *[f"{v!r}D * z{i}" for i, v in enumerate(model.single[d].tolist())],
                 *[f"{v!r}D * z{i} * z{j}" for (i, j), v in zip(_PAIRS, model.pairs[d].tolist(), strict=True)]]
        scores.append(F.when(F.col("n") > 0, F.expr(" + ".join(terms))).otherwise(F.lit(math.log(model.shares[d]))).alias(f"s{d}"))
    return rows.select("doc_id", "tokens", *scores)


def posteriors(docs: DataFrame, labelled: DataFrame) -> tuple[DataFrame, list[str]]:
    """(table of doc_id, tokens, p0 ... per domain; the domains in order)."""
    model = learn(docs, labelled)
    if model is None:
        return word_features(docs).select("doc_id", "tokens"), []
    return _normalised(_softmax_scores(word_features(docs), model), len(model.domains)), model.domains


def target_totals(natural: list[float], domains: list[str], targets: dict[str, float], budget: float | None,
                  hold_rest: bool = False) -> list[float]:
    """Tokens wanted per domain: targets are shares of the budget (natural total unless given).

    ``hold_rest``: domains without a target keep their own totals, and the budget follows from them; the shares given must be below 1 together.
    """
    given = {d: max(0.0, float(targets[d])) for d in domains if d in targets}
    free = [k for k, d in enumerate(domains) if d not in given]
    if hold_rest:
        rest = sum(natural[k] for k in free) / (1.0 - sum(given.values()))
        return [given[d] * rest if d in given else natural[k] for k, d in enumerate(domains)]
    left = max(0.0, 1.0 - sum(given.values())) if free else 0.0
    spare = sum(natural[k] for k in free)
    shares = [given[d] if d in given else left * (natural[k] / spare if spare else 1 / len(free)) for k, d in enumerate(domains)]
    whole = sum(shares) or 1.0
    return [(sum(natural) if budget is None else budget) * s / whole for s in shares]


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None,
        steps: int = STEPS, tolerance: float = TOLERANCE, hold_rest: bool = False, most: float | None = None) -> DataFrame:
    """doc_id, tokens, domain (the likeliest), posterior (its probability) and rate of every row.

    ``targets``, ``budget`` and ``hold_rest`` as in ``target_totals``; ``most`` bounds the rates (1: no document is drawn twice).
    """
    table, domains = posteriors(docs, labelled)
    if not domains:
        return table.select("doc_id", "tokens", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("posterior"), F.lit(1.0).alias("rate"))
    ps = [F.col(f"p{k}") for k in range(len(domains))]

    def totals(rate: Column) -> list[float]:
        row = table.agg(*[F.coalesce(F.sum(rate * F.col("tokens") * p), F.lit(0.0)).alias(f"a{k}") for k, p in enumerate(ps)]).first()
        return [float(v) for v in row]

    rate, natural = F.lit(1.0), totals(F.lit(1.0))
    wanted, now = target_totals(natural, domains, targets, budget, hold_rest), natural
    scale = [max(v, 1e-9) for v in natural]
    for nth in range(1, steps + 1):
        if all(abs(a - t) <= tolerance * max(t, 1.0) for a, t in zip(now, wanted, strict=True)):
            break
        step = sum((p * F.lit((a - t) / s) for p, a, t, s in zip(ps[1:], now[1:], wanted[1:], scale[1:], strict=True)),
                   ps[0] * F.lit((now[0] - wanted[0]) / scale[0]))
        rate = F.greatest(F.lit(0.0), rate - step)
        rate = rate if most is None else F.least(F.lit(float(most)), rate)
        if nth % WRITE_EVERY == 0:
            table, rate = saved(table.withColumn("rate", rate), "rates"), F.col("rate")
        before, now = now, totals(rate)
        if all(abs(a - b) <= STILL * max(b, 1.0) for a, b in zip(now, before, strict=True)):
            break
    best = F.greatest(*ps) if len(ps) > 1 else ps[0]
    domain = F.coalesce(*[F.when(p == best, F.lit(d)) for p, d in zip(ps, domains, strict=True)])
    return table.select("doc_id", "tokens", domain.alias("domain"), best.alias("posterior"), rate.alias("rate"))


def draw(docs: DataFrame, rates: DataFrame, seed: int = 9) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says: the whole part, and once more where a hash of doc_id falls below the rest.

    ``rates`` has one doc_id once or more; the largest rate counts. Rows without one, or with a null doc_id, stay once.
    """
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    drawn = (rates.where("doc_id is not null").groupBy("doc_id").agg(F.max("rate").alias("rate"))
             .select("doc_id", (F.floor(F.col("rate") + u)).cast("int").alias("__copies")).where("__copies <> 1"))
    joined = docs.alias("d").join(drawn.alias("r").hint("shuffle_hash"), F.expr("cast(d.doc_id as bigint) = r.doc_id"), "left")
    times = F.coalesce(F.col("r.__copies"), F.lit(1))
    copy = unused("copy", docs)
    return joined.where(times > 0).select("d.*", F.explode(F.sequence(F.lit(1), times)).alias(copy)).drop(copy)
