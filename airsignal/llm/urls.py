"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest.

A url's host stands after its first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; its path follows, up to ``?``, ``#`` or the
end. A rule (verdict, host, path) fits its host and all hosts below it where the url's path starts with the rule's; the
longest fitting rule decides (host and path together; of equally long ones the one with the longer host, then the first given).

Urls that no rule fits are judged by a logistic regression learned from a small table of labelled urls. Its features are the
character n-grams of host and path, each host label and path segment framed, hashed into ``BUCKETS``: a bucket counts once
per url, divided by the root of the number of buckets. Top-level names, schemes, digits and queries say nothing about a site, so
digits are one symbol and the last label of a host is left out. The regression is fitted by Newton steps in the dual (a matrix
of as many rows as labelled urls), so the size of the hash space does not matter.

Results: a null url, or one without ``://``, has empty host and path and no rule; a url without any known n-gram is
allowed (clean unless something speaks against it). Repeated rows get equal results. Without
labelled urls of both kinds everything that no rule blocks is allowed. Columns other than the id and the url are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airsignal.llm.common import BASE, mix, text_buffer

ALLOW, BLOCK = "allow", "block"
#: Hash buckets, lengths of the n-grams, and the penalty on the weights.
BUCKETS, SHORTEST, LONGEST, RIDGE = 1 << 18, 3, 6, 0.02
#: Labelled urls that the fit takes at most, in the order of a hash of the url.
SAMPLE_ROWS = 2_000
#: Urls scored at once.
ROWS = 4096

#: Words of hosts and paths that the filter is meant to stop, and of ordinary ones: the small labelled table is made of them.
UNWANTED = ["casino", "casino-bonus", "poker-win", "win-jackpot", "slots", "betting", "bets", "free-bets", "sports-bet", "lottery-win", "adult", "adult-video", "xxx",
            "porn", "sex-cams", "nude", "escort", "hot-dating", "pills", "cheap-pills", "viagra", "cheap-meds", "pharmacy-discount", "diet-pills",
            "spam", "spam-mail", "link-farm", "seo-links", "ads", "ads-server", "adserver", "click-ads", "track", "tracker", "ad-tracking", "pixel-track",
            "malware", "phishing", "warez", "crack-keygen", "torrent-free", "payday-loan", "fast-loans", "free-money", "get-rich", "replica-watches", "clickbait"]
ORDINARY = ["news", "weather", "city-library", "university", "school", "docs", "shop", "museum", "garden", "kitchen", "travel", "maps", "health", "hospital",
            "research", "science", "sports-club", "football", "music", "radio", "books", "history", "photos", "film", "theatre", "bank", "jobs", "forum",
            "wiki", "recipes", "town-hall", "parliament", "church", "railway", "airport", "hotel", "bakery", "farm", "coffee", "bicycles", "software", "linux",
            "python", "astronomy", "physics", "chemistry", "math", "art", "design", "family", "kids", "animals", "birds", "ocean", "mountain", "river",
            "thing", "nation", "station", "the-other", "another", "weblog", "traction", "attraction", "adventure", "winter", "window", "betterment", "alphabet", "loanwords"]


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 for unwanted), each word in a few usual shapes of a url."""
    shapes = ["https://{w}.example.com/en/{n}", "http://www.{w}.example.org/de/{n}.html", "https://blog.{w}.example.net/fr/{n}/", "https://m.{w}.example.com/es/{n}#top",
              "https://example.org/{w}/{n}?page=2", "http://{w}{n}.net/", "https://{o}.example.com/{w}/index.html"]
    rows = []
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        for k, w in enumerate(words):
            rows += [(shapes[(k + j) % len(shapes)].format(w=w, n=17 * k + j, o=ORDINARY[(7 * k + j) % len(ORDINARY)]), label) for j in (0, 2, 4)]
    return rows


# ---- host, path, rules -----------------------------------------------------------------------------


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, capitals, capitals.lower()), path


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(rules: Iterable[tuple[str, str]]) -> list[Rule]:
    """Rules from (verdict, "host/path") texts, the deciding one first."""
    out = []
    for verdict, text in rules:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"verdict must be allow or block, not {verdict!r}")
        cut = text.find("/")
        host, path = (text, "") if cut < 0 else (text[:cut], text[cut:])
        out.append(Rule(verdict, host.lower(), path))
    return sorted(out, key=lambda r: (-len(r.text), -len(r.host)))


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, null without one: one branch per rule, in the order of length."""
    text = verdict = F.lit(None).cast("string")
    for r in reversed(rules):
        fits = ((host == F.lit(r.host)) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


# ---- n-grams and regression ------------------------------------------------------------------------


def _fold() -> np.ndarray:
    """Letters in lower case, one symbol for digits, bytes of other characters; all else frames labels and segments."""
    out = np.full(256, 1, np.uint64)
    for b in range(97, 123):
        out[b] = out[b - 32] = b
    out[48:58] = 2
    out[128:] = np.arange(128, 256)
    return out


FOLD = _fold()


def grams(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram, each once per row; hosts without their last label."""
    from pyarrow import compute as pc

    stem = pc.replace_substring_regex(pc.fill_null(hosts, ""), r"(?s)\.?[^.]*$", "")
    texts = pc.binary_join_element_wise("/", stem, pc.fill_null(paths, ""), "/", "")
    data, offsets = text_buffer(texts)
    n, row = len(data), np.repeat(np.arange(len(texts)), np.diff(offsets))
    code = np.append(FOLD[data], np.zeros(LONGEST, np.uint64))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    found, h = [], np.zeros(n, np.uint64)
    inner = np.zeros(n, bool)  # a frame stands at either end of a gram only
    for k in range(LONGEST):
        h = h * BASE + code[k:k + n]
        if k >= SHORTEST - 1:
            at = np.flatnonzero((left > k) & ~inner)
            found.append(row[at].astype(np.int64) * BUCKETS + (mix(h[at] + np.uint64(k)) & np.uint64(BUCKETS - 1)).astype(np.int64))
        if k >= 1:
            inner |= code[k:k + n] == 1  # the symbols passed so far, without the first one, of the next longer gram
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys // BUCKETS, keys % BUCKETS


@dataclass
class Model:
    weight: np.ndarray  # per bucket
    bias: float


def train(hosts: Sequence[str], paths: Sequence[str], unwanted: Sequence[int], ridge: float = RIDGE) -> Model:
    """Logistic regression with a penalty on the weights."""
    y = np.where(np.array(unwanted, int) == 1, 1.0, -1.0)
    if not (y > 0).any() or not (y < 0).any():
        return Model(np.zeros(BUCKETS, np.float32), -30.0)
    row, bucket = grams(pa.array(hosts, pa.string()), pa.array(paths, pa.string()))
    known, at = np.unique(bucket, return_inverse=True)
    x = np.zeros((len(y), len(known)))
    x[row, at] = 1
    x /= np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)
    kernel = x @ x.T
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * len(y)  # both kinds count alike
    alpha, bias = np.zeros(len(y)), 0.0
    for _ in range(50):  # Newton steps on the coefficients of the rows
        z = kernel @ alpha + bias
        p = 1 / (1 + np.exp(np.clip(y * z, -30, 30)))
        v = np.maximum(share * p * (1 - p), 1e-9)
        t = z + share * y * p / v
        # (K + ridge n / v) alpha + bias = t, sum of alpha 0
        a = np.block([[kernel + np.diag(ridge * len(y) / v), np.ones((len(y), 1))], [np.ones((1, len(y))), np.zeros((1, 1))]])
        new = np.linalg.solve(a, np.append(t, 0.0))
        moved = max(np.abs(new[:-1] - alpha).max(), abs(new[-1] - bias))
        alpha, bias = new[:-1], float(new[-1])
        if moved < 1e-10:
            break
    weight = np.zeros(BUCKETS, np.float32)
    weight[known] = x.T @ alpha
    return Model(weight, bias)


def decisions(hosts: pa.Array, paths: pa.Array, model: Model) -> np.ndarray:
    """Log odds that each url is unwanted; below 0 where nothing in it is known."""
    row, bucket = grams(hosts, paths)
    n, w = np.bincount(row, minlength=len(hosts)), model.weight[bucket]
    known = np.bincount(row, w != 0, len(hosts)) > 0
    z = np.bincount(row, w, len(hosts)) / np.maximum(np.sqrt(n), 1) + model.bias
    return np.where(known, z, min(model.bias, -1e-6))


# ---- operator -------------------------------------------------------------------------------------


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Train on a bounded sample of the labelled table (url, unwanted 0/1); a url with both labels counts as unwanted."""
    own = (labelled.where("url is not null and unwanted in (0, 1)").groupBy("url").agg(F.max(F.col("unwanted").cast("int")).alias("unwanted"))
           .orderBy(F.xxhash64("url"), "url").limit(rows))
    host, path = host_and_path(F.col("url"))
    found = sorted(own.select(host.alias("host"), path.alias("path"), "unwanted").collect())
    return train([r.host for r in found], [r.path for r in found], [r.unwanted for r in found])


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, unwanted int")


def judge(pages: DataFrame, model: Model, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (probability that the url is unwanted by the regression; null where a rule decides) of every row."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    text, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "verdict": verdict})
    held = pages.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                hosts, paths, ruled = (part.column(c) for c in ("host", "path", "verdict"))
                free = ruled.is_null().to_numpy(zero_copy_only=False)
                z = np.zeros(part.num_rows)
                if free.any():
                    pick = pa.array(np.flatnonzero(free))
                    z[free] = decisions(hosts.take(pick), paths.take(pick), held.value)
                own = np.where(z > 0, BLOCK, ALLOW)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([
                    part.column("page_id"), hosts, paths, part.column("rule"),
                    pa.array([v if v is not None else o for v, o in zip(ruled.to_pylist(), own.tolist(), strict=True)], pa.string()),
                    pa.array(p, pa.float64(), mask=~free)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
