"""Secret scans with an incremental blob ledger. DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its text (its blob). The ledger, a Parquet table on shared
storage, holds one row per scanned (blob, rule, rule version) with its spans, empty ones included. A scan
hashes the given versions, scans one copy of each blob for the rules whose (blob, rule, version) the ledger
lacks, appends those rows, and joins the ledger's spans back to every path that has the blob. A rule whose
version changes is scanned anew; all other pairs are read from the ledger.

Results: null texts count as empty and have no spans; repeated rows and copies are scanned once and reported each;
a null id is kept; an empty table gives an empty result. Spans are in code points, the end exclusive, ordered by
start and then by the rule's place in the list. If a run dies after appending, the next one reads the pairs as seen; a pair
appended twice counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


#: Kinds and patterns of the base rules. A greedy run that is too short holds no run that is long
#: enough, so ``{24,}`` and ``{16,}`` find what ``+`` and a check of the length find, without a match for every letter.
BASE_RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Headers of private keys.
MORE_RULES = [Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")]
RULES = BASE_RULES + MORE_RULES

LEDGER = T.StructType([
    T.StructField("blob", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("version", T.IntegerType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def ledger(spark, path: str) -> DataFrame:
    """The ledger at ``path``, one row per pair; an empty one is made if there is none."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path).dropDuplicates(["blob", "kind", "version"])


def _matches(rule: Rule):
    """Array of (gap before the match, its length, the checked group's length) of the rule's matches in ``text``."""
    pat = F.lit(rule.pattern)
    size = lambda xs: F.transform(xs, lambda x: F.length(x).cast("long"))
    whole = F.regexp_extract_all("text", pat, F.lit(0))
    part = whole if not rule.group else F.regexp_extract_all("text", pat, F.lit(rule.group))
    found = F.arrays_zip(size(F.split("text", rule.pattern, -1)).alias("gap"), size(whole).alias("len"), size(part).alias("checked"))
    return F.when(F.col("text").rlike(rule.pattern), found)


def scan_blobs(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(blob, kind, start, end) of the rows (blob, text, kinds): ``kinds`` are the rules to run on the row."""
    todo = F.array(*[F.when(F.array_contains("kinds", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.least).cast("long").alias("least"), _matches(r).alias("found")))
                     for r in rules])
    each = (blobs.select("blob", F.monotonically_increasing_id().alias("row"), F.explode(todo).alias("r"))
            .where("r.found is not null")
            .select("blob", "row", "r.kind", "r.least", F.posexplode("r.found").alias("pos", "m"))
            .select("blob", "row", "kind", "least", "pos", "m.*").where("len is not null"))
    upto = Window.partitionBy("blob", "row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).where("checked >= least")
            .select("blob", "kind", (F.col("end") - F.col("len")).alias("start"), "end"))


def update(versions: DataFrame, path: str, rules: list[Rule] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks for the rows (id, text) of ``versions``; return the ledger after it."""
    spark = versions.sparkSession
    rows = versions.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    seen = ledger(spark, path).select("blob", "kind", "version")
    wanted = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])).alias("r")
    lacking = (rows.groupBy("blob").agg(F.min("id").alias("id")).select("blob", "id", wanted).select("blob", "id", "r.*")
               .join(seen, ["blob", "kind", "version"], "left_anti"))
    todo = lacking.groupBy("blob", "id").agg(F.collect_set("kind").alias("kinds"))  # as many kinds as rules at most
    blobs = (rows.alias("d").join(todo.alias("t").hint("shuffle_hash"), F.expr("d.blob = t.blob and d.id <=> t.id"))
             .select("d.blob", "d.text", "t.kinds"))
    spans = (scan_blobs(blobs, rules).groupBy("blob", "kind")
             .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")))
    none = F.array().cast(LEDGER["spans"].dataType)
    (lacking.select("blob", "kind", "version").join(spans, ["blob", "kind"], "left")
     .select("blob", "kind", F.col("version").cast("int").alias("version"), F.coalesce("spans", none).alias("spans"))
     .write.mode("append").parquet(path))
    return ledger(spark, path)


def scan(docs: DataFrame, path: str, rules: list[Rule] = RULES, id_col: str = "doc_id") -> DataFrame:
    """id, blob and spans (array of start, place of the rule, end, kind; ordered) of every row, through the ledger at ``path``."""
    versions = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    known = update(versions, path, rules)
    place = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    active = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    found = (known.where((F.size("spans") > 0) & (F.col("version") == active[F.col("kind")]))
             .select("blob", "kind", F.explode("spans").alias("s"))
             .groupBy("blob").agg(F.sort_array(F.collect_set(F.struct(F.col("s.start").alias("start"), place[F.col("kind")].alias("place"),
                                                                     F.col("s.end").alias("end"), "kind"))).alias("spans")))
    paths = versions.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    empty = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    return paths.join(found, "blob", "left").select(F.col("id").alias(id_col), "blob", F.coalesce("spans", empty).alias("spans"))


def as_text(spans):
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts per base kind, sha256 of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["place"] < len(BASE_RULES))
    at = lambda k: F.size(F.filter("spans", lambda s: s["place"] == k)).cast("long")
    counts = [at(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """DuckDB SQL of the same result, straight over the documents."""
    parts = []
    for k, r in enumerate(RULES):
        pat = r.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, n, {k} AS place, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{pat}', 0) AS ms, "
                     f"regexp_extract_all(t, '{pat}', {r.group}) AS vs, string_split_regex(t, '{pat}') AS gaps FROM d")
    union = "\nUNION ALL ".join(parts)
    text = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place){}, '')"
    counts = ", ".join(f"count(*) FILTER (WHERE place = {k}) AS n_{r.kind}" for k, r in enumerate(BASE_RULES))
    only = f" FILTER (WHERE place < {len(BASE_RULES)})"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents),
m AS ({union}),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
p AS (SELECT *, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s0 FROM i),
f AS (SELECT n, place, kind, s0::BIGINT AS s, (s0 + length(ms[i]))::BIGINT AS e FROM p WHERE length(vs[i]) >= least),
g AS (SELECT n, {counts}, {text.format(only)} AS base, {text.format('')} AS spans FROM f GROUP BY n)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE_RULES)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (n)"""


ORACLE = _oracle()
