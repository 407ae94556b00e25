"""Run logs with a drifting schema.

Older logs carry ``mse`` and an empty feature list, newer ones not; all are
read with one explicit superset schema, so missing fields are NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

RUN_LOG = StructType([
    StructField("model_name", StringType()),
    StructField("timestamp", StringType()),
    StructField("scores", StructType([StructField(n, DoubleType()) for n in ("mse", "rmse", "mae", "r2", "mape")])),
    StructField("feature_columns", ArrayType(StringType())),
])


def write_run_logs(runs: DataFrame, path: str) -> None:
    """``runs(model_name, timestamp, mse?, rmse, mae, r2, mape, feature_columns?)`` -> JSON lines."""
    score_cols = [c for c in ("mse", "rmse", "mae", "r2", "mape") if c in runs.columns]
    out = runs.select("model_name", "timestamp", F.struct(*score_cols).alias("scores"),
                      *(["feature_columns"] if "feature_columns" in runs.columns else []))
    out.write.mode("append").json(path)


def run_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs of the files under ``path``, flattened, best first: ordered by rmse, then time, then name (a range-partitioned sort)."""
    # a log is one object, on one line or pretty-printed, or (as written here) one object per line
    lines = spark.read.schema(RUN_LOG).json(path)
    whole = spark.read.schema(RUN_LOG).option("multiLine", True).json(path)
    source = F.input_file_name()
    named = F.col("model_name").isNotNull()
    lines, whole = lines.withColumn("__file", source).where(named), whole.withColumn("__file", source).where(named)
    rest = whole.join(lines.select("__file").distinct(), "__file", "left_anti")
    d = lines.unionByName(rest)
    flat = d.select("model_name", F.col("timestamp").alias("run_ts"),
                    *[F.col(f"scores.{n}").alias(n) for n in ("mse", "rmse", "mae", "r2", "mape")],
                    F.coalesce(F.size("feature_columns"), F.lit(0)).alias("n_features"))
    return flat.orderBy(F.col("rmse").asc_nulls_last(), "run_ts", "model_name")
