"""Query registry: Spark callables plus their DuckDB oracle SQL.

Each query reads the given test tables (or frames Spark derives from them) in
full. Doubles are rounded on both sides (``digits``, default 6) because the two
engines may differ in the last bits of sums, sin/cos and logs. Rounding is done
in two exact decimal steps — snap to 9 decimals, then half-up to ``digits`` —
so values that are exact decimal ties (e.g. means over 32 rows) round the same
way in both engines; +0.0 turns -0.0 into 0.0.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    digits: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(self.fn(spark, sf_dir), self.digits)


REGISTRY: dict[str, Query] = {}


def round_doubles(df: DataFrame, digits: Mapping[str, int] | None = None, default: int = 6) -> DataFrame:
    digits = digits or {}
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            snapped = F.col(f"`{f.name}`").cast("double").try_cast("decimal(38,9)")
            out[f.name] = F.round(snapped, digits.get(f.name, default)).cast("double") + F.lit(0.0)
    return df.withColumns(out) if out else df


class OracleSQL(str):
    """SQL text that also carries the rounding digits of its double columns."""

    digits: dict[str, int]


def oracle(ctes: Sequence[str], body: str, dbl: Mapping[str, int] | Sequence[str]) -> OracleSQL:
    """``WITH ctes, __q AS (body) SELECT * REPLACE (round(c, d) + 0.0 AS c ...) FROM __q``."""
    spec = dict(dbl) if isinstance(dbl, Mapping) else {c: 6 for c in dbl}
    with_ = "WITH " + ",\n".join([*ctes, f"__q AS (\n{body}\n)"])
    if not spec:
        text = f"{with_}\nSELECT * FROM __q"
    else:
        rep = ", ".join(f'round(TRY_CAST("{c}" AS DECIMAL(38, 9)), {d})::DOUBLE + 0.0 AS "{c}"'
                        for c, d in spec.items())
        text = f"{with_}\nSELECT * REPLACE ({rep}) FROM __q"
    out = OracleSQL(text)
    out.digits = spec
    return out


def register(name: str, sql: str | None = None, digits: Mapping[str, int] | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        spec = dict(getattr(sql, "digits", {}) or {})
        spec.update(digits or {})
        REGISTRY[name] = Query(name, fn, None if sql is None else str(sql), spec)
        return fn
    return deco


def dspec(cols: Sequence[str], d: int = 6, **over: int) -> dict[str, int]:
    """Rounding spec: every column in ``cols`` at ``d`` digits, overrides by name."""
    out = {c: d for c in cols}
    out.update(over)
    return out
