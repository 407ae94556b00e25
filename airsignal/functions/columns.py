"""Scalar feature expressions.

Every function returns Spark Columns built from built-in expressions, so they
stay inside whole-stage codegen and need no Python worker. Functions named
``*_col`` / returning ``Column`` compose; functions taking a DataFrame add
columns with one ``withColumns`` call (one Project node, however wide).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "col_of", "nan_to_null", "aqi_index_to_scale", "aqi_from_pollutants", "calendar_parts",
    "day_of_week", "is_weekend", "season", "cyclical", "numeric_coerce", "polynomial",
    "center_scale", "direction_components", "log1p_features", "row_stats", "interactions",
    "safe_ratio", "aqi_category", "alert_level", "clip_floor", "category_attributes",
    "AQI_CATEGORIES", "ALERT_LEVELS", "CATEGORY_COLORS", "CATEGORY_ADVICE", "POWER_SUFFIX",
]

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference application's (do not edit):
#   pollution index 1..5 -> 50, 100, 150, 200, 300; any other index -> 100
#   category upper bounds (inclusive): 50 Good, 100 Moderate,
#     150 Unhealthy for Sensitive Groups, 200 Unhealthy, 300 Very Unhealthy, above Hazardous
#   alert lower bounds (inclusive): 300 Hazardous, 200 Very Unhealthy, 150 Unhealthy,
#     100 Unhealthy for Sensitive Groups, 50 Moderate, below Good
#   colours: Good #00E400, Moderate #FFFF00, Unhealthy for Sensitive Groups #FF7E00,
#     Unhealthy #FF0000, Very Unhealthy #8F3F97, Hazardous #7E0023, unknown #808080
#   pressure reference 1013.25 hPa, visibility scale 10000 m, cloud scale 100 %
# ---------------------------------------------------------------------------
INDEX_TO_SCALE = {1: 50, 2: 100, 3: 150, 4: 200, 5: 300}
INDEX_DEFAULT = 100

AQI_CATEGORIES = [
    (50.0, "Good"),
    (100.0, "Moderate"),
    (150.0, "Unhealthy for Sensitive Groups"),
    (200.0, "Unhealthy"),
    (300.0, "Very Unhealthy"),
]
AQI_TOP_CATEGORY = "Hazardous"

ALERT_LEVELS = [
    (300.0, "Hazardous"),
    (200.0, "Very Unhealthy"),
    (150.0, "Unhealthy"),
    (100.0, "Unhealthy for Sensitive Groups"),
    (50.0, "Moderate"),
]
ALERT_BOTTOM_LEVEL = "Good"

CATEGORY_COLORS = {
    "Good": "#00E400",
    "Moderate": "#FFFF00",
    "Unhealthy for Sensitive Groups": "#FF7E00",
    "Unhealthy": "#FF0000",
    "Very Unhealthy": "#8F3F97",
    "Hazardous": "#7E0023",
}
UNKNOWN_COLOR = "#808080"

# Default advice per category (own wording): icon, message, actions. ``category_attributes`` takes another table.
CATEGORY_ADVICE = {
    "Good": ("🟢", "The air is clean.", ["Go outside as you like", "Air the rooms"]),
    "Moderate": ("🟡", "The air is fine for most; a few very sensitive people may notice it.",
                 ["Plan outdoor sport by how you feel", "Watch the hourly values"]),
    "Unhealthy for Sensitive Groups": ("🟠", "Children, older people and people with asthma may be affected.",
                                       ["Shorten outdoor sport if you belong to these groups", "Air rooms only briefly"]),
    "Unhealthy": ("🔴", "Anyone may be affected.", ["Move activities indoors", "Wear a filter mask outside"]),
    "Very Unhealthy": ("🟣", "Effects on health are likely for everyone.",
                       ["Stay inside", "Run an air filter", "Check on people at risk"]),
    "Hazardous": ("🟤", "Emergency level: serious effects for everyone.",
                  ["Do not go outside", "Seal the room and run an air filter", "Follow the local authorities"]),
}
ADVICE_FALLBACK = "Good"

PRESSURE_REF = 1013.25
VISIBILITY_SCALE = 10000.0
CLOUDS_SCALE = 100.0

POWER_SUFFIX = {2: "squared", 3: "cubed"}


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN -> NULL (Spark orders NaN above every number; pandas skips it)."""
    c = col_of(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


# --- 3, 15: AQI scales ------------------------------------------------------

def aqi_index_to_scale(c: str | Column) -> Column:
    """Pollution index 1..5 -> 50..300; every other value (also NULL) -> 100."""
    m = F.create_map(*[x for k, v in INDEX_TO_SCALE.items() for x in (F.lit(k), F.lit(float(v)))])
    idx = col_of(c).cast("int")
    return F.coalesce(F.try_element_at(m, idx), F.lit(float(INDEX_DEFAULT)))


def aqi_from_pollutants(pm25: str | Column, pm10: str | Column) -> Column:
    """max(0, max(2.5*pm25, pm10)); NULL inputs are skipped, both NULL -> NULL."""
    a = col_of(pm25) * F.lit(2.5)
    b = col_of(pm10) * F.lit(1.0)
    g = F.greatest(a, b)
    return F.when(g.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(0.0), g))


# --- 20-23: calendar ----------------------------------------------------------

def _local(ts: str | Column, tz: str | Column | None) -> Column:
    """Wall-clock time in ``tz`` (a zone name or a Column of zone names)."""
    t = col_of(ts)
    if tz is None:
        return t
    zone = F.lit(tz) if isinstance(tz, str) else tz
    return F.from_utc_timestamp(t.cast("timestamp"), zone)


def day_of_week(ts: str | Column) -> Column:
    """Monday = 0 .. Sunday = 6 (Spark ``weekday``, not ``dayofweek``)."""
    return F.weekday(col_of(ts)).cast("int")


def is_weekend(ts: str | Column) -> Column:
    return day_of_week(ts).isin(5, 6).cast("int")


def season(ts: str | Column) -> Column:
    """1 winter (Dec-Feb), 2 spring, 3 summer, 4 fall: (month % 12 + 3) div 3."""
    return ((F.month(col_of(ts)) % 12 + 3) / 3).cast("int")


def calendar_parts(df: DataFrame, ts: str = "ts", tz: str | None = None) -> DataFrame:
    """hour, day, month, day_of_week (Mon=0). ``tz`` converts UTC ts to local time first."""
    t = _local(ts, tz)
    return df.withColumns({
        "hour": F.hour(t).cast("int"),
        "day": F.dayofmonth(t).cast("int"),
        "month": F.month(t).cast("int"),
        "day_of_week": day_of_week(t),
    })


def cyclical(df: DataFrame, periods: Mapping[str, float]) -> DataFrame:
    """``<col>_sin`` / ``<col>_cos`` of 2*pi*col/period."""
    out = {}
    for c, p in periods.items():
        ang = F.lit(2 * math.pi) * F.col(c) / F.lit(float(p))
        out[f"{c}_sin"] = F.sin(ang)
        out[f"{c}_cos"] = F.cos(ang)
    return df.withColumns(out)


# --- 24-31: numeric transforms -------------------------------------------------

# Plain decimal or scientific number with optional surrounding blanks. Spark's
# cast alone would accept suffixes such as '12d'; a text that does not match is NULL.
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def numeric_coerce(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Text -> double; unparsable, empty and NaN -> NULL. Numeric columns pass through."""
    out = {}
    types = dict(df.dtypes)
    for c in cols:
        if c not in types:
            continue
        if types[c] == "string":
            s = F.col(c)
            out[c] = F.when(s.rlike(NUMERIC_TEXT), F.trim(s).try_cast("double"))
        else:
            out[c] = nan_to_null(F.col(c).cast("double"))
    return df.withColumns(out) if out else df


def polynomial(df: DataFrame, powers: Mapping[str, Sequence[int]]) -> DataFrame:
    """``<col>_squared`` / ``<col>_cubed`` as products (exact, codegen friendly)."""
    out = {}
    for c, ps in powers.items():
        for p in ps:
            e = F.col(c)
            for _ in range(p - 1):
                e = e * F.col(c)
            out[f"{c}_{POWER_SUFFIX.get(p, f'pow{p}')}"] = e
    return df.withColumns(out)


def center_scale(df: DataFrame, spec: Mapping[str, tuple[float, float, str]]) -> DataFrame:
    """``name = (col - center) / scale`` for each ``col: (center, scale, name)``."""
    return df.withColumns({
        name: (F.col(c) - F.lit(float(center))) / F.lit(float(scale))
        for c, (center, scale, name) in spec.items()
    })


def direction_components(df: DataFrame, c: str) -> DataFrame:
    r = F.radians(F.col(c))
    return df.withColumns({f"{c}_sin": F.sin(r), f"{c}_cos": F.cos(r)})


def log1p_features(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """``<col>_log`` = ln(1 + x); x <= -1 gives NULL."""
    return df.withColumns({
        f"{c}_log": F.when(F.col(c) > -1, F.log1p(F.col(c))) for c in cols
    })


def row_stats(df: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    """Across-column sum, mean, sample std and max per row, NULLs skipped.

    sum of nothing = 0, the others NULL; std of one value is NULL.
    Expressions are written out per column (no arrays), so they stay scalar code.
    """
    cs = [F.col(c) for c in cols]
    n = sum((c.isNotNull().cast("int") for c in cs), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    mean = F.when(n > 0, total / n)
    ss = sum((F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cs), F.lit(0.0))
    std = F.when(n > 1, F.sqrt(ss / (n - 1)))
    return df.withColumns({
        f"{prefix}_sum": total,
        f"{prefix}_mean": mean,
        f"{prefix}_std": std,
        f"{prefix}_max": F.greatest(*cs),
    })


def interactions(df: DataFrame, pairs: Iterable[tuple[str, str, str]]) -> DataFrame:
    return df.withColumns({name: F.col(a) * F.col(b) for a, b, name in pairs})


def safe_ratio(df: DataFrame, a: str, b: str, name: str, mode: str = "epsilon") -> DataFrame:
    """``epsilon``: a / (b + 1e-8) (training path); ``positive``: a / b if b > 0 else 0 (forecast path)."""
    if mode == "epsilon":
        e = F.try_divide(F.col(a), F.col(b) + F.lit(1e-8))
    elif mode == "positive":
        e = F.when(F.col(b) > 0, F.col(a) / F.col(b)).when(F.col(b).isNotNull(), F.lit(0.0))
    else:
        raise ValueError(f"unknown ratio mode {mode!r}")
    return df.withColumn(name, e)


# --- 32, 33, 41: categories -----------------------------------------------------

def aqi_category(c: str | Column) -> Column:
    """Upper-inclusive bands; NULL stays NULL."""
    c = col_of(c)
    e = None
    for bound, label in AQI_CATEGORIES:
        e = F.when(c <= bound, label) if e is None else e.when(c <= bound, label)
    return e.when(c.isNotNull(), AQI_TOP_CATEGORY)


def alert_level(c: str | Column, thresholds: Sequence[tuple[float, str]] | None = None,
                bottom: str = ALERT_BOTTOM_LEVEL) -> Column:
    """Lower-inclusive bands (other edges than ``aqi_category``); NULL stays NULL."""
    c = col_of(c)
    e = None
    for bound, label in (thresholds or ALERT_LEVELS):
        e = F.when(c >= bound, label) if e is None else e.when(c >= bound, label)
    return e.when(c.isNotNull(), bottom)


def clip_floor(c: str | Column, floor: float = 0.0) -> Column:
    c = col_of(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(floor)), c))


def _lit_map(d: Mapping[str, object]) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def category_attributes(df: DataFrame, c: str = "category",
                        advice: Mapping[str, tuple[str, str, Sequence[str]]] | None = None) -> DataFrame:
    """colour, icon, message and actions of a category; ``advice`` replaces the default table.

    A literal map lookup, not a join: a handful of entries, evaluated in codegen.
    Unknown category: grey colour, advice of "Good".
    """
    advice = CATEGORY_ADVICE if advice is None else advice
    key = F.col(c)
    colors = _lit_map(CATEGORY_COLORS)
    icons = _lit_map({k: v[0] for k, v in advice.items()})
    msgs = _lit_map({k: v[1] for k, v in advice.items()})
    acts = F.create_map(*[x for k, v in advice.items()
                          for x in (F.lit(k), F.array(*[F.lit(a) for a in v[2]]))])
    fb = F.lit(ADVICE_FALLBACK)
    return df.withColumns({
        "color": F.coalesce(F.try_element_at(colors, key), F.lit(UNKNOWN_COLOR)),
        "icon": F.coalesce(F.try_element_at(icons, key), F.try_element_at(icons, fb)),
        "message": F.coalesce(F.try_element_at(msgs, key), F.try_element_at(msgs, fb)),
        "actions": F.coalesce(F.try_element_at(acts, key), F.try_element_at(acts, fb)),
    })
