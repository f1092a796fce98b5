"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BASES = ("official_release", "official_schedule", "fixed_lag", "unverified", "unknown")
POLICIES = {
    "official_release_only": BASES[:1],
    "include_schedule": BASES[:2],
    "include_estimates": BASES[:3],
    "include_unverified": BASES[:4],
    "all": BASES,
}


def past(keys: list[str], order: str) -> WindowSpec:
    """All rows of a key before the current one."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def regime(growth: Column, inflation: Column) -> Column:
    """Quadrant of two scores; strictly above 0 is up, null if either is missing."""
    up, hot = growth > 0, inflation > 0
    return (
        F.when(growth.isNull() | inflation.isNull(), F.lit(None).cast("string"))
        .when(up & ~hot, "goldilocks")
        .when(up & hot, "reflation")
        .when(~up & hot, "stagflation")
        .otherwise("recession")
    )


def safe_name(text: Column) -> Column:
    """A text as the name of a file: letters, digits, dots, dashes and underscores stay, anything else is an underscore."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "_")


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in a fixed order: by the keys, then by all other columns that can be ordered. For output; operators don't need it."""
    rest = [c for c, t in df.dtypes if c not in keys and not t.startswith("map")]
    return df.orderBy(*keys, *rest)


def dcf_value(fcf: Column, rates: Column, discount: Column, terminal: Column) -> Column:
    """Present value of cash flows that grow by ``rates``, plus the discounted terminal value."""
    start = F.struct(fcf.cast("double").alias("fcf"), F.lit(0.0).alias("pv"), F.lit(0).alias("year"))

    def step(s: Column, g: Column) -> Column:
        flow, year = s["fcf"] * (1 + g), s["year"] + 1
        return F.struct(flow.alias("fcf"), (s["pv"] + flow / F.pow(1 + discount, year)).alias("pv"), year.alias("year"))

    def finish(s: Column) -> Column:
        return s["pv"] + s["fcf"] * (1 + terminal) / (discount - terminal) / F.pow(1 + discount, s["year"])

    return F.aggregate(rates, start, step, finish)


def bisect(value, low: float, high: float, steps: int = 100) -> Column:
    """Root of a decreasing-or-increasing ``value(x) - target`` column function, by bisection inside the plan.

    ``value`` takes a column x and returns a column that is positive above the root.
    """
    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        above = value(mid) > 0
        return F.struct(F.when(above, s["lo"]).otherwise(mid).alias("lo"), F.when(above, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["lo"] + s["hi"]) / 2)
