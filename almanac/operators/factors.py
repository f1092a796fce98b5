"""Factor operators on long monthly panels (series_id, month_end, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from almanac.functions.columns import past, regime
from almanac.operators.asof import latest

#: Transforms by name: a column of the value, the value some periods before, and the value of the second source. Callers may add their own.
TRANSFORMS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "level": lambda v, before, other: v,
    "diff": lambda v, before, other: v - before,
    "pct_change": lambda v, before, other: F.try_divide(v, before) - 1,
    "yoy": lambda v, before, other: F.try_divide(v, before) - 1,
    "distance_from_50": lambda v, before, other: v - 50.0,
    "real_rate_proxy": lambda v, before, other: v - other,
}
#: Months that a transform looks back where the configuration names none.
PERIODS = {"yoy": 12}


def _optional(config: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in config.columns else F.lit(None).cast(kind).alias(name)


def transforms(panel: DataFrame, config: DataFrame) -> DataFrame:
    """Each component's transformed and oriented series.

    ``config``: factor, component, source, transform, periods, weight, sign, and where needed inflation_source and
    min_components. Earlier values and second sources are joined on series and month, so any number of periods is one plan; the panel has
    every month. Components whose source is not in the panel have no rows; an unknown transform is an error.
    """
    default = F.lit(1)
    for name, n in PERIODS.items():
        default = F.when(F.col("transform") == name, n).otherwise(default)
    plan = config.select("factor", "component", F.col("source").alias("series_id"), "transform", F.coalesce("periods", default).alias("periods"), "weight", "sign", _optional(config, "inflation_source", "string"), _optional(config, "min_components", "int"))
    rows = panel.join(F.broadcast(plan), "series_id")  # a row per configured component
    rows = rows.withColumn("then", F.last_day(F.add_months("month_end", -F.col("periods"))))
    earlier = panel.select("series_id", F.col("month_end").alias("then"), F.col("value").alias("before"))
    second = panel.select(F.col("series_id").alias("inflation_source"), "month_end", F.col("value").alias("other"))
    rows = rows.join(earlier, ["series_id", "then"], "left").join(second, ["inflation_source", "month_end"], "left")
    out = F.raise_error(F.concat(F.lit("unknown transform: "), F.coalesce("transform", F.lit("none")))).cast("double")
    for name, fn in TRANSFORMS.items():
        out = F.when(F.col("transform") == name, fn(F.col("value"), F.col("before"), F.col("other"))).otherwise(out)
    return rows.withColumn("x", out * F.col("sign")).select("factor", "component", "series_id", "month_end", "weight", "min_components", "x")


def expanding_zscore(df: DataFrame, least: int = 36, include_current: bool = False) -> DataFrame:
    """Score against rows before the current one of the same series, or up to it; null with fewer than ``least`` values or no spread."""
    keys = ["factor", "component", "series_id"]
    w = Window.partitionBy(*keys).orderBy("month_end").rowsBetween(Window.unboundedPreceding, 0) if include_current else past(keys, "month_end")
    z = (F.col("x") - F.avg("x").over(w)) / F.nullif(F.stddev_samp("x").over(w), F.lit(0.0))
    return df.withColumn("z", F.when(F.count("x").over(w) >= least, z))


def _needed(scores: DataFrame) -> Column:
    given = F.max("min_components") if "min_components" in scores.columns else F.lit(None).cast("int")
    return F.coalesce(given, F.count_distinct("component")).alias("needed")


def config_violations(config: DataFrame) -> DataFrame:
    """(rule, factor, component) of a factor configuration: a weight that is missing or negative, weights of a factor that sum to nothing (no component), a minimum above the number of components."""
    bad = config.where(F.coalesce(F.col("weight") < 0, F.lit(True)) | F.isnan("weight")).select(F.lit("weight").alias("rule"), "factor", "component")
    by = config.groupBy("factor").agg(F.sum("weight").alias("total"), F.count("*").alias("n"), (F.max("min_components") if "min_components" in config.columns else F.lit(None)).alias("least"))
    none = F.lit(None).cast("string").alias("component")
    empty = by.where(~F.coalesce(F.col("total") > 0, F.lit(False))).select(F.lit("no_weight").alias("rule"), "factor", none)
    return bad.unionByName(empty).unionByName(by.where("least > n").select(F.lit("minimum").alias("rule"), "factor", none))


def composite(scores: DataFrame) -> DataFrame:
    """(factor, month_end, score): weighted mean of the components that are there; null with fewer than the configured minimum, or else than the loaded ones.

    Missing components are left out and the weights of the others scaled; weights that vanish give null.
    """
    needed = scores.groupBy("factor").agg(_needed(scores))
    weight = F.sum(F.when(F.col("z").isNotNull(), F.col("weight")))
    by = scores.groupBy("factor", "month_end").agg(F.count("z").alias("n"), F.try_divide(F.sum(F.col("z") * F.col("weight")), weight).alias("score"))
    return by.join(needed, "factor").select("factor", "month_end", F.when(F.col("n") >= F.col("needed"), F.col("score")).alias("score"))


def contributions(scores: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """z times weight over the weights present, per component, at the last month of the panel.

    With ``config`` a factor shows only if its minimum, or else all of its configured components, are there.
    """
    w = Window.partitionBy("factor")
    last = scores.withColumn("end", F.max("month_end").over(w)).where("month_end = end and z is not null")
    if config is not None:
        needed = config.groupBy("factor").agg(_needed(config))
        last = last.withColumn("n", F.count("*").over(w)).join(F.broadcast(needed), "factor").where("n >= needed")  # a row per factor
    return last.withColumn("contribution", F.col("z") * F.col("weight") / F.sum("weight").over(w)).select("factor", "component", "month_end", "contribution")


def regimes(factors: DataFrame, growth: str = "growth", inflation: str = "inflation") -> DataFrame:
    """(month_end, growth, inflation, regime)."""
    wide = factors.groupBy("month_end").agg(F.max(F.when(F.col("factor") == growth, F.col("score"))).alias("growth"), F.max(F.when(F.col("factor") == inflation, F.col("score"))).alias("inflation"))
    return wide.withColumn("regime", regime(F.col("growth"), F.col("inflation")))


def factor_latest(factors: DataFrame) -> DataFrame:
    """Last non-null score per factor, the one before, and the change."""
    w = Window.partitionBy("factor").orderBy("month_end")
    rows = factors.where("score is not null").withColumn("previous", F.lag("score").over(w))
    return latest(rows, ["factor"], "month_end").withColumn("change", F.col("score") - F.col("previous"))


def regime_latest(table: DataFrame) -> DataFrame:
    """Last known regime, the one before, and whether it changed; one calendar of months in one window."""
    known = table.where("regime is not null")
    top = known.select(F.max(F.struct("month_end", "regime")).alias("now"))
    before = known.join(F.broadcast(top), F.col("month_end") < F.col("now.month_end")).groupBy("now").agg(F.max(F.struct("month_end", "regime")).alias("was"))
    return before.select(F.col("now.month_end").alias("month_end"), F.col("now.regime").alias("regime"), F.col("was.regime").alias("previous"), (F.col("now.regime") != F.col("was.regime")).alias("changed"))


def factor_status(factors: DataFrame) -> DataFrame:
    """``factor_latest`` for every factor, with a status and whether the score lies above its own past."""
    state = F.when(F.col("score") > 0, "above_expanding_mean").when(F.col("score").isNotNull(), "below_expanding_mean").otherwise("insufficient_data")
    rows = factors.select("factor").distinct().join(factor_latest(factors), "factor", "left")
    return rows.withColumn("status", F.when(F.col("score").isNotNull(), "available").otherwise("insufficient_data")).withColumn("state", state)


def factor_coverage(factors: DataFrame) -> DataFrame:
    """Per factor: months with a score, the first and the last."""
    known = F.col("score").isNotNull()
    return factors.groupBy("factor").agg(F.count(F.when(known, 1)).alias("months"), F.min(F.when(known, F.col("month_end"))).alias("first_month"), F.max(F.when(known, F.col("month_end"))).alias("last_month"))


def regime_months(table: DataFrame) -> DataFrame:
    """Months per regime."""
    return table.where("regime is not null").groupBy("regime").agg(F.count("*").alias("months"))


def component_sources(config: DataFrame) -> DataFrame:
    """(source, required): the series that a configuration reads; one that any component requires is not optional."""
    second = F.when(F.col("transform") == "real_rate_proxy", _optional(config, "inflation_source", "string"))
    optional = F.coalesce(F.col("optional"), F.lit(False)) if "optional" in config.columns else F.lit(False)
    each = config.select(F.explode(F.array_compact(F.array("source", second))).alias("source"), (~optional).alias("required"))
    return each.groupBy("source").agg(F.max("required").alias("required"))


def source_coverage(config: DataFrame, catalog: DataFrame, present: DataFrame) -> DataFrame:
    """(source, required, status) of configured series; ``catalog`` has (key, provider), ``present`` the series_id of landed snapshots.

    Status is present or missing for snapshots, provider_backed for others, and not_in_catalog.
    """
    rows = component_sources(config).join(catalog.select(F.col("key").alias("source"), "provider"), "source", "left")
    rows = rows.join(present.select(F.col("series_id").alias("source"), F.lit(True).alias("there")).distinct(), "source", "left")
    status = F.when(F.col("provider").isNull(), "not_in_catalog").when(F.col("provider") != "csv", "provider_backed").when(F.col("there"), "present").otherwise("missing")
    return rows.select("source", "required", status.alias("status"))


def country_factors(panel: DataFrame, config: DataFrame, least: int = 36) -> DataFrame:
    """(factor, month_end, score) of every configured factor; one without any loaded component is null in every month."""
    return all_factors(composite(expanding_zscore(transforms(panel, config), least)), panel, config)


def all_factors(made: DataFrame, panel: DataFrame, config: DataFrame) -> DataFrame:
    """Factors (factor, month_end, score) with a row for every configured factor and month of the panel."""
    grid = config.select("factor").distinct().join(panel.select("month_end").distinct(), F.lit(True))  # factors and months are few
    return grid.join(made, ["factor", "month_end"], "left")


def country_baseline(obs: DataFrame, config: DataFrame, start: str | None = None, end: str | None = None, least: int = 36, policy: str = "all", gate: bool = False) -> DataFrame:
    """Observations to regimes: policy, as-of panel, transforms, past-only scores, factors, quadrant.

    ``gate``: raise if an observation breaks the contract.
    """
    from almanac.operators.asof import asof_month_end
    from almanac.operators.contracts import apply_policy, require, violations

    if gate:
        require(violations(obs))
    return regimes(composite(expanding_zscore(transforms(asof_month_end(apply_policy(obs, policy), start, end), config), least)))
