"""Forward returns and signal diagnostics; horizons are rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HORIZONS = (1, 3, 6, 12)


def price_guard(prices: DataFrame) -> DataFrame:
    """Assets all of whose prices are positive: rates are not prices."""
    return prices.groupBy("asset").agg(F.min("price").alias("least")).where("least > 0").select("asset")


def forward_returns(prices: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(asset, month_end, horizon, fwd_return): all horizons from one window."""
    w = Window.partitionBy("asset").orderBy("month_end")
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), (F.try_divide(F.lead("price", h).over(w), F.col("price")) - 1).alias("fwd_return")) for h in horizons])
    return prices.withColumn("cells", cells).select("asset", "month_end", F.explode("cells").alias("c")).select("asset", "month_end", "c.*")


def regime_return_summary(regimes: DataFrame, forward: DataFrame) -> DataFrame:
    """Per regime, asset and horizon: count, mean, median, deviation and share of gains."""
    rows = forward.where("fwd_return is not null").join(regimes.where("regime is not null").select("month_end", "regime"), "month_end")
    r = F.col("fwd_return")
    return rows.groupBy("regime", "asset", "horizon").agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.median(r).alias("median"), F.stddev_samp(r).alias("std"), F.avg((r > 0).cast("double")).alias("positive_rate"))


def regime_research(regimes: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> tuple[DataFrame, DataFrame]:
    """Forward returns of the assets, and their summary by the regime of the month that they start in."""
    forward = forward_returns(prices, horizons)
    return forward, regime_return_summary(regimes, forward)


def cross_section(forward: DataFrame) -> DataFrame:
    """(month_end, horizon, y): mean over assets."""
    return forward.groupBy("month_end", "horizon").agg(F.avg("fwd_return").alias("y"))


def ranked(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Average rank of non-null values within keys, as ``rank_<column>``."""
    order = Window.partitionBy(*keys, F.col(column).isNull()).orderBy(column)
    peers = Window.partitionBy(*keys, column)
    rank = F.rank().over(order) + (F.count("*").over(peers) - 1) / 2
    return df.withColumn(f"rank_{column}", F.when(F.col(column).isNotNull(), rank))


def pairs(signal: DataFrame, target: DataFrame) -> DataFrame:
    """Signal rows with each horizon's target."""
    return signal.join(target, "month_end").select("horizon", "month_end", "signal", "y")


def _guarded(a: str, b: str):
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    fine = (F.count(F.when(both, 1)) >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return F.when(fine, F.corr(x, y)), F.count(F.when(both, 1))


def information_coefficient(paired: DataFrame) -> DataFrame:
    """(horizon, ic, n)."""
    ic, n = _guarded("signal", "y")
    return paired.groupBy("horizon").agg(ic.alias("ic"), n.alias("n"))


def rank_ic(paired: DataFrame) -> DataFrame:
    """(horizon, rank_ic, n), ranks taken over each series before pairing."""
    ic, n = _guarded("rank_signal", "rank_y")
    return ranked(ranked(paired, "signal", ["horizon"]), "y", ["horizon"]).groupBy("horizon").agg(ic.alias("rank_ic"), n.alias("n"))


def ic_stability(paired: DataFrame, window: int = 12, least: int = 24) -> DataFrame:
    """Mean over deviation of rolling correlations, annualised; null with too few windows."""
    w = Window.partitionBy("horizon").orderBy("month_end").rowsBetween(1 - window, 0)
    rolling = paired.where("signal is not null and y is not null").withColumn("ic", F.when(F.count("*").over(w) == window, F.corr("signal", "y").over(w)))
    mean, std = F.avg("ic"), F.stddev_samp("ic")
    return rolling.groupBy("horizon").agg(F.count("ic").alias("windows"), F.when((F.count("ic") >= least) & (std > 0), mean / std * F.sqrt(F.lit(12.0))).alias("ic_ir"))


def hit_rate(paired: DataFrame) -> DataFrame:
    """Share of pairs whose signal lies above its median exactly when the target is positive; null where the IC is undefined."""
    full = paired.where("signal is not null and y is not null")
    middle = full.groupBy("horizon").agg(F.median("signal").alias("middle"))
    hit = ((F.col("signal") > F.col("middle")) == (F.col("y") > 0)).cast("double")
    ic, n = _guarded("signal", "y")
    return full.join(F.broadcast(middle), "horizon").groupBy("horizon").agg(F.when(ic.isNotNull() & (n >= 2), F.avg(hit)).alias("hit_rate"), n.alias("n"))


def quantile_returns(paired: DataFrame, buckets: int = 5) -> DataFrame:
    """(horizon, bucket, n, mean, std) by linearly interpolated signal quantiles, right-closed."""
    full = paired.where("signal is not null and y is not null")
    points = F.array(*[F.lit(i / buckets) for i in range(buckets + 1)])
    edges = full.groupBy("horizon").agg(F.array_distinct(F.percentile("signal", points)).alias("edges"))
    bucket = F.greatest(F.size(F.filter("edges", lambda e: e < F.col("signal"))) - 1, F.lit(0))
    return full.join(F.broadcast(edges), "horizon").withColumn("bucket", bucket).groupBy("horizon", "bucket").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"))


def long_short(buckets: DataFrame) -> DataFrame:
    """Top bucket's mean minus the bottom one's."""
    return buckets.groupBy("horizon").agg((F.max_by("mean", "bucket") - F.min_by("mean", "bucket")).alias("spread"))


def idea_verdict(ics: DataFrame) -> DataFrame:
    """The horizon with the greatest absolute IC."""
    return ics.where("ic is not null").agg(F.max_by("horizon", F.abs("ic")).alias("best_horizon"), F.max_by("ic", F.abs("ic")).alias("best_ic"))


def percent_rank(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Average rank over the number of non-null values within keys, as ``pct_<column>``; the greatest is 1."""
    n = F.count(column).over(Window.partitionBy(*keys))
    return ranked(df, column, keys).withColumn(f"pct_{column}", F.col(f"rank_{column}") / n)


def signal_guard(signal: DataFrame) -> DataFrame:
    """(problem, month_end): why a signal (month_end, signal) can't be tested: no rows, or a month that repeats."""
    twice = signal.groupBy("month_end").count().where("count > 1").select(F.lit("duplicate_month").alias("problem"), "month_end")
    empty = signal.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("empty_signal").alias("problem"), F.lit(None).cast("date").alias("month_end"))
    return twice.unionByName(empty)


def strength(ic: str = "ic"):
    """Band of an absolute IC. 0.02, 0.05 and 0.10."""
    size = F.abs(F.col(ic))
    return F.when(size < 0.02, "negligible").when(size < 0.05, "weak").when(size < 0.10, "moderate").when(size.isNotNull(), "strong")


def diagnostics(paired: DataFrame) -> DataFrame:
    """(horizon, ic, n, rank_ic, ic_ir, hit_rate, strength, direction), one row per horizon."""
    out = information_coefficient(paired)
    for more in (rank_ic(paired).drop("n"), ic_stability(paired).drop("windows"), hit_rate(paired).drop("n")):
        out = out.join(more, "horizon", "left")
    return out.withColumn("strength", strength()).withColumn("direction", F.when(F.col("ic") > 0, "positive").when(F.col("ic").isNotNull(), "negative"))


def signal_verdict(found: DataFrame, few: int = 60, spread: float = 3.0) -> DataFrame:
    """One row from ``diagnostics``: the best horizon with its figures, and warnings on few pairs, no IC at all, and ICs that vary by more than ``spread``."""
    usable = (F.col("n") >= few) & F.col("ic").isNotNull()
    size = F.when(usable, F.abs("ic"))
    order = F.when(F.col("ic").isNotNull(), F.struct(F.abs("ic").alias("size"), (-F.col("horizon")).alias("sooner")))
    row = found.agg(
        F.max_by(F.struct("horizon", "ic", "ic_ir", "n", "strength", "direction"), order).alias("best"),
        F.max("n").alias("most"),
        F.count("ic").alias("defined"),
        F.count(size).alias("usable"),
        (F.max(size) / F.greatest(F.min(size), F.lit(1e-9))).alias("ratio"),
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("most") < few, F.lit("few_observations")),
            F.when(F.col("defined") == 0, F.lit("nothing_to_measure")),
            F.when((F.col("usable") > 1) & (F.col("ratio") > spread), F.lit("unstable_across_horizons")),
        )
    )
    return row.select("best.*", warnings.alias("warnings"))


def evaluate_idea(signal: Callable[[DataFrame], DataFrame], panel: DataFrame, columns: list[str], target: DataFrame) -> DataFrame:
    """Run a user's signal on the columns it may see, then its diagnostics per horizon.

    The signal is put on the panel's months, so one for another date does not count; a signal without rows or with a month twice is an error.
    """
    from almanac.operators.contracts import require

    made = signal(panel.select("month_end", *columns)).select("month_end", "signal")
    require(signal_guard(made))
    return diagnostics(pairs(panel.select("month_end").join(made, "month_end", "left"), target))


def idea_on_prices(signal: Callable[[DataFrame], DataFrame], panel: DataFrame, columns: list[str], prices: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """The same against asset prices (asset, month_end, price); assets with a price that is not positive are refused."""
    from almanac.operators.contracts import require

    require(prices.where("price <= 0").select("asset").distinct())
    return evaluate_idea(signal, panel, columns, cross_section(forward_returns(prices, horizons)))


def evaluate_ideas_in_pandas(panel: DataFrame, key: str, fn: Callable, schema: str) -> DataFrame:
    """A pandas signal function per universe, in parallel over ``key``."""
    return panel.groupBy(key).applyInPandas(fn, schema)


def ideas_in_pandas(panel: DataFrame, key: str, columns: list[str], ideas: dict[str, Callable], target: DataFrame) -> DataFrame:
    """(key, idea, horizon, n, ic) of many pandas signals over many universes at once.

    ``ideas`` map a name to a function of a universe's frame (month_end, and the columns that it may see, in order of month) that gives a series of its length. All ideas of a
    universe are taken from one frame, in one task per universe; months of one universe are few. ``target`` has (month_end, horizon, y). The correlation
    is null with fewer than three complete pairs or a side that is constant.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("month_end", kind="stable").reset_index(drop=True)
        seen = frame[["month_end", *columns]]
        made = [pd.DataFrame({key: frame[key], "month_end": frame["month_end"], "idea": name, "signal": pd.Series(idea(seen.copy())).astype(float).to_numpy()}) for name, idea in ideas.items()]
        return pd.concat(made, ignore_index=True)

    kind = panel.schema[key].dataType.simpleString()
    signals = evaluate_ideas_in_pandas(panel.select(key, "month_end", *columns), key, run, f"{key} {kind}, month_end date, idea string, signal double")
    both = signals.where("signal is not null and not isnan(signal)").join(target.where("y is not null"), "month_end")
    by = both.groupBy(key, "idea", "horizon").agg(F.count("*").alias("n"), F.corr("signal", "y").alias("ic"), F.stddev_samp("signal").alias("a"), F.stddev_samp("y").alias("b"))
    return by.select(key, "idea", "horizon", "n", F.when((F.col("n") >= 3) & (F.col("a") > 0) & (F.col("b") > 0), F.col("ic")).alias("ic"))
