"""Portfolio accounting for many strategies at once, without a loop over days.

Between two fills the holdings drift with prices, so growth since a fill is a weighted sum of price ratios; equity
is the running product of the growth of each holding period and of its fee. Every strategy has the calendar of its own
symbols, and all windows are keyed by strategy, so strategies are accounted for side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CASH = "CASH"
#: Periods by rebalance frequency; ``buy_and_hold`` fills once.
UNITS = {"monthly": "month", "quarterly": "quarter", "annual": "year", "yearly": "year"}
#: What a symbol may look like, and how far weights may sum from one.
SYMBOL, SUM_TOLERANCE = "^[A-Z0-9.^=_-]{1,24}$", 1e-8


def common_history(prices: DataFrame) -> DataFrame:
    """(first, last): the span in which every symbol has started and none has ended."""
    ends = prices.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return ends.agg(F.max("a").alias("first"), F.min("b").alias("last"))


def price_gaps(prices: DataFrame) -> DataFrame:
    """(date, missing symbols) inside the common history; dates are counted, no grid of all pairs is built."""
    span = common_history(prices)
    total = prices.agg(F.count_distinct("symbol").alias("symbols"))
    inside = prices.join(F.broadcast(span), F.col("date").between(F.col("first"), F.col("last")))  # one row
    by = inside.groupBy("date").agg(F.count_distinct("symbol").alias("present"))
    return by.join(F.broadcast(total), F.lit(True)).where("present < symbols").select("date", (F.col("symbols") - F.col("present")).alias("missing"))


def holdings(strategies: DataFrame) -> DataFrame:
    """(strategy_id, cost, symbol, w) of the assets that a strategy holds; cash is what is left."""
    return strategies.select("strategy_id", "cost", F.explode("weights").alias("symbol", "w")).where(F.col("symbol") != CASH)


def held_prices(prices: DataFrame, strategies: DataFrame) -> DataFrame:
    """(strategy_id, cost, symbol, w, date, price) inside each strategy's own common history, with the number of its ``symbols``."""
    rows = prices.where("price is not null").join(holdings(strategies), "symbol")
    ends = rows.groupBy("strategy_id", "symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    span = ends.groupBy("strategy_id").agg(F.max("a").alias("first"), F.min("b").alias("last"))
    symbols = holdings(strategies).groupBy("strategy_id").agg(F.count("*").alias("symbols"))
    return rows.join(span, "strategy_id").where("date between first and last").join(symbols, "strategy_id").drop("first", "last")


def strategy_gaps(prices: DataFrame, strategies: DataFrame) -> DataFrame:
    """(strategy_id, date, missing): sessions inside a strategy's common history without a price of some of its assets, which are named."""
    rows = held_prices(prices, strategies)
    by = rows.groupBy("strategy_id", "date").agg(F.collect_set("symbol").alias("there"), F.max("symbols").alias("symbols")).where(F.size("there") < F.col("symbols"))
    wanted = holdings(strategies).groupBy("strategy_id").agg(F.array_sort(F.collect_set("symbol")).alias("wanted"))  # a strategy's own symbols
    return by.join(wanted, "strategy_id").select("strategy_id", "date", F.array_except("wanted", "there").alias("missing"))


def dropped_rows(prices: DataFrame, strategies: DataFrame) -> DataFrame:
    """(strategy_id, dropped): dates outside the common history that only some of a strategy's assets have."""
    every = prices.where("price is not null").join(holdings(strategies), "symbol").groupBy("strategy_id").agg(F.count_distinct("date").alias("every"))
    kept = held_prices(prices, strategies).groupBy("strategy_id").agg(F.count_distinct("date").alias("kept"))
    return every.join(kept, "strategy_id", "left").select("strategy_id", (F.col("every") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def price_violations(prices: DataFrame) -> DataFrame:
    """(rule, symbol, date): prices that are missing, not finite or not positive, dates that repeat, and symbols of fewer than two dates."""
    price = F.col("price")
    rules = {"missing_price": price.isNull(), "not_finite": F.isnan(price) | (F.abs(price) == float("inf")), "not_positive": price <= 0}
    rows = prices.select(F.explode(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in rules.items()]))).alias("rule"), "symbol", "date")
    twice = prices.groupBy("symbol", "date").count().where("count > 1").select(F.lit("duplicate_date").alias("rule"), "symbol", "date")
    short = prices.groupBy("symbol").agg(F.count_distinct("date").alias("n")).where("n < 2").select(F.lit("too_short").alias("rule"), "symbol", F.lit(None).cast("date").alias("date"))
    return rows.unionByName(twice).unionByName(short)


def weight_violations(instructions: DataFrame, prices: DataFrame, allow_cash: bool = True) -> DataFrame:
    """(rule, strategy_id, date, symbol) of target weights (strategy_id, date, symbol, weight) against prices (symbol, date)."""
    w, key = F.col("weight"), ["strategy_id", "date"]
    finite = w.isNotNull() & ~F.isnan(w) & (F.abs(w) != float("inf"))
    rows = instructions.select(F.explode(F.array_compact(F.array(F.when(~finite, F.lit("not_finite")), F.when(finite & (w < -1e-12), F.lit("negative"))))).alias("rule"), *key, "symbol")
    nobody = F.lit(None).cast("string").alias("symbol")
    twice = instructions.groupBy(*key, "symbol").count().where("count > 1").select(F.lit("duplicate").alias("rule"), *key, "symbol")
    total = instructions.groupBy(*key).agg(F.sum("weight").alias("total"))
    off = total.where(F.col("total") > 1 + SUM_TOLERANCE if allow_cash else F.abs(F.col("total") - 1) >= SUM_TOLERANCE).select(F.lit("sum").alias("rule"), *key, nobody)
    unpriced = instructions.where(F.col("symbol") != CASH).join(prices.select("symbol").distinct(), "symbol", "left_anti").select(F.lit("no_prices").alias("rule"), *key, "symbol")
    other = instructions.select(*key).distinct().join(prices.select("date").distinct(), "date", "left_anti").select(F.lit("not_a_session").alias("rule"), *key, nobody)
    return rows.unionByName(twice).unionByName(off).unionByName(unpriced).unionByName(other)


def normal_symbol(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def strategy_violations(specs: DataFrame) -> DataFrame:
    """(rule, strategy_id) of strategy specifications.

    ``specs``: strategy_id, name, frequency, weights map, start_date, end_date, initial_capital, cost, and of a deposit plan contribution,
    contribution_day, tiers (array of (threshold, fraction)) and rules (array of (drawdown, cap)), null without a plan.
    """
    symbols, weights = F.transform(F.map_keys("weights"), normal_symbol), F.map_values("weights")

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    def unordered(name: str, bad) -> Column:
        pairs = F.arrays_zip(F.slice(name, 1, F.greatest(F.size(name) - 1, F.lit(0))).alias("x"), F.slice(name, 2, F.greatest(F.size(name) - 1, F.lit(0))).alias("y"))
        return F.exists(pairs, lambda p: bad(p["x"], p["y"]))

    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    name = F.trim("name")
    rules = {
        "name_length": ~F.length(name).between(1, 100),
        "frequency": ~F.col("frequency").isin("buy_and_hold", "monthly", "quarterly", "annual"),
        "no_weights": F.size("weights") <= 0,
        "symbol": F.exists(symbols, lambda s: ~s.rlike(SYMBOL)),
        "duplicate_symbol": F.size(F.array_distinct(symbols)) < F.size(symbols),
        "weight": F.exists(weights, lambda w: ~finite(w) | (w < 0)),
        "weights_sum": F.abs(total - 1) > SUM_TOLERANCE,
        "only_cash": F.forall(symbols, lambda s: s == CASH) & (F.size("weights") > 0),
        "initial_capital": ~finite(F.col("initial_capital")) | (F.col("initial_capital") <= 0),
        "cost": ~finite(F.col("cost")) | (F.col("cost") < 0),
        "dates": F.col("start_date") > F.col("end_date"),
        "contribution": ~finite(F.col("contribution")) & F.col("contribution").isNotNull() | (F.col("contribution") <= 0),
        "contribution_day": F.col("contribution").isNotNull() & ~F.coalesce(F.col("contribution_day").isin("MON", "TUE", "WED", "THU", "FRI"), F.lit(False)),
        "tier": F.exists("tiers", lambda t: ~(finite(t["threshold"]) & (t["threshold"] > 0) & finite(t["fraction"]) & (t["fraction"] > 0) & (t["fraction"] <= 1))),
        "tier_order": unordered("tiers", lambda x, y: x["threshold"] >= y["threshold"]),
        "rule": F.exists("rules", lambda r: ~((r["drawdown"] > 0) & (r["drawdown"] < 1) & (r["cap"] >= 0) & (r["cap"] <= 1))),
        "rule_order": unordered("rules", lambda x, y: x["drawdown"] >= y["drawdown"]),
        "rule_caps": unordered("rules", lambda x, y: x["cap"] <= y["cap"]),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(k in ("name_length", "frequency", "initial_capital", "cost"))), F.lit(k)) for k, test in rules.items()]))
    return specs.select(F.explode(broken).alias("rule"), "strategy_id")


def sessions(prices: DataFrame, strategies: DataFrame) -> DataFrame:
    """(strategy_id, date, pos): the sessions of each strategy's common history that all of its assets have, in order."""
    dates = held_prices(prices, strategies).groupBy("strategy_id", "date").agg(F.count("*").alias("n"), F.max("symbols").alias("symbols")).where("n = symbols")
    return dates.select("strategy_id", "date").withColumn("pos", F.row_number().over(Window.partitionBy("strategy_id").orderBy("date")) - 1)


def rebalance_instructions(strategies: DataFrame, calendar: DataFrame) -> DataFrame:
    """(strategy_id, signal_pos): the first session, then each session before a new month, quarter or year."""
    rows = calendar.withColumn("next", F.lead("date").over(Window.partitionBy("strategy_id").orderBy("date"))).join(strategies.select("strategy_id", "frequency"), "strategy_id")
    return rows.where((F.col("pos") == 0) | _turns(F.col("date"), F.col("next"))).select("strategy_id", F.col("pos").alias("signal_pos"))


def fills(instructions: DataFrame, calendar: DataFrame, lag: int = 1) -> DataFrame:
    """(strategy_id, pos, date): the session ``lag`` after the signal; fills past the end are dropped."""
    late = instructions.select("strategy_id", (F.col("signal_pos") + lag).alias("pos")).distinct()
    return late.join(calendar, ["strategy_id", "pos"])


def _turns(date: Column, after: Column) -> Column:
    """Whether the next session lies in another period of the strategy's frequency."""
    turn = F.lit(False)
    for name, u in UNITS.items():
        turn = turn | ((F.col("frequency") == name) & (F.date_trunc(u, date) != F.date_trunc(u, after)))
    return F.coalesce(turn, F.lit(False))


def _marked(prices: DataFrame, strategies: DataFrame, lag: int) -> DataFrame:
    """Each holding at each session that all of a strategy's assets have: its value since the fill that its opening holdings come from, and that value a session before.

    All assets of a strategy then share their sessions, so positions and fills come from one window per holding.
    """
    everyone = F.count("*").over(Window.partitionBy("strategy_id", "date")) == F.col("symbols")
    rows = held_prices(prices, strategies).withColumn("whole", everyone).where("whole").join(strategies.select("strategy_id", "frequency"), "strategy_id")
    w = Window.partitionBy("strategy_id", "symbol").orderBy("date")
    rows = rows.withColumn("pos", F.row_number().over(w) - 1).withColumn("signal", (F.col("pos") == 0) | _turns(F.col("date"), F.lead("date").over(w)))
    rows = rows.withColumn("fill", F.coalesce(F.lag("signal", lag).over(w), F.lit(False)) if lag else F.col("signal"))
    opened = F.last(F.when(F.col("fill"), F.col("price")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("p0", opened).withColumn("value", F.col("w") * F.col("price") / F.col("p0")).withColumn("before", F.col("w") * F.lag("price").over(w) / F.col("p0"))


def backtest_daily(prices: DataFrame, strategies: DataFrame, lag: int = 1, guard: bool = True) -> DataFrame:
    """(strategy_id, date, gross_return, net_return, turnover, equity, drawdown) of strategies (strategy_id, frequency, cost, weights map).

    ``guard``: raise if a strategy has a session without a price of one of its assets, as bridging it would book the
    return of several sessions as one. Without it such sessions are left out.
    """
    if guard:
        from almanac.operators.contracts import require

        require(strategy_gaps(prices, strategies))
    keys = ["strategy_id", "pos", "date"]
    total = _marked(prices, strategies, lag).groupBy(*keys).agg(
        F.max("cost").alias("cost"),
        F.max("fill").alias("fill"),
        F.sum("w").alias("invested"),
        F.sum("value").alias("value"),
        F.sum("before").alias("before"),
        F.collect_list(F.struct("w", "value")).alias("parts"),  # one per symbol of the strategy
    )
    growth = F.when(F.col("value").isNull(), 1.0).otherwise(1 - F.col("invested") + F.col("value"))
    opening = F.when(F.col("value").isNull(), 1.0).otherwise(1 - F.col("invested") + F.col("before"))
    drift = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + F.abs(p["w"] - F.coalesce(p["value"], F.lit(0.0)) / F.col("growth")))
    out = total.withColumn("growth", growth).withColumn("turnover", F.when(F.col("fill"), drift).otherwise(0.0))
    out = out.withColumn("gross_return", F.col("growth") / opening - 1)
    out = out.withColumn("net_return", (1 + F.col("gross_return")) * (1 - F.col("turnover") * F.col("cost")) - 1)
    run = Window.partitionBy("strategy_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("equity", F.product(1 + F.col("net_return")).over(run))
    out = out.withColumn("drawdown", F.col("equity") / F.greatest(F.max("equity").over(run), F.lit(1.0)) - 1)
    return out.select("strategy_id", "date", "gross_return", "net_return", "turnover", "equity", "drawdown")


def account_weights(prices: DataFrame, strategies: DataFrame, lag: int = 1) -> DataFrame:
    """(strategy_id, date, symbol, effective, ending): weights that earned the session's return, and weights after its trades; cash is a row of its own."""
    day = _marked(prices, strategies, lag)
    per = Window.partitionBy("strategy_id", "pos")
    growth = 1 - F.sum("w").over(per) + F.sum("value").over(per)
    ending = F.when(F.col("fill"), F.col("w")).when(F.col("value").isNotNull(), F.col("value") / growth).otherwise(0.0)
    assets = day.select("strategy_id", "pos", "date", "symbol", ending.alias("ending"))
    cash = assets.groupBy("strategy_id", "pos", "date").agg(F.greatest(1 - F.sum("ending"), F.lit(0.0)).alias("ending")).withColumn("symbol", F.lit(CASH))
    before = F.lag("ending").over(Window.partitionBy("strategy_id", "symbol").orderBy("pos"))
    rows = assets.unionByName(cash).withColumn("effective", F.coalesce(before, F.when(F.col("symbol") == CASH, 1.0).otherwise(0.0)))
    return rows.select("strategy_id", "date", "symbol", "effective", "ending")


def average_weights(weights: DataFrame) -> DataFrame:
    """(strategy_id, symbol, weight): mean effective weight, the first session left out."""
    first = weights.groupBy("strategy_id").agg(F.min("date").alias("first"))
    return weights.join(first, "strategy_id").where("date > first").groupBy("strategy_id", "symbol").agg(F.avg("effective").alias("weight"))


def weight_checks(weights: DataFrame) -> DataFrame:
    """(strategy_id, max_error, min_cash): how far weights with cash sum from one, and the least cash."""
    by = weights.groupBy("strategy_id", "date").agg(F.sum("ending").alias("total"), F.min(F.when(F.col("symbol") == CASH, F.col("ending"))).alias("cash"))
    return by.groupBy("strategy_id").agg(F.max(F.abs(F.col("total") - 1)).alias("max_error"), F.min("cash").alias("min_cash"))


def month_end_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key's last date in every month."""
    last = df.groupBy(*keys, F.date_trunc("month", "date").alias("_month")).agg(F.max("date").alias("date")).drop("_month")
    return df.join(last, [*keys, "date"])


def month_end_weights(weights: DataFrame) -> DataFrame:
    """(strategy_id, date, symbol, weight) after the last session of each month."""
    return month_end_rows(weights, ["strategy_id"]).select("strategy_id", "date", "symbol", F.col("ending").alias("weight"))


def sampled_curve(daily: DataFrame, most: int = 360, initial: float = 1.0) -> DataFrame:
    """(strategy_id, date, value): month-end equity, every n-th month if there are more than ``most``, the last kept; the start comes first.

    The limit is the feature: a curve to draw.
    """
    months = month_end_rows(daily.select("strategy_id", "date", "equity"), ["strategy_id"])
    w = Window.partitionBy("strategy_id")
    numbered = months.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("date")) - 1)
    stride = F.when(F.col("n") > most, F.floor(F.col("n") / most)).otherwise(1)
    picked = numbered.where((F.pmod(F.col("k"), stride) == 0) | (F.col("k") == F.col("n") - 1)).select("strategy_id", "date", (F.col("equity") * initial).alias("value"), F.lit(1).alias("place"))
    start = daily.groupBy("strategy_id").agg(F.min("date").alias("date")).select("strategy_id", "date", F.lit(initial).alias("value"), F.lit(0).alias("place"))
    return start.unionByName(picked)


def backtest_metrics(daily: DataFrame, year: float = 252.0, rf: float = 0.0) -> DataFrame:
    """One row per strategy: sessions, ending equity, returns, growth a year over n - 1 intervals, volatility, Sharpe ratio, drawdown, Calmar ratio, turnover."""
    r = F.col("net_return")
    by = daily.groupBy("strategy_id").agg(
        F.count("*").alias("n"),
        F.max_by("equity", "date").alias("ending"),
        (F.product(1 + F.col("gross_return")) - 1).alias("gross_total_return"),
        (F.stddev_samp(r) * F.sqrt(F.lit(year))).alias("volatility"),
        F.try_divide(F.avg(r - rf / year) * F.sqrt(F.lit(year)), F.stddev_samp(r)).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.sum("turnover").alias("turnover"),
    )
    by = by.withColumn("total_return", F.col("ending") - 1).withColumn("cagr", F.pow("ending", year / F.greatest(F.col("n") - 1, F.lit(1))) - 1)
    return by.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / -F.col("max_drawdown"))).withColumn("observations", F.col("n") - 1)


def period_returns(daily: DataFrame, unit: str) -> DataFrame:
    """(strategy_id, period, ret): compounded returns per month or year."""
    period = F.date_trunc(unit, "date").cast("date")
    return daily.groupBy("strategy_id", period.alias("period")).agg((F.product(1 + F.col("net_return")) - 1).alias("ret"))


def stress_years(daily: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """(strategy_id, year, ret, first_fill, worst): returns of chosen years, with the strategy's first fill and the date of its deepest drawdown."""
    about = daily.groupBy("strategy_id").agg(F.min(F.when(F.col("turnover") > 0, F.col("date"))).alias("first_fill"), F.min(F.struct("drawdown", "date"))["date"].alias("worst"))
    by = daily.where(F.year("date").isin(*years)).groupBy("strategy_id", F.year("date").alias("year")).agg((F.product(1 + F.col("net_return")) - 1).alias("ret"))
    return by.join(about, "strategy_id")


def drawdown_episode(daily: DataFrame) -> DataFrame:
    """Deepest drawdown per strategy: trough, the peak before it and the recovery, if any; none without a drawdown.

    The peak is at least the starting value, whose date is the first session.
    """
    worst = daily.groupBy("strategy_id").agg(F.min(F.struct("drawdown", "date")).alias("at"), F.min("date").alias("start")).where("at.drawdown < 0")
    rows = daily.join(worst.select("strategy_id", F.col("at.drawdown").alias("depth"), F.col("at.date").alias("trough"), "start"), "strategy_id")
    before = F.col("date") <= F.col("trough")
    top = F.greatest(F.max(F.when(before, F.col("equity"))).over(Window.partitionBy("strategy_id")), F.lit(1.0))
    by = rows.withColumn("top", top).groupBy("strategy_id", "depth", "trough", "start", "top").agg(
        F.min(F.when(before & (F.col("equity") == F.col("top")), F.col("date"))).alias("peak"),
        F.min(F.when(~before & (F.col("equity") >= F.col("top")), F.col("date"))).alias("recovery"),
    )
    peak = F.coalesce("peak", "start")
    return by.select("strategy_id", "depth", "trough", peak.alias("peak"), "recovery", F.datediff("trough", peak).alias("days_to_trough"), F.col("recovery").isNotNull().alias("recovered"))


def with_benchmarks(strategies: DataFrame) -> DataFrame:
    """The strategies and their benchmarks: the same weights bought once, and each asset alone; ``benchmark`` names them, null for the strategy itself.

    A benchmark's strategy_id is the strategy's with its name after a slash.
    """
    columns = ["strategy_id", "frequency", "cost", "weights"]
    own = strategies.select(*columns).withColumn("benchmark", F.lit(None).cast("string")).withColumn("of", F.col("strategy_id"))
    hold = strategies.select("strategy_id", "cost", "weights").withColumn("benchmark", F.lit("same_weights_buy_and_hold"))
    single = holdings(strategies).select("strategy_id", "cost", F.create_map("symbol", F.lit(1.0)).alias("weights"), F.concat("symbol", F.lit("_buy_and_hold")).alias("benchmark"))
    more = hold.unionByName(single).withColumn("of", F.col("strategy_id")).withColumn("frequency", F.lit("buy_and_hold"))
    more = more.withColumn("strategy_id", F.concat_ws("/", "of", "benchmark"))
    return own.unionByName(more)


def benchmark_metrics(prices: DataFrame, strategies: DataFrame, year: float = 252.0, guard: bool = True) -> DataFrame:
    """``backtest_metrics`` of every strategy and benchmark (of, benchmark), over the strategy's own sessions; ``guard`` as for ``backtest_daily``."""
    if guard:
        from almanac.operators.contracts import require

        require(strategy_gaps(prices, strategies))
    every = with_benchmarks(strategies)
    days = sessions(prices, strategies).select(F.col("strategy_id").alias("of"), "date")
    inside = prices.join(holdings(strategies).select(F.col("strategy_id").alias("of"), "symbol"), "symbol").join(days, ["of", "date"])
    # Prices are named by strategy, so that each is accounted for in its own span.
    named = inside.select(F.concat_ws("/", "of", "symbol").alias("symbol"), "date", "price")
    renamed = F.transform_keys("weights", lambda k, _: F.when(k == CASH, k).otherwise(F.concat_ws("/", "of", k)))
    daily = backtest_daily(named, every.withColumn("weights", renamed), guard=False)
    return backtest_metrics(daily, year).join(every.select("strategy_id", "of", "benchmark"), "strategy_id")


def contribution_sessions(calendar: DataFrame, weekday: str = "FRI") -> DataFrame:
    """Last session of each week that ends on the weekday."""
    return calendar.groupBy(F.next_day(F.date_sub("date", 1), weekday).alias("week")).agg(F.max("date").alias("date")).select("date")


def deposit_units(prices: DataFrame, deposits: DataFrame, weights: DataFrame) -> DataFrame:
    """(symbol, date, units): units bought so far when every deposit (date, amount) is spent by weight."""
    rows = prices.join(weights, "symbol").join(deposits, "date", "left")
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    bought = F.coalesce(F.col("amount"), F.lit(0.0)) * F.col("weight") / F.col("price")
    return rows.select("symbol", "date", "price", F.sum(bought).over(w).alias("units"))


def unit_nav(units: DataFrame, deposits: DataFrame) -> DataFrame:
    """(date, equity, flow, nav): value of one account, and growth of a unit without deposits."""
    value = units.groupBy("date").agg(F.sum(F.col("units") * F.col("price")).alias("equity"))
    rows = value.join(deposits.select("date", F.col("amount").alias("flow")), "date", "left").fillna(0.0, ["flow"])
    return _chained(rows.withColumn("account", F.lit(0)).withColumn("opening", F.lit(None).cast("double"))).drop("account", "opening")


def _chained(rows: DataFrame) -> DataFrame:
    """Growth without flows, chained per account; the first session's is against what was paid in, where ``opening`` says so."""
    w = Window.partitionBy("account").orderBy("date")
    growth = F.coalesce(F.try_divide(F.col("equity") - F.col("flow"), F.lag("equity").over(w)), F.try_divide(F.col("equity"), F.col("opening")), F.lit(1.0))
    return rows.withColumn("g", growth).withColumn("nav", F.product("g").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("g")


def deposit_accounts(prices: DataFrame, plans: DataFrame) -> DataFrame:
    """(account, date, equity, flow, nav, drawdown) of fully invested deposit plans, all at once.

    ``plans``: account, initial, amount, weekday, cost, weights map that sums to 1 without cash. The initial capital is invested at
    the first session, each week's deposit at the last session of the week that ends on the weekday; a budget of b buys for b / (1 + cost).
    """
    strategies = plans.select(F.col("account").alias("strategy_id"), F.lit("buy_and_hold").alias("frequency"), "cost", "weights")
    held = held_prices(prices, strategies).withColumnRenamed("strategy_id", "account")
    dates = held.select("account", "date").distinct().join(plans.select("account", "initial", "amount", "weekday", "cost"), "account")
    week = F.expr("next_day(date_sub(date, 1), weekday)")
    due = F.col("date") == F.max("date").over(Window.partitionBy("account", week))
    first = F.col("date") == F.min("date").over(Window.partitionBy("account"))
    paid = dates.withColumn("deposit", F.when(due, F.col("amount")).otherwise(0.0)).withColumn("start", F.when(first, F.col("initial")).otherwise(0.0))
    paid = paid.select("account", "date", "deposit", "start", ((F.col("deposit") + F.col("start")) / (1 + F.col("cost"))).alias("spent"))
    rows = held.drop("cost").join(paid, ["account", "date"])
    w = Window.partitionBy("account", "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    units = rows.withColumn("units", F.sum(F.col("spent") * F.col("w") / F.col("price")).over(w))
    value = units.groupBy("account", "date").agg(F.sum(F.col("units") * F.col("price")).alias("equity"), F.max("deposit").alias("flow"), F.max("start").alias("start"))
    opening = F.when(F.col("start") > 0, F.col("start") + F.col("flow"))
    out = _chained(value.withColumn("opening", opening))
    run = Window.partitionBy("account").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("account", "date", "equity", "flow", "start", "nav", (F.col("nav") / F.greatest(F.max("nav").over(run), F.lit(1.0)) - 1).alias("drawdown"))


def deposit_summary(accounts: DataFrame) -> DataFrame:
    """Per account: deposits, what was paid in, ending equity and unit value, drawdown, and the money-weighted return."""
    by = accounts.groupBy("account").agg(F.count(F.when(F.col("flow") > 0, 1)).alias("contributions"), F.sum(F.col("flow") + F.col("start")).alias("paid_in"), F.max_by("equity", "date").alias("equity"), F.max_by("nav", "date").alias("nav"), F.min("drawdown").alias("max_drawdown"))
    last = accounts.groupBy("account").agg(F.max("date").alias("date"), F.max_by("equity", "date").alias("amount"))
    flows = accounts.select("account", "date", (-F.col("flow") - F.col("start")).alias("amount")).where("amount <> 0").unionByName(last)
    return by.join(xirr(flows), "account", "left")


def _roots(times: pa.Array, amounts: pa.Array, steps: int) -> pa.Array:
    """Rates at which flows (a list of times and one of amounts per account) are worth nothing; all accounts of a batch are halved at once."""
    counts = pc.list_value_length(times).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(counts):
        return pa.array([], pa.float64())
    t, amount = (x.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for x in (times, amounts))
    starts = np.cumsum(counts) - counts

    def sign(rate: np.ndarray) -> np.ndarray:
        return np.sign(np.add.reduceat(amount * np.repeat(1 + rate, counts) ** -t, starts))

    with np.errstate(all="ignore"):
        lo, high = np.full(len(counts), -0.9999), np.ones(len(counts))
        at_low = sign(lo)
        for _ in range(25):
            wider = ~(at_low * sign(high) <= 0) & (high < 1e6)
            if not wider.any():
                break
            high = np.where(wider, high * 2 + 1, high)
        fine, hi = at_low * sign(high) <= 0, high
        for _ in range(steps):
            mid = (lo + hi) / 2
            same = sign(mid) == at_low
            now = np.where(same, mid, lo), np.where(same, hi, mid)
            if np.array_equal(now[0], lo) and np.array_equal(now[1], hi):  # no number lies between the two: further steps change nothing
                break
            lo, hi = now
    return pa.array((lo + hi) / 2, mask=~fine)


def xirr(flows: DataFrame, steps: int = 160) -> DataFrame:
    """(account, xirr): money-weighted return a year of dated flows (account, date, amount).

    Flows of a day are summed first, so an account holds one value per day. The bracket [-0.9999, 1] is widened until the value of the flows changes
    its sign, then halved on that sign; null unless flows have both signs, or if there is no change below a million.
    """
    daily = flows.groupBy("account", "date").agg(F.sum("amount").cast("double").alias("amount"), F.max("amount").alias("most"), F.min("amount").alias("least"))
    fine = (F.max("most") > 0) & (F.min("least") < 0)
    by = daily.groupBy("account").agg(F.array_sort(F.collect_list(F.struct("date", "amount"))).alias("flows"), F.min("date").alias("first"), fine.alias("fine"))
    times = F.transform("flows", lambda f: F.datediff(f["date"], F.col("first")) / 365.25)

    @F.arrow_udf("double")
    def roots(times: pa.Array, amounts: pa.Array) -> pa.Array:
        return _roots(times, amounts, steps)

    rows = by.select("account", "fine", roots(times, F.col("flows.amount")).alias("root"))
    return rows.select("account", F.when(F.col("fine"), F.col("root")).alias("xirr"))


def take_profit_triggers(nav: DataFrame, tiers: tuple[float, ...]) -> DataFrame:
    """(tier, date): first date on which the cumulative return reaches each tier."""
    cells = F.array(*[F.struct(F.lit(t).alias("tier"), F.when(F.col("nav") - 1 >= t, F.col("date")).alias("date")) for t in tiers])
    return nav.select(F.explode(cells).alias("c")).groupBy("c.tier").agg(F.min("c.date").alias("date"))


def drawdown_triggers(nav: DataFrame, rules: tuple[tuple[float, float], ...], base: float = 1.0) -> DataFrame:
    """(account, date, event, cap, drawdown): when drawdown rules (drawdown, cap) bind on a table (account, date, nav), and when a new high lifts them.

    The deepest rule that a date breaks counts, if its cap is below the one in force since the last new high; rules are in order of depth.
    """
    w = Window.partitionBy("account").orderBy("date")
    high = F.greatest(F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    rows = nav.withColumn("new", F.col("nav") > F.coalesce(high, F.lit(1.0)))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("epoch", F.sum(F.col("new").cast("int")).over(run)).withColumn("drawdown", F.col("nav") / F.greatest(F.max("nav").over(run), F.lit(1.0)) - 1)
    cap = F.lit(base)
    for depth, most in rules:
        cap = F.when(F.col("drawdown") <= -depth, min(most, base)).otherwise(cap)
    since = Window.partitionBy("account", "epoch").orderBy("date")
    rows = rows.withColumn("cap", cap).withColumn("force", F.coalesce(F.min("cap").over(since.rowsBetween(Window.unboundedPreceding, -1)), F.lit(base)))
    rows = rows.withColumn("left", F.lag(F.least("force", "cap")).over(w))
    event = F.when(F.col("cap") < F.col("force"), "triggered").when(F.col("new") & (F.col("left") < base), "rearmed")
    return rows.withColumn("event", event).where("event is not null").select("account", "date", "event", F.when(F.col("event") == "rearmed", F.lit(base)).otherwise(F.col("cap")).alias("cap"), "drawdown")


def paired_effects(runs: DataFrame, switch: str, others: list[str], metric: str) -> DataFrame:
    """Rows equal on all other switches: the metric with the switch minus without, as mean and count."""
    both = runs.groupBy(*others).agg(F.max(F.when(F.col(switch), F.col(metric))).alias("on"), F.max(F.when(~F.col(switch), F.col(metric))).alias("off"))
    return both.where("on is not null and off is not null").agg(F.avg(F.col("on") - F.col("off")).alias("effect"), F.count("*").alias("pairs"))


def effects(runs: DataFrame, switches: list[str], metrics: list[str]) -> DataFrame:
    """(switch, metric, effect, pairs) of a full factorial table: every switch and metric, over pairs that differ in that switch alone."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])
    flags = F.array(*[F.struct(F.lit(s).alias("switch"), F.col(s).alias("on"), F.concat_ws(",", *[F.col(o).cast("string") for o in switches if o != s]).alias("others")) for s in switches])
    long = runs.select(F.explode(flags).alias("f"), cells.alias("cells")).select("f.*", F.explode("cells").alias("c")).select("switch", "on", "others", "c.*")
    both = long.groupBy("switch", "metric", "others").agg(F.max(F.when(F.col("on"), F.col("x"))).alias("a"), F.max(F.when(~F.col("on"), F.col("x"))).alias("b"))
    return both.where("a is not null and b is not null").groupBy("switch", "metric").agg(F.avg(F.col("a") - F.col("b")).alias("effect"), F.count("*").alias("pairs"))


def experiment_id(switches: list[str]) -> Column:
    """A name of a run from its switches, such as ``lag1-cost0``."""
    return F.concat_ws("-", *[F.concat(F.lit(s), F.col(s).cast("int").cast("string")) for s in switches])


def compare_pairs(results: DataFrame, pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """(run, other, metric, delta) of named pairs (run, other) out of results (run, metrics...)."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])
    long = results.select("run", F.explode(cells).alias("c")).select("run", "c.*")
    a, b = long.withColumnRenamed("x", "a"), long.select(F.col("run").alias("other"), "metric", F.col("x").alias("b"))
    return pairs.join(a, "run").join(b, ["other", "metric"]).select("run", "other", "metric", (F.col("a") - F.col("b")).alias("delta"))


def against_reference(results: DataFrame, reference: DataFrame) -> DataFrame:
    """(strategy_id, metric, value, expected, delta) of long results against stated values (strategy_id, metric, expected)."""
    return reference.join(results, ["strategy_id", "metric"], "left").withColumn("delta", F.col("value") - F.col("expected")).select("strategy_id", "metric", "value", "expected", "delta")


def event_counts(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Events per account and kind, a column per kind."""
    return events.groupBy("account").agg(*[F.count(F.when(F.col("event") == k, 1)).alias(k) for k in kinds])


def finite_or_null(df: DataFrame) -> DataFrame:
    """Doubles that are no finite number become null, as JSON has none."""
    return df.select(*[F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def panel_hash(prices: DataFrame, strategies: DataFrame) -> DataFrame:
    """(strategy_id, sha256) of each strategy's aligned prices: a hash per session, then one over them in order."""
    rows = held_prices(prices, strategies)
    line = F.concat_ws("=", "symbol", F.col("price").cast("string"))
    day = rows.groupBy("strategy_id", "date").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ";"), 256).alias("h"))  # a strategy's own symbols
    text = F.transform(F.array_sort(F.collect_list(F.struct("date", "h"))), lambda x: F.concat_ws(":", x["date"].cast("string"), x["h"]))  # its own sessions
    return day.groupBy("strategy_id").agg(F.sha2(F.array_join(text, "\n"), 256).alias("sha256"))


def strategy_reports(daily: DataFrame, weights: DataFrame, year: float = 252.0, rf: float = 0.0, most: int = 360) -> DataFrame:
    """One nested document per strategy: ``summary``, ``monthly`` and ``annual`` returns, ``drawdown``, ``curve``, ``month_end_weights`` and ``average_weights``.

    Lists are in order of date and bounded by a strategy's own months and symbols; the rows of accounts are reduced before they are gathered. A strategy
    without a drawdown has null there. ``sources.readers.save_reports`` writes the documents as JSON, without numbers that are not finite.
    """
    metrics = finite_or_null(backtest_metrics(daily, year, rf))
    summary = metrics.select("strategy_id", F.struct(*[c for c in metrics.columns if c != "strategy_id"]).alias("summary"))

    def listed(df: DataFrame, name: str, *fields: str) -> DataFrame:
        return df.groupBy("strategy_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    episode = drawdown_episode(daily)
    parts = [
        listed(period_returns(daily, "month"), "monthly", "period", "ret"),
        listed(period_returns(daily, "year"), "annual", "period", "ret"),
        listed(sampled_curve(daily, most), "curve", "date", "place", "value"),
        episode.select("strategy_id", F.struct(*[c for c in episode.columns if c != "strategy_id"]).alias("drawdown")),
        listed(month_end_weights(weights), "month_end_weights", "date", "symbol", "weight"),
        listed(average_weights(weights), "average_weights", "symbol", "weight"),
    ]
    for part in parts:
        summary = summary.join(part, "strategy_id", "left")
    return summary
