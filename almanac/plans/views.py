"""The test tables read as observations, ledgers, prices, fundamentals, flows and strategies; ``SQL`` says the same."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.last_day("o_orderdate").alias("observation_date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    digit = F.substring("series_id", 1, 1).cast("int")
    basis = F.get(F.array(*map(F.lit, ("official_release", "official_schedule", "fixed_lag", "unverified", "unknown"))), digit - 1)
    return by.withColumn("lag_days", digit * 7).withColumn("availability_basis", basis).withColumn("available_date", F.when(digit < 5, F.date_add("observation_date", digit * 7)))


def config(spark: SparkSession) -> DataFrame:
    rows = [
        ("growth", "urgent", "1-URGENT", "yoy", None, 0.6, 1, False, None, None),
        ("growth", "high", "2-HIGH", "diff", 3, 0.4, 1, False, None, None),
        ("inflation", "medium", "3-MEDIUM", "level", 1, 0.5, 1, False, None, None),
        ("inflation", "unspecified", "4-NOT SPECIFIED", "pct_change", 1, 0.5, -1, False, None, None),
        ("liquidity", "half_year", "1-URGENT", "yoy", 6, 0.5, 1, False, None, 2),
        ("liquidity", "balance", "2-HIGH", "distance_from_50", None, 0.3, 1, False, None, 2),
        ("liquidity", "real", "3-MEDIUM", "real_rate_proxy", None, 0.2, -1, False, "4-NOT SPECIFIED", 2),
        ("liquidity", "absent", "6-ABSENT", "level", None, 0.2, 1, True, None, 2),
    ]
    return spark.createDataFrame(rows, "factor string, component string, source string, transform string, periods int, weight double, sign int, optional boolean, inflation_source string, min_components int")


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _shipped(spark, sf_dir).groupBy(F.col("l_returnflag").alias("series_id"), F.last_day("o_orderdate").alias("observation_date"), F.last_day("l_shipdate").alias("vintage")).agg(F.sum("l_extendedprice").alias("amount"))
    w = Window.partitionBy("series_id", "observation_date").orderBy("vintage").rowsBetween(Window.unboundedPreceding, 0)
    return by.select("series_id", "observation_date", "vintage", F.col("vintage").alias("available_date"), F.round(F.sum("amount").over(w), 2).alias("value"), F.lit("https://example.org/a").alias("source_url"))


def watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with all columns: February's row is joint with January, which has none; releases of R in even months are undated."""
    base, m = ledger(spark, sf_dir).where("month(observation_date) <> 1"), F.month("observation_date")
    unknown = (F.col("series_id") == "R") & (m % 2 == 0)
    year = F.date_format("observation_date", "yyyy")
    return base.select(
        "series_id",
        F.when(m == 2, F.concat(year, F.lit("-01/"), year, F.lit("-02"))).otherwise(F.date_format("observation_date", "yyyy-MM")).alias("observation_period"),
        "observation_date",
        F.when(~unknown, F.col("available_date")).alias("available_date"),
        F.when(unknown, "unknown").otherwise("official_release").alias("availability_basis"),
        F.to_timestamp(F.concat(F.date_format("vintage", "yyyy-MM-dd"), F.lit(" 12:00:00"))).alias("retrieved_at"),
        "value",
        F.lit("percent").alias("unit"),
        F.lit("https://example.org/v").alias("source_value_url"),
        F.when(unknown, "").otherwise("https://example.org/e").alias("availability_evidence_url"),
        F.when(~unknown, F.col("vintage")).alias("vintage"),
        F.when(m == 7, F.array(F.lit("methodology_change_review"))).otherwise(F.array().cast("array<string>")).alias("quality_flags"),
        F.lit("title").alias("source_title"),
    )


def _priced(spark: SparkSession, sf_dir: str, symbol: str, day) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_type").alias(symbol), day.alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))


def monthly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir, "asset", F.last_day("l_shipdate")).withColumnRenamed("date", "month_end")


def weekly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir, "symbol", F.date_trunc("week", "l_shipdate").cast("date"))


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir, "symbol", F.col("l_shipdate").cast("date"))


def session_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), F.col("ts").cast("date").alias("date")).agg(F.avg("value").alias("price"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate"), 2))
    metric = F.concat_ws("_", "l_returnflag", "l_linestatus")
    rows = _shipped(spark, sf_dir).select(F.col("l_suppkey").alias("company_id"), metric.alias("metric"), quarter.alias("period_end"), F.greatest(F.col("l_shipdate").cast("date"), quarter).alias("available_date"), "l_extendedprice")
    by = rows.groupBy("company_id", "metric", "period_end", "available_date").agg(F.sum("l_extendedprice").alias("amount"))
    w = Window.partitionBy("company_id", "metric", "period_end").orderBy("available_date").rowsBetween(Window.unboundedPreceding, 0)
    return by.select("company_id", "metric", "period_end", "available_date", F.round(F.sum("amount").over(w), 2).alias("value"))


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    by = rows.groupBy(F.col("c_nationkey").alias("holder"), F.last_day("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("amount"))
    w = Window.partitionBy("holder").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return by.select("holder", "date", F.round(F.sum("amount").over(w), 2).alias("stock"))


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    suppliers, customers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.sum("amount").alias("amount"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("entity"), F.col("c_mktsegment").alias("component")).agg((F.avg("c_acctbal") / 1000).alias("score"), F.count("*").alias("n"))
    total = by.groupBy("entity").agg(F.sum("n").alias("total"))
    return by.join(total, "entity").select("entity", "component", "score", F.length("component").cast("double").alias("weight"), (F.col("n") / F.col("total")).alias("confidence"))


def strategies(spark: SparkSession) -> DataFrame:
    rows = [("even", "monthly", 0.001, {"ECONOMY": 0.25, "LARGE": 0.25, "MEDIUM": 0.25, "SMALL": 0.25}), ("half", "quarterly", 0.0005, {"PROMO": 0.3, "STANDARD": 0.2}), ("pair", "annual", 0.0, {"ECONOMY": 0.5, "PROMO": 0.5})]
    return spark.createDataFrame(rows, "strategy_id string, frequency string, cost double, weights map<string, double>")


SQL = {
    "v_obs": """select series_id, observation_date, value, d * 7 as lag_days, ['official_release', 'official_schedule', 'fixed_lag', 'unverified', 'unknown'][d] as availability_basis,
        case when d < 5 then observation_date + d * 7 end as available_date
      from (select o_orderpriority as series_id, cast(last_day(o_orderdate) as date) as observation_date, round(sum(o_totalprice), 2) as value, cast(substr(o_orderpriority, 1, 1) as int) as d from orders group by all)""",
    "v_cal": "select cast(last_day(m) as date) as month_end from (select a, b, unnest(generate_series(date_trunc('month', a), b, interval 1 month)) as m from (select min(available_date) as a, max(available_date) as b from v_obs)) where last_day(m) between a and b",
    "v_cal_l": "select cast(last_day(m) as date) as month_end from (select a, b, unnest(generate_series(date_trunc('month', a), last_day(b), interval 1 month)) as m from (select min(vintage) as a, max(vintage) as b from v_ledger)) where last_day(m) between a and last_day(b)",
    "v_panel": """select s.series_id, c.month_end, (select arg_max(value, (available_date, observation_date)) from v_obs o where o.series_id = s.series_id and o.available_date <= c.month_end) as value
      from (select distinct series_id from v_obs) s cross join v_cal c""",
    "v_cfg": """select * from (values ('growth', 'urgent', '1-URGENT', 'yoy', 12, 0.6::double, 1, null, null), ('growth', 'high', '2-HIGH', 'diff', 3, 0.4::double, 1, null, null), ('inflation', 'medium', '3-MEDIUM', 'level', 1, 0.5::double, 1, null, null),
      ('inflation', 'unspecified', '4-NOT SPECIFIED', 'pct_change', 1, 0.5::double, -1, null, null), ('liquidity', 'half_year', '1-URGENT', 'yoy', 6, 0.5, 1, null, 2), ('liquidity', 'balance', '2-HIGH', 'distance_from_50', 1, 0.3, 1, null, 2),
      ('liquidity', 'real', '3-MEDIUM', 'real_rate_proxy', 1, 0.2, -1, '4-NOT SPECIFIED', 2), ('liquidity', 'absent', '6-ABSENT', 'level', 1, 0.2, 1, null, 2)) t(factor, component, source, transform, periods, weight, sign, second, least)""",
    "v_num": "select *, row_number() over (partition by series_id order by month_end) as rn from v_panel",
    "v_tr": """select factor, component, n.series_id, n.month_end, weight, least, sign * case transform when 'level' then n.value when 'diff' then n.value - b.value when 'distance_from_50' then n.value - 50 when 'real_rate_proxy' then n.value - o.value else n.value / nullif(b.value, 0) - 1 end as x
      from v_num n join v_cfg on n.series_id = source left join v_num b on b.series_id = n.series_id and b.rn = n.rn - periods left join v_num o on o.series_id = second and o.rn = n.rn""",
    "v_z": """select *, case when count(x) over w >= 36 then (x - avg(x) over w) / nullif(stddev_samp(x) over w, 0) end as z from v_tr
      window w as (partition by factor, component order by month_end rows between unbounded preceding and 1 preceding)""",
    "v_factor": """select factor, month_end, case when count(z) >= max(coalesce(least, components)) then sum(z * weight) / sum(case when z is not null then weight end) end as score from v_z join (select factor, count(distinct component) as components from v_tr group by 1) using (factor) group by all""",
    "v_regime": """select month_end, growth, inflation, case when growth is null or inflation is null then null when growth > 0 and inflation <= 0 then 'goldilocks' when growth > 0 then 'reflation' when inflation > 0 then 'stagflation' else 'recession' end as regime
      from (select month_end, max(score) filter (factor = 'growth') as growth, max(score) filter (factor = 'inflation') as inflation from v_factor group by 1)""",
    "v_ship": "select * from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate",
    "v_ledger": """select series_id, observation_date, vintage, vintage as available_date, round(sum(amount) over (partition by series_id, observation_date order by vintage rows unbounded preceding), 2) as value
      from (select l_returnflag as series_id, cast(last_day(o_orderdate) as date) as observation_date, cast(last_day(l_shipdate) as date) as vintage, sum(l_extendedprice) as amount from v_ship group by all)""",
    "v_watch": """select series_id, case when m = 2 then y || '-01/' || y || '-02' else strftime(observation_date, '%Y-%m') end as observation_period, observation_date, case when not u then available_date end as available_date,
        case when u then 'unknown' else 'official_release' end as availability_basis, vintage as landed, value, case when u then '' else 'https://example.org/e' end as evidence_url, case when not u then vintage end as vintage, m
      from (select *, month(observation_date) as m, strftime(observation_date, '%Y') as y, series_id = 'R' and month(observation_date) % 2 = 0 as u from v_ledger) where m <> 1""",
    "v_price_m": "select p_type as asset, cast(last_day(l_shipdate) as date) as month_end, sum(l_extendedprice) / sum(l_quantity) as price from lineitem join part on l_partkey = p_partkey group by all",
    "v_price_w": "select p_type as symbol, cast(date_trunc('week', l_shipdate) as date) as date, sum(l_extendedprice) / sum(l_quantity) as price from lineitem join part on l_partkey = p_partkey group by all",
    "v_price_d": "select p_type as symbol, cast(l_shipdate as date) as date, sum(l_extendedprice) / sum(l_quantity) as price from lineitem join part on l_partkey = p_partkey group by all",
    "v_session": "select event_type as symbol, cast(ts as date) as date, avg(value) as price from events group by all",
    "v_fwd": """select asset, month_end, h as horizon, case h when 1 then lead(price, 1) over w when 3 then lead(price, 3) over w when 6 then lead(price, 6) over w else lead(price, 12) over w end / nullif(price, 0) - 1 as fwd_return
      from v_price_m cross join (select unnest([1, 3, 6, 12]) as h) window w as (partition by asset, h order by month_end)""",
    "v_pair": """select horizon, month_end, signal, y from (select month_end, value as signal from v_panel where series_id = '1-URGENT') join (select month_end, horizon, avg(fwd_return) as y from v_fwd group by all) using (month_end)""",
    "v_bucket": """select horizon, greatest(len(list_filter(edges, lambda e: e < signal)) - 1, 0) as bucket, count(*) as n, avg(y) as mean, stddev_samp(y) as std from
      (select * from v_pair where signal is not null and y is not null) join (select horizon, list_sort(list_distinct(quantile_cont(signal, [0, 0.2, 0.4, 0.6, 0.8, 1]))) as edges from v_pair where signal is not null and y is not null group by 1) using (horizon) group by all""",
    "v_fund": """select company_id, metric, period_end, available_date, round(sum(amount) over (partition by company_id, metric, period_end order by available_date rows unbounded preceding), 2) as value from
      (select l_suppkey as company_id, l_returnflag || '_' || l_linestatus as metric, cast(last_day(date_trunc('quarter', o_orderdate) + interval 2 month) as date) as period_end,
        greatest(cast(l_shipdate as date), cast(last_day(date_trunc('quarter', o_orderdate) + interval 2 month) as date)) as available_date, sum(l_extendedprice) as amount from v_ship group by all)""",
    "v_stock": """select holder, date, round(sum(amount) over (partition by holder order by date rows unbounded preceding), 2) as stock from
      (select c_nationkey as holder, cast(last_day(o_orderdate) as date) as date, sum(o_totalprice) as amount from orders join customer on o_custkey = c_custkey group by all)""",
    "v_flow": """select s_nationkey as src, c_nationkey as dst, sum(l_extendedprice * (1 - l_discount)) as amount from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all""",
    "v_sig": """select entity, component, score, cast(length(component) as double) as weight, n / sum(n) over (partition by entity) as confidence from
      (select c_nationkey as entity, c_mktsegment as component, avg(c_acctbal) / 1000 as score, count(*) as n from customer group by all)""",
    "v_strat": """select * from (values ('even', 'month', 0.001::double, ['ECONOMY', 'LARGE', 'MEDIUM', 'SMALL'], [0.25::double, 0.25, 0.25, 0.25]), ('half', 'quarter', 0.0005, ['PROMO', 'STANDARD'], [0.3, 0.2]), ('pair', 'year', 0.0, ['ECONOMY', 'PROMO'], [0.5, 0.5])) t(strategy_id, u, cost, symbols, ws)""",
    "v_span": "select strategy_id, max(a) as a, min(b) as b from (select strategy_id, symbol, min(date) as a, max(date) as b from v_price_d join (select strategy_id, unnest(symbols) as symbol from v_strat) using (symbol) group by all) group by 1",
    "v_price_m_w": "select asset as symbol, month_end as date from v_price_m",
    # Prices of each strategy's sessions as lists in the order of its symbols.
    "v_sess": """select strategy_id, cost, ws, date, p, pos, pos = 1 or date_trunc(u, d1) <> date_trunc(u, date) and pos > 1 as fill from
      (select *, row_number() over (partition by strategy_id order by date) - 1 as pos, lag(date) over (partition by strategy_id order by date) as d1 from
        (select strategy_id, any_value(u) as u, any_value(cost) as cost, any_value(ws) as ws, date, list(price order by symbol) as p from v_price_w join (select *, unnest(symbols) as symbol from v_strat) using (symbol) group by strategy_id, date having count(*) = len(any_value(symbols))))""",
    # A loop over days: mark to the close, then trade to the target and pay the fee.
    "v_loop": """select strategy_id, date, pos, ws, 1.0::double as equity, 1.0::double as opening, 1.0::double as marked, 0.0::double as turnover, 1.0::double as cash, list_transform(ws, lambda w: 0.0::double) as units, list_transform(ws, lambda w: 0.0::double) as held, list_transform(ws, lambda w: 0.0::double) as before from v_sess where pos = 0
      union all
      select s.strategy_id, s.date, s.pos, s.ws, m.after, l.equity, m.marked, m.turnover, case when s.fill then m.after * (1 - list_sum(s.ws)) else l.cash end,
        case when s.fill then list_transform(range(1, len(s.ws) + 1), lambda i: s.ws[i] * m.after / s.p[i]) else l.units end,
        case when s.fill then s.ws else list_transform(range(1, len(s.ws) + 1), lambda i: l.units[i] * s.p[i] / m.marked) end, l.held
      from v_loop l join v_sess s on s.strategy_id = l.strategy_id and s.pos = l.pos + 1,
        lateral (select l.cash + list_sum(list_transform(range(1, len(s.ws) + 1), lambda i: l.units[i] * s.p[i])) as marked) v,
        lateral (select v.marked as marked, case when s.fill then list_sum(list_transform(range(1, len(s.ws) + 1), lambda i: abs(s.ws[i] - l.units[i] * s.p[i] / v.marked))) else 0.0 end as turnover) t,
        lateral (select t.marked as marked, t.turnover as turnover, t.marked * (1 - t.turnover * s.cost) as after) m""",
    "v_day": """select strategy_id, date, pos, marked / opening - 1 as gross_return, equity / opening - 1 as net_return, turnover, equity,
      equity / greatest(max(equity) over (partition by strategy_id order by pos), 1.0) - 1 as drawdown from v_loop""",
    "v_weight": """select strategy_id, date, pos, symbol, effective, ending from (select strategy_id, date, pos, unnest(symbols) as symbol, unnest(before) as effective, unnest(held) as ending from v_loop join (select strategy_id, symbols from v_strat) using (strategy_id))
      union all select strategy_id, date, pos, 'CASH', greatest(1 - list_sum(before), 0), greatest(1 - list_sum(held), 0) from v_loop""",
    "v_dep": """select date, 100.0 as amount from (select max(date) as date from (select distinct date from v_session) group by date_trunc('week', date + 2))""",
    "v_units": """select symbol, date, price, sum(coalesce(amount, 0) * 0.2 / price) over (partition by symbol order by date rows unbounded preceding) as units from v_session left join v_dep using (date)""",
    "v_nav": """select date, equity, flow, nav from (select *, exp(sum(ln(g)) over (order by date rows unbounded preceding)) as nav from
      (select *, case when lag(equity) over (order by date) > 0 then (equity - flow) / lag(equity) over (order by date) else 1 end as g from
        (select date, sum(units * price) as equity, coalesce(max(amount), 0) as flow from v_units left join v_dep using (date) group by 1)))""",
}


def sql(final: str) -> str:
    """A statement with all views that it names, directly or through others, defined before it."""
    needed: list[str] = []

    def want(text: str, own: str = "") -> None:
        for name, body in SQL.items():
            if name != own and name in re.findall(r"\w+", text) and name not in needed:
                want(body, name)
                needed.append(name)

    want(final)
    own = re.match(r"\s*with(?:\s+recursive)?\s", final)
    parts = [f"{n} as ({SQL[n]})" for n in needed]
    if own:  # the statement's own views follow
        return "with recursive " + ",\n".join(parts + [final[own.end() :]])
    return ("with recursive " + ",\n".join(parts) + "\n" if parts else "") + final
