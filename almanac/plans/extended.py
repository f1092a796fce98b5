"""More registered queries: portfolio reports, research reports, archives and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.operators import asof, factors, ledger, portfolio, research
from almanac.plans import views as v
from almanac.plans.base import CUTOFF, query
from almanac.sources.shared import shared_folder, written
from almanac.streaming.ledger import stream_ledger

DECISIONS = "select unnest([date '1995-12-31', date '1996-12-31', date '1997-12-31']) as decision_date"


def _decisions(s):
    return s.sql("select explode(array(date'1995-12-31', date'1996-12-31', date'1997-12-31')) as decision_date")


@query(f"select series_id, decision_date, vintage, observation_date, value from v_ledger join (select series_id, decision_date, max(vintage) as vintage from v_ledger join ({DECISIONS}) on vintage <= decision_date group by all) using (series_id, vintage)")
def vintage_asof_dates(s, d):
    return asof.vintage_asof_dates(v.ledger(s, d), _decisions(s)).select("series_id", "decision_date", "vintage", "observation_date", "value")


@query("select series_id, min(vintage) as earliest, max(vintage) as latest, count(distinct vintage) as vintages from v_ledger group by 1")
def archive_coverage(s, d):
    return asof.archive_coverage(v.ledger(s, d))


@query(f"select series_id, observation_date, vintage, greatest(available_date, vintage) as effective from v_ledger where month(observation_date) % 2 = 0 and greatest(available_date, vintage) <= date '{CUTOFF}'")
def eligible_rows(s, d):
    rows = v.ledger(s, d).withColumn("availability_basis", F.when(F.month("observation_date") % 2 == 0, "official_release").otherwise("unverified"))
    return asof.eligible_rows(rows, CUTOFF).select("series_id", "observation_date", "vintage", "effective")


def _panel(s, d):
    return asof.asof_month_end(v.observations(s, d))


def _factors(s, d):
    return factors.country_factors(_panel(s, d), v.config(s))


@query("select factor, count(score) as months, min(month_end) filter (score is not null) as first_month, max(month_end) filter (score is not null) as last_month from v_factor group by 1")
def factor_coverage(s, d):
    return factors.factor_coverage(_factors(s, d))


@query("select regime, count(*) as months from v_regime where regime is not null group by 1")
def regime_months(s, d):
    return factors.regime_months(factors.regimes(_factors(s, d)))


@query("""select factor, month_end, round(score, 6) as score, round(p, 6) as previous, round(score - p, 6) as change, 'available' as status, case when score > 0 then 'above_expanding_mean' else 'below_expanding_mean' end as state
  from (select *, lag(score) over (partition by factor order by month_end) as p from v_factor where score is not null) qualify row_number() over (partition by factor order by month_end desc) = 1""")
def factor_status(s, d):
    return factors.factor_status(_factors(s, d))


@query("""select source, max(sign <> 0 and component <> 'absent') as required, case when not bool_or(source in (select series_id from v_obs)) then 'not_in_catalog' when source = '2-HIGH' then 'provider_backed' when source = '3-MEDIUM' then 'missing' else 'present' end as status
  from (select source, sign, component from v_cfg union all select second, sign, component from v_cfg where transform = 'real_rate_proxy') group by 1""")
def source_coverage(s, d):
    series = v.observations(s, d).select("series_id").distinct()
    catalog = series.select(F.col("series_id").alias("key"), F.when(F.col("series_id") == "2-HIGH", "fred").otherwise("csv").alias("provider"))
    return factors.source_coverage(v.config(s), catalog, series.where("series_id <> '3-MEDIUM'"))


@query("select factor, component, month_end, round(case when n >= 36 then (x - m) / nullif(sd, 0) end, 6) as z from (select *, count(x) over w as n, avg(x) over w as m, stddev_samp(x) over w as sd from v_tr window w as (partition by factor, component order by month_end rows between unbounded preceding and current row))")
def inclusive_zscore(s, d):
    return factors.expanding_zscore(factors.transforms(_panel(s, d), v.config(s)), include_current=True).select("factor", "component", "month_end", "z")


def _pairs(s, d):
    signal = _panel(s, d).where("series_id = '1-URGENT'").select("month_end", F.col("value").alias("signal"))
    return research.pairs(signal, research.cross_section(research.forward_returns(v.monthly_prices(s, d))))


@query("""select horizon, month_end, round((rank() over (partition by horizon, signal is null order by signal) + (count(*) over (partition by horizon, signal) - 1) / 2) / count(signal) over (partition by horizon), 6) as pct_signal from v_pair where signal is not null""")
def signal_percentile(s, d):
    return research.percent_rank(_pairs(s, d), "signal", ["horizon"]).where("signal is not null").select("horizon", "month_end", "pct_signal")


DIAGNOSTICS = """both_ as (select * from v_pair where signal is not null and y is not null), one as (select horizon, case when count(*) >= 3 then corr(signal, y) end as ic, count(*) as n from both_ group by 1),
  ranks as (select *, rank() over (partition by horizon, signal is null order by signal) + (count(*) over (partition by horizon, signal) - 1) / 2 as a, rank() over (partition by horizon, y is null order by y) + (count(*) over (partition by horizon, y) - 1) / 2 as b from v_pair),
  rk as (select horizon, corr(a, b) filter (signal is not null and y is not null) as rank_ic from ranks group by 1),
  roll as (select horizon, case when count(*) over w = 12 then corr(signal, y) over w end as c from both_ window w as (partition by horizon order by month_end rows between 11 preceding and current row)),
  ir as (select horizon, case when count(c) >= 24 then avg(c) / nullif(stddev_samp(c), 0) * sqrt(12) end as ic_ir from roll group by 1),
  hit as (select horizon, avg(((signal > m) = (y > 0))::int) as hit_rate from (select *, median(signal) over (partition by horizon) as m from both_) group by 1),
  diag as (select horizon, ic, n, rank_ic, ic_ir, hit_rate, case when abs(ic) < 0.02 then 'negligible' when abs(ic) < 0.05 then 'weak' when abs(ic) < 0.1 then 'moderate' when ic is not null then 'strong' end as strength,
    case when ic > 0 then 'positive' when ic is not null then 'negative' end as direction from one left join rk using (horizon) left join ir using (horizon) left join hit using (horizon))"""


@query(f"with {DIAGNOSTICS} select horizon, round(ic, 6) as ic, n, round(rank_ic, 6) as rank_ic, round(ic_ir, 6) as ic_ir, round(hit_rate, 6) as hit_rate, strength, direction from diag")
def idea_diagnostics(s, d):
    """A signal from panel columns, put on the panel's months and tested against positive prices."""
    wide = asof.panel_wide(_panel(s, d), ["1-URGENT"]).toDF("month_end", "urgent")
    return research.idea_on_prices(lambda p: p.select("month_end", F.col("urgent").alias("signal")), wide, ["urgent"], v.monthly_prices(s, d))


@query(f"""with {DIAGNOSTICS}, top as (select * from diag where ic is not null order by abs(ic) desc, horizon limit 1)
  select top.horizon, round(ic, 6) as ic, round(ic_ir, 6) as ic_ir, n, strength, direction, array_to_string(list_filter([case when (select max(n) from diag) < 60 then 'few_observations' end, case when (select count(ic) from diag) = 0 then 'nothing_to_measure' end,
    case when (select count(*) from diag where n >= 60 and ic is not null) > 1 and (select max(abs(ic)) / greatest(min(abs(ic)), 1e-9) from diag where n >= 60 and ic is not null) > 3 then 'unstable_across_horizons' end], lambda x: x is not null), ',') as warnings from top""")
def signal_verdict(s, d):
    found = research.signal_verdict(research.diagnostics(_pairs(s, d)))
    return found.withColumn("warnings", F.array_join("warnings", ","))


def _book(s, d):
    return v.weekly_prices(s, d), v.strategies(s)


@query("select strategy_id, date, symbol, round(effective, 6) + 0.0 as effective, round(ending, 6) + 0.0 as ending from v_weight")
def account_weights(s, d):
    return portfolio.account_weights(*_book(s, d))


@query("select strategy_id, symbol, round(avg(effective), 6) + 0.0 as weight from v_weight where pos > 0 group by all")
def average_weights(s, d):
    return portfolio.average_weights(portfolio.account_weights(*_book(s, d)))


@query("select strategy_id, date, symbol, round(ending, 6) + 0.0 as weight from v_weight where (strategy_id, date) in (select strategy_id, max(date) from v_weight group by strategy_id, date_trunc('month', date))")
def month_end_weights(s, d):
    return portfolio.month_end_weights(portfolio.account_weights(*_book(s, d)))


@query("select strategy_id, round(max(abs(t - 1)), 6) + 0.0 as max_error, round(min(c), 6) + 0.0 as min_cash from (select strategy_id, date, sum(ending) as t, min(ending) filter (symbol = 'CASH') as c from v_weight group by all) group by 1")
def weight_checks(s, d):
    return portfolio.weight_checks(portfolio.account_weights(*_book(s, d)))


def _daily(s, d):
    return portfolio.backtest_daily(*_book(s, d), guard=False)


@query("""with months as (select strategy_id, date, equity, count(*) over (partition by strategy_id) as n, row_number() over (partition by strategy_id order by date) - 1 as k from v_day where (strategy_id, date) in (select strategy_id, max(date) from v_day group by strategy_id, date_trunc('month', date)))
  select strategy_id, date, round(ln(equity), 6) + 0.0 as log_value, 1 as place from months where k % (case when n > 36 then n // 36 else 1 end) = 0 or k = n - 1 union all select strategy_id, min(date), 0.0, 0 from v_day group by 1""")
def sampled_curve(s, d):
    return portfolio.sampled_curve(_daily(s, d), 36).withColumn("log_value", F.log("value")).drop("value")


@query("""select strategy_id, cast(year(date) as int) as year, round(product(1 + net_return) - 1, 6) + 0.0 as ret, any_value(f) as first_fill, any_value(w) as worst
  from v_day join (select strategy_id, min(date) filter (turnover > 0) as f, arg_min(date, (drawdown, date)) as w from v_day group by 1) using (strategy_id) where year(date) in (1996, 1998) group by all""")
def stress_years(s, d):
    return portfolio.stress_years(_daily(s, d), (1996, 1998))


HOLD = """alone as (select strategy_id, symbol, s.date, row_number() over (partition by strategy_id, symbol order by s.date) - 1 as pos, price, cost from v_sess s join (select strategy_id, unnest(symbols) as symbol from v_strat) using (strategy_id) join v_price_w w using (symbol, date)),
  ends as (select strategy_id, symbol, any_value(cost) as cost, arg_max(price, pos) / max(price) filter (pos = 1) as growth, max(pos) as n from alone group by all)"""


@query(f"""with {HOLD} select strategy_id as of, symbol || '_buy_and_hold' as benchmark, round(ln((1 - cost) * growth), 6) as log_ending, n as observations from ends
  union all select strategy_id, 'same_weights_buy_and_hold', round(ln((1 - list_sum(ws) * e.cost) * (1 - list_sum(ws) + (select sum(growth * w) from (select unnest(symbols) as symbol, unnest(ws) as w) join ends using (symbol) where ends.strategy_id = t.strategy_id)) ), 6), e.n
    from v_strat t join (select strategy_id, any_value(cost) as cost, max(n) as n from ends group by 1) e using (strategy_id)""")
def benchmarks(s, d):
    found = portfolio.benchmark_metrics(*_book(s, d), 52.0, guard=False).where("benchmark is not null")
    return found.select("of", "benchmark", F.log("ending").alias("log_ending"), "observations")


def _spoiled(s, d):
    day = F.dayofmonth("date")
    prices = v.daily_prices(s, d)
    price = F.when(day == 3, None).when(day == 5, -F.col("price")).when(day == 7, float("nan")).otherwise(F.col("price"))
    return prices.withColumn("price", price).unionByName(prices.where("dayofmonth(date) = 9"))


@query("""select 'missing_price' as rule, symbol, date from v_price_d where day(date) = 3 union all select 'not_positive', symbol, date from v_price_d where day(date) = 5 union all select 'not_finite', symbol, date from v_price_d where day(date) = 7
  union all select 'duplicate_date', symbol, date from v_price_d where day(date) = 9""")
def price_violations(s, d):
    return portfolio.price_violations(_spoiled(s, d))


@query("""with t as (select symbol, date, case when month(date) = 1 then -0.1 when month(date) = 2 then 0.9 else 0.2 end as weight from v_price_m_w), n as (select * from t)
  select 'negative' as rule, 'book' as strategy_id, date, symbol from t where weight < 0 union all select 'sum', 'book', date, null from t group by date having sum(weight) > 1 + 1e-8
  union all select 'no_prices', 'book', date, symbol from t where symbol = 'PROMO' union all select 'not_a_session', 'book', date, null from t where month(date) = 4 group by date""")
def weight_violations(s, d):
    months = v.monthly_prices(s, d).select(F.col("asset").alias("symbol"), F.col("month_end").alias("date"))
    target = months.withColumn("strategy_id", F.lit("book")).withColumn("weight", F.when(F.month("date") == 1, -0.1).when(F.month("date") == 2, 0.9).otherwise(0.2))
    return portfolio.weight_violations(target, months.where("month(date) <> 4 and symbol <> 'PROMO'"))


@query("""select strategy_id, date, array_to_string(list_filter(list_sort(any_value(symbols)), lambda x: not list_contains(list(symbol), x)), ',') as missing from v_price_d join (select *, unnest(symbols) as symbol from v_strat) using (symbol)
  join (select strategy_id, max(a) as a, min(b) as b from (select strategy_id, symbol, min(date) as a, max(date) as b from v_price_d join (select strategy_id, unnest(symbols) as symbol from v_strat) using (symbol) group by all) group by 1) using (strategy_id)
  where date between a and b group by strategy_id, date having count(*) < len(any_value(symbols))""")
def strategy_gaps(s, d):
    return portfolio.strategy_gaps(v.daily_prices(s, d), v.strategies(s)).withColumn("missing", F.array_join("missing", ","))


@query("""select 'name_length' as rule, n_nationkey as strategy_id from nation where n_nationkey % 5 = 0 union all select 'frequency', n_nationkey from nation where n_nationkey % 5 = 1
  union all select 'duplicate_symbol', n_nationkey from nation where n_nationkey % 5 = 2 union all select 'weights_sum', n_nationkey from nation where n_nationkey % 5 = 3 union all select 'rule_caps', n_nationkey from nation where n_nationkey % 5 = 3
  union all select 'tier_order', n_nationkey from nation where n_nationkey % 5 = 4 union all select 'dates', n_nationkey from nation where n_nationkey % 5 = 4 union all select 'symbol', n_nationkey from nation where n_nationkey = 9 union all select 'contribution_day', n_nationkey from nation where n_nationkey = 8""")
def strategy_violations(s, d):
    """A specification per nation, each with faults of its own."""
    m, pick = F.col("n_nationkey") % 5, F.col("n_nationkey")
    second = F.when(m == 2, " aaa").when(pick == 9, "b b").otherwise("BBB")
    tiers = F.array(F.struct(F.lit(0.2).alias("threshold"), F.lit(0.5).alias("fraction")), F.struct(F.when(m == 4, 0.1).otherwise(0.4).alias("threshold"), F.lit(1.0).alias("fraction")))
    rules = F.array(F.struct(F.lit(0.1).alias("drawdown"), F.lit(0.8).alias("cap")), F.struct(F.lit(0.2).alias("drawdown"), F.when(m == 3, 0.9).otherwise(0.5).alias("cap")))
    specs = v.table(s, d, "nation").select(
        pick.alias("strategy_id"),
        F.when(m == 0, "  ").otherwise(F.col("n_name")).alias("name"),
        F.when(m == 1, "weekly").otherwise("monthly").alias("frequency"),
        F.create_map(F.lit("AAA"), F.lit(0.5), second, F.when(m == 3, 0.6).otherwise(0.5)).alias("weights"),
        F.to_date(F.lit("2020-01-01")).alias("start_date"),
        F.when(m == 4, F.to_date(F.lit("2019-01-01"))).alias("end_date"),
        F.lit(100.0).alias("initial_capital"),
        F.lit(0.001).alias("cost"),
        F.lit(10.0).alias("contribution"),
        F.when(pick == 8, "SAT").otherwise("FRI").alias("contribution_day"),
        tiers.alias("tiers"),
        rules.alias("rules"),
    )
    return portfolio.strategy_violations(specs)


def _plans(s):
    rows = [("a", 100.0, 10.0, "FRI", 0.0, {"click": 0.5, "view": 0.5}), ("b", 1000.0, 50.0, "MON", 0.001, {"click": 1.0}), ("c", 500.0, 25.0, "WED", 0.002, {"purchase": 0.3, "view": 0.7})]
    return s.createDataFrame(rows, "account string, initial double, amount double, weekday string, cost double, weights map<string, double>")


PLANS = """plan as (select * from (values ('a', 100.0::double, 10.0::double, 5, 0.0::double, ['click', 'view'], [0.5::double, 0.5]), ('b', 1000.0, 50.0, 1, 0.001, ['click'], [1.0]), ('c', 500.0, 25.0, 3, 0.002, ['purchase', 'view'], [0.3, 0.7])) t(account, initial, amount, dow, cost, symbols, ws)),
  flow as (select account, date, cost, case when date = max(date) over (partition by account, date + cast((dow - isodow(date) + 7) % 7 as int)) then amount else 0 end as deposit, case when date = min(date) over (partition by account) then initial else 0 end as start
    from plan cross join (select distinct date from v_session)),
  held as (select account, date, symbol, price, sum((deposit + start) / (1 + cost) * w / price) over (partition by account, symbol order by date rows unbounded preceding) as units
    from flow join (select account, unnest(symbols) as symbol, unnest(ws) as w from plan) using (account) join v_session using (symbol, date)),
  acct as (select account, date, sum(units * price) as equity, any_value(deposit) as flow, any_value(start) as start from held join flow using (account, date) group by all),
  chain as (select *, exp(sum(ln(coalesce(g, equity / (flow + start)))) over (partition by account order by date rows unbounded preceding)) as nav from (select *, (equity - flow) / lag(equity) over (partition by account order by date) as g from acct))"""


@query(f"with {PLANS} select account, date, round(equity, 6) as equity, round(flow, 6) as flow, round(start, 6) as start, round(nav, 6) as nav, round(nav / greatest(max(nav) over (partition by account order by date), 1) - 1, 6) + 0.0 as drawdown from chain")
def deposit_accounts(s, d):
    return portfolio.deposit_accounts(v.session_prices(s, d), _plans(s))


@query(f"""with {PLANS}, cash as (select account, date, -flow - start as amount from acct where flow + start > 0 union all select account, max(date), arg_max(equity, date) from acct group by 1),
  dated as (select account, list(struct_pack(t := (date - s) / 365.25, a := amount)) as f from (select account, date, sum(amount) as amount, min(min(date)) over (partition by account) as s from cash group by account, date) group by 1),
  rounds as (select account, f, 0 as k, -0.9999::double as lo, 1e5::double as hi from dated union all select account, f, k + 1, case when worth > 0 then mid else lo end, case when worth > 0 then hi else mid end
    from (select *, (lo + hi) / 2 as mid, list_sum(list_transform(f, lambda x: x.a * power(1 + (lo + hi) / 2, -x.t))) as worth from rounds where k < 120))
  select account, count(*) filter (flow > 0) as contributions, round(sum(flow + start), 6) as paid_in, round(arg_max(equity, date), 6) as equity, round(arg_max(nav, date), 6) as nav, round(min(dd), 6) + 0.0 as max_drawdown, round(any_value(x), 6) as xirr
  from (select *, nav / greatest(max(nav) over (partition by account order by date), 1) - 1 as dd from chain) join (select account, (lo + hi) / 2 as x from rounds where k = 120) using (account) group by 1""")
def deposit_summary(s, d):
    return portfolio.deposit_summary(portfolio.deposit_accounts(v.session_prices(s, d), _plans(s)))


@query(f"""with {PLANS}, step as (select account, date, nav, row_number() over (partition by account order by date) as k from chain),
  walk as (select account, 0::bigint as k, null::date as date, 1.0::double as high, 1.0::double as force, null::varchar as event, null::double as cap, 0.0::double as drawdown from plan
    union all select w.account, s.k, s.date, greatest(w.high, s.nav), case when s.nav > w.high then 1.0 when c < w.force then c else w.force end, case when s.nav > w.high and w.force < 1 then 'rearmed' when s.nav <= w.high and c < w.force then 'triggered' end,
        case when s.nav > w.high then 1.0 else c end, s.nav / greatest(w.high, s.nav) - 1
      from walk w join step s on s.account = w.account and s.k = w.k + 1, lateral (select case when s.nav / w.high - 1 <= -0.05 then 0.3::double when s.nav / w.high - 1 <= -0.01 then 0.7 else 1.0 end as c) t)
  select account, date, event, cap, round(drawdown, 6) + 0.0 as drawdown from walk where event is not null""")
def drawdown_triggers(s, d):
    """Caps by drawdown against a walk over the days."""
    return portfolio.drawdown_triggers(portfolio.deposit_accounts(v.session_prices(s, d), _plans(s)), ((0.01, 0.7), (0.05, 0.3)))


RUNS = "select l_returnflag = 'R' as returned, l_linestatus = 'F' as closed, quarter(l_shipdate) > 2 as late, sum(l_extendedprice) / sum(l_quantity) as price, avg(l_discount) as discount from lineitem where l_returnflag <> 'N' or l_linestatus = 'O' group by all"


def _runs(s, d):
    by = v.table(s, d, "lineitem").where("l_returnflag <> 'N' or l_linestatus = 'O'").groupBy((F.col("l_returnflag") == "R").alias("returned"), (F.col("l_linestatus") == "F").alias("closed"), (F.quarter("l_shipdate") > 2).alias("late"))
    return by.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"), F.avg("l_discount").alias("discount"))


@query(f"""with r as ({RUNS}), m as (select returned, closed, late, 'price' as metric, price as x from r union all select returned, closed, late, 'discount', discount from r)
  select switch, metric, round(avg(d), 6) + 0.0 as effect, count(*) as pairs from (select 'returned' as switch, a.metric, a.x - b.x as d from m a join m b on a.metric = b.metric and a.returned and not b.returned and a.closed = b.closed and a.late = b.late
    union all select 'closed', a.metric, a.x - b.x from m a join m b on a.metric = b.metric and a.closed and not b.closed and a.returned = b.returned and a.late = b.late
    union all select 'late', a.metric, a.x - b.x from m a join m b on a.metric = b.metric and a.late and not b.late and a.closed = b.closed and a.returned = b.returned) group by all""")
def factorial_effects(s, d):
    return portfolio.effects(_runs(s, d), ["returned", "closed", "late"], ["price", "discount"])


@query(f"""with r as (select 'returned' || returned::int || '-closed' || closed::int || '-late' || late::int as run, price from ({RUNS})) select a.run, b.run as other, 'price' as metric, round(a.price - b.price, 6) + 0.0 as delta from r a join r b on a.run like '%late1' and b.run = replace(a.run, 'late1', 'late0')""")
def run_pairs(s, d):
    runs = _runs(s, d).withColumn("run", portfolio.experiment_id(["returned", "closed", "late"]))
    pairs = runs.where("run like '%late1'").select("run", F.replace("run", F.lit("late1"), F.lit("late0")).alias("other"))
    return portfolio.compare_pairs(runs, pairs, ["price"])


@query("""with m as (select strategy_id, min(drawdown) as max_drawdown, sum(turnover) as turnover from v_day group by 1) select strategy_id, metric, round(value, 6) as value, round(expected, 6) as expected, round(value - expected, 6) + 0.0 as delta from (select strategy_id, unnest(['max_drawdown', 'turnover']) as metric, unnest([max_drawdown, turnover]) as value, unnest([-0.5::double, 10.0]) as expected from m)""")
def against_reference(s, d):
    long = portfolio.backtest_metrics(_daily(s, d)).unpivot("strategy_id", ["max_drawdown", "turnover"], "metric", "value")
    stated = v.strategies(s).select("strategy_id", F.explode(F.create_map(F.lit("max_drawdown"), F.lit(-0.5), F.lit("turnover"), F.lit(10.0))).alias("metric", "expected"))
    return portfolio.against_reference(long, stated)


@query("""with kinds as (select user_id as account, event_type as event from events) select account, count(*) filter (event = 'click') as click, count(*) filter (event = 'view') as view from kinds group by 1""")
def event_counts(s, d):
    return portfolio.event_counts(v.table(s, d, "events").select(F.col("user_id").alias("account"), F.col("event_type").alias("event")), ["click", "view"])


@query("select strategy_id, count(*) as sessions, min(date) as first, max(date) as last from v_sess group by 1")
def strategy_sessions(s, d):
    return portfolio.sessions(*_book(s, d)).groupBy("strategy_id").agg(F.count("*").alias("sessions"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("""select strategy_id, sha256(string_agg(strftime(date, '%Y-%m-%d') || ':' || h, chr(10) order by date)) as sha256 from (select strategy_id, date, sha256(string_agg(symbol || '=' || n, ';' order by symbol)) as h from
  (select p_type as symbol, cast(l_shipdate as date) as date, cast(count(*) as varchar) || '.0' as n from lineitem join part on l_partkey = p_partkey group by all)
  join (select strategy_id, unnest(symbols) as symbol from v_strat) using (symbol) join v_span using (strategy_id) where date between a and b group by all) group by 1""")
def panel_hash(s, d):
    """A hash over each strategy's aligned panel, of a whole-numbered price so that both engines write it alike."""
    lines = v.table(s, d, "lineitem").join(v.table(s, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    counts = lines.groupBy(F.col("p_type").alias("symbol"), F.col("l_shipdate").cast("date").alias("date")).agg(F.count("*").cast("double").alias("price"))
    return portfolio.panel_hash(counts, v.strategies(s))


AS_OF = "1998-06-30"
VERSIONS = f"ver as (select * from v_watch where available_date <= date '{AS_OF}' and vintage <= date '{AS_OF}' qualify row_number() over (partition by series_id, observation_period order by vintage desc, landed desc) = 1)"


@query("""select 'official_unproven' as rule, series_id, observation_period from v_watch where availability_basis = 'official_release' and m = 3 union all select 'unknown_with_date', series_id, observation_period from v_watch where availability_basis = 'unknown' and m = 4
  union all select 'value', series_id, observation_period from v_watch where m = 5 union all select 'source_url', series_id, observation_period from v_watch where m = 6 union all select 'unit_missing', series_id, observation_period from v_watch where m = 7 union all select 'date_missing', series_id, observation_period from v_watch where m = 9""")
def record_violations(s, d):
    m, rows = F.month("observation_date"), v.watch(s, d)
    rows = rows.withColumn("availability_evidence_url", F.when(m == 3, None).otherwise(F.col("availability_evidence_url"))).withColumn("value", F.when(m != 5, F.col("value")))
    rows = rows.withColumn("source_value_url", F.when(m == 6, "ftp://x").otherwise(F.col("source_value_url"))).withColumn("unit", F.when(m == 7, " ").otherwise(F.col("unit")))
    rows = rows.withColumn("available_date", F.when(m == 4, F.coalesce("available_date", "observation_date")).when(m == 9, None).otherwise(F.col("available_date"))).withColumn("availability_basis", F.when(m == 9, "fixed_lag").otherwise(F.col("availability_basis")))
    return ledger.record_violations(rows)


@query(f"""with {VERSIONS}, months as (select distinct series_id, unnest(generate_series(strptime(substr(observation_period, 1, 7) || '-01', '%Y-%m-%d'), strptime(right(observation_period, 7) || '-01', '%Y-%m-%d'), interval 1 month)) as month from ver where month(observation_date) % 5 <> 0),
  gone as (select series_id, month from (select series_id, unnest(generate_series(min(month), max(month), interval 1 month)) as month from months group by 1) except select series_id, month from months)
  select series_id, array_to_string(list(strftime(month, '%Y-%m') order by month)[1:10], ',') as months, count(*) > 10 as truncated, cast(count(*) as int) as n from gone group by 1""")
def missing_months(s, d):
    rows = ledger.current_versions(v.watch(s, d), AS_OF).where("month(observation_date) % 5 <> 0")
    return ledger.missing_months(rows, 10).withColumn("months", F.array_join("months", ","))


@query("""with have as (select distinct series_id, observation_date as month_end, observation_period from v_watch where m % 5 <> 0),
  gone as (select series_id, cast(last_day(m) as date) as month_end from (select series_id, unnest(generate_series(date_trunc('month', min(month_end)), max(month_end), interval 1 month)) as m from have group by 1) except select series_id, month_end from have)
  select series_id, month_end, case when exists (select 1 from have h where h.series_id = g.series_id and h.month_end = last_day(g.month_end + interval 1 day) and h.observation_period like '%/%') then 'structural' else 'unresolved' end as gap from gone g""")
def classified_gaps(s, d):
    return ledger.classified_gaps(v.watch(s, d).where("month(observation_date) % 5 <> 0"))


@query(f"""with {VERSIONS}, old as (select *, lag(value) over w as p, row_number() over (partition by series_id order by available_date desc, observation_period desc) as k from ver window w as (partition by series_id order by available_date, observation_period)), fin as (select * from old where k = 1)
  select 'stale_series' as finding, series_id, observation_period, cast(date '{AS_OF}' - available_date as double) as amount from fin where date '{AS_OF}' - available_date > 75
  union all select 'unusual_publication_lag', series_id, observation_period, cast(available_date - observation_date as double) from fin where available_date - observation_date > 45
  union all select 'large_change', series_id, observation_period, round(value - p, 6) from fin where abs(value - p) >= case series_id when 'A' then 1e12 else 10 end
  union all select 'missing_periods', series_id, string_agg(strftime(month, '%Y-%m'), ',' order by month), count(*) from (select series_id, month from (select series_id, unnest(generate_series(min(a), max(b), interval 1 month)) as month from per group by 1) except select series_id, unnest(generate_series(a, b, interval 1 month)) from per) group by 2
  union all select 'methodology_change_review', series_id, observation_period, null from v_watch where m = 7
  union all select 'large_revision', series_id, strftime(observation_date, '%Y-%m'), round(value - p, 6) from ev where p is not null and abs(value - p) >= case series_id when 'A' then 1e12 else 10 end
  union all select case when p is null then 'new_release' else 'historical_revision' end, null, null, count(*) from ev group by all
  union all select 'unknown_release_dates', null, null, count(*) filter (availability_basis = 'unknown') from v_watch""".replace("fin as (select * from old where k = 1)", "fin as (select * from old where k = 1), per as (select series_id, strptime(substr(observation_period, 1, 7) || '-01', '%Y-%m-%d') as a, strptime(right(observation_period, 7) || '-01', '%Y-%m-%d') as b from ver), ev as (select series_id, observation_date, value, lag(value) over (partition by series_id, observation_date order by vintage) as p from v_ledger where month(observation_date) = 3)"))
def quality_audit(s, d):
    """Findings at a date, with the revisions of March as the events."""
    march = v.ledger(s, d).where("month(observation_date) = 3").withColumn("old_value", F.lag("value").over(Window.partitionBy("series_id", "observation_date").orderBy("vintage")))
    events = march.select(F.when(F.col("old_value").isNull(), "new_release").otherwise("historical_revision").alias("event"), "series_id", F.date_format("observation_date", "yyyy-MM").alias("observation_period"), "old_value", F.col("value").alias("new_value"))
    return ledger.quality_audit(v.watch(s, d), events, AS_OF, {"A": 1e12})


STATUS = f"""sset as (select unnest(['A', 'N', 'R', 'X']) as series_id), elig as (select *, greatest(available_date, vintage) as eff from v_watch where availability_basis = 'official_release' and greatest(available_date, vintage) <= date '{AS_OF}'),
  cur as (select * from elig qualify row_number() over (partition by series_id, observation_period order by vintage desc, landed desc) = 1)"""


@query(f"""with {STATUS}, seq as (select *, lag(value) over (partition by series_id order by observation_date, eff) as p, row_number() over (partition by series_id order by observation_date desc, eff desc) as k from cur where series_id <> 'A'),
  und as (select * from v_watch where availability_basis = 'unknown' and landed <= date '{AS_OF}' qualify row_number() over (partition by series_id order by landed desc, observation_date desc) = 1), un2 as (select 'A' as series_id, observation_period, value from und)
  select s.series_id, case when q.series_id is not null then 'available' when u.series_id is not null then 'unknown_release_date' else 'not_collected' end as status, coalesce(q.observation_period, u.observation_period) as observation_period, coalesce(q.value, u.value) as value, q.p as previous, round(q.value - q.p, 6) as change
  from sset s left join (select * from seq where k = 1) q using (series_id) left join un2 u using (series_id)""")
def metric_status(s, d):
    """Series A has only the undated rows of R, X has none."""
    rows = v.watch(s, d).where("series_id <> 'A'")
    rows = rows.where("series_id <> 'R' or availability_basis <> 'unknown'").unionByName(rows.where("series_id = 'R' and availability_basis = 'unknown'").withColumn("series_id", F.lit("A")))
    return ledger.metric_status(rows, s.createDataFrame([("A",), ("N",), ("R",), ("X",)], "series_id string"), AS_OF)


@query(f"""with {STATUS} select 4::bigint as configured, (select count(distinct series_id) from cur) as with_official, (select string_agg(series_id, ',' order by series_id) from sset where series_id not in (select series_id from cur)) as without_official,
  (select count(*) from cur) as official_rows, round((select avg((evidence_url like 'http%')::int) from cur), 6) as evidence_rate, (select count(*) from v_watch where availability_basis = 'unknown') as unknown_rows, (select max(landed) from v_watch) as updated""")
def report_coverage(s, d):
    found = ledger.report_coverage(v.watch(s, d), s.createDataFrame([("A",), ("N",), ("R",), ("X",)], "series_id string"), AS_OF)
    return found.withColumn("without_official", F.array_join("without_official", ",")).withColumn("updated", F.col("updated_at").cast("date")).drop("updated_at")


@query("select series_id, count(*) as n_rows, min(observation_date) as first_date, max(observation_date) as last_date, count(*) filter (availability_basis = 'official_release') as official, count(*) filter (availability_basis = 'unknown') as unknown, count(nullif(evidence_url, '')) as with_evidence, median(available_date - observation_date) as median_lag from v_watch group by 1")
def snapshot_profile(s, d):
    return ledger.snapshot_profile(v.watch(s, d))


MACRO = [("growth", "accepted", "A", "yoy", 12, 1.0, 1, None), ("inflation", "noted", "N", "diff", 1, 0.5, 1, 1), ("inflation", "returned", "R", "level", None, 0.5, -1, 1)]


@query(f"""with {STATUS}, cal as (select cast(last_day(m) as date) as month_end from (select unnest(generate_series(date_trunc('month', min(vintage)), date '{AS_OF}', interval 1 month)) as m from elig)),
  pan as (select series_id, month_end, arg_max(value, (observation_date, vintage)) as value from elig join cal on vintage <= month_end group by all), num as (select *, row_number() over (partition by series_id order by month_end) as rn from pan),
  tr as (select 'growth' as factor, 'accepted' as component, a.month_end, 1.0::double as weight, a.value / nullif(b.value, 0) - 1 as x from num a left join num b on b.series_id = a.series_id and b.rn = a.rn - 12 where a.series_id = 'A'
    union all select 'inflation', 'noted', a.month_end, 0.5, a.value - b.value from num a left join num b on b.series_id = a.series_id and b.rn = a.rn - 1 where a.series_id = 'N' union all select 'inflation', 'returned', month_end, 0.5, -value from num where series_id = 'R'),
  z as (select *, case when count(x) over w >= 12 then (x - avg(x) over w) / nullif(stddev_samp(x) over w, 0) end as z from tr window w as (partition by component order by month_end rows between unbounded preceding and 1 preceding)),
  fac as (select factor, month_end, case when count(z) >= 1 then sum(z * weight) / sum(case when z is not null then weight end) end as score from z group by all),
  reg as (select month_end, case when g > 0 and i <= 0 then 'goldilocks' when g > 0 then 'reflation' when i > 0 then 'stagflation' else 'recession' end as regime from (select month_end, max(score) filter (factor = 'growth') as g, max(score) filter (factor = 'inflation') as i from fac group by 1) where g is not null and i is not null)
  select 'factors' as section, factor as name, 'available' as status, round(score, 6) as value, round(p, 6) as previous, round(score - p, 6) as change, case when score > 0 then 'above_expanding_mean' else 'below_expanding_mean' end as note
    from (select *, lag(score) over (partition by factor order by month_end) as p from fac where score is not null) qualify row_number() over (partition by factor order by month_end desc) = 1
  union all select 'contributions', factor || '/' || component, null, round(z * weight / sum(weight) over (partition by factor), 6), null, null, null from z where z is not null and month_end = (select max(month_end) from z)
  union all select 'regime', regime, 'available', null, null, null, p from (select *, lag(regime) over (order by month_end) as p from reg) qualify row_number() over (order by month_end desc) = 1
  union all select 'metrics', series_id, case when v is null then 'not_collected' else 'available' end, v, p, round(v - p, 6), per from sset left join (select series_id, value as v, lag(value) over (partition by series_id order by observation_date, eff) as p, observation_period as per, row_number() over (partition by series_id order by observation_date desc, eff desc) as k from cur qualify k = 1) using (series_id)
  union all select 'coverage', unnest(['configured', 'with_official', 'official_rows', 'evidence_rate', 'unknown_rows']), null, unnest([4, (select count(distinct series_id) from cur), (select count(*) from cur), (select round(avg((evidence_url like 'http%')::int), 6) from cur), (select count(*) from v_watch where availability_basis = 'unknown')]), null, null, null""")
def macro_report(s, d):
    """All sections but quality, which ``quality_audit`` covers."""
    config = s.createDataFrame(MACRO, "factor string, component string, source string, transform string, periods int, weight double, sign int, min_components int")
    events = s.createDataFrame([], "event string, series_id string, observation_period string, old_value double, new_value double")
    series = s.createDataFrame([("A",), ("N",), ("R",), ("X",)], "series_id string")
    return ledger.macro_report(v.watch(s, d), events, config, series, AS_OF, 12).where("section <> 'quality'")


@query(f"""with rows_ as (select series_id, observation_period, value, evidence_url, available_date, vintage, m from v_watch where landed <= date '{CUTOFF}' qualify row_number() over (partition by series_id, observation_period order by vintage desc nulls last, landed desc) = 1)
  select series_id, observation_period, value, 'new' as kind from rows_ union all select series_id, observation_period, unnest([value + 3, value + 1]), 'revised' from rows_ where m = 6""")
def ledger_stream(s, d):
    """Rows landed in three batches, one of them twice and with repeats inside a batch, streamed into a ledger; what it then holds.

    June's revision comes together with an older and a newer reading of a lower value, and is in time between them.
    """
    root = shared_folder(s, "ledger")
    rows = asof.latest(v.watch(s, d).where(F.col("retrieved_at").cast("date") <= CUTOFF), ["series_id", "observation_period"], "vintage", "retrieved_at")
    rows = written(rows, "landed")  # for all three batches
    june = rows.where("month(observation_date) = 6")
    # Landed out of order: 09:00 reads one more, 01:00 three more, and 00:00 what is stored.
    revised = june.withColumn("value", F.col("value") + 1).withColumn("retrieved_at", F.expr("retrieved_at + interval 9 hours"))
    revised = revised.unionByName(june.withColumn("value", F.col("value") + 3).withColumn("retrieved_at", F.expr("retrieved_at + interval 1 hour"))).unionByName(june)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    for batch in (rows.unionByName(rows), rows, revised):
        batch.write.mode("append").parquet(f"{root}/in")
        stream_ledger(s, f"{root}/in", schema, f"{root}/ledger", f"{root}/bad", f"{root}/checkpoint", "2002-01-01").awaitTermination(600)
    held = s.read.schema(rows.schema).parquet(f"{root}/ledger")
    return held.select("series_id", "observation_period", "value", F.when(F.array_contains("quality_flags", "historical_revision"), "revised").otherwise("new").alias("kind"))
