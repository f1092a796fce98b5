"""Registered queries and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import asof, contracts, factors, harvest, ledger, portfolio, research, valuation
from almanac.plans import views as v
from almanac.plans.base import CUTOFF, ORACLES, QUERIES, query  # noqa: F401

@query("select series_id, observation_date, value, case when nullif(b, '') is not null then b when available_date is null then 'unknown' else 'unverified' end as availability_basis from (select *, case when series_id < '3' then '' else availability_basis end as b from v_obs)")
def normalize_obs(s, d):
    obs = v.observations(s, d).withColumn("availability_basis", F.when(F.col("series_id") < "3", "").otherwise(F.col("availability_basis")))
    return contracts.normalize_observations(obs).select("series_id", "observation_date", "value", "availability_basis")


@query("select series_id, observation_date, observation_date + lag_days as available_date, 'fixed_lag' as availability_basis from v_obs")
def attach_lag(s, d):
    return contracts.attach_lag(v.observations(s, d)).select("series_id", "observation_date", "available_date", "availability_basis")


@query("select series_id, observation_date, value from v_obs where availability_basis in ('official_release', 'official_schedule')")
def policy_filter(s, d):
    return contracts.apply_policy(v.observations(s, d), "include_schedule").select("series_id", "observation_date", "value")


@query("select series_id, observation_date, case when series_id < '5' then available_date else observation_date + lag_days end as available_date, case when series_id < '5' then availability_basis else 'fixed_lag' end as availability_basis from v_obs")
def resolve_dates(s, d):
    return contracts.resolve_dates(v.observations(s, d)).select("series_id", "observation_date", "available_date", "availability_basis")


# Observations that break every rule of the contract somewhere, by series and month.
BROKEN = """broken as (select series_id, case when m = 11 then null else observation_date end as observation_date, observation_date as od, case when m = 1 then null else value end as value,
    case when m = 2 then 'odd' when m = 3 then 'fixed_lag' when m = 4 then 'unknown' when series_id < '3' and m = 5 then 'official_release' else availability_basis end as basis,
    case when m = 3 then null when m = 4 then coalesce(available_date, observation_date + 3) when m = 6 then observation_date - 45 when m = 7 then observation_date - 20 else available_date end as available_date,
    case when m = 7 then strftime(observation_date, '%Y-%m') when m = 6 then 'no period' end as period,
    case when m = 8 then '' when m = 9 then 'ftp://example.org' else 'https://example.org/v' end as value_url,
    case when m = 5 then null when m = 10 then 'example' else 'http://example.org/e' end as evidence_url
  from (select *, month(observation_date) as m from v_obs))"""


def _broken(s, d):
    m, obs = F.month("observation_date"), v.observations(s, d)
    base, end = F.col("availability_basis"), F.col("observation_date")
    basis = F.when(m == 2, "odd").when(m == 3, "fixed_lag").when(m == 4, "unknown").when((F.col("series_id") < "3") & (m == 5), "official_release").otherwise(base)
    date = F.when(m == 3, None).when(m == 4, F.coalesce("available_date", F.date_add(end, 3))).when(m == 6, F.date_sub(end, 45)).when(m == 7, F.date_sub(end, 20)).otherwise(F.col("available_date"))
    return obs.select(
        "series_id",
        F.when(m != 11, end.cast("string")).otherwise(F.lit("not a date")).alias("observation_date"),
        F.when(m != 1, F.col("value")).alias("value"),
        basis.alias("availability_basis"),
        date.alias("available_date"),
        F.when(m == 7, F.date_format(end, "yyyy-MM")).when(m == 6, "no period").alias("observation_period"),
        F.when(m == 8, "").when(m == 9, "ftp://example.org").otherwise("https://example.org/v").alias("source_value_url"),
        F.when(m == 5, None).when(m == 10, "example").otherwise("http://example.org/e").alias("availability_evidence_url"),
    )


VIOLATIONS = f"""with {BROKEN}, marked as (select *, basis in ('official_release', 'official_schedule') as evidenced from broken),
  ruled as (select 'bad_date' as rule, series_id, observation_date from marked where observation_date is null
  union all select 'missing_value', series_id, observation_date from marked where value is null
  union all select 'bad_basis', series_id, observation_date from marked where basis = 'odd'
  union all select 'basis_without_date', series_id, observation_date from marked where basis <> 'unknown' and available_date is null
  union all select 'unknown_with_date', series_id, observation_date from marked where basis = 'unknown' and available_date is not null
  union all select 'look_ahead', series_id, observation_date from marked where available_date < case when period is not null and period <> 'no period' then date_trunc('month', od) else observation_date end
  union all select 'source_url_missing', series_id, observation_date from marked where value_url = ''
  union all select 'source_url_not_http', series_id, observation_date from marked where value_url like 'ftp%'
  union all select 'evidence_missing', series_id, observation_date from marked where evidenced and evidence_url is null
  union all select 'evidence_not_http', series_id, observation_date from marked where evidenced and evidence_url = 'example'
  union all select 'no_available_date', series_id, null from marked group by series_id having count(available_date) = 0)"""


@query(f"{VIOLATIONS} select rule, series_id, observation_date from ruled union all select 'duplicate_date', series_id, observation_date from v_obs where month(observation_date) = 12")
def contract_violations(s, d):
    rows = _broken(s, d)
    return contracts.violations(rows.unionByName(rows.where("observation_date like '%-12-31'")), require_available_date=True).where("rule <> 'never'")


@query(f"""{VIOLATIONS} select series_id, count(*) as n_rows, count(available_date) as n_dated, count(*) filter (available_date is not null and basis in ('fixed_lag', 'unverified', 'unknown')) as n_unevidenced,
  (select count(*) from ruled r where r.series_id = m.series_id) as n_errors, (select count(*) from ruled r where r.series_id = m.series_id) = 0 as ok from marked m group by series_id""")
def contract_report(s, d):
    return contracts.contract_report(_broken(s, d), require_available_date=True)


@query("""select o.series_id, count(*) as n_rows, min(observation_date) as first_date, max(observation_date) as last_date, count(*) filter (availability_basis = 'official_release') as n_official_release,
  count(*) filter (availability_basis = 'official_schedule') as n_official_schedule, count(*) filter (availability_basis = 'fixed_lag') as n_fixed_lag, count(*) filter (availability_basis = 'unverified') as n_unverified,
  count(*) filter (availability_basis = 'unknown') as n_unknown, count(*) filter (availability_basis = 'fixed_lag' and month(observation_date) = 3) as n_errors, count(*) filter (availability_basis = 'fixed_lag' and month(observation_date) = 3) = 0 as ok from v_obs o group by 1""")
def snapshot_validation(s, d):
    """The release dates of March are a day off the lag that the sidecar states."""
    obs = v.observations(s, d).withColumn("availability_evidence_url", F.lit("https://example.org/e"))
    moved = obs.withColumn("available_date", F.when(F.month("observation_date") == 3, F.date_add("available_date", 1)).otherwise(F.col("available_date")))
    return contracts.validate_snapshots(moved, obs.select("series_id", F.col("lag_days").alias("availability_lag_days")).distinct())


@query("select series_id, count(*) as n from v_obs where series_id < '3' group by 1")
def unproven_claims(s, d):
    return contracts.unproven_claims(v.observations(s, d).withColumn("available_date", F.lit(None).cast("date")))


@query("select s.series_id, b.availability_basis, count(o.value) as n from (select distinct series_id from v_obs) s cross join (select unnest(['official_release', 'official_schedule', 'fixed_lag', 'unverified', 'unknown']) as availability_basis) b left join v_obs o on o.series_id = s.series_id and o.availability_basis = b.availability_basis group by all")
def basis_counts(s, d):
    return contracts.basis_counts(v.observations(s, d))


@query("""select series_id, observation_date, array_to_string(list_filter([case when series_id < '2' and m <> 1 then 'release_date_has_official_evidence' else 'release_date_unknown' end, case when m % 2 = 0 then 'multi_month_period' end, case when m = 2 then 'joint_period_release' end,
  case when series_id = '3-MEDIUM' then 'cumulative_ytd_yoy_as_reported' end, case when m = 3 then 'methodology_change_review' end, case when m = 4 then 'seeded_from_frozen_pr13_snapshot' end], lambda x: x is not null), ',') as flags from (select *, month(observation_date) as m from v_obs)""")
def quality_flags(s, d):
    m, year = F.month("observation_date"), F.date_format("observation_date", "yyyy")
    rows = v.observations(s, d).withColumn("availability_evidence_url", F.when(m != 1, "https://example.org/e"))
    rows = rows.withColumn("observation_period", F.when(m % 2 == 0, F.concat(year, F.lit("-01/"), F.date_format("observation_date", "yyyy-MM"))).otherwise(F.date_format("observation_date", "yyyy-MM")))
    rows = rows.withColumn("source_title", F.when(m == 3, "数据修订说明").otherwise("数据")).withColumn("seeded", m == 4).withColumn("own", F.col("series_id"))
    renamed = rows.withColumn("series_id", F.when(F.col("series_id") == "3-MEDIUM", "cn_retail_sales_ytd").otherwise(F.col("series_id")))
    return contracts.quality_flags(renamed).select(F.col("own").alias("series_id"), "observation_date", F.array_join("quality_flags", ",").alias("flags"))


@query("select * from v_panel")
def asof_month_end(s, d):
    return asof.asof_month_end(v.observations(s, d))


@query("""select month_end, max(value) filter (series_id = '1-URGENT') as urgent, max(value) filter (series_id = '2-HIGH') as high from v_panel group by 1""")
def panel_wide(s, d):
    return asof.panel_wide(asof.asof_month_end(v.observations(s, d)), ["1-URGENT", "2-HIGH"]).toDF("month_end", "urgent", "high")


@query(f"select series_id, observation_date, arg_max(value, vintage) as value, max(vintage) as vintage from v_ledger where vintage <= date '{CUTOFF}' group by all")
def latest_version(s, d):
    return asof.visible_versions(v.ledger(s, d), CUTOFF).select("series_id", "observation_date", "value", "vintage")


@query("select l.series_id, c.month_end, max(observation_date) as observation_date, arg_max(value, (observation_date, vintage)) as value from v_ledger l join v_cal_l c on vintage <= month_end group by all")
def vintage_panel(s, d):
    return asof.vintage_panel(v.ledger(s, d))


@query(f"select series_id, vintage, observation_date, value from v_ledger join (select series_id, max(vintage) as vintage from v_ledger where vintage <= date '{CUTOFF}' group by 1) using (series_id, vintage)")
def vintage_asof(s, d):
    return asof.vintage_asof(v.ledger(s, d), CUTOFF).select("series_id", "vintage", "observation_date", "value")


@query("select series_id, observation_date, arg_min(value, vintage) as first_value, arg_max(value, vintage) as last_value, cast(sum(m) as bigint) as revisions from (select *, coalesce((abs(value - lag(value) over (partition by series_id, observation_date order by vintage)) > 1e-12)::int, 0) as m from v_ledger) group by all")
def vintage_revisions(s, d):
    return asof.vintage_revisions(v.ledger(s, d))


@query(f"select company_id, metric, max(period_end) as period_end, arg_max(value, (period_end, available_date)) as value from v_fund where available_date <= date '{CUTOFF}' group by all")
def fundamentals_asof(s, d):
    return asof.fundamentals_asof(v.fundamentals(s, d), CUTOFF).select("company_id", "metric", "period_end", "value")


@query("select company_id, metric, decision_date, max(period_end) as period_end, arg_max(value, (period_end, available_date)) as value from v_fund join (select unnest([date '1995-12-31', date '1996-12-31', date '1997-12-31']) as decision_date) on available_date <= decision_date group by all")
def fundamentals_asof_dates(s, d):
    dates = s.sql("select explode(array(date'1995-12-31', date'1996-12-31', date'1997-12-31')) as decision_date")
    return asof.fundamentals_asof_dates(v.fundamentals(s, d), dates)


def _transformed(s, d):
    return factors.transforms(asof.asof_month_end(v.observations(s, d)), v.config(s))


def _factors(s, d):
    return factors.composite(factors.expanding_zscore(_transformed(s, d)))


@query("select factor, component, series_id, month_end, round(x, 6) + 0.0 as x from v_tr")
def transforms(s, d):
    return _transformed(s, d).drop("weight", "min_components")


@query("select factor, component, month_end, round(z, 6) as z from v_z")
def expanding_zscore(s, d):
    return factors.expanding_zscore(_transformed(s, d)).select("factor", "component", "month_end", "z")


@query("select factor, month_end, round(score, 6) as score from v_factor")
def composite_factor(s, d):
    return _factors(s, d)


@query("select month_end, regime from v_regime")
def regime(s, d):
    return factors.regimes(_factors(s, d)).select("month_end", "regime")


@query("select month_end, round(growth, 6) as growth, round(inflation, 6) as inflation, regime from v_regime")
def country_baseline(s, d):
    return factors.country_baseline(v.observations(s, d), v.config(s))


@query("select factor, component, month_end, round(z * weight / sum(weight) over (partition by factor), 6) as contribution from v_z where z is not null and month_end = (select max(month_end) from v_z) and factor in (select factor from v_z where month_end = (select max(month_end) from v_z) group by factor having count(z) >= max(case factor when 'liquidity' then 2 else 2 end))")
def factor_contributions(s, d):
    return factors.contributions(factors.expanding_zscore(_transformed(s, d)), v.config(s))


@query("select factor, month_end, round(score, 6) as score, round(p, 6) as previous, round(score - p, 6) as change from (select *, lag(score) over (partition by factor order by month_end) as p from v_factor where score is not null) qualify row_number() over (partition by factor order by month_end desc) = 1")
def factor_latest(s, d):
    return factors.factor_latest(_factors(s, d))


@query("select month_end, regime, p as previous, regime <> p as changed from (select *, lag(regime) over (order by month_end) as p from v_regime where regime is not null) order by month_end desc limit 1")
def regime_latest(s, d):
    return factors.regime_latest(factors.regimes(_factors(s, d)))


@query("select asset from v_price_m group by 1 having min(price) > 0")
def price_guard(s, d):
    return research.price_guard(v.monthly_prices(s, d))


@query("select asset, month_end, horizon, round(fwd_return, 6) as fwd_return from v_fwd")
def forward_returns(s, d):
    return research.forward_returns(v.monthly_prices(s, d))


@query("select regime, asset, horizon, count(*) as n, round(avg(fwd_return), 6) as mean, round(median(fwd_return), 6) as median, round(stddev_samp(fwd_return), 6) as std, round(avg((fwd_return > 0)::int), 6) as positive_rate from v_fwd join v_regime using (month_end) where fwd_return is not null and regime is not null group by all")
def regime_return_summary(s, d):
    return research.regime_return_summary(factors.regimes(_factors(s, d)), research.forward_returns(v.monthly_prices(s, d)))


def _paired(s, d):
    signal = asof.asof_month_end(v.observations(s, d)).where("series_id = '1-URGENT'").select("month_end", F.col("value").alias("signal"))
    return research.pairs(signal, research.cross_section(research.forward_returns(v.monthly_prices(s, d))))


IC = "select horizon, case when count(*) filter (signal is not null and y is not null) >= 3 then corr(signal, y) end as ic, count(*) filter (signal is not null and y is not null) as n from v_pair group by 1"


@query(f"select horizon, round(ic, 6) as ic, n from ({IC})")
def ic(s, d):
    return research.information_coefficient(_paired(s, d))


@query("""select horizon, round(corr(a, b) filter (signal is not null and y is not null), 6) as rank_ic, count(*) filter (signal is not null and y is not null) as n from (select *,
  rank() over (partition by horizon, signal is null order by signal) + (count(*) over (partition by horizon, signal) - 1) / 2 as a, rank() over (partition by horizon, y is null order by y) + (count(*) over (partition by horizon, y) - 1) / 2 as b from v_pair) group by 1""")
def rank_ic(s, d):
    return research.rank_ic(_paired(s, d))


@query("select horizon, count(c) as windows, round(case when count(c) >= 24 then avg(c) / nullif(stddev_samp(c), 0) * sqrt(12) end, 6) as ic_ir from (select horizon, case when count(*) over w = 12 then corr(signal, y) over w end as c from v_pair where signal is not null and y is not null window w as (partition by horizon order by month_end rows between 11 preceding and current row)) group by 1")
def ic_ir(s, d):
    return research.ic_stability(_paired(s, d))


@query("select horizon, round(avg(((signal > m) = (y > 0))::int), 6) as hit_rate, count(*) as n from (select *, median(signal) over (partition by horizon) as m from v_pair where signal is not null and y is not null) group by 1")
def hit_rate(s, d):
    return research.hit_rate(_paired(s, d))


@query("select horizon, cast(bucket as int) as bucket, n, round(mean, 6) as mean, round(std, 6) as std from v_bucket")
def quantile_returns(s, d):
    return research.quantile_returns(_paired(s, d))


@query("select horizon, round(arg_max(mean, bucket) - arg_min(mean, bucket), 6) as spread from v_bucket group by 1")
def long_short(s, d):
    return research.long_short(research.quantile_returns(_paired(s, d)))


@query(f"select arg_max(horizon, abs(ic)) as best_horizon, round(arg_max(ic, abs(ic)), 6) as best_ic from ({IC})")
def idea_verdict(s, d):
    return research.idea_verdict(research.information_coefficient(_paired(s, d)))


@query("select max(a) as first, min(b) as last from (select min(date) as a, max(date) as b from v_price_d group by symbol)")
def common_history(s, d):
    return portfolio.common_history(v.daily_prices(s, d))


@query("select date, (select count(distinct symbol) from v_price_d) - count(*) as missing from v_price_d where date between (select max(a) from (select min(date) as a from v_price_d group by symbol)) and (select min(b) from (select max(date) as b from v_price_d group by symbol)) group by 1 having count(*) < (select count(distinct symbol) from v_price_d)")
def price_gaps(s, d):
    return portfolio.price_gaps(v.daily_prices(s, d))


@query("select strategy_id, cast(pos - 1 as int) as signal_pos from v_sess where fill union select strategy_id, max(pos)::int from v_sess group by 1 having false")
def rebalance_instructions(s, d):
    calendar = portfolio.sessions(v.weekly_prices(s, d), v.strategies(s))
    last = calendar.groupBy("strategy_id").agg(F.max("pos").alias("end"))
    return portfolio.rebalance_instructions(v.strategies(s), calendar).join(last, "strategy_id").where("signal_pos < end").select("strategy_id", "signal_pos")


@query("select strategy_id, cast(pos as int) as pos, date from v_sess where fill")
def fills(s, d):
    calendar = portfolio.sessions(v.weekly_prices(s, d), v.strategies(s))
    return portfolio.fills(portfolio.rebalance_instructions(v.strategies(s), calendar), calendar).select("strategy_id", "pos", "date")


def _daily(s, d):
    return portfolio.backtest_daily(v.weekly_prices(s, d), v.strategies(s), guard=False)  # the smallest tables have gaps


@query("select strategy_id, date, round(gross_return, 6) + 0.0 as gross_return, round(net_return, 6) + 0.0 as net_return, round(turnover, 6) as turnover, round(ln(equity), 6) + 0.0 as log_equity, round(drawdown, 6) + 0.0 as drawdown from v_day")
def backtest_daily(s, d):
    return _daily(s, d).withColumn("equity", F.log("equity")).withColumnRenamed("equity", "log_equity")


METRICS = """select strategy_id, count(*) as n, arg_max(equity, pos) as ending, product(1 + gross_return) - 1 as gross_total_return, stddev_samp(net_return) * sqrt(52) as volatility,
  avg(net_return) * sqrt(52) / nullif(stddev_samp(net_return), 0) as sharpe, min(drawdown) as max_drawdown, sum(turnover) as turnover, arg_max(equity, pos) - 1 as total_return,
  power(arg_max(equity, pos), 52.0 / (count(*) - 1)) - 1 as cagr, count(*) - 1 as observations from v_day group by 1"""


@query(f"""select strategy_id, n, round(ln(ending), 6) as log_ending, round(ln(1 + gross_total_return), 6) as log_gross, round(volatility, 6) as volatility, round(sharpe, 6) as sharpe, round(max_drawdown, 6) as max_drawdown, round(turnover, 6) as turnover,
  round(ln(1 + total_return), 6) as log_total, round(cagr, 6) as cagr, round(case when max_drawdown < 0 then cagr / -max_drawdown end, 6) as calmar, observations from ({METRICS})""")
def backtest_metrics(s, d):
    found = portfolio.backtest_metrics(_daily(s, d), 52.0)
    logs = [F.log("ending").alias("log_ending"), F.log(1 + F.col("gross_total_return")).alias("log_gross"), F.log(1 + F.col("total_return")).alias("log_total")]
    return found.select("*", *logs).drop("ending", "gross_total_return", "total_return")


@query("select strategy_id, cast(date_trunc('month', date) as date) as period, round(product(1 + net_return) - 1, 6) + 0.0 as ret from v_day group by all")
def monthly_returns(s, d):
    return portfolio.period_returns(_daily(s, d), "month")


@query("select strategy_id, cast(date_trunc('year', date) as date) as period, round(product(1 + net_return) - 1, 6) + 0.0 as ret from v_day group by all")
def annual_returns(s, d):
    return portfolio.period_returns(_daily(s, d), "year")


@query("""with worst as (select strategy_id, min(drawdown) as depth, arg_min(date, (drawdown, date)) as trough from v_day group by 1 having min(drawdown) < 0),
  tops as (select w.*, greatest(max(equity), 1.0) as top, min(date) as start from worst w join v_day v on v.strategy_id = w.strategy_id and v.date <= w.trough group by all)
  select t.strategy_id, round(depth, 6) as depth, trough, coalesce(min(date) filter (date <= trough and equity = top), any_value(start)) as peak, min(date) filter (date > trough and equity >= top) as recovery,
    cast(trough - coalesce(min(date) filter (date <= trough and equity = top), any_value(start)) as int) as days_to_trough, min(date) filter (date > trough and equity >= top) is not null as recovered
  from tops t join v_day v on v.strategy_id = t.strategy_id group by t.strategy_id, depth, trough""")
def drawdown_episode(s, d):
    return portfolio.drawdown_episode(_daily(s, d))


def _deposits(s, d):
    return portfolio.contribution_sessions(v.session_prices(s, d).select("date").distinct()).withColumn("amount", F.lit(100.0))


def _units(s, d):
    prices = v.session_prices(s, d)
    return portfolio.deposit_units(prices, _deposits(s, d), prices.select("symbol").distinct().withColumn("weight", F.lit(0.2)))


@query("select date from v_dep")
def contribution_sessions(s, d):
    return _deposits(s, d).select("date")


@query("select symbol, date, round(units, 6) as units from v_units")
def deposit_units(s, d):
    return _units(s, d).select("symbol", "date", "units")


@query("select date, round(equity, 6) as equity, cast(flow as double) as flow, round(nav, 6) as nav from v_nav")
def unit_nav(s, d):
    return portfolio.unit_nav(_units(s, d), _deposits(s, d))


@query("select cast(t as double) as tier, min(date) filter (nav - 1 >= t) as date from v_nav cross join (select unnest([0.02, 0.1, 5.0]) as t) group by 1")
def take_profit_triggers(s, d):
    return portfolio.take_profit_triggers(portfolio.unit_nav(_units(s, d), _deposits(s, d)), (0.02, 0.1, 5.0))


# Bisection by rounds over each account's flows.
XIRR = """flows as (select account, date, sum(amount) as amount from (select o_custkey as account, cast(o_orderdate as date) as date, -o_totalprice as amount from orders
    union all select o_custkey, date '2001-12-31', sum(o_totalprice) * (case o_custkey % 3 when 0 then 1.1 when 1 then 0.4 else 60 end) from orders group by 1) group by all),
  dated as (select account, list(struct_pack(t := (date - start) / 365.25, a := amount)) as f from (select *, min(date) over (partition by account) as start from flows) group by 1),
  rounds as (select account, f, 0 as k, -0.9999::double as lo, 1e5::double as hi from dated
    union all select account, f, k + 1, case when worth > 0 then mid else lo end, case when worth > 0 then hi else mid end
      from (select *, (lo + hi) / 2 as mid, list_sum(list_transform(f, lambda x: x.a * power(1 + (lo + hi) / 2, -x.t))) as worth from rounds where k < 120))"""


@query(f"with recursive {XIRR} select account, round(case when (select count(*) from flows l where l.account = r.account) > 1 then (lo + hi) / 2 end, 6) as xirr from rounds r where k = 120")
def xirr(s, d):
    """Per customer: orders paid in, and 1.1, 0.4 or 60 times their sum paid out at the end of 2001."""
    orders = v.table(s, d, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderdate").cast("date").alias("date"), (-F.col("o_totalprice")).alias("amount"))
    times = F.when(F.col("account") % 3 == 0, 1.1).when(F.col("account") % 3 == 1, 0.4).otherwise(60.0)
    out = orders.groupBy("account").agg((F.sum("amount") * -1).alias("amount")).select("account", F.to_date(F.lit("2001-12-31")).alias("date"), (F.col("amount") * times).alias("amount"))
    return portfolio.xirr(orders.unionByName(out))


@query("select round(avg(a - b), 6) as effect, count(*) as pairs from (select l_returnflag, l_shipmonth, max(m) filter (l_linestatus = 'F') as a, max(m) filter (l_linestatus <> 'F') as b from (select l_returnflag, l_linestatus, month(l_shipdate) as l_shipmonth, sum(l_extendedprice) / sum(l_quantity) as m from lineitem group by all) group by 1, 2) where a is not null and b is not null", 6)
def paired_effects(s, d):
    runs = v.table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus", F.month("l_shipdate").alias("month")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("m"))
    return portfolio.paired_effects(runs.withColumn("closed", F.col("l_linestatus") == "F"), "closed", ["l_returnflag", "month"], "m")


# Newest versions against those stored at the cutoff; then the same rows again, with another address in April and another value in June.
CHANGES = f"""batch as (select series_id, observation_period, value, available_date, evidence_url, availability_basis, 1 as arrival, m from v_watch qualify row_number() over (partition by series_id, observation_period order by vintage desc nulls last, landed desc) = 1),
  rows_ as (select series_id, observation_period, value, available_date, evidence_url, availability_basis, arrival from batch union all select series_id, observation_period, case when m = 6 then value + 1 else value end, available_date, case when m = 4 then 'https://example.org/new' else evidence_url end, availability_basis, 2 from batch
    union all select series_id, observation_period, value, available_date, evidence_url, null, 0 from (select * from v_watch where landed <= date '{CUTOFF}' qualify row_number() over (partition by series_id, observation_period order by vintage desc nulls last, landed desc) = 1)),
  seq as (select *, lag(value) over w as old_value, lag(available_date) over w as old_date, lag(evidence_url) over w as old_url, lag(arrival) over w as earlier from rows_ window w as (partition by series_id, observation_period order by arrival)),
  events as (select *, case when earlier is null then 'new_release' when abs(value - old_value) > 1e-12 then 'historical_revision' when available_date is distinct from old_date or evidence_url is distinct from old_url then 'provenance_update' else 'unchanged' end as event from seq where arrival > 0)"""


def _batch(s, d):
    newest = asof.latest(v.watch(s, d), ["series_id", "observation_period"], "vintage", "retrieved_at").withColumn("arrival", F.lit(1))
    m = F.month("observation_date")
    again = newest.withColumn("value", F.when(m == 6, F.col("value") + 1).otherwise(F.col("value"))).withColumn("arrival", F.lit(2))
    again = again.withColumn("availability_evidence_url", F.when(m == 4, "https://example.org/new").otherwise(F.col("availability_evidence_url")))
    return newest.unionByName(again), v.watch(s, d).where(F.col("retrieved_at").cast("date") <= CUTOFF)


@query(f"with {CHANGES} select series_id, observation_period, value, event, old_value, case when event = 'new_release' and availability_basis = 'official_release' then available_date when event in ('historical_revision', 'provenance_update') then date '2002-01-01' end as vintage from events where event <> 'unchanged'")
def ledger_changes(s, d):
    found = ledger.ledger_changes(*_batch(s, d), processed="2002-01-01").where("event <> 'unchanged'")
    return found.select("series_id", "observation_period", "value", "event", "old_value", "vintage")


@query("""select series_id, cast(last_day(m) as date) as month_end from (select series_id, unnest(generate_series(date_trunc('month', min(observation_date)), max(observation_date), interval 1 month)) as m from v_obs where month(observation_date) % 5 <> 0 group by 1)
  except select series_id, observation_date from v_obs where month(observation_date) % 5 <> 0""")
def missing_periods(s, d):
    return ledger.missing_periods(v.observations(s, d).where("month(observation_date) % 5 <> 0"))


@query("select series_id, round(avg(available_date - observation_date), 6) as mean_lag, cast(max(available_date - observation_date) as int) as max_lag, count(*) filter (available_date - observation_date > 45) as late from v_ledger group by 1")
def publication_lag(s, d):
    return ledger.publication_lag(v.ledger(s, d))


@query("select series_id, max(observation_date) as last_date, cast(date '2002-01-01' - max(observation_date) as int) as age_days from v_obs group by 1 having date '2002-01-01' - max(observation_date) > 75")
def stale_series(s, d):
    return ledger.stale_series(v.observations(s, d), "2002-01-01")


@query("select series_id, observation_date, value, p as previous, round(value / p - 1, 6) as change from (select *, lag(value) over (partition by series_id order by observation_date) as p from v_obs) where abs(value / p - 1) > 0.2")
def large_changes(s, d):
    return ledger.large_changes(v.observations(s, d), 0.2)


@query("select series_id, observation_date, value, p as previous, round(value - p, 6) as change from (select *, lag(value) over (partition by series_id order by observation_date) as p from v_obs) qualify row_number() over (partition by series_id order by observation_date desc) = 1")
def latest_metrics(s, d):
    return ledger.latest_metrics(v.observations(s, d))


@query("select series_id, count(*) as n_rows, count(distinct observation_date) as observations, min(observation_date) as first_date, max(observation_date) as last_date, count(*) - count(distinct observation_date) as revisions from v_ledger group by 1")
def ledger_coverage(s, d):
    return ledger.ledger_coverage(v.ledger(s, d))


@query(f"select company_id, metric, period_end, filed, value from (select company_id, metric, period_end, available_date as filed, value from v_fund where available_date <= date '{CUTOFF}') qualify row_number() over (partition by company_id, metric, period_end order by filed desc) = 1")
def pit_facts(s, d):
    filings = v.fundamentals(s, d).withColumnRenamed("available_date", "filed").withColumn("unit", F.lit("USD")).withColumn("ordinal", F.lit(0))
    return valuation.pit_facts(filings, CUTOFF).select("company_id", "metric", "period_end", "filed", "value")


def _suppliers(s, d):
    return v.table(s, d, "supplier").withColumn("n", F.col("s_suppkey"))


@query("""select company_id, round(tax_rate, 6) as tax_rate, round(ebit * (1 - tax_rate), 6) as nopat, round(ebit * (1 - tax_rate) + 10 - 5 - company_id % 3, 6) as fcff, case when company_id % 7 = 0 then 'missing_metric' when company_id % 11 = 0 then 'available_before_period_end' when company_id % 5 = 0 then 'no_pretax_income' end as reason
  from (select s_suppkey as company_id, s_acctbal as ebit, case when s_suppkey % 7 <> 0 and s_suppkey % 11 <> 0 and s_suppkey % 5 <> 0 then 20.0::double / (s_suppkey % 5 * 100) end as tax_rate from supplier)""")
def fcff(s, d):
    n = F.col("n")
    values = F.create_map(
        F.lit("operating_income"), F.when(n % 7 != 0, F.col("s_acctbal").cast("double")), F.lit("pretax_income"), n % 5 * 100.0, F.lit("income_tax"), F.lit(20.0), F.lit("depreciation_amortization"), F.lit(10.0),
        F.lit("capex"), F.lit(5.0), F.lit("accounts_receivable_change"), (n % 3).cast("double"),
    )
    day = F.to_date(F.lit("2020-12-31"))
    facts = _suppliers(s, d).select(n.alias("company_id"), day.alias("period_end"), F.when(n % 11 == 0, F.date_sub(day, 1)).otherwise(F.date_add(day, 60)).alias("available_date"), F.explode(values).alias("metric", "value"))
    return valuation.fcff(valuation.fcff_parts(facts.where("value is not null"))).select("company_id", "tax_rate", "nopat", "fcff", "reason")


def _dcf_rows(s, d):
    return _suppliers(s, d).select(F.col("n").alias("company_id"), F.lit(100.0).alias("fcf"), F.array_repeat((F.expr("n % 9") / 100.0), 5).alias("growth_rates"), F.lit(0.1).alias("discount"), F.lit(0.03).alias("terminal"), F.lit(50.0).alias("net_debt"), F.expr("double(n % 11)").alias("shares"))


DCF = "(list_sum([100 * power(1 + g, y) / power(1.1, y) for y in [1, 2, 3, 4, 5]]) + 100 * power(1 + g, 5) * 1.03 / 0.07 / power(1.1, 5) - 50)"


@query(f"select company_id, case when k > 0 then round({DCF} / k, 6) end as value_per_share, case when k = 0 then 'shares_not_positive' end as reason from (select s_suppkey as company_id, (s_suppkey % 9) / 100.0::double as g, s_suppkey % 11 as k from supplier)")
def dcf(s, d):
    return valuation.dcf(_dcf_rows(s, d)).select("company_id", "value_per_share", "reason")


@query("""select s_suppkey as company_id, case when s_suppkey % 11 > 0 and s_suppkey % 13 <> 0 and s_suppkey % 17 <> 0 then round((s_suppkey % 9) / 100.0::double, 6) end as implied_growth,
  case when s_suppkey % 11 = 0 then 'shares_not_positive' when s_suppkey % 17 = 0 then 'bad_price' when s_suppkey % 13 = 0 then 'price_out_of_range' end as reason from supplier""")
def reverse_dcf(s, d):
    n = F.col("company_id")
    price = F.when(n % 17 == 0, -1.0).when(n % 13 == 0, 1e9).otherwise(F.col("value_per_share"))
    return valuation.reverse_dcf(valuation.dcf(_dcf_rows(s, d)).withColumn("price", price)).select("company_id", "implied_growth", "reason")


@query("select s_suppkey as company_id, s_acctbal >= 0 and s_acctbal <= 5000 and s_suppkey % 4 <> 0 as valid, round(5000 / (100.0::double + s_suppkey) - 1, 6) as margin from supplier")
def valuation_band(s, d):
    band = _suppliers(s, d).select(F.col("n").alias("company_id"), F.col("s_acctbal").alias("low"), F.lit(5000.0).alias("base"), F.lit(9000.0).alias("high"), (F.col("n") + 100.0).alias("price"), F.when(F.col("n") % 4 == 0, 1.5).otherwise(0.9).alias("confidence"))
    return valuation.valuation_band(band).select("company_id", "valid", "margin")


@query("""with kinds as (select n_nationkey as company_id, ['general', 'high_growth', 'bank', 'insurance', 'reit', 'commodity', 'other'][n_nationkey % 7 + 1] as kind from nation),
  never as (select * from (values ('bank', ['operating_income', 'depreciation_amortization', 'capex']), ('insurance', ['operating_income', 'depreciation_amortization', 'capex']), ('reit', ['depreciation_amortization'])) t(kind, gone))
  select company_id, array_to_string(list_sort(list_filter(['operating_income', 'pretax_income', 'income_tax', 'depreciation_amortization', 'capex'], lambda m: list_contains(coalesce(gone, []), m) or m = 'income_tax' and company_id % 2 = 0)), ',') as missing from kinds left join never using (kind)""")
def fcff_support(s, d):
    companies = _kinds(s, d)
    facts = companies.select("company_id", F.explode(F.array(*map(F.lit, valuation.REQUIRED))).alias("metric")).where("metric <> 'income_tax' or company_id % 2 = 1")
    return valuation.fcff_support(facts, companies).select("company_id", F.array_join("missing", ",").alias("missing"))


def _kinds(s, d):
    kinds = F.array(*map(F.lit, ("general", "high_growth", "bank", "insurance", "reit", "commodity", "other")))
    return v.table(s, d, "nation").select(F.col("n_nationkey").alias("company_id"), F.get(kinds, (F.col("n_nationkey") % 7).cast("int")).alias("business_type"))


@query("""select company_id, cast(generate_subscripts(m, 1) - 1 as int) as place, unnest(m) as method from (select n_nationkey as company_id, case n_nationkey % 7 when 0 then ['dcf', 'reverse_dcf'] when 1 then ['reverse_dcf', 'dcf'] when 2 then ['residual_income'] when 3 then ['embedded_value'] when 4 then ['affo_nav'] when 5 then ['normalized_cycle'] end as m from nation)
  where m is not null union all select n_nationkey, null, null from nation where n_nationkey % 7 = 6""")
def method_routing(s, d):
    return valuation.method_routing(_kinds(s, d))


# Filings by tag: the seven tags of the balance sheet and those of cash flow, dealt over suppliers by line and quarter.
FILED = """filed as (select l_suppkey as company_id, ['CashAndCashEquivalentsAtCarryingValue', 'ShortTermInvestments', 'MarketableSecuritiesCurrent', 'AvailableForSaleSecurities', 'LongTermInvestments', 'LongTermDebtNoncurrent', 'LongTermDebtCurrent', 'OperatingIncomeLoss',
    'IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest', 'IncomeTaxExpenseBenefit', 'DepreciationAmortizationAndAccretionNet', 'PaymentsToAcquirePropertyPlantAndEquipment', 'IncreaseDecreaseInInventories', 'Assets'][l_partkey % 14 + 1] as metric,
    cast(last_day(date_trunc('year', l_shipdate) + interval 11 month) as date) as period_end, cast(last_day(date_trunc('year', l_shipdate) + interval 11 month) as date) + 60 + cast(l_linenumber as int) * 20 as available_date, round(sum(l_extendedprice), 2) as value
  from lineitem group by all)"""


def _filed(s, d):
    tags = [*valuation.LIQUID_TAGS.values(), *valuation.DEBT_TAGS.values(), *(valuation.TAGS[c] for c in (*valuation.REQUIRED, "inventory_change")), "Assets"]
    end = F.last_day(F.add_months(F.date_trunc("year", "l_shipdate").cast("date"), 11))
    rows = v.table(s, d, "lineitem").select(F.col("l_suppkey").alias("company_id"), F.get(F.array(*map(F.lit, tags)), (F.col("l_partkey") % 14).cast("int")).alias("metric"), end.alias("period_end"), F.date_add(end, 60 + F.col("l_linenumber").cast("int") * 20).alias("available_date"), "l_extendedprice")
    return rows.groupBy("company_id", "metric", "period_end", "available_date").agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))


BALANCE = "bal as (select *, metric like '%Debt%' as debt from filed where metric in ('CashAndCashEquivalentsAtCarryingValue', 'ShortTermInvestments', 'MarketableSecuritiesCurrent', 'AvailableForSaleSecurities', 'LongTermInvestments', 'LongTermDebtNoncurrent', 'LongTermDebtCurrent'))"


@query(f"""with {FILED}, {BALANCE}, now as (select company_id, metric, any_value(debt) as debt, arg_max(value, available_date) as value from bal where (company_id, period_end) in (select company_id, max(period_end) from bal group by 1) group by all)
  select company_id, round(coalesce(sum(value) filter (debt), 0), 2) as debt, round(coalesce(sum(value) filter (not debt), 0), 2) as liquid, round(coalesce(sum(value) filter (debt), 0) - coalesce(sum(value) filter (not debt), 0), 2) as net_debt, cast(7 - count(*) as int) as missing from now group by 1""", 2)
def net_debt(s, d):
    return valuation.net_debt(_filed(s, d)).withColumn("missing", F.size("missing"))


VALUED = f"""{FILED}, {BALANCE}, kinds as (select s_suppkey as company_id, ['general', 'bank', 'commodity', 'reit', 'general', 'general'][s_suppkey % 6 + 1] as kind, 1000.0::double + s_suppkey % 5 as shares, 200.0::double + s_suppkey % 90 as price from supplier),
  known as (select company_id, metric, period_end, max(available_date) as available_date, arg_max(value, available_date) as value from filed where available_date <= date '{CUTOFF}' group by all),
  parts as (select company_id, period_end, max(value) filter (metric = 'OperatingIncomeLoss') as ebit, max(value) filter (metric like 'IncomeLoss%') as pretax, max(value) filter (metric = 'IncomeTaxExpenseBenefit') as tax, max(value) filter (metric like 'Depreciation%') as da,
    max(value) filter (metric like 'Payments%') as capex, coalesce(max(value) filter (metric like '%Inventories'), 0) as wc from known join kinds using (company_id) where kind in ('general', 'commodity') group by all),
  cash as (select company_id, max(period_end) as period_end, arg_max(ebit * (1 - tax / pretax) + da - capex - wc, period_end) as fcff from parts where ebit is not null and pretax is not null and tax is not null and da is not null and capex is not null group by 1),
  debt as (select company_id, sum(case when debt then value else -value end) as net_debt from (select company_id, metric, any_value(metric like '%Debt%') as debt, arg_max(value, available_date) as value from known where (company_id, period_end) in
    (select company_id, max(period_end) from known where metric in (select metric from bal) group by 1) and metric in (select metric from bal) group by all) group by 1),
  sup as (select company_id, array_to_string(list_sort(list_filter(['operating_income', 'pretax_income', 'income_tax', 'depreciation_amortization', 'capex'], lambda c: not list_contains(coalesce(have, []), c))), ',') as missing from kinds left join
    (select company_id, list(distinct case when metric = 'OperatingIncomeLoss' and kind <> 'bank' then 'operating_income' when metric like 'IncomeLoss%' then 'pretax_income' when metric = 'IncomeTaxExpenseBenefit' then 'income_tax' when metric like 'Depreciation%' and kind in ('general', 'commodity') then 'depreciation_amortization'
      when metric like 'Payments%' and kind <> 'bank' then 'capex' end) as have from known join kinds using (company_id) group by 1) using (company_id)),
  val as (select k.company_id, period_end, fcff, coalesce(net_debt, 0) as net_debt, shares, price, missing,
      list_transform([0.02::double, 0.03, 0.04], lambda g: (list_sum([fcff * power(1 + g, y) / power(1.1, y) for y in [1, 2, 3, 4, 5]]) + fcff * power(1 + g, 5) * 1.02 / 0.08 / power(1.1, 5) - coalesce(net_debt, 0)) / shares) as b
    from kinds k left join cash using (company_id) left join debt using (company_id) left join sup using (company_id))"""


@query(f"""with recursive {VALUED}, rounds as (select company_id, fcff, net_debt, shares, price, 0 as k, -0.5::double as lo, 1.0::double as hi from val where fcff is not null
    union all select company_id, fcff, net_debt, shares, price, k + 1, case when p < price then mid else lo end, case when p < price then hi else mid end from (select *, (lo + hi) / 2 as mid,
      (list_sum([fcff * power(1 + (lo + hi) / 2, y) / power(1.1, y) for y in [1, 2, 3, 4, 5]]) + fcff * power(1 + (lo + hi) / 2, 5) * 1.02 / 0.08 / power(1.1, 5) - net_debt) / shares as p from rounds where k < 60)),
  edge as (select company_id, (list_sum([fcff * power(0.5, y) / power(1.1, y) for y in [1, 2, 3, 4, 5]]) + fcff * power(0.5, 5) * 1.02 / 0.08 / power(1.1, 5) - net_debt) / shares <= price and (list_sum([fcff * power(2, y) / power(1.1, y) for y in [1, 2, 3, 4, 5]]) + fcff * power(2, 5) * 1.02 / 0.08 / power(1.1, 5) - net_debt) / shares >= price as inside from val where fcff is not null)
  select company_id, period_end, round(fcff, 4) as fcff, round(net_debt, 4) as net_debt, round(b[1], 4) as low, round(b[2], 4) as base, round(b[3], 4) as high, b[1] >= 0 and b[1] <= b[2] and b[2] <= b[3] as valid, round(b[2] / price - 1, 4) as margin,
    round(case when inside then (lo + hi) / 2 end, 4) as implied_growth, case when missing <> '' then 'unsupported: ' || missing when fcff is null then 'no_full_period' end as reason
  from val left join edge using (company_id) left join (select company_id, lo, hi from rounds where k = 60) using (company_id)""", 4)
def company_values(s, d):
    """Facts to bands: filings as known at a date, cash flow, net debt, value, implied growth."""
    filings = _filed(s, d).withColumnRenamed("available_date", "filed").withColumn("unit", F.lit("USD")).withColumn("ordinal", F.lit(0))
    kinds = F.array(*map(F.lit, ("general", "bank", "commodity", "reit", "general", "general")))
    n = F.col("s_suppkey")
    companies = v.table(s, d, "supplier").select(n.alias("company_id"), F.get(kinds, (n % 6).cast("int")).alias("business_type"), (1000.0 + n % 5).alias("shares"), (200.0 + n % 90).alias("price"))
    return valuation.value_companies(filings, companies, CUTOFF)


@query("select holder, date, round(f, 6) as flow from (select *, stock - lag(stock) over (partition by holder order by date) - stock * 0.01 - 1 as f from v_stock) where f is not null")
def stock_flow(s, d):
    return valuation.stock_flow(v.stocks(s, d).withColumn("valuation", F.col("stock") * 0.01).withColumn("other", F.lit(1.0))).select("holder", "date", "flow")


@query("select holder, date, round(f, 6) as flow from (select *, stock - lag(stock) over (partition by holder order by date) * 1.02::double as f from v_stock) where f is not null")
def aum_flow(s, d):
    return valuation.aum_flow(v.stocks(s, d).withColumnRenamed("stock", "aum").withColumn("ret", F.lit(0.02))).select("holder", "date", "flow")


@query("select node, round(sum(i), 2) as inflow, round(sum(o), 2) as outflow, round(sum(i) - sum(o), 2) as net from (select dst as node, amount as i, 0 as o from v_flow where src <> dst union all select src, 0, amount from v_flow where src <> dst) group by 1", 2)
def flow_network(s, d):
    return valuation.flow_network(v.flow_edges(s, d))


@query("select entity, round(sum(score * weight * confidence) / sum(weight * confidence), 6) as score, count(*) as n from v_sig group by 1")
def combine_signals(s, d):
    return valuation.combine_signals(v.signals(s, d))


@query("select n_nationkey as company_id, n_name as name, s_suppkey as security_id from nation left join supplier on s_nationkey = n_nationkey")
def entity_join(s, d):
    companies = v.table(s, d, "nation").select(F.col("n_nationkey").alias("company_id"), F.col("n_name").alias("name"))
    return valuation.entity_join(companies, v.table(s, d, "supplier").select(F.col("s_nationkey").alias("company_id"), F.col("s_suppkey").alias("security_id")))


@query(r"""select page_id, coalesce(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '') as title, coalesce(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '') as heading, cast(len(regexp_extract_all(html, '<a href="')) as int) as n_links,
  cast(length(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\b[^>]*>.*?</(script|style)>', '', 'gs'), '<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) as int) as text_chars from pages""")
def page_fields(s, d):
    return harvest.page_fields(v.table(s, d, "pages"))


@query(r"""select page_id, href, arg_max(title, (length(title), title)) as title from (select page_id, regexp_extract(a, '<a href="([^"]*)">', 1) as href, regexp_extract(a, '>([^<]*)</a>', 1) as title from (select page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) as a from pages)) group by all""")
def page_links(s, d):
    return harvest.page_links(v.table(s, d, "pages"))


@query("select symbol, max(date) as date, round(arg_max(price, date), 6) as close from v_price_d group by symbol, date_trunc('month', date) qualify date_trunc('month', max(date)) < max(date_trunc('month', max(date))) over (partition by symbol)")
def completed_month_close(s, d):
    return harvest.completed_month_close(v.daily_prices(s, d).withColumnRenamed("price", "close"))


@query("select symbol, count(*) as n, count(*) filter (least(price, price - 1500) <= 0) as bad_price, count(*) filter (price < 3000) as high_below_low, 0::bigint as duplicates from v_price_d group by 1")
def ohlc_checks(s, d):
    p = F.col("price")
    return harvest.ohlc_checks(v.daily_prices(s, d).select("symbol", "date", p.alias("open"), (p - 1500).alias("close"), p.alias("high"), F.least(p, F.lit(3000.0)).alias("low")).withColumn("low", F.when(F.col("high") < 3000, F.lit(3000.0)).otherwise(F.col("low"))))


@query("select symbol, count(*) as n, min(date) as first_date, max(date) as last_date, round(min(price), 6) as least, round(max(price), 6) as most from v_price_d group by 1")
def price_status(s, d):
    return harvest.price_status(v.daily_prices(s, d))


from almanac.plans import checks, extended, landed  # noqa: E402, F401
