"""Registered checks of entities, edges, signals, catalogs, bars and prices over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import asof, contracts, harvest, ledger, research, valuation
from almanac.plans import views as v
from almanac.plans.base import query
from almanac.sources import catalog, readers

# A catalog of parts: providers are brands, symbols are types, and some entries are faulty.
CATALOG = """cat as (select cast(p_partkey as varchar) as key, p_brand as provider, p_type as symbol, case when p_partkey % 11 = 0 then 'stock' else ['macro', 'market', 'rate', 'fx', 'commodity'][p_partkey % 5 + 1] end as kind,
  case when p_partkey % 13 = 0 then null else ['daily', 'weekly', 'monthly', 'quarterly'][p_partkey % 4 + 1] end as frequency, case when p_partkey % 17 = 0 then 'soon' else cast(p_partkey % 9 - 1 as varchar) end as lag, p_partkey from part)"""


def _catalog(s, d):
    n = F.col("p_partkey")
    kinds, steps = F.array(*map(F.lit, catalog.KINDS)), F.array(*map(F.lit, catalog.FREQUENCIES))
    return v.table(s, d, "part").select(
        n.cast("string").alias("key"),
        F.col("p_brand").alias("provider"),
        F.col("p_type").alias("symbol"),
        F.when(n % 11 == 0, "stock").otherwise(F.get(kinds, (n % 5).cast("int"))).alias("kind"),
        F.when(n % 13 != 0, F.get(steps, (n % 4).cast("int"))).alias("frequency"),
        F.when(n % 17 == 0, "soon").otherwise((n % 9 - 1).cast("string")).alias("release_lag_days"),
        F.lit("").alias("notes"),
    )


@query(f"""with {CATALOG} select 'kind' as rule, key from cat where kind = 'stock' union all select 'frequency_missing', key from cat where frequency is null union all select 'lag_not_whole', key from cat where lag = 'soon' union all select 'lag_negative', key from cat where try_cast(lag as int) < 0""")
def catalog_violations(s, d):
    return catalog.catalog_violations(_catalog(s, d))


@query(f"""with {CATALOG} select 'shared_symbol' as warning, string_agg(key, ',' order by key) as keys from cat group by provider, symbol having count(*) > 1 union all select 'no_lag', key from cat where try_cast(lag as int) = 0 and frequency in ('monthly', 'quarterly')
  union all select 'long_daily_lag', key from cat where try_cast(lag as int) > 3 and frequency = 'daily'""")
def catalog_warnings(s, d):
    return catalog.catalog_warnings(_catalog(s, d)).withColumn("keys", F.array_join("keys", ","))


def _edges(s, d):
    edges = v.flow_edges(s, d)
    n = (F.col("src") * 31 + F.col("dst")) % 10
    return edges.select(
        F.when(n != 1, F.col("src")).alias("src"), F.when(n == 2, F.col("src")).otherwise(F.col("dst")).alias("dst"), "amount", F.when(n == 3, "").otherwise("USD").alias("currency"),
        F.when(n == 4, "guess").when(n % 2 == 0, "observed").otherwise("inferred").alias("evidence"), F.when(n == 5, 1.5).otherwise(0.5).alias("confidence"), F.when(n != 6, "x").alias("source"), F.to_date(F.lit("2024-01-31")).alias("date"),
    )


EDGES = """edge as (select case when n <> 1 then src end as src, case when n = 2 then src else dst end as dst, amount, case when n = 4 then 'guess' when n % 2 = 0 then 'observed' else 'inferred' end as evidence, case when n = 3 then '' else 'USD' end as currency, n, src as s0, dst as d0
  from (select *, (src * 31 + dst) % 10 as n from v_flow))"""


@query(f"""with {EDGES} select 'node_missing' as rule, src, dst from edge where n = 1 union all select 'same_node', src, dst from edge where src = dst union all select 'currency_missing', src, dst from edge where n = 3
  union all select 'evidence', src, dst from edge where n = 4 union all select 'confidence', src, dst from edge where n = 5 union all select 'source_missing', src, dst from edge where n = 6""")
def edge_violations(s, d):
    return valuation.edge_violations(_edges(s, d))


@query(f"""with {EDGES} select node, date '2024-01-31' as date, currency, evidence, round(sum(i), 0) as inflow, round(sum(o), 0) as outflow, round(sum(i) - sum(o), 0) as net from (select dst as node, currency, evidence, amount as i, 0 as o from edge where src <> dst
  union all select src, currency, evidence, 0, amount from edge where src <> dst) group by all""", 0)
def flow_network_by_evidence(s, d):
    return valuation.flow_network(_edges(s, d))


@query("""select 'score' as rule, entity, component from v_sig where entity % 5 = 0 union all select 'weight', entity, component from v_sig where entity % 5 = 1 union all select 'confidence', entity, component from v_sig where entity % 5 = 2 union all select 'name_missing', entity, '' from v_sig where entity % 5 = 3""")
def component_violations(s, d):
    m = F.col("entity") % 5
    rows = v.signals(s, d).withColumn("score", F.when(m == 0, float("inf")).otherwise(F.col("score"))).withColumn("weight", F.when(m == 1, -1.0).otherwise(F.col("weight")))
    return valuation.component_violations(rows.withColumn("confidence", F.when(m != 2, F.col("confidence"))).withColumn("component", F.when(m == 3, "").otherwise(F.col("component"))))


@query("select entity, case when count(*) >= 4 then round(sum(score * weight * confidence) / sum(weight * confidence), 6) end as score, count(*) as n from v_sig where (entity % 2 = 0 or component <> 'BUILDING') and (entity % 3 <> 0 or component <> 'MACHINERY') group by 1")
def combine_signals_minimum(s, d):
    """Components without weight or confidence are not used; with fewer than four there is no score."""
    rows = v.signals(s, d)
    rows = rows.withColumn("weight", F.when((F.col("entity") % 2 == 1) & (F.col("component") == "BUILDING"), 0.0).otherwise(F.col("weight")))
    return valuation.combine_signals(rows.withColumn("confidence", F.when((F.col("entity") % 3 == 0) & (F.col("component") == "MACHINERY"), 0.0).otherwise(F.col("confidence"))), 4)


@query("""select 'company_id' as rule, n_name as id from nation where n_nationkey % 3 = 0 union all select 'name', 'N:' || n_name from nation where n_nationkey % 3 <> 0 and n_nationkey % 4 = 0 union all select 'name', n_name from nation where n_nationkey % 3 = 0 and n_nationkey % 4 = 0
  union all select 'security_id', s_name from supplier where s_suppkey % 3 = 0 union all select 'attributes', case when s_suppkey % 3 = 0 then s_name else 'S:' || s_name end from supplier where s_suppkey % 5 = 0""")
def entity_violations(s, d):
    n, k = F.col("n_nationkey"), F.col("s_suppkey")
    companies = v.table(s, d, "nation").select(F.when(n % 3 == 0, F.col("n_name")).otherwise(F.concat(F.lit("N:"), "n_name")).alias("company_id"), F.when(n % 4 != 0, F.col("n_name")).alias("name"))
    name = F.when(k % 3 == 0, F.col("s_name")).otherwise(F.concat(F.lit("S:"), "s_name"))
    securities = v.table(s, d, "supplier").select(name.alias("security_id"), F.lit("T").alias("ticker"), F.when(k % 5 == 0, " ").otherwise("X").alias("exchange"), F.lit("USD").alias("currency"))
    return valuation.company_violations(companies).unionByName(valuation.security_violations(securities))


@query("select s_suppkey as n, case when s_nationkey <> 7 then 'US:' || lpad(cast(s_nationkey as varchar), 10, '0') end as company_id from supplier")
def entity_resolution(s, d):
    """Suppliers to ids of their nations by name, in another case and with blanks; one nation is not in the table."""
    nations = v.table(s, d, "nation").select(F.col("n_nationkey"), F.col("n_name"))
    rows = v.table(s, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("n"), F.concat(F.lit(" "), F.lower("n_name")).alias("ticker"))
    tickers = nations.where("n_nationkey <> 7").select(F.col("n_nationkey").alias("cik_str"), F.col("n_name").alias("ticker"))
    return readers.resolve_entities(rows, tickers).select("n", "company_id")


@query("select company_id, metric, period_end, available_date, value, cast(row_number() over (partition by company_id, metric order by period_end desc, available_date desc) as int) as place from v_fund")
def tidy_facts(s, d):
    return valuation.tidy_facts(v.fundamentals(s, d))


@query("select holder, date, round(stock - lag(stock) over (partition by holder order by date) - 2, 6) as flow, 0.0::double as residual from v_stock qualify row_number() over (partition by holder order by date) > 1", 4)
def stock_identity(s, d):
    return valuation.stock_flow(v.stocks(s, d).withColumn("valuation", F.lit(1.0)).withColumn("other", F.lit(1.0))).select("holder", "date", "flow", "residual")


@query("""with t as (select case when day(date) = 2 then 'never' when day(date) % 2 = 0 then strftime(date, '%-m/%-d/%Y') else strftime(date, '%Y-%m-%d') end as place, day(date) as k from (select distinct date from v_price_d))
  select case k when 2 then 'bad_date' when 3 then 'bad_price' when 4 then 'high_below_low' else 'duplicate_date' end as rule, place from t where k in (2, 3, 4, 5) union all select 'too_few_rows', cast(count(*) + count(*) filter (k = 5) as varchar) from t""")
def ohlc_violations(s, d):
    """Bars as text in two date formats, with a fault of each kind."""
    k, date = F.dayofmonth("date"), F.col("date")
    rows = v.daily_prices(s, d).select("date").distinct()
    text = F.when(k == 2, "never").when(k % 2 == 0, F.date_format(date, "M/d/yyyy")).otherwise(date.cast("string"))
    bars = rows.select(text.alias("DATE"), F.lit("2").alias("OPEN"), F.when(k == 4, "1").otherwise("3").alias("HIGH"), F.lit("2").alias("LOW"), F.when(k == 3, "-2").otherwise("2").alias("CLOSE"), k.alias("k"))
    return harvest.validate_ohlc(bars.drop("k").unionByName(bars.where("k = 5").drop("k")), 10**9)[1].withColumnRenamed("at", "place")


@query("select symbol, date, 1.0::double * cast(day(date) as int) as price from v_price_d where day(date) <> 3")
def vendor_close(s, d):
    """One field of a long vendor table; empty cells go."""
    rows = v.daily_prices(s, d).select(F.col("symbol").alias("ticker"), F.to_timestamp("date").alias("time"), F.when(F.dayofmonth("date") != 3, F.dayofmonth("date")).alias("value"))
    return harvest.select_close(rows.withColumn("field", F.lit("Close")).unionByName(rows.withColumn("field", F.lit("Open"))))


@query("""select coalesce(p.symbol, c.symbol) as symbol, min(date) as first_date, max(date) as last_date, count(date) as n, case when count(date) = 0 then 'missing' when any_value(p.symbol) = 'LARGE' then 'invalid' when any_value(c.symbol) is null then 'present_not_configured' else 'ok' end as quality
  from v_price_d p full join (select unnest(['ECONOMY', 'LARGE', 'ABSENT', 'SMALL']) as symbol) c on p.symbol = c.symbol group by 1""")
def price_report(s, d):
    prices = v.daily_prices(s, d).withColumn("price", F.when(F.col("symbol") == "LARGE", -F.col("price")).otherwise(F.col("price")))
    return harvest.price_report(prices, s.createDataFrame([(" economy",), ("LARGE",), ("ABSENT",), ("SMALL",)], "symbol string"))


@query("select series_id as symbol, observation_date as date, observation_date + 1 as available_date, 'fixed_lag' as availability_basis from v_obs")
def estimated_closes(s, d):
    closes = v.observations(s, d).select(F.col("series_id").alias("symbol"), F.col("observation_date").alias("date"), F.col("value").alias("close"))
    return harvest.estimated_closes(closes).select(F.col("series_id").alias("symbol"), F.col("observation_date").alias("date"), "available_date", "availability_basis")


@query("""select series_id, strftime(observation_date, '%Y-%m') as observation_period, case when availability_basis <> 'unknown' then available_date end as vintage, date '2020-05-01' as retrieved, 'percent' as unit from v_obs""")
def seeded_ledger(s, d):
    obs = v.observations(s, d).withColumn("observation_period", F.lit(" "))
    side = obs.select("series_id").distinct().withColumn("unit", F.lit("percent")).withColumn("downloaded_at", F.to_timestamp(F.lit("2020-05-01")))
    return ledger.seed_ledger(obs, side).select("series_id", "observation_period", "vintage", F.col("retrieved_at").cast("date").alias("retrieved"), "unit")


@query("select series_id, observation_date, available_date, observation_date + lag_days as expected from v_obs where availability_basis = 'fixed_lag' and month(observation_date) = 4")
def lag_violations(s, d):
    obs = v.observations(s, d)
    moved = obs.withColumn("available_date", F.when(F.month("observation_date") == 4, F.date_add("available_date", 1)).otherwise(F.col("available_date")))
    return contracts.lag_violations(moved, obs.select("series_id", F.col("lag_days").alias("availability_lag_days")).distinct()).withColumn("available_date", F.date_sub("available_date", 1))


@query("select 'duplicate_month' as problem, month_end from v_panel where series_id = '1-URGENT' and month(month_end) = 6")
def signal_guard(s, d):
    rows = asof.asof_month_end(v.observations(s, d)).where("series_id = '1-URGENT'").select("month_end", F.col("value").alias("signal"))
    return research.signal_guard(rows.unionByName(rows.where("month(month_end) = 6")))


@query("""select series_id, observation_date, case when series_id = '3-MEDIUM' then 'cumulative_ytd_yoy' else u end as reported_as, case when u like '%percent%' then '%' when u = 'index_points' then '点' else u end as shown_unit,
  case when u in ('percent_yoy', 'percent_ytd_yoy') then '个百分点' when u like '%percent%' then '%' when u = 'index_points' then '点' else u end as change_unit
  from (select *, ['percent_yoy', 'percent_ytd_yoy', 'yield_percent', 'percent', 'index_points', 'tons'][month(observation_date) % 6 + 1] as u from v_obs)""")
def displayed_units(s, d):
    units = F.array(*map(F.lit, ("percent_yoy", "percent_ytd_yoy", "yield_percent", "percent", "index_points", "tons")))
    rows = v.observations(s, d).withColumn("unit", F.get(units, F.month("observation_date") % 6)).withColumn("own", F.col("series_id"))
    rows = rows.withColumn("series_id", F.when(F.col("series_id") == "3-MEDIUM", "cn_fixed_asset_investment").otherwise(F.col("series_id")))
    return ledger.displayed(rows).select(F.col("own").alias("series_id"), "observation_date", "reported_as", "shown_unit", "change_unit")


@query("""select series_id, min(observation_date)::date as first_date, string_agg(strftime(m, '%Y-%m'), ',' order by m) as months from (select series_id, observation_date, unnest(generate_series(date_trunc('month', observation_date), date_trunc('month', observation_date) + interval 1 month, interval 1 month)) as m from v_obs where month(observation_date) = 1) group by 1""")
def period_months(s, d):
    """Joint periods as the months that they cover."""
    rows = v.observations(s, d).where("month(observation_date) = 1")
    period = F.concat(F.date_format("observation_date", "yyyy-MM"), F.lit("/"), F.date_format(F.add_months("observation_date", 1), "yyyy-MM"))
    months = rows.select("series_id", "observation_date", F.explode(ledger.covered_months(period)).alias("m"))
    return months.groupBy("series_id").agg(F.min("observation_date").alias("first_date"), F.array_join(F.array_sort(F.collect_list(F.date_format("m", "yyyy-MM"))), ",").alias("months"))
