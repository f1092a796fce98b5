"""Queries over files that are landed from the given tables and read back, and over release pages made of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almanac.functions.columns import safe_name
from almanac.operators import asof, contracts, factors, harvest, ledger, portfolio, research, valuation
from almanac.plans import views as v
from almanac.plans.base import CUTOFF, query
from almanac.sources import catalog, readers
from almanac.sources.shared import shared_folder, written
from almanac.streaming.ledger import folder_value

# Release pages: the kind, period and value of each follow from page_id; the given page stands around and inside of them.
_TITLES = ("规模以上工业增加值", "社会消费品零售总额", "全国固定资产投资基本情况", "居民消费价格", "工业生产者出厂价格", "民间投资", "金融统计数据报告", "社会融资规模存量统计数据报告")
_PHRASES = ("规模以上工业增加值", "社会消费品零售总额", "固定资产投资（不含农户）", "居民消费价格", "工业生产者出厂价格", "民间投资", "广义货币(M2)余额", "社会融资规模存量")


def release_pages(s, d):
    """(url, html): nested divisions, references by name and number, comments, and a second value outside of the article."""
    k, year = F.pmod("page_id", F.lit(8)), F.lit(2010) + F.pmod("page_id", F.lit(10))
    month, joint = F.lit(1) + F.pmod("page_id", F.lit(12)), F.pmod("page_id", F.lit(3)) == 0
    kind, phrase = F.get(F.array(*map(F.lit, _TITLES)), k.cast("int")), F.get(F.array(*map(F.lit, _PHRASES)), k.cast("int"))
    period = F.concat(year.cast("string"), F.lit("年"), F.when(joint & (month > 1), F.lit("1&mdash;")).otherwise(""), month.cast("string"), F.lit("月&#20221;"))
    word = F.get(F.array(F.lit("增长"), F.lit("下降"), F.lit("持平")), F.pmod("page_id", F.lit(3)).cast("int"))
    number = F.format_string("%d.%d", F.pmod("page_id", F.lit(97)), F.pmod("page_id", F.lit(10)))
    title = F.concat(period, kind)
    date = F.concat((year + 1).cast("string"), F.lit("/1/"), (F.lit(1) + F.pmod("page_id", F.lit(28))).cast("string"), F.lit(" 10:00"))
    body = F.concat(F.lit("<div><p>&nbsp;"), F.lit("<!-- </div> -->"), phrase, F.lit("</p></div><div><div><span>同比"), word, number, F.lit("%</span></div><script>x='</div>'</script></div>"))
    page = F.concat(
        F.lit("<html><head><meta name=\"ArticleTitle\" content='"), title, F.lit("'><meta content='"), F.when(k % 2 == 0, date).otherwise(""), F.lit("' name=PubDate></head><body>"),
        F.lit("<div class='nav'>"), "html", F.lit("</div><div class=\"TRS_Editor big\">"), body, F.lit("</div><div>"), phrase, F.lit("同比增长99.9%</div></body></html>"),
    )
    root = shared_folder(s, "pages")
    v.table(s, d, "pages").select("page_id", F.concat(F.lit("http://example.org/p/"), F.col("page_id").cast("string")).alias("url"), page.alias("html")).write.parquet(root)
    return s.read.schema("page_id long, url string, html string").parquet(root)


_RELEASES = """rel as (select *, cast('http://example.org/p/' || page_id as varchar) as url, cast(last_day(make_date(y, m, 1)) as date) as observation_date,
    case when j then y || '-01/' || y || '-' || lpad(cast(m as varchar), 2, '0') else y || '-' || lpad(cast(m as varchar), 2, '0') end as observation_period,
    case k when 0 then 'industrial_production' when 1 then case when j then 'retail_sales_ytd' else 'retail_sales' end when 2 then 'fixed_asset_investment' when 3 then 'cpi' when 4 then 'ppi' when 6 then 'm2' when 7 then 'tsf_stock' end as series,
    case page_id % 3 when 0 then 1 when 1 then -1 else 0 end * cast((page_id % 97) || '.' || (page_id % 10) as double) as value
  from (select page_id, page_id % 8 as k, 2010 + page_id % 10 as y, 1 + page_id % 12 as m, page_id % 3 = 0 and page_id % 12 > 0 as j from pages))"""


@query(f"with {_RELEASES} select url, series, observation_date, observation_period, case when k % 2 = 0 then make_date(y + 1, 1, cast(1 + page_id % 28 as int)) end as published, value from rel where series is not null union all select url, 'm1', observation_date, observation_period, make_date(y + 1, 1, cast(1 + page_id % 28 as int)), null from rel where k = 6")
def release_values(s, d):
    return harvest.page_values(release_pages(s, d)).select("url", "series", "observation_date", "observation_period", "published", "value")


@query(f"with {_RELEASES} select series as series_id, count(distinct observation_date) as observations, min(observation_date) as first_date, max(observation_date) as last_date, count(*) filter (k % 2 = 0) as dated, count(*) filter (k % 2 = 1) as undated from rel where series is not null group by 1")
def harvested_coverage(s, d):
    return harvest.harvest(release_pages(s, d))[2]


@query("""with hit as (select page_id, 'http://example.org/sj/' || (page_id % 40) || '.html' as url, 'release ' || page_id as title from pages where page_id % 5 <> 0) select url, max_by(title, (strlen(title), title)) as title from hit group by 1""")
def listed_releases(s, d):
    """Links of listings by relative addresses of many forms to one path, the longest title of an address first; others lead elsewhere."""
    n = F.pmod("page_id", F.lit(40)).cast("string")
    form = F.pmod("page_id", F.lit(5))
    href = F.when(form == 1, F.concat(F.lit("../../sj/"), n, F.lit(".html"))).when(form == 2, F.concat(F.lit("/x/.././sj/"), n, F.lit(".html")))
    href = href.when(form == 3, F.concat(F.lit("//example.org/sj/"), n, F.lit(".html"))).when(form == 4, F.concat(F.lit("../../../../sj/./"), n, F.lit(".html"))).otherwise(F.lit("?page=2"))
    anchor = F.concat(F.lit("<div><a target=\"_blank\" href='"), href, F.lit("'><b>release</b>&#32;"), F.col("page_id").cast("string"), F.lit("</a></div>"))
    pages = v.table(s, d, "pages").select(F.lit("http://example.org/list/2024/index.html").alias("url"), anchor.alias("html"))
    return harvest.candidate_links(harvest.release_links(pages), "/sj/")


# Files as they are landed: a folder per layout and per series or symbol.


def _series(file):
    return folder_value(file, "series_id")


def _obs(s, d):
    return v.observations(s, d).withColumn("observation_date", F.col("observation_date").cast("string")).withColumn("available_date", F.col("available_date").cast("string")).withColumn("value", F.col("value").cast("string"))


def _land(df, path, **options):
    df.write.mode("append").options(header=True, **options).partitionBy("series_id").csv(path)


def _landed_snapshots(s, d):
    """Three layouts: with the basis in another order, without it, and with fourteen columns behind quoted names that hold commas and line ends."""
    root, obs = shared_folder(s, "snapshots"), written(_obs(s, d), "obs")  # for all three layouts
    digit = F.substring("series_id", 1, 1).cast("int") % 3
    _land(obs.where(digit == 0).select("series_id", "availability_basis", "value", "available_date", "observation_date"), f"{root}/a")
    _land(obs.where(digit == 1).select("series_id", "observation_date", "value", "available_date"), f"{root}/b")
    wide = [F.lit(f"x{i}, \"{i}\"\nnext").alias(f"extra, {i}") for i in range(11)]
    _land(obs.where(digit == 2).select("series_id", *wide, "available_date", "observation_date", "value"), f"{root}/c", escape='"')
    return readers.read_snapshots(s, f"{root}/*/*", name=_series)


@query("select series_id, observation_date, value, available_date, case when d % 3 = 0 then availability_basis when available_date is not null then 'unverified' else 'unknown' end as availability_basis from (select *, cast(substr(series_id, 1, 1) as int) as d from v_obs)")
def landed_snapshots(s, d):
    return _landed_snapshots(s, d).select("series_id", "observation_date", "value", "available_date", "availability_basis")


@query("select series_id, observation_date, value, case when series_id <> '2-HIGH' then 'percent' end as unit from v_obs where observation_date between date '1995-03-01' and date '1996-06-30'")
def landed_with_sidecar(s, d):
    """A range of dates, with what sidecars say of the series; one series has none."""
    rows = _landed_snapshots(s, d).where("observation_date between '1995-03-01' and '1996-06-30'")
    side = v.observations(s, d).select(F.col("series_id").alias("series_key")).distinct().where("series_key <> '2-HIGH'").withColumn("unit", F.lit("percent"))
    return readers.attach_sidecar(rows, side).select("series_id", "observation_date", "value", "unit")


@query("""select 'no_sidecar' as rule, '2-HIGH' as series_id union all select unnest(['source_name', 'source_url', 'frequency', 'downloaded_at', 'reported_as', 'revision_policy']) || '_missing', series_id from (select distinct series_id from v_obs where series_id <> '2-HIGH')""")
def sidecar_violations(s, d):
    obs = v.observations(s, d)
    side = obs.select(F.col("series_id").alias("series_key")).distinct().where("series_key <> '2-HIGH'").withColumn("unit", F.lit("percent")).withColumn("frequency", F.lit(" "))
    return readers.sidecar_violations(obs, side)


def _landed_prices(s, d):
    root = shared_folder(s, "prices")
    rows = written(v.daily_prices(s, d), "daily").withColumnRenamed("symbol", "series_id").withColumn("day", F.dayofmonth("date"))  # for all three layouts
    text = F.when(F.col("day") == 2, "never").otherwise(F.col("date").cast("string"))
    price = F.when(F.col("day") == 3, "-1").otherwise(F.col("price").cast("string"))
    dated = F.concat(F.date_sub("date", 1).cast("string"), F.lit("T23:30:00-01:00"))
    filler = [F.lit("1").alias(f"c{i}") for i in range(12)]
    _land(rows.where("series_id < 'M'").select("series_id", *filler, text.alias("Trade Date"), F.lit("0").alias("Close"), price.alias("Adj Close")), f"{root}/a")
    _land(rows.where("series_id >= 'M' and series_id < 'S'").select("series_id", F.when(F.col("day") == 2, "").otherwise(dated).alias("timestamp"), price.alias("value")), f"{root}/b")
    _land(rows.where("series_id >= 'S'").select("series_id", F.col("date").cast("string").alias("when"), price.alias("price")), f"{root}/c")
    return readers.read_prices(s, f"{root}/*/*", name=_series)


@query("select symbol, date, round(price, 6) as price, case when symbol < 'M' then 'adjusted' else 'as_supplied' end as basis from v_price_d where symbol < 'S' and day(date) not in (2, 3)")
def landed_prices(s, d):
    """Dates and prices in columns 13 to 15, names in another case, instants with an offset."""
    return _landed_prices(s, d)[0]


@query("select case when day(date) = 2 then 'bad_date' else 'bad_price' end as rule, symbol, case when day(date) = 3 then date end as date, count(*) as n from v_price_d where symbol < 'S' and day(date) in (2, 3) group by all union all select 'no_header', symbol, null, 1 from v_price_d where symbol >= 'S' group by symbol")
def landed_price_violations(s, d):
    """Faulty rows, and files whose header names no date."""
    found = _landed_prices(s, d)[1]
    rows = found.where("rule <> 'no_header'").groupBy("rule", "symbol", "date").agg(F.count("*").alias("n"))
    return rows.unionByName(found.where("rule = 'no_header'").distinct().withColumn("n", F.lit(1).cast("long")))


@query("select series_id, observation_date, value from v_obs where month(observation_date) <> 5 and observation_date >= date '1994-01-01'")
def landed_series(s, d):
    """Two-column files by the name of their reader; cells that are no number go."""
    root = shared_folder(s, "series")
    rows = _obs(s, d).withColumn("value", F.when(F.month("observation_date") == 5, ".").otherwise(F.col("value")))
    _land(rows.select("series_id", F.col("observation_date").alias("DATE"), F.col("value").alias("X")), root)
    return readers.READERS["two_column"](s, f"{root}/*", "1994-01-01", name=_series)


@query("select series_id, vintage, observation_date, value, least(observation_date + 90, vintage) as available_date from v_ledger")
def landed_vintages(s, d):
    """An archive of a folder per series and vintage, with dates of availability."""
    root = shared_folder(s, "archive")
    rows = v.ledger(s, d).select("series_id", F.col("vintage").cast("string").alias("v"), "observation_date", "value", "vintage")
    rows.write.option("header", True).partitionBy("series_id", "v").csv(root)
    found = readers.read_vintages(s, root, r"series_id=([^/]+)/v=([0-9-]{10})/")
    return readers.with_vintage_availability(found, 90).select("series_id", "vintage", "observation_date", "value", "available_date")


@query(f"select series_id, count(distinct vintage) filter (vintage > date '{CUTOFF}') as captured, count(distinct vintage) filter (vintage <= date '{CUTOFF}') as skipped from v_ledger group by 1")
def captured_vintages(s, d):
    """A second capture of all vintages after a first one up to a date: only the later ones are written."""
    root, rows = shared_folder(s, "captured"), written(v.ledger(s, d), "ledger")  # for both captures
    readers.capture_vintages(s, rows.where(F.col("vintage") <= CUTOFF), root)
    return readers.capture_vintages(s, rows, root)


@query("select series_id, cast(p as date) as vintage from (select distinct series_id from v_ledger), (select unnest(generate_series(date '1995-01-31', date '1997-01-31', interval 6 month)) as p) where (series_id, cast(p as date)) not in (select series_id, vintage from v_ledger)")
def planned_vintages(s, d):
    held = v.ledger(s, d).select("series_id", "vintage").distinct()
    return readers.plan_vintages(s, held.select("series_id").distinct(), "1995-01-31", "1997-01-31", 6, held)


@query("""select 'US:' || lpad(cast(l_suppkey as varchar), 10, '0') as company_id, l_returnflag as metric, case when l_linenumber % 2 = 0 then 'USD' else 'CNY' end as unit, cast(min(o_orderdate) as date) as period_start, cast(l_shipdate as date) as period_end, cast(l_shipdate as date) + 30 as filed, round(sum(l_extendedprice), 2) as value,
  'SEC/' || case when l_linenumber % 3 = 0 then '10-Q' else '10-K' end || '/' || cast(max(l_orderkey) as varchar) as source from lineitem join orders on l_orderkey = o_orderkey where l_linenumber % 5 <> 4 group by l_suppkey, l_returnflag, l_linenumber, l_shipdate""", 2)
def landed_facts(s, d):
    """Nested documents, a line per company, of tags, units and facts; forms that are not periodic are left out."""
    root = shared_folder(s, "facts")
    lines = v.table(s, d, "lineitem").join(v.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    lines = lines.repartition("l_suppkey")  # which serves all groups below
    n = F.col("l_linenumber")
    by = lines.groupBy("l_suppkey", "l_returnflag", "l_linenumber", "l_shipdate").agg(F.round(F.sum("l_extendedprice"), 2).alias("val"), F.min("o_orderdate").cast("date").alias("start"), F.max("l_orderkey").cast("string").alias("accn"))
    form = F.when(n % 5 == 4, "8-K").when(n % 3 == 0, "10-Q").otherwise("10-K")
    fact = F.struct("start", F.col("l_shipdate").cast("date").alias("end"), "val", F.date_add(F.col("l_shipdate").cast("date"), 30).alias("filed"), form.alias("form"), "accn")
    units = by.groupBy("l_suppkey", "l_returnflag", F.when(n % 2 == 0, "USD").otherwise("CNY").alias("unit")).agg(F.collect_list(fact).alias("list"))
    tags = units.groupBy("l_suppkey", "l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("unit", "list"))).alias("units"))
    docs = tags.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", F.struct(F.lit("x").alias("label"), "units")))).alias("tags"))
    docs.select(F.to_json(F.struct(F.col("l_suppkey").alias("cik"), F.create_map(F.lit("us-gaap"), "tags").alias("facts"))).alias("value")).write.text(root)
    return readers.read_company_facts(s, root, lines=True).drop("ordinal")


@query("select sha256(n_name || chr(10)) as sha256, cast(strlen(n_name) + 1 as bigint) as length from nation")
def file_hashes(s, d):
    """Digests of files that hold one name each."""
    root = shared_folder(s, "files")
    v.table(s, d, "nation").select(F.col("n_name").alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(root)
    return readers.file_inventory(s, f"{root}/*").select("sha256", "length")


@query("with o as (select count(*) as n, min(observation_date) as a, max(observation_date) as b from v_obs where series_id = '2-HIGH'), w as (select count(*) as n, min(observation_date) as a, max(observation_date) as b from v_obs where series_id = '2-HIGH' and observation_date between date '1993-01-01' and date '1997-12-31') select w.n < o.n as shorter, w.a > o.a as starts_later, w.b < o.b as ends_earlier from o, w")
def history_guard(s, d):
    obs = v.observations(s, d).where("series_id = '2-HIGH'")
    return readers.history_guard(obs, obs.where("observation_date between '1993-01-01' and '1997-12-31'"))


@query("select series_id, observation_date, value, available_date from v_obs where month(observation_date) <> 3")
def saved_snapshots(s, d):
    """Rows beside an undated copy, and March with two values: the dated row is kept, March is a conflict and not written."""
    root, obs = shared_folder(s, "saved"), v.observations(s, d).select("series_id", "observation_date", "value", "available_date")
    march = obs.where("month(observation_date) = 3").withColumn("value", F.col("value") + 1)
    readers.save_snapshots(obs.unionByName(obs.withColumn("available_date", F.lit(None).cast("date"))).unionByName(march), root)
    return s.read.schema("observation_date date, value double, available_date date, series_id string").parquet(root).select("series_id", "observation_date", "value", "available_date")


@query("select series_id, observation_date from v_obs where month(observation_date) = 3")
def snapshot_conflicts(s, d):
    root, obs = shared_folder(s, "conflicts"), v.observations(s, d).select("series_id", "observation_date", "value", "available_date")
    march = obs.where("month(observation_date) = 3").withColumn("value", F.col("value") + 1)
    return readers.save_snapshots(obs.unionByName(march), root)[0]


@query("select 'panel' as part, count(*) as n from v_panel union all select 'prices', count(*) from v_price_m union all select 'forward_returns', count(*) from v_fwd union all select 'run', 2")
def saved_tables(s, d):
    """Tables of a baseline and of regime research, written and counted when read back."""
    root, panel = shared_folder(s, "tables"), asof.asof_month_end(v.observations(s, d))
    prices = v.monthly_prices(s, d)
    readers.save_baseline(f"{root}/b", panel, panel, panel, {"policy": "all", "country": "x"})
    readers.save_regime_research(f"{root}/r", panel, prices, research.forward_returns(prices), panel)
    parts = [("panel", s.read.parquet(f"{root}/b/panel")), ("prices", s.read.parquet(f"{root}/r/prices")), ("forward_returns", s.read.parquet(f"{root}/r/forward_returns")), ("run", s.read.json(f"{root}/b/run"))]
    return ledger.union_batches(*[df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts])


@query("""select strategy_id, n, months, years, round(depth, 6) as depth, trough, round(weights, 6) as weights, round(log_total, 6) as log_total from (select strategy_id, count(*) as n, count(distinct date_trunc('month', date)) as months, count(distinct date_trunc('year', date)) as years, least(min(drawdown), 0) as depth, arg_min(date, (drawdown, date)) as trough, ln(arg_max(equity, pos)) as log_total from v_day group by 1)
  join (select strategy_id, sum(w) as weights from (select strategy_id, symbol, avg(effective) as w from v_weight where pos > 0 group by all) group by 1) using (strategy_id)""", 6)
def strategy_reports(s, d):
    """A document per strategy, written as JSON and read back."""
    root = shared_folder(s, "reports")
    daily = portfolio.backtest_daily(v.weekly_prices(s, d), v.strategies(s), guard=False)
    made = portfolio.strategy_reports(daily, portfolio.account_weights(v.weekly_prices(s, d), v.strategies(s)), 52.0)
    readers.save_reports(made, root)
    read = s.read.schema(made.schema).json(root)
    total = F.aggregate("average_weights", F.lit(0.0), lambda a, x: a + x["weight"])
    return read.select("strategy_id", F.col("summary.n").alias("n"), F.size("monthly").cast("long").alias("months"), F.size("annual").cast("long").alias("years"), "drawdown.depth", "drawdown.trough", total.alias("weights"), F.log("summary.ending").alias("log_total"))


@query("""with sig as (select series_id, month_end, idea, x as signal from (select series_id, month_end, value - avg(value) over w as mean6, value - lag(value, 3) over (partition by series_id order by month_end) as diff3, count(value) over w as k from v_panel where value is not null window w as (partition by series_id order by month_end rows 5 preceding)) unpivot (x for idea in (mean6, diff3)) where idea = 'diff3' or k = 6)
  select series_id, idea, horizon, count(*) as n, round(corr(signal, y), 6) as ic from sig join (select month_end, horizon, avg(fwd_return) as y from v_fwd group by all) using (month_end) where signal is not null and y is not null group by all""")
def pandas_ideas(s, d):
    """Two pandas signals over every series at once."""
    panel = asof.asof_month_end(v.observations(s, d)).where("value is not null")
    ideas = {"mean6": lambda f: f["value"] - f["value"].rolling(6).mean(), "diff3": lambda f: f["value"].diff(3)}
    return research.ideas_in_pandas(panel, "series_id", ["value"], ideas, research.cross_section(research.forward_returns(v.monthly_prices(s, d))))


# Records by kind of fault, by day of the month of the release; the rest in two readings a day apart.
@query(f"""with base as (select series_id, observation_period, available_date, availability_basis, vintage, landed, value, m from v_watch where landed <= date '{CUTOFF}' qualify row_number() over (partition by series_id, observation_period order by vintage desc nulls last, landed desc) = 1)
  select series_id, observation_period, case when m = 5 then 'unit_missing' when m = 8 then 'source_url' when m = 11 then 'value' when m = 6 then 'historical_revision' else 'new_release' end as outcome, case when m in (5, 8, 11) then null when m = 6 then date '2002-01-01' when availability_basis = 'official_release' then available_date end as vintage,
    case when m = 6 and availability_basis = 'official_release' then available_date end as old_vintage from base union all select series_id, observation_period, 'new_release', case when availability_basis = 'official_release' then available_date end, null from base where m = 6""")
def appended_batch(s, d):
    """A batch of records into an empty ledger: faulty ones apart with their rule, events with both vintages; June comes twice, the later reading first."""
    rows = asof.latest(v.watch(s, d).where(F.col("retrieved_at").cast("date") <= CUTOFF), ["series_id", "observation_period"], "vintage", "retrieved_at")
    m = F.month("observation_date")
    faulty = rows.withColumn("unit", F.when(m != 5, F.col("unit"))).withColumn("source_value_url", F.when(m == 8, "ftp://x").otherwise(F.col("source_value_url"))).withColumn("value", F.when(m == 11, float("nan")).otherwise(F.col("value")))
    june = faulty.where("month(observation_date) = 6").withColumn("value", F.col("value") - 5).withColumn("retrieved_at", F.expr("retrieved_at + interval 1 day"))
    _, events, bad = ledger.append_batch(june.unionByName(faulty), rows.limit(0), "2002-01-01")
    none = F.lit(None).cast("date")
    broken = bad.select("series_id", "observation_period", F.array_join("rules", ",").alias("outcome"), none.alias("vintage"), none.alias("old_vintage"))
    return events.select("series_id", "observation_period", F.col("event").alias("outcome"), F.col("new_vintage").alias("vintage"), "old_vintage").unionByName(broken)


# Quarters in dollars, with every fourth filer's also as figures of the year to date; one in three files whole years in another unit beside them.
_QUARTERS = """q0 as (select l_suppkey as company_id, ['OperatingIncomeLoss', 'IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest', 'IncomeTaxExpenseBenefit', 'DepreciationAmortizationAndAccretionNet', 'PaymentsToAcquirePropertyPlantAndEquipment'][t] as metric, t,
    cast(date_trunc('quarter', l_shipdate) as date) as period_start, cast(last_day(date_trunc('quarter', l_shipdate) + interval 2 month) as date) as period_end, round(sum(l_extendedprice), 2) as value from lineitem, (select unnest([1, 2, 3, 4, 5]) as t) where l_partkey % 5 <> t % 2 + 3 group by all)"""


@query(f"""with {_QUARTERS}, ttm as (select company_id, t, period_end, sum(value) over w as value, count(*) over w as n from q0 window w as (partition by company_id, t order by period_end range between interval 290 day preceding and current row)),
  wide as (select company_id, period_end, max(value) filter (t = 1) as ebit, max(value) filter (t = 2) as pretax, max(value) filter (t = 3) as tax, max(value) filter (t = 4) as da, max(value) filter (t = 5) as capex from ttm where n = 4 and period_end + 45 <= date '{CUTOFF}' group by all)
  select s_suppkey as company_id, max(period_end) as period_end, round(arg_max(ebit * (1 - tax / pretax) + da - capex, period_end), 2) as fcff from supplier left join (select * from wide where ebit is not null and pretax is not null and tax is not null and da is not null and capex is not null) on company_id = s_suppkey and s_suppkey % 7 <> 0 group by 1""", 2)
def company_values_by_quarter(s, d):
    """Cash flows of trailing years from quarters and from figures of the year to date; whole years in a second unit and types outside of the table don't disturb."""
    start, part, price = F.date_trunc("quarter", "l_shipdate").cast("date"), F.col("l_partkey") % 5, F.col("l_extendedprice")
    # Five tags have two sums: those in odd places leave out the parts of one remainder, those in even places of another.
    tags = [valuation.TAGS[c] for c in valuation.REQUIRED]
    sides = [(part != left, [F.lit(t) for t in tags[place::2]]) for place, left in ((0, 4), (1, 3))]
    sums = [[F.sum(F.when(has, price)).alias(f"sum{i}"), F.count(F.when(has, 1)).alias(f"n{i}")] for i, (has, _) in enumerate(sides)]
    quarters = v.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("company_id"), start.alias("period_start")).agg(*sums[0], *sums[1]).repartition("company_id")
    side = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.round(f"sum{i}", 2).alias("value"), F.col(f"n{i}").alias("n"), F.array(*metrics).alias("metrics")) for i, (_, metrics) in enumerate(sides)]))
    rows = quarters.select("company_id", "period_start", F.last_day(F.add_months("period_start", 2)).alias("period_end"), side.alias("s")).select("company_id", "period_start", "period_end", "s.*").where("n > 0")
    w = Window.partitionBy("company_id", "side", F.year("period_end")).orderBy("period_end")
    whole = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 4
    # Figures of the year to date stand for quarters where all four of a year are there.
    ytd = rows.withColumn("whole", whole).withColumn("sum", F.sum("value").over(w)).withColumn("first", F.trunc("period_end", "year"))
    cumulative = (F.col("company_id") % 4 == 0) & F.col("whole")
    rows = ytd.select("company_id", "metrics", F.when(cumulative, F.col("first")).otherwise(F.col("period_start")).alias("period_start"), "period_end", F.when(cumulative, F.round("sum", 2)).otherwise(F.col("value")).alias("value"))
    own = F.struct("period_start", "value", F.lit("USD").alias("unit"))
    year = F.struct(F.trunc("period_end", "year").alias("period_start"), (F.col("value") * 7).alias("value"), F.lit("CNY").alias("unit"))
    filed = rows.select("company_id", "period_end", "metrics", F.explode(F.array_compact(F.array(own, F.when((F.month("period_end") == 12) & (F.col("company_id") % 3 == 0), year)))).alias("f"))
    rows = filed.select("company_id", F.explode("metrics").alias("metric"), "f.unit", "f.period_start", "period_end", "f.value")
    filings = rows.withColumn("filed", F.date_add("period_end", 45)).withColumn("ordinal", F.lit(0))
    n = F.col("s_suppkey")
    companies = v.table(s, d, "supplier").select(n.alias("company_id"), F.when(n % 7 == 0, "bank").when(n % 2 == 0, "odd kind").otherwise("general").alias("business_type"), F.lit(1000.0).alias("shares"), F.lit(200.0).alias("price"))
    return valuation.value_companies(filings, companies, CUTOFF).select("company_id", "period_end", "fcff")


@query("select 'company_id' as rule, n_name as company_id, case when n_nationkey % 4 = 0 then ' ' else 'm' || n_nationkey end as metric from nation where n_nationkey % 3 = 0 union all select 'metric', case when n_nationkey % 3 = 0 then n_name else 'N:' || n_name end, ' ' from nation where n_nationkey % 4 = 0 union all select 'available_before_period_end', case when n_nationkey % 3 = 0 then n_name else 'N:' || n_name end, case when n_nationkey % 4 = 0 then ' ' else 'm' || n_nationkey end from nation where n_nationkey % 5 = 0")
def fact_violations(s, d):
    n = F.col("n_nationkey")
    rows = v.table(s, d, "nation").select(F.when(n % 3 == 0, F.col("n_name")).otherwise(F.concat(F.lit("N:"), "n_name")).alias("company_id"), F.when(n % 4 == 0, " ").otherwise(F.concat(F.lit("m"), n.cast("string"))).alias("metric"), F.to_date(F.lit("2020-12-31")).alias("period_end"), F.when(n % 5 == 0, F.to_date(F.lit("2020-12-30"))).otherwise(F.to_date(F.lit("2021-02-01"))).alias("available_date"))
    return valuation.fact_violations(rows).drop("period_end")


@query("select 'weight' as rule, p_type as factor, cast(p_partkey as varchar) as component from part where p_partkey % 10 = 0 union all select 'minimum', p_type, null from part group by p_type having count(*) % 2 = 1 union all select 'no_weight', p_type, null from part group by p_type having sum(case when p_partkey % 10 = 0 then -1 else p_partkey % 10 end) <= 0")
def config_violations(s, d):
    """Configurations of parts: every tenth weight is negative, and minimums of half the types exceed their components."""
    n, w = F.col("p_partkey"), Window.partitionBy("p_type")
    rows = v.table(s, d, "part").select(F.col("p_type").alias("factor"), n.cast("string").alias("component"), F.when(n % 10 == 0, -1.0).otherwise((n % 10).cast("double")).alias("weight"), (F.count("*").over(w) + F.count("*").over(w) % 2).alias("min_components"))
    return factors.config_violations(rows)


# Functions of text over titles and cells made from the given tables.
@query(f"with {_RELEASES} select page_id, case when k <> 5 then case k when 1 then 'retail_sales' when 6 then 'money' else series end end as kind, cast(last_day(make_date(y, m, 1)) as date) as period, case k when 5 then null else case page_id % 3 when 1 then -1 when 2 then 0 else 1 end * (page_id % 1000 + 1000 + (page_id % 10) / 10.0) end as value from rel", 4)
def release_titles(s, d):
    """Class, period and signed percentage of titles; numbers have thousands separators."""
    pages = harvest.release_pages(release_pages(s, d)).withColumn("page_id", F.regexp_extract("url", r"(\d+)$", 1).cast("long"))
    word = F.get(F.array(F.lit("上升"), F.lit("回落"), F.lit("持平")), F.pmod("page_id", F.lit(3)).cast("int"))
    text = F.concat("title", F.lit("比上年"), word, F.lit(" "), F.format_number(F.pmod("page_id", F.lit(1000)) + 1000 + F.pmod("page_id", F.lit(10)) / 10, 1), F.lit(" %"))
    kind = harvest.release_class(F.col("title"))
    return pages.select("page_id", kind.alias("kind"), harvest.release_period(F.col("title")).alias("period"), F.when(kind.isNotNull(), harvest.signed_percent(text, "比上年")).alias("value"))


@query("""select o_orderkey, case when o_orderkey % 5 = 4 then null else cast(cast(o_orderdate as date) + interval 10 year as date) end as found, case when o_orderkey % 4 <> 0 then cast(o_orderdate as date) end as iso, case when o_orderkey % 4 = 0 then null when o_orderkey % 3 = 0 then cast(o_orderdate as date) else cast(o_orderdate as date) - 1 end as utc_day,
  regexp_replace(o_orderpriority, '[^A-Za-z0-9._-]', '_', 'g') as name, case when o_orderkey % 7 > 1 then o_totalprice end as price from orders""")
def text_functions(s, d):
    """Dates within text, dates and instants of cells with words for none, names of files, and numbers that JSON has."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    text = F.when(k % 5 == 4, "x 2024-13-45 y").otherwise(F.concat(F.lit("于"), F.date_format(F.add_months(day, 120), "yyyy年M月d日发布, 2019-01-01")))
    cell = F.when(k % 4 == 0, F.get(F.array(F.lit("NaT"), F.lit(" unknown"), F.lit("")), ((k / 4) % 3).cast("int"))).when(k % 3 == 0, F.concat(day.cast("string"), F.lit("T09:00:00+08:00"))).otherwise(F.concat(day.cast("string"), F.lit(" 07:59:59")))
    rows = v.table(s, d, "orders").select(k, harvest.first_date(text).alias("found"), ledger.iso_date(cell).alias("iso"), ledger.shanghai_timestamp(cell).alias("at"), safe_name(F.col("o_orderpriority")).alias("name"), F.when(k % 7 == 0, float("inf")).when(k % 7 == 1, float("nan")).otherwise(F.col("o_totalprice").cast("double")).alias("price"))
    return portfolio.finite_or_null(rows).withColumn("utc_day", F.to_utc_timestamp("at", F.current_timezone()).cast("date")).drop("at")


@query(f"with {_RELEASES} select series as series_id, observation_date, case when k % 2 = 0 then make_date(y + 1, 1, cast(1 + page_id % 28 as int)) end as available_date, case when k % 2 = 0 then 'official_release' else 'unknown' end as availability_basis, case when k % 2 = 0 then url else '' end as availability_evidence_url, value from rel where series is not null")
def release_rows(s, d):
    """Observations of release pages: official where the page is dated."""
    return harvest.harvest(release_pages(s, d))[0].select("series_id", "observation_date", "available_date", "availability_basis", "availability_evidence_url", "value")


@query("select 'error' as level, 'availability_evidence' as \"column\" where false union all select 'warning', unnest(['lag_days', 'odd'])")
def column_report(s, d):
    """Columns that observations have and the contract does not know."""
    return contracts.column_report(v.observations(s, d).withColumn("odd", F.lit(1)))


@query("select s_suppkey as key, case when s_suppkey % 2 = 0 then 'even' end as note, case when s_suppkey % 2 = 1 then s_nationkey end as n from supplier")
def united_batches(s, d):
    """Records of two sources with different columns."""
    rows = v.table(s, d, "supplier").withColumnRenamed("s_suppkey", "key")
    return ledger.union_batches(rows.where("key % 2 = 0").select("key", F.lit("even").alias("note")), rows.where("key % 2 = 1").select(F.col("s_nationkey").alias("n"), "key"))


@query("select 'error' as level, case when p_partkey % 4 = 0 then 'frequency_missing' else 'kind' end as finding, cast(p_partkey as varchar) as keys from part where p_partkey % 4 = 0 or p_partkey % 4 = 1 union all select 'warning', 'long_daily_lag', cast(p_partkey as varchar) from part where p_partkey % 4 = 2")
def catalog_audit(s, d):
    """A catalog written as a configuration file, read, and audited."""
    n = F.col("p_partkey")
    entry = F.struct(F.lit("csv").alias("provider"), n.cast("string").alias("symbol"), F.when(n % 4 == 1, "odd").otherwise("macro").alias("kind"), F.when(n % 4 == 2, "daily").when(n % 4 != 0, "weekly").alias("frequency"), F.lit(5).alias("release_lag_days"))
    root = shared_folder(s, "catalog")
    whole = v.table(s, d, "part").agg(F.map_from_entries(F.collect_list(F.struct(n.cast("string"), entry))).alias("series"))  # a configuration is one document
    whole.select(F.to_json(F.struct("series")).alias("value")).coalesce(1).write.text(root)
    return catalog.catalog_audit(catalog.catalog_frame(s, catalog.parsed(catalog.read_text(s, root)))).withColumn("keys", F.array_join("keys", ","))
