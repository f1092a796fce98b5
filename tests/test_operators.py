"""Hand-calculated cases, look-ahead checks, and the portfolio against a loop over days."""

import datetime as dt
import html
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from almanac.functions.columns import regime
from almanac.operators import asof, contracts, factors, harvest, ledger, portfolio, research, valuation
from almanac.plans import views
from almanac.streaming.ledger import stream_ledger

D = dt.date


def test_asof_follows_release_order(spark):
    obs = spark.createDataFrame([("a", D(2025, 1, 10), D(2025, 1, 15), 100.0), ("a", D(2025, 2, 10), D(2025, 2, 14), 110.0), ("a", D(2025, 3, 10), D(2025, 3, 14), 120.0)], "series_id string, observation_date date, available_date date, value double")
    got = {r.month_end: r.value for r in asof.asof_month_end(obs, "2024-12-01", "2025-03-31").collect()}
    assert got == {D(2024, 12, 31): None, D(2025, 1, 31): 100.0, D(2025, 2, 28): 110.0, D(2025, 3, 31): 120.0}


def test_zscore_does_not_look_ahead(spark):
    def scores(values):
        rows = [("f", "c", "s", D(2000, 1 + i, 1), 1.0, float(x)) for i, x in enumerate(values)]
        df = spark.createDataFrame(rows, "factor string, component string, series_id string, month_end date, weight double, x double")
        return [r.z for r in factors.expanding_zscore(df, 3).orderBy("month_end").collect()]

    assert scores([1, 2, 3, 4, 5, 6]) == scores([1, 2, 3, 4, 5, 6, 1000, -1000])[:6]


def test_regime_quadrants(spark):
    df = spark.createDataFrame([(1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0), (None, 0.0)], "g double, i double")
    assert [r.r for r in df.select(regime(F.col("g"), F.col("i")).alias("r")).collect()] == ["goldilocks", "reflation", "stagflation", "recession", None]


def test_forward_returns(spark):
    prices = spark.createDataFrame([("a", D(2020, m, 28), p) for m, p in enumerate((100.0, 110.0, 121.0, 121.0, 133.1), 1)], "asset string, month_end date, price double")
    got = {(r.month_end.month, r.horizon): r.fwd_return for r in research.forward_returns(prices).collect()}
    assert got[1, 1] == pytest.approx(0.10) and got[1, 3] == pytest.approx(0.21) and got[5, 1] is None


def test_vintages_replay(spark):
    rows = [("s", D(2024, 1, 31), D(2024, 2, 8), D(2024, 2, 8), 0.8), ("s", D(2024, 1, 31), D(2025, 1, 15), D(2024, 2, 8), 1.0)]
    df = spark.createDataFrame(rows, "series_id string, observation_date date, vintage date, available_date date, value double")
    got = {r.month_end: r.value for r in asof.vintage_panel(df, "2024-01-01", "2025-01-31").collect()}
    assert got[D(2024, 12, 31)] == 0.8 and got[D(2025, 1, 31)] == 1.0 and D(2024, 1, 31) not in got
    assert asof.vintage_asof(df, "2023-01-01").count() == 0


def test_restatement_is_seen_only_later(spark):
    rows = [("c", "m", "USD", D(2017, 9, 30), D(2017, 11, 3), 63.598, 0), ("c", "m", "USD", D(2017, 9, 30), D(2018, 11, 5), 64.225, 1), ("c", "m", "USD", D(2017, 9, 30), D(2017, 9, 1), 1.0, 2)]
    df = spark.createDataFrame(rows, "company_id string, metric string, unit string, period_end date, filed date, value double, ordinal int")
    assert [valuation.pit_facts(df, d).first().value for d in ("2018-01-01", "2019-01-01")] == [63.598, 64.225]


def test_contract_violations(spark):
    rows = [("s", D(2024, 11, 30), D(2024, 11, 1), "official_release", 1.0), ("s", D(2024, 12, 31), None, "fixed_lag", None), ("s", D(2024, 12, 31), D(2025, 1, 2), "unknown", 1.0), ("s", D(2025, 1, 31), D(2025, 2, 2), "odd", 1.0)]
    df = spark.createDataFrame(rows, "series_id string, observation_date date, available_date date, availability_basis string, value double").withColumn("availability_evidence_url", F.lit("https://example.org/e"))
    assert sorted(r.rule for r in contracts.violations(df).collect()) == ["bad_basis", "basis_without_date", "duplicate_date", "look_ahead", "missing_value", "unknown_with_date"]
    with pytest.raises(ValueError):
        contracts.require(contracts.violations(df))


def looped(days, prices, strategy, lag=1):
    """Equity by session: holdings drift, fills trade at the close and pay a fee."""
    unit = {"monthly": lambda x: (x.year, x.month), "quarterly": lambda x: (x.year, (x.month - 1) // 3), "annual": lambda x: x.year}[strategy.frequency]
    signals = {0} | {i - 1 for i in range(1, len(days)) if unit(days[i]) != unit(days[i - 1])}
    cash, held, out = 1.0, {}, []
    for i, day in enumerate(days):
        equity = cash + sum(n * prices[s, day] for s, n in held.items())
        if i - lag in signals:
            drift = {s: held.get(s, 0) * prices[s, day] / equity for s in strategy.weights}
            turnover = sum(abs(w - drift[s]) for s, w in strategy.weights.items())
            equity *= 1 - turnover * strategy.cost
            held = {s: w * equity / prices[s, day] for s, w in strategy.weights.items()}
            cash = equity * (1 - sum(strategy.weights.values()))
        out.append(equity)
    return out


def test_backtest_equals_a_loop_over_days(spark):
    prices, strategies = views.weekly_prices(spark, "/root/testdata/sf0.001"), views.strategies(spark)
    full = prices.groupBy("date").count().where("count = 6").select("date")
    prices = prices.join(full, "date").cache()
    table = {(r.symbol, r.date): r.price for r in prices.collect()}
    days = sorted({d for _, d in table})
    got = portfolio.backtest_daily(prices, strategies).orderBy("date").collect()
    for s in strategies.collect():
        mine = [r.equity for r in got if r.strategy_id == s.strategy_id]
        assert mine == pytest.approx(looped(days, table, s), rel=1e-9)


def test_xirr(spark):
    rows = [("a", D(2020, 1, 1), -100.0), ("a", D(2024, 1, 1), 146.41), ("b", D(2020, 1, 1), 5.0), ("up", D(2020, 1, 1), -1.0), ("up", D(2021, 1, 1), 50.0), ("loan", D(2020, 1, 1), 100.0), ("loan", D(2021, 1, 1), -110.0)]
    got = {r.account: r.xirr for r in portfolio.xirr(spark.createDataFrame(rows, "account string, date date, amount double")).collect()}
    assert got["a"] == pytest.approx(0.10, abs=1e-3) and got["b"] is None
    assert got["up"] == pytest.approx(50 ** (365.25 / 366) - 1, rel=1e-6) and got["loan"] == pytest.approx(0.10, abs=1e-3)


def test_reverse_dcf_inverts_dcf(spark):
    df = spark.createDataFrame([(100.0, [0.08] * 5, 0.1, 0.03, 50.0, 10.0)], "fcf double, growth_rates array<double>, discount double, terminal double, net_debt double, shares double")
    priced = valuation.dcf(df).withColumnRenamed("value_per_share", "price")
    assert valuation.reverse_dcf(priced).first().implied_growth == pytest.approx(0.08, abs=1e-6)


def test_flows(spark):
    df = spark.createDataFrame([("h", D(2024, 1, 31), 100.0, 0.0, 0.0), ("h", D(2024, 2, 29), 110.0, 8.0, 0.0)], "holder string, date date, stock double, valuation double, other double")
    assert valuation.stock_flow(df).first().flow == 2.0


def test_release_text(spark):
    df = spark.createDataFrame([("2020年11月份增长7.0%", "居民消费价格同比下降0.7%。核心CPI同比上涨0.3%"), ("2020年1—2月份", "无"), ("2024年社会融资规模存量统计数据报告", "持平"), ("2024年工业企业利润", "减少1,234.5%"), ("2024年前三季度", "回落 0.2 %"), ("2024年1 — 2月份", "同比持平0.0%")], "title string, body string")
    got = df.select(harvest.release_period(F.col("title")).alias("p"), harvest.signed_percent(F.col("body"), "居民消费价格同比").alias("v"), harvest.first_date(F.lit("发布 2020-12-15 10:00")).alias("d")).collect()
    assert [r.p for r in got] == [D(2020, 11, 30), D(2020, 2, 29), D(2024, 12, 31), None, D(2024, 9, 30), D(2024, 2, 29)]
    assert [r.v for r in got] == [-0.7, None, None, None, None, None] and got[0].d == D(2020, 12, 15)
    assert [r.v for r in df.select(harvest.signed_percent(F.col("body")).alias("v")).collect()] == [-0.7, None, None, -1234.5, -0.2, 0.0]


PAGE = """<html><head><meta name="ArticleTitle" content="{title}"><meta name="PubDate" content="{date}"><title>x</title></head><body><h1>other</h1><div class="nav">menu</div><div id="zoom"><p>{body}</p></div><div class="foot">2019-01-01</div></body></html>"""


def test_harvest_of_release_pages(spark):
    """Literal pages: dated and undated, joint periods, core prices, money, an annual retail release, one without its value, and one that is no release."""
    pages = [
        ("a", "2020年11月份规模以上工业增加值增长7.0%", "2020-12-15 10:00", "11月份，规模以上工业增加值同比实际增长7.0%。"),
        ("b", "2024年3月份居民消费价格同比下降0.7%", "2024/04/11", "居民消费价格同比下降0.7%，核心CPI同比上涨0.3%。"),
        ("c", "2024年1—2月份社会消费品零售总额增长5.5%", "", "社会消费品零售总额81307亿元，同比增长5.5%。"),
        ("d", "2024年2月金融统计数据报告", "2024-03-15", "广义货币(M2)余额299.56万亿元，同比增长8.7%。狭义货币(M1)余额66.59万亿元，同比下降1.2%。"),
        ("e", "2023年社会融资规模存量统计数据报告", "2024-01-12", "2023年末社会融资规模存量为378.09万亿元，同比增长9.5%。"),
        ("f", "2023年社会消费品零售总额增长7.2%", "2024-01-17", "全年增长7.2%。12 月份，社会消费品零售总额43550亿元，同比增长7.4%。"),
        ("g", "2024年5月中国采购经理指数运行情况", "2024-05-31", "新订单指数为49.6%，比上月回落。"),
        ("h", "2024年6月份工业生产者出厂价格", "2024-07-10", "没有数字。"),
        ("i", "2024年工业企业利润", "2024-01-01", "利润增长3%。"),
        ("j", "2024年4月份固定资产投资增长&nbsp;4.2%", "2024-02-30", "1—4月份，全国固定资产投资143401亿元，同比增长4.2%。"),
    ]
    df = spark.createDataFrame([(u, PAGE.format(title=t, date=d, body=b)) for u, t, d, b in pages], "url string, html string")
    rows, unparsed, coverage = harvest.harvest(df)
    got = {(r.source_value_url, r.series_id): (r.observation_date, r.observation_period, r.available_date, r.availability_basis, r.value) for r in rows.collect()}
    official, unknown = "official_release", "unknown"
    assert got == {
        ("a", "industrial_production"): (D(2020, 11, 30), "2020-11", D(2020, 12, 15), official, 7.0),
        ("b", "cpi"): (D(2024, 3, 31), "2024-03", D(2024, 4, 11), official, -0.7),
        ("b", "core_cpi"): (D(2024, 3, 31), "2024-03", D(2024, 4, 11), official, 0.3),
        ("c", "retail_sales_ytd"): (D(2024, 2, 29), "2024-01/2024-02", None, unknown, 5.5),
        ("d", "m2"): (D(2024, 2, 29), "2024-02", D(2024, 3, 15), official, 8.7),
        ("d", "m1"): (D(2024, 2, 29), "2024-02", D(2024, 3, 15), official, -1.2),
        ("e", "tsf_stock"): (D(2023, 12, 31), "2023-12", D(2024, 1, 12), official, 9.5),
        ("f", "retail_sales"): (D(2023, 12, 31), "2023-12", D(2024, 1, 17), official, 7.4),
        ("g", "pmi_new_orders"): (D(2024, 5, 31), "2024-05", D(2024, 5, 31), official, 49.6),
        ("j", "fixed_asset_investment"): (D(2024, 4, 30), "2024-04", None, unknown, 4.2),
    }
    assert [(r.series, r.url) for r in unparsed.collect()] == [("ppi", "h")]
    assert {r.series_id: (r.observations, r.dated, r.undated) for r in coverage.collect()}["retail_sales_ytd"] == (1, 0, 1)
    assert not {r.rule for r in contracts.violations(rows).collect()} - {"source_url_not_http", "evidence_not_http"}


def test_links_are_resolved_and_filtered(spark):
    links = [("https://h.cn/sj/zxfb/index.html", "./2024/t1.html", "2024年3月份"), ("https://h.cn/sj/zxfb/index.html", "/sj/zxfb/2024/t1.html", "2024年3月份更长"), ("https://h.cn/sj/zxfb/", "../other/t2.html", "2024年"), ("https://h.cn/sj/zxfb/", "https://x.cn/sj/zxfb/t3.html", "2019年"), ("https://h.cn/sj/zxfb/", "//y.cn/sj/zxfb/t4.html", "2023年1月"), ("https://h.cn/sj/zxfb/", "t5.html", " ")]
    df = spark.createDataFrame(links, "base string, href string, title string")
    got = {r.url: r.title for r in harvest.candidate_links(df, "/sj/zxfb", 2023, 2024).collect()}
    assert got == {"https://h.cn/sj/zxfb/2024/t1.html": "2024年3月份更长", "https://y.cn/sj/zxfb/t4.html": "2023年1月"}
    assert {r.url for r in harvest.candidate_links(df, "/sj").collect()} == {*got, "https://h.cn/sj/other/t2.html", "https://x.cn/sj/zxfb/t3.html"}


def test_bars(spark):
    rows = [("02/26/2026", "20", "21", "19", "20.5"), ("2026-02-27", "20", "21", "19", "19.5"), ("3/2/2026", "18", "17", "18", "18.5"), ("02/27/2026", "1", "1", "1", "1"), ("13/45/2026", "x", "1", "1", "-1")]
    bars, wrong = harvest.validate_ohlc(spark.createDataFrame(rows, "DATE string, OPEN string, HIGH string, LOW string, CLOSE string"), 6)
    assert sorted((r.rule, r.at) for r in wrong.collect()) == [("bad_date", "13/45/2026"), ("bad_price", "13/45/2026"), ("duplicate_date", "2026-02-27"), ("high_below_low", "3/2/2026"), ("too_few_rows", "5")]
    closes = harvest.completed_month_close(bars.where("close > 10").withColumn("symbol", F.lit("v")))
    assert [(r.observation_date, float(r.value), r.available_date) for r in harvest.estimated_closes(closes).collect()] == [(D(2026, 2, 27), 19.5, D(2026, 2, 28))]
    with pytest.raises(ValueError):
        harvest.validate_ohlc(spark.createDataFrame([("a",)], "DATE string"))


SCHEMA = "series_id string, observation_date date, vintage date, available_date date, value double, source_url string"


def test_ledger_stream_appends_once(spark, tmp_path):
    rows = [("s", D(2024, 1, 31), D(2024, 2, 8), D(2024, 2, 8), 0.8, "https://example.org/a"), (None, D(2024, 1, 31), None, None, 1.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    paths = [str(tmp_path / p) for p in ("in", "ledger", "bad")]
    for n in range(2):  # the same rows landed twice
        df.write.mode("append").parquet(paths[0])
        stream_ledger(spark, paths[0], SCHEMA, paths[1], paths[2], str(tmp_path / f"checkpoint{n}")).awaitTermination(120)
    assert spark.read.parquet(paths[1]).count() == 1
    changed = df.where("series_id is not null").withColumn("value", F.lit(1.0))
    assert ledger.ledger_changes(changed, spark.read.parquet(paths[1])).first().event == "historical_revision"


def test_dates_of_records(spark):
    rows = [("2024-01-05",), ("unknown",), (" NaT ",), ("",), (None,), ("2024-01-05T10:00:00+08:00",), ("2024-01-05 10:00:00",), ("odd",)]
    got = spark.createDataFrame(rows, "t string").select("t", ledger.iso_date(F.col("t")).alias("d"), F.date_format(ledger.shanghai_timestamp(F.col("t")), "yyyy-MM-dd HH:mm").alias("at")).collect()
    assert {r.t: r.d for r in got} == {"2024-01-05": D(2024, 1, 5), "unknown": None, " NaT ": None, "": None, None: None, "2024-01-05T10:00:00+08:00": D(2024, 1, 5), "2024-01-05 10:00:00": D(2024, 1, 5), "odd": None}
    at = {r.t: r["at"] for r in got}
    assert at["2024-01-05"] == "2024-01-04 16:00" and at["2024-01-05T10:00:00+08:00"] == at["2024-01-05 10:00:00"] == "2024-01-05 02:00" and at["odd"] is None


def test_names_orders_and_unions(spark):
    from almanac.functions.columns import ordered, safe_name

    df = spark.createDataFrame([("^VIX/x 1", 2), ("é-_.9", 1)], "n string, k int")
    assert [r.s for r in ordered(df.select("k", safe_name(F.col("n")).alias("s")), "k").collect()] == ["é-_.9", "_VIX_x_1"]
    assert ledger.union_batches(df, df.select("n"), df.withColumn("more", F.lit(1))).columns == ["n", "k", "more"]


def test_transforms_look_back_as_told_and_refuse_unknown_ones(spark):
    months = spark.sql("select explode(sequence(date'2020-01-31', date'2022-12-31', interval 1 month)) as m").select(F.last_day("m").alias("month_end"))
    panel = months.select(F.lit("s").alias("series_id"), "month_end", (F.months_between("month_end", F.lit("2019-12-31")) + 1).alias("value"))
    schema = "factor string, component string, source string, transform string, periods int, weight double, sign int"
    config = [("f", "a", "s", "yoy", 6, 1.0, 1), ("f", "b", "s", "yoy", None, 1.0, 1), ("f", "c", "s", "distance_from_50", None, 1.0, -1)]
    got = {(r.component, r.month_end): r.x for r in factors.transforms(panel, spark.createDataFrame(config, schema)).collect()}
    assert got["a", D(2020, 7, 31)] == pytest.approx(8 / 2 - 1) and got["b", D(2020, 12, 31)] is None and got["b", D(2021, 1, 31)] == pytest.approx(14 / 2 - 1)
    assert got["c", D(2020, 1, 31)] == 48.0
    with pytest.raises(Exception, match="unknown transform"):
        factors.transforms(panel, spark.createDataFrame([("f", "a", "s", "odd", 1, 1.0, 1)], schema)).collect()


def test_composite_minimum_and_weights(spark):
    rows = [("f", c, D(2024, m, 28), w, 2, z) for c, w, zs in (("a", 1.0, (1.0, 1.0)), ("b", 1.0, (3.0, None)), ("c", 2.0, (5.0, 5.0))) for m, z in zip((1, 2), zs, strict=True)]
    df = spark.createDataFrame(rows, "factor string, component string, month_end date, weight double, min_components int, z double")
    assert {r.month_end.month: r.score for r in factors.composite(df).collect()} == pytest.approx({1: 3.5, 2: 11 / 3})
    assert {r.month_end.month: r.score for r in factors.composite(df.withColumn("min_components", F.lit(None).cast("int"))).collect()} == {1: pytest.approx(3.5), 2: None}


def test_contract_of_joint_periods(spark):
    """A period released inside its month is no look-ahead, one before its month is; a required date that no row has is one violation."""
    rows = [("s", D(2025, 1, 31), D(2025, 1, 27), "2025-01"), ("t", D(2025, 1, 31), D(2024, 12, 31), "2025-01"), ("u", D(2025, 2, 28), D(2025, 2, 1), "2025-01/2025-02")]
    df = spark.createDataFrame(rows, "series_id string, observation_date date, available_date date, observation_period string").withColumn("value", F.lit(1.0)).withColumn("availability_basis", F.lit("unverified"))
    assert [(r.rule, r.series_id) for r in contracts.violations(df).collect()] == [("look_ahead", "t")]
    undated = df.withColumn("available_date", F.lit(None).cast("date")).withColumn("availability_basis", F.lit("unknown"))
    assert {r.rule for r in contracts.violations(undated, require_available_date=True).collect()} == {"no_available_date"}
    assert [tuple(r) for r in contracts.column_report(df.drop("value").withColumn("odd", F.lit(1))).collect()] == [("error", "value"), ("warning", "odd")]
    with pytest.raises(ValueError):
        contracts.normalize_observations(df, "official_release")


def test_ledger_changes_chain_inside_a_batch(spark):
    """The same row twice is new once; then a date, an address and a value change in turn."""
    schema = "series_id string, observation_period string, observation_date date, available_date date, availability_basis string, value double, source_value_url string, vintage date, retrieved_at timestamp, arrival int"
    base = ("s", "2024-01", D(2024, 1, 31), D(2024, 2, 8), "official_release", 0.8, "https://a", None, None)
    rows = [(*base, 1), (*base, 2), (*base[:3], D(2024, 2, 9), *base[4:], 3), (*base[:3], D(2024, 2, 9), *base[4:6], "https://b", None, None, 4), (*base[:3], D(2024, 2, 9), base[4], 1.0, "https://b", None, None, 5)]
    batch = spark.createDataFrame(rows, schema).withColumn("retrieved_at", F.expr("timestamp'2024-03-01' + make_interval(0, 0, 0, 0, arrival)"))
    stored = batch.drop("arrival").limit(0)
    got = ledger.ledger_changes(batch, stored, "2024-03-01").collect()
    assert sorted((r.event, str(r.vintage)) for r in got) == [("historical_revision", "2024-03-01"), ("new_release", "2024-02-08"), ("provenance_update", "2024-03-01"), ("provenance_update", "2024-03-01"), ("unchanged", "None")]
    kept = ledger.append_changes(batch, stored, "2024-03-01")
    assert kept.count() == 4 and ledger.append_changes(batch.where("arrival = 5"), kept, "2024-03-02").count() == 0
    assert ledger.change_events(ledger.ledger_changes(batch, stored, "2024-03-01")).where("event = 'historical_revision'").first().old_value == 0.8


ADDRESSES = ["?p=2", "x.html", "./x", "../x", "../../../../../x.html", "/c/../d.html", "//k.cn/../y", "http://k.cn/a/../b", "#top", "", "..", ".", "../", "a/./b/../../c", "/", "/..", "mailto:a@b", "x?y=/../z", "javascript:void(0)", "/a//b", "a//b/c", "?#", "./../g/.", "ftp://f/x", "a;b/../c"]


def test_addresses_are_joined_as_by_the_standard_library(spark):
    bases = ["http://h.cn/a/b.html", "http://h.cn/a/b/", "http://h.cn", "https://h.cn/a//b/c?x=1#f", "http://h.cn/a/b/c/d", "mailto:x@y"]
    df = spark.createDataFrame([(b, r) for b in bases for r in ADDRESSES], "b string, r string").repartition(2)
    got = {(x.b, x.r): x.u for x in df.select("b", "r", harvest.resolved(F.col("b"), F.col("r")).alias("u")).collect()}
    assert got == {(b, r): urljoin(b, r) for b, r in got}


def test_character_references(spark):
    texts = ["a&mdash;b", "&#8212;x &#x4e00; &amp;lt; &nbsp;|", "&unknown; & &&lt;", "&copy 2024 &#0; &#55296; &#99999999;", "plain", "&eacute;&NotEqualTilde;&hellip;", "", "R&D; AT&T"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").repartition(2)
    got = {r.t: r.d for r in df.select("t", harvest.decoded(F.col("t")).alias("d")).collect()}
    assert got == {t: html.unescape(t) for t in texts} | {None: None}


NESTED = """<html><head><meta name='ArticleTitle' content="2024年1&mdash;2月份规模以上工业增加值增长7.0%"><meta name="PubDate" content="{meta}"></head><body><div class="nav"><div>x</div></div>
<!-- <div id="zoom">no</div> --><div class="detail-title-des"><p>来源：x</p><div>发布时间：2024/03/18 10:00</div></div><div data-x="a>b" class="z TRS_Editor y"><div><div>规模以上工业增加值</div><div>同比增长6.5%</div></div><div/><p>后</p></div>
<div>外 规模以上工业增加值同比增长9.9%</div><script>var a="<div>";</script><div ID=zoom>第二 <b>块</b>"""


def test_pages_with_nested_blocks(spark):
    """Blocks end where their depth returns; comments, scripts and signs in attributes don't count, and a block without an end runs to the end."""
    rows = [("http://h/1", NESTED.format(meta="2024-03-17")), ("http://h/2", NESTED.format(meta="")), ("http://h/3", "<h1>2024年3月份居民消费价格</h1> 居民消费价格同比下降 0.3%"), ("http://h/4", ""), ("http://h/5", None)]
    rows += [("http://h/6", "<div class='TRS_Editor'>" + "<div>" * 300 + "深" + "</div>" * 300 + "尾</div><div>外</div>"), ("http://h/7", "<div id='zoomed'>a</div><div class=xtrs_editor>b</div>")]
    got = {r.url: r for r in harvest.release_pages(spark.createDataFrame(rows, "url string, html string").repartition(3)).collect()}
    body = "规模以上工业增加值 同比增长6.5% 后 第二 块"
    assert (got["http://h/1"].title, got["http://h/1"].published, got["http://h/1"].body) == ("2024年1—2月份规模以上工业增加值增长7.0%", D(2024, 3, 17), body)
    assert got["http://h/2"].published == D(2024, 3, 18) and (got["http://h/6"].body, got["http://h/7"].body, got["http://h/4"].title) == ("深 尾", "", "")
    values = {r.url: r for r in harvest.page_values(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert (values["http://h/1"].value, values["http://h/1"].observation_period, values["http://h/3"].value) == (6.5, "2024-01/2024-02", -0.3)
    links = harvest.release_links(spark.createDataFrame([("http://h/a/b", "<a href='x.html' title=\"T\"><img src=q></a><A class=k HREF=../y>A <b>B</b>&amp;C</A><a name=z>no</a>")], "url string, html string"))
    assert [tuple(r) for r in links.collect()] == [("http://h/a/b", "x.html", "T"), ("http://h/a/b", "../y", "A B &C")]


def test_investment_of_one_kind_is_not_the_national_one(spark):
    rows = [("u", "2024年1—3月份全国固定资产投资基本情况", "民间固定资产投资增长0.5%。全国固定资产投资（不含农户）同比增长4.5%"), ("v", "2024年1—3月份固定资产投资", "民间固定资产投资增长0.5%")]
    df = spark.createDataFrame([(u, t, b, D(2024, 4, 1)) for u, t, b in rows], "url string, title string, body string, published date")
    assert {r.url: r.value for r in harvest.release_values(df).collect()} == {"u": 4.5, "v": None}


WATCHED = "series_id string, observation_period string, observation_date date, available_date date, availability_basis string, retrieved_at timestamp, value double, unit string, source_value_url string, availability_evidence_url string, vintage date, quality_flags array<string>, source_title string"


def watched(value, at, period="2024-01", **other):
    day = D(2024, int(period[-2:]), 28)
    row = {"series_id": "cn_cpi", "observation_period": period, "observation_date": day, "available_date": day, "availability_basis": "official_release", "retrieved_at": dt.datetime.fromisoformat(f"2024-03-01T{at}"), "value": value, "unit": "percent", "source_value_url": "https://a", "availability_evidence_url": "https://e", "vintage": None, "quality_flags": None, "source_title": "t"} | other
    return tuple(row[f.split()[0]] for f in WATCHED.split(", "))


def test_batches_are_chained_by_time(spark):
    """A later reading of a lower value is the current one; faulty records don't take part; events carry both vintages."""
    rows = [watched(1.0, "09:00"), watched(1.2, "01:00"), watched(1.0, "10:00"), watched(9.9, "11:00", unit=" "), watched(3.0, "02:00", "2024-02", source_title="口径调整"), watched(3.0, "03:00", "2024-02", source_value_url="https://b")]
    batch = spark.createDataFrame(rows, WATCHED)
    kept, events, bad = ledger.append_batch(batch, batch.limit(0), "2024-03-02")
    got = sorted((r.observation_period, r.retrieved_at.hour, r.value, str(r.vintage), r.quality_flags[-1]) for r in kept.collect())
    assert got == [("2024-01", 1, 1.2, "2024-01-28", "release_date_has_official_evidence"), ("2024-01", 9, 1.0, "2024-03-02", "historical_revision"), ("2024-02", 2, 3.0, "2024-02-28", "methodology_change_review"), ("2024-02", 3, 3.0, "2024-03-02", "provenance_update")]
    assert sorted((r.event, r.old_value, r.new_value, str(r.old_vintage), str(r.new_vintage)) for r in events.where("event <> 'new_release'").collect()) == [("historical_revision", 1.2, 1.0, "2024-01-28", "2024-03-02"), ("provenance_update", 3.0, 3.0, "2024-02-28", "2024-03-02")]
    assert [(r.rules, r.value) for r in bad.collect()] == [(["unit_missing"], 9.9)]
    stored = spark.createDataFrame(kept.collect(), WATCHED)
    assert [x.count() for x in ledger.append_batch(batch.where("hour(retrieved_at) in (10, 3)"), stored, "2024-03-03")[:2]] == [0, 0]


def test_stream_takes_rows_by_time_and_repeats_batches(spark, tmp_path):
    """Readings out of order inside a batch; a batch repeated after its sinks were written leaves ledger and quarantine as they are."""
    import os

    paths = [str(tmp_path / p) for p in ("in", "ledger", "bad", "checkpoint")]
    batches = [[watched(1.0, "09:00"), watched(1.2, "01:00"), watched(None, "01:00", "2024-02")], [watched(1.0, "10:00"), watched(1.1, "11:00"), watched(4.0, "01:00", "2024-03", series_id="cn ppi+x/y")]]
    for rows in batches:
        spark.createDataFrame(rows, WATCHED).coalesce(1).write.mode("append").parquet(paths[0])
        stream_ledger(spark, paths[0], WATCHED, *paths[1:], "2024-03-02").awaitTermination(300)

    def held():
        return [sorted((r.series_id, r.observation_period, r.value, str(r.vintage), str(r.quality_flags)) for r in spark.read.schema(WATCHED).parquet(p).collect()) for p in paths[1:3]]

    good, bad = held()
    assert [(r[2], r[3]) for r in good if r[0] == "cn_cpi"] == [(1.0, "2024-03-02"), (1.1, "2024-03-02"), (1.2, "2024-01-28")] and len(good) == 4 and len(bad) == 1
    commits = tmp_path / "checkpoint" / "commits"
    last = max(int(x) for x in os.listdir(commits) if x.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)
    stream_ledger(spark, paths[0], WATCHED, *paths[1:], "2024-03-02").awaitTermination(300)
    assert held() == [good, bad]
    # A new checkpoint knows what the ledger holds: what was landed before is not the news.
    stream_ledger(spark, paths[0], WATCHED, *paths[1:3], str(tmp_path / "another"), "2024-03-02").awaitTermination(300)
    assert len([r for r in held()[0] if r[0] != "cn_cpi"]) == 1


def test_company_with_quarters_years_and_two_units(spark):
    """Quarters of 2020 and 2021's first, a year filed in two units, figures of the year to date: by hand."""
    tag, ends = valuation.TAGS, [(D(2020, 1, 1), D(2020, 3, 31)), (D(2020, 4, 1), D(2020, 6, 30)), (D(2020, 7, 1), D(2020, 9, 30)), (D(2020, 10, 1), D(2020, 12, 31)), (D(2021, 1, 1), D(2021, 3, 31))]
    rows = []
    for name, quarter in (("operating_income", 25.0), ("pretax_income", 20.0), ("income_tax", 5.0), ("depreciation_amortization", 2.5), ("capex", 2.5)):
        rows += [("q", tag[name], "USD", a, b, b + dt.timedelta(30), quarter + i) for i, (a, b) in enumerate(ends)]
        rows += [("q", tag[name], "CNY", D(2020, 1, 1), D(2020, 12, 31), D(2021, 2, 1), 7 * 4 * quarter)]
        rows += [("y", tag[name], "USD", D(2020, 1, 1), b, b + dt.timedelta(30), quarter * (i + 1)) for i, (_, b) in enumerate(ends[:4])]
        rows += [("y", tag[name], "USD", *ends[4], D(2021, 5, 1), 3 * quarter)]
        rows += [("one", tag[name], "EUR", *ends[0], D(2020, 5, 1), quarter)]
    filings = spark.createDataFrame([(*r, 0) for r in rows], "company_id string, metric string, unit string, period_start date, period_end date, filed date, value double, ordinal int")
    companies = spark.createDataFrame([("q", "shipping", 10.0, 50.0), ("y", "general", 10.0, 50.0), ("one", "general", 10.0, 50.0)], "company_id string, business_type string, shares double, price double")

    def at(cutoff):
        return {r.company_id: (r.period_end, r.fcff and round(r.fcff, 6), r.reason) for r in valuation.value_companies(filings, companies, cutoff).collect()}

    year = lambda ebit, pretax, tax, da, capex: round(ebit * (1 - tax / pretax) + da - capex, 6)
    late = at("2021-12-31")
    # Sums of the last four quarters: 26 + 27 + 28 + 29 and so on; of the year to date, three quarters of 2020 and 75 for 2021's first.
    assert late["q"] == (D(2021, 3, 31), year(110, 90, 30, 20, 20), None)
    assert late["y"] == (D(2021, 3, 31), year(150, 120, 30, 15, 15), None) and late["one"] == (None, None, "no_full_period")
    early = at("2021-02-15")
    assert early["q"] == (D(2020, 12, 31), year(106, 86, 26, 16, 16), None) and early["y"] == (D(2020, 12, 31), year(100, 80, 20, 10, 10), None)


def test_a_vendor_table_without_prices_is_an_error(spark):
    bars = spark.createDataFrame([("Close", "A", "2024-01-02", None), ("Open", "A", "2024-01-02", 1.0)], "field string, ticker string, time string, value double")
    assert harvest.select_close(bars).count() == 0 and harvest.select_close(bars, "Open", strict=True).count() == 1
    with pytest.raises(ValueError, match="Close"):
        harvest.select_close(bars, strict=True)


def test_weights_of_a_configuration(spark):
    rows = [("g", "a", 0.5, 2), ("g", "b", -0.1, 2), ("i", "c", 0.0, 2), ("l", "d", 1.0, 1)]
    config = spark.createDataFrame(rows, "factor string, component string, weight double, min_components int")
    assert sorted(tuple(r) for r in factors.config_violations(config).collect()) == [("minimum", "i", None), ("no_weight", "i", None), ("weight", "g", "b")]
