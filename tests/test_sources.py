"""Sources and sinks on files written by the tests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac.operators import contracts, factors, portfolio
from almanac.sources import catalog, readers
from almanac.streaming.ledger import read_asof_view, stream_asof

D = dt.date


def write(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_snapshots_of_differing_columns(spark, tmp_path):
    path = write(
        tmp_path / "s",
        {
            "a.csv": "observation_date,value,available_date\n2024-01-31,1.5,2024-02-10\n2024-02-29,2.5,\nbad,3,\n",
            "b.csv": "value,observation_date,availability_basis,available_date\n7,2024-01-31,,2024-02-01\nx,2024-02-29,fixed_lag,2024-03-01\n",
        },
    )
    got = {(r.series_id, r.observation_date): (r.value, r.available_date, r.availability_basis) for r in readers.read_snapshots(spark, path).collect()}
    assert got == {
        ("a", D(2024, 1, 31)): (1.5, D(2024, 2, 10), "unverified"),
        ("a", D(2024, 2, 29)): (2.5, None, "unknown"),
        ("a", None): (3.0, None, "unknown"),
        ("b", D(2024, 1, 31)): (7.0, D(2024, 2, 1), None),
        ("b", D(2024, 2, 29)): (None, D(2024, 3, 1), "fixed_lag"),
    }
    assert readers.read_snapshots(spark, path, "2024-02-01", "2024-02-29").count() == 2
    assert set(contracts.normalize_observations(readers.read_snapshots(spark, path)).columns) >= {"series_id", "availability_basis"}
    side = spark.createDataFrame([("a", "n", "u", "monthly", "percent", "2024-01-01", "level", " ")], ", ".join(f"{c} string" for c in readers.SIDECAR))
    assert sorted(tuple(r) for r in readers.sidecar_violations(readers.read_snapshots(spark, path), side).collect()) == [("no_sidecar", "b"), ("revision_policy_missing", "a")]
    assert {r.unit for r in readers.attach_sidecar(readers.read_snapshots(spark, path), side).collect()} == {"percent", None}


def test_prices_of_differing_columns(spark, tmp_path):
    path = write(tmp_path / "p", {"aa.csv": "Date,Close,Adj Close\n2024-01-02,10,9\n2024-01-03,0,0\n2024-01-04,11,10\n2024-01-04,11,10\n", "bb.csv": "timestamp,price\n2024-01-02T20:00:00Z,5\nnever,6\n2024-01-03 00:00:00,7.5\n"})
    good, bad = readers.read_prices(spark, path)
    assert sorted(tuple(r) for r in good.collect()) == [("AA", D(2024, 1, 2), 9.0, "adjusted"), ("BB", D(2024, 1, 2), 5.0, "as_supplied"), ("BB", D(2024, 1, 3), 7.5, "as_supplied")]
    assert sorted((r.rule, r.symbol) for r in bad.collect()) == [("bad_date", "BB"), ("bad_price", "AA"), ("duplicate_date", "AA"), ("duplicate_date", "AA")]
    assert {len(r.sha256) for r in readers.file_inventory(spark, path).collect()} == {64}


def test_files_by_header(spark, tmp_path):
    """Fourteen columns, quoted names, cells with line ends, a byte order mark, odd file names; a file of no known header is named, not lost."""
    many = ",".join(f"c{i}" for i in range(12))
    files = {
        "wide.csv": f"{many},Date,Close\n" + ",".join("x" * 12) + ",2024-01-02,5\n",
        "quoted.csv": 'Date,"Adj Close","a ""note"", long"\n2024-01-02,7,"two\nlines, and ""more"""\n2024-01-03,8,\n',
        "bom [1].csv": "\ufeffdate,price\n2024-01-02T01:00:00+09:00,3\n",
        "none.csv": "when,price\n2024-01-02,1\n",
        "empty.csv": "",
        "heads.csv": "date,close\n",
    }
    good, bad = readers.read_prices(spark, write(tmp_path / "p", files))
    assert sorted(tuple(r) for r in good.collect()) == [("BOM [1]", D(2024, 1, 1), 3.0, "as_supplied"), ("QUOTED", D(2024, 1, 2), 7.0, "adjusted"), ("QUOTED", D(2024, 1, 3), 8.0, "adjusted"), ("WIDE", D(2024, 1, 2), 5.0, "as_supplied")]
    assert sorted(tuple(r) for r in bad.collect()) == [("no_header", "EMPTY", None), ("no_header", "NONE", None)]
    assert readers.read_prices(spark, str(tmp_path / "p"), "2024-01-02", "2024-01-02")[0].count() == 2
    text = '"observation_date","value","note"\n2024-01-31,1,"a\nb"\n2024-02-29,2,""\n'
    path = write(tmp_path / "s", {"q.csv": text, "w.csv": f"{many},value,observation_date,available_date\n" + ",".join("x" * 12) + ",4,2024-01-31,2024-02-01\n"})
    assert sorted((r.series_id, r.observation_date, r.value, r.availability_basis) for r in readers.read_snapshots(spark, path).collect()) == [("q", D(2024, 1, 31), 1.0, "unknown"), ("q", D(2024, 2, 29), 2.0, "unknown"), ("w", D(2024, 1, 31), 4.0, "unverified")]
    with pytest.raises(ValueError, match="none.csv"):
        readers.read_snapshots(spark, write(tmp_path / "bad", {"none.csv": "date,value\n1,2\n"}))
    with pytest.raises(ValueError, match="three.csv"):
        readers.read_two_column_series(spark, write(tmp_path / "three", {"three.csv": "a,b,c\n2024-01-01,2,3\n"}))
    dated = write(tmp_path / "two", {"x.csv": "DATE,X\n2024-01-01,1\n2024-02-01,2\n2024-03-01,NaN\n"})
    assert [r.value for r in readers.read_two_column_series(spark, dated, "2024-01-15", "2024-12-31").collect()] == [2.0]


def test_two_columns_vintages_and_capture(spark, tmp_path):
    path = write(tmp_path / "t", {"x.csv": "DATE,X\n2024-01-01,1\n2024-02-01,.\n"})
    assert [tuple(r) for r in readers.read_two_column_series(spark, path).collect()] == [("x", D(2024, 1, 1), 1.0)]
    root = write(tmp_path / "v", {"CPI/2020-07-01.csv": "observation_date,value,vintage_date\n2020-05-01,1.0,2020-07-01\n", "CPI/manifest.txt": "x"})
    rows = readers.with_vintage_availability(readers.read_vintages(spark, root), 90).collect()
    assert [(r.series_id, r.vintage, r.available_date, r.availability_basis) for r in rows] == [("CPI", D(2020, 7, 1), D(2020, 7, 1), "fixed_lag")]
    symbols = spark.createDataFrame([("CPI",)], "series_id string")
    plan = readers.plan_vintages(spark, symbols, "2020-01-01", "2021-07-01", 6, readers.read_vintages(spark, root).select("series_id", "vintage"))
    assert sorted(r.vintage for r in plan.collect()) == [D(2020, 1, 1), D(2021, 1, 1), D(2021, 7, 1)]
    fetched = plan.select("series_id", "vintage", F.to_date(F.lit("2019-12-01")).alias("observation_date"), F.when(F.col("vintage") > "2020-06-01", 2.0).alias("value"))
    archive = str(tmp_path / "archive")
    assert [tuple(r) for r in readers.capture_vintages(spark, fetched, archive).collect()] == [("CPI", 3, 0)]
    assert [tuple(r) for r in readers.capture_vintages(spark, fetched, archive).collect()] == [("CPI", 1, 2)]
    assert spark.read.parquet(archive).count() == 2


def test_company_facts_and_entities(spark, tmp_path):
    text = '{"cik": 320193, "facts": {"us-gaap": {"NetCash": {"label": "x", "units": {"USD": [{"end": "2017-09-30", "val": 1.0, "filed": "2017-11-03", "form": "10-K", "accn": "a"}, {"end": "2017-09-30", "val": 2.0, "filed": "2017-11-02", "form": "8-K", "accn": "b"}]}}}}}'
    got = readers.read_company_facts(spark, write(tmp_path / "f", {"c.json": text})).collect()
    assert [(r.company_id, r.metric, r.unit, r.value, r.source) for r in got] == [("US:0000320193", "NetCash", "USD", 1.0, "SEC/10-K/a")]
    tickers = spark.createDataFrame([(320193, "AAPL", "Apple")], "cik_str bigint, ticker string, title string")
    rows = spark.createDataFrame([(" aapl ",), ("none",)], "ticker string")
    assert {r.ticker: r.company_id for r in readers.resolve_entities(rows, tickers).collect()} == {" aapl ": "US:0000320193", "none": None}


def test_history_guard_and_snapshot_sink(spark, tmp_path):
    rows = [("s", D(2024, 1, 31), None, 1.0), ("s", D(2024, 1, 31), D(2024, 2, 1), 1.0), ("s", D(2024, 2, 29), None, 2.0), ("s", D(2024, 2, 29), None, 3.0), ("t", D(2024, 1, 31), None, 5.0)]
    df = spark.createDataFrame(rows, "series_id string, observation_date date, available_date date, value double")
    conflicts, coverage = readers.save_snapshots(df, str(tmp_path / "out"))
    assert [tuple(r) for r in conflicts.collect()] == [("s", D(2024, 2, 29))]
    held = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.series_id, r.available_date) for r in held.collect() if r.available_date) == [("s", D(2024, 2, 1))] and held.count() == 2
    assert {r.series_id: r.note for r in coverage.collect()}["t"] == "1 observations from 2024-01-31 to 2024-01-31; release date unknown for 1"
    old, new = df.where("series_id = 's'"), df.where("series_id = 't'")
    assert tuple(readers.history_guard(old, new).first()) == (True, False, True)


def test_sinks(spark, tmp_path):
    one = spark.createDataFrame([("s", D(2024, 1, 31), 1.0)], "strategy_id string, date date, value double")
    readers.save_baseline(str(tmp_path / "b"), one, one, one, {"policy": "all"})
    readers.save_regime_research(str(tmp_path / "r"), one, one, one, one)
    readers.save_backtest(str(tmp_path / "k"), one, one, one, one)
    assert spark.read.json(str(tmp_path / "b/run")).first().value == "all" and spark.read.parquet(str(tmp_path / "r/summary")).count() == 1
    assert spark.read.text(str(tmp_path / "k/report")).first()[0].startswith('{"strategy_id":"s"') and spark.read.parquet(str(tmp_path / "k/daily")).count() == 1


def test_catalog(spark, tmp_path):
    text = '{"series": {"a": {"provider": "csv", "symbol": "x", "kind": "macro", "frequency": "monthly"}, "b": {"provider": "csv", "symbol": "x", "kind": "odd", "frequency": "daily", "release_lag_days": 5, "color": 1}, "c": {"provider": "fred", "symbol": "y", "kind": "rate", "frequency": "weekly", "release_lag_days": -1}, "d": {"provider": "fred", "symbol": "z", "kind": "rate", "release_lag_days": "10"}}}'
    frame = catalog.catalog_frame(spark, catalog.parsed(catalog.read_text(spark, write(tmp_path / "c", {"c.json": text}))))
    found = sorted((r.level, r.finding, ",".join(r["keys"])) for r in catalog.catalog_audit(frame).collect())
    assert found == [
        ("error", "frequency_missing", "d"), ("error", "kind", "b"), ("error", "lag_negative", "c"), ("error", "lag_not_whole", "d"), ("error", "unknown_field", "b"),
        ("warning", "long_daily_lag", "b"), ("warning", "no_lag", "a"), ("warning", "shared_symbol", "a,b"),
    ]
    with pytest.raises(ValueError):
        catalog.parsed("[1]")
    parts = catalog.components_frame(spark, {"cn": {"growth": {"min_components": 1, "components": {"pmi": {"source": "p", "transform": "real_rate_proxy", "inflation_source": "q"}, "x": {"source": "p", "optional": True}}}}})
    assert {(r.source, r.required) for r in factors.component_sources(parts).collect()} == {("p", True), ("q", True)}
    companies, securities = catalog.universe_frames(spark, {"companies": [{"company_id": "US:A", "name": "A"}], "securities": [{"security_id": "X", "ticker": "A"}]})
    assert companies.count() == securities.count() == 1


def test_asof_view_of_a_stream_equals_the_batch(spark, tmp_path):
    """Late and out-of-order releases over three landings: the view is what the whole history gives."""
    from almanac.operators.asof import asof_month_end

    schema = "series_id string, observation_date date, available_date date, value double"
    batches = [[("a", D(2024, 1, 31), D(2024, 2, 10), 1.0), ("b", D(2024, 1, 31), D(2024, 3, 5), 5.0)], [("a", D(2024, 3, 31), D(2024, 4, 10), 3.0)], [("a", D(2024, 2, 29), D(2024, 3, 20), 2.0), ("b", D(2024, 2, 29), D(2024, 5, 2), 6.0)]]
    paths = [str(tmp_path / p) for p in ("in", "obs", "view", "checkpoint")]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(paths[0])
        stream_asof(spark, paths[0], schema, *paths[1:], "2024-06-30").awaitTermination(120)
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {(r.series_id, r.month_end): r.value for r in asof_month_end(whole, end="2024-06-30").collect() if r.value is not None}
    got = {(r.series_id, r.month_end): r.value for r in read_asof_view(spark, paths[2]).collect() if r.value is not None}
    assert got == want and got["a", D(2024, 3, 31)] == 2.0


def test_backtest_refuses_gaps(spark):
    """Two assets, one without a price on a day: refused, and left out without the guard."""
    days = [D(2024, 1, 1 + i) for i in range(5)]
    prices = spark.createDataFrame([("A", d, 10.0 + i) for i, d in enumerate(days)] + [("B", d, 20.0) for i, d in enumerate(days) if i != 3], "symbol string, date date, price double")
    strategies = spark.createDataFrame([("s", "buy_and_hold", 0.0, {"A": 0.5, "B": 0.4, "CASH": 0.1})], "strategy_id string, frequency string, cost double, weights map<string, double>")
    with pytest.raises(ValueError, match="B"):
        portfolio.backtest_daily(prices, strategies)
    got = portfolio.backtest_daily(prices, strategies, guard=False).orderBy("date").collect()
    assert len(got) == 4 and got[-1].equity == pytest.approx(0.5 * 14 / 11 + 0.5)
    assert {r.symbol for r in portfolio.account_weights(prices, strategies).collect()} == {"A", "B", "CASH"}
    assert portfolio.dropped_rows(prices.where("symbol = 'A' or date > '2024-01-02'"), strategies).first().dropped == 2


def test_deposit_plan_by_hand(spark):
    days = [D(2025, 1, d) for d in (6, 7, 8, 9, 10, 13, 14, 15, 16, 17)]
    prices = spark.createDataFrame([("GLD", d, p) for d, p in zip(days, [100.0] * 4 + [110.0] * 5 + [121.0], strict=True)], "symbol string, date date, price double")
    plans = spark.createDataFrame([("a", 100.0, 10.0, "FRI", 0.0, {"GLD": 1.0}), ("b", 100.0, 10.0, "FRI", 0.01, {"GLD": 1.0})], "account string, initial double, amount double, weekday string, cost double, weights map<string, double>")
    got = {r.account: r for r in portfolio.deposit_summary(portfolio.deposit_accounts(prices, plans)).collect()}
    a, b = got["a"], got["b"]
    assert (a.contributions, a.paid_in, a.max_drawdown) == (2, 120.0, 0.0) and a.equity == pytest.approx(142) and a.nav == pytest.approx(1.21) and a.xirr > 0
    assert b.max_drawdown == pytest.approx(1 / 1.01 - 1) and b.equity < a.equity


def test_portfolio_fixtures(spark):
    """Hand-calculated accounts: two instructions with costs, a return that belongs to the old holdings, an entry fee."""
    days = [D(2024, 1, 30), D(2024, 1, 31), D(2024, 2, 1), D(2024, 2, 2)]
    rows = [("A", d, p) for d, p in zip(days, (100.0, 200.0, 220.0, 220.0), strict=True)] + [("B", d, p) for d, p in zip(days, (100.0, 100.0, 110.0, 220.0), strict=True)]
    prices = spark.createDataFrame(rows, "symbol string, date date, price double")
    book = lambda f, c, w: spark.createDataFrame([("s", f, c, w)], "strategy_id string, frequency string, cost double, weights map<string, double>")
    daily = portfolio.backtest_daily(prices, book("buy_and_hold", 0.01, {"A": 0.5, "B": 0.5})).orderBy("date").collect()
    assert [r.net_return for r in daily] == pytest.approx([0, -0.01, 0.10, 0.5]) and daily[1].drawdown == pytest.approx(-0.01)
    monthly = portfolio.backtest_daily(prices, book("monthly", 0.01, {"A": 0.5, "B": 0.5})).orderBy("date").collect()
    assert monthly[2].turnover == pytest.approx(0) and [r.turnover for r in monthly][:2] == pytest.approx([0, 1])
