"""How often rows are read and shuffled: figures of Spark's own stages, which grow with the tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from almanac.operators import portfolio, valuation
from almanac.plans import landed, registry, views
from almanac.sources import readers

D, DATA = dt.date, "/root/testdata/sf0.001"


def stages(spark, run):
    """(rows read from files, rows written to shuffles) while ``run`` runs."""

    def now():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        found = [found.apply(i) for i in range(found.size())]
        return {(s.stageId(), s.attemptId()): (s.inputRecords(), s.shuffleWriteRecords()) for s in found}

    before = now()
    run()
    fresh = [v for k, v in now().items() if k not in before]
    return tuple(sum(x) for x in zip(*fresh))


def test_facts_of_companies_are_shuffled_a_few_times(spark):
    """Tags that no concept needs are not shuffled at all, the rest by company: once to be chosen, and once each as quarters, years and rows of a period."""
    quarters = [(D(2019 + i // 4, 1 + i % 4 * 3, 1), D(2019 + i // 4, 3 + i % 4 * 3, 28)) for i in range(8)]
    tags = [valuation.TAGS[c] for c in valuation.REQUIRED]
    rows = [(c, t, "USD", a, b, b + dt.timedelta(30), 10.0 + i, 0) for c in range(40) for t in tags for i, (a, b) in enumerate(quarters)]
    other = [(c, f"Other{k}", "USD", a, b, b + dt.timedelta(30), 1.0, 0) for c in range(40) for k in range(20) for a, b in quarters]
    filings = spark.createDataFrame(rows + other, "company_id int, metric string, unit string, period_start date, period_end date, filed date, value double, ordinal int")
    companies = spark.createDataFrame([(c, "general", 10.0, 50.0) for c in range(40)], "company_id int, business_type string, shares double, price double")
    got = []
    _, shuffled = stages(spark, lambda: got.extend(valuation.value_companies(filings, companies, "2021-12-31").collect()))
    assert len(got) == 40 and {r.period_end for r in got} == {D(2020, 12, 28)}
    assert shuffled < 4 * len(rows), shuffled / len(rows)


def test_documents_of_companies_land_in_few_files(spark, tmp_path, monkeypatch):
    """As many files as tasks, not as companies; each line is a document."""
    monkeypatch.setattr(landed, "shared_folder", lambda s, name: str(tmp_path / name))
    companies = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert landed.landed_facts(spark, DATA).select("company_id").distinct().count() == companies > 4
    files = [f for _, _, found in os.walk(tmp_path / "facts") for f in found if f.startswith("part-")]
    assert len(files) <= 4


def test_company_facts_by_line(spark, tmp_path):
    fact = '{"cik": %d, "facts": {"us-gaap": {"Cash": {"label": "x", "units": {"USD": [{"end": "2017-09-30", "val": %d, "filed": "2017-11-03", "form": "10-K", "accn": "a"}]}}}}}'
    (tmp_path / "all.json").write_text("\n".join(fact % (k, k * 10) for k in range(1, 4)) + "\n")
    got = readers.read_company_facts(spark, str(tmp_path), lines=True).collect()
    assert sorted((r.company_id, r.value) for r in got) == [("US:0000000001", 10.0), ("US:0000000002", 20.0), ("US:0000000003", 30.0)]


def test_flows_are_shuffled_twice_and_solved_in_batches(spark):
    """Flows go by day, then by account, and are read once; rates as by halving in plain Python, also without a root, a sign or a date."""
    rows = [(a, D(2015, 1, 1) + dt.timedelta(37 * k * (1 + a % 5)), -10.0 - (a * k) % 7) for a in range(60) for k in range(12)]
    rows += [(a, D(2024, 1, 1), (0.2 + a / 20) * 200) for a in range(60)]
    rows += [(100, D(2020, 1, 1), -1.0), (100, D(2020, 1, 1), 5.0), (101, D(2020, 1, 1), -5.0), (101, None, 6.0), (102, D(2020, 1, 1), -5.0), (102, D(2021, 1, 1), None), (103, D(2020, 1, 1), -5.0), (103, D(2020, 6, 1), 5e9), (104, D(2020, 1, 1), 0.0)]
    flows = spark.createDataFrame(rows, "account int, date date, amount double")
    got = {}
    _, shuffled = stages(spark, lambda: got.update({r.account: r.xirr for r in portfolio.xirr(flows).collect()}))
    assert shuffled <= 2 * len(rows)
    assert {a: got.pop(a) for a in range(100, 105)} == dict.fromkeys(range(100, 105))

    def worth(account, rate):
        own = [(d, x) for a, d, x in rows if a == account]
        return sum(x * (1 + rate) ** (-(d - min(own)[0]).days / 365.25) for d, x in own)

    for account, rate in got.items():
        lo, hi = -0.9999, 1e6  # worth falls with the rate: paid in first, paid out last
        for _ in range(160):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if worth(account, mid) > 0 else (lo, mid)
        assert abs(rate - lo) < 1e-9


@pytest.mark.parametrize("name, view, column", [("captured_vintages", "ledger", "value"), ("ledger_stream", "watch", "value"), ("landed_prices", "daily_prices", "price"), ("landed_snapshots", "observations", "value")])
def test_rows_of_several_writes_are_computed_once(spark, monkeypatch, name, view, column):
    seen, given = spark.sparkContext.accumulator(0), getattr(views, view)
    expected = given(spark, DATA).count()

    def counted(x):
        seen.add(1)
        return x

    count = F.udf(counted, "double").asNondeterministic()
    monkeypatch.setattr(views, view, lambda s, d: given(s, d).withColumn(column, count(column)))
    registry.QUERIES[name](spark, DATA).collect()
    assert seen.value == expected > 0


def test_fetched_rows_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    rows = [("CPI", D(2024, 1, k), D(2023, 12, 31), float(k)) for k in range(1, 11)]
    fetched = spark.createDataFrame(rows, "series_id string, vintage date, observation_date date, value double").withColumn("value", counted("value"))
    assert [tuple(r) for r in readers.capture_vintages(spark, fetched, str(tmp_path / "a")).collect()] == [("CPI", 10, 0)]
    assert seen.value == len(rows)
