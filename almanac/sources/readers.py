"""Sources and sinks with declared schemas."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.sources.shared import written

OBSERVATION = "observation_date string, observation_period string, available_date string, availability_basis string, availability_evidence_url string, source_value_url string, value string"
FACTS = "cik bigint, facts map<string, map<string, struct<label: string, units: map<string, array<struct<start: date, end: date, val: double, filed: date, form: string, accn: string>>>>>>"
PERIODIC = ("10-K", "10-Q", "20-F", "40-F")

#: Readers by name: (spark, path) to observations. Callers may add their own.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def file_headers(spark: SparkSession, path: str) -> dict[str, str | None]:
    """The first line that is not blank of every file by its address; None for a file without one.

    Lines are not shuffled: one small row per file comes to the driver, which has the list of files anyway.
    """
    raw = spark.read.text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
    first = lines.where("at = 0 and trim(value) <> ''").groupBy("file").agg(F.min_by("value", "n").alias("header"))
    plain = {re.sub("^file:/+", "/", file): file for file in raw.inputFiles()}  # two ways to write an address
    found = {re.sub("^file:/+", "/", r.file): r.header for r in first.collect()}
    return {file: found.get(key) for key, file in plain.items()}


def column_names(header: str | None) -> list[str]:
    """The names of a header line, quoted or not; a byte order mark goes."""
    return [name.strip() for name in next(csv.reader([(header or "").lstrip("\ufeff")]), [])]


def read_by_header(spark: SparkSession, path: str, pick: Callable[[list[str]], dict[str, int] | None], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """CSV files of any layouts: (file, found, one text column per name of ``columns``), ``found`` being those that the file has, and (file, header) of files whose header ``pick`` refuses.

    ``pick`` gets the names of a header and says where each wanted column stands. Files of one header are read together by Spark's own parser
    and the groups united, so there is no bound on columns, quoted names and cells may hold commas and line ends, and the plan grows
    with the number of layouts. Columns that a file lacks are null.
    """
    groups: dict[str, list[str]] = {}
    bad = []
    for file, header in sorted(file_headers(spark, path).items()):
        if header is not None and pick(column_names(header)) is not None:
            groups.setdefault(header, []).append(re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file)))
        else:
            bad.append((file, header))
    out = spark.createDataFrame([], ", ".join(["file string", "found array<string>", *[f"`{c}` string" for c in columns]]))
    for header, files in sorted(groups.items()):
        names = column_names(header)
        places = pick(names)
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        rows = spark.read.schema(schema).csv(sorted(files), header=True, multiLine=True, escape='"')
        cells = [(F.nullif(F.trim(f"c{places[c]}"), F.lit("")) if c in places else F.lit(None).cast("string")).alias(c) for c in columns]
        found = F.array(*[F.lit(c) for c in columns if c in places]).cast("array<string>")
        out = out.unionByName(rows.select(F.col("_metadata.file_path").alias("file"), found.alias("found"), *cells))
    return out, spark.createDataFrame(bad, "file string, header string")


def file_name(file: Column) -> Column:
    """The name of a CSV file without its folder and ending."""
    return F.regexp_extract(F.url_decode(file), r"([^/]+)\.csv$", 1)


def _between(df: DataFrame, start: str | None, end: str | None, column: str = "observation_date") -> DataFrame:
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(column) <= F.lit(end).cast("date"))


def read_snapshots(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, name: Callable[[Column], Column] = file_name) -> DataFrame:
    """Snapshot CSVs, one per series; the file name, or what ``name`` makes of the file's address, is the series. Dates that don't parse are null and kept for the contract.

    Columns are taken by name, wherever they stand, and files may lack all but observation_date and value; one that lacks these is an error. A file
    without the basis column gets ``unverified`` where it has a date and ``unknown`` elsewhere; a basis that is there is kept as given, blank or
    not. ``start`` and ``end`` bound the observation dates, inclusive.
    """
    names = [f.split()[0] for f in OBSERVATION.split(", ")]

    def pick(header: list[str]) -> dict[str, int] | None:
        return {c: header.index(c) for c in names if c in header} if {"observation_date", "value"} <= set(header) else None

    rows, bad = read_by_header(spark, path, pick, names)
    if wrong := bad.limit(5).collect():
        raise ValueError(f"files without observation_date and value: {[r.file for r in wrong]}")
    out = rows.withColumn("series_id", name(F.col("file")))
    for c in ("observation_date", "available_date"):
        out = out.withColumn(c, F.try_to_date(c, "yyyy-MM-dd"))
    basis = F.when(F.array_contains("found", "availability_basis"), F.col("availability_basis")).when(F.col("available_date").isNotNull(), "unverified").otherwise("unknown")
    out = out.withColumn("value", F.col("value").try_cast("double")).withColumn("availability_basis", basis)
    return _between(out.select("series_id", *names), start, end)


#: What the sidecar of a snapshot must say.
SIDECAR = ("series_key", "source_name", "source_url", "frequency", "unit", "downloaded_at", "reported_as", "revision_policy")


def attach_sidecar(obs: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Observations with what the sidecar (series_key, ...) says of their series; one without a sidecar has nulls. The table is one row per series."""
    return obs.join(sidecar.withColumnRenamed("series_key", "series_id"), "series_id", "left")


def sidecar_violations(obs: DataFrame, sidecar: DataFrame) -> DataFrame:
    """(rule, series_id): series without a sidecar, and required keys that a sidecar lacks or leaves blank."""
    bare = obs.select("series_id").distinct().join(sidecar.select(F.col("series_key").alias("series_id")), "series_id", "left_anti").select(F.lit("no_sidecar").alias("rule"), "series_id")
    lacks = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"{c}_missing")) if c in sidecar.columns else F.lit(f"{c}_missing") for c in SIDECAR]
    return sidecar.select(F.explode(F.array_compact(F.array(*lacks))).alias("rule"), F.col("series_key").alias("series_id")).unionByName(bare)


def read_two_column_series(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, name: Callable[[Column], Column] = file_name) -> DataFrame:
    """(series_id, observation_date, value) of two-column CSVs, whatever the columns are called; rows without a number go. A file of another width is an error.

    ``start`` and ``end`` bound the dates, inclusive.
    """
    rows, bad = read_by_header(spark, path, lambda names: {"observation_date": 0, "value": 1} if len(names) == 2 else None, ["observation_date", "value"])
    if wrong := bad.limit(5).collect():
        raise ValueError(f"files that don't have two columns: {[r.file for r in wrong]}")
    out = rows.select(name(F.col("file")).alias("series_id"), F.try_to_date("observation_date", "yyyy-MM-dd").alias("observation_date"), F.col("value").try_cast("double").alias("value"))
    return _between(out.where("value is not null and not isnan(value) and observation_date is not null"), start, end)


#: An archive's address: folder of the symbol, file of the vintage.
ARCHIVE = r"([^/]+)/([0-9-]{10})\.csv$"


def read_vintages(spark: SparkSession, root: str, layout: str = ARCHIVE) -> DataFrame:
    """An archive <symbol>/<vintage>.csv, or another ``layout`` whose groups are the two: (series_id, vintage, observation_date, value)."""
    raw = spark.read.schema("observation_date date, value double, vintage_date date").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(root, header=True)
    file = F.url_decode("_metadata.file_path")
    return raw.select(F.regexp_extract(file, layout, 1).alias("series_id"), F.to_date(F.regexp_extract(file, layout, 2)).alias("vintage"), "observation_date", "value")


def with_vintage_availability(df: DataFrame, lag: int) -> DataFrame:
    """Release dates of vintage rows: the lag after the observation, at the latest the vintage."""
    return df.withColumn("available_date", F.least(F.date_add("observation_date", lag), F.col("vintage"))).withColumn("availability_basis", F.lit("fixed_lag"))


def plan_vintages(spark: SparkSession, symbols: DataFrame, start: str, end: str, step_months: int, existing: DataFrame) -> DataFrame:
    """(series_id, vintage) still to be captured."""
    dates = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval {int(step_months)} month)")).alias("vintage"))
    return symbols.select("series_id").join(F.broadcast(dates), F.lit(True)).join(existing, ["series_id", "vintage"], "left_anti")


def capture_vintages(spark: SparkSession, fetched: DataFrame, root: str) -> DataFrame:
    """Write fetched rows (series_id, vintage, observation_date, value) of vintages that the archive lacks; rows without a value go.

    Returns (series_id, captured, skipped): vintages written and found there. What is fetched is computed once, so counts and files are of the same rows.
    """
    schema = "observation_date date, value double, series_id string, vintage date"
    fetched = written(fetched.select("series_id", "vintage", "observation_date", "value"), "fetched")
    spark.createDataFrame([], schema).write.mode("append").partitionBy("series_id", "vintage").parquet(root)
    there = spark.read.schema(schema).parquet(root).select("series_id", "vintage", F.lit(True).alias("there")).distinct()
    marked = fetched.select("series_id", "vintage").distinct().join(there, ["series_id", "vintage"], "left")
    counts = marked.groupBy("series_id").agg(F.count(F.when(F.col("there").isNull(), 1)).alias("captured"), F.count("there").alias("skipped"))
    done = spark.createDataFrame(counts.collect(), counts.schema)  # a row per series, counted before the archive changes
    new = fetched.where("value is not null").join(there, ["series_id", "vintage"], "left_anti").select("observation_date", "value", "series_id", "vintage")
    new.write.mode("append").partitionBy("series_id", "vintage").parquet(root)
    return done


def read_company_facts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(company_id, metric, unit, period_start, period_end, value, filed, source, ordinal) of periodic reports; a fact of a moment has no start.

    A file is one company's document or, with ``lines``, has a document in every line: many companies then need few files, and Spark splits them.
    """
    raw = spark.read.schema(FACTS).option("multiLine", not lines).json(path)
    tags = raw.select(F.format_string("US:%010d", "cik").alias("company_id"), F.explode("facts").alias("_", "tags")).select("company_id", F.explode("tags").alias("metric", "t"))
    facts = tags.select("company_id", "metric", F.explode("t.units").alias("unit", "list")).select("company_id", "metric", "unit", F.posexplode("list").alias("ordinal", "f"))
    return facts.where(F.col("f.form").isin(*PERIODIC)).select("company_id", "metric", "unit", F.col("f.start").alias("period_start"), F.col("f.end").alias("period_end"), F.col("f.val").alias("value"), F.col("f.filed").alias("filed"), F.concat_ws("/", F.lit("SEC"), "f.form", "f.accn").alias("source"), "ordinal")


def resolve_entities(df: DataFrame, tickers: DataFrame, column: str = "ticker") -> DataFrame:
    """Rows with the ``company_id`` of their ticker, whatever its case and blanks; null for a ticker that the table (cik_str, ticker) lacks."""
    known = tickers.select(F.upper(F.trim("ticker")).alias("_ticker"), F.format_string("US:%010d", F.col("cik_str").cast("bigint")).alias("company_id")).dropDuplicates(["_ticker"])
    return df.withColumn("_ticker", F.upper(F.trim(column))).join(known, "_ticker", "left").drop("_ticker")


#: Names of the date and price columns of price files, the preferred first.
DATE_NAMES = ("date", "timestamp", "datetime", "time", "trade_date")
PRICE_NAMES = ("adj_close", "adjusted_close", "close", "price", "value")


def utc_date(text: Column) -> Column:
    """The date of a text: in UTC where it names an offset, as written otherwise; null if it has none."""
    clean = F.trim(text)
    zoned = F.to_utc_timestamp(F.try_to_timestamp(clean), F.current_timezone()).cast("date")
    written = F.try_to_date(F.substring(clean, 1, 10), "yyyy-MM-dd")
    return F.coalesce(F.when(clean.rlike(r"\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"), zoned), written, F.try_to_timestamp(clean).cast("date"))


def read_prices(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, name: Callable[[Column], Column] = file_name) -> tuple[DataFrame, DataFrame]:
    """(symbol, date, price, basis) of the price CSVs of a folder, and (rule, symbol, date) of what can't be used.

    Every file may name its columns in its own way and have any number of them: the first known date and price column of its header counts.
    ``basis`` says whether the price is adjusted. Rules: no_header (a file without such columns), bad_date, bad_price (no positive finite number),
    duplicate_date; such rows are not returned. ``start`` and ``end`` bound the prices, inclusive.
    """

    def pick(names: list[str]) -> dict[str, int] | None:
        plain = [n.lower().replace(" ", "_") for n in names]
        date, price = next((n for n in DATE_NAMES if n in plain), None), next((n for n in PRICE_NAMES if n in plain), None)
        if date is None or price is None:
            return None
        return {"date": plain.index(date), "price": plain.index(price)} | ({"adjusted": plain.index(price)} if price.startswith("adj") else {})

    rows, unread = read_by_header(spark, path, pick, ["date", "price", "adjusted"])
    symbol = F.upper(name(F.col("file"))).alias("symbol")
    price = F.col("price").try_cast("double")
    basis = F.when(F.array_contains("found", "adjusted"), "adjusted").otherwise("as_supplied")
    typed = rows.select(symbol, utc_date(F.col("date")).alias("date"), price.alias("price"), basis.alias("basis"))
    good_price = F.coalesce((F.col("price") > 0) & ~F.isnan("price") & (F.col("price") < float("inf")), F.lit(False))
    marked = typed.withColumn("n", F.count("*").over(Window.partitionBy("symbol", "date")))
    rule = F.when(F.col("date").isNull(), "bad_date").when(~good_price, "bad_price").when(F.col("n") > 1, "duplicate_date")
    marked = marked.withColumn("rule", rule)
    wrong = marked.where("rule is not null").select("rule", "symbol", "date")
    wrong = wrong.unionByName(unread.select(F.lit("no_header").alias("rule"), symbol, F.lit(None).cast("date").alias("date")))
    return _between(marked.where("rule is null").select("symbol", "date", "price", "basis"), start, end, "date"), wrong


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def history_guard(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: whether a replacement has fewer rows, starts later or ends earlier."""
    ends = [d.agg(F.count("*").alias(f"n_{k}"), F.min("observation_date").alias(f"a_{k}"), F.max("observation_date").alias(f"b_{k}")) for k, d in (("old", old), ("new", new))]
    return ends[0].join(ends[1], F.lit(True)).select((F.col("n_new") < F.col("n_old")).alias("shorter"), (F.col("a_new") > F.col("a_old")).alias("starts_later"), (F.col("b_new") < F.col("b_old")).alias("ends_earlier"))


def save_snapshots(df: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write one row per series and date, the dated one first, partitioned by series; rows whose values differ are not written.

    Returns the conflicts (series_id, observation_date), and coverage (series_id, observations, first_date, last_date, undated, note) of what is written.
    """
    key = ["series_id", "observation_date"]
    conflicts = df.groupBy(*key).agg(F.count_distinct("value").alias("n")).where("n > 1").select(*key)
    order = F.struct(F.col("available_date").isNull().alias("undated"), F.col("available_date"))
    rows = df.join(conflicts, key, "left_anti").groupBy(*key).agg(F.min_by(F.struct(*[c for c in df.columns if c not in key]), order).alias("r")).select(*key, "r.*")
    rows.write.mode("overwrite").partitionBy("series_id").parquet(path)
    by = rows.groupBy("series_id").agg(F.count("*").alias("observations"), F.min("observation_date").alias("first_date"), F.max("observation_date").alias("last_date"), F.count(F.when(F.col("available_date").isNull(), 1)).alias("undated"))
    note = F.format_string("%d observations from %s to %s; release date unknown for %d", "observations", F.col("first_date").cast("string"), F.col("last_date").cast("string"), "undated")
    return conflicts, by.withColumn("note", note)


def save_baseline(path: str, panel: DataFrame, factors: DataFrame, regimes: DataFrame, about: dict[str, str]) -> None:
    """The tables of a country baseline, and what the run was."""
    for name, df in (("panel", panel), ("factors", factors), ("regimes", regimes)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    panel.sparkSession.createDataFrame([(k, str(x)) for k, x in sorted(about.items())], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/run")


def save_regime_research(path: str, regimes: DataFrame, prices: DataFrame, forward: DataFrame, summary: DataFrame) -> None:
    """State, prices, forward returns and their summary."""
    for name, df in (("regimes", regimes), ("prices", prices), ("forward_returns", forward), ("summary", summary)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def save_backtest(path: str, prices: DataFrame, daily: DataFrame, metrics: DataFrame, monthly: DataFrame) -> None:
    """The artefacts of backtests, partitioned by strategy, with a JSON report per strategy."""
    for name, df in (("daily", daily), ("monthly_returns", monthly)):
        df.write.mode("overwrite").partitionBy("strategy_id").parquet(f"{path}/{name}")
    prices.write.mode("overwrite").parquet(f"{path}/prices")
    save_reports(metrics, f"{path}/report")


def save_reports(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


READERS |= {"snapshots": read_snapshots, "two_column": read_two_column_series, "vintages": read_vintages}
