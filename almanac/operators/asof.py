"""As-of operators: what was known at each month-end, by release order, by vintage, by period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def month_ends(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "available_date", whole: bool = True) -> DataFrame:
    """Calendar month-ends within [start, end], as a one-column frame; a bound that is not given is the least or greatest ``column`` of the data.

    ``whole``: a last month that has not ended is left out.
    """
    bounds = df.agg(F.min(column).alias("a"), F.max(column).alias("b")) if start is None or end is None else df.sparkSession.range(1)
    a, b = (F.lit(given).cast("date") if given is not None else F.col(name).cast("date") for given, name in ((start, "a"), (end, "b")))
    last = b if whole else F.last_day(b)
    bounds = bounds.select(a.alias("a"), last.alias("b")).where("a is not null and b >= a")
    months = bounds.select("a", "b", F.explode(F.expr("sequence(trunc(a, 'MM'), b, interval 1 month)")).alias("m"))
    return months.where("last_day(m) between a and b").select(F.last_day("m").alias("month_end"))


def asof_month_end(obs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(series_id, month_end, value): the last released value of each series; null before the first release.

    Observations and calendar rows are united and swept once per series, so there is one shuffle and
    no join on the data; of one release date the latest observation wins. The calendar spans the release dates unless bounds are given.
    """
    rows = obs.where("available_date is not null and value is not null").select("series_id", F.col("available_date").alias("at"), F.lit(0).alias("tag"), "observation_date", "value")
    calendar = obs.select("series_id").distinct().join(F.broadcast(month_ends(obs, start, end)), F.lit(True))  # months are few: 12 a year
    marks = calendar.select("series_id", F.col("month_end").alias("at"), F.lit(1).alias("tag"), F.lit(None).cast("date").alias("observation_date"), F.lit(None).cast("double").alias("value"))
    w = Window.partitionBy("series_id").orderBy("at", "tag", "observation_date").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.unionByName(marks).withColumn("value", F.last("value", ignorenulls=True).over(w))
    return swept.where("tag = 1").select("series_id", F.col("at").alias("month_end"), "value")


def panel_wide(panel: DataFrame, series: list[str]) -> DataFrame:
    """A column per named series; only for the output edge."""
    return panel.groupBy("month_end").pivot("series_id", series).agg(F.first("value"))


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is greatest by ``order``, nulls lowest."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fundamentals_asof(facts: DataFrame, cutoff: str) -> DataFrame:
    """Per company and metric the latest period known at the cutoff, in its latest version."""
    return latest(facts.where(F.col("available_date") <= F.lit(cutoff).cast("date")), ["company_id", "metric"], "period_end", "available_date")


def fundamentals_asof_dates(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """The same at many decision dates (decision_date): a running maximum swept over facts and dates together."""
    keys = facts.select("company_id", "metric").distinct().join(decisions.select("decision_date").distinct(), F.lit(True))
    rows = facts.select("company_id", "metric", F.col("available_date").alias("at"), F.lit(0).alias("tag"), F.struct("period_end", "available_date", "value").alias("fact"))
    marks = keys.select("company_id", "metric", F.col("decision_date").alias("at"), F.lit(1).alias("tag"), F.lit(None).cast(rows.schema["fact"].dataType).alias("fact"))
    w = Window.partitionBy("company_id", "metric").orderBy("at", "tag").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.unionByName(marks).withColumn("fact", F.max("fact").over(w)).where("tag = 1 and fact is not null")
    return swept.select("company_id", "metric", F.col("at").alias("decision_date"), "fact.period_end", "fact.value")


def visible_versions(ledger: DataFrame, cutoff: str) -> DataFrame:
    """Latest version of each (series, period) whose release and vintage are known at the cutoff."""
    known = ledger.where(F.greatest("available_date", "vintage") <= F.lit(cutoff).cast("date"))
    return latest(known, ["series_id", "observation_date"], "vintage", *[c for c in ("retrieved_at",) if c in ledger.columns])


def eligible_rows(ledger: DataFrame, cutoff: str) -> DataFrame:
    """Rows of officially released values whose release and vintage are known at the cutoff, with the date from which both are."""
    known = ledger.where((F.col("availability_basis") == "official_release") & F.col("value").isNotNull() & ~F.isnan("value"))
    known = known.where("available_date is not null and vintage is not null").withColumn("effective", F.greatest("available_date", "vintage"))
    return known.where(F.col("effective") <= F.lit(cutoff).cast("date"))


def vintage_panel(ledger: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(series_id, month_end, observation_date, value): at each month-end the newest observation, in its newest visible version.

    As versions only become visible, a running maximum of (observation, vintage, value) by effective date does both steps.
    """
    effective = F.greatest("available_date", "vintage")
    rows = ledger.select("series_id", effective.alias("at"), F.lit(0).alias("tag"), F.struct("observation_date", "vintage", "value").alias("row"))
    calendar = ledger.select("series_id").distinct().join(F.broadcast(month_ends(ledger, start, end, "vintage", whole=False)), F.lit(True))
    marks = calendar.select("series_id", F.col("month_end").alias("at"), F.lit(1).alias("tag"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    w = Window.partitionBy("series_id").orderBy("at", "tag").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.unionByName(marks).withColumn("row", F.max("row").over(w)).where("tag = 1 and row is not null")
    return swept.select("series_id", F.col("at").alias("month_end"), "row.observation_date", "row.value")


def vintage_asof(archive: DataFrame, cutoff: str) -> DataFrame:
    """All rows of each series' newest vintage at the cutoff; nothing before the first."""
    known = archive.where(F.col("vintage") <= F.lit(cutoff).cast("date"))
    newest = known.groupBy("series_id").agg(F.max("vintage").alias("vintage"))
    return known.join(newest, ["series_id", "vintage"])


def vintage_asof_dates(archive: DataFrame, decisions: DataFrame) -> DataFrame:
    """The same at many decision dates (decision_date): the newest vintage by each date is found on distinct vintages, then its rows are joined."""
    vintages = archive.select("series_id", "vintage").distinct()
    rows = vintages.select("series_id", F.col("vintage").alias("at"), F.lit(0).alias("tag"), F.col("vintage"))
    marks = vintages.select("series_id").distinct().join(decisions.select("decision_date").distinct(), F.lit(True))
    marks = marks.select("series_id", F.col("decision_date").alias("at"), F.lit(1).alias("tag"), F.lit(None).cast("date").alias("vintage"))
    w = Window.partitionBy("series_id").orderBy("at", "tag").rowsBetween(Window.unboundedPreceding, 0)
    newest = rows.unionByName(marks).withColumn("vintage", F.max("vintage").over(w)).where("tag = 1 and vintage is not null")
    return archive.join(newest.select("series_id", F.col("at").alias("decision_date"), "vintage"), ["series_id", "vintage"])


def archive_coverage(archive: DataFrame) -> DataFrame:
    """Per series the earliest and latest vintage held; the earliest is the first date that can be replayed honestly."""
    return archive.groupBy("series_id").agg(F.min("vintage").alias("earliest"), F.max("vintage").alias("latest"), F.count_distinct("vintage").alias("vintages"))


def vintage_revisions(archive: DataFrame) -> DataFrame:
    """First and last value of each observation, and how often it changed."""
    w = Window.partitionBy("series_id", "observation_date").orderBy("vintage")
    moved = archive.withColumn("moved", (F.abs(F.col("value") - F.lag("value").over(w)) > 1e-12).cast("int"))
    return moved.groupBy("series_id", "observation_date").agg(F.min_by("value", "vintage").alias("first_value"), F.max_by("value", "vintage").alias("last_value"), F.sum(F.coalesce("moved", F.lit(0))).alias("revisions"))
