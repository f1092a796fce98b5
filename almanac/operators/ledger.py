"""Append-only ledgers of releases: change classes, vintages, audits, latest metrics, report coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators.asof import eligible_rows, latest

KEY = ["series_id", "observation_date"]
#: Besides the value, what makes a record of a key another one.
COMPARED = ("available_date", "source_value_url", "availability_evidence_url", "source_url")
#: Changes of a value from which a release asks for a review, by series, and the limit of all other series.
LIMITS = {
    "cn_pmi_new_orders": 8.0,
    "cn_cpi": 3.0,
    "cn_core_cpi": 3.0,
    "cn_ppi": 5.0,
    "cn_industrial_production": 8.0,
    "cn_retail_sales": 8.0,
    "cn_retail_sales_ytd": 8.0,
    "cn_fixed_asset_investment": 8.0,
    "cn_m1": 10.0,
    "cn_m2": 10.0,
    "cn_tsf_stock_yoy": 10.0,
}
OTHER_LIMIT = 10.0
#: Words for a missing date.
NO_DATE = ("", "nan", "nat", "unknown")


def iso_date(text: Column) -> Column:
    """A date of text; null for what stands for none."""
    return F.when(~F.lower(F.trim(text)).isin(*NO_DATE), F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd"))


def shanghai_timestamp(text: Column) -> Column:
    """An instant of text; one without an offset is Shanghai time. Null for what stands for none."""
    clean = F.when(~F.lower(F.trim(text)).isin(*NO_DATE), F.trim(text))
    has_zone = clean.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & clean.rlike(r"\d{2}:\d{2}")
    return F.when(has_zone, F.try_to_timestamp(clean)).otherwise(F.try_to_timestamp(F.concat(F.when(F.length(clean) <= 10, F.concat(clean, F.lit(" 00:00:00"))).otherwise(clean), F.lit("+08:00"))))


def covered_months(period: Column) -> Column:
    """First days of the months that a period text names: ``2024-03``, or ``2024-01/2024-02``; null for other text."""
    first = F.try_to_date(F.concat(F.nullif(F.regexp_extract(period, r"^(\d{4}-\d{2})(?:/(\d{4}-\d{2}))?$", 1), F.lit("")), F.lit("-01")), "yyyy-MM-dd")
    last = F.try_to_date(F.concat(F.nullif(F.regexp_extract(period, r"^(\d{4}-\d{2})(?:/(\d{4}-\d{2}))?$", 2), F.lit("")), F.lit("-01")), "yyyy-MM-dd")
    return F.when(first.isNotNull(), F.sequence(first, F.greatest(first, F.coalesce(last, first)), F.expr("interval 1 month")))


def broken_rules() -> Column:
    """The rules that a ledger record breaks, as an array."""
    basis, http = F.col("availability_basis"), "^https?://"
    dated, evidence = F.col("available_date").isNotNull(), F.coalesce("availability_evidence_url", F.lit(""))
    rules = {
        "series_missing": F.coalesce(F.trim("series_id"), F.lit("")) == "",
        "period_missing": F.coalesce(F.trim("observation_period"), F.lit("")) == "",
        "unit_missing": F.coalesce(F.trim("unit"), F.lit("")) == "",
        "source_url": ~F.coalesce("source_value_url", F.lit("")).rlike(http),
        "official_unproven": (basis == "official_release") & ~(dated & evidence.rlike(http)),
        "unknown_with_date": (basis == "unknown") & dated,
        "date_missing": ~basis.isin("official_release", "unknown") & ~dated,
        "value": F.col("value").try_cast("double").isNull() | F.isnan(F.col("value").try_cast("double")),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(k)) for k, t in rules.items()]))


def record_violations(df: DataFrame) -> DataFrame:
    """(rule, series_id, observation_period) of ledger records that can't be stored."""
    return df.select(F.explode(broken_rules()).alias("rule"), "series_id", "observation_period")


def ledger_changes(batch: DataFrame, ledger: DataFrame, processed: str | None = None, key: list[str] | None = None) -> DataFrame:
    """Each row of a batch with its ``event``: new_release, historical_revision (another value), provenance_update (another date or address) or unchanged.

    A row is compared with the one before it: rows of a key follow the stored versions, the latest of them last, in order of ``arrival`` if the
    batch has it, then of ``retrieved_at``, then of value, so a key that comes twice is chained by time. ``old_value`` and ``old_vintage`` are of
    the version that it is compared with. With ``processed``, a date, new versions get their vintage: that date for a change, the
    release date for an official new release, none otherwise. Stored and new rows are swept once, in one shuffle.
    """
    key = key or (["series_id", "observation_period"] if "observation_period" in batch.columns else KEY)
    compared = [c for c in COMPARED if c in batch.columns and c in ledger.columns]
    timed = "retrieved_at" in batch.columns and "retrieved_at" in ledger.columns
    arrival = F.col("arrival") if "arrival" in batch.columns else F.lit(0)
    stored = ledger.withColumn("_tag", F.lit(0)).withColumn("_at", F.lit(None).cast("long"))
    rows = batch.withColumn("_tag", F.lit(1)).withColumn("_at", arrival.cast("long")).drop("arrival")
    both = rows.unionByName(stored, allowMissingColumns=True)
    version = F.when(F.col("_tag") == 0, F.col("vintage")).asc_nulls_first()  # of stored rows; the vintage of a new row follows from its event
    instant = [F.col("retrieved_at").asc_nulls_first()] if timed else []
    w = Window.partitionBy(*key).orderBy("_tag", version, F.col("_at").asc_nulls_first(), *instant, "value", *compared)
    before = F.lag(F.struct(F.lit(True).alias("there"), "value", *compared)).over(w)
    both = both.withColumn("_was", before).withColumn("old_value", F.col("_was.value"))
    moved = F.lit(False)
    for c in compared:
        moved = moved | ~F.col(c).eqNullSafe(F.col(f"_was.{c}"))
    kind = F.when(F.col("_tag") == 0, "stored").when(F.col("_was.there").isNull(), "new_release").when(F.abs(F.col("value") - F.col("old_value")) > 1e-12, "historical_revision").when(moved, "provenance_update").otherwise("unchanged")
    both = both.withColumn("event", kind)
    if processed is not None:
        official = F.when(F.col("availability_basis") == "official_release", F.col("available_date")) if "availability_basis" in batch.columns else F.lit(None).cast("date")
        both = both.withColumn("vintage", F.when(F.col("event") == "new_release", official).when(F.col("event").isin("historical_revision", "provenance_update"), F.lit(processed).cast("date")).otherwise(F.col("vintage")))
    kept = F.when(F.col("event") != "unchanged", F.struct("vintage"))
    both = both.withColumn("old_vintage", F.last(kept, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))["vintage"])
    return both.where("_tag = 1").drop("_tag", "_at", "_was")


def valid_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that a ledger accepts, and the others with a ``rules`` array of what is wrong with them, as in ``record_violations``."""
    marked = df.withColumn("rules", broken_rules())
    return marked.where(F.size("rules") == 0).drop("rules"), marked.where(F.size("rules") > 0)


def append_batch(batch: DataFrame, ledger: DataFrame, processed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch of records against a ledger: rows to append, events, and invalid records with the rules that they break.

    Records are checked, flagged, chained by time, and get their vintage in one plan. A row's flags are made of its own fields, a change
    adds its event. Appending the rows and running the batch again gives none.
    """
    from almanac.operators.contracts import quality_flags

    good, bad = valid_records(batch)
    changes = ledger_changes(quality_flags(good), ledger, processed)
    return _changed(changes, ledger), change_events(changes), bad


def _changed(changes: DataFrame, ledger: DataFrame) -> DataFrame:
    rows = changes.where("event <> 'unchanged'")
    if "quality_flags" in ledger.columns:
        flags = F.coalesce("quality_flags", F.array().cast("array<string>")) if "quality_flags" in rows.columns else F.array().cast("array<string>")
        rows = rows.withColumn("quality_flags", F.when(F.col("event") == "new_release", flags).otherwise(F.array_append(flags, F.col("event"))))
    return rows.select(*[c for c in ledger.columns if c in rows.columns])


def append_changes(batch: DataFrame, ledger: DataFrame, processed: str | None = None) -> DataFrame:
    """Only the rows that change the ledger, in its columns; appending them twice adds nothing. Flags of a row, if there, name its change. ``append_batch`` checks and flags records too."""
    return _changed(ledger_changes(batch, ledger, processed), ledger)


def change_events(changes: DataFrame) -> DataFrame:
    """(event, series_id, observation_period, old_value, new_value, old_vintage, new_vintage) of ``ledger_changes``, what is unchanged left out."""
    period = F.col("observation_period") if "observation_period" in changes.columns else F.date_format("observation_date", "yyyy-MM")
    vintage = F.col("vintage") if "vintage" in changes.columns else F.lit(None).cast("date")
    return changes.where("event <> 'unchanged'").select("event", "series_id", period.alias("observation_period"), "old_value", F.col("value").alias("new_value"), "old_vintage", vintage.alias("new_vintage"))


def seed_ledger(snapshots: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Ledger rows of frozen snapshots: the release date is the vintage, an unknown one has none; the sidecar gives unit and time of download."""
    known = F.coalesce("availability_basis", F.lit("unknown")) != "unknown"
    rows = snapshots.join(sidecar.select("series_id", "unit", F.col("downloaded_at").alias("retrieved_at")), "series_id")
    rows = rows.withColumn("available_date", F.when(known, F.col("available_date"))).withColumn("vintage", F.col("available_date")).withColumn("seeded", F.lit(True))
    return rows.withColumn("observation_period", F.coalesce(F.nullif(F.trim("observation_period"), F.lit("")), F.date_format("observation_date", "yyyy-MM")))


def missing_periods(df: DataFrame) -> DataFrame:
    """(series_id, month_end) between a series' first and last month that it lacks."""
    have = df.select("series_id", F.last_day("observation_date").alias("month_end")).distinct()
    span = have.groupBy("series_id").agg(F.min("month_end").alias("a"), F.max("month_end").alias("b"))
    grid = span.select("series_id", F.explode(F.expr("sequence(trunc(a, 'MM'), trunc(b, 'MM'), interval 1 month)")).alias("m")).select("series_id", F.last_day("m").alias("month_end"))
    return grid.join(have, ["series_id", "month_end"], "left_anti")


def classified_gaps(df: DataFrame) -> DataFrame:
    """``missing_periods`` with a class: structural where the next month's row is a joint release of both, unresolved otherwise."""
    joint = df.where(F.col("observation_period").rlike(r"^\d{4}-\d{2}/\d{4}-\d{2}$")).select("series_id", F.last_day(F.add_months("observation_date", -1)).alias("month_end"), F.lit(True).alias("joint")).distinct()
    return missing_periods(df).join(joint, ["series_id", "month_end"], "left").select("series_id", "month_end", F.when(F.col("joint"), "structural").otherwise("unresolved").alias("gap"))


def current_versions(ledger: DataFrame, as_of: str) -> DataFrame:
    """Per series and period the latest version whose release and vintage are known at the date."""
    cutoff = F.lit(as_of).cast("date")
    known = ledger.where((F.col("available_date") <= cutoff) & (F.col("vintage") <= cutoff))
    return latest(known, ["series_id", "observation_period"], "vintage", "retrieved_at")


def missing_months(versions: DataFrame, most: int = 48) -> DataFrame:
    """(series_id, months, truncated, n): months that no period of a series covers, joint periods covering all of theirs; the first ``most`` are named."""
    have = versions.select("series_id", F.explode(covered_months(F.col("observation_period"))).alias("month")).distinct()
    span = have.groupBy("series_id").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    grid = span.select("series_id", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    gone = grid.join(have, ["series_id", "month"], "left_anti").groupBy("series_id").agg(F.array_sort(F.collect_list(F.date_format("month", "yyyy-MM"))).alias("all"))  # months of one series
    return gone.select("series_id", F.slice("all", 1, most).alias("months"), (F.size("all") > most).alias("truncated"), F.size("all").alias("n"))


def publication_lag(df: DataFrame) -> DataFrame:
    """Per series: mean and greatest days from observation to release, and how many exceed 45."""
    lag = F.datediff("available_date", "observation_date")
    return df.where("available_date is not null").groupBy("series_id").agg(F.avg(lag).alias("mean_lag"), F.max(lag).alias("max_lag"), F.count(F.when(lag > 45, 1)).alias("late"))


def stale_series(df: DataFrame, as_of: str, limit: int = 75) -> DataFrame:
    """Series whose last observation is older than the limit at the date."""
    last = df.groupBy("series_id").agg(F.max("observation_date").alias("last_date"))
    return last.withColumn("age_days", F.datediff(F.lit(as_of).cast("date"), "last_date")).where(F.col("age_days") > limit)


def large_changes(df: DataFrame, limit: float) -> DataFrame:
    """Observations that differ from the one before by more than the limit, relatively."""
    w = Window.partitionBy("series_id").orderBy("observation_date")
    rows = df.withColumn("previous", F.lag("value").over(w))
    return rows.withColumn("change", F.try_divide(F.col("value"), F.col("previous")) - 1).where(F.abs("change") > limit).select("series_id", "observation_date", "value", "previous", "change")


def limit_of(series: Column, limits: dict[str, float] | None = None) -> Column:
    """A series' review limit."""
    known = LIMITS if limits is None else limits
    return F.coalesce(F.create_map(*[x for k, most in known.items() for x in (F.lit(k), F.lit(most))])[series], F.lit(OTHER_LIMIT)) if known else F.lit(OTHER_LIMIT)


def quality_audit(ledger: DataFrame, events: DataFrame, as_of: str, limits: dict[str, float] | None = None, stale_days: int = 75, late_days: int = 45) -> DataFrame:
    """(finding, series_id, observation_period, amount) at a date: what a reviewer should look at, and counts of events and unknown dates.

    Releases of a series are ordered by release date; the last is compared with the one before. Nothing here is taken for an error.
    """
    versions = current_versions(ledger, as_of)
    w = Window.partitionBy("series_id").orderBy("available_date", "observation_period")
    rows = versions.withColumn("previous", F.lag("value").over(w)).withColumn("last", F.lead("value").over(w).isNull() & (F.row_number().over(w) == F.count("*").over(Window.partitionBy("series_id"))))
    final = rows.where("last")
    age, lag = F.datediff(F.lit(as_of).cast("date"), "available_date"), F.datediff("available_date", "observation_date")
    limit = limit_of(F.col("series_id"), limits)
    change = F.col("value") - F.col("previous")
    found = F.array_compact(
        F.array(
            F.when(age > stale_days, F.struct(F.lit("stale_series").alias("finding"), age.cast("double").alias("amount"))),
            F.when(lag > late_days, F.struct(F.lit("unusual_publication_lag").alias("finding"), lag.cast("double").alias("amount"))),
            F.when(F.abs(change) >= limit, F.struct(F.lit("large_change").alias("finding"), change.alias("amount"))),
        )
    )
    per_final = final.select(F.explode(found).alias("f"), "series_id", "observation_period").select("f.finding", "series_id", "observation_period", "f.amount")
    nothing, text = F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string")
    gaps = missing_months(versions).select(F.lit("missing_periods").alias("finding"), "series_id", F.array_join("months", ",").alias("observation_period"), F.col("n").cast("double").alias("amount"))
    reviews = ledger.where(F.array_contains("quality_flags", "methodology_change_review")).select(F.lit("methodology_change_review").alias("finding"), "series_id", "observation_period", nothing)
    moved = F.col("new_value") - F.col("old_value")
    revisions = events.where((F.col("event") == "historical_revision") & (F.abs(moved) >= limit)).select(F.lit("large_revision").alias("finding"), "series_id", "observation_period", moved.alias("amount"))
    counts = events.groupBy(F.col("event").alias("finding")).agg(F.count("*").cast("double").alias("amount")).select("finding", text.alias("series_id"), text.alias("observation_period"), "amount")
    unknown = ledger.agg(F.count(F.when(F.col("availability_basis") == "unknown", 1)).cast("double").alias("amount")).select(F.lit("unknown_release_dates").alias("finding"), text.alias("series_id"), text.alias("observation_period"), "amount")
    out = per_final
    for more in (gaps, reviews, revisions, counts, unknown):
        out = out.unionByName(more)
    return out


def latest_metrics(df: DataFrame) -> DataFrame:
    """Last observation of each series, the one before and the change."""
    w = Window.partitionBy("series_id").orderBy("observation_date")
    rows = df.withColumn("previous", F.lag("value").over(w))
    return latest(rows, ["series_id"], "observation_date").select("series_id", "observation_date", "value", "previous", (F.col("value") - F.col("previous")).alias("change"))


def metric_status(ledger: DataFrame, series: DataFrame, as_of: str) -> DataFrame:
    """(series_id, status, observation_period, value, previous, change) of every configured series at a date.

    ``available`` with the last official observation, ``unknown_release_date`` with the last stored one without a date, or ``not_collected``.
    """
    versions = latest(eligible_rows(ledger, as_of), ["series_id", "observation_period"], "vintage", "retrieved_at")
    w = Window.partitionBy("series_id").orderBy("observation_date", "effective", "available_date")
    rows = versions.withColumn("previous", F.lag("value").over(w))
    now = latest(rows, ["series_id"], "observation_date", "effective", "available_date").select("series_id", "observation_period", "value", "previous")
    undated = ledger.where((F.col("availability_basis") == "unknown") & (F.col("retrieved_at").cast("date") <= F.lit(as_of).cast("date")))
    last = latest(undated, ["series_id"], "retrieved_at", "observation_date").select("series_id", F.col("observation_period").alias("u_period"), F.col("value").alias("u_value"))
    out = series.select("series_id").distinct().join(now, "series_id", "left").join(last, "series_id", "left")
    known, other = F.col("value").isNotNull(), F.col("u_value").isNotNull()
    return out.select(
        "series_id",
        F.when(known, "available").when(other, "unknown_release_date").otherwise("not_collected").alias("status"),
        F.when(known, F.col("observation_period")).otherwise(F.col("u_period")).alias("observation_period"),
        F.coalesce("value", "u_value").alias("value"),
        "previous",
        (F.col("value") - F.col("previous")).alias("change"),
    )


def ledger_coverage(ledger: DataFrame) -> DataFrame:
    """Per series: rows, distinct observations, revisions, first and last."""
    return ledger.groupBy("series_id").agg(F.count("*").alias("n_rows"), F.count_distinct("observation_date").alias("observations"), F.min("observation_date").alias("first_date"), F.max("observation_date").alias("last_date")).withColumn("revisions", F.col("n_rows") - F.col("observations"))


def report_coverage(ledger: DataFrame, series: DataFrame, as_of: str) -> DataFrame:
    """One row at a date: configured series, those with official rows, those without by name, official rows, share with evidence, undated rows, last retrieval."""
    rows = latest(eligible_rows(ledger, as_of), ["series_id", "observation_period"], "vintage", "retrieved_at")
    there = series.select("series_id").distinct().join(rows.select("series_id", F.lit(True).alias("there")).distinct(), "series_id", "left")
    configured = there.agg(F.count("*").alias("configured"), F.count("there").alias("with_official"), F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("series_id")))).alias("without_official"))  # configured names
    official = rows.agg(F.count("*").alias("official_rows"), F.coalesce(F.avg(F.coalesce(F.col("availability_evidence_url").rlike("^https?://"), F.lit(False)).cast("double")), F.lit(0.0)).alias("evidence_rate"))
    stored = ledger.agg(F.count(F.when(F.col("availability_basis") == "unknown", 1)).alias("unknown_rows"), F.max("retrieved_at").alias("updated_at"))
    return configured.join(official, F.lit(True)).join(stored, F.lit(True))  # one row each


def snapshot_profile(obs: DataFrame) -> DataFrame:
    """Per series: rows, first and last observation, official and unknown rows, rows with evidence, and the median days to release."""
    return obs.groupBy("series_id").agg(
        F.count("*").alias("n_rows"),
        F.min("observation_date").alias("first_date"),
        F.max("observation_date").alias("last_date"),
        F.count(F.when(F.col("availability_basis") == "official_release", 1)).alias("official"),
        F.count(F.when(F.col("availability_basis") == "unknown", 1)).alias("unknown"),
        F.count(F.nullif("availability_evidence_url", F.lit(""))).alias("with_evidence"),
        F.median(F.datediff("available_date", "observation_date")).alias("median_lag"),
    )


#: What a unit is shown as, what its changes are shown as where that differs, and names of regimes.
UNIT_LABELS = {"percent_yoy": "%", "percent_ytd_yoy": "%", "yield_percent": "%", "percent": "%", "index_points": "点"}
CHANGE_LABELS = {"percent_yoy": "个百分点", "percent_ytd_yoy": "个百分点"}
REGIME_LABELS = {"goldilocks": "增长改善 / 通胀回落", "reflation": "增长改善 / 通胀上行", "stagflation": "增长走弱 / 通胀上行", "recession": "增长走弱 / 通胀回落"}


def labelled(column: Column, labels: dict[str, str]) -> Column:
    """The label of a value; a value without one stands for itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[column], column)


def displayed(df: DataFrame) -> DataFrame:
    """Rows with how their value is reported (growth of the year to date, or the unit), and the units of value and change as shown."""
    from almanac.operators.contracts import CUMULATIVE

    shown = labelled(F.col("unit"), UNIT_LABELS)
    change = F.when(F.col("unit").isin(*CHANGE_LABELS), labelled(F.col("unit"), CHANGE_LABELS)).otherwise(shown)
    reported = F.when(F.col("series_id").isin(*CUMULATIVE), "cumulative_ytd_yoy").otherwise(F.col("unit"))
    return df.withColumn("reported_as", reported).withColumn("shown_unit", shown).withColumn("change_unit", change)


def union_batches(*batches: DataFrame) -> DataFrame:
    """Records of several sources under one another; columns that a source lacks are null."""
    out = batches[0]
    for more in batches[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def macro_report(ledger: DataFrame, events: DataFrame, config: DataFrame, series: DataFrame, as_of: str, least: int = 36, limits: dict[str, float] | None = None) -> DataFrame:
    """(section, name, status, value, previous, change, note) of a macro report at a date, from the ledger alone.

    Sections: metrics, factors, contributions, regime, coverage and quality. Factors see each month only what was official and known then. The
    ledger's columns that are needed, the scores and the factors are written once, as all sections derive from them.
    """
    from almanac.operators import factors as f
    from almanac.operators.asof import vintage_panel
    from almanac.sources.shared import written

    needed = ("series_id", "observation_period", "observation_date", "available_date", "availability_basis", "availability_evidence_url", "retrieved_at", "value", "vintage", "quality_flags")
    ledger = written(ledger.select(*[c for c in needed if c in ledger.columns]), "report-ledger")
    rows = eligible_rows(ledger, as_of)
    panel = written(vintage_panel(rows, end=as_of).select("series_id", "month_end", "value"), "report-panel")
    scores = written(f.expanding_zscore(f.transforms(panel, config), least), "report-scores")
    composite = written(f.all_factors(f.composite(scores), panel, config), "report-factors")

    def part(df: DataFrame, section: str, name: Column, **columns: Column) -> DataFrame:
        kinds = {"status": "string", "value": "double", "previous": "double", "change": "double", "note": "string"}
        return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), *[columns.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    metrics = part(metric_status(ledger, series, as_of), "metrics", F.col("series_id"), status=F.col("status"), value=F.col("value"), previous=F.col("previous"), change=F.col("change"), note=F.col("observation_period"))
    status = part(f.factor_status(composite), "factors", F.col("factor"), status=F.col("status"), value=F.col("score"), previous=F.col("previous"), change=F.col("change"), note=F.col("state"))
    shares = part(f.contributions(scores, config), "contributions", F.concat_ws("/", "factor", "component"), value=F.col("contribution"))
    quadrant = part(f.regime_latest(f.regimes(composite)), "regime", F.col("regime"), status=F.lit("available"), note=F.col("previous"))
    coverage = report_coverage(ledger, series, as_of).select(F.explode(F.create_map(*[x for c in ("configured", "with_official", "official_rows", "evidence_rate", "unknown_rows") for x in (F.lit(c), F.col(c).cast("double"))])).alias("name", "value"))
    covered = part(coverage, "coverage", F.col("name"), value=F.col("value"))
    audit = quality_audit(ledger, events, as_of, limits)
    quality = part(audit, "quality", F.concat_ws("/", "finding", "series_id"), value=F.col("amount"), note=F.col("observation_period"))
    out = metrics
    for more in (status, shares, quadrant, covered, quality):
        out = out.unionByName(more)
    return out
