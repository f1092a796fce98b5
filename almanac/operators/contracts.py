"""Observation contracts: normal form, dates of release, policies, and violations as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.columns import BASES, POLICIES

EVIDENCED = BASES[:2]
REQUIRED = ("observation_date", "value", "availability_basis")
OPTIONAL = ("available_date", "availability_evidence_url", "availability_lag_days", "observation_period", "source_value_url")
#: Columns that normal observations start with, where they have them.
ORDER = ("series_id", "observation_date", "value", "available_date", "availability_basis", "availability_evidence_url", "availability_lag_days")
HTTP = "^https?://"


def as_date(df: DataFrame, name: str) -> Column:
    """A column as a date; text that is none becomes null."""
    return F.try_to_date(F.substring(F.trim(F.col(name)), 1, 10), "yyyy-MM-dd") if dict(df.dtypes)[name] == "string" else F.col(name).cast("date")


def normalize_observations(df: DataFrame, dated_rows_basis: str = "unverified") -> DataFrame:
    """Typed observations in a fixed column order; a blank label is none, a dated row without label gets the default, an undated one ``unknown``.

    No date is made up: one that does not parse is null, and stays so.
    """
    if dated_rows_basis not in BASES or dated_rows_basis in EVIDENCED:
        raise ValueError("a default basis must be known and cannot claim evidence")
    if lacking := {"observation_date", "value"} - set(df.columns):
        raise ValueError(f"observations lack {sorted(lacking)}")
    out = df.withColumn("observation_date", as_date(df, "observation_date")).withColumn("value", F.col("value").try_cast("double"))
    if "available_date" in df.columns:
        out = out.withColumn("available_date", as_date(df, "available_date"))
    dated = F.col("available_date").isNotNull() if "available_date" in df.columns else F.lit(False)
    label = F.nullif(F.trim("availability_basis"), F.lit("")) if "availability_basis" in df.columns else F.lit(None).cast("string")
    out = out.withColumn("availability_basis", F.coalesce(label, F.when(dated, F.lit(dated_rows_basis)).otherwise("unknown")))
    return out.select(*[c for c in ORDER if c in out.columns], *[c for c in out.columns if c not in ORDER])


def attach_lag(df: DataFrame, lag: str = "lag_days") -> DataFrame:
    """Release dates estimated as observation date plus a lag in days."""
    return df.withColumn("available_date", F.date_add("observation_date", F.col(lag))).withColumn("availability_basis", F.lit("fixed_lag"))


def apply_policy(df: DataFrame, policy: str) -> DataFrame:
    """Rows whose basis the policy admits."""
    return df.where(F.col("availability_basis").isin(*POLICIES[policy]))


def resolve_dates(df: DataFrame, lag: str = "lag_days") -> DataFrame:
    """Series without any date get their lag; elsewhere dated rows of basis ``unknown`` become ``unverified``.

    A series without dates that claims evidence is not resolved: ``unproven_claims`` lists it, and its rows keep their basis.
    """
    stats = df.groupBy("series_id").agg((F.count("available_date") > 0).alias("has_dates"), F.max(F.col("availability_basis").isin(*EVIDENCED)).alias("claims"))
    out = df.join(stats, "series_id").withColumn("claims", ~F.col("has_dates") & F.coalesce("claims", F.lit(False)))
    lagged = ~F.col("has_dates") & ~F.col("claims")
    basis = F.when(lagged, "fixed_lag").when(F.col("available_date").isNotNull() & (F.col("availability_basis") == "unknown"), "unverified")
    date = F.when(lagged, F.date_add("observation_date", F.col(lag))).otherwise(F.col("available_date"))
    return out.withColumn("availability_basis", basis.otherwise(F.col("availability_basis"))).withColumn("available_date", date).drop("has_dates", "claims")


def unproven_claims(df: DataFrame) -> DataFrame:
    """(series_id, n): series without any release date, and how many of their rows claim evidence of one."""
    by = df.groupBy("series_id").agg(F.count("available_date").alias("dates"), F.count(F.when(F.col("availability_basis").isin(*EVIDENCED), 1)).alias("n"))
    return by.where("dates = 0 and n > 0").select("series_id", "n")


def column_report(df: DataFrame) -> DataFrame:
    """(level, column): required columns that are missing (error), and columns that are not known (warning); no job runs."""
    known = {*REQUIRED, *OPTIONAL, "series_id"}
    found = [("error", c) for c in REQUIRED if c not in df.columns] + [("warning", c) for c in df.columns if c not in known]
    return df.sparkSession.createDataFrame(found, "level string, column string")


def row_rules(df: DataFrame) -> dict[str, Column]:
    """What makes a row break each rule, for the columns that the frame has."""
    basis, observed = F.trim("availability_basis"), as_date(df, "observation_date")
    evidenced = F.coalesce(basis.isin(*EVIDENCED), F.lit(False))
    rules = {
        "bad_date": observed.isNull(),
        "missing_value": F.col("value").try_cast("double").isNull() | F.isnan(F.col("value").try_cast("double")),
        "bad_basis": ~F.coalesce(basis.isin(*BASES), F.lit(False)),
    }
    if "available_date" in df.columns:
        available = as_date(df, "available_date")
        start = observed
        if "observation_period" in df.columns:
            month = F.nullif(F.regexp_extract("observation_period", r"^(\d{4}-\d{2})", 1), F.lit(""))
            start = F.coalesce(F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd"), observed)
        rules |= {"basis_without_date": (basis != "unknown") & available.isNull(), "unknown_with_date": (basis == "unknown") & available.isNotNull(), "look_ahead": available < start}
    if "source_value_url" in df.columns:
        url = F.coalesce(F.trim("source_value_url"), F.lit(""))
        rules |= {"source_url_missing": url == "", "source_url_not_http": (url != "") & ~url.rlike(HTTP)}
    if "availability_evidence_url" in df.columns:
        url = F.coalesce(F.trim("availability_evidence_url"), F.lit(""))
        rules |= {"evidence_missing": evidenced & (url == ""), "evidence_not_http": evidenced & (url != "") & ~url.rlike(HTTP)}
    else:
        rules |= {"evidence_missing": evidenced}
    return rules


def violations(df: DataFrame, require_available_date: bool = False) -> DataFrame:
    """(rule, series_id, observation_date) for every broken rule; duplicates count once per key, an undated series once.

    The frame needs the required columns; ``column_report`` says which it lacks.
    """
    if lacking := set(REQUIRED) - set(df.columns):
        raise ValueError(f"observations lack {sorted(lacking)}")
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in row_rules(df).items()]))
    date = as_date(df, "observation_date").alias("observation_date")
    rows = df.select(F.explode(broken).alias("rule"), "series_id", date)
    keyed = df.select("series_id", date).where("observation_date is not null")
    twice = keyed.groupBy("series_id", "observation_date").count().where("count > 1").select(F.lit("duplicate_date").alias("rule"), "series_id", "observation_date")
    out = rows.unionByName(twice)
    if require_available_date:
        dated = as_date(df, "available_date") if "available_date" in df.columns else F.lit(None)
        undated = df.groupBy("series_id").agg(F.count(dated).alias("n")).where("n = 0")
        out = out.unionByName(undated.select(F.lit("no_available_date").alias("rule"), "series_id", F.lit(None).cast("date").alias("observation_date")))
    return out


def contract_report(df: DataFrame, require_available_date: bool = False) -> DataFrame:
    """Per series: rows, dated rows, errors, dated rows on an unevidenced basis (a warning), and whether the contract holds."""
    dated = as_date(df, "available_date").isNotNull() if "available_date" in df.columns else F.lit(False)
    weak = dated & F.trim("availability_basis").isin(*BASES[2:])
    by = df.groupBy("series_id").agg(F.count("*").alias("n_rows"), F.count(F.when(dated, 1)).alias("n_dated"), F.count(F.when(weak, 1)).alias("n_unevidenced"))
    errors = violations(df, require_available_date).groupBy("series_id").agg(F.count("*").alias("n_errors"))
    return by.join(errors, "series_id", "left").fillna(0, ["n_errors"]).withColumn("ok", F.col("n_errors") == 0)


def lag_violations(df: DataFrame, sidecar: DataFrame) -> DataFrame:
    """(series_id, observation_date, available_date, expected) of ``fixed_lag`` rows off the lag that their series' sidecar states."""
    expected = F.date_add("observation_date", F.col("availability_lag_days").cast("int"))
    rows = df.where("availability_basis = 'fixed_lag'").drop("availability_lag_days").join(sidecar.select("series_id", "availability_lag_days"), "series_id", "left")
    return rows.withColumn("expected", expected).where(~F.col("available_date").eqNullSafe(F.col("expected"))).select("series_id", "observation_date", "available_date", "expected")


def basis_counts(df: DataFrame) -> DataFrame:
    """Rows per series and basis, with zeros."""
    labels = df.sparkSession.createDataFrame([(b,) for b in BASES], "availability_basis string")
    grid = df.select("series_id").distinct().join(F.broadcast(labels), F.lit(True))  # five labels
    found = df.groupBy("series_id", "availability_basis").agg(F.count("*").alias("n"))
    return grid.join(found, ["series_id", "availability_basis"], "left").fillna(0, ["n"])


def validate_snapshots(df: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Per series: rows, first and last observation, rows per basis with zeros, errors of the contract and of the stated lag, and whether all is well."""
    kinds = [F.count(F.when(F.col("availability_basis") == b, 1)).alias(f"n_{b}") for b in BASES]
    by = df.groupBy("series_id").agg(F.count("*").alias("n_rows"), F.min("observation_date").alias("first_date"), F.max("observation_date").alias("last_date"), *kinds)
    errors = violations(df).select("series_id").unionByName(lag_violations(df, sidecar).select("series_id")).groupBy("series_id").agg(F.count("*").alias("n_errors"))
    return by.join(errors, "series_id", "left").fillna(0, ["n_errors"]).withColumn("ok", F.col("n_errors") == 0)


def quality_flags(df: DataFrame) -> DataFrame:
    """Flags of ledger rows as an array; what a ledger lacks in columns raises no flag."""
    has = set(df.columns)
    no = F.lit(False)
    evidence = F.coalesce(F.col("availability_evidence_url") != "", no) if "availability_evidence_url" in has else F.lit(True)
    proven = F.coalesce(F.col("availability_basis") == "official_release", no) & evidence
    period = F.coalesce("observation_period", F.lit("")) if "observation_period" in has else F.lit("")
    title = F.coalesce("source_title", F.lit("")) if "source_title" in has else F.lit("")
    flags = {
        "release_date_has_official_evidence": proven,
        "release_date_unknown": ~proven,
        "multi_month_period": period.contains("/"),
        "joint_period_release": period.rlike(r"^\d{4}-01/\d{4}-02$"),
        "cumulative_ytd_yoy_as_reported": F.coalesce(F.col("series_id").isin(*CUMULATIVE), no),
        "methodology_change_review": title.rlike(METHODOLOGY),
        "seeded_from_frozen_pr13_snapshot": F.coalesce(F.col("seeded"), no) if "seeded" in has else no,
    }
    return df.withColumn("quality_flags", F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in flags.items()])))


#: Series that are reported as growth of the year to date, and the words of a title that ask for a review.
CUMULATIVE = ("cn_fixed_asset_investment", "cn_retail_sales_ytd")
METHODOLOGY = "统计口径|统计范围|统计制度|口径调整|修订|调整"


def require(found: DataFrame) -> None:
    """Raise if a violations table has rows; one small action."""
    if bad := found.limit(20).collect():
        raise ValueError(f"violations: {bad}")
