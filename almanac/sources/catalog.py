"""The catalog of series, factor configurations and universes as small tables, and checks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds, frequencies and fields of catalog entries.
KINDS = ("macro", "market", "rate", "fx", "commodity")
FREQUENCIES = ("daily", "weekly", "monthly", "quarterly")
FIELDS = ("provider", "symbol", "kind", "frequency", "release_lag_days", "notes")
SCHEMA = "key string, provider string, symbol string, kind string, frequency string, release_lag_days string, notes string"
COMPONENTS = "country string, factor string, component string, source string, transform string, periods int, weight double, sign double, optional boolean, inflation_source string, min_components int"


def parsed(text: str) -> dict:
    """A configuration text, JSON or YAML, as a mapping; YAML needs its library."""
    import json

    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError("the top level of a configuration must be a mapping")
    return found


def read_text(spark: SparkSession, path: str) -> str:
    """One small file as text, from any store that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]


def catalog_frame(spark: SparkSession, config: dict) -> DataFrame:
    """A row per series of ``{"series": {key: {...}}}``; fields that are not known are listed in ``extra``, and a lag that is no whole number stays text."""
    rows = []
    for key, entry in (config.get("series") or {}).items():
        if not isinstance(entry, dict):
            raise ValueError(f"{key}: an entry must be a mapping")
        lag = entry.get("release_lag_days", 0)
        whole = isinstance(lag, int) and not isinstance(lag, bool)
        rows.append((key, *[entry.get(f) for f in FIELDS[:4]], str(lag) if whole else repr(lag), entry.get("notes", ""), sorted(set(entry) - set(FIELDS))))
    return spark.createDataFrame(rows, SCHEMA + ", extra array<string>")


def components_frame(spark: SparkSession, config: dict) -> DataFrame:
    """A row per country, factor and component of ``{country: {factor: {min_components, components: {name: {...}}}}}``."""
    rows = []
    for country, factors in config.items():
        for factor, about in factors.items():
            for name, c in about["components"].items():
                rows.append((country, factor, name, c["source"], c.get("transform", "level"), c.get("periods"), float(c.get("weight", 1.0)), float(c.get("sign", 1.0)), bool(c.get("optional", False)), c.get("inflation_source"), about.get("min_components")))
    return spark.createDataFrame(rows, COMPONENTS)


def universe_frames(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """Companies and securities of ``{"companies": [...], "securities": [...]}``."""
    companies = [tuple(c.get(f) for f in ("company_id", "name", "domicile", "sector", "industry")) for c in config.get("companies") or []]
    securities = [tuple(x.get(f) for f in ("security_id", "ticker", "exchange", "currency", "security_type", "company_id")) for x in config.get("securities") or []]
    return (
        spark.createDataFrame(companies, "company_id string, name string, domicile string, sector string, industry string"),
        spark.createDataFrame(securities, "security_id string, ticker string, exchange string, currency string, security_type string, company_id string"),
    )


def _broken(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))


def catalog_violations(catalog: DataFrame) -> DataFrame:
    """(rule, key) of catalog entries: a required field that is missing, a field that is not known, a kind or frequency that is none, a lag that is no whole number or negative."""
    blank = {f"{c}_missing": F.coalesce(F.trim(c), F.lit("")) == "" for c in ("key", "provider", "symbol", "kind", "frequency")}
    lag = F.col("release_lag_days").try_cast("int")
    rules = blank | {
        "kind": F.col("kind").isNotNull() & ~F.col("kind").isin(*KINDS),
        "frequency": F.col("frequency").isNotNull() & ~F.col("frequency").isin(*FREQUENCIES),
        "lag_not_whole": lag.isNull() | ~F.col("release_lag_days").cast("string").rlike(r"^-?\d+$"),
        "lag_negative": lag < 0,
    }
    if "extra" in catalog.columns:
        rules["unknown_field"] = F.size("extra") > 0
    return catalog.select(F.explode(_broken(rules)).alias("rule"), "key")


def catalog_warnings(catalog: DataFrame) -> DataFrame:
    """(warning, keys): entries that load but look wrong: several keys of one provider's symbol, slow series without a lag, daily ones with more than three days."""
    shared = catalog.groupBy("provider", "symbol").agg(F.array_sort(F.collect_list("key")).alias("keys")).where(F.size("keys") > 1).select(F.lit("shared_symbol").alias("warning"), "keys")
    lag = F.col("release_lag_days").try_cast("int")
    rules = {"no_lag": (lag == 0) & F.col("frequency").isin("monthly", "quarterly"), "long_daily_lag": (F.col("frequency") == "daily") & (lag > 3)}
    each = catalog.select(F.explode(_broken(rules)).alias("warning"), F.array("key").alias("keys"))
    return shared.unionByName(each)


def catalog_audit(catalog: DataFrame) -> DataFrame:
    """(level, finding, keys): errors and warnings together."""
    errors = catalog_violations(catalog).select(F.lit("error").alias("level"), F.col("rule").alias("finding"), F.array("key").alias("keys"))
    return errors.unionByName(catalog_warnings(catalog).select(F.lit("warning").alias("level"), F.col("warning").alias("finding"), "keys"))
