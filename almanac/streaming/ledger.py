"""The ledger as a stream: validated micro-batches appended once, whatever is retried, and an as-of view kept up to date."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from almanac.operators.asof import asof_month_end
from almanac.operators.ledger import COMPARED, KEY


def accepted(has: set[str]) -> Column:
    """Whether a ledger accepts a row of these columns: key and value there, official rows proven, unknown ones undated, addresses http(s)."""
    ok = F.col("series_id").isNotNull() & F.col("observation_date").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")
    if "availability_basis" in has:
        dated, basis = F.col("available_date").isNotNull(), F.col("availability_basis")
        evidence = F.coalesce("availability_evidence_url", F.lit("")).rlike("^https?://") if "availability_evidence_url" in has else F.lit(True)
        ok = ok & F.when(basis == "official_release", dated & evidence).when(basis == "unknown", ~dated).otherwise(dated)
    if "source_value_url" in has:
        ok = ok & F.coalesce("source_value_url", F.lit("")).rlike("^https?://")
    return F.coalesce(ok, F.lit(False))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that a ledger accepts, and the rest for quarantine."""
    ok = accepted(set(df.columns))
    return df.where(ok), df.where(~ok)


#: What a key's state holds: the last version that was kept.
STATE = "value double, compared string, vintage string"
CHANGED = "row string, event string, vintage string"


def folder_value(path: Column, name: str) -> Column:
    """The value of a partition column in a file's address, whose signs are escaped once in the folder and once in the address."""
    value = F.regexp_extract(path, f"/{name}=([^/]*)/", 1)
    for _ in range(2):
        value = F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
    return value


def chained(processed: str | None) -> Callable:
    """The stateful step: rows of a key in order of time, each compared with the last version kept; gives those that change it, and invalid ones."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = (state.get if state.exists else None), []
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["stored", "at", "value", "compared"], ascending=[False, True, True, True], kind="stable", na_position="first")
        known = last is not None
        for r in rows.itertuples(index=False):
            if not r.ok:
                out.append((r.row, "invalid", None))
            elif r.stored:
                if not known:  # what the state has is newer than what it wrote before
                    last = (r.value, r.compared, r.vintage)
            else:
                if last is None:
                    event, vintage = "new_release", r.official
                elif abs(last[0] - r.value) > 1e-12:
                    event, vintage = "historical_revision", processed
                elif last[1] != r.compared:
                    event, vintage = "provenance_update", processed
                else:
                    continue
                vintage = r.vintage if processed is None else vintage
                last = (r.value, r.compared, vintage)
                out.append((r.row, event, vintage))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["row", "event", "vintage"], dtype=object)

    return step


def stream_ledger(spark: SparkSession, source: str, schema: str, ledger: str, quarantine: str, checkpoint: str, processed: str | None = None) -> StreamingQuery:
    """Append new and changed rows of landed files to the ledger. Late rows are kept; they show from their vintage on.

    The last version of every key is kept in Spark's state store, so a micro-batch reads its own rows alone; rows of a key are taken in
    order of ``retrieved_at``, then value. What the ledger holds when the stream begins is read once into the state, by a new checkpoint too, so rows
    that are landed again add nothing. Each batch owns a folder in ledger and quarantine and overwrites it, so one that is repeated
    after either sink was written leaves both as they are. The ledger is partitioned by batch and series.
    """
    compared = [c for c in COMPARED if c in StructType.fromDDL(schema).fieldNames()]
    kind = StructType.fromDDL(schema)
    names = set(kind.fieldNames())
    key = ["series_id", "observation_period"] if "observation_period" in names else KEY
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def marked(df: DataFrame, stored: bool) -> DataFrame:
        official = F.when(F.col("availability_basis") == "official_release", F.col("available_date")) if "availability_basis" in names else F.lit(None)
        at = F.unix_micros("retrieved_at") if "retrieved_at" in names else F.lit(0).cast("long")
        at = F.when(F.lit(stored), F.coalesce(F.unix_date("vintage"), F.lit(-(10**6))).cast("long")).otherwise(at) if "vintage" in names else at
        return df.select(
            *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(key)],
            F.lit(stored).alias("stored"),
            accepted(names).alias("ok"),
            at.alias("at"),
            F.col("value").cast("double").alias("value"),
            F.to_json(F.struct(*compared), {"ignoreNullFields": "false"}).alias("compared") if compared else F.lit("").alias("compared"),
            (F.col("vintage") if "vintage" in names else F.lit(None)).cast("string").alias("vintage"),
            official.cast("string").alias("official"),
            F.to_json(F.struct(*kind.fieldNames()), {"ignoreNullFields": "false"}).alias("row"),
        )

    def append(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.from_json("row", kind).alias("r"), "event", "vintage").select("r.*", F.col("event").alias("_event"), F.col("vintage").alias("_vintage"))
        fresh = rows.where("_event <> 'invalid'")
        if "vintage" in names:
            fresh = fresh.withColumn("vintage", F.col("_vintage").cast("date"))
        if "quality_flags" in names:
            flags = F.coalesce("quality_flags", F.array().cast("array<string>"))
            fresh = fresh.withColumn("quality_flags", F.when(F.col("_event") == "new_release", flags).otherwise(F.array_append(flags, F.col("_event"))))
        fresh.drop("_event", "_vintage").write.mode("overwrite").partitionBy("series_id").parquet(f"{ledger}/batch={run}-{batch_id}")
        rows.where("_event = 'invalid'").drop("_event", "_vintage").write.mode("overwrite").parquet(f"{quarantine}/batch={run}-{batch_id}")

    empty = spark.createDataFrame([], schema)
    empty.write.mode("ignore").partitionBy("series_id").parquet(f"{ledger}/batch=none")  # so that there is a ledger to read
    landed = marked(spark.readStream.schema(schema).parquet(source), False)
    # A stream does not see the folders' columns, so the series comes from the path.
    inside = StructType([f for f in kind.fields if f.name != "series_id"])
    files = spark.readStream.schema(inside).option("recursiveFileLookup", "true").parquet(ledger)
    stored = marked(files.withColumn("series_id", folder_value(F.col("_metadata.file_path"), "series_id")), True)
    keys = [f"k{i}" for i in range(len(key))]
    changed = landed.unionByName(stored).groupBy(*keys).applyInPandasWithState(chained(processed), CHANGED, STATE, "update", "NoTimeout")
    return changed.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_asof(spark: SparkSession, source: str, schema: str, observations: str, view: str, checkpoint: str, end: str) -> StreamingQuery:
    """The month-end as-of panel as a view: each batch of observations is stored, and the panels of the series that it touches are built anew.

    The view is partitioned by series and a batch overwrites the partitions of its series, so it is never larger than the panel, and a batch
    that is repeated changes nothing. Other series are neither read nor written.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("series_id").parquet(f"{observations}/batch={batch_id}")
        touched = spark.read.option("basePath", observations).schema(schema).parquet(f"{observations}/batch={batch_id}").select("series_id").distinct()
        every = spark.read.option("basePath", observations).schema(schema).parquet(observations)
        series = every.join(F.broadcast(touched), "series_id", "left_semi") if touched.limit(100_001).count() <= 100_000 else every.join(touched, "series_id", "left_semi")
        panel = asof_month_end(series, end=end).select("month_end", "value", "series_id")
        panel.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("series_id").parquet(view)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_asof_view(spark: SparkSession, view: str) -> DataFrame:
    """(series_id, month_end, value) of the view."""
    return spark.read.schema("month_end date, value double, series_id string").parquet(view).select("series_id", "month_end", "value")
