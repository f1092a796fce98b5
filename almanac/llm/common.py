"""What the operators of this subpackage share: cutting lineage, size-checked joins, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a side of a join may have to be broadcast; each caller keeps such rows to about 100 bytes.
BROADCAST_ROWS = 400_000
#: Bytes that a side of a join may have to be broadcast, where its rows have no bound.
BROADCAST_BYTES = 40_000_000
#: Rows of texts that are sent to a Python worker together.
BATCH_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, the session's checkpoint
    folder, or a new local one if the session itself is local. Any other session must name a folder.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or spark.conf.get("almanac.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-almanac-")
        spark.conf.set("almanac.shared.dir", found)
    return found.rstrip("/")


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches of at most ``BATCH_ROWS`` rows: texts have no bound, and a worker holds a batch several times over."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return the written table: it outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/almanac-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str, limit: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """Join on named columns; ``small`` (already written, narrow) is broadcast only if it has at most ``limit`` rows.

    Where rows hold lists or texts, ``size`` is the bytes of one, and their sum is bounded by ``BROADCAST_BYTES`` too.
    With more Spark shuffles both sides, and adaptive execution splits skewed partitions.
    """
    few = small.limit(limit + 1).count() <= limit
    if few and size is not None:
        few = (small.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    return big.join(F.broadcast(small) if few else small, on, how)


def crc_mod(column: str, n: int):
    """Remainder of the CRC-32 of a column's text; null for null."""
    return F.crc32(F.col(column).cast("string")) % n
