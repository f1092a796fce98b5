"""Where registered queries and their SQL are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.plans import views as v

QUERIES: dict = {}
ORACLES: dict = {}
CUTOFF = "1997-06-30"


def query(sql: str | None = None, places: int = 6):
    """Register a function (spark, sf_dir); its doubles are rounded to ``places``, and so are those of the SQL."""

    def add(fn):
        def run(spark, sf_dir) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = v.sql(sql)
        return fn

    return add
