"""Equi-joins on cells whose full cells are cut into counted parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key on the left side that one task joins; a fuller key is cut into parts of about this many.
PART_ROWS = 10_000


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys``. Keys with more than PART_ROWS left rows are salted: their left rows are cut into parts by a hash of the row and the right rows go to each part.

    The salt depends on the row's plain columns alone, so that a task that runs again gives the same rows.
    """
    keys = list(keys)
    full = left.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > PART_ROWS)
    full = full.select(*keys, F.ceil(F.col("__n") / PART_ROWS).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    row = F.xxhash64(*(F.col(c) for c, t in left.dtypes if "<" not in t))
    a = left.withColumn("__h", row).join(full, keys, "left").withColumn("__salt", F.pmod("__h", parts).cast("int")).drop("__h", "__parts")
    b = right.join(full, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return a.join(b, [*keys, "__salt"]).drop("__salt")
