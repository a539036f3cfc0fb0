"""Comparing all rows of a key without bringing them all to one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_pairs(rows: DataFrame, keys: Sequence[str], spread: Column, block: int) -> DataFrame:
    """The rows of keys that have several, dealt to pairs of blocks in columns low and high.

    Column own has the block the row itself is in.

    A key's rows are dealt by the hash of ``spread`` to blocks of about ``block`` rows. Each
    row stands once in every pair of blocks that its own is part of, so any two rows of a key meet
    in some pair, and no pair holds more than about twice ``block`` rows however many the key has.
    """
    several = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return (
        rows.join(several, list(keys))
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64(spread), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .drop("n", "blocks", "other")
    )
