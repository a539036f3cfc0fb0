"""Cross-site boilerplate: lines that stand on many sites are removed.

A line's spread is the number of distinct sites it stands on. Each line hash gets a HyperLogLog
sketch of its sites; sketches of many tasks merge by aggregation. Lines whose estimate lies
near the threshold get an exact distinct count, lines clearly above it are boilerplate, lines
clearly below are not. Only DataFrame functions are used.

The threshold is a share of the distinct sites of the input, but never below ``least_sites``. Lines
are what newlines separate; a line is compared without white space at its ends, and lines
shorter than ``min_chars`` are never boilerplate. Two kinds of documents are left whole: those of
which nothing but white space would be left, and those whose whole text stands on as many sites
itself, told by an exact count per hash of the text. They are copies, which is for document dedup to
settle.

Lines are told apart by a 64-bit hash, whole texts by their MD5. Null text stays null and empty text
empty; a null site is no site. Every row is cleaned by its own text, whatever its id, null and
repeated ids included. Other columns, whatever their names, are carried along as they are.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import written

#: Sketches have 2^LG_K cells and an error of about 1.04 / sqrt(2^LG_K).
LG_K = 10
#: Estimates within this many standard errors of the threshold are counted exactly.
STANDARD_ERRORS = 6
#: What is taken from both ends of a line.
WHITE_SPACE = " \t\n\v\f\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE_SPACE))


def _comparable(line: Column, min_chars: int) -> Column:
    """Hash of a line without outer white space; null if it is too short to count."""
    bare = _bare(line)
    return F.when(F.char_length(bare) >= min_chars, F.xxhash64(bare))


def _hashes(text: Column, min_chars: int) -> Column:
    bare = F.filter(F.transform(_lines(text), _bare), lambda line: F.char_length(line) >= min_chars)
    return F.array_distinct(F.transform(bare, lambda line: F.xxhash64(line)))


def boilerplate(
    docs: DataFrame,
    min_sites: int,
    min_chars: int = 20,
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """(line): hashes of the lines that stand on at least ``min_sites`` sites."""
    placed = docs.where(F.col(site_col).isNotNull()).select(
        F.col(site_col).alias("site"), F.explode(_hashes(F.col(text_col), min_chars)).alias("line")
    )
    spread = placed.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    band = STANDARD_ERRORS * 1.04 / 2 ** (LG_K / 2)
    spread = spread.select("line", F.hll_sketch_estimate("sketch").alias("sites")).where(
        F.col("sites") >= min_sites * (1 - band)
    )
    # A table of the few lines that spread this far: sketched once, and of known size for the join.
    spread, _ = written(spread, "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + band)).select("line")
    near = spread.where(F.col("sites") <= min_sites * (1 + band)).select("line")
    exact = placed.join(near, "line", "left_semi").distinct().groupBy("line").count()
    return sure.union(exact.where(F.col("count") >= min_sites).select("line"))


def sites_needed(
    docs: DataFrame, sites_share: float, least_sites: int, site_col: str = "source"
) -> int:
    """Sites a line has to stand on: that share of all sites, rounded up, ``least_sites`` at least."""
    sites = docs.agg(F.count_distinct(site_col)).first()[0]
    return max(least_sites, math.ceil(round(sites_share * sites, 6)))


def remove_boilerplate(
    docs: DataFrame,
    sites_share: float = 0.2,
    least_sites: int = 3,
    min_chars: int = 20,
    text_col: str = "text",
    site_col: str = "source",
    removed_col: str | None = None,
) -> DataFrame:
    """The documents without boilerplate lines, with the columns they had.

    ``removed_col`` names an added column with the number of lines removed from each row.
    """
    needed = sites_needed(docs, sites_share, least_sites, site_col)
    # As a table its size is known: Spark broadcasts it while small and shuffles beyond that.
    known, _ = written(boilerplate(docs, needed, min_chars, text_col, site_col), "boilerplate")
    tag = uuid.uuid4().hex
    key, bad, text = f"key_{tag}", f"bad_{tag}", F.col(text_col)
    standing = docs.select(
        F.md5(text).alias(key),
        F.col(site_col).alias("site"),
        F.explode(_hashes(text, min_chars)).alias("line"),
    )
    # Which boilerplate lines a text has and on how many sites it stands; few texts have any.
    by_site = standing.join(known, "line").groupBy(key, "site")
    by_text = by_site.agg(F.collect_set("line").alias("lines")).groupBy(key)
    by_text = by_text.agg(F.count("site").alias("sites"), F.first("lines").alias(bad))
    # A table of its own: small ones are broadcast, else a text with very many copies can be split.
    by_text, _ = written(by_text.where(F.col("sites") < needed).select(key, bad), "affected")
    joined = docs.join(by_text, F.md5(text) == F.col(key), "left")

    def goes(line: Column) -> Column:
        return F.coalesce(F.array_contains(F.col(bad), _comparable(line, min_chars)), F.lit(False))

    lines, kept = _lines(text), f"kept_{tag}"
    joined = joined.withColumn(
        kept, F.when(F.col(bad).isNotNull(), F.filter(lines, lambda line: ~goes(line)))
    )
    cleaned = F.array_join(kept, "\n")
    removed = F.size(lines) - F.size(kept)
    applies = F.col(bad).isNotNull() & (_bare(cleaned) != "")
    columns = [
        F.when(applies, cleaned).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`")
        for c in docs.columns
    ]
    if removed_col:
        columns.append(F.when(applies, removed).otherwise(0).cast("long").alias(removed_col))
    return joined.select(columns)
