"""The corpus pipeline: documents through five of the operators, each stage on what is left.

Quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, BPE encoding. Each
stage's result is written as Parquet and read again as the documents of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, lines, quality, simhash
from ledgerlens.llm import queries as q
from ledgerlens.session import remove, remove_at_exit, scratch_path, work_tables

#: The classifier and the search for near-duplicates are no SQL; tests compare with brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject."""
    q.on_workers(spark)
    labels = q.table(spark, sf_dir, "labels")
    model = quality.fit_labels(quality.statistics(quality.labelled(docs, labels)), labels)
    return docs.where(quality.scored_text(F.col("text"), model) >= q.MIN_SCORE)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on many sites; none goes as a whole."""
    cleaned = lines.remove_boilerplate(docs, q.SITES_SHARE, q.LEAST_SITES, q.MIN_LINE_CHARS)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    q.on_workers(spark)
    return simhash.one_of_each(docs, q.SHINGLE, q.MAX_BITS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item of ``q.LEAST_ITEM_WORDS`` words or more."""
    benchmark = q.table(spark, sf_dir, "benchmark")
    return decontaminate.without_contaminated(docs, benchmark, least_words=q.LEAST_ITEM_WORDS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their number and digests."""
    q.on_workers(spark)
    return q.bpe_round_trip(docs, q.tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_boilerplate),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; of the files made only the result's stay."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        with work_tables(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        remove_at_exit(spark, path)
        docs = spark.read.schema(made.schema).parquet(path)
        if old:
            remove(spark, old)
        old = path
    return docs
