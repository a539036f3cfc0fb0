"""Top lists, tie-averaging ranks and concentration bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.measures import share_pct

# Rank bands with their captions; payers after the last band form the rest.
BANDS = [
    (1, 10, "Penerimaan 10 WP Terbesar"),
    (11, 100, "Penerimaan 11 s.d. 100 WP Terbesar"),
    (101, 500, "Penerimaan 101 s.d. 500 WP Terbesar"),
]
REST_CAPTION = "Penerimaan 501 s.d. %d WP Terbesar"
TOTAL_CAPTION = "Total"


def largest(df: DataFrame, measure: str, ids: Sequence[str], n: int = 10) -> DataFrame:
    """The ``n`` rows with the largest measure, missing values last, ties by id."""
    return df.orderBy(F.col(measure).desc_nulls_last(), *ids).limit(n)


def smallest(df: DataFrame, measure: str, ids: Sequence[str], n: int = 10) -> DataFrame:
    """The ``n`` rows with the smallest measure, missing values last, ties by id."""
    return df.orderBy(F.col(measure).asc_nulls_last(), *ids).limit(n)


def average_rank(value: Column, *partition: str) -> Column:
    """Descending rank in which tied values share the mean of their places; NULL unranked."""
    places = F.rank().over(W.partitionBy(*partition).orderBy(value.desc_nulls_last()))
    ties = F.count(F.lit(1)).over(W.partitionBy(*partition, value))
    return F.when(value.isNotNull(), places + (ties - 1) / F.lit(2.0))


def rank_bands(payers: DataFrame, rank_by: str, share_of: str) -> DataFrame:
    """Ten largest payers, then the sums of each rank band, of the rest and of all payers.

    ``payers`` has one row per (npwp, payer); every other column is a measure. Only the
    rows inside the last band are ranked: the rest is the grand total minus those. Each
    ranked row and the total row state which output rows they add to or subtract from,
    and one small aggregation sums them.
    """
    measures = [c for c in payers.columns if c not in ("npwp", "payer")]
    last_rank = BANDS[-1][1]
    order = [F.col(rank_by).desc_nulls_last(), F.col("npwp"), F.col("payer")]
    ranked = payers.orderBy(*order).limit(last_rank).withColumn(
        "rank", F.row_number().over(W.orderBy(*order))
    )
    total = payers.agg(
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures],
        F.count(F.lit(1)).alias("n"),
    )

    def entry(row_kind: str, pos: Column, npwp: Column, payer: Column, weight: int) -> Column:
        return F.struct(
            F.lit(row_kind).alias("row_kind"),
            pos.cast("int").alias("pos"),
            npwp.alias("npwp"),
            payer.alias("payer"),
            F.lit(weight).alias("weight"),
        )

    no_id = F.lit(None).cast("string")
    rest_pos = F.lit(len(BANDS) + 1)
    band_of_rank = F.lit(None)
    caption_of_rank = F.lit(None)
    for pos, (first, last, caption) in reversed(list(enumerate(BANDS, start=1))):
        inside = F.col("rank").between(first, last)
        band_of_rank = F.when(inside, F.lit(pos)).otherwise(band_of_rank)
        caption_of_rank = F.when(inside, F.lit(caption)).otherwise(caption_of_rank)
    from_ranked = [
        entry("band", band_of_rank, no_id, caption_of_rank, 1),
        entry("band", rest_pos, no_id, F.lit(REST_CAPTION), -1),
    ]
    as_payer = entry("payer", F.col("rank"), F.col("npwp"), F.col("payer"), 1)
    from_total = [
        entry("band", F.lit(pos), no_id, F.lit(caption), 0)
        for pos, (_, _, caption) in enumerate(BANDS, start=1)
    ] + [
        entry("band", rest_pos, no_id, F.lit(REST_CAPTION), 1),
        entry("total", F.lit(1), no_id, F.lit(TOTAL_CAPTION), 1),
    ]
    contributions = ranked.select(
        F.inline(
            F.when(F.col("rank") <= BANDS[0][1], F.array(as_payer, *from_ranked)).otherwise(
                F.array(*from_ranked)
            )
        ),
        *measures,
        F.lit(1).cast("bigint").alias("n"),
    ).unionByName(total.select(F.inline(F.array(*from_total)), *measures, "n"))

    rows = contributions.groupBy("row_kind", "pos", "npwp", "payer").agg(
        *[F.coalesce(F.sum(F.col(m) * F.col("weight")), F.lit(0)).alias(m) for m in measures],
        F.sum(F.col("n") * F.col("weight")).alias("n"),
    )
    # At most ten payers, the bands and the total are left here, in one partition.
    everything = W.partitionBy()
    is_total = F.col("row_kind") == "total"
    whole = F.max(F.when(is_total, F.col(share_of))).over(everything)
    payer_count = F.max(F.when(is_total, F.col("n"))).over(everything)
    kinds_in_order = F.array(F.lit("payer"), F.lit("band"), F.lit("total"))
    row_order = F.array_position(kinds_in_order, F.col("row_kind"))
    report = rows.select(
        "row_kind",
        "pos",
        "npwp",
        F.when(
            (F.col("row_kind") == "band") & (F.col("pos") == rest_pos),
            F.format_string(REST_CAPTION, payer_count),
        )
        .otherwise(F.col("payer"))
        .alias("payer"),
        *measures,
        "n",
        share_pct(F.col(share_of), whole).alias("share_pct"),
    )
    return report.sortWithinPartitions(row_order, "pos")
