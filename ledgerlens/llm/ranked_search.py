"""Ranked lexical search, term at a time with a limit on accumulators.

A query's terms are taken rarest first. Each posting list adds its scores to the accumulators of
its documents. Once the terms that remain, by the largest scores of their lists, cannot bring a
document without an accumulator up to the kth largest partial score, no accumulator is created any
more; those that exist are brought to their exact scores by the remaining lists. A document that a tie
could put among the first k keeps its chance, as creation stops only if the remaining bound is
strictly less.

Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII, with A-Z
lower-cased. N counts the documents with a term, L all their terms, n one document's, df the
documents with a term, tf its occurrences in a document. A term weighs
``floor(1000 * ln((2N + 2) / (2 df + 1)))`` and adds
``weight * ((10^9 tf) div (1000 tf + 12 m))`` with ``m = 75 + (25 n N) div L`` for each of its
occurrences in the query; all but the weight is in whole numbers.

Texts are split once, in tasks that hand on each document's distinct terms and counts; Spark joins
them with the terms of the queries, as a broadcast while those are few. Postings are dealt by
document to blocks of about ``BLOCK`` postings and the queries to blocks of ``QUERIES``, so a term that
every document holds is spread evenly, and a task holds the posting lists of one pair of blocks. Each
block gives its k best of every query, and the best of these are the result.

A null text has no terms. Every row is a document, or a query, of its own, also under repeated or
null ids; equal scores go by ascending document id, null ids last. Other columns are not carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerlens.llm.rows import SLICE
from ledgerlens.session import written

K = 20
#: Postings of a block of documents, and queries that are answered against it at a time.
BLOCK = 1 << 20
QUERIES = 1024
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """Terms in order; in UTF-8 every byte of a character beyond ASCII is 0x80 or more."""
    return _TERM.findall((text or "").encode().lower())


def counted(rows: DataFrame) -> DataFrame:
    """(row, id, n, term, tf): the distinct terms of every (row, id, text) that has terms.

    Rows of the term "" add up the texts (n) and terms (tf) of a slice of rows.
    """
    id_type = rows.schema["id"].dataType.simpleString()
    schema = StructType.fromDDL(
        f"row bigint, id {id_type}, n bigint, terms array<string>, times array<bigint>"
    )
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                made, texts, total = [], 0, 0
                for row, key, text in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns)):
                    if terms := terms_of(text):
                        counts = Counter(terms)
                        texts, total = texts + 1, total + len(terms)
                        names = [t.decode() for t in counts]
                        made.append((row, key, len(terms), names, list(counts.values())))
                if made:
                    made.append((None, None, texts, [""], [total]))
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*made), arrow_schema)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    made = rows.select("row", "id", "text").mapInArrow(run, schema)
    pairs = made.select("row", "id", "n", F.explode(F.arrays_zip("terms", "times")).alias("p"))
    return pairs.select("row", "id", "n", F.col("p.terms").alias("term"), F.col("p.times").alias("tf"))


def top_documents(
    size: int, lists: list[tuple[int, np.ndarray, np.ndarray]], k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k best of ``size`` documents and their scores, by score and then by position.

    ``lists`` has (documents of the term in all, positions in ascending order, scores of a list).
    """
    lists = sorted((x for x in lists if len(x[1])), key=lambda x: x[0])
    bounds = np.cumsum([int(scores.max()) for _, _, scores in lists][::-1])[::-1].tolist()
    sums = np.zeros(size, np.int64)
    alive, survivors = np.zeros(size, bool), None
    for bound, (_, at, scores) in zip(bounds, lists):
        if survivors is None and np.count_nonzero(alive) >= k:
            partial = sums[alive]
            if bound < np.partition(partial, len(partial) - k)[len(partial) - k]:
                survivors = np.flatnonzero(alive)
        if survivors is None:
            sums[at] += scores
            alive[at] = True
        elif len(survivors) < len(at):
            place = np.minimum(np.searchsorted(at, survivors), len(at) - 1)
            hit = at[place] == survivors
            sums[survivors[hit]] += scores[place[hit]]
        else:
            hit = alive[at]
            sums[at[hit]] += scores[hit]
    found = np.flatnonzero(alive & (sums > 0))
    best = found[np.lexsort((found, -sums[found]))[:k]]
    return best, sums[best]


def _answered(rows: DataFrame, k: int) -> DataFrame:
    """(query, row, id, score): each block's k best of every query, from partitions by block."""
    id_type = rows.schema["id"].dataType.simpleString()
    schema = StructType.fromDDL(f"query bigint, row bigint, id {id_type}, score bigint")
    arrow_schema = to_arrow_schema(schema)

    def answer(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts)
        asks = whole.filter(pc.is_valid(whole["query"]))
        held = whole.filter(pc.is_null(whole["query"]))
        # Documents take positions in order of their ids.
        rows, first, document = np.unique(
            held["row"].to_numpy(), return_index=True, return_inverse=True
        )
        ids = pa.table({"id": held["id"].take(first), "row": rows})
        by_id = pc.sort_indices(
            ids, [("id", "ascending"), ("row", "ascending")], null_placement="at_end"
        ).to_numpy()
        rows, ids, rank = rows[by_id], ids["id"].take(by_id), np.argsort(by_id)
        position, terms, score = rank[document], held["number"].to_numpy(), held["score"].to_numpy()
        order = np.lexsort((position, terms))
        terms, position, score = terms[order], position[order], score[order]
        names, starts = np.unique(terms, return_index=True)
        ends = np.append(starts[1:], len(terms))
        made: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        asks = asks.filter(pc.is_in(asks["number"], pa.array(names))).sort_by("query")
        owners, firsts = np.unique(asks["query"].to_numpy(), return_index=True)
        place = np.searchsorted(names, asks["number"].to_numpy())
        times, frequency = asks["score"].to_numpy(), asks["df"].to_numpy()
        for owner, begin, end in zip(owners, firsts, np.append(firsts[1:], len(place))):
            lists = []
            for i in range(begin, end):
                span = slice(starts[place[i]], ends[place[i]])
                lists.append((frequency[i], position[span], times[i] * score[span]))
            best, sums = top_documents(len(rows), lists, k)
            for column, values in zip(made, (np.full(len(best), owner), best, sums)):
                column.append(values)
        owner, best, sums = map(np.concatenate, made)
        columns = [owner, rows[best], ids.take(best).combine_chunks(), sums]
        columns = [pa.array(c, f.type) for c, f in zip(columns, arrow_schema)]
        return pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        for batch in batches:
            names = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if names[start] != block and parts:
                    yield answer(parts)
                    parts = []
                block = names[start]
                parts.append(batch.slice(start, end - start))
        if parts:
            yield answer(parts)

    return rows.mapInArrow(run, schema)


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id_col: str = "item_id",
    query_text_col: str = "text",
    block_postings: int = BLOCK,
    block_queries: int = QUERIES,
) -> DataFrame:
    """(query id, rank, document id, score): the k best documents of every query row."""
    asked, _ = written(_numbered(queries, query_id_col, query_text_col), "queries")
    wanted = counted(asked).where("term <> ''").select(F.col("row").alias("query"), "term", "tf")
    wanted, _ = written(wanted, "wanted")
    terms = wanted.select("term").distinct().withColumn("number", F.monotonically_increasing_id())
    sums = docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).cast("long"))
    terms, _ = written(terms.union(sums), "terms")
    found = counted(_numbered(docs, id_col, text_col)).join(terms, "term").drop("term")
    postings, _ = written(found, "postings")
    adds = F.col("number") < 0
    counts = [F.sum(F.when(adds, F.col(c))) for c in ("n", "tf")] + [F.count(F.when(~adds, 1))]
    count, length, held = (x or 0 for x in postings.agg(*counts).first())
    postings = postings.where(~adds)
    blocks = max(1, -(-held // block_postings))
    parts = max(1, -(-asked.count() // block_queries))

    frequency = postings.groupBy("number").agg(F.count("*").alias("df"))
    ratio = (F.lit(2.0) * count + 2) / (F.lit(2.0) * F.col("df") + 1)
    weight = F.floor(1000 * F.log(ratio))
    lists = wanted.join(terms.join(frequency, "number"), "term").select(
        F.pmod(F.xxhash64("query"), F.lit(parts)).alias("part"),
        "query",
        "number",
        (F.col("tf") * weight).alias("score"),
        "df",
    )
    lists, _ = written(lists, "lists")
    asks = lists.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Decimals, since the product of a long text and many documents may exceed 64 bits.
    shift = F.expr(f"75 + (cast(n as decimal(19,0)) * {25 * count}BD) div {max(length, 1)}BD")
    scored = postings.withColumn("m", shift).withColumn(
        "score", F.expr("(1000000000L * tf) div (1000 * tf + 12 * m)")
    )
    held = scored.join(lists.select("number", "part").distinct(), "number")
    held = held.withColumn("at", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    block = (F.col("at") * parts + F.col("part")).cast("long").alias("block")
    dealt = asks.select(block, "query", "number", "score", "df").unionByName(
        held.select(block, "row", "id", "number", "score"), allowMissingColumns=True
    )
    dealt = dealt.repartition(blocks * parts, "block").sortWithinPartitions("block")
    best = _answered(dealt, k)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    owners = asked.select(F.col("row").alias("query"), F.col("id").alias(query_id_col))
    return ranked.select("query", "rank", F.col("id").alias(id_col), "score").join(
        owners, "query"
    ).select(query_id_col, "rank", id_col, "score")


def _numbered(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
