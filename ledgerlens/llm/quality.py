"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text becomes a vector of transformed statistics. Both classes get a mean and a
covariance that is shrunk towards the pooled covariance and then towards a multiple of the
identity. A score compares the two log densities, each a squared Mahalanobis distance
computed with that class's Cholesky factor, which the fitted model keeps.

Nothing but the text enters a score. Null text counts as empty, and an empty text has statistics
like any other. Labels that are null or neither 0 nor 1 are left out; a document with several
labels counts once for each. With one class missing every score is 1 or 0, for the class there
is; without labels it is 0.5. Rows with a null id are scored but never learnt from.
"""

from __future__ import annotations

import dataclasses
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.rows import map_rows

#: Names of the statistics, in order.
STATISTICS = (
    "length",
    "word_length",
    "distinct_words",
    "repeated_neighbours",
    "commonest_word",
    "symbols",
    "capitals",
    "digits",
    "punctuation",
    "wordless_tokens",
    "line_length",
    "repeated_lines",
    "marked_ends",
)
#: Share of the pooled covariance in a class's covariance, and of the identity after that.
POOLED_SHARE = 0.05
IDENTITY_SHARE = 0.005

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _PUNCTUATION, _SYMBOL = range(7)


def _letter_kinds() -> np.ndarray:
    """Kind of every code point below U+3000; those beyond count as lower-case letters."""
    kinds = np.zeros(0x3000, np.uint8)
    for code in range(len(kinds)):
        c = chr(code)
        if c.isspace():
            kinds[code] = _SPACE
        elif c.isdigit():
            kinds[code] = _DIGIT
        elif c.isupper():
            kinds[code] = _UPPER
        elif c in ".,":
            kinds[code] = _STOP
        elif c in ";:!?'\"()-":
            kinds[code] = _PUNCTUATION
        elif not c.isalpha():
            kinds[code] = _SYMBOL
    return kinds


_KINDS = _letter_kinds()


def document_vector(text: str | None) -> list[float]:
    """The statistics of one whole text. Shares are logs, so that ratios become distances."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kinds = _KINDS[np.minimum(codes, len(_KINDS) - 1)]
    counts = np.bincount(kinds, minlength=7)
    inside = np.zeros(len(kinds) + 2, bool)
    inside[1:-1] = kinds != _SPACE
    starts, ends = np.flatnonzero(inside[1:] > inside[:-1]), np.flatnonzero(inside[1:] < inside[:-1])
    seen = np.concatenate([[0], np.cumsum(kinds <= _DIGIT)])
    wordless = int((seen[starts] == seen[ends]).sum())
    marked = int((kinds[ends - 1] >= _PUNCTUATION).sum()) if len(ends) else 0
    words = text.split()
    times = Counter(words)
    lines = [line for line in text.split("\n") if line]
    n_chars, n_words, n_lines = len(text), len(words), len(lines)
    letters = n_chars - int(counts[_SPACE])

    def share(part: float, whole: float) -> float:
        return math.log((part + 0.5) / (whole + 1.0))

    return [
        math.log1p(n_chars),
        math.log((letters + 1.0) / (n_words + 1.0)),
        share(len(times), n_words),
        share(sum(map(str.__eq__, words, words[1:])), n_words),
        share(max(times.values(), default=0), n_words),
        share(int(counts[_SYMBOL]), n_chars),
        share(int(counts[_UPPER]), letters),
        share(int(counts[_DIGIT]), n_chars),
        share(int(counts[_STOP] + counts[_PUNCTUATION]), n_chars),
        share(wordless, n_words),
        math.log((n_words + 1.0) / (n_lines + 1.0)),
        share(n_lines - len(set(lines)), n_lines),
        share(marked, n_words),
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every document."""
    rows = docs.select(id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, x array<double>"
    return map_rows(rows, schema, lambda: lambda key, text: (key, document_vector(text)))


@dataclasses.dataclass(frozen=True)
class QualityModel:
    """Class means, inverse Cholesky factors and offsets of the fitted discriminant."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def score(self, vectors: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``vectors``."""
        logs = np.empty((2, len(vectors)))
        for c in (0, 1):
            whitened = (vectors - self.means[c]) @ self.factors[c].T
            logs[c] = self.offsets[c] - 0.5 * np.einsum("ij,ij->i", whitened, whitened)
        if np.isinf(self.offsets).any():
            return np.full(len(vectors), 0.5 if np.isinf(self.offsets).all() else self._only())
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))

    def _only(self) -> float:
        return float(np.argmax(self.offsets))


def model_from_moments(moments: dict[int, np.ndarray], size: int) -> QualityModel:
    """The discriminant from each class's count, sums and sums of products."""
    counts = np.zeros(2)
    means, spread = np.zeros((2, size)), np.zeros((2, size, size))
    for c, m in moments.items():
        counts[c] = m[0]
        if m[0]:
            means[c] = m[1 : 1 + size] / m[0]
            spread[c] = m[1 + size :].reshape(size, size) / m[0] - np.outer(means[c], means[c])
    total = counts.sum()
    pooled = (counts[:, None, None] * spread).sum(axis=0) / max(total, 1)
    factors, offsets = np.zeros((2, size, size)), np.full(2, -np.inf)
    for c in (0, 1):
        shrunk = (1 - POOLED_SHARE) * spread[c] + POOLED_SHARE * pooled
        level = max(np.trace(shrunk) / size, 1e-6)
        shrunk = (1 - IDENTITY_SHARE) * shrunk + IDENTITY_SHARE * level * np.eye(size)
        cholesky = np.linalg.cholesky(shrunk)
        factors[c] = np.linalg.inv(cholesky)
        if counts[c]:
            offsets[c] = np.log(counts[c] / total) - np.log(np.diag(cholesky)).sum()
    return QualityModel(means, factors, offsets)


def fit(labelled: DataFrame, label_col: str = "label", vector_col: str = "x") -> QualityModel:
    """Fit on all rows of (label, vector).

    Tasks add up counts, sums and products; the sums of those are two rows of fixed length,
    the only thing that reaches the driver.
    """
    size = len(STATISTICS)
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(
        F.col(label_col).cast("int"), vector_col
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + size + size * size))
        for batch in batches:
            labels = batch.column(0).to_numpy()
            vectors = batch.column(1).flatten().to_numpy().reshape(-1, size)
            for c in (0, 1):
                own = vectors[labels == c]
                sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_pydict({"label": pa.array([0, 1], pa.int32()), "m": list(sums)})

    parts = rows.mapInArrow(add_up, "label int, m array<double>")
    summed = (
        parts.select("label", F.posexplode("m")).groupBy("label", "pos").agg(F.sum("col").alias("s"))
    )
    moments = {c: np.zeros(1 + size + size * size) for c in (0, 1)}
    for label, pos, value in summed.collect():
        moments[label][pos] = value
    return model_from_moments(moments, size)


def scored(vectors: Column, model: QualityModel) -> Column:
    """Score of a column of statistics."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        rows = column.flatten().to_numpy().reshape(-1, len(STATISTICS))
        return pa.array(model.score(rows), pa.float64())

    return score(vectors)


def scored_text(text: Column, model: QualityModel) -> Column:
    """Score of a column of texts, for filtering documents in place."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        rows = np.array([document_vector(t.as_py()) for t in column]).reshape(-1, len(STATISTICS))
        return pa.array(model.score(rows), pa.float64())

    return score(text)


def in_training(id_column: Column, folds: int = 5) -> Column:
    """Whether labels of this document may be learnt: CRC-32 of the id not divisible by ``folds``."""
    return F.crc32(id_column.cast("string")) % folds != 0


def labelled(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality"
) -> DataFrame:
    """The documents that have a label that may be learnt."""
    wanted = labels.where(F.col(label_col).isNotNull() & in_training(F.col(id_col)))
    return docs.join(wanted.select(id_col), id_col, "left_semi")


def fit_labels(
    vectors: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality"
) -> QualityModel:
    """Fit on the statistics of the documents that have a label and are not held out."""
    wanted = labels.select(id_col, F.col(label_col).alias("label")).where(in_training(F.col(id_col)))
    return fit(vectors.where(in_training(F.col(id_col))).join(wanted, id_col))


