"""Running a Python function over documents inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows turned into Python objects at a time; bounds a task's memory whatever the batch size.
SLICE = 128


def map_slices(
    rows: DataFrame, schema: StructType | str, start: Callable[[], Callable[..., Sequence]]
) -> DataFrame:
    """One output row for each input row, converted a slice of rows at a time.

    ``start`` runs once per task and returns the function that gets a slice's columns as lists
    and returns the output columns, so tables and caches live as long as the task.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                made = convert(*[c.to_pylist() for c in batch.slice(at, SLICE).columns])
                columns = [pa.array(c, f.type) for c, f in zip(made, arrow_schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    return rows.mapInArrow(run, schema)


def map_rows(
    rows: DataFrame, schema: StructType | str, start: Callable[[], Callable[..., tuple]]
) -> DataFrame:
    """One output row for each input row, converted by the function ``start`` returns."""

    def start_slices() -> Callable[..., Sequence]:
        convert = start()
        return lambda *columns: list(zip(*map(convert, *columns)))

    return map_slices(rows, schema, start_slices)
