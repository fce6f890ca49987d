"""Python functions of one row as columns: a few rows at a time, whatever Spark hands over at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that are Python objects at once. An Arrow batch has up to ten thousand, of which only the buffers are held. Several columns
#: are made by one worker, which functions of iterators wouldn't be.
AT_ONCE = 64


def by_row(kind: T.DataType) -> Callable[[Callable], Callable[..., Column]]:
    """``work(value, ...)`` of one row's values as a function of columns; ``work`` sees nulls as None.

    Of a struct it returns a dict or the fields in order.
    """

    def wrap(work: Callable) -> Callable[..., Column]:
        def made(*values):
            out = work(*values)
            return dict(zip(kind.names, out, strict=True)) if isinstance(out, tuple) else out

        @F.arrow_udf(kind)
        def run(*columns: pa.Array) -> pa.Array:
            to, parts = to_arrow_type(kind), []
            for at in range(0, len(columns[0]), AT_ONCE):
                rows = zip(*(c.slice(at, AT_ONCE).to_pylist() for c in columns), strict=True)
                parts.append(pa.array([made(*r) for r in rows], to))
            return pa.concat_arrays(parts) if parts else pa.array([], to)

        return run

    return wrap


def with_made(rows: DataFrame, name: str, kind: T.DataType, work: Callable, given: Sequence[Column], kept: Sequence[str]) -> DataFrame:
    """The columns ``kept`` and ``name``, which ``work`` makes of a row's values ``given``.

    For values as long as texts: other than those of :func:`by_row` they go back
    ``AT_ONCE`` rows at a time, so neither side holds what is made of a whole
    Arrow batch, and no queue in front of Python holds its rows.
    """
    n = len(kept)
    taken = rows.select(*kept, *[c.alias(f"_given{i}") for i, c in enumerate(given)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = to_arrow_type(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                made = pa.array([work(*r) for r in zip(*(c.to_pylist() for c in some.columns[n:]), strict=True)], to)
                yield pa.RecordBatch.from_arrays([*some.columns[:n], made], [*kept, name])

    return taken.mapInArrow(run, T.StructType([*(taken.schema[c] for c in kept), T.StructField(name, kind)]))
