"""Rows made of texts by small helpers, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Input rows that are held as Python values at a time; rows handed on at a time.
ROWS, OUT = 32, 5_000
KINDS = {"long": pa.int64(), "string": pa.string(), "integer": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}


def text_rows(rows: DataFrame, keys: list[str], columns: list[str], f: Callable[..., Iterable[tuple]], made: dict[str, str], nth: str = "idx") -> DataFrame:
    """keys, nth (from 0 in each row) and the columns made (name: string, integer, long or double) of what f yields for a row's columns."""
    width = len(keys)
    schema = rows.select(*keys).schema.add(nth, "integer")
    for name, kind in made.items():
        schema = schema.add(name, DataType.fromDDL(kind))
    names = schema.fieldNames()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ready(part: pa.RecordBatch, at: list[int], out: list[tuple]) -> pa.RecordBatch:
            made_columns = zip(*out, strict=True)
            kinds = [pa.int32(), *(KINDS[k] for k in made.values())]
            return pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(at, pa.int64())) for k in range(width)), *(pa.array(x, k) for x, k in zip(made_columns, kinds, strict=True))], names=names)

        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                at, out = [], []
                for row, values in enumerate(zip(*(part.column(width + c).to_pylist() for c in range(len(columns))), strict=True)):
                    for n, x in enumerate(f(*values)):
                        at.append(row)
                        out.append((n, *x))
                        if len(out) >= OUT:
                            yield ready(part, at, out)
                            at, out = [], []
                if out:
                    yield ready(part, at, out)

    return rows.select(*keys, *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)]).mapInArrow(run, schema)


def text_lists(rows: DataFrame, keep: list[str], columns: list[Column | str], f: Callable[..., Iterable[tuple]], made: dict[str, str], name: str) -> DataFrame:
    """The columns keep of rows and, under name, the list of structs (made, as of text_rows) that f yields for a row's columns: no join has to bring the others back."""
    kind, width = pa.list_(pa.struct([(n, KINDS[k]) for n, k in made.items()])), len(keep)
    schema = rows.select(*keep, F.lit(None).cast(f"array<struct<{','.join(f'{n}:{k}' for n, k in made.items())}>>").alias(name)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                values = zip(*(c.to_pylist() for c in part.columns[width:]), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array([list(f(*v)) for v in values], kind)], names=[*keep, name])

    return rows.select(*keep, *[(F.col(c) if isinstance(c, str) else c).alias(f"_{i}") for i, c in enumerate(columns)]).mapInArrow(run, schema)


def rows_or_error(rows: DataFrame, keys: list[str], columns: list[str], f: Callable[..., Iterable[tuple]], made: dict[str, str]) -> DataFrame:
    """text_rows' columns and error: a row whose f fails gives one row with its message and no result, instead of ending the job.

    What f yielded before it failed is dropped."""

    def guarded(*values: object) -> Iterable[tuple]:
        try:
            return [(*x, None) for x in f(*values)]
        except Exception as e:  # whatever a row's content brings about is that row's result
            return [(*[None] * len(made), f"{type(e).__name__}: {e}")]

    return text_rows(rows, keys, columns, guarded, {**made, "error": "string"})
