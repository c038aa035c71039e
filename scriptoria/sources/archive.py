"""Books as ZIP archives, packed where their entries lie."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPOCH = (1980, 1, 1, 0, 0, 0)  # of every entry, so that a task that runs again writes the same bytes


def zip_books(entries: DataFrame, key: str) -> DataFrame:
    """key, n_entries, archive: a ZIP file for each key. entries: key, path, content (string); null content is no entry, of a path that repeats the least stays.

    One shuffle, by key; entries are compressed as they stream past, so a task holds one archive and one entry."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, p.as_py(), c.as_py()) for b in batches for k, p, c in zip(*b.columns, strict=True))
        for k, own in itertools.groupby(rows, key=lambda r: r[0]):
            buffer, n = io.BytesIO(), 0
            with zipfile.ZipFile(buffer, "w") as z:
                for path, same in itertools.groupby(own, key=lambda r: r[1]):
                    z.writestr(zipfile.ZipInfo(path, EPOCH), next(same)[2], zipfile.ZIP_DEFLATED)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], k.type), pa.array([n], pa.int32()), pa.array([buffer.getvalue()], pa.binary())], names=[key, "n_entries", "archive"])

    rows = entries.where("path IS NOT NULL AND content IS NOT NULL").select(key, "path", "content")
    return rows.repartition(key).sortWithinPartitions(key, "path", "content").mapInArrow(run, rows.select(key).schema.add("n_entries", "integer").add("archive", "binary"))


def book_entries(books: DataFrame, key: str, root: str, **files: str) -> DataFrame:
    """Entries for zip_books: for each file (path below root: column) of every book. Columns that are no strings become JSON."""
    kinds = dict(books.dtypes)
    made = [F.struct(F.concat_ws("/", F.col(root), F.lit(path)).alias("path"), (F.col(c) if kinds[c] == "string" else F.to_json(c)).alias("content")) for path, c in files.items()]
    return books.select(key, F.explode(F.array(*made)).alias("e")).select(key, "e.path", "e.content")
