"""Embeddings without a model file: signed random projections of hashed character trigrams, equal on every machine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers of a vector, buckets of trigrams, the projection's seed; texts that are embedded at a time.
SIZE, BUCKETS, SEED, BATCH = 64, 4096, 7, 50


@lru_cache(maxsize=2)
def projection(size: int = SIZE, seed: int = SEED) -> np.ndarray:
    """Of each bucket a vector of 1 and -1; made once for each worker."""
    return np.random.default_rng(seed).integers(0, 2, (BUCKETS, size)).astype(np.float64) * 2 - 1


def trigram_counts(text: str | None) -> np.ndarray:
    """How often trigrams of the lower-cased text, with a space at either end, fall to each bucket."""
    if not text:
        return np.zeros(BUCKETS, dtype=np.int64)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return np.bincount((c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % BUCKETS, minlength=BUCKETS)


def embed(texts: list[str | None]) -> np.ndarray:
    """A row for each text; zeros for one without characters. Counts are damped by their square root, to 1024ths: so sums are exact in any order."""
    counts = np.array([trigram_counts(t) for t in texts], dtype=np.float64).reshape(len(texts), BUCKETS)
    return (np.rint(np.sqrt(counts) * 1024) @ projection() / 1024).astype(np.float32)


def with_embeddings(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with embedding (an array of floats) of their text, in batches of BATCH texts."""
    schema = rows.selectExpr("*", "CAST(NULL AS ARRAY<FLOAT>) AS embedding").schema
    at = rows.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                made = embed(part.column(at).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, SIZE), pa.int32()), pa.array(made.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "embedding"])

    return rows.mapInArrow(run, schema)
