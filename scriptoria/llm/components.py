"""Connected components of an edge table: tasks contract CHUNK edges at a time to stars, then large-star and small-star rounds of plain joins go on, if there are more."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Edges that a task contracts at a time; a table of no more is done with that.
CHUNK = 500_000


def link(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the groups of u[i] and v[i]; root keeps pointing straight at the least member."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, further := root[root]):
            root[:] = further


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the components that some edges make: each vertex but the least with the least."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(names))
    link(root, at[: len(u)], at[len(u) :])
    some = np.flatnonzero(root != np.arange(len(names)))
    return names[some], names[root[some]]


def _contracted(edges: DataFrame, n: int, chunk: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= chunk:
                yield of(held)
                held, size = [], 0
        if held:
            yield of(held)

    def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = stars(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v"])

    return cut(edges.coalesce(-(-n // chunk)).mapInArrow(run, "u long, v long"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u (all are larger than their v) has one edge and is no other's v: then each component is a star around its least vertex."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    ends = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.agg(F.count_if((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))).first()[0] == 0


def star_components(edges: DataFrame, chunk: int = CHUNK, most_rounds: int = 60) -> DataFrame:
    """u, v: every vertex that has an edge and is not the least of its component, and that least vertex.

    edges: u, v (long, not null); loops and repeats do no harm. Each round is written to the shared folder.
    """
    now = cut(edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")))
    for _ in range(most_rounds):
        n = now.count()
        if not n:
            return now
        less = _contracted(now, n, chunk)
        drop_cut(now)
        if n <= chunk or _are_stars(less):
            return less
        now = cut(_small_star(_large_star(less)))
        drop_cut(less)
    raise RuntimeError(f"no stars after {most_rounds} rounds")
