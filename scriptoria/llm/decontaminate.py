"""Benchmark decontamination: which documents hold a benchmark item, by containment of its five-word shingles.

Items are partitioned by size (powers of two of their shingle count). An item's MinHash sketch is the bottom k of
its shingle hashes, with k set by the partition: an item of n shingles that a document holds to the share t misses at
most n - ceil(t n) of them, so among one more than that the document shares at least one. Looking the document's
shingles up in the sketches therefore finds every pair above the threshold; each is then verified on the shingles
themselves. Nothing depends on a document's length, which MinHash of whole documents would.

Defined cases: null or wordless texts hold and are nothing; a text of fewer than five words is one shingle; repeated
rows give one pair; pairs carry null ids as they are; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_words, cut

WORDS, THRESHOLD = 5, 0.8
#: Shingles of all items up to which they are broadcast; beyond it sketches are joined by a shuffle.
MAX_BROADCAST_SHINGLES = 500_000
PAIRS = "doc_id long, text_hash long, item_id long, n_item_shingles long, n_shared long"
_PAIRS = ["doc_id", "text_hash", "item_id", "n_item_shingles", "n_shared"]


def shingles(text: str | None, words: int = WORDS) -> list[bytes]:
    """The text's word shingles, in order, repeats included; a shorter text is one."""
    w = byte_words(text)
    joined = b" ".join(w)
    if len(w) <= words:
        return [joined] if w else []
    out, ends, at = [], [], -1
    for x in w:
        at += 1 + len(x)
        ends.append(at)
    out.append(joined[: ends[words - 1]])
    out += [joined[a + 1 : b] for a, b in zip(ends, ends[words:], strict=False)]
    return out


def hashes(parts: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(p) for p in parts), dtype="u8", count=len(parts))


def least_shared(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def sketch_size(n: int, threshold: float) -> int:
    """Of the size partition that n falls in; at most n."""
    top = (1 << n.bit_length()) - 1
    return min(n, top - least_shared(top, threshold) + 1)


def sketch(parts: set[bytes], threshold: float) -> np.ndarray:
    return np.sort(hashes(list(parts)))[: sketch_size(len(parts), threshold)]


def _pairs(rows: Iterable[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_PAIRS)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_PAIRS)


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, max_broadcast: int = MAX_BROADCAST_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment of every pair with containment >= threshold.

    docs: doc_id, text. items: item_id, text."""
    found = _found(docs, items, threshold, words, max_broadcast)
    found = found.groupBy("doc_id", "item_id").agg(F.max("n_item_shingles").alias("n_item_shingles"), F.max("n_shared").alias("n_shared"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))


def _found(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, max_broadcast: int = MAX_BROADCAST_SHINGLES) -> DataFrame:
    """PAIRS of every row and item with containment >= threshold; text_hash tells rows of one doc_id apart."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    items = items.select(F.col("item_id").cast("long"), "text").distinct()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(shingles(t.as_py(), words)) for t in batch.column(1)], pa.int64())], names=["n"])

    total = items.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    return _by_broadcast(docs, items, threshold, words) if total <= max_broadcast else _by_shuffle(docs, items, threshold, words)


def _by_broadcast(docs: DataFrame, items: DataFrame, threshold: float, words: int) -> DataFrame:
    ids, sets = [], []
    for row in items.toLocalIterator():
        if parts := set(shingles(row["text"], words)):
            ids.append(row["item_id"])
            sets.append(parts)
    sketches = [sketch(s, threshold) for s in sets]
    keys = np.concatenate(sketches) if sketches else np.zeros(0, "u8")
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sketches]) if sketches else np.zeros(0, "i8")
    order = np.argsort(keys, kind="stable")
    held = docs.sparkSession.sparkContext.broadcast((ids, sets, keys[order], owners[order]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, keys, owners = held.value
        maybe = np.zeros(1 << 16, dtype=bool)  # by a hash's last 16 bits
        maybe[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            out = []
            for doc_id, text, text_hash in zip(*batch.columns, strict=True):
                parts = shingles(text.as_py(), words)
                h = hashes(parts)
                h = h[maybe[(h & np.uint64(0xFFFF)).astype(np.int64)]]
                lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
                near = {int(o) for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True) for o in owners[a:b]}
                if near:
                    own = set(parts)
                    for i in sorted(near):
                        shared = len(sets[i] & own)
                        if shared >= least_shared(len(sets[i]), threshold):
                            out.append((doc_id.as_py(), text_hash.as_py(), ids[i], len(sets[i]), shared))
            yield _pairs(out)

    return docs.mapInArrow(run, PAIRS)


def _by_shuffle(docs: DataFrame, items: DataFrame, threshold: float, words: int) -> DataFrame:
    """For many items: sketches and document shingles meet by hash; candidates are verified on both texts."""

    def explode(of_item: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, text in zip(batch.column(0), batch.column(1), strict=True):
                    parts = set(shingles(text.as_py(), words))
                    h = sketch(parts, threshold) if of_item else np.unique(hashes(list(parts)))
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(h), pa.int64()), pa.array(h.view("i8"))], names=["key", "h"])

        return run

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text_hash, item_id, text, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = set(shingles(item, words))
                shared = len(parts & set(shingles(text, words)))
                if shared >= least_shared(len(parts), threshold):
                    out.append((doc_id, text_hash, item_id, len(parts), shared))
            yield _pairs(out)

    sketches = items.mapInArrow(explode(True), "key long, h long").select(F.col("key").alias("item_id"), "h")
    probes = docs.select("text_hash", "text").mapInArrow(explode(False), "key long, h long").select("key", "h")
    near = cut(probes.join(sketches, "h").select(F.col("key").alias("_t"), F.col("item_id").alias("_i")).distinct())
    texts = items.withColumnRenamed("text", "item")
    both = near.join(docs, F.col("_t") == F.col("text_hash")).join(texts, F.col("_i").eqNullSafe(F.col("item_id")))
    return both.select("doc_id", "text_hash", "item_id", "text", "item").mapInArrow(verify, PAIRS)


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows whose text holds an item; other texts under the same doc_id, or null, stay."""
    hit = cut(_found(docs, items, **options).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct())
    rows = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.struct(*docs.columns).alias("_row"))
    return rows.join(hit, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_h")), "left_anti").select("_row.*")
