"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Hashed counts of words and of word shapes (letter case, digits, signs; runs
collapsed), and of repeated word pairs, are weighted by inverse document
frequency over all documents and projected on the leading right singular vectors of a bounded sample of labelled rows.
The sample's vectors are broadcast; each document's cosine with every one of them is computed in blocks, and the
labels of its K nearest vote with the squares of their similarities.

Bounds: SAMPLE labelled rows (smallest md5 of doc_id) and DIM features, so what the driver holds and broadcasts
does not grow. Labels, lang, source and doc_id are no features.

Defined cases: null texts are empty; texts without words, and all texts if nothing is labelled, get the prior, the mean
label of the sample (0.5 without one); several labels of one doc_id are averaged, 0.5 and more count as 1; of rows with one doc_id the
least text is learnt from, each is scored; an empty table gives no rows; columns named like the results are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_words, without

WORD_DIM, SHAPE_DIM, REPEAT_DIM = 2048, 512, 8
DIM = WORD_DIM + SHAPE_DIM + REPEAT_DIM
SAMPLE, RANK, K = 2048, 48, 15
KEEP = 0.7
ROWS = 256
_SHAPE = bytes(ord("A") if 65 <= i <= 90 else ord("9") if 48 <= i <= 57 else ord("a") if 97 <= i <= 122 or i >= 128 else i for i in range(256))
_RUN = re.compile(rb"([A-Za9])\1+")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of a text's features."""
    listed = byte_words(text)
    words, again = Counter(listed), max(0, len(listed) - 1 - len(set(zip(listed, listed[1:], strict=False))))
    shapes = Counter(_RUN.sub(rb"\1", (text or "").encode("utf-8", "surrogatepass").translate(_SHAPE)).split())
    at = [zlib.crc32(w) % WORD_DIM for w in words] + [WORD_DIM + zlib.crc32(s) % SHAPE_DIM for s in shapes]
    n = [*words.values(), *shapes.values()]
    if again:  # word pairs that came before, by their share of all
        at.append(WORD_DIM + SHAPE_DIM + min(REPEAT_DIM - 1, again * REPEAT_DIM // len(listed)))
        n.append(again)
    places, inverse = np.unique(np.array(at, dtype=np.int64), return_inverse=True)
    return places, np.bincount(inverse, weights=n, minlength=len(places)) if len(at) else np.zeros(0)


def vectors(texts: Iterable[str | None], idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of unit length (zero for texts without words)."""
    rows = []
    for text in texts:
        row = np.zeros(DIM, dtype=np.float32)
        at, n = features(text)
        row[at] = (1 + np.log(n)) * idf[at]
        rows.append(row)
    x = np.stack(rows) if rows else np.zeros((0, DIM), dtype=np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents, and of those that have each feature; over all documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df[features(text.as_py())[0]] += 1
            n += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["place", "n"])

    df = np.zeros(DIM + 1, dtype=np.int64)
    for place, n in docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n")).collect():
        df[place] = n
    return int(df[-1]), df[:-1]


def leading_directions(x: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """The first right singular vectors of x, by subspace iteration; as columns."""
    q = np.random.default_rng(seed).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, right = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ right.T)[:, :rank]


def votes(z: np.ndarray, known: np.ndarray, labels: np.ndarray, prior: float, k: int = K) -> np.ndarray:
    """Scores of latent rows z: labels of the k nearest known rows, weighted by squared similarity."""
    cosine = z @ known.T
    k = min(k, known.shape[0])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 2
    total = weight.sum(axis=1)
    return np.where(total > 1e-9, (weight * labels[near]).sum(axis=1) / np.maximum(total, 1e-9), prior).clip(0, 1)


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """docs with held_out, score and predicted, in place of columns of these names."""
    docs = without(docs, "held_out", "score", "predicted")
    names = docs.columns
    train = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").alias("_id"), "text")
    train = train.join(texts.select("_id").distinct(), train.doc_id == F.col("_id"), "left_semi")
    chosen = train.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    rows = texts.join(F.broadcast(chosen), F.col("_id") == F.col("doc_id")).groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def sparse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in each], pa.binary()), pa.array([n.astype("f4").tobytes() for _, n in each], pa.binary())], names=["doc_id", "label", "at", "n"])

    n, df = document_frequencies(docs)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    learnt = sorted(rows.mapInArrow(sparse, "doc_id long, label int, at binary, n binary").collect())
    x = np.zeros((len(learnt), DIM), dtype=np.float32)
    for row, (_, _, at, count) in zip(x, learnt, strict=True):
        places = np.frombuffer(at, dtype="i8")
        row[places] = (1 + np.log(np.frombuffer(count, dtype="f4"))) * idf[places]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    y = np.array([r[1] for r in learnt], dtype=np.float64)
    prior = float(y.mean()) if len(y) else 0.5
    directions = leading_directions(x) if len(y) else np.zeros((DIM, 1), dtype=np.float32)
    held = docs.sparkSession.sparkContext.broadcast((idf, directions, _unit(x @ directions), y, prior))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, directions, known, y, prior = held.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                rows = batch.column(0).slice(i, ROWS)
                z = _unit(vectors((t.as_py() for t in rows.field(text)), idf) @ directions)
                s = votes(z, known, y, prior) if len(y) else np.full(len(rows), prior)
                yield pa.RecordBatch.from_arrays([rows, pa.array(s)], names=["_row", "score"])

    text = [c.lower() for c in names].index("text")
    packed = docs.select(F.struct(*names).alias("_row"))
    schema = packed.select("_row").schema.add("score", "double")
    out = packed.mapInArrow(score, schema).select("_row.*", "score")
    return out.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= keep).cast("int"))
