"""Readers of books, and the catalog's incremental intake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOOK = T.StructType([T.StructField(n, T.StringType()) for n in ("identifier", "type", "title", "publication", "date", "language", "description", "contenuto", "text", "content")] + [T.StructField("author", T.StructType([T.StructField("name", T.StringType())])), T.StructField("subject", T.ArrayType(T.StringType()))])


def read_books(spark: SparkSession, path: str, pattern: str = "*", ordered: bool = False) -> DataFrame:
    """One row for each file, JSON or plain text: file_name, title, author, text. The text is contenuto, text or content, else the whole file.

    pattern: which names are read, such as *.json*; ordered: by name."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"), "value")
    book = F.from_json("value", BOOK)
    rows = raw.select("file_name", "value", book.alias("b"), F.try_parse_json("value").isNotNull().alias("is_json"))
    has = lambda k: F.array_contains(F.json_object_keys("value"), k)  # noqa: E731  a key decides by being there, even with null
    first = F.when(has("contenuto"), F.col("b.contenuto")).when(has("text"), F.col("b.text")).when(has("content"), F.col("b.content")).otherwise("")
    text = F.when(F.col("is_json"), first).otherwise(F.col("value"))
    books = rows.select("file_name", "b.title", F.col("b.author.name").alias("author"), text.alias("text"))
    return books.orderBy("file_name") if ordered else books


def unseen(files: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    return files.join(catalog, key, "left_anti")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key, by the given columns (null comes first): an aggregation, so a key with many rows is reduced where they lie."""
    others = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def read_chunks(spark: SparkSession, path: str, method: str, book: str) -> DataFrame:
    """A book's chunks in order, of those that write_chunks wrote; other books' folders are not read."""
    return spark.read.parquet(path).where((F.col("method") == method) & (F.col("book_name") == book)).orderBy("chunk_id")


def listed_chunks(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """method, book_name, chunk_id, topic_hint (the manifest's), text: chunks that a manifest lists; those that are missing are passed over."""
    listed = manifests.select("method", "book_name", F.explode("chunks").alias("c")).select("method", "book_name", "c.chunk_id", "c.topic_hint")
    return listed.join(chunks.select("method", "book_name", "chunk_id", "text"), ["method", "book_name", "chunk_id"])


def title_of(file_name):
    """A title from a file's name: without .json and what comes before the first _, dashes as spaces, words capitalised."""
    return F.initcap(F.replace(F.regexp_replace(F.regexp_replace(file_name, r"\.json$", ""), r"^[^_]*_", ""), F.lit("-"), F.lit(" ")))
