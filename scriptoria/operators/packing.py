"""Texts cut to the size of a prompt: whole lines packed together, overlong lines wrapped at words; and passages drawn at random."""

from __future__ import annotations

import textwrap
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROMPT_CHARS = 1500
EDGE = 0.2  # share of a text at either end from which no passage is drawn


def packed(text: str, most: int = PROMPT_CHARS) -> Iterator[str]:
    """Packs of consecutive lines, each pack stripped. A line joins a pack while both have fewer than most characters, a line
    end counted for each line before; a line of most characters or more is wrapped, and its last part begins the next pack."""
    held: list[str] = []
    size = 0
    for line in text.split("\n"):
        if size + len(line) >= most:
            if held:
                yield "\n".join(held).strip()
            parts = [line] if len(line) < most else textwrap.wrap(line, most, break_long_words=False)
            yield from parts[:-1]
            held, size = [], 0
            if not parts:  # a long line of nothing but spaces
                continue
            line = parts[-1]
        held.append(line)
        size += len(line) + 1
    if held:
        yield "\n".join(held).strip()


def pack_lines(docs: DataFrame, key: str = "doc_id", most: int = PROMPT_CHARS) -> DataFrame:
    """key, idx, text of every pack; null texts have none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                packs = list(packed(text.as_py(), most)) if text.is_valid else []
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(packs), pa.int64())), pa.array(range(len(packs)), pa.int32()), pa.array(packs, pa.string())], names=[key, "idx", "text"])

    rows = docs.select(key, "text")
    return rows.mapInArrow(run, rows.select(key).schema.add("idx", "integer").add("text", "string"))


def draw(*by: Column) -> Column:
    """A number from 0 to 2^32 - 1 that looks random and is the same in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in by])), 1, 8), 16, 10).cast("long")


def sample_passages(docs: DataFrame, key: str = "doc_id", least: int = 600, most: int = 1200, seed: str = "p1") -> DataFrame:
    """key, start, passage: a passage of up to most characters from the middle of every text of at least that length, trimmed to whole words."""
    n = F.length("text")
    low, high = F.floor(n * F.lit(EDGE)), F.floor(n * F.lit(1 - EDGE)) - most
    centre = F.greatest(F.lit(0), F.floor(n / 2) - F.lit(most // 2))
    start = F.when(low >= high, centre).otherwise(low + draw(F.col(key), F.lit(seed)) % F.greatest(high - low + 1, F.lit(1)))
    rows = docs.where(n >= least).select(key, "text", start.cast("long").alias("start"))
    rows = rows.withColumn("cut", F.substring("text", F.col("start").cast("int") + 1, F.lit(most)))
    inner = F.regexp_extract("cut", r"(?s)^[^ ]* (.*) [^ ]*$", 1)
    return rows.select(key, "start", F.when(F.col("cut").rlike(r"(?s) .* "), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(F.col("cut")).alias("passage"))


def sample_rows(rows: DataFrame, group: str, key: str, n: int, seed: str = "r1") -> DataFrame:
    """n rows of each group, drawn without replacement; the same in every run."""
    w = Window.partitionBy(group).orderBy(draw(F.col(key), F.lit(seed)), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
