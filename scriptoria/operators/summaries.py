"""Hierarchical summaries: sections to batches to books. The summariser is a column function; the default takes a text's longest line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import strip

MACRO_THRESHOLD, MACRO_BATCH, GLOBAL_BATCH = 10, 10, 4
CALL_CHARS = 20_000
Summariser = Callable[[Column], Column]


def gist(text: Column, chars: int = 300) -> Column:
    """A deterministic stand-in for a model, which reads the whole text: its longest line, of equal ones the first, up to chars characters."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct((-F.length(line)).alias("n"), i.alias("i"), line.alias("line")))
    return F.substring(F.array_min(lines)["line"], 1, chars)


def with_gist(docs: DataFrame, keys: str | list[str], text: str) -> DataFrame:
    """keys, text and gist: a summary for each row, made once (a generator's column is not put in the place of each use)."""
    keys = [keys] if isinstance(keys, str) else keys
    return docs.select(*keys, text, F.explode(F.array(gist(F.col(text)))).alias("gist"))


def entity_string(entities: Column) -> Column:
    """Distinct people and places of an array of entities (label, word), without ##, trimmed, of three characters or more, sorted, as one string; a fixed phrase without any."""
    words = F.transform(F.filter(entities, lambda e: e["label"].isin("PER", "LOC")), lambda e: strip(F.replace(e["word"], F.lit("##"), F.lit(""))))
    some = F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3)))
    return F.coalesce(F.nullif(F.array_join(some, ", "), F.lit("")), F.lit("Nessuna entità specifica"))


def sections(chunks: DataFrame, group: str, section: str, order: str, summarise: Summariser = gist) -> DataFrame:
    """group, section, num_chunks, total_chars, summary: a section's chunks in order, joined by one space, summarised."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("text").alias("t"))))
    rows = chunks.groupBy(group, section).agg(F.count(F.lit(1)).alias("num_chunks"), F.sum(F.length("text")).alias("total_chars"), held.alias("held"))
    return rows.select(group, section, "num_chunks", "total_chars", summarise(F.array_join(F.transform("held", lambda x: x["t"]), " ")).alias("summary"))


def batched_sections(chunks: DataFrame, group: str, order: str, budget: int = CALL_CHARS, summarise: Summariser = gist) -> DataFrame:
    """group, summary: a group's texts in order, summarised at once if they are of up to budget characters together, else in batches.

    A batch ends before the text with which it would pass the budget. Summaries of batches, but for empty ones, are summarised again;
    if that gives nothing, they are joined. Null texts are empty."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce("text", F.lit("")).alias("t"))))
    rows = chunks.groupBy(group).agg(held.alias("held")).select(group, F.transform("held", lambda x: x["t"]).alias("texts"))
    # where batches begin, as places in texts, and the characters of the open one
    start = F.struct(F.array(F.lit(0)).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def step(acc: Column, t: Column) -> Column:
        full = (acc["i"] > F.element_at(acc["at"], -1)) & (acc["n"] + F.length(t) > budget)
        return F.struct(
            F.when(full, F.concat(acc["at"], F.array(acc["i"]))).otherwise(acc["at"]).alias("at"),
            F.when(full, F.length(t)).otherwise(acc["n"] + F.length(t)).alias("n"), (acc["i"] + 1).alias("i"),
        )

    rows = rows.withColumn("at", F.aggregate("texts", start, step)["at"]).withColumn("text", F.array_join("texts", "\n\n"))
    ends = F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.size("texts")))
    parts = F.transform(F.arrays_zip(F.col("at").alias("a"), ends.alias("b")), lambda x: F.array_join(F.slice("texts", x["a"] + 1, x["b"] - x["a"]), "\n\n"))
    rows = rows.withColumn("said", F.filter(F.transform(parts, lambda p: summarise(p)), lambda s: s != ""))
    merged = F.coalesce(F.nullif(summarise(F.array_join("said", "\n\n")), F.lit("")), F.array_join("said", " "))
    several = F.when(F.size("said") > 1, merged).otherwise(F.array_join("said", ""))
    return rows.select(group, F.when(F.length("text") <= budget, summarise(F.col("text"))).otherwise(several).alias("summary"))


def _reduce(rows: DataFrame, group: str, least: int, k: int, summarise: Summariser) -> DataFrame:
    """Groups of more than least rows (at, summary) become one row for each k, in order; others stay."""
    w = Window.partitionBy(group)
    rows = rows.where(F.trim("summary") != "").withColumn("n", F.count(F.lit(1)).over(w)).withColumn("nth", F.row_number().over(w.orderBy("at")) - 1)
    rows = rows.withColumn("batch", F.when(F.col("n") > least, F.floor(F.col("nth") / k)).otherwise(F.col("nth"))).withColumn("many", F.col("n") > least)
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "summary"))), lambda x: x["summary"]), "\n\n")
    some = rows.groupBy(group, "batch", "many").agg(held.alias("joined"))
    return some.select(group, F.col("batch").alias("at"), F.when(F.col("many"), summarise(F.col("joined"))).otherwise(F.col("joined")).alias("summary"))


def books(section_rows: DataFrame, group: str, section: str, summarise: Summariser = gist) -> DataFrame:
    """group, parts, global_summary: macro batches of ten if there are more than ten, partial ones of four if more than four, then the whole."""
    macro = _reduce(section_rows.select(group, F.col(section).alias("at"), "summary"), group, MACRO_THRESHOLD, MACRO_BATCH, summarise)
    partial = _reduce(macro, group, GLOBAL_BATCH, GLOBAL_BATCH, summarise)
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "summary"))), lambda x: x["summary"]), "\n\n")
    return partial.groupBy(group).agg(F.count(F.lit(1)).alias("parts"), held.alias("global_summary"))
