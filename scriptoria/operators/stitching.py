"""Entities of whole texts from what a model finds in overlapping windows: validated, snapped to words, merged, put at their places in the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entities import NAME, clean_span, is_valid, normal_label, once
from .reading import REACH, snap, trim_span
from .textrows import text_rows

#: Characters of a window that a model reads.
INPUT_CHARS = 2000


def recognise(windows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, label, start, end, score: capitalised words of each window's text, by rules that stand in for a model: its labels carry B- or I-, and its scores repeat by fives."""
    name = re.compile(NAME)

    def found(text: str | None) -> Iterator[tuple]:
        for n, m in enumerate(name.finditer((text or "")[:INPUT_CHARS])):
            yield "B-LOC" if len(m[0]) % 2 else "I-PER", *m.span(), (6 + n % 5) / 10

    return text_rows(windows, keys, ["text"], found, {"label": "string", "start": "integer", "end": "integer", "score": "double"}, "n")


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def _snapped() -> Column:
    """An array of a span's start, end and own text at the edges of words, with the sign before it; empty if the span may not stand.

    Only the span's surroundings are looked at."""
    start, end = F.col("start"), F.col("end")
    base = F.greatest(start - REACH - 1, F.lit(0))

    def kept(at: Column, near: Column) -> Column:
        before = F.least(at["start"], F.lit(1))
        row = F.struct((base + at["start"]).alias("start"), (base + at["end"]).alias("end"), before.alias("_before"), _cut(near, at["start"] - before, at["end"]).alias("_own"))
        return F.when(clean_span(_cut(near, at["start"], at["end"])) != "", F.array(row))

    def moved(near: Column) -> Column:
        word = _cut(near, start - base, end - base)
        edges = once(snap(near, start - base, end - base), lambda s: trim_span(near, s["start"], s["end"]))
        return F.when((word != "") & is_valid(F.col("label"), word, F.col("score")), once(edges, lambda at: kept(at, near)))

    return once(_cut(F.col("_text"), base, end + REACH), moved)


def _judged() -> Column:
    """An array of a merged span's word and places, trimmed; empty if it may not stand."""

    def kept(at: Column, word: Column) -> Column:
        row = F.struct("label", word.alias("word"), (F.col("start") + at["start"]).alias("start"), (F.col("start") + at["end"]).alias("end"), F.round("score", 4).alias("score"))
        return F.when((at["start"] < at["end"]) & is_valid(F.col("label"), word, F.col("score")), F.array(row))

    edges = trim_span(F.col("_text"), F.lit(0), F.length("_text"))
    return once(edges, lambda at: once(clean_span(_cut(F.col("_text"), at["start"], at["end"])), lambda word: kept(at, word)))


def window_entities(windows: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, label, word, start, end, score: a text's entities, each (start, end, label) once.

    windows: key, idx, start (of the window in the text), text. spans: key, idx, n (their order), label, start, end (in the window's text), score.
    Spans that may not stand are dropped; others are moved to the edges of words. Neighbours of one label that touch become one, with the higher score,
    and are judged again. Of windows that overlap the later one's finding stays. Spans beyond INPUT_CHARS, of null labels or texts are none.

    A window's text goes no further than the join: each span takes its own words with it, and what it adds to those that it touches."""
    where = [key, "idx"]
    texts = windows.select(*where, F.col("start").alias("_from"), F.substring("text", 1, INPUT_CHARS).alias("_text"))
    rows = spans.select(*where, "n", normal_label(F.col("label")).alias("label"), "start", "end", "score").join(texts, where)
    rows = rows.select(*where, "n", "label", "score", "_from", F.inline(_snapped()))

    order = Window.partitionBy(*where).orderBy("start", "end", "n")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_other", (~F.lag("label").over(order).eqNullSafe(F.col("label"))).cast("int")).withColumn("_stretch", F.sum("_other").over(run))
    far = F.max("end").over(Window.partitionBy(*where, "_stretch").orderBy("start", "end", "n").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_far", far).withColumn("_new", (F.col("_far").isNull() | (F.col("start") > F.col("_far") + 1)).cast("int")).withColumn("_span", F.sum("_new").over(run))
    # what a span adds: all of it if it begins one, else what lies behind the ends before
    begin = F.when(F.col("_new") == 1, F.col("start")).otherwise(F.col("_far"))
    rows = rows.withColumn("_own", F.substring("_own", begin - F.col("start") + F.col("_before") + 1, F.greatest(F.col("end") - begin, F.lit(0))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "n", "_own"))), lambda x: x["_own"]), "")
    merged = rows.groupBy(*where, "_span").agg(*[F.first(c).alias(c) for c in ("label", "_from")], F.min("start").alias("start"), F.max("score").alias("score"), joined.alias("_text"))

    placed = merged.select(key, "idx", "_from", F.inline(_judged())).withColumn("start", F.col("_from") + F.col("start")).withColumn("end", F.col("_from") + F.col("end"))
    last = F.max_by(F.struct("word", "score"), "idx")
    return placed.groupBy(key, "start", "end", "label").agg(last.alias("_l")).select(key, "label", "_l.word", "start", "end", "_l.score")


def entities_json(entities: DataFrame, key: str, name: Column) -> DataFrame:
    """key, json: a book's entities by their places, their number and the book's name, as one JSON text. name: an expression of key."""
    fields = ("label", "word", "score", "start", "end")
    held = F.array_sort(F.collect_list(F.struct("start", "end", "label", F.struct(*fields).alias("e"))))
    rows = entities.groupBy(key).agg(F.transform(held, lambda x: x["e"]).alias("entities"))
    return rows.select(key, F.to_json(F.struct(name.alias("book_name"), F.size("entities").alias("total_entities"), "entities")).alias("json"))
