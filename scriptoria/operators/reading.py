"""Spans and texts as a reader sees them: snapping to words, highlighting, loose one-to-one matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entities import fuzzy_match, once

#: Characters that part words, and how far a span may grow or shrink.
PARTS = r"\s'\"()\[\]{}.,;:!?\-–—/\\"
REACH = 2


def _run(text: Column, regex: str) -> Column:
    return F.length(F.regexp_extract(text, f"(?U){regex}", 0))


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def snap(text: Column, start: Column, end: Column) -> Column:
    """start, end moved to the edges of words: each side grows by up to two characters, or else gives up to two that part words."""
    grown = _run(_between(text, F.greatest(start - REACH, F.lit(0)), start), f"[^{PARTS}]*\\z")
    shed = _run(_between(text, start, F.least(start + REACH, end)), f"^[{PARTS}]*")
    more = _run(_between(text, end, end + REACH), f"^[^{PARTS}]*")

    def ends(begin: Column, more: Column) -> Column:
        less = _run(_between(text, F.greatest(begin, end - REACH), end), f"[{PARTS}]*\\z")
        return F.struct(begin.alias("start"), F.when(more > 0, end + more).otherwise(end - less).alias("end"))

    begin = once(grown, lambda g: F.when(g > 0, start - g).otherwise(start + shed))
    return once(F.struct(begin.alias("b"), more.alias("m")), lambda x: ends(x["b"], x["m"]))


def snap_every(docs: DataFrame, step: int, width: int) -> DataFrame:
    """doc_id, at, start, end: spans of width characters at each step-th place of a text, snapped.

    A text falls into stretches of a hundred steps in one pass, each with its neighbours' signs within reach, so that no span looks at a whole text."""
    block, behind = 100 * step, width + REACH
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.length("text").alias("_n"), F.regexp_extract_all(F.concat("text", F.lit(" ")), F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("_b"))
    # the blank added to a text makes the stretch of its last place; it is no part of the text
    rows = texts.select("doc_id", "_n", F.posexplode(F.transform("_b", lambda b, i: F.concat(F.when(i > 0, F.substring(F.get("_b", i - 1), -REACH, REACH)).otherwise(""), b, F.coalesce(F.substring(F.get("_b", i + 1), 1, behind), F.lit("")))))).toDF("doc_id", "_n", "_i", "_near")
    begin = F.col("_i") * block
    base = F.greatest(begin - REACH, F.lit(0))
    rows = rows.select("doc_id", "_n", base.alias("_base"), F.substring("_near", F.lit(1), F.col("_n") - base).alias("_near"), F.explode(F.sequence(begin, F.least(begin + block - step, F.col("_n")), F.lit(step))).alias("at"))
    low = F.greatest(F.col("at") - REACH, F.lit(0))
    near = F.substring("_near", low - F.col("_base") + 1, F.lit(behind + 2 * REACH))
    rows = rows.select("doc_id", "at", low.alias("_low"), near.alias("_near"), (F.col("at") - low).alias("_s"), (F.least(F.col("at") + width, F.col("_n")) - low).alias("_e"))
    snapped = rows.select("doc_id", "at", "_low", snap(F.col("_near"), F.col("_s"), F.col("_e")).alias("s"))
    return snapped.select("doc_id", "at", (F.col("_low") + F.col("s.start")).alias("start"), (F.col("_low") + F.col("s.end")).alias("end"))


def trim_span(text: Column, start: Column, end: Column) -> Column:
    """start, end without characters that part words at either side."""
    span = _between(text, start, end)
    begin = start + _run(span, f"^[{PARTS}]*")
    return F.struct(begin.alias("start"), F.greatest(begin, end - _run(span, f"[{PARTS}]*\\z")).alias("end"))


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def highlight(text: Column, entities: Column) -> Column:
    """HTML with a span around every occurrence of the entities' words (label, word): from left to right, the longest
    that begins at a place, none inside another; a word of several labels has its first. Line ends become <br>."""
    some = F.filter(entities, lambda e: e["word"] != "")
    words = F.array_distinct(F.transform(some, lambda e: e["word"]))
    by_length = F.reverse(F.array_sort(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
    quoted = F.transform(by_length, lambda x: F.concat(F.lit(r"\Q"), F.replace(x["w"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    regex = F.when(F.size(words) > 0, F.array_join(quoted, "|")).otherwise("(?!)")
    plain = F.split(text, regex, -1)

    def marked(hit: Column) -> Column:
        label = F.element_at(F.filter(some, lambda e: e["word"] == hit), 1)["label"]
        return F.concat(F.lit('<span class="hl-'), F.lower(label), F.lit('" title="'), label, F.lit('">'), escape_html(hit), F.lit("</span>"))

    hits = F.regexp_extract_all(text, regex, F.lit(0))
    parts = F.zip_with(plain, hits, lambda p, h: F.concat(escape_html(p), F.when(h.isNull(), "").otherwise(marked(h))))
    return F.replace(F.array_join(parts, ""), F.lit("\n"), F.lit("<br>"))


def match_one_to_one(gold: Column, found: Column) -> Column:
    """Pairs (gold, found), in the order of gold: each takes the first of found that matches it loosely and is not taken. Both are one passage's normalised words."""
    places = F.transform(found, lambda f, i: i)
    empty = F.array().cast("array<struct<g:int,f:int>>")

    def step(pairs: Column, g: Column) -> Column:
        free = F.filter(places, lambda i: ~F.exists(pairs, lambda p: p["f"] == i) & fuzzy_match(F.get(gold, g), F.get(found, i)))
        return F.when(F.size(free) > 0, F.array_append(pairs, F.struct(g.alias("g"), F.get(free, F.lit(0)).alias("f")))).otherwise(pairs)

    pairs = F.aggregate(F.transform(gold, lambda g, i: i), empty, step)
    return F.transform(pairs, lambda p: F.struct(F.get(gold, p["g"]).alias("gold"), F.get(found, p["f"]).alias("found")))
