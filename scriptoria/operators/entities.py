"""Entity spans: extraction by a deterministic stand-in, validity, de-duplication, merging, containment, retention."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textrows import text_lists

#: Fixed values.
LABELS = ("PER", "LOC", "ORG", "WORK", "DATE", "EVENT", "TIT", "REL", "FANT")
DATE = r"(?i)^(\d{3,4}|\d{1,2}\s+[a-zà-ù]+\s+\d{3,4}|[ivxlcdm]{1,7})$"
STOP = r"(?i)^(il|lo|la|i|gli|le|un|uno|una|di|de|del|dello|della|dei|degli|delle|e|o|a|da|in|su|con|per|tra|fra|l|d)$"
SCORE, SURE_DATE, SURE_FANT = 0.65, 0.85, 0.75
NAME = r"[A-Z][a-z]{2,}"  # what stands in for a model's spans


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, pos, word, label of capitalised words, by rules that stand in for a model: PER by length, else LOC."""
    words = F.regexp_extract_all("text", F.lit(NAME), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(words).alias("pos", "word"))
    return rows.withColumn("label", F.when(F.length("word") % 2 == 0, "PER").otherwise("LOC"))


def extract_spans(docs: DataFrame) -> DataFrame:
    """extract() with start and end, in characters of the text."""
    name = re.compile(NAME)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                found = [(row, *m.span(), m[0], pos) for row, text in enumerate(part.column(1).to_pylist()) for pos, m in enumerate(name.finditer(text or ""))]
                row, start, end, word, pos = zip(*found, strict=True) if found else ([], [], [], [], [])
                label = ["LOC" if len(w) % 2 else "PER" for w in word]
                kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, k) for x, k in zip((pos, word, label, start, end), kinds, strict=True))], names=["doc_id", "pos", "word", "label", "start", "end"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("pos", "integer").add("word", "string").add("label", "string").add("start", "integer").add("end", "integer"))


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, entities: extract_spans()' spans of each text, by place, made where the text lies."""
    name = re.compile(NAME)

    def spans(text: str | None) -> Iterator[tuple[int, int, str, str]]:
        return ((*m.span(), m[0], "LOC" if len(m[0]) % 2 else "PER") for m in name.finditer(text or ""))

    return text_lists(docs, ["doc_id", "text"], ["text"], spans, {"start": "integer", "end": "integer", "word": "string", "label": "string"}, "entities")


def normal_label(label: Column) -> Column:
    return F.upper(F.replace(F.replace(label, F.lit("B-"), F.lit("")), F.lit("I-"), F.lit("")))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once however often f names it."""
    return F.transform(F.array(x), f)[0]


def is_valid(label: Column, word: Column, score: Column) -> Column:
    """Whether a span, cleaned first, may stand."""
    date = label == "DATE"

    def fits(word: Column) -> Column:
        letters = F.length(F.regexp_replace(word, r"[^\p{L}]", "")) / F.greatest(F.length(word), F.lit(1))
        return (
            (word != "") & (date | ((F.length(word) >= 3) & (letters >= 0.6)))
            & F.when(date, word.rlike(DATE) | (score >= SURE_DATE)).otherwise(~word.rlike(STOP))
            & ((label != "PER") | word.rlike(r"\p{Lu}")) & ((label != "FANT") | (score >= SURE_FANT))
        )

    return label.isin(*LABELS) & (score >= SCORE) & once(clean_span(word), fits)


def _one_by(pick, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key the one that pick (min_by or max_by) takes by order: an aggregation, without a sort of a key's rows."""
    others = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(pick(F.struct(*others), F.struct(order)).alias("_row"))
    return one.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows of one key the first; all keys in the order in which they come first."""
    return _one_by(F.min_by, rows, keys, order)


def word_counts(spans: DataFrame) -> DataFrame:
    """word (trimmed), n, label: that of the word's first span, by doc_id and pos."""
    return spans.groupBy(F.trim("word").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.min_by("label", F.struct("doc_id", "pos")).alias("label"))


def valid_gold(samples: DataFrame, json: str, least: int = 50) -> DataFrame:
    """samples with the label and text of their JSON, of known labels and texts of least characters or more."""
    read = samples.withColumn("_s", F.from_json(json, "label string, text string"))
    read = read.withColumn("label", F.col("_s.label")).withColumn("text", F.col("_s.text")).drop("_s")
    return read.where(F.col("label").isin(*LABELS) & (F.length("text") >= least))


def last_wins(spans: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows of one key the last."""
    return _one_by(F.max_by, spans, keys, order)


def merge_spans(spans: DataFrame, group: str) -> DataFrame:
    """Neighbours in order of (start, end) of one label that touch (start <= end before + 1) become one span."""
    w = Window.partitionBy(group).orderBy("start", "end", "label")
    run = Window.partitionBy(group).orderBy("start", "end", "label").rowsBetween(Window.unboundedPreceding, 0)
    rows = spans.withColumn("_relabel", (~F.lag("label").over(w).eqNullSafe(F.col("label"))).cast("int")).withColumn("_stretch", F.sum("_relabel").over(run))
    within = Window.partitionBy(group, "_stretch").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    far = F.max("end").over(within)
    rows = rows.withColumn("_new", (far.isNull() | (F.col("start") > far + 1)).cast("int")).withColumn("_span", F.sum("_new").over(run))
    return rows.groupBy(group, "_span", "label").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")).drop("_span")


def contained(chunks: DataFrame, spans: DataFrame, key: str, width: int = 2000) -> DataFrame:
    """Spans that lie inside chunks (char_start, char_end): an equi-join on key and on blocks of width, then the exact test."""
    blocks = F.explode(F.sequence(F.floor(F.col("char_start") / width), F.floor(F.col("char_end") / width)))
    left = chunks.withColumn("_block", blocks)
    right = spans.withColumn("_block", F.floor(F.col("start") / width))
    return left.join(right, [key, "_block"]).where("start >= char_start AND end <= char_end").drop("_block")


def entity_counts(chunks: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, char_start, num_entities of every chunk; 0 for those without entities."""
    inside = contained(chunks.select(key, "char_start", "char_end"), spans, key).groupBy(key, "char_start").agg(F.count(F.lit(1)).alias("_n"))
    return chunks.select(key, "char_start").join(inside, [key, "char_start"], "left").select(key, "char_start", F.coalesce("_n", F.lit(0)).alias("num_entities"))


def retention_keys(entities: Column) -> Column:
    """Distinct names, in lower case, of an array of entities (label, word): people and places of three characters or more, sorted."""
    some = F.filter(entities, lambda e: e["label"].isin("PER", "LOC"))
    words = F.transform(some, lambda e: F.lower(F.trim(F.replace(e["word"], F.lit("##"), F.lit("")))))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3)))


def _within(keys: Column, summary: Column) -> Column:
    """Those of keys that the lower-cased summary holds; it is lower-cased once."""
    return once(F.lower(summary), lambda low: F.filter(keys, lambda k: F.contains(low, k)))


def retention_report(entities: Column, summary: Column) -> Column:
    """retention_percent (100 without names), total_key_entities, survived, lost: which names of entities (label, word) occur in the lower-cased summary."""
    keys = retention_keys(entities)
    survived = _within(keys, summary)
    percent = F.when(F.size(keys) == 0, 100.0).otherwise(F.round(F.size(survived) * 100.0 / F.greatest(F.size(keys), F.lit(1)), 1))
    return F.struct(percent.alias("retention_percent"), F.size(keys).cast("long").alias("total_key_entities"), survived.alias("survived"), F.array_except(keys, survived).alias("lost"))


def retention_global(words: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total_unique_entities, found_in_global, retention_percent: names of a whole book (keys, word, label) that its summary (keys, summary; one row) has.

    Every book of summaries has a row; one without names retains 0."""
    word = F.lower(F.trim(F.replace("word", F.lit("##"), F.lit(""))))
    names = words.where(F.col("label").isin("PER", "LOC")).select(*keys, word.alias("word")).where(F.length("word") >= 3).distinct()
    held = summaries.select(*keys, F.lower("summary").alias("summary")).join(names, keys, "left")
    found = held.groupBy(*keys).agg(F.count("word").alias("total_unique_entities"), F.count_if(F.contains(F.coalesce("summary", F.lit("")), F.col("word"))).alias("found_in_global"))
    return found.withColumn("retention_percent", F.coalesce(F.round(F.col("found_in_global") * 100.0 / F.nullif("total_unique_entities", F.lit(0)), 1), F.lit(0.0)))


def retention(keys: Column, summary: Column, none: float = 100.0) -> Column:
    """Per cent of distinct keys that occur, anywhere, in the lower-cased summary."""
    distinct = F.array_distinct(F.transform(keys, lambda k: F.lower(k)))
    found = F.size(_within(distinct, summary))
    return F.when(F.size(distinct) == 0, none).otherwise(F.round(found * 100.0 / F.greatest(F.size(distinct), F.lit(1)), 1))


def clean_span(word: Column) -> Column:
    """White space, then punctuation, off both ends; runs of white space to one space."""
    for edge in (r"(?U)\s+", r"['’\"“”‘()\[\]{}.,;:!?\-]+"):
        word = F.regexp_replace(word, f"^{edge}|{edge}\\z", "")
    return F.regexp_replace(word, r"(?U)\s+", " ")


def normal_word(word: Column) -> Column:
    """Lower case, letters, digits and spaces only, trimmed."""
    return F.trim(F.regexp_replace(F.lower(word), r"(?U)[^\p{Alnum}\s]", ""))


def fuzzy_match(a: Column, b: Column) -> Column:
    """Equal; or one of three characters or more inside the other; or equal without spaces."""
    tight = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return (a == b) | ((F.length(a) >= 3) & F.contains(b, a)) | ((F.length(b) >= 3) & F.contains(a, b)) | (tight(a) == tight(b))


def join_wordpieces(tokens: DataFrame, group: str, order: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """group, word, label: tokens (label, word) joined to whole words and normalised; each (word, label) of two characters or more once.

    A token that begins with ## goes on the word before it, under that word's label; tokens of other labels end a word."""
    w = Window.partitionBy(group).orderBy(order)
    rows = tokens.select(group, order, "word", "label", F.col("label").isin(*labels).alias("known"))
    rows = rows.withColumn("goes_on", F.col("word").startswith("##"))
    rows = rows.withColumn("run", F.sum(F.when(F.col("known") & F.col("goes_on"), 0).otherwise(1)).over(w))
    rows = rows.withColumn("of", F.last(F.when(F.col("known") & ~F.col("goes_on"), F.col("label")), ignorenulls=True).over(w)).where("known")
    words = rows.groupBy(group, "run").agg(F.array_sort(F.collect_list(F.struct(F.col(order), "word"))).alias("parts"), F.first("of").alias("label"))
    joined = F.array_join(F.transform("parts", lambda p: F.replace(p["word"], F.lit("##"), F.lit(""))), "")
    return words.select(group, normal_word(joined).alias("word"), F.coalesce("label", F.lit("")).alias("label")).where(F.length("word") >= 2).distinct()
