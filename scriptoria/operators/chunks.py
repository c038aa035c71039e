"""Chunks of texts: lines, windows, boundaries, islands and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import strip
from .ordering import numbered
from .splitting import PIECE, paragraphs
from .textrows import text_rows


def line_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, idx, text of every line that is not blank."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text")).where(F.trim("text") != "")


def sliding_windows(docs: DataFrame, size: int = 2000, overlap: int = 300) -> DataFrame:
    """doc_id, start, end of windows of size characters that overlap; the last ends with the text."""
    n, stride = F.length("text"), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)
    rows = docs.where(n > 0).select("doc_id", n.alias("n"), F.explode(starts).alias("start"))
    return rows.select("doc_id", "start", F.least(F.col("start") + size, F.col("n")).alias("end"))


def window_texts(docs: DataFrame, size: int = 2000, overlap: int = 300) -> DataFrame:
    """doc_id, idx (from 0), start, text of the windows of sliding_windows, made where a text lies."""
    n, stride = F.length("text"), size - overlap
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int"))
    rows = docs.where(n > 0).select("doc_id", "text", F.explode(numbers).alias("idx")).withColumn("start", F.col("idx") * stride)
    return rows.select("doc_id", "idx", "start", F.substring("text", F.col("start") + 1, F.lit(size)).alias("text"))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def embedding_boundaries(vectors: DataFrame, group: list[str], order: str, threshold: float = 0.35) -> DataFrame:
    """vectors with sim (cosine to the one before), boundary and section (its number in the group); fewer than three vectors have no boundary."""
    w = Window.partitionBy(*group).orderBy(order)
    rows = vectors.withColumn("sim", cosine(F.lag("embedding").over(w), F.col("embedding"))).withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    rows = rows.withColumn("boundary", F.coalesce(F.col("sim") < threshold, F.lit(False)) & (F.col("_of") >= 3)).drop("_of")
    return rows.withColumn("section", F.sum(F.col("boundary").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def frame_boundaries(rows: DataFrame, group: list[str], order: str, keys: str, frame: int, least: int) -> DataFrame:
    """A boundary falls before a row that shares fewer than least keys with the frame rows before it, taken together."""
    w = Window.partitionBy(*group).orderBy(order)
    before = F.array_distinct(F.flatten(F.collect_list(keys).over(w.rowsBetween(-frame, -1))))
    shared = F.size(F.array_intersect(before, F.col(keys)))
    first = F.row_number().over(w) == 1
    return rows.withColumn("shared", F.when(~first, shared)).withColumn("boundary", ~first & (shared < least))


def chapters(rows: DataFrame, group: list[str], order: str, keys: str) -> DataFrame:
    """group, section, first, last, keys, chapter: rows cut into sections where no key of the four rows before recurs, and
    sections into chapters where fewer than two keys of the three sections before do."""

    def numbered(some: DataFrame, by: str, name: str, frame: int, least: int) -> DataFrame:
        cut = frame_boundaries(some, group, by, keys, frame, least)
        return cut.withColumn(name, F.sum(F.col("boundary").cast("int")).over(Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))

    sections = numbered(rows, order, "section", 4, 1).groupBy(*group, "section").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.array_distinct(F.flatten(F.collect_list(keys))).alias(keys)
    )
    return numbered(sections, "section", "chapter", 3, 2).withColumn("chapter", F.col("chapter") + 1).drop("shared", "boundary")


def boundary_union(*lists: Column) -> Column:
    """Lists of boundaries as one, sorted, each once."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*lists))))


def islands(rows: DataFrame, group: list[str], order: str, value: Column) -> DataFrame:
    """rows with island: the number of the run of equal values."""
    w = Window.partitionBy(*group).orderBy(order)
    rows = rows.withColumn("_value", value)
    change = (~F.lag("_value").over(w).eqNullSafe(F.col("_value"))).cast("int")
    return rows.withColumn("_change", change).withColumn("island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_value", "_change")


def budget_batches(rows: DataFrame, group: list[str], order: str, text: str, budget: int) -> DataFrame:
    """group, batches: lengths of greedy batches: a new one starts where a row would pass the budget, unless none is in the batch yet."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce(F.length(text), F.lit(0)).alias("n"))))
    # the lengths of the open batch's rows and of those done; one that holds only empty rows is open too
    empty = F.struct(F.lit(0).alias("rows"), F.lit(0).alias("open"), F.array().cast("array<int>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["rows"] > 0) & (acc["open"] + x["n"] > budget)
        return F.struct(
            F.when(full, 1).otherwise(acc["rows"] + 1).alias("rows"), F.when(full, x["n"]).otherwise(acc["open"] + x["n"]).alias("open"),
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
        )

    folded = F.aggregate(held, empty, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    return rows.groupBy(*group).agg(folded.alias("batches"))


def fixed_batches(rows: DataFrame, group: list[str], order: str, k: int) -> DataFrame:
    """rows with batch: each k rows of a group, by order (whole numbers), make one."""
    return numbered(rows, group, order, "batch").withColumn("batch", F.floor((F.col("batch") - 1) / k))


#: Fixed value: headings of chapters; with case ignored, Roman numerals match a few Italian words too, as they are meant to.
HEADING = r"(?iU)\b(CAPITOLO|CAPO|CAP\.|LIBRO|PARTE)\s+([IVXLCDM]+|\d+)\b"


def is_heading(text: Column) -> Column:
    return text.rlike(HEADING)


def section_number(hint: Column) -> Column:
    """The first integer of a topic hint; 0 without one."""
    return F.coalesce(F.regexp_extract(hint, r"(\d+)", 1).try_cast("int"), F.lit(0))


def base_topic(hint: Column) -> Column:
    return strip(F.regexp_replace(hint, r"(?U)\s*\(parte.*?\)", ""))


def pseudo_paragraphs(docs: DataFrame, target: int = 500) -> DataFrame:
    """doc_id, idx, text, char_start, char_end of pseudo-paragraphs: sentences joined until they reach target characters."""
    return text_rows(docs, ["doc_id"], ["text"], lambda text: paragraphs(text, target), PIECE)
