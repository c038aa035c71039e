"""Coherence and agreement reports: term weights, similarities of neighbours, nearest boundaries, precision and recall."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words left out of term weights.
STOPWORDS = (
    "il", "lo", "la", "i", "gli", "le", "un", "uno", "una", "di", "a", "da", "in", "con", "su", "per", "tra", "fra", "e", "o", "ma", "se", "che", "non", "si", "è",
    "era", "ai", "del", "dei", "delle", "della", "degli", "al", "allo", "alla", "agli", "nel", "nello", "nella", "nei", "negli", "nelle", "col", "coi", "sui", "come",
    "anche", "già", "più", "suo", "sua", "suoi", "sue", "mio", "mia", "questo", "quella", "essere", "fare", "avere", "così", "poi", "però", "quando", "dove", "quello",
)


_WORD = re.compile(r"[^\W]+")
_LATIN = re.compile(r"[a-zß-ÿ]{3,}")
_LEFT_OUT = frozenset(STOPWORDS)
Weights = list[dict[str, float]]


def text_weights_of(texts: list[str]) -> tuple[Weights, Weights]:
    """Of each text its words' tf, and tf * ln(N / df) among the texts; words of all of them have none."""
    counts = [Counter(w for w in _WORD.findall(x.lower()) if _LATIN.fullmatch(w) and w not in _LEFT_OUT) for x in texts]
    df = Counter(w for c in counts for w in c)
    tf = [{w: n / all_words for w, n in c.items()} for c in counts for all_words in (c.total(),)]
    return tf, [{w: v * math.log(len(texts) / df[w]) for w, v in t.items() if df[w] < len(texts)} for t in tf]


def line_weights(text: str | None, least: int = 1) -> tuple[list[str], Weights, Weights]:
    """A text's lines that are not blank, and their weights; nothing if there are fewer than least lines."""
    lines = [x for x in (text or "").split("\n") if x.strip(" ")]
    return (lines, *text_weights_of(lines)) if len(lines) >= least else ([], [], [])


def similar_pairs(w: Weights, number: list[int], most: int) -> list[tuple[str, int, int, float]]:
    """(kind, a, b, similarity), with places from 0, of chunks with weights w in sections of these numbers.

    Neighbours are intra (of one section) or boundary pairs; cross pairs are the first chunk of each section and of the first one whose
    number is larger by max(3, a third of the sections), most in all."""
    out = [("intra" if number[i] == number[i + 1] else "boundary", i, i + 1, weights_cosine(w[i], w[i + 1])) for i in range(len(w) - 1)]
    first: dict[int, int] = {}
    for i, s in enumerate(number):
        first.setdefault(s, i)
    known = sorted(first)
    gap, far, found = max(3, len(known) // 3), 0, 0
    for s in known:
        while far < len(known) and known[far] - s < gap:
            far += 1
        if far == len(known) or found == most:
            break
        a, b = first[s], first[known[far]]
        out.append(("cross", a, b, weights_cosine(w[a], w[b])))
        found += 1
    return out


def weights_cosine(a: dict[str, float], b: dict[str, float]) -> float:
    """Of two sparse vectors; 0 without common words."""
    dot = sum(v * b[w] for w, v in a.items() if w in b)
    scale = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
    return round(dot / scale, 4) if scale else 0.0


def _per_text(docs: DataFrame, rows: Callable[[str | None], list[tuple]], schema: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """doc_id and the rows that each text yields: a text is one row, so nothing is shuffled."""
    some = docs.select("doc_id", "text")
    out = some.select("doc_id").schema
    for name, kind, _ in schema:
        out = out.add(name, kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                if found := rows(text.as_py()):
                    cols = [pa.array(c, k) for c, (_, _, k) in zip(zip(*found, strict=True), schema, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(found), pa.int64())), *cols], names=["doc_id", *(n for n, _, _ in schema)])

    return some.mapInArrow(run, out)


def text_weights(docs: DataFrame, idf: bool) -> DataFrame:
    """doc_id, idx (the line's number), word and tf or, with idf, w of every line of docs (doc_id, text), without a shuffle."""

    def rows(text: str | None) -> list[tuple]:
        places = [i for i, x in enumerate((text or "").split("\n")) if x.strip(" ")]
        _, tf, w = line_weights(text)
        return [(i, word, v) for i, weights in zip(places, w if idf else tf, strict=True) for word, v in weights.items()]

    return _per_text(docs, rows, [("idx", "integer", pa.int32()), ("word", "string", pa.string()), ("w" if idf else "tf", "double", pa.float64())])


def text_similarity(docs: DataFrame) -> DataFrame:
    """doc_id, idx (from 1), sim: the cosine of each line's weights with the next one's, of texts of three lines or more, without a shuffle."""

    def rows(text: str | None) -> list[tuple]:
        _, _, w = line_weights(text, 3)
        return [(i + 1, weights_cosine(a, b)) for i, (a, b) in enumerate(zip(w, w[1:], strict=False))]

    return _per_text(docs, rows, [("idx", "integer", pa.int32()), ("sim", "double", pa.float64())])


def coherence_pairs(docs: DataFrame, sections: Callable[[list[str]], list[int]], most: int = 20) -> DataFrame:
    """doc_id, kind, chunk_a, chunk_b, similarity. Chunks are the lines, numbered from 1; sections gives each its section's number.

    Neighbours are intra (of one section) or boundary pairs; cross pairs are the first chunk of each section and of the first one that
    is further on by max(3, a third of the sections), most a text. Texts of fewer than three lines have none."""

    def rows(text: str | None) -> list[tuple]:
        lines, _, w = line_weights(text, 3)
        return [(kind, a + 1, b + 1, v) for kind, a, b, v in similar_pairs(w, sections(lines), most)]

    return _per_text(docs, rows, [("kind", "string", pa.string()), ("chunk_a", "long", pa.int64()), ("chunk_b", "long", pa.int64()), ("similarity", "double", pa.float64())])


def coherence_report(pairs: DataFrame, key: str, digits: int = 4) -> DataFrame:
    """key; of intra, boundary and cross pairs the average similarity (null without any) and number; delta: intra less boundary."""
    kinds = ("intra", "boundary", "cross")
    exact = F.col("similarity").cast("decimal(18, 10)")  # so that halves are rounded up, whatever order they are added in
    mean = [F.round(F.avg(F.when(F.col("kind") == k, exact)), digits).cast("double").alias(f"avg_{k}") for k in kinds]
    some = pairs.groupBy(key).agg(*mean, *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    return some.withColumn("delta", F.round(F.col("avg_intra") - F.col("avg_boundary"), digits))


def section_starts(rows: DataFrame, group: list[str], order: str, section: str) -> DataFrame:
    """The rows at which a section's number differs from that of the row before; rows without a number are passed over."""
    w = Window.partitionBy(*group).orderBy(order)
    known = rows.where(F.col(section).isNotNull()).withColumn("_p", F.lag(section).over(w))
    return known.where(~F.col("_p").eqNullSafe(F.col(section))).drop("_p")


def nearest(left: DataFrame, right: DataFrame, group: str, at: str, other: str, tolerance: int) -> DataFrame:
    """left with the right position nearest to it in its group (ties: the earlier), its distance, and whether it is a match.

    One sort of both sides together: the nearest is the last right position before or the first after."""
    both = left.select(group, F.col(at).alias("p"), F.lit(None).cast("long").alias("q"), F.lit(1).alias("mine")).unionByName(right.select(group, F.col(other).alias("p"), F.col(other).cast("long").alias("q"), F.lit(0).alias("mine")))
    w = Window.partitionBy(group).orderBy("p")
    both = both.withColumn("before", F.last("q", True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first("q", True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    near = F.when(F.col("after").isNull() | (F.col("p") - F.col("before") <= F.col("after") - F.col("p")), F.col("before")).otherwise(F.col("after"))
    rows = both.where("mine = 1").select(group, F.col("p").alias(at), F.coalesce(near, F.col("after")).alias(other))
    return rows.withColumn("dist", F.abs(F.col(at) - F.col(other))).withColumn("is_match", F.coalesce(F.col("dist") <= tolerance, F.lit(False)))


def section_representatives(rows: DataFrame, group: str, section: str, order: str) -> DataFrame:
    """The first row of each section: group, section, and its place (at) among all rows of the group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("at", F.row_number().over(w)).groupBy(group, section).agg(F.min("at").alias("at"))


def cross_pairs(rows: DataFrame, group: str, section: str, order: str, most: int = 20) -> DataFrame:
    """group, a, b: each section with the first later one whose number is larger by max(3, a third of all sections) or more; the first most of each group.

    Sections without a number are passed over. The first most are taken by a limit in each task, then each is held against every section; no group is sorted as a whole."""
    reps = rows.select(F.col(group).alias("_g"), F.col(section).alias("s")).distinct()
    gaps = reps.groupBy("_g").agg(F.greatest(F.lit(3), F.floor(F.count(F.lit(1)) / 3)).alias("gap"), F.max("s").alias("last"))
    # sections without a later one are the last of all, so the first most are known before their pairs are
    nth = F.row_number().over(Window.partitionBy("_g").orderBy("s"))
    first = reps.where("s IS NOT NULL").withColumn("_n", nth).where(F.col("_n") <= most).select(F.col("_g").alias("_h"), F.col("s").alias("a"))
    first = first.join(gaps.withColumnRenamed("_g", "_h2"), F.col("_h").eqNullSafe(F.col("_h2"))).where(F.col("a") + F.col("gap") <= F.col("last")).select("_h", "a", "gap")
    wanted = first.groupBy("_h").agg(F.collect_list(F.struct("a", "gap")).alias("w"))
    met = reps.where("s IS NOT NULL").join(wanted, F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "s", F.explode(F.filter("w", lambda w: F.col("s") >= w["a"] + w["gap"])).alias("w"))
    return met.groupBy("_g", F.col("w.a").alias("a")).agg(F.min("s").alias("b")).select(F.col("_g").alias(group), "a", "b")


def boundary_scores(gold: DataFrame, local: DataFrame, tolerance: int, group: list[str]) -> DataFrame:
    """group; matched and all boundaries of both sides, precision, recall, f1 (0 where nothing is there). gold: group, g; local: group, l.

    A boundary is matched if the other side has one within tolerance: they meet in blocks of that width, each with its neighbours."""
    width = max(1, tolerance)
    mine = gold.select(*group, F.col("g").alias("p"), F.lit(1).alias("gold")).unionByName(local.select(*group, F.col("l").alias("p"), F.lit(0).alias("gold"))).withColumn("block", F.floor(F.col("p") / width))
    others = mine.select(*group, F.col("p").alias("q"), (1 - F.col("gold")).alias("gold"), F.explode(F.array(*[F.col("block") + d for d in (-1, 0, 1)])).alias("block"))
    matched = mine.join(others, [*group, "gold", "block"], "left").groupBy(*group, "gold", "p").agg(F.max(F.coalesce(F.abs(F.col("p") - F.col("q")) <= tolerance, F.lit(False))).alias("hit"))
    count = lambda side, hit: F.count_if((F.col("gold") == side) & (F.col("hit") if hit else F.lit(True)))
    rows = matched.groupBy(*group).agg(count(0, True).alias("hit_local"), count(0, False).alias("n_local"), count(1, True).alias("hit_gold"), count(1, False).alias("n_gold"))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    rows = rows.withColumn("p", ratio("hit_local", "n_local")).withColumn("r", ratio("hit_gold", "n_gold"))
    f1 = F.coalesce(2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0)), F.lit(0.0))
    return rows.select(*group, "hit_local", "n_local", "hit_gold", "n_gold", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def label_scores(rows: DataFrame, label: str, predicted: Column, gold: Column) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 per label and, where is_total (with label null), over all."""
    some = rows.rollup(label).agg((F.grouping(label) == 1).alias("is_total"), *[F.sum(c.cast("long")).alias(n) for n, c in (("tp", predicted & gold), ("fp", predicted & ~gold), ("fn", ~predicted & gold))])
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 4)
    return some.select(label, "is_total", "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
