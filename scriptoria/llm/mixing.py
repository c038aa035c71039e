"""Mixing sources to target weights: how many words of each document the mix takes.

Documents get hash-random keys. Within a source they are ranged by key into buckets; word counts are summed by bucket,
prefix-summed over a source's buckets and then inside each bucket. A source's budget gives whole epochs first; the rest
is cut exactly where its prefix sum reaches it. No source meets in one task: its share of a bucket is the most.

Defined cases: null text has size 0; a null source is one more source, the last; null doc_ids share a key and are
ordered by size and text hash, as repeated rows are; an empty table gives no rows; a table of empty texts takes nothing;
columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_of, without

CAP = 3
WEIGHTS = (1, 2, 3)
SALT = "mix-1"
BUCKET_HEX = 3  # 4096 buckets a source


def source_targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """_src, source_size, target. sizes: one row for each source (_src: 0 or 1 for null, then the name; source_size).

    All sizes are shared out by weight, at most cap times a source's size; the excess is reshared. With sources ordered by
    cap size / weight, those before the first whose share fits are at their cap."""
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy("_src")) - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") * cap / F.col("w"), "_src")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))) / F.sum("w").over(onward)
    levels = ranked.withColumn("level", level).withColumn("nth", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("w") <= F.col("source_size") * cap, F.struct("nth", "level"))
    levels = levels.withColumn("water", F.min(fits).over(whole)["level"])
    return levels.select("_src", "source_size", F.least((F.col("source_size") * cap).cast("double"), F.col("water") * F.col("w")).alias("target"))


def mix(docs: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, salt: str = SALT) -> DataFrame:
    """docs with size, source_size, target and taken (words that the mix takes, repeats counted), in place of columns of these names or of its working columns'."""
    docs = without(docs, "size", "source_size", "target", "taken", "before", "epochs", "budget", "_src", "_key", "_bucket", "_tie")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{salt}")))
    src = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    rows = docs.withColumn("size", F.regexp_count(text_of(), F.lit(WORD)).cast("long")).withColumn("_src", src).withColumn("_key", key)
    rows = rows.withColumn("_bucket", F.substring("_key", 1, BUCKET_HEX)).withColumn("_tie", F.xxhash64("text"))  # before the shuffle, which then needs no text
    buckets = rows.groupBy("_src", "_bucket").agg(F.sum("size").alias("n"))
    targets = source_targets(buckets.groupBy("_src").agg(F.sum("n").alias("source_size")), cap, weights)
    up_to = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.round("target").cast("long")
    plan = buckets.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0))).join(targets, "_src")
    plan = plan.select("_src", "_bucket", "before", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).alias("epochs"), budget.alias("budget"))
    within = Window.partitionBy("_src", "_bucket").orderBy("_key", "size", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.join(plan, ["_src", "_bucket"])
    ahead = F.col("before") + F.sum("size").over(within) - F.col("size")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - ahead))
    return both.withColumn("taken", taken.cast("long")).drop("_src", "_bucket", "_key", "_tie", "before", "epochs", "budget")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, whole: each as often as its taken words fill it, the cut one if at least half of it is taken."""
    names = docs.columns
    apart = docs.select("doc_id", "source", "text", F.struct(*names).alias("_row"))
    copies = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    mixed = mix(apart, **options).where(copies > 0)
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), copies)).alias("_n")).select(*[F.col("_row")[n].alias(n) for n in names])
