"""Exact duplicates by skew-safe combining: locally, within salted groups, then over the salts, on full content throughout.

Texts are equal if they are identical once A-Z are lower-cased. A group is keyed by its digest and its whole text, so no stage
takes two texts for one because their digests agree. First each task merges its own copies (the map side of the first
aggregation), then the tasks' winners merge within (digest, text, salt), where a salt stands for some of the tasks, then the
salts' winners merge. A group that holds a third of all rows so reaches no task with more than a row from each task or salt.

Rows learn their group's winner by digest. Groups of a thousandth of all rows or more, a thousand at most, are broadcast; others
meet their rows in a join. Digests that several texts share meet their rows by the text too.

Defined cases: null text is empty; a null doc_id is less than any other, keep_id is null where a group has no other; of equal rows (text and
doc_id) one is kept; very long texts are keys like others; an empty table gives no rows; the input's other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, text_of

SALTS = 64
#: A group is broadcast to its rows if it holds one of so many equal shares of all rows: there are no more such groups.
SHARES = 1000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def winners(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """digest, text, keep_id, group_size of each group of equal texts. rows: digest, text, doc_id."""
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = salted.groupBy("digest", "text", "salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def mark_duplicates(docs: DataFrame, row: Column | None = None, digest: Callable[[Column], Column] = sha256, shares: int = SHARES, salts: int = SALTS) -> DataFrame:
    """For every row of docs: doc_id, keep_id (the doc_id that stays), group_size, kept, text_sha256, and what row says of it, as column row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(text_of()).alias("text"), (F.lit(None).cast("int") if row is None else row).alias("row")).withColumn("digest", digest(F.col("text")))
    groups = cut(winners(rows.select("digest", "text", "doc_id"), salts).drop("text"))
    shared = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    collide = not shared.isEmpty()
    alone = groups.join(shared, "digest", "left_anti") if collide else groups

    said = ["doc_id", "row", "keep_id", "group_size", "text_sha256"]
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    heavy = F.broadcast(alone.where(F.col("group_size") * shares >= total))  # at most that many
    rows = rows.withColumn("text_sha256", F.sha2("text", 256))
    known = rows.join(heavy, "digest", "left")
    open_ = known.where("group_size IS NULL").drop("keep_id", "group_size")
    out = known.where("group_size IS NOT NULL").select(said).unionByName(open_.drop("text").join(alone.where(F.col("group_size") * shares < total), "digest").select(said))
    if collide:  # different texts of one digest: their rows meet them by the text
        by_text = winners(rows.select("digest", "text", "doc_id").join(shared, "digest", "left_semi"), salts)
        out = out.unionByName(open_.join(by_text, ["digest", "text"]).select(said))

    top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = cut(out.select(*said, top.alias("kept"), F.monotonically_increasing_id().alias("at")))  # stored: at no longer changes
    tops = out.where("kept")
    if tops.count() > groups.count():  # rows that repeat both text and doc_id: the first of them stays
        first = tops.groupBy("text_sha256", "keep_id").agg(F.min("at").alias("at")).select("at")
        out = out.where("NOT kept").unionByName(tops.join(first, "at", "left_semi")).unionByName(tops.join(first, "at", "left_anti").withColumn("kept", F.lit(False)))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "row")


def keep_last(docs: DataFrame) -> DataFrame:
    """docs without copies: of equal texts the row of the largest doc_id, whole."""
    return mark_duplicates(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns])).where("kept").select("row.*")
