"""Tables that are rewritten: partial results of a book, an upserted catalog, JSON files of which only changed ones are written, good and bad rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..functions.cleaning import strip

# ---- partial saves of summaries
OWNER = ("book_name", "method", "model")
SECTION = "book_name string, method string, model string, section_idx int, topic_hint string, summary string, retention_percent double"


def safe_model(model: Column) -> Column:
    """A model's name as part of a path: what is neither a letter, a digit, _ nor - becomes _."""
    return F.regexp_replace(model, r"(?U)[^\w\-]", "_")


def read_partial(spark: SparkSession, path: str) -> DataFrame:
    """The sections saved so far; none if nothing has been saved."""
    try:
        return spark.read.schema(SECTION).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SECTION)


def save_partial(sections: DataFrame, path: str) -> None:
    """Adds finished sections (SECTION's columns) to the saved ones; only the folders of their (book, method, model) are written anew.

    A section with a blank summary is not finished. Of sections with one number the new one stays, of several new ones the largest summary
    in order; so a batch that comes again, whole or in part, leaves the same table."""
    spark = sections.sparkSession
    new = sections.withColumn("model", safe_model(F.col("model"))).where(strip(F.coalesce("summary", F.lit(""))) != "").withColumn("_new", F.lit(1))
    saved = read_partial(spark, path).join(F.broadcast(new.select(*OWNER).distinct()), list(OWNER), "left_semi").withColumn("_new", F.lit(0))
    last = Window.partitionBy(*OWNER, "section_idx").orderBy(F.desc("_new"), F.desc("summary"))
    rows = new.unionByName(saved).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*OWNER).parquet(path)


def stream_partials(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Saves each batch of a stream of finished sections; a batch that is replayed after a failure changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: save_partial(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending_sections(sections: DataFrame, saved: DataFrame) -> DataFrame:
    """The sections that are not saved yet: where a run that broke off goes on."""
    return sections.join(saved.select(*OWNER, "section_idx"), [*OWNER, "section_idx"], "left_anti")


def partial_outputs(saved: DataFrame, totals: DataFrame) -> DataFrame:
    """A row for each (book, method, model): total_sections (of totals: book_name, method, total_sections), completed_sections, avg_ner_retention, global_summary (empty until the end) and sections, in order."""
    held = F.array_sort(F.collect_list(F.struct("section_idx", "topic_hint", "summary", "retention_percent")))
    rows = saved.groupBy(*OWNER).agg(F.count(F.lit(1)).alias("completed_sections"), F.coalesce(F.round(F.avg("retention_percent"), 1), F.lit(0.0)).alias("avg_ner_retention"), held.alias("sections"))
    return rows.join(totals, ["book_name", "method"], "left").select(*OWNER, "total_sections", "completed_sections", "avg_ner_retention", F.lit("").alias("global_summary"), "sections")


# ---- a catalog with upserts
BUCKETS = 64


def _commits(spark: SparkSession, path: str) -> dict[int, str]:
    """Of each bucket the commit that wrote it last, by the newest marker; at most BUCKETS rows."""
    try:
        marks = spark.read.schema("version long, mapping string").json(f"{path}/_commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    newest = marks.orderBy(F.desc("version")).first()
    return {int(k): v for k, v in json.loads(newest.mapping).items()} if newest else {}


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The catalog as of its newest marker; what a broken upsert has left is not read."""
    commits = _commits(spark, path)
    paths = [f"{path}/data/commit={c}/bucket={b}" for b, c in commits.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(updates: DataFrame, path: str, key: str, schema: str, commit: str) -> bool:
    """Puts updates (schema's columns, a row for each key) in place of the catalog's rows of their keys, and adds the others.

    Copy on write: of BUCKETS buckets by the key's hash only those that updates touch are written, under the commit's name; a marker that names
    each bucket's commit comes last and makes it valid. A commit that is valid already changes nothing: then the result is False."""
    spark = updates.sparkSession
    commits = _commits(spark, path)
    try:
        known = [r.version for r in spark.read.schema("version long, commit string").json(f"{path}/_commits").select("version", "commit").where(F.col("commit") == commit).limit(1).collect()]
        version = spark.read.schema("version long").json(f"{path}/_commits").agg(F.max("version")).first()[0]
    except AnalysisException:
        known, version = [], 0
    if known:
        return False
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    names = spark.createDataFrame([], schema).columns
    updates = updates.select(*names).withColumn("bucket", bucket)
    touched = sorted(r.bucket for r in updates.select("bucket").distinct().collect())  # at most BUCKETS
    old = [f"{path}/data/commit={commits[b]}/bucket={b}" for b in touched if b in commits]
    kept = spark.read.schema(schema).parquet(*old).join(updates.select(key), key, "left_anti").select(*names).withColumn("bucket", bucket) if old else updates.limit(0)
    updates.unionByName(kept).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/commit={commit}")
    mapping = {**commits, **dict.fromkeys(touched, commit)}
    spark.createDataFrame([((version or 0) + 1, commit, json.dumps(mapping))], "version long, commit string, mapping string").coalesce(1).write.mode("append").json(f"{path}/_commits")
    return True


# ---- JSON files, rewritten where something changes
def with_key(value: Column, name: str, to: Column) -> Column:
    """A JSON object with a key's value replaced, in its place, or added at the end; all other keys stay as they are, known or not."""
    held = F.from_json(value, "map<string, variant>")
    new = F.parse_json(F.to_json(F.array(to)))  # the only way to make a string a variant keeps it in an array
    new = F.variant_get(new, "$[0]", "variant")
    replaced = F.transform_values(held, lambda k, v: F.when(k == name, new).otherwise(v))
    return F.to_json(F.when(F.array_contains(F.map_keys(held), name), replaced).otherwise(F.map_concat(held, F.create_map(F.lit(name), new))))


def rewritten(files: DataFrame, name: str, change) -> DataFrame:
    """file_name, value of the files (file_name, value: JSON objects) of which change makes another text of the key: the others need no writing."""
    before = F.get_json_object("value", f"$.{name}")
    rows = files.withColumn("_before", before).withColumn("_after", change(F.col("_before")))
    return rows.where(F.col("_before").isNotNull() & ~F.col("_before").eqNullSafe(F.col("_after"))).select("file_name", with_key(F.col("value"), name, F.col("_after")).alias("value"))


# ---- good and bad rows
def write_divided(rows: DataFrame, path: str, error: str = "error") -> None:
    """rows in one pass: those without an error under outcome=good, the others under outcome=bad."""
    rows.withColumn("outcome", F.when(F.col(error).isNull(), "good").otherwise("bad")).write.mode("overwrite").partitionBy("outcome").parquet(path)


def read_outcome(spark: SparkSession, path: str, outcome: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("outcome") == outcome).drop("outcome")
