"""Writers of chunks, manifests and entity lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import strip


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as Parquet, by method and book."""
    chunks.write.mode("overwrite").partitionBy("method", "book_name").parquet(path)


def manifest(chunks: DataFrame) -> DataFrame:
    """One row for each method and book: total_chunks and its chunks' metadata, in order."""
    meta = F.struct("chunk_id", "topic_hint", "char_start", "char_end", F.length("text").alias("text_length"))
    return chunks.groupBy("method", "book_name").agg(F.count(F.lit(1)).alias("total_chunks"), F.array_sort(F.collect_list(meta)).alias("chunks"))


RULE = "=" * 60


def joined_summaries(sections: DataFrame, group: str, order: str) -> DataFrame:
    """group, text, sections: a book's summaries that are not blank, in order, under their topics; as one text and as JSON."""
    rows = sections.withColumn("summary", strip(F.col("summary"))).where("summary <> ''")
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("section_idx"), F.coalesce("topic_hint", F.concat(F.lit("Sezione "), F.col(order).cast("string"))).alias("topic_hint"), "summary")))
    rows = rows.groupBy(group).agg(held.alias("s"))
    said = F.transform("s", lambda x: F.concat(F.lit("=== "), x["topic_hint"], F.lit(" ===\n\n"), x["summary"]))
    return rows.select(group, F.array_join(said, f"\n\n{RULE}\n\n").alias("text"), F.to_json("s").alias("sections"))


def synopsis(books: DataFrame) -> DataFrame:
    """title, json, text of books that have a summary. books: title, author, model, method, created_at, summary. The text's paragraphs are wrapped at 100 characters."""
    rows = books.withColumn("testo", strip(F.col("summary"))).where("testo <> ''")
    words = F.size(F.filter(F.split("testo", r"\s+"), lambda w: w != ""))
    known = F.struct(
        F.col("title").alias("titolo"), F.coalesce("author", F.lit("N/D")).alias("autore"), F.coalesce("model", F.lit("N/D")).alias("modello"), F.coalesce("method", F.lit("N/D")).alias("metodo_chunking"),
        F.substring(F.coalesce(F.col("created_at").cast("string"), F.lit("")), 1, 10).alias("data_generazione"), F.length("testo").alias("num_caratteri"), words.alias("num_parole"), "testo",
    )
    paragraphs = F.filter(F.transform(F.split("testo", "\n\n"), lambda p: F.trim(F.regexp_replace(p, r"\s", " "))), lambda p: p != "")
    wrapped = F.transform(paragraphs, lambda p: F.array_join(F.regexp_extract_all(p, F.lit(r"(\S(?:.{0,98}\S)?|\S+)(?= |$)"), F.lit(1)), "\n"))
    return rows.select("title", F.to_json(known).alias("json"), F.array_join(wrapped, "\n\n").alias("text"))


def write_entity_csv(entities: DataFrame, path: str) -> None:
    """Entities as CSV with quoted words; scores with four digits."""
    entities.select(F.col("word").alias("parola"), F.col("label").alias("etichetta"), F.format_string("%.4f", "score").alias("score"), F.col("start").alias("char_start"), F.col("end").alias("char_end")).write.mode("overwrite").option("header", True).csv(path)
