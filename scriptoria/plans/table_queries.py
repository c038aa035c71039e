"""Registered queries over progress, rewritten files, faulty rows and table functions, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import tables as U
from ..operators.splitting import split
from ..operators.textrows import rows_or_error
from ..sources import tables as T
from ..streaming import progress as P
from .queries import _t
from .registry import query
from .section_queries import _PARAGRAPHS, _pieces


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, event_type AS status, CASE WHEN event_id % 3 > 0 THEN 'step ' || event_id END AS detail FROM events),
l AS (SELECT key, string_agg(detail, ',' ORDER BY seq) AS log FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM e WHERE detail IS NOT NULL) WHERE n <= 20 GROUP BY key)
SELECT key, max(seq) AS seq, arg_max(status, seq) AS status, coalesce(any_value(log), '') AS log FROM e LEFT JOIN l USING (key) GROUP BY key""")
def progress_latest(spark, sf_dir):
    """The latest state of each user, and the last twenty lines of their log."""
    events = _t(spark, sf_dir, "events")
    detail = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("step "), F.col("event_id").cast("string")))
    rows = P.progress(events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), detail.alias("detail")))
    return rows.withColumn("log", F.array_join("log", ","))


@query(f"SELECT doc_id, lang, n_chars, t AS contenuto FROM (SELECT *, translate(text, '{C.SYMBOLS}', '') AS t FROM documents) WHERE t <> text")
def rewrite_changed(spark, sf_dir):
    """Documents as JSON files whose text cleaning changes, rewritten; their other keys, known or not, are read back."""
    value = F.to_json(F.struct("doc_id", "lang", F.col("text").alias("contenuto"), "n_chars"))
    files = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_name"), value.alias("value"))
    read = F.from_json("value", "doc_id long, lang string, n_chars long, contenuto string")
    return T.rewritten(files, "contenuto", C.strip_symbols).select(read.alias("b")).select("b.*")


@query(f"""WITH RECURSIVE {_pieces('p', "(SELECT doc_id, text FROM documents WHERE length(text) >= 300) q", 'doc_id', False)} SELECT doc_id, CAST(part AS INT) AS idx, text, CAST(NULL AS VARCHAR) AS error FROM p
UNION ALL SELECT doc_id, 0, NULL, 'ValueError: a text of ' || length(text) || ' characters' FROM documents WHERE length(text) < 300""")
def split_or_fault(spark, sf_dir):
    """Divided texts; one that is too short gives its fault instead of ending the job."""

    def pieces(text: str) -> Iterator[tuple[str]]:
        if len(text) < 300:
            raise ValueError(f"a text of {len(text)} characters")
        for x in split(text):
            yield (x[0],)

    return rows_or_error(_t(spark, sf_dir, "documents"), ["doc_id"], ["text"], pieces, {"text": "string"})


def _lateral(spark, sf_dir, call: str):
    U.register(spark)
    return spark.sql(f"SELECT d.doc_id, p.* FROM {{docs}} d, LATERAL {call} p", docs=_t(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"WITH RECURSIVE {_PARAGRAPHS} SELECT doc_id, CAST(idx AS INT) AS idx, text, char_start, char_end FROM para")
def sql_pseudo_paragraphs(spark, sf_dir):
    return _lateral(spark, sf_dir, "pseudo_paragraphs(d.text, 500)")


@query(f"WITH RECURSIVE {_pieces('p', 'documents', 'doc_id', False)} SELECT doc_id, CAST(part AS INT) AS idx, text, CAST(s AS INT) AS char_start, CAST(e AS INT) AS char_end FROM p")
def sql_split_semantic(spark, sf_dir):
    return _lateral(spark, sf_dir, "split_semantic(d.text, 2000, 300)")


@query()
def sql_ner_windows(spark, sf_dir):
    return _lateral(spark, sf_dir, "ner_windows(d.text, 500, 2000, 300)")
