"""Registered queries that compare two ways of dividing a text, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import builders as B
from ..operators import comparison as C
from ..operators import entities as E
from ..operators import report as R
from .more_queries import _mean
from .queries import _t
from .registry import query
from .section_queries import _MARKS, _NER, _SECTIONS, _cut_paragraphs

_STOP = ", ".join(f"'{w}'" for w in R.STOPWORDS)


def _pairs_sql(name: str, source: str) -> str:
    """CTEs that end in <name>s: doc_id, kind, chunk_a, chunk_b, similarity of source's rows (doc_id, chunk_id, section, text)."""
    n = name
    return f"""{n}r AS (SELECT doc_id, chunk_id AS idx, section AS sec, text FROM {source} QUALIFY count(*) OVER (PARTITION BY doc_id) >= 3),
{n}w AS (SELECT doc_id, idx, word FROM (SELECT doc_id, idx, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM {n}r) WHERE regexp_full_match(word, '[a-zß-ÿ]{{3,}}') AND word NOT IN ({_STOP})),
{n}t AS (SELECT doc_id, idx, word, count(*) / sum(count(*)) OVER (PARTITION BY doc_id, idx) AS tf FROM {n}w GROUP BY doc_id, idx, word),
{n}n AS (SELECT doc_id, count(*) AS n FROM {n}r GROUP BY doc_id), {n}f AS (SELECT doc_id, word, count(*) AS df FROM {n}t GROUP BY doc_id, word),
{n}v AS (SELECT doc_id, idx, word, tf * ln(n / df) AS w FROM {n}t JOIN {n}f USING (doc_id, word) JOIN {n}n USING (doc_id) WHERE df < n),
{n}m AS (SELECT doc_id, idx, sqrt(sum(w * w)) AS norm FROM {n}v GROUP BY doc_id, idx),
{n}q AS (SELECT doc_id, sec, min(idx) AS idx FROM {n}r GROUP BY doc_id, sec), {n}g AS (SELECT doc_id, greatest(3, count(*) // 3) AS gap FROM {n}q GROUP BY doc_id),
{n}c AS (SELECT doc_id, a, b FROM (SELECT x.doc_id, x.idx AS a, arg_min(y.idx, y.sec) AS b, row_number() OVER (PARTITION BY x.doc_id ORDER BY x.sec) AS nth FROM {n}q x JOIN {n}g g ON g.doc_id = x.doc_id JOIN {n}q y ON y.doc_id = x.doc_id AND y.sec - x.sec >= gap GROUP BY x.doc_id, x.sec, x.idx) WHERE nth <= 20),
{n}p AS (SELECT a.doc_id, CASE WHEN a.sec = b.sec THEN 'intra' ELSE 'boundary' END AS kind, a.idx AS a, b.idx AS b FROM {n}r a JOIN {n}r b ON a.doc_id = b.doc_id AND b.idx = a.idx + 1 UNION ALL SELECT doc_id, 'cross', a, b FROM {n}c),
{n}d AS (SELECT p.doc_id, p.a, p.b, p.kind, sum(x.w * y.w) AS dot FROM {n}p p JOIN {n}v x ON x.doc_id = p.doc_id AND x.idx = p.a JOIN {n}v y ON y.doc_id = p.doc_id AND y.idx = p.b AND y.word = x.word GROUP BY ALL),
{n}s AS (SELECT p.doc_id, p.kind, p.a AS chunk_a, p.b AS chunk_b, round(coalesce(dot / nullif(x.norm * y.norm, 0), 0), 4) AS similarity FROM {n}p p LEFT JOIN {n}d USING (doc_id, a, b, kind) LEFT JOIN {n}m x ON x.doc_id = p.doc_id AND x.idx = p.a LEFT JOIN {n}m y ON y.doc_id = p.doc_id AND y.idx = p.b)"""


_FIRST = f"{_SECTIONS}, fc AS (SELECT c.doc_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.section, c.part) AS chunk_id, c.section, a AS char_start, text FROM sc c)"
_SECOND = _NER.replace(f"{_MARKS}, ", "")


def _sections(spark, sf_dir) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return B.section_books(E.with_spans(docs), _cut_paragraphs(docs))


@query(f"WITH RECURSIVE {_FIRST}, {_pairs_sql('x', 'fc')} SELECT doc_id, kind, chunk_a, chunk_b, similarity FROM xs")
def chunk_similarity_pairs(spark, sf_dir):
    """How similar chunks are to their neighbours, within sections and across their borders, and to chunks far away."""
    return C.similarity_pairs(C.books_of(_sections(spark, sf_dir))).select("doc_id", "kind", "chunk_a", "chunk_b", "similarity")


def _averages(name: str, alias: str) -> str:
    kinds = ("intra", "boundary", "cross")
    return f"{name}a AS (SELECT doc_id, " + ", ".join(f"{_mean(k)} AS {alias}_{k}, count(*) FILTER (WHERE kind = '{k}') AS {alias}_n_{k}" for k in kinds) + f" FROM {name}s GROUP BY doc_id)"


_COLUMNS = [f"{m}_{x}{k}" for m in ("embed", "ner") for x in ("", "n_") for k in ("intra", "boundary", "cross")]
_REPORT = f"""{_FIRST}, {_SECOND}, {_pairs_sql('x', 'fc')}, {_averages('x', 'embed')}, {_pairs_sql('y', 'ny')}, {_averages('y', 'ner')},
fb AS (SELECT doc_id, section, min(chunk_id) AS id, arg_min(char_start, chunk_id) AS at_ FROM fc GROUP BY doc_id, section),
cb AS (SELECT doc_id, chapter_id, min(char_start) AS at_ FROM ny GROUP BY doc_id, chapter_id),
nr AS (SELECT fb.doc_id, fb.id, fb.at_, arg_min({{'c': cb.chapter_id, 'at_': cb.at_}}, {{'d': abs(cb.at_ - fb.at_), 'a': cb.at_, 'c': cb.chapter_id}}) AS n FROM fb JOIN cb USING (doc_id) GROUP BY fb.doc_id, fb.id, fb.at_),
cp AS (SELECT doc_id, count(*) FILTER (WHERE abs(n.at_ - at_) <= 1500) AS matches, string_agg(id || ':' || n.c || ':' || abs(n.at_ - at_), ',' ORDER BY at_, id) AS comparison FROM nr GROUP BY doc_id),
f1 AS (SELECT doc_id, count(*) AS embed_total_chunks FROM fc GROUP BY doc_id), f2 AS (SELECT doc_id, count(*) AS embed_total_sections FROM fb GROUP BY doc_id),
n1 AS (SELECT doc_id, count(*) AS ner_total_chunks, count(DISTINCT section) AS ner_total_sections FROM ny GROUP BY doc_id)"""


@query(f"""WITH RECURSIVE {_REPORT} SELECT doc_id, embed_total_chunks, embed_total_sections, ner_total_chunks, ner_total_sections, CASE WHEN embed_total_chunks IS NOT NULL AND ner_total_chunks IS NOT NULL THEN coalesce(round(coalesce(matches, 0) / nullif(embed_total_sections, 0), 2), 0.0) END AS avg_jaccard_score,
comparison, {', '.join(_COLUMNS)} FROM f1 JOIN f2 USING (doc_id) FULL JOIN n1 USING (doc_id) LEFT JOIN cp USING (doc_id) LEFT JOIN xa USING (doc_id) LEFT JOIN ya USING (doc_id)""")
def two_method_report(spark, sf_dir):
    """One row for each text: chunks by similarity and chunks by names, how coherent each are, and whether their boundaries agree."""
    rows = C.two_method_report(_sections(spark, sf_dir), B.ner_section_books(E.with_spans(_t(spark, sf_dir, "documents"))))
    compared = F.array_join(F.transform("comparison", lambda c: F.concat_ws(":", c["id"].cast("string"), c["other_id"].cast("string"), c["dist"].cast("string"))), ",")
    said = [F.col(f"{m}_similarity.{x or 'avg_'}{k}").alias(f"{m}_{x}{k}") for m in ("embed", "ner") for x in ("", "n_") for k in ("intra", "boundary", "cross")]
    return rows.select("doc_id", "embed_total_chunks", "embed_total_sections", "ner_total_chunks", "ner_total_sections", "avg_jaccard_score", compared.alias("comparison"), *said)
