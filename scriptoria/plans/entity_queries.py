"""Registered queries that lead from windows to entities, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks as H
from ..operators import reading as D
from ..operators import stitching as T
from ..operators import windows as N
from .queries import _t
from .registry import query

_PARTS = r"\s''\"()\[\]{}.,;:!?\-–—/\\"
_NOT, _RUN = f"[^{_PARTS}]*", f"[{_PARTS}]*"


def _trim(s: str, e: str) -> tuple[str, str]:
    """SQL for a span's edges without what parts words."""
    begin = f"({s} + length(regexp_extract(substr(text, {s} + 1, {e} - {s}), '^{_RUN}')))"
    return begin, f"greatest({begin}, {e} - length(regexp_extract(substr(text, {s} + 1, {e} - {s}), '{_RUN}$')))"


def _clean(x: str) -> str:
    for edge in (r"\s+", r"[''’\"“”‘()\[\]{}.,;:!?\-]+"):
        x = f"regexp_replace({x}, '^{edge}|{edge}$', '', 'g')"
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


_STOP = "(?i)^(il|lo|la|i|gli|le|un|uno|una|di|de|del|dello|della|dei|degli|delle|e|o|a|da|in|su|con|per|tra|fra|l|d)$"
_VALID = rf"score >= 0.65 AND length(word) >= 3 AND length(regexp_replace(word, '[^\p{{L}}]', '', 'g')) / greatest(length(word), 1) >= 0.6 AND NOT regexp_matches(word, '{_STOP}') AND (label <> 'PER' OR regexp_matches(word, '\p{{Lu}}'))"
_B2, _E2 = _trim("b1", "e1")
_B4, _E4 = _trim("b3", "e3")
_ENTITIES = rf"""
w AS (SELECT doc_id, s AS base, CAST(s // 1700 AS INT) AS idx, substr(text, s + 1, 2000) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 2000) / 1700)) AS BIGINT) * 1700 + 1, 1700)) AS s FROM documents WHERE length(text) > 0)),
h AS (SELECT doc_id, idx, base, text, unnest(range(len(x))) AS n, unnest(x) AS hit, unnest(g[1:len(x)]) AS gap FROM (SELECT *, regexp_extract_all(text, '[A-Z][a-z]{{2,}}') AS x, string_split_regex(text, '[A-Z][a-z]{{2,}}') AS g FROM w)),
p AS (SELECT doc_id, idx, base, text, n, CASE WHEN length(hit) % 2 = 1 THEN 'LOC' ELSE 'PER' END AS label, (6 + n % 5) / 10 AS score, hit AS word, sum(length(gap) + length(hit)) OVER v - length(hit) AS s, sum(length(gap) + length(hit)) OVER v AS e FROM h WINDOW v AS (PARTITION BY doc_id, idx ORDER BY n)),
r AS (SELECT *, length(regexp_extract(substr(text, CAST(greatest(s - 2, 0) + 1 AS BIGINT), CAST(s - greatest(s - 2, 0) AS BIGINT)), '{_NOT}$')) AS grown, length(regexp_extract(substr(text, CAST(s + 1 AS BIGINT), 2), '^{_RUN}')) AS shed, length(regexp_extract(substr(text, CAST(e + 1 AS BIGINT), 2), '^{_NOT}')) AS more, length(regexp_extract(substr(text, CAST(e - 1 AS BIGINT), 2), '{_RUN}$')) AS less FROM p WHERE {_VALID}),
k AS (SELECT *, CAST(CASE WHEN grown > 0 THEN s - grown ELSE s + shed END AS BIGINT) AS b1, CAST(CASE WHEN more > 0 THEN e + more ELSE e - less END AS BIGINT) AS e1 FROM r),
t AS (SELECT doc_id, idx, base, text, n, label, score, {_B2} AS b2, {_E2} AS e2 FROM k),
u AS (SELECT * FROM t WHERE {_clean('substr(text, b2 + 1, e2 - b2)')} <> ''),
o AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER v THEN 1 ELSE 0 END AS other FROM u WINDOW v AS (PARTITION BY doc_id, idx ORDER BY b2, e2, n)),
st AS (SELECT *, sum(other) OVER (PARTITION BY doc_id, idx ORDER BY b2, e2, n) AS stretch FROM o),
nw AS (SELECT *, CASE WHEN b2 <= max(e2) OVER (PARTITION BY doc_id, idx, stretch ORDER BY b2, e2, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM st),
sp AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, idx ORDER BY b2, e2, n) AS span FROM nw),
m AS (SELECT doc_id, idx, any_value(base) AS base, any_value(text) AS text, any_value(label) AS label, min(b2) AS b3, max(e2) AS e3, max(score) AS score FROM sp GROUP BY doc_id, idx, span),
f AS (SELECT *, {_B4} AS b4, {_E4} AS e4 FROM m), c AS (SELECT *, {_clean('substr(text, b4 + 1, e4 - b4)')} AS word FROM f WHERE b4 < e4),
q AS (SELECT doc_id, base + b4 AS start, base + e4 AS stop, label, arg_max({{'word': word, 'score': round(score, 4)}}, idx) AS l FROM c WHERE {_VALID} GROUP BY ALL)"""


def _entities(spark, sf_dir) -> DataFrame:
    windows = H.window_texts(_t(spark, sf_dir, "documents"))
    return T.window_entities(windows, T.recognise(windows, ["doc_id", "idx"]))


@query(f"""WITH {_ENTITIES} SELECT doc_id, label, l.word AS word, CAST(start AS INT) AS start, CAST(stop AS INT) AS "end", l.score AS score FROM q""")
def window_entities(spark, sf_dir):
    """Entities of whole texts from windows of 2000 characters that overlap by 300."""
    return _entities(spark, sf_dir)


@query(f"""WITH {_ENTITIES} SELECT doc_id, json_extract_string(j, '$.book_name') AS book_name, CAST(json_extract(j, '$.total_entities') AS BIGINT) AS total_entities, CAST(json_extract_string(j, '$.entities[0].word') AS VARCHAR) AS first_word, CAST(json_array_length(j, '$.entities') AS BIGINT) AS listed
FROM (SELECT doc_id, to_json({{'book_name': 'book ' || doc_id, 'total_entities': count(*), 'entities': list({{'word': l.word}} ORDER BY start, stop, label)}}) AS j FROM q GROUP BY doc_id)""")
def entities_document(spark, sf_dir):
    """Each text's entities as one JSON document, and what is read back from it."""
    said = T.entities_json(_entities(spark, sf_dir), "doc_id", F.concat(F.lit("book "), F.col("doc_id").cast("string")))
    read = F.from_json("json", "book_name string, total_entities long, entities array<struct<label:string,word:string,score:double,start:int,end:int>>")
    return said.select("doc_id", read.alias("j")).select("doc_id", "j.book_name", "j.total_entities", F.get("j.entities", F.lit(0))["word"].alias("first_word"), F.size("j.entities").cast("long").alias("listed"))


@query()
def entity_windows(spark, sf_dir):
    return N.entity_windows(_t(spark, sf_dir, "documents"))


_AT = f"""a AS (SELECT doc_id, text, unnest(range(0, length(text) + 1, 20)) AS s FROM documents), b AS (SELECT *, least(s + 5, length(text)) AS e FROM a),
c AS (SELECT doc_id, text, s, e, length(regexp_extract(substr(text, greatest(s - 2, 0) + 1, s - greatest(s - 2, 0)), '{_NOT}$')) AS grown, length(regexp_extract(substr(text, s + 1, least(s + 2, e) - s), '^{_RUN}')) AS shed, length(regexp_extract(substr(text, e + 1, 2), '^{_NOT}')) AS more FROM b),
d AS (SELECT *, CASE WHEN grown > 0 THEN s - grown ELSE s + shed END AS f FROM c)"""


@query(f"""WITH {_AT} SELECT doc_id, CAST(s AS INT) AS "at", CAST(f AS INT) AS start, CAST(CASE WHEN more > 0 THEN e + more ELSE e - length(regexp_extract(substr(text, greatest(f, e - 2) + 1, e - greatest(f, e - 2)), '{_RUN}$')) END AS INT) AS "end" FROM d""")
def entities_snap(spark, sf_dir):
    """Spans of five characters, one for every twenty, moved to the edges of words."""
    return D.snap_every(_t(spark, sf_dir, "documents"), 20, 5)
