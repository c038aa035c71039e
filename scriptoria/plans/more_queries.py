"""More registered queries: small relational steps of the reading, chunking and summary views, each with DuckDB SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..operators import chunks as H
from ..operators import entities as E
from ..operators import report as R
from ..operators import summaries as M
from ..sources import books as S
from ..sources import sinks as K
from .queries import _ENT, _GIST, _names, _t
from .registry import query


@query("SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY conv_id, role")
def distinct_first(spark, sf_dir):
    """Each role of a conversation once, at its first turn."""
    return E.first_wins(_t(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "role", "turn")


@query("""SELECT conv_id, coalesce(string_agg(DISTINCT w, ', ' ORDER BY w) FILTER (WHERE label <> 'DATE' AND length(w) >= 3), 'Nessuna entità specifica') AS entities FROM (
SELECT conv_id, replace(w, '##', '') AS w, CASE length(w) % 3 WHEN 0 THEN 'PER' WHEN 1 THEN 'LOC' ELSE 'DATE' END AS label FROM (SELECT conv_id, unnest(CASE WHEN len(x) = 0 THEN [''] ELSE x END) AS w FROM (SELECT conv_id, regexp_extract_all(text, '[A-Z][a-z]+') AS x FROM conversations))) GROUP BY conv_id""")
def entity_string(spark, sf_dir):
    """The people and places of a conversation, sorted, as one string."""
    label = lambda w: F.when(F.length(w) % 3 == 0, "PER").when(F.length(w) % 3 == 1, "LOC").otherwise("DATE")
    found = F.transform(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)), lambda w: F.struct(label(w).alias("label"), w.alias("word")))
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.flatten(F.collect_list(found)).alias("entities"))
    return rows.select("conv_id", M.entity_string(F.col("entities")).alias("entities"))


@query("SELECT doc_id, 'Capitolo ' || dense_rank() OVER (PARTITION BY lang, source ORDER BY doc_id // 40) AS title FROM documents")
def chapter_titles(spark, sf_dir):
    """Sections numbered anew, without gaps, within a book."""
    w = Window.partitionBy("lang", "source").orderBy(F.floor(F.col("doc_id") / 40))
    return _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Capitolo "), F.dense_rank().over(w).cast("string")).alias("title"))


@query("SELECT source, count(*) AS total_sections, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS completed_sections, coalesce(bool_or(l.quality = 1), false) AS has_good FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def progress_counters(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("total_sections"), F.count("quality").alias("completed_sections"), F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("has_good"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chunk_id, count(*) OVER (PARTITION BY conv_id) AS total_chunks FROM conversations")
def chunk_numbers(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w.orderBy("turn")).cast("long").alias("chunk_id"), F.count(F.lit(1)).over(w).alias("total_chunks"))


@query("""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS idx, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), n AS (SELECT doc_id, idx, regexp_extract(text, '0*([0-9]+)', 1) AS section FROM l WHERE regexp_matches(text, '[0-9]'))
SELECT doc_id, idx, section FROM (SELECT *, lag(section) OVER (PARTITION BY doc_id ORDER BY idx) AS p FROM n) WHERE section IS DISTINCT FROM p""")
def section_starts(spark, sf_dir):
    """Lines whose first number differs from that of the last line that has one."""
    rows = H.line_chunks(_t(spark, sf_dir, "documents")).where(F.col("text").rlike("[0-9]")).select("doc_id", "idx", F.regexp_extract("text", "0*([0-9]+)", 1).alias("section"))
    return R.section_starts(rows, ["doc_id"], "idx", "section").select("doc_id", "idx", "section")


@query("SELECT conv_id, turn, lag(turn) OVER w AS before, lead(turn) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def navigation(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("before"), F.lead("turn").over(w).alias("after"))


@query("""SELECT conv_id, array_to_string(list_transform(list_sort(list_distinct(list_concat(coalesce(list(turn) FILTER (WHERE role = 'user'), []), coalesce(list(turn) FILTER (WHERE length(text) > 100), [])))), lambda x: CAST(x AS VARCHAR)), ',') AS bounds
FROM conversations GROUP BY conv_id""")
def boundary_union(spark, sf_dir):
    """Two lists of boundaries as one, sorted, each once."""
    lists = [F.collect_list(F.when(c, F.col("turn"))) for c in (F.col("role") == "user", F.length("text") > 100)]
    rows = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(H.boundary_union(*lists).alias("b"))
    return rows.select("conv_id", F.array_join(F.transform("b", lambda x: x.cast("string")), ",").alias("bounds"))


@query("SELECT doc_id AS id, 'real' AS kind, length(text) AS chars, lang FROM documents UNION ALL SELECT item_id, 'synthetic', length(text), NULL FROM benchmark")
def samples_union(spark, sf_dir):
    real = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("real").alias("kind"), F.length("text").alias("chars"), "lang")
    made = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("synthetic").alias("kind"), F.length("text").alias("chars"))
    return real.unionByName(made, allowMissingColumns=True)


@query(f"WITH {_ENT}, d AS (SELECT DISTINCT doc_id, label, word FROM n) SELECT doc_id, label, word, row_number() OVER (PARTITION BY doc_id ORDER BY label, lower(word), word) AS nth FROM d")
def entities_sorted(spark, sf_dir):
    """Each document's entities by label and, in Italian alphabetical order, word."""
    rows = E.extract(_t(spark, sf_dir, "documents")).select("doc_id", "label", "word").distinct()
    w = Window.partitionBy("doc_id").orderBy("label", F.collate(F.col("word"), "it"), "word")
    return rows.withColumn("nth", F.row_number().over(w).cast("long"))


@query("SELECT doc_id, start, \"end\" FROM (SELECT doc_id, s AS start, least(s + 2000, length(text)) AS \"end\" FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 2000) / 1700)) AS BIGINT) * 1700 + 1, 1700)) AS s FROM documents WHERE length(text) > 0)) WHERE start < 50 * 1700")
def first_blocks(spark, sf_dir):
    """The first fifty windows of each text (a top-k view)."""
    return H.sliding_windows(_t(spark, sf_dir, "documents")).where(F.col("start") < 50 * 1700)


@query("SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND turn = 0")
def first_questions(spark, sf_dir):
    """Rows of one key and one level."""
    return _t(spark, sf_dir, "conversations").where((F.col("role") == "user") & (F.col("turn") == 0)).select("conv_id", "turn", "role")


_GOLD = ", ".join(f"'{x}'" for x in (*E.LABELS, "MISC", "?"))


@query(f"SELECT conv_id, turn, label FROM (SELECT conv_id, turn, text, [{_GOLD}][CAST((conv_id + turn) % 11 + 1 AS INT)] AS label FROM conversations) WHERE label NOT IN ('MISC', '?') AND length(text) >= 50")
def gold_valid(spark, sf_dir):
    """Samples, as JSON, whose label is known and whose text has 50 characters or more."""
    label = F.element_at(F.array(*map(F.lit, (*E.LABELS, "MISC", "?"))), ((F.col("conv_id") + F.col("turn")) % 11 + 1).cast("int"))
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(label.alias("label"), "text")).alias("json"))
    return E.valid_gold(rows, "json").select("conv_id", "turn", "label")


@query(f"SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN translate(text, '{C.SYMBOLS}', '') END, text) AS text FROM documents LEFT JOIN labels USING (doc_id)")
def clean_or_raw(spark, sf_dir):
    """The cleaned text where cleaning succeeded, else the raw one."""
    labels = _t(spark, sf_dir, "labels").select("doc_id", "quality")
    cleaned = F.when(F.col("quality") == 1, C.strip_symbols(F.col("text")))
    return _t(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", C.fallback(cleaned, F.col("text")).alias("text"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS \"day\", count(*) AS n FROM events GROUP BY 1")
def events_by_day(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS users, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id")
def role_map(spark, sf_dir):
    """Counts by role, gathered as a map for each conversation."""
    counts = _t(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("m"))
    return maps.select("conv_id", F.coalesce(F.try_element_at("m", F.lit("user")), F.lit(0)).alias("users"), F.size("m").cast("long").alias("roles"))


_KEPT = f"""k AS (SELECT doc_id, source, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Z][a-z]{{2,}}'), lambda x: lower(x)))) AS k, lower({_GIST}) AS s FROM documents)"""


@query(f"""WITH {_KEPT} SELECT doc_id, CASE WHEN len(k) = 0 THEN 100.0 ELSE round(len(list_filter(k, lambda x: contains(s, x))) * 100.0 / len(k), 1) END AS retention_percent, len(k) AS total_key_entities,
array_to_string(list_filter(k, lambda x: contains(s, x)), ',') AS survived, array_to_string(list_filter(k, lambda x: NOT contains(s, x)), ',') AS lost FROM k""")
def retention_report(spark, sf_dir):
    """Which names of each text its summary still has, and which not."""
    marks = F.transform(_names(), lambda w: F.struct(F.when(F.length(w) % 2 == 0, "PER").otherwise("LOC").alias("label"), w.alias("word")))
    rows = M.with_gist(_t(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", E.retention_report(marks, F.col("gist")).alias("r"))
    return rows.select("doc_id", "r.retention_percent", "r.total_key_entities", F.array_join("r.survived", ",").alias("survived"), F.array_join("r.lost", ",").alias("lost"))


@query(f"""WITH {_KEPT}, b AS (SELECT source, doc_id % 40 AS part, arg_min(s, {{'n': -length(s), 'd': doc_id}}) AS s FROM k GROUP BY ALL), w AS (SELECT DISTINCT source, doc_id % 40 AS part, unnest(k) AS w FROM k)
SELECT b.source, CAST(b.part AS BIGINT) AS part, count(w) AS total_unique_entities, count(*) FILTER (WHERE contains(s, w)) AS found_in_global, coalesce(round(count(*) FILTER (WHERE contains(s, w)) * 100.0 / nullif(count(w), 0), 1), 0.0) AS retention_percent
FROM b LEFT JOIN w ON w.source = b.source AND w.part = b.part GROUP BY b.source, b.part""")
def retention_global(spark, sf_dir):
    """Names of a whole book that its summary has, books without names too. A source's texts make forty books; a book's summary is the longest of its texts'."""
    docs = M.with_gist(_t(spark, sf_dir, "documents").withColumn("part", F.col("doc_id") % 40), ["doc_id", "source", "part"], "text")
    words = docs.select("source", "part", F.explode(_names()).alias("word")).withColumn("label", F.when(F.length("word") % 2 == 0, "PER").otherwise("LOC"))
    books = docs.groupBy("source", "part").agg(F.min_by("gist", F.struct(-F.length("gist"), "doc_id")).alias("summary"))
    return E.retention_global(words, books, ["source", "part"])


_HINTS = """l AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), k AS (SELECT * FROM l WHERE trim(text) <> ''),
r AS (SELECT doc_id, row_number() OVER w AS idx, count(*) OVER (PARTITION BY doc_id) AS of_, text, 1 + coalesce(sum(CAST(length(text) % 4 = 0 AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sec FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)), r3 AS (SELECT * FROM r WHERE of_ >= 3)"""
_STOP = ", ".join(f"'{w}'" for w in R.STOPWORDS)
_PROFILE = f"""WITH {_HINTS},
w AS (SELECT doc_id, idx, word FROM (SELECT doc_id, idx, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM r3) WHERE regexp_full_match(word, '[a-zß-ÿ]{{3,}}') AND word NOT IN ({_STOP})),
tf AS (SELECT doc_id, idx, word, count(*) / sum(count(*)) OVER (PARTITION BY doc_id, idx) AS tf FROM w GROUP BY doc_id, idx, word), n AS (SELECT doc_id, count(*) AS n FROM r3 GROUP BY doc_id), f AS (SELECT doc_id, word, count(*) AS df FROM tf GROUP BY doc_id, word),
v AS (SELECT doc_id, idx, word, tf * ln(n / df) AS w FROM tf JOIN f USING (doc_id, word) JOIN n USING (doc_id) WHERE df < n), m AS (SELECT doc_id, idx, sqrt(sum(w * w)) AS norm FROM v GROUP BY doc_id, idx),
q AS (SELECT doc_id, sec, min(idx) AS idx FROM r3 GROUP BY doc_id, sec), g AS (SELECT doc_id, greatest(3, count(*) // 3) AS gap FROM q GROUP BY doc_id),
c AS (SELECT doc_id, a, b FROM (SELECT x.doc_id, x.idx AS a, arg_min(y.idx, y.sec) AS b, row_number() OVER (PARTITION BY x.doc_id ORDER BY x.sec) AS nth FROM q x JOIN g ON g.doc_id = x.doc_id JOIN q y ON y.doc_id = x.doc_id AND y.sec - x.sec >= gap GROUP BY x.doc_id, x.sec, x.idx) WHERE nth <= 20),
p AS (SELECT a.doc_id, CASE WHEN a.sec = b.sec THEN 'intra' ELSE 'boundary' END AS kind, a.idx AS a, b.idx AS b FROM r3 a JOIN r3 b ON a.doc_id = b.doc_id AND b.idx = a.idx + 1 UNION ALL SELECT doc_id, 'cross', a, b FROM c),
dots AS (SELECT p.doc_id, p.a, p.b, p.kind, sum(x.w * y.w) AS dot FROM p JOIN v x ON x.doc_id = p.doc_id AND x.idx = p.a JOIN v y ON y.doc_id = p.doc_id AND y.idx = p.b AND y.word = x.word GROUP BY ALL),
s AS (SELECT p.doc_id, p.kind, p.a AS chunk_a, p.b AS chunk_b, round(coalesce(dot / nullif(x.norm * y.norm, 0), 0), 4) AS similarity FROM p LEFT JOIN dots USING (doc_id, a, b, kind) LEFT JOIN m x ON x.doc_id = p.doc_id AND x.idx = p.a LEFT JOIN m y ON y.doc_id = p.doc_id AND y.idx = p.b)"""


def _mean(kind: str) -> str:
    """SQL for the average of four-digit similarities of a kind to four digits, halves up."""
    some = f"FILTER (WHERE kind = '{kind}')"
    return f"(2 * CAST(round(sum(similarity) {some} * 10000) AS BIGINT) + count(*) {some}) // nullif(2 * count(*) {some}, 0) / 10000"


def _profile(spark, sf_dir):
    """Lines as chunks; a new section begins after each line whose length is a multiple of four."""
    return R.coherence_pairs(_t(spark, sf_dir, "documents"), lambda lines: list(itertools.accumulate((len(x) % 4 == 0 for x in lines[:-1]), initial=1)))


@query(f"{_PROFILE} SELECT doc_id, kind, chunk_a, chunk_b, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY chunk_a) AS nth FROM s) WHERE kind = 'cross' OR nth <= 30")
def coherence_pairs(spark, sf_dir):
    """The first thirty pairs of neighbours within and across sections, and all cross pairs (a top-k report)."""
    w = Window.partitionBy("doc_id", "kind").orderBy("chunk_a")
    return _profile(spark, sf_dir).withColumn("nth", F.row_number().over(w)).where("kind = 'cross' OR nth <= 30").drop("nth")


@query(f"""{_PROFILE}, t AS (SELECT doc_id, {_mean('intra')} AS avg_intra, {_mean('boundary')} AS avg_boundary, {_mean('cross')} AS avg_cross,
count(*) FILTER (WHERE kind = 'intra') AS n_intra, count(*) FILTER (WHERE kind = 'boundary') AS n_boundary, count(*) FILTER (WHERE kind = 'cross') AS n_cross FROM s GROUP BY doc_id) SELECT *, round(avg_intra - avg_boundary, 4) AS delta FROM t""")
def coherence_report(spark, sf_dir):
    """One row for each book: average similarity within, across and far from section borders, and how sharp the borders are."""
    return R.coherence_report(_profile(spark, sf_dir), "doc_id")


@query(f"""WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i, coalesce(text, '') AS t FROM conversations),
b AS (SELECT conv_id, i, t, length(t) AS n, 0 AS batch FROM c WHERE i = 1 UNION ALL SELECT c.conv_id, c.i, c.t, CASE WHEN b.n + length(c.t) > 500 THEN length(c.t) ELSE b.n + length(c.t) END, b.batch + CAST(b.n + length(c.t) > 500 AS INT)
FROM b JOIN c ON c.conv_id = b.conv_id AND c.i = b.i + 1), j AS (SELECT conv_id, batch, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM b GROUP BY conv_id, batch), s AS (SELECT conv_id, batch, {_GIST} AS s FROM j),
m AS (SELECT conv_id, count(*) AS k, string_agg(s, chr(10) || chr(10) ORDER BY batch) AS text, string_agg(s, ' ' ORDER BY batch) AS spaced FROM s WHERE s <> '' GROUP BY conv_id), g AS (SELECT conv_id, k, text, spaced, {_GIST} AS again FROM m),
f AS (SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM c GROUP BY conv_id), w AS (SELECT conv_id, length(text) AS n, {_GIST} AS whole FROM f)
SELECT conv_id, CASE WHEN n <= 500 THEN whole WHEN k > 1 THEN coalesce(nullif(again, ''), spaced) ELSE coalesce(text, '') END AS summary FROM w LEFT JOIN g USING (conv_id)""")
def batched_summaries(spark, sf_dir):
    """A conversation's summary, of batches of up to 500 characters where it is longer."""
    return M.batched_sections(_t(spark, sf_dir, "conversations"), "conv_id", "turn", 500)


@query("SELECT conv_id, turn, role || ' listed' AS topic_hint, text FROM conversations WHERE turn % 3 <> 1")
def manifest_chunks(spark, sf_dir):
    """Chunks that a manifest lists; those whose files are missing are passed over."""
    rows = _t(spark, sf_dir, "conversations").select(F.lit("turns").alias("method"), F.col("conv_id").cast("string").alias("book_name"), F.col("turn").alias("chunk_id"), "text", "role", "conv_id")
    listed = K.manifest(rows.withColumn("topic_hint", F.concat("role", F.lit(" listed"))).withColumn("char_start", F.lit(0)).withColumn("char_end", F.length("text")))
    found = S.listed_chunks(listed, rows.where("chunk_id % 3 <> 1"))
    return found.select(F.col("book_name").cast("long").alias("conv_id"), F.col("chunk_id").alias("turn"), "topic_hint", "text")
