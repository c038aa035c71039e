"""The registered queries over the driver's tables, each with DuckDB SQL for the same rows where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import naming as G
from ..operators import chunks as H
from ..operators import entities as E
from ..operators import ordering as O
from ..operators import packing as L
from ..operators import reading as D
from ..operators import report as R
from ..operators import summaries as M
from ..sources import archive as A
from ..sources import books as B
from ..sources import sinks as K
from ..streaming import events as S
from .registry import query


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _map(spark: SparkSession, sf_dir: str, f, table: str = "documents", key: str = "doc_id") -> DataFrame:
    return _t(spark, sf_dir, table).select(key, f(F.col("text")).alias("text"))


def _names() -> Column:
    return F.regexp_extract_all("text", F.lit(E.NAME), F.lit(0))


_SYMBOLS = f"translate(text, '{C.SYMBOLS}', '')"
_DICTIONARY = "text"
for _a, _b in C.CORRECTIONS:
    _quoted = [x.replace("'", "''") for x in (_a, _b)]
    _DICTIONARY = f"replace({_DICTIONARY}, '{_quoted[0]}', '{_quoted[1]}')"


@query(f"SELECT doc_id, {_SYMBOLS} AS text FROM documents")
def clean_strip_symbols(spark, sf_dir):
    return _map(spark, sf_dir, C.strip_symbols)


@query(f"SELECT doc_id, length(text) AS raw_chars, length(t) AS chars, length(text) - length(t) AS removed, round((length(text) - length(t)) * 100.0 / nullif(length(text), 0), 1) AS pct FROM (SELECT doc_id, text, {_SYMBOLS} AS t FROM documents)")
def clean_stats(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("raw_chars"), F.length(C.strip_symbols(F.col("text"))).alias("chars"))
    removed = F.col("raw_chars") - F.col("chars")
    return d.withColumn("removed", removed).withColumn("pct", F.round(removed * 100.0 / F.nullif("raw_chars", F.lit(0)), 1))


@query("SELECT doc_id, regexp_replace(text, ' +', ' ', 'g') AS text FROM documents")
def clean_collapse_spaces(spark, sf_dir):
    return _map(spark, sf_dir, C.collapse_spaces)


@query("SELECT doc_id, replace(text, '-' || chr(10), chr(10)) AS text FROM documents")
def clean_hyphen_eol(spark, sf_dir):
    return _map(spark, sf_dir, C.join_hyphenated)


@query("SELECT conv_id, turn, replace(text, '''', '’') AS text FROM conversations")
def clean_curly_apostrophe(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", C.curly_apostrophes(F.col("text")).alias("text"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, '\"'), lambda p, i: CASE WHEN i = 1 THEN p WHEN i % 2 = 0 THEN '«' || p ELSE '»' || p END), '') AS text FROM documents")
def clean_quote_toggle(spark, sf_dir):
    return _map(spark, sf_dir, C.toggle_quotes)


@query(f"SELECT doc_id, {_DICTIONARY} AS text FROM documents")
def clean_dictionary(spark, sf_dir):
    return _map(spark, sf_dir, C.apply_dictionary)


_ENDINGS = f"""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[{C.W.replace("'", "''")}]+\\.?|[^{C.W.replace("'", "''")}]+'), lambda t: CASE
  WHEN t LIKE '%.' OR NOT regexp_matches(t, '^[{C.W.replace("'", "''")}]') THEN t ELSE list_transform([list_transform([CASE WHEN regexp_matches(t, '[a-z]') THEN regexp_replace(t, '[{C.K}]+$', '') ELSE t END],
    lambda o: CASE WHEN strlen(o) = 2 AND regexp_matches(o, '(?i)[{C.K}]$') THEN o[1:1] ELSE o END)[1]],
    lambda o: CASE WHEN strlen(o) = 1 AND regexp_matches(o, '(?i)^[{C.K}]$') AND (regexp_matches(o, '[a-z]') OR regexp_matches(t, '[a-z]')) THEN '' ELSE o END)[1] END), '') AS text FROM documents
"""


@query(_ENDINGS)
def clean_word_endings(spark, sf_dir):
    return _map(spark, sf_dir, C.strip_endings)


@query()
def clean_garbage_filter(spark, sf_dir):
    return _map(spark, sf_dir, C.drop_garbage)


@query()
def clean_dropcaps(spark, sf_dir):
    return _map(spark, sf_dir, C.reconnect_drop_caps)


@query()
def clean_contextual(spark, sf_dir):
    return _map(spark, sf_dir, C.contextual_rewrite)


@query()
def clean_full(spark, sf_dir):
    return _map(spark, sf_dir, C.clean)


@query("SELECT doc_id, replace(replace(text, 'the', 'der'), 'der ', 'den ') AS text FROM documents")
def apply_corrections(spark, sf_dir):
    fixes = F.array(*[F.struct(F.lit(a).alias("errato"), F.lit(b).alias("corretto")) for a, b in (("the", "der"), ("", "x"), ("der ", "den "))])
    return _map(spark, sf_dir, lambda t: C.apply_corrections(t, fixes))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace('<think>' || role || '</think>' || chr(10) || chr(10) || text || chr(9), '(?is)<think>.*?</think>', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM conversations""")
def strip_think(spark, sf_dir):
    said = F.concat(F.lit("<think>"), F.col("role"), F.lit("</think>\n\n"), F.col("text"), F.lit("\t"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", C.strip_think(said).alias("text"))


_MARKDOWN = "text"
for _a, _b in C.MARKDOWN:
    _MARKDOWN = f"regexp_replace({_MARKDOWN}, '{_a}', '{_b.replace('$', chr(92))}', 'g')"


@query(f"SELECT doc_id, regexp_replace({_MARKDOWN}, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') AS text FROM documents")
def strip_markdown(spark, sf_dir):
    return _map(spark, sf_dir, C.strip_markdown)


#: The summaries' stand-in: the longest line, of equal ones the first, up to 300 characters.
_GIST = "substr(list_sort(list_transform(string_split(text, chr(10)), lambda l, i: {'n': -length(l), 'i': i, 'l': l}))[1].l, 1, 300)"
_LINES = "c AS (SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), k AS (SELECT * FROM c WHERE trim(text) <> '')"
_STOP = ", ".join(f"'{w}'" for w in R.STOPWORDS)
_TERMS = "w AS (SELECT doc_id, idx, word FROM (SELECT doc_id, idx, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+')) AS word FROM %s) WHERE regexp_full_match(word, '[a-zß-ÿ]{3,}') AND word NOT IN (" + _STOP + "))"
_TF = "tf AS (SELECT doc_id, idx, word, count(*) / sum(count(*)) OVER (PARTITION BY doc_id, idx) AS tf FROM w GROUP BY doc_id, idx, word)"


@query(f"WITH {_LINES}, {_TERMS % 'k'}, {_TF} SELECT * FROM tf")
def tf(spark, sf_dir):
    return R.text_weights(_t(spark, sf_dir, "documents"), idf=False)


_IDF = "n AS (SELECT doc_id, count(*) AS n FROM %s GROUP BY doc_id), f AS (SELECT doc_id, word, count(*) AS df FROM tf GROUP BY doc_id, word), v AS (SELECT doc_id, idx, word, tf * ln(n / df) AS w FROM tf JOIN f USING (doc_id, word) JOIN n USING (doc_id) WHERE df < n)"


@query(f"WITH {_LINES}, {_TERMS % 'k'}, {_TF}, {_IDF % 'k'} SELECT * FROM v")
def tfidf(spark, sf_dir):
    return R.text_weights(_t(spark, sf_dir, "documents"), idf=True)


_SIM = f"""WITH {_LINES}, r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS idx, count(*) OVER (PARTITION BY doc_id) AS of_, text FROM k), r3 AS (SELECT * FROM r WHERE of_ >= 3),
{_TERMS % 'r3'}, {_TF}, {_IDF % 'r3'}, m AS (SELECT doc_id, idx, sqrt(sum(w * w)) AS norm FROM v GROUP BY doc_id, idx),
dots AS (SELECT a.doc_id, a.idx, sum(a.w * b.w) AS dot FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.word = b.word AND b.idx = a.idx + 1 GROUP BY a.doc_id, a.idx),
s AS (SELECT r3.doc_id, r3.idx, round(coalesce(dot / nullif(m.norm * x.norm, 0), 0), 4) AS sim FROM r3 LEFT JOIN dots USING (doc_id, idx) LEFT JOIN m USING (doc_id, idx) LEFT JOIN m x ON x.doc_id = r3.doc_id AND x.idx = r3.idx + 1 WHERE r3.idx < of_)"""


@query(f"{_SIM} SELECT * FROM s")
def adjacent_similarity(spark, sf_dir):
    return R.text_similarity(_t(spark, sf_dir, "documents"))


@query(f"{_SIM} SELECT doc_id, count(*) AS pairs, round(avg(sim), 3) AS avg_sim, max(sim) AS max_sim FROM s GROUP BY doc_id")
def similarity_profile(spark, sf_dir):
    sims = R.text_similarity(_t(spark, sf_dir, "documents"))
    return sims.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("sim"), 3).alias("avg_sim"), F.max("sim").alias("max_sim"))


@query("SELECT doc_id, s AS start, least(s + 2000, length(text)) AS \"end\" FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 2000) / 1700)) AS BIGINT) * 1700 + 1, 1700)) AS s FROM documents WHERE length(text) > 0)")
def windows_sliding(spark, sf_dir):
    return H.sliding_windows(_t(spark, sf_dir, "documents"))


@query("SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\pL\\pN_])(CAPITOLO|CAPO|CAP\\.|LIBRO|PARTE)\\s+([IVXLCDM]+|[0-9]+)($|[^\\pL\\pN_])') AS heading FROM documents")
def explicit_headings(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", H.is_heading(F.col("text")).alias("heading"))


_COS = "SELECT vec_id, label, list_cosine_similarity(CAST(lag(embedding) OVER w AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS c FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)"


@query(f"SELECT vec_id, label, round(c, 6) AS sim, coalesce(c < 0.35, false) AS boundary, CAST(sum(CAST(coalesce(c < 0.35, false) AS INT)) OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS section FROM ({_COS})")
def embed_sections(spark, sf_dir):
    rows = H.embedding_boundaries(_t(spark, sf_dir, "embeddings"), ["label"], "vec_id")
    return rows.select("vec_id", "label", F.round("sim", 6).alias("sim"), "boundary", "section")


_ENT = "e AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS word FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]{2,}') AS x FROM documents)), n AS (SELECT *, CASE WHEN length(word) % 2 = 0 THEN 'PER' ELSE 'LOC' END AS label FROM e)"


@query(f"WITH {_ENT} SELECT * FROM n")
def entities_extract(spark, sf_dir):
    return E.extract(_t(spark, sf_dir, "documents"))


@query(f"WITH {_ENT} SELECT label, count(*) AS n FROM n GROUP BY label")
def entities_label_counts(spark, sf_dir):
    return E.extract(_t(spark, sf_dir, "documents")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ENT} SELECT word, count(*) AS n, arg_min(label, {{'d': doc_id, 'p': pos}}) AS label FROM n GROUP BY word ORDER BY n DESC, word LIMIT 15")
def entities_top15(spark, sf_dir):
    return E.word_counts(E.extract(_t(spark, sf_dir, "documents"))).orderBy(F.desc("n"), "word").limit(15)


@query(f"WITH {_ENT} SELECT * FROM n WHERE label = 'PER' AND contains(lower(word), 'an')")
def entities_facet(spark, sf_dir):
    return E.extract(_t(spark, sf_dir, "documents")).where((F.col("label") == "PER") & F.contains(F.lower("word"), F.lit("an")))


@query(f"WITH {_ENT}, s AS (SELECT *, (pos % 10) / 10 AS score FROM n) SELECT doc_id, pos, word, label, score FROM s WHERE score >= 0.65 AND length(word) >= 3 AND NOT regexp_full_match(word, '(?i)(il|lo|la|i|gli|le|un|uno|una|di|de|del|dello|della|dei|degli|delle|e|o|a|da|in|su|con|per|tra|fra|l|d)')")
def entities_valid(spark, sf_dir):
    rows = E.extract(_t(spark, sf_dir, "documents")).withColumn("score", F.col("pos") % 10 / 10)
    return rows.where(E.is_valid(F.col("label"), F.col("word"), F.col("score")))


@query(f"WITH {_ENT} SELECT doc_id, word, label, max(pos) AS pos FROM n GROUP BY doc_id, word, label")
def entities_dedup_last(spark, sf_dir):
    return E.last_wins(E.extract(_t(spark, sf_dir, "documents")), ["doc_id", "word", "label"], "pos").select("doc_id", "word", "label", "pos")


_SPANS = """hits AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS word, unnest(g[1:len(x)]) AS gap FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]{2,}') AS x, string_split_regex(text, '[A-Z][a-z]{2,}') AS g FROM documents)),
n AS (SELECT doc_id, pos, word, CASE WHEN length(word) % 2 = 0 THEN 'PER' ELSE 'LOC' END AS label, CAST(sum(length(gap) + length(word)) OVER w - length(word) AS INT) AS start, CAST(sum(length(gap) + length(word)) OVER w AS INT) AS stop FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""


@query(f'WITH {_SPANS} SELECT doc_id, pos, word, label, start, stop AS "end" FROM n')
def entities_spans(spark, sf_dir):
    return E.extract_spans(_t(spark, sf_dir, "documents"))


@query(f"""WITH {_SPANS}, s AS (SELECT doc_id, label, start, stop, (pos % 10) / 10 AS score FROM n),
r AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER w THEN 1 ELSE 0 END AS c FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY start, stop, label)),
g AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY start, stop, label) AS st FROM r),
h AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY doc_id, st ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS nw FROM g),
i AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY start, stop, label) AS sp FROM h)
SELECT doc_id, label, min(start) AS start, max(stop) AS "end", max(score) AS score FROM i GROUP BY doc_id, sp, label""")
def entities_merge_spans(spark, sf_dir):
    spans = E.extract_spans(_t(spark, sf_dir, "documents")).select("doc_id", "label", "start", "end", (F.col("pos") % 10 / 10).alias("score"))
    return E.merge_spans(spans, "doc_id")


@query(f"""WITH {_SPANS},
c AS (SELECT doc_id, s AS char_start, least(s + 2000, length(text)) AS char_end FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 2000) / 1700)) AS BIGINT) * 1700 + 1, 1700)) AS s FROM documents WHERE length(text) > 0))
SELECT c.doc_id, char_start, count(n.doc_id) AS num_entities FROM c LEFT JOIN n ON n.doc_id = c.doc_id AND start >= char_start AND stop <= char_end GROUP BY c.doc_id, char_start""")
def chunk_entity_containment(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    windows = H.sliding_windows(docs).select("doc_id", F.col("start").alias("char_start"), F.col("end").alias("char_end"))
    return E.entity_counts(windows, E.extract_spans(docs), "doc_id")


_KEYS = "k AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{2,}')) AS keys FROM conversations)"


@query(f"""WITH {_KEYS}, b AS (SELECT a.conv_id, a.turn, count(DISTINCT p.w) FILTER (WHERE list_contains(a.keys, p.w)) AS shared FROM k a JOIN (SELECT conv_id, turn, unnest(keys) AS w FROM k) p ON p.conv_id = a.conv_id AND p.turn BETWEEN a.turn - 4 AND a.turn - 1 GROUP BY a.conv_id, a.turn)
SELECT k.conv_id, k.turn, CASE WHEN k.turn > (SELECT min(turn) FROM k z WHERE z.conv_id = k.conv_id) THEN coalesce(shared, 0) END AS shared, k.turn > (SELECT min(turn) FROM k z WHERE z.conv_id = k.conv_id) AND coalesce(shared, 0) < 1 AS boundary FROM k LEFT JOIN b USING (conv_id, turn)""")
def ner_l1_boundaries(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{2,}"), F.lit(0))).alias("keys"))
    return H.frame_boundaries(rows, ["conv_id"], "turn", "keys", 4, 1).select("conv_id", "turn", "shared", "boundary")


@query("SELECT conv_id, turn, CAST(sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS island FROM (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS c FROM conversations)")
def section_islands(spark, sf_dir):
    return H.islands(_t(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role")).select("conv_id", "turn", "island")


@query("""WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS i, coalesce(length(text), 0) AS n FROM conversations),
b AS (SELECT conv_id, i, n AS open, 0 AS batch FROM c WHERE i = 1 UNION ALL SELECT c.conv_id, c.i, CASE WHEN b.open + c.n > 2000 THEN c.n ELSE b.open + c.n END, b.batch + CAST(b.open + c.n > 2000 AS INT) FROM b JOIN c ON c.conv_id = b.conv_id AND c.i = b.i + 1)
SELECT conv_id, string_agg(size, ',' ORDER BY batch) AS batches FROM (SELECT conv_id, batch, max(open) AS size FROM b GROUP BY conv_id, batch) GROUP BY conv_id""")
def budget_batches(spark, sf_dir):
    return H.budget_batches(_t(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", 2000).withColumn("batches", F.array_join(F.transform("batches", lambda b: b.cast("string")), ","))


@query("SELECT source, b AS batch, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT source, n_chars, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS b FROM documents) GROUP BY source, b")
def macro_batches(spark, sf_dir):
    return H.fixed_batches(_t(spark, sf_dir, "documents"), ["source"], "doc_id", 10).groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, CASE WHEN len(k) = 0 THEN 100.0 ELSE round(len(list_filter(k, lambda x: contains(lower(s), x))) * 100.0 / len(k), 1) END AS retention FROM (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Z][a-z]{2,}'), lambda x: lower(x))) AS k, " + _GIST + " AS s FROM documents)")
def retention_section(spark, sf_dir):
    return M.with_gist(_t(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", E.retention(_names(), F.col("gist")).alias("retention"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, sf_dir):
    return B.unseen(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("doc_id", "source")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_version(spark, sf_dir):
    return B.latest(_t(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


_VECS = """v AS (SELECT vec_id // 100 AS book, vec_id, label, list_cosine_similarity(CAST(lag(embedding) OVER w AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS c, lag(label) OVER w AS p, count(*) OVER (PARTITION BY vec_id // 100) AS n FROM embeddings WINDOW w AS (PARTITION BY vec_id // 100 ORDER BY vec_id)),
l AS (SELECT book, vec_id AS l FROM v WHERE c < 0.35 AND n >= 3), g AS (SELECT book, vec_id AS g FROM v WHERE p IS NOT NULL AND label <> p)"""


def _prf_sql(tolerance: int) -> str:
    return f"""WITH {_VECS}, c AS (SELECT book, count(l) AS n_local, count(l) FILTER (WHERE EXISTS (SELECT 1 FROM g WHERE g.book = l.book AND abs(l - g) <= {tolerance})) AS hit_local FROM l GROUP BY book),
    d AS (SELECT book, count(g) AS n_gold, count(g) FILTER (WHERE EXISTS (SELECT 1 FROM l WHERE g.book = l.book AND abs(l - g) <= {tolerance})) AS hit_gold FROM g GROUP BY book),
    e AS (SELECT book, coalesce(hit_local, 0) AS hit_local, coalesce(n_local, 0) AS n_local, coalesce(hit_gold, 0) AS hit_gold, coalesce(n_gold, 0) AS n_gold FROM c FULL JOIN d USING (book)),
    f AS (SELECT *, CASE WHEN n_local > 0 THEN hit_local / n_local ELSE 0 END AS p, CASE WHEN n_gold > 0 THEN hit_gold / n_gold ELSE 0 END AS r FROM e)
    SELECT book, hit_local, n_local, hit_gold, n_gold, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM f"""


def _boundary_prf(spark, sf_dir, tolerance):
    """Each hundred vectors is a book: boundaries by similarity against those at which the label changes."""
    rows = _t(spark, sf_dir, "embeddings").withColumn("book", F.floor(F.col("vec_id") / 100))
    found = H.embedding_boundaries(rows, ["book"], "vec_id").where("boundary").select("book", F.col("vec_id").alias("l"))
    changed = F.lag("label").over(Window.partitionBy("book").orderBy("vec_id")) != F.col("label")
    gold = rows.select("book", "vec_id", changed.alias("changed")).where("changed").select("book", F.col("vec_id").alias("g"))
    return R.boundary_scores(gold, found, tolerance, ["book"])


@query(_prf_sql(2))
def boundary_prf_embed(spark, sf_dir):
    return _boundary_prf(spark, sf_dir, 2)


@query(_prf_sql(1))
def boundary_prf_ner(spark, sf_dir):
    return _boundary_prf(spark, sf_dir, 1)


@query("""WITH c AS (SELECT source, grouping(source) = 1 AS is_total, sum(CAST(n_chars > 1000 AND quality = 1 AS INT)) AS tp, sum(CAST(n_chars > 1000 AND quality <> 1 AS INT)) AS fp, sum(CAST(n_chars <= 1000 AND quality = 1 AS INT)) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source))
SELECT source, is_total, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM c""")
def label_prf_rollup(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    return R.label_scores(rows, "source", F.col("n_chars") > 1000, F.col("quality") == 1)


_NEAR = """WITH a AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS p, event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS q FROM events WHERE event_type = (SELECT max(event_type) FROM events)),
n AS (SELECT a.user_id, a.p, a.event_id, arg_min(q, abs(q - p) * 2 + CASE WHEN q > p THEN 1 ELSE 0 END) AS near FROM a LEFT JOIN b USING (user_id) GROUP BY a.user_id, a.p, a.event_id),
d AS (SELECT user_id, p AS "at", near, abs(p - near) AS dist, coalesce(abs(p - near) <= 1500, false) AS is_match FROM n)"""


def _nearest(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", "event_type", F.unix_timestamp("ts").alias("at"))
    ends = rows.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    rows = rows.join(F.broadcast(ends))  # one row
    return R.nearest(rows.where("event_type = lo").select("user_id", "at"), rows.where("event_type = hi").select("user_id", F.col("at").alias("near")).distinct(), "user_id", "at", "near", 1500)


@query(f"{_NEAR} SELECT * FROM d")
def nearest_boundary(spark, sf_dir):
    return _nearest(spark, sf_dir)


@query(f"{_NEAR} SELECT count(*) AS n, CAST(sum(CAST(is_match AS INT)) AS BIGINT) AS matches, round(sum(CAST(is_match AS INT)) / count(*), 2) AS ratio FROM d")
def boundary_agreement(spark, sf_dir):
    return _nearest(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_match").cast("int")).alias("matches"), F.round(F.sum(F.col("is_match").cast("int")) / F.count(F.lit(1)), 2).alias("ratio"))


@query("SELECT c_custkey, c_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def catalog_list(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_custkey").distinct()
    return _t(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.col("o_custkey").isNotNull().alias("has_orders"))


@query("SELECT o_orderkey, o_custkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey")
def catalog_nested(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("l"))
    joined = _t(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", "o_custkey", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("lines"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def catalog_orphans(spark, sf_dir):
    return _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_scan(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '1') OR contains(CAST(p_partkey AS VARCHAR), '7')")
def title_search(spark, sf_dir):
    return _t(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("1")) | F.col("p_partkey").cast("string").contains("7")).select("p_partkey", "p_name")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    return S.tumbling(_t(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([b, b - INTERVAL 30 MINUTE]) AS start, event_type, value FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b, event_type, value FROM events)) GROUP BY start, event_type""")
def events_sliding(spark, sf_dir):
    return S.sliding(_t(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""WITH s AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS c FROM events), g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def events_session(spark, sf_dir):
    return S.sessions(_t(spark, sf_dir, "events"))


@query("""WITH k AS (SELECT source, doc_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{2,}')) AS k FROM documents), n AS (SELECT source, doc_id, k, lag(k) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM k)
SELECT source, doc_id, CASE WHEN len(list_distinct(list_concat(k, p))) = 0 THEN 1.0 ELSE round(len(list_intersect(k, p)) / len(list_distinct(list_concat(k, p))), 6) END AS jaccard FROM n WHERE p IS NOT NULL""")
def adjacent_jaccard(spark, sf_dir):
    keys = _t(spark, sf_dir, "documents").select("source", "doc_id", F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{2,}"), F.lit(0))).alias("k"))
    rows = O.with_previous(keys, ["source"], "doc_id", "k", "p").where("p IS NOT NULL")
    both = F.size(F.array_union("k", "p"))
    return rows.select("source", "doc_id", F.when(both == 0, 1.0).otherwise(F.round(F.size(F.array_intersect("k", "p")) / F.greatest(both, F.lit(1)), 6)).alias("jaccard"))


@query("SELECT conv_id, role, num_chunks, total_chars, " + _GIST + " AS summary FROM (SELECT conv_id, role, count(*) AS num_chunks, CAST(sum(length(text)) AS BIGINT) AS total_chars, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id, role)")
def section_summaries(spark, sf_dir):
    return M.sections(_t(spark, sf_dir, "conversations"), "conv_id", "role", "turn")


_BOOKS = """WITH s AS (SELECT source, pos, s FROM (SELECT source, doc_id AS pos, <text> AS s FROM documents) WHERE trim(s, ' ') <> ''), a AS (SELECT source, s, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY pos) - 1 AS i FROM s),
b AS (SELECT source, CASE WHEN n > 10 THEN i // 10 ELSE i END AS pos, n > 10 AS many, string_agg(s, chr(10) || chr(10) ORDER BY i) AS j FROM a GROUP BY ALL), c AS (SELECT source, pos, CASE WHEN many THEN <j> ELSE j END AS s FROM b),
d AS (SELECT source, s, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY pos) - 1 AS i FROM c WHERE trim(s, ' ') <> ''),
e AS (SELECT source, CASE WHEN n > 4 THEN i // 4 ELSE i END AS pos, n > 4 AS many, string_agg(s, chr(10) || chr(10) ORDER BY i) AS j FROM d GROUP BY ALL), f AS (SELECT source, pos, CASE WHEN many THEN <j> ELSE j END AS s FROM e)
SELECT source, count(*) AS parts, string_agg(s, chr(10) || chr(10) ORDER BY pos) AS global_summary FROM f GROUP BY source""".replace("<text>", _GIST).replace("<j>", _GIST.replace("text", "j"))


@query(_BOOKS)
def book_summaries(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("source", "doc_id", M.gist(F.col("text")).alias("summary"))
    return M.books(rows, "source", "doc_id")


@query("""WITH q AS (SELECT DISTINCT source, (doc_id // 40) * (doc_id // 40) // 7 AS s FROM documents), g AS (SELECT source, greatest(3, count(*) // 3) AS gap FROM q GROUP BY source)
SELECT source, a, b FROM (SELECT x.source, x.s AS a, min(y.s) AS b, row_number() OVER (PARTITION BY x.source ORDER BY x.s) AS n FROM q x JOIN g ON g.source = x.source JOIN q y ON y.source = x.source AND y.s - x.s >= gap GROUP BY x.source, x.s) WHERE n <= 20""")
def cross_pairs(spark, sf_dir):
    """Sections' numbers have gaps of their own, uneven ones."""
    by = F.floor(F.col("doc_id") / 40)
    rows = _t(spark, sf_dir, "documents").select("source", "doc_id", F.floor(by * by / 7).alias("section"))
    return R.cross_pairs(rows, "source", "section", "doc_id")


@query("SELECT source, round(avg(r), 1) AS avg_retention FROM (SELECT source, CASE WHEN len(k) = 0 THEN 100.0 ELSE round(len(list_filter(k, lambda x: contains(lower(s), x))) * 100.0 / len(k), 1) END AS r FROM (SELECT source, list_distinct(list_transform(regexp_extract_all(text, '[A-Z][a-z]{2,}'), lambda x: lower(x))) AS k, " + _GIST + " AS s FROM documents)) GROUP BY source")
def retention_average(spark, sf_dir):
    rows = M.with_gist(_t(spark, sf_dir, "documents"), "source", "text").select("source", E.retention(_names(), F.col("gist")).alias("r"))
    return rows.groupBy("source").agg(F.round(F.avg("r"), 1).alias("avg_retention"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS n FROM documents) WHERE n = 1")
def upload_dedupe(spark, sf_dir):
    return B.latest(_t(spark, sf_dir, "documents"), ["source", "lang"], "doc_id").select("doc_id", "source")


@query("SELECT doc_id, length(text) AS chars, len(list_filter(string_split_regex(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')) AS words, substr(text, 1, 50000) AS preview FROM documents")
def text_preview(spark, sf_dir):
    words = F.size(F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))
    return _t(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"), words.alias("words"), F.substring("text", 1, 50000).alias("preview"))


@query("""WITH t AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}'))) AS w FROM documents))
SELECT a.doc_id, a.w AS a, b.w AS b FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.w < b.w AND (contains(b.w, a.w) OR contains(a.w, b.w))""")
def fuzzy_pairs(spark, sf_dir):
    """Pairs that match loosely among all words of each document; words meet by the substrings of the longer one."""
    words = E.extract(_t(spark, sf_dir, "documents")).select("doc_id", E.normal_word(F.col("word")).alias("w")).distinct()
    starts = F.sequence(F.lit(1), F.length("w") - 2)
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(3), F.length("w") - i + 1), lambda n: F.substring("w", i, n))))
    inner = words.select("doc_id", F.col("w").alias("long"), F.explode(F.array_distinct(parts)).alias("short"))
    pairs = inner.join(words.withColumnRenamed("w", "short"), ["doc_id", "short"]).where("short <> long")
    return pairs.select("doc_id", F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b"))


_SHARED = "b AS (SELECT a.conv_id, a.turn, count(DISTINCT p.w) FILTER (WHERE list_contains(a.keys, p.w)) AS shared FROM k a JOIN (SELECT conv_id, turn, unnest(keys) AS w FROM k) p ON p.conv_id = a.conv_id AND p.turn BETWEEN a.turn - 4 AND a.turn - 1 GROUP BY a.conv_id, a.turn)"


@query(f"""WITH {_KEYS}, {_SHARED}, x AS (SELECT conv_id, turn, keys, sum(CASE WHEN turn > m AND coalesce(shared, 0) < 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section
  FROM k LEFT JOIN b USING (conv_id, turn) JOIN (SELECT conv_id, min(turn) AS m FROM k GROUP BY conv_id) USING (conv_id)),
s AS (SELECT conv_id, CAST(section AS BIGINT) AS section, min(turn) AS "first", max(turn) AS "last", list_distinct(flatten(list(keys))) AS keys FROM x GROUP BY conv_id, section),
c AS (SELECT a.conv_id, a.section, count(DISTINCT p.w) FILTER (WHERE list_contains(a.keys, p.w)) AS shared FROM s a JOIN (SELECT conv_id, section, unnest(keys) AS w FROM s) p ON p.conv_id = a.conv_id AND p.section BETWEEN a.section - 3 AND a.section - 1 GROUP BY a.conv_id, a.section)
SELECT conv_id, section, "first", "last", CAST(1 + sum(CASE WHEN section > 0 AND coalesce(shared, 0) < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY section) AS BIGINT) AS chapter FROM s LEFT JOIN c USING (conv_id, section)""")
def ner_chapters(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{2,}"), F.lit(0))).alias("keys"))
    return H.chapters(rows, ["conv_id"], "turn", "keys").select("conv_id", "section", "first", "last", "chapter")


@query("""SELECT conv_id, turn, replace(CASE WHEN len(w) = 0 THEN t ELSE regexp_replace(t, '(' || array_to_string(list_transform(list_reverse_sort(list_transform(w, lambda x: {'n': length(x), 'w': x})), lambda x: x.w), '|') || ')', '<span class="hl-per" title="PER">\\1</span>', 'g') END, chr(10), '<br>') AS html
FROM (SELECT conv_id, turn, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{2,}')) AS w FROM conversations)""")
def entities_highlight(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{2,}"), F.lit(0))
    marks = F.transform(words, lambda w: F.struct(F.lit("PER").alias("label"), w.alias("word")))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", D.highlight(F.col("text"), marks).alias("html"))


@query("""WITH RECURSIVE w AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Z][a-z]{2,}') AS x FROM conversations), g AS (SELECT conv_id, turn, list_transform(list_filter(x, lambda e, i: list_position(x, e) = i), lambda e: lower(e)) AS gold FROM w),
p AS (SELECT conv_id, turn, gold, lead(gold) OVER (PARTITION BY conv_id ORDER BY turn) AS found FROM g),
r AS (SELECT conv_id, turn, gold, found, 0 AS i, CAST([] AS BIGINT[]) AS taken FROM p WHERE found IS NOT NULL UNION ALL SELECT conv_id, turn, gold, found, i + 1, CASE WHEN f IS NULL THEN taken ELSE list_append(taken, f) END FROM (SELECT *, list_filter(range(1, len(found) + 1),
  lambda j: NOT list_contains(taken, j) AND (gold[i + 1] = found[j] OR (length(gold[i + 1]) >= 3 AND contains(found[j], gold[i + 1])) OR (length(found[j]) >= 3 AND contains(gold[i + 1], found[j]))))[1] AS f FROM r WHERE i < len(gold)))
SELECT conv_id, turn, CAST(len(gold) AS INT) AS n_gold, CAST(len(found) AS INT) AS n_found, CAST(len(taken) AS INT) AS tp FROM r WHERE i = len(gold)""")
def entities_one_to_one(spark, sf_dir):
    """Capitalised words of each turn against those of the next."""
    words = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{2,}"), F.lit(0))), lambda w: F.lower(w))
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("gold")).withColumn("found", F.lead("gold").over(Window.partitionBy("conv_id").orderBy("turn"))).where("found IS NOT NULL")
    return rows.select("conv_id", "turn", F.size("gold").alias("n_gold"), F.size("found").alias("n_found"), F.size(D.match_one_to_one(F.col("gold"), F.col("found"))).alias("tp"))


@query()
def clean_semantic(spark, sf_dir):
    return _map(spark, sf_dir, C.semantic_clean)


@query("""SELECT conv_id, string_agg('=== ' || role || ' ===' || chr(10) || chr(10) || trim(text, ' '), chr(10) || chr(10) || repeat('=', 60) || chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text, ' ') <> '' GROUP BY conv_id""")
def export_summaries(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("topic_hint"), F.col("text").alias("summary"))
    return K.joined_summaries(rows, "conv_id", "turn").select("conv_id", "text")


@query()
def pack_lines(spark, sf_dir):
    return L.pack_lines(_t(spark, sf_dir, "documents"))


_DRAW = "CAST('0x' || substr(md5(doc_id || '|{}'), 1, 8) AS BIGINT)"
_PASSAGES = f"""WITH n AS (SELECT doc_id, text, length(text) AS n, CAST(floor(length(text) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS lo, CAST(floor(length(text) * CAST(0.8 AS DOUBLE)) AS BIGINT) - 1200 AS hi FROM documents WHERE length(text) >= 600),
s AS (SELECT doc_id, text, CASE WHEN lo >= hi THEN greatest(0, n // 2 - 600) ELSE lo + {_DRAW.format('p1')} % (hi - lo + 1) END AS start FROM n), c AS (SELECT doc_id, start, substr(text, start + 1, 1200) AS cut FROM s)
SELECT doc_id, start, CASE WHEN regexp_matches(cut, '(?s) .* ') THEN regexp_replace(regexp_extract(cut, '(?s)^[^ ]* (.*) [^ ]*$', 1), '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') ELSE cut END AS passage FROM c"""


@query(_PASSAGES)
def sample_passages(spark, sf_dir):
    return L.sample_passages(_t(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_DRAW.format('r1')}, doc_id) AS n FROM documents) WHERE n <= 10")
def sample_rows(spark, sf_dir):
    """Ten documents of each source (a sampling operator)."""
    return L.sample_rows(_t(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 10)


@query("""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(trim(regexp_replace(replace(n, '_', ' '), '\\.txt|\\.json', '', 'g'), ' '), '\\pL+|[^\\pL]+'), lambda r: upper(r[1:1]) || lower(r[2:])), '') AS name,
regexp_replace(source || ':' || lang || '.v1', '[^\\pL\\pN\\pM_\\-]', '_', 'g') AS file FROM (SELECT *, regexp_replace(md5(CAST(doc_id AS VARCHAR)) || '_' || source || '_l''' || lang || '.json', '^[0-9a-f]{6,}_', '') AS n FROM documents)""")
def book_names(spark, sf_dir):
    file = F.concat(F.md5(F.col("doc_id").cast("string")), F.lit("_"), "source", F.lit("_l'"), "lang", F.lit(".json"))
    return _t(spark, sf_dir, "documents").select("doc_id", G.book_name(file).alias("name"), G.file_safe(F.concat("source", F.lit(":"), "lang", F.lit(".v1"))).alias("file"))


@query("SELECT conv_id, turn, CASE WHEN i = 1 THEN 'INIZIALE' WHEN i = n THEN 'FINALE' ELSE 'CENTRALE' END AS position FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def part_positions(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", G.position(F.row_number().over(w.orderBy("turn")), F.count(F.lit(1)).over(w)).alias("position"))


@query("""SELECT source, n + m + CASE WHEN m > 4 THEN CAST(ceil(m / 4) AS BIGINT) ELSE 1 END AS steps, greatest(chars // 3, 5000) AS target FROM (SELECT source, n, chars, CASE WHEN n > 10 THEN CAST(ceil(n / 10) AS BIGINT) ELSE 0 END AS m
FROM (SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source))""")
def summary_plan(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return rows.select("source", G.summary_steps(F.col("n")).alias("steps"), G.target_chars(F.col("chars"), 3, 5000).alias("target"))


@query("SELECT event_id, regexp_extract('reply: ' || props || ' done.', '(?s)[\\[{].*[\\]}]') AS json, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def embedded_json(spark, sf_dir):
    found = G.embedded_json(F.concat(F.lit("reply: "), "props", F.lit(" done.")))
    return _t(spark, sf_dir, "events").select("event_id", found.alias("json")).withColumn("k", F.get_json_object("json", "$.k").cast("long"))


@query(f"WITH {_ENT} SELECT DISTINCT doc_id, lower(word) AS word, label FROM n")
def wordpieces_join(spark, sf_dir):
    """Each capitalised word as pieces of two letters, joined again."""
    words = E.extract(_t(spark, sf_dir, "documents")).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("word"), F.lit(2))))
    pieces = words.select("doc_id", "label", F.struct("pos", "at").alias("place"), F.concat(F.when(F.col("at") > 1, "##").otherwise(""), F.substring("word", F.col("at"), F.lit(2))).alias("word"))
    return E.join_wordpieces(pieces, "doc_id", "place")


@query()
def export_archives(spark, sf_dir):
    """A ZIP archive for each document: its text, its cleaned text, and what is known of it."""
    rows = _t(spark, sf_dir, "documents").select("doc_id", G.file_safe(F.concat(F.lit("doc "), "doc_id")).alias("root"), "text", C.strip_symbols(F.col("text")).alias("clean"), F.struct("doc_id", "lang", "source", "n_chars").alias("about"))
    entries = A.book_entries(rows, "doc_id", "root", **{"00_originale/originale.txt": "text", "01_testo_pulito/testo_pulito.txt": "clean", "about.json": "about"})
    return A.zip_books(entries, "doc_id")
