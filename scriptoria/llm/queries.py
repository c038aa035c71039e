"""The subpackage's registered queries, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, class_lm, collocations, decontaminate, exact_dedup, media, mixing, quality_knn, secret_scan, simhash_dedup, spelling, token_files, url_filter
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') t(conv_id, turn, role, text)")
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.read_back(chat_format.format_conversations(convs))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_knn.score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.text_media(table(spark, sf_dir, "documents")))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_documents(token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path()))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents")).drop("row")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_secret_scans, op3_simhash_near_dedup, op4_benchmark_decontamination, op5_mixing, op6_quality_classifier, op7_lm_scoring, op8_media_columns, op9_url_filters, op10_token_ids, op11_collocations, op12_spelling_variants, op13_exact_dedup)
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _secrets_sql() -> str:
    spans = []
    for i, r in enumerate(secret_scan.RULES):
        regex = r.regex.replace("'", "''")
        length = f"length(regexp_extract(hit, '{regex}', {r.group}))" if r.group else "length(hit)"
        spans.append(
            f"SELECT row_id, {i} AS nth, '{r.kind}' AS kind, start, start + length(hit) AS stop FROM ("
            f"SELECT row_id, hit, CAST(sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (PARTITION BY row_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ("
            f"SELECT row_id, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS n FROM ("
            f"SELECT row_id, regexp_extract_all(text, '{regex}') AS hits, string_split_regex(text, '{regex}') AS gaps FROM d)) "
            f"WINDOW w AS (PARTITION BY row_id ORDER BY n)) WHERE {length} >= {r.min_chars}"
        )
    base = len(secret_scan.BASE)
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)
    named = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE)
    return (
        "WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents), "
        f"s AS ({' UNION ALL '.join(spans)}), "
        f"g AS (SELECT row_id, {counts}, {listed} FILTER (WHERE nth < {base}) AS base, {listed} AS spans FROM s GROUP BY row_id) "
        f"SELECT doc_id, {named}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row_id)"
    )


def _shingles_sql(key: str, source: str) -> str:
    return (
        f"SELECT DISTINCT {key}, CASE WHEN len(w) <= 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM ("
        f"SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM ("
        f"SELECT {key}, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM {source}) WHERE len(w) > 0)"
    )


_CONTAINED = (
    f"WITH i AS ({_shingles_sql('item_id', 'benchmark')}), d AS ({_shingles_sql('doc_id', 'documents')}), n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id) "
    "SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared, count(*) / n AS containment FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= ceil(0.8 * n - 1e-9)"
)
_MIX = """
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix-1') AS k, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, source_size * 3 / w AS ratio FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS nth,
  (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM o),
t AS (SELECT source, source_size, least(CAST(source_size * 3 AS DOUBLE), w * (SELECT arg_min(lev, nth) FROM l WHERE lev * w <= source_size * 3)) AS target FROM l),
p AS (SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS budget, CAST(round(target) AS BIGINT) // greatest(source_size, 1) AS epochs,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)) AS BIGINT) AS taken FROM p
"""
_CHAT = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role || chr(0) || text, '\\\\|</?s>|\\[/?INST\\]|\\[/?SAY\\]')) + CASE WHEN role = 'assistant' THEN 18 ELSE 20 END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""

_EXACT = f"""
WITH d AS (SELECT doc_id, {_LOWER.replace('text', "coalesce(text, '')")} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256 FROM d WINDOW w AS (PARTITION BY norm)
"""

_PHRASES = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.replace('text', "coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM w) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
b AS (SELECT lang, phrase, max(a) AS within FROM (SELECT lang, a, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase FROM f WHERE k > 2) GROUP BY lang, phrase),
c AS (SELECT f.lang, f.phrase, f.a, f.w, f.k, unnest(range(1, f.k)) AS i FROM f LEFT JOIN b USING (lang, phrase) WHERE f.k > 1 AND (within IS NULL OR 100 * within < 80 * f.a)),
s AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, c.i, CAST(2000000::HUGEINT * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM c JOIN f x ON c.lang = x.lang AND array_to_string(c.w[1:c.i], ' ') = x.phrase JOIN f y ON c.lang = y.lang AND array_to_string(c.w[c.i + 1:c.k], ' ') = y.phrase),
m AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM m JOIN t USING (lang) QUALIFY rank <= 2000
"""


def _crc_entry(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


_BYTES = "flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))"
_CRC = f"xor(list_reduce([4294967295::BIGINT] || {_BYTES}, lambda a, b: xor(a >> 8, [{', '.join(str(_crc_entry(i)) + '::BIGINT' * (i == 0) for i in range(256))}][(xor(a, b) & 255) + 1])), 4294967295)"
_SPELLING = f"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.replace('text', "coalesce(text, '')")}, '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
c AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, run, count(*) AS n FROM d WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, {_CRC} AS h FROM c),
e AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
k AS (SELECT word, n, i, left(word, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.rest = w.word UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.rest = w.word),
b AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
f AS (SELECT word, min(other) AS form FROM p JOIN b USING (word) WHERE p.m = b.m GROUP BY word),
v AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN form END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM w LEFT JOIN b USING (word) LEFT JOIN f USING (word)),
r AS (SELECT word, word AS root FROM v UNION ALL SELECT r.word, v.form FROM r JOIN v ON r.root = v.word WHERE v.form IS NOT NULL)
SELECT word, form, r.root, n, n_near, form_n FROM v JOIN r USING (word) JOIN (SELECT word AS root FROM v WHERE form IS NULL) l ON r.root = l.root
"""


#: Levels of the tree that the SQL unrolls; no path of the tables is deeper.
_URL_LEVELS = 8


def _urls_sql() -> str:
    u = url_filter

    def fitting(said: str) -> str:
        rules = sorted(u.RULES, key=lambda r: -len(r.name))
        return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, said)}'" for r in rules) + " END"

    counted = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("n", "labelled", "blocked"))
    steps = [
        "r AS (SELECT page_id, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages)",
        f"p AS (SELECT page_id, {_LOWER.replace('text', 'h')} AS host, path, list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM r)",
        f"v AS (SELECT page_id, host, path, {fitting('name')} AS rule, {fitting('verdict')} AS ruled, "
        f"list_transform(parts, lambda s: CASE WHEN regexp_matches(s, '{u.VARIABLE}') THEN '*' ELSE s END) AS shape FROM p)",
        "t0 AS (SELECT host, shape, shape AS template, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (WHERE ruled = 'block') AS blocked FROM v GROUP BY host, shape)",
    ]
    for d in range(_URL_LEVELS):
        steps += [
            f"n{d} AS (SELECT host, array_to_string(template[1:{d}], '/') AS parent, template[{d + 1}] AS child, sum(n) AS n FROM t{d} WHERE len(template) > {d} GROUP BY ALL)",
            f"w{d} AS (SELECT host, parent FROM n{d} GROUP BY host, parent HAVING count(*) >= {u.MANY} AND sum(n) < {u.RARE} * count(*))",
            f"t{d + 1} AS (SELECT t.host, shape, CASE WHEN w.parent IS NOT NULL AND len(template) > {d} THEN template[1:{d}] || ['*'] || template[{d + 2}:] ELSE template END AS template, n, labelled, blocked "
            f"FROM t{d} t LEFT JOIN w{d} w ON t.host = w.host AND array_to_string(template[1:{d}], '/') = w.parent)",
        ]
    steps += [
        f"f AS (SELECT host, shape, n, labelled, blocked, '/' || array_to_string(template, '/') AS template, array_to_string(list_transform(template, lambda s: CASE WHEN s = '*' THEN s ELSE '+' END), '/') AS form FROM t{_URL_LEVELS})",
        f"k AS (SELECT host, form, template, {counted} FROM f GROUP BY host, form, template)",
        "a AS (SELECT host, form, (CAST(sum(blocked) AS BIGINT) + 1) / (CAST(sum(labelled) AS BIGINT) + 2) AS share FROM k GROUP BY host, form)",
        f"b AS (SELECT host, template, n, labelled, blocked, CASE WHEN labelled = 0 OR abs(blocked - labelled * share) > {u.APART} * sqrt(labelled * share * (1 - share)) THEN template ELSE form END AS branch FROM k JOIN a USING (host, form))",
        "g AS (SELECT (CAST(sum(blocked) AS BIGINT) + 1) / (CAST(sum(labelled) AS BIGINT) + 2) AS rate FROM b)",
        f"m AS (SELECT host, branch, {counted} FROM b GROUP BY host, branch)",
        f"s AS (SELECT host, branch, CAST({u.SMOOTH} AS DOUBLE) + CAST({u.HALF} AS DOUBLE) * (n - labelled) AS weight, labelled, blocked FROM m)",
        "q AS (SELECT host, branch, (blocked + weight * rate) / (labelled + weight) AS purity FROM s, g)",
    ]
    return (
        f"WITH {', '.join(steps)} SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {u.REJECT} AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict, template, purity "
        "FROM v JOIN f USING (host, shape) JOIN b USING (host, template) JOIN q USING (host, branch)"
    )


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _CHAT, "op2_secret_scans": _secrets_sql(), "op4_benchmark_decontamination": _CONTAINED, "op5_mixing": _MIX, "op9_url_filters": _urls_sql(), "op11_collocations": _PHRASES, "op12_spelling_variants": _SPELLING, "op13_exact_dedup": _EXACT}
