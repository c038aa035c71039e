"""Registered queries over chunks by section: paragraphs with offsets, divided texts, base chunks, sections and chapters, each with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase

from pyspark.sql import functions as F

from ..operators import builders as B
from ..operators import chunks as H
from ..operators import embedding as M
from ..operators import entities as E
from ..operators import splitting as P
from ..operators.textrows import text_rows
from .queries import _SPANS, _t
from .registry import query

#: Cosine of two paragraphs' letter counts below which a section begins.
ALIKE = 0.97


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_PARAGRAPHS = rf"""
ps AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: s <> '') AS ss FROM documents),
pt AS (SELECT doc_id, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM ps),
pc AS (SELECT doc_id, i, s, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto, max(i) OVER (PARTITION BY doc_id) AS last FROM pt),
pn AS (SELECT a.doc_id, a.i, coalesce(b.i, a.last) AS stop FROM pc a ASOF LEFT JOIN pc b ON a.doc_id = b.doc_id AND a.upto - length(a.s) - 1 + 501 <= b.upto),
pr AS (SELECT doc_id, i, stop, 0 AS idx FROM pn WHERE i = 0 UNION ALL SELECT n.doc_id, n.i, n.stop, r.idx + 1 FROM pr r JOIN pn n ON n.doc_id = r.doc_id AND n.i = r.stop + 1),
pp AS (SELECT r.doc_id, r.idx, string_agg(t.s, ' ' ORDER BY t.i) AS p FROM pr r JOIN pt t ON t.doc_id = r.doc_id AND t.i BETWEEN r.i AND r.stop GROUP BY r.doc_id, r.idx),
pa AS (SELECT p.doc_id, p.idx, p.p, greatest(strpos(d.text, left(p.p, 50)) - 1, 0) AS a FROM pp p JOIN documents d USING (doc_id) WHERE p.idx = 0
  UNION ALL SELECT p.doc_id, p.idx, p.p, x.a + length(x.p) + greatest(strpos(substr(d.text, x.a + length(x.p) + 1), left(p.p, 50)) - 1, 0) FROM pa x JOIN pp p ON p.doc_id = x.doc_id AND p.idx = x.idx + 1 JOIN documents d ON d.doc_id = x.doc_id),
para AS (SELECT doc_id, idx, p AS text, CAST(a AS INT) AS char_start, CAST(a + length(p) AS INT) AS char_end FROM pa)"""


@query(f"WITH RECURSIVE {_PARAGRAPHS} SELECT doc_id, CAST(idx AS INT) AS idx, text, char_start, char_end FROM para")
def pseudo_paragraphs(spark, sf_dir):
    return H.pseudo_paragraphs(_t(spark, sf_dir, "documents"))


def _pieces(name: str, source: str, keys: str, entities: bool, most: int = 2000, overlap: int = 300) -> str:
    """CTEs that end in name: keys, part, text, s, e of the pieces of source's texts (keys, text and, if asked for, ents: list of structs start, key)."""
    low = f"(start + {most // 3})"
    wide, signs = f"substr(text, {low} + 1, {most - most // 3})", f"substr(text, {low} + 2, {most - most // 3})"
    blank, space = (f"strpos(reverse({wide}), {x})" for x in ("chr(10) || chr(10)", "' '"))
    stop = f"length(regexp_extract(reverse({signs}), '^[^.!?]*[.!?]'))"
    shift = "NULL"
    if entities:
        mid = f"(start + {most} - 150)"
        near, back = f"substr(text, {low} + 1, {mid} + 300 - {low})", f"substr(text, {low} + 2, {mid} - {low})"
        before, after = (f"list_distinct(list_transform(list_filter(ents, lambda x: x.start >= {a} AND x.start < {b}), lambda x: x.key))" for a, b in ((low, mid), (mid, f"start + {most}")))
        nn, ss = f"strpos(reverse({near}), chr(10) || chr(10))", f"length(regexp_extract(reverse({back}), '^[^.!?]*[.!?]'))"
        shift = (
            f"CASE WHEN len({before}) > 0 AND len({after}) > 0 AND len(list_intersect({before}, {after})) / len(list_distinct(list_concat({before}, {after}))) < 0.4 "
            f"THEN CASE WHEN {nn} > 0 THEN {low} + length({near}) - {nn} + 1 WHEN {ss} > 0 THEN {low} + 2 + length({back}) - {ss} END END"
        )
    cut = (
        f"CASE WHEN length(text) - start <= {most} THEN NULL ELSE coalesce({shift}, CASE WHEN {blank} > 0 THEN {low} + length({wide}) - {blank} + 1 END, CASE WHEN {stop} > 0 THEN {low} + 2 + length({signs}) - {stop} END, "
        f"CASE WHEN {space} > 0 THEN {low} + length({wide}) - {space} + 1 END, start + {most}) END"
    )
    ents = ", ents" if entities else ""
    go_on = f"greatest(start, cut - {overlap})"
    sign = f"length(regexp_extract(substr(text, {go_on} + 1, cut - {go_on}), '^[^.!?\\n]*[.!?\\n]'))"
    step = f"SELECT *, least({go_on} + {sign}, cut) AS nxt FROM (SELECT *, {cut} AS cut FROM %s)"
    return f"""{name}_r AS (SELECT {keys}, text{ents}, 0 AS start FROM {source} WHERE length(text) > 0 UNION ALL SELECT {keys}, text{ents}, nxt FROM ({step % f'{name}_r'}) WHERE nxt IS NOT NULL AND nxt < length(text)),
{name} AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY s) - 1 AS part, text, s, e FROM (SELECT {keys}, piece AS text, start AS s, CASE WHEN cut IS NULL THEN start + length(piece) ELSE cut END AS e
  FROM (SELECT *, {_strip('CASE WHEN cut IS NULL THEN substr(text, start + 1) ELSE substr(text, start + 1, cut - start) END')} AS piece FROM (SELECT *, {cut} AS cut FROM {name}_r))) WHERE text <> '')"""


@query(f"WITH RECURSIVE {_pieces('p', 'documents', 'doc_id', False)} SELECT doc_id, CAST(part AS INT) AS idx, text, CAST(s AS INT) AS char_start, CAST(e AS INT) AS char_end FROM p")
def size_split(spark, sf_dir):
    return P.size_split(_t(spark, sf_dir, "documents"))


_MARKS = f"{_SPANS}, ek AS (SELECT *, label || ':' || lower(word) AS key FROM n), em AS (SELECT doc_id, list({{'start': start, 'key': key}} ORDER BY start) AS ents FROM ek GROUP BY doc_id)"
_BASE = f"""{_MARKS}, bs AS (SELECT doc_id, text, coalesce(ents, []) AS ents FROM documents LEFT JOIN em USING (doc_id)),
{_pieces('b', 'bs', 'doc_id', True)},
bh AS (SELECT b.doc_id, b.part, list({{'start': start, 'stop': stop, 'key': key}} ORDER BY start, stop) AS held FROM b JOIN ek ON ek.doc_id = b.doc_id AND start >= s AND stop <= e GROUP BY b.doc_id, b.part),
base AS (SELECT b.doc_id, CAST(b.part + 1 AS INT) AS chunk_id, text, s, e, coalesce(held, []) AS held, list_sort(list_distinct(list_transform(coalesce(held, []), lambda x: x.key))) AS keys FROM b LEFT JOIN bh USING (doc_id, part))"""


@query(f"WITH RECURSIVE {_BASE} SELECT doc_id, chunk_id, text, CAST(s AS INT) AS char_start, CAST(e AS INT) AS char_end, 'Chunk NER ' || chunk_id AS topic_hint, len(held) AS num_entities, array_to_string(keys, ',') AS keys, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM base")
def base_chunks(spark, sf_dir):
    """Texts divided at shifts of entities, with the entities that each chunk holds."""
    rows = B.base_chunks(E.with_spans(_t(spark, sf_dir, "documents")))
    return rows.select("doc_id", "chunk_id", "text", "char_start", "char_end", "topic_hint", "num_entities", F.array_join("keys", ",").alias("keys"), "total_chunks")


def _profiled(text: str | None) -> Iterator[tuple]:
    """Paragraphs with a profile: how often each letter from a to z occurs in them."""
    for paragraph in P.paragraphs(text):
        yield *paragraph, list(map(paragraph[0].lower().count, ascii_lowercase))


def _cut_paragraphs(docs):
    """Paragraphs without their text, with cut: whether a section begins there, as their letters differ or they hold a heading. Their text is read once, where it is."""
    rows = text_rows(docs, ["doc_id"], ["text"], _profiled, {**P.PIECE, "letters": "array<int>"})
    rows = rows.select("doc_id", "idx", "char_start", "char_end", F.col("letters").cast("array<float>").alias("embedding"), H.is_heading(F.col("text")).alias("headed"))
    return H.embedding_boundaries(rows, ["doc_id"], "idx", ALIKE).select("doc_id", "idx", "char_start", "char_end", (F.col("boundary") | F.col("headed")).alias("cut"))


_LETTERS = f"[{', '.join(f'''CAST(length(t) - length(replace(t, '{c}', '')) AS DOUBLE)''' for c in map(chr, range(97, 123)))}]"
_CUTS = rf"""lv AS (SELECT doc_id, idx, text, {_LETTERS} AS v FROM (SELECT doc_id, idx, text, lower(text) AS t FROM para)),
lb AS (SELECT doc_id, idx FROM (SELECT doc_id, idx, count(*) OVER (PARTITION BY doc_id) AS n, v, lag(v) OVER (PARTITION BY doc_id ORDER BY idx) AS u FROM lv) WHERE n >= 3 AND u IS NOT NULL AND list_dot_product(u, u) > 0 AND list_dot_product(v, v) > 0 AND list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))) < {ALIKE}
  UNION SELECT doc_id, idx FROM lv WHERE regexp_matches(text, '(?i)\b(CAPITOLO|CAPO|CAP\.|LIBRO|PARTE)\s+([IVXLCDM]+|\d+)\b')),"""
_SECTIONS = rf"""{_PARAGRAPHS}, {_CUTS}
sx AS (SELECT p.doc_id, p.idx, char_start, char_end, 1 + sum(CASE WHEN p.idx > 0 AND b.idx IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.idx) AS section FROM para p LEFT JOIN lb b ON b.doc_id = p.doc_id AND b.idx = p.idx),
sy AS (SELECT doc_id, section, arg_min(char_start, idx) AS a, arg_max(char_end, idx) AS z FROM sx GROUP BY doc_id, section),
sz AS (SELECT y.doc_id, section, a, z + CASE WHEN section = max(section) OVER (PARTITION BY y.doc_id) OR regexp_matches(substr(d.text, z, 1), '[.!?"''»\n]') THEN 0 ELSE length(regexp_extract(substr(d.text, z + 1, 300), '^[^.!?]*[.!?]')) END AS z, d.text AS book FROM sy y JOIN documents d USING (doc_id)),
st AS (SELECT doc_id, section, a, z, substr(book, a + 1, z - a) AS text FROM sz),
{_MARKS},
sl AS (SELECT doc_id, section, text, coalesce((SELECT list({{'start': start, 'key': key}} ORDER BY start) FROM ek WHERE ek.doc_id = st.doc_id AND start >= a AND stop <= z), []) AS ents FROM st WHERE length(text) > 2000),
{_pieces('sp', 'sl', 'doc_id, section', True)},
sc AS (SELECT doc_id, section, 0 AS part, '' AS said, text, a, z FROM st WHERE length(text) <= 2000 UNION ALL SELECT p.doc_id, p.section, part, ' (parte)', p.text, st.a + s, st.a + e FROM sp p JOIN st ON st.doc_id = p.doc_id AND st.section = p.section),
sh AS (SELECT c.doc_id, c.section, c.part, count(*) AS n, string_agg(word, ',' ORDER BY start, stop) AS words FROM sc c JOIN ek ON ek.doc_id = c.doc_id AND start >= a AND stop <= z GROUP BY c.doc_id, c.section, c.part)"""


@query(f"""WITH RECURSIVE {_SECTIONS} SELECT c.doc_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY c.section, c.part) AS INT) AS chunk_id, text, CAST(a AS INT) AS char_start, CAST(z AS INT) AS char_end, 'Capitolo Semantico ' || c.section || said AS topic_hint,
coalesce(words, '') AS entities, coalesce(n, 0) AS num_entities, count(*) OVER (PARTITION BY c.doc_id) AS total_chunks FROM sc c LEFT JOIN sh h ON h.doc_id = c.doc_id AND h.section = c.section AND h.part = c.part""")
def section_chunks(spark, sf_dir):
    """Sections of a text between boundaries of its paragraphs, the long ones divided, with the entities of each chunk."""
    docs = _t(spark, sf_dir, "documents")
    rows = B.section_chunks(E.with_spans(docs), _cut_paragraphs(docs))
    return rows.select("doc_id", "chunk_id", "text", "char_start", "char_end", "topic_hint", F.array_join(F.transform("entities", lambda e: e["word"]), ",").alias("entities"), "num_entities", "total_chunks")


_NER = rf"""{_BASE},
nk AS (SELECT doc_id, chunk_id, unnest(keys) AS key FROM base),
nb AS (SELECT b.doc_id, b.chunk_id, b.chunk_id > 1 AND count(DISTINCT p.key) FILTER (WHERE list_contains(b.keys, p.key)) < 1 AS cut FROM base b LEFT JOIN nk p ON p.doc_id = b.doc_id AND p.chunk_id BETWEEN b.chunk_id - 4 AND b.chunk_id - 1 GROUP BY b.doc_id, b.chunk_id),
nx AS (SELECT base.*, 1 + sum(CAST(cut AS INT)) OVER (PARTITION BY base.doc_id ORDER BY base.chunk_id) AS section FROM base JOIN nb USING (doc_id, chunk_id)),
nf AS (SELECT doc_id, section, arg_min({{'start': h.start, 'stop': h.stop}}, {{'c': chunk_id, 's': h.start, 'e': h.stop}}) AS f, h.key AS key FROM (SELECT doc_id, section, chunk_id, unnest(held) AS h FROM nx) GROUP BY doc_id, section, h.key),
ns AS (SELECT doc_id, section, string_agg(text, ' ' ORDER BY chunk_id) AS text, arg_min(s, chunk_id) AS a, arg_max(e, chunk_id) AS z FROM nx GROUP BY doc_id, section),
nl AS (SELECT doc_id, section, text FROM ns WHERE length(text) > 2000),
{_pieces('np', 'nl', 'doc_id, section', False)},
na AS (SELECT p.doc_id, p.section, p.part, p.text, ns.a + greatest(strpos(substr(d.text, CAST(ns.a + 1 AS BIGINT)), left(p.text, 50)) - 1, 0) AS spot FROM np p JOIN ns ON ns.doc_id = p.doc_id AND ns.section = p.section JOIN documents d ON d.doc_id = p.doc_id WHERE p.part = 0
  UNION ALL SELECT doc_id, section, part, text, cursor + greatest(strpos(substr(book, CAST(cursor + 1 AS BIGINT)), left(text, 50)) - 1, 0) FROM (
    SELECT p.doc_id, p.section, p.part, p.text, d.text AS book, greatest(x.spot, x.spot + length(x.text) - 400) AS cursor FROM na x JOIN np p ON p.doc_id = x.doc_id AND p.section = x.section AND p.part = x.part + 1 JOIN documents d ON d.doc_id = x.doc_id)),
nc AS (SELECT doc_id, section, 0 AS part, '' AS said, text, a, z, 0 AS divided FROM ns WHERE length(text) <= 2000 UNION ALL SELECT doc_id, section, part, ' (parte)', text, spot, spot + length(text), 1 FROM na),
nh AS (SELECT c.doc_id, c.section, c.part, key FROM nc c JOIN nf ON nf.doc_id = c.doc_id AND nf.section = c.section AND (divided = 0 OR (f.start >= a AND f.stop <= z))),
ne AS (SELECT doc_id, section, part, count(*) AS n FROM nh GROUP BY doc_id, section, part),
no AS (SELECT s.doc_id, s.section, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.section) AS nth, coalesce(keys, []) AS keys FROM (SELECT DISTINCT doc_id, section FROM nc) s LEFT JOIN (SELECT doc_id, section, list(DISTINCT key) AS keys FROM nh GROUP BY doc_id, section) k ON k.doc_id = s.doc_id AND k.section = s.section),
nu AS (SELECT doc_id, nth, unnest(keys) AS key FROM no),
nv AS (SELECT o.doc_id, o.section, o.nth, o.nth > 1 AND count(DISTINCT u.key) FILTER (WHERE list_contains(o.keys, u.key)) < 2 AS cut FROM no o LEFT JOIN nu u ON u.doc_id = o.doc_id AND u.nth BETWEEN o.nth - 3 AND o.nth - 1 GROUP BY o.doc_id, o.section, o.nth),
nw AS (SELECT doc_id, section, 1 + sum(CAST(cut AS INT)) OVER (PARTITION BY doc_id ORDER BY nth) AS chapter_id FROM nv),
ny AS (SELECT c.doc_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY c.section, c.part) AS INT) AS chunk_id, c.section, c.text, CAST(a AS INT) AS char_start, CAST(z AS INT) AS char_end, 'Sezione NER ' || c.section || said AS topic_hint, coalesce(n, 0) AS num_entities,
  count(*) OVER (PARTITION BY c.doc_id) AS total_chunks, CAST(chapter_id AS BIGINT) AS chapter_id, 'Capitolo NER ' || chapter_id AS chapter_hint FROM nc c JOIN nw w ON w.doc_id = c.doc_id AND w.section = c.section LEFT JOIN ne ON ne.doc_id = c.doc_id AND ne.section = c.section AND ne.part = c.part)"""


def _ner_chunks(spark, sf_dir):
    return B.ner_section_chunks(E.with_spans(_t(spark, sf_dir, "documents")))


@query(f"WITH RECURSIVE {_NER} SELECT doc_id, chunk_id, text, char_start, char_end, topic_hint, num_entities, total_chunks, chapter_id, chapter_hint FROM ny")
def ner_section_chunks(spark, sf_dir):
    """Chunks joined to sections while their names recur, long sections divided again and found again in the text, under chapters."""
    return _ner_chunks(spark, sf_dir).drop("section", "entities")


@query(f"""WITH RECURSIVE {_NER} SELECT doc_id, chapter_id, chapter_hint, string_agg(DISTINCT section, ',' ORDER BY section) AS section_ids, count(DISTINCT section) AS num_sections, min(char_start) AS char_start, max(char_end) AS char_end FROM ny GROUP BY doc_id, chapter_id, chapter_hint""")
def ner_section_chapters(spark, sf_dir):
    rows = B.chapter_metadata(_ner_chunks(spark, sf_dir))
    return rows.withColumn("section_ids", F.array_join(F.transform("section_ids", lambda x: x.cast("string")), ","))


@query()
def paragraph_sections(spark, sf_dir):
    """Sections of each text: a new one begins with a paragraph whose embedding is unlike the one before (in made-up prose few are below the usual 0.35)."""
    rows = M.with_embeddings(H.pseudo_paragraphs(_t(spark, sf_dir, "documents")))
    return H.embedding_boundaries(rows, ["doc_id"], "idx", 0.8).select("doc_id", "idx", F.round("sim", 4).alias("sim"), "boundary", "section")
