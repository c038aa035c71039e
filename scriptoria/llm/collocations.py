"""Phrase collocations: frequent phrases of two to four words, ranked by how seldom their parts occur apart.

Each task turns the texts that it reads into generalised suffix automata over words, one for each language and SHARD_BYTES of text, as
far as phrases of DEPTH words go. Their states are built level by level from arrays: a phrase is reached from the phrase without its last
word (a transition), its suffix link leads to the phrase without its first word, and endpos counts say how often it ends somewhere. Counts of a shard
are summed globally; phrases of three and more words leave a shard only if each two neighbours are a frequent pair. The frequent pairs, counted first, are
told by a bitmap: what it lets through wrongly is counted and dropped, nothing frequent is lost.

Of the frequent phrases, each gives its count to what it ends and begins with, its suffix link and its prefix; the largest such count
subsumes a phrase that seldom occurs outside. Parts meet their counts in a join; the parts that make up a thousandth of all words, few by
that bound, are broadcast, so that no key of the join is hot. The first of each language are taken in two steps, by salts and then over them.

Defined cases: null text has no words, a null language is und; texts without words, and pieces of one, count in n alone; very long texts are cut into
parts that share what phrases need; repeated rows count again; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

DEPTH, LEAST, TOP, SCALE = 4, 30, 2000, 2_000_000
#: Bytes of text of a shard; parts of a text that are longer are cut.
SHARD_BYTES = 2_000_000
#: A part is hot, and broadcast, if it makes up one of so many equal shares of all words; salts of the ranking; bits for each pair of the bitmap, and most bits.
SHARES, SALTS, PAIR_BITS, MOST_BITS = 1000, 16, 16, 1 << 29

#: What ends a piece becomes a byte that UTF-8 does not have; A-Z become lower case, tabs spaces.
_TABLE = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Tokens:
    """Words of some texts: their codes, whether each follows the one before within a piece, and how many of them to count."""

    def __init__(self, texts: list[tuple[bytes, int]]):
        """texts: (text, as _TABLE turns it; words at its beginning that only give context)."""
        data = np.frombuffer(b"\xff".join(t for t, _ in texts) + b"\xff", dtype=np.uint8)
        inside = (data != 32) & (data != 0xFF)
        edge = np.diff(inside.astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.cumsum(data == 0xFF, dtype=np.int32)[starts]
        self.joined = np.concatenate([[False], piece[1:] == piece[:-1]]) if len(piece) else np.zeros(0, dtype=bool)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        self.words, self.codes = words.dictionary, words.indices.to_numpy()
        self.fresh = np.ones(len(starts), dtype=bool)
        if any(n for _, n in texts):
            begins = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t, _ in texts])[:-1])
            for at, (_, n) in zip(begins.tolist(), texts, strict=True):
                self.fresh[at : at + n] = False


class Level:
    """The states that phrases of one length reach: of each, the state of the phrase without its last word, that word, its suffix link and its count."""

    def __init__(self, prefix: np.ndarray, word: np.ndarray, link: np.ndarray, count: np.ndarray):
        self.prefix, self.word, self.link, self.count = prefix, word, link, count


class Automaton:
    """A generalised suffix automaton down to a depth, unmerged: a state for each distinct phrase, by level. keep says which pairs (as codes) lead further."""

    def __init__(self, tokens: Tokens, depth: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        codes = tokens.codes.astype(np.int64)
        self.tokens = tokens
        self.levels = [Level(np.zeros(0, np.int64), np.arange(len(tokens.words)), np.zeros(0, np.int64), np.bincount(codes[tokens.fresh], minlength=len(tokens.words)))]
        state = codes  # of the phrase that ends at each place; -1: none that leads further
        for k in range(2, depth + 1):
            here = np.flatnonzero(tokens.joined & (np.concatenate([[-1], state])[:-1] >= 0) & (state >= 0))
            before, own = state[here - 1], state[here]
            found = pa.array(before * len(tokens.words) + codes[here]).dictionary_encode()
            ids = found.indices.to_numpy()
            first = np.empty(len(found.dictionary), dtype=np.int64)
            first[ids[::-1]] = np.arange(len(ids))[::-1]
            level = Level(before[first], codes[here][first], own[first], np.bincount(ids[tokens.fresh[here]], minlength=len(first)))
            self.levels.append(level)
            state = np.full(len(codes), -1, dtype=np.int64)
            state[here] = np.where(keep(level.prefix, level.word)[ids], ids, -1) if k == 2 and keep is not None else ids

    def phrases(self, k: int) -> tuple[pa.Array, np.ndarray]:
        """The phrases of k words, and their counts; those that only give context are left out."""
        level = self.levels[k - 1]
        some = np.flatnonzero(level.count)
        columns, at = [], some
        for depth in range(k - 1, -1, -1):
            columns.insert(0, self.tokens.words.take(pa.array(self.levels[depth].word[at])))
            if depth:
                at = self.levels[depth].prefix[at]
        text = columns[0] if k == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary()))
        return text.cast(pa.string()), level.count[some]


def pieces(text: bytes, size: int = SHARD_BYTES, depth: int = DEPTH) -> Iterator[tuple[bytes, int]]:
    """A text, as _TABLE turns it, in parts that grow by about size bytes, each with the number of words at its beginning that it repeats for the phrases across."""
    at = end = context = 0
    while len(text) - end > size:
        found = max(text.rfind(c, end + 1, end + size) for c in (b" ", b"\xff"))
        if found < 0:
            found = min((x for c in (b" ", b"\xff") if (x := text.find(c, end + size)) >= 0), default=-1)
        if found < 0:
            break
        end = found
        yield text[at:end], context
        begin, at, context = at, end, 0
        while context < depth - 1 and text[end] == 32 and (last := len(text[begin:at].rstrip(b" "))) and text[begin + last - 1] != 0xFF:
            at = max(begin, *(text.rfind(c, begin, begin + last) + 1 for c in (b" ", b"\xff")))
            context += 1
    yield text[at:], context


def pair_hashes(lang: str, words: pa.Array, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of each pair of words, in a language."""
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), dtype="u8", count=len(words))
    mixed = (h[first] * np.uint64(0x9E3779B97F4A7C15) + h[second]) ^ np.uint64(xxhash.xxh64_intdigest(lang))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ mixed >> np.uint64(32)


COUNTS = "lang string, k int, phrase string, f long"


def _shards(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[tuple[bytes, int]]]]:
    """A language and some of its texts, about size bytes at a time."""
    held: dict[str, list[tuple[bytes, int]]] = {}
    sizes: Counter[str] = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            for part in pieces(text.as_py().translate(_TABLE), size):
                held.setdefault(lang, []).append(part)
                sizes[lang] += len(part[0])
                if sizes[lang] >= size or sizes.total() >= 4 * size:
                    full = max(sizes, key=sizes.__getitem__)
                    del sizes[full]
                    yield full, held.pop(full)
    yield from held.items()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def _batch(lang: str, k: int, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(phrases), 50_000):
        some = phrases.slice(i, 50_000)
        yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some)), pa.repeat(pa.scalar(k, pa.int32()), len(some)), some, pa.array(counts[i : i + 50_000], pa.int64())], names=["lang", "k", "phrase", "f"])


def _summed(counts: DataFrame, least: int) -> DataFrame:
    return counts.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0))


def frequent_phrases(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, size: int = SHARD_BYTES) -> DataFrame:
    """lang, k, phrase, f of the phrases of 1 to depth words that occur least times or more; with k = 0, all words of a language."""

    def short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _shards(batches, size):
            found = Automaton(Tokens(texts), min(2, depth))
            yield from _batch(lang, 0, pa.array([""]), np.array([found.levels[0].count.sum()]))
            for k in range(1, min(2, depth) + 1):
                yield from _batch(lang, k, *found.phrases(k))

    texts = _texts(docs)
    found = cut(_summed(texts.mapInArrow(short, COUNTS), least))
    if depth <= 2:
        return found
    bitmap = texts.sparkSession.sparkContext.broadcast(pair_bitmap(found))

    def long(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, dtype=np.uint8)
        for lang, some in _shards(batches, size):
            tokens = Tokens(some)

            def keep(first: np.ndarray, second: np.ndarray, lang: str = lang, tokens: Tokens = tokens) -> np.ndarray:
                h = pair_hashes(lang, tokens.words, first, second) & np.uint64(8 * len(bits) - 1)
                return (bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

            automaton = Automaton(tokens, depth, keep)
            for k in range(3, depth + 1):
                yield from _batch(lang, k, *automaton.phrases(k))

    return found.unionByName(cut(_summed(texts.mapInArrow(long, COUNTS), least)))


_BLOCK_BITS = 1 << 15


def pair_bitmap(found: DataFrame) -> bytes:
    """A bit for each frequent pair's hash: about PAIR_BITS bits for a pair, MOST_BITS at most (beyond, it only lets more through)."""
    pairs = found.where("k = 2").select("lang", "phrase")
    n, block = max(pairs.count(), 1), _BLOCK_BITS
    bits = min(MOST_BITS, max(block, 1 << (n * PAIR_BITS - 1).bit_length()))

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in set(batch.column(0).to_pylist()):
                some = batch.filter(pc.equal(batch.column(0), lang)).column(1).cast(pa.binary()).to_pylist()
                both = pa.array([w for x in some for w in x.split(b" ")], pa.binary()).dictionary_encode()
                ids = both.indices.to_numpy()
                h = pair_hashes(lang, both.dictionary, ids[::2], ids[1::2]) & np.uint64(bits - 1)
                yield pa.RecordBatch.from_arrays([pa.array((h // np.uint64(block)).astype(np.int32)), pa.array((h % np.uint64(block)).astype(np.int32))], names=["block", "bit"])

    def filled(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(block, dtype=np.uint8)
        for batch in batches:
            out[batch.column(1).to_numpy()] = 1
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    out = bytearray(bits // 8)
    blocks = pairs.mapInArrow(marked, "block int, bit int").distinct().groupBy("block").applyInArrow(filled, "block int, bits binary")
    for r in blocks.toLocalIterator():
        out[r.block * block // 8 : (r.block + 1) * block // 8] = r.bits
    return bytes(out)


def _without_last(phrase: Column) -> Column:
    return F.regexp_extract(phrase, r"^([\s\S]*) [^ ]+$", 1)


def _without_first(phrase: Column) -> Column:
    return F.regexp_extract(phrase, r"^[^ ]+ ([\s\S]*)$", 1)


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language, by score, count and phrase.

    a: the phrase's count; l, r: those of its parts where it is cut, at the weakest place; score: SCALE * a / (l + r), rounded down."""
    counts = frequent_phrases(docs, depth, least)
    found, total = counts.where("k > 0"), counts.where("k = 0").select("lang", F.col("f").alias("n"))

    # a phrase gives its count to its suffix link and to its prefix
    longer = found.where("k > 2").select("lang", "f", F.explode(F.array(_without_last(F.col("phrase")), _without_first(F.col("phrase")))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    open_ = found.where("k > 1").join(longer, ["lang", "phrase"], "left").where("within IS NULL OR 100 * within < 80 * f")
    open_ = cut(open_.select("lang", "phrase", "k", F.col("f").alias("a")))

    words = F.split("phrase", " ")
    parts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(i.alias("cut"), F.array_join(F.slice(words, 1, i), " ").alias("left"), F.array_join(F.slice(words, i + 1, F.col("k") - i), " ").alias("right")))
    parts = open_.select("lang", "phrase", "a", F.explode(parts).alias("p")).select("lang", "phrase", "a", "p.cut", F.explode(F.array(F.struct(F.lit(True).alias("is_left"), F.col("p.left").alias("part")), F.struct(F.lit(False).alias("is_left"), F.col("p.right").alias("part")))).alias("q"))
    parts = parts.select("lang", "phrase", "a", "cut", "q.is_left", "q.part")
    all_words = total.agg(F.sum("n")).first()[0] or 0
    hot = F.col("f") * SHARES >= all_words
    known = found.where(F.col("k") < depth).select("lang", F.col("phrase").alias("part"), "f")
    dealt = parts.join(F.broadcast(known.where(hot)), ["lang", "part"], "left")  # at most SHARES of each length
    rest = dealt.where("f IS NULL").drop("f").join(known.where(~hot), ["lang", "part"])
    both = dealt.where("f IS NOT NULL").unionByName(rest)
    cuts = both.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("is_left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("is_left"), F.col("f"))).alias("r"))
    cuts = cuts.withColumn("score", F.expr(f"CAST((CAST(a AS DECIMAL(20, 0)) * {SCALE}) div CAST(l + r AS DECIMAL(20, 0)) AS BIGINT)"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = weakest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("nth") <= top).drop("nth", "salt")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
