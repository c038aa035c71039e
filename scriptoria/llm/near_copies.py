"""Near copies: SimHash groups, completed to what a Jaccard similarity of THRESHOLD of five-word shingles links.

First, fingerprints of all texts (64 bits over their five-word shingles) are joined by the binary tries of simhash_dedup at three
bits, and each text is verified against the least of its group. Three bits cannot find all texts that are similar to 0.8 (such differ
in some ten bits of 64, up to 18, and no trie join stays below all pairs at so many), so the rest is found by MinHash: texts
that agree in all ROWS values of one of BANDS bands form a bucket. A pair at 0.8 shares no bucket with a probability of
(1 - 0.8^5)^32, three in a million, and more similar ones with less. Every link is verified on the shingles themselves.

Each text is verified against one pivot of its buckets, the nearest by SimHash; in buckets that still hold several components, in
ROUNDS rounds, against random other pivots; then against the NEAREST texts of other components by the parities of their shingles'
hashes; and at last all pairs of different components that parities do not rule out are verified. Pairs within a component are
never looked at, so a large group of copies costs a few pairs for each text.
The texts of buckets with over MANY texts outside their main component, as boilerplate makes them, meet for that last step by their rarest
shingles instead, so many of each that no two similar texts are without a common one (a prefix filter): that loses no pair.
In other buckets a text has MANY pairs at most. A pivot's shingles go to SALTS tasks, however many texts it is held against.

Defined cases: null text is empty; texts without words are copies of each other; a text of fewer than five words is one shingle; long
texts are sets of shingles like others; null and repeated doc_ids, repeated rows: see keep_one; other columns stay, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut
from .components import star_components
from .decontaminate import hashes, shingles
from .simhash_dedup import fingerprint_links

THRESHOLD = 0.8
#: MinHash values in a band, bands; 64-bit numbers that hold a text's parities; rounds of random pivots.
ROWS, BANDS, PARITIES, ROUNDS = 5, 32, 8, 1
#: Texts outside a bucket's main component that are paired with all of it directly; tasks that a pivot's set goes to.
MANY, SALTS = 64, 16
#: Near texts that each one is held against, and texts of a bucket that a task compares with.
NEAREST, BLOCK_ROWS = 8, 20_000
_MIX = np.random.default_rng(11).integers(0, 1 << 64, (2, ROWS * BANDS), dtype="u8", endpoint=False)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; of a text without words, that of nothing."""
    return np.unique(hashes(shingles(text) or [b""]))


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= threshold * (len(a) + len(b) - shared) - 1e-9


def bands(found: np.ndarray) -> np.ndarray:
    """A hash of each band of a set's MinHash values."""
    least = np.full(ROWS * BANDS, np.uint64((1 << 64) - 1))
    for i in range(0, len(found), 2048):
        least = np.minimum(least, (found[i : i + 2048, None] * (_MIX[0] | np.uint64(1)) + _MIX[1]).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], dtype="u8")


def simhash(found: np.ndarray) -> np.uint64:
    """The SimHash of a set of hashes: a bit is set if over half of them have it."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(found), 100_000):
        ones += np.unpackbits(found[i : i + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0]


def parities(found: np.ndarray) -> np.ndarray:
    """PARITIES numbers: of the hashes that fall to each bit, whether there is an odd number."""
    odd = np.bincount((found & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


SKETCH = "key long, n int, fp long, odd array<long>, h array<long>"


def sketches(texts: DataFrame) -> DataFrame:
    """key, n (the text's shingles), fp (their SimHash), odd (parities), h (the bands); a task passes over texts that it has seen."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                for key, text in zip(*(c.slice(i, 256) for c in batch.columns), strict=True):
                    if (k := key.as_py()) not in seen:
                        seen.add(k)
                        found = shingle_set(text.as_py())
                        out.append((k, len(found), simhash(found), parities(found), bands(found).view("i8")))
                if out:
                    keys, n, fp, odd, h = zip(*out, strict=True)
                    lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]), pa.int32()), pa.array(np.concatenate(xs))) for xs in (odd, h)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int32()), pa.array(np.array(fp, dtype="u8").view("i8")), *lists], names=["key", "n", "fp", "odd", "h"])

    return texts.select("text_hash", "text").mapInArrow(run, SKETCH).dropDuplicates(["key"])


def _sets(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """key, s: the shingle sets of the texts of some keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                found = shingle_set(text.as_py()).view("i8")
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))], names=["key", "s"])

    need = keys.distinct().withColumnRenamed("key", "text_hash").hint("merge")  # keys grow with the texts: never broadcast
    return cut(texts.join(need, "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text_hash", "text").mapInArrow(run, "key long, s array<long>"))


def _verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """u, v of the pairs (hub, key) that are similar. A hub may have any number of pairs."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, found = None, np.zeros(0, dtype="u8")
        for batch in batches:
            out: list[tuple[int, int]] = []
            for own, key, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if key is None:  # the hub's own row comes first
                    hub, found = own, np.array(s.values).view("u8")
                elif own == hub and similar(found, np.asarray(s.values).view("u8"), threshold):
                    out.append((own, key))
            if out:
                u, v = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    pairs = pairs.select("hub", "key", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    many = pairs.join(sets, "key").select("hub", "salt", "key", "s")
    one = pairs.select("hub", "salt").distinct().join(sets.withColumnRenamed("key", "hub"), "hub").select("hub", "salt", F.lit(None).cast("long").alias("key"), "s")
    dealt = one.unionByName(many).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("key"))
    return cut(dealt.mapInArrow(check, "u long, v long"))


def _tried(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("hub", "key").alias("u"), F.least("hub", "key").alias("v"))


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """pairs (hub, key) without those tried, each once whichever way round."""
    pairs = pairs.select("hub", "key", F.greatest("hub", "key").alias("u"), F.least("hub", "key").alias("v")).dropDuplicates(["u", "v"])
    return cut(pairs.join(tried, ["u", "v"], "left_anti").select("hub", "key"))


def _apart(a: Column, b: Column) -> Column:
    """Bits in which parities differ: each is a shingle, or an odd number of them, that only one of two texts has."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(PARITIES)), F.lit(0))


def _may(n: Column, m: Column, a: Column, b: Column, threshold: float) -> Column:
    """Whether texts of n and m shingles with parities a and b may be similar."""
    sizes = F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - 1e-9
    return sizes & (_apart(a, b) <= F.lit((1 - threshold) / (1 + threshold)) * (n + m) + 1e-9)


def linked_texts(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """u, v: each text hash that is linked, directly or over others, to a lesser one, and the least that it is linked to.

    texts: text_hash, text; repeats do no harm."""
    known = cut(sketches(texts))

    # fingerprints within three bits, by the trie join; each text is held against the least of its group
    groups = star_components(fingerprint_links(known.select("fp").distinct(), 3)).withColumnsRenamed({"u": "fp", "v": "group"})
    grouped = known.select("key", "fp").join(groups, "fp", "left").select("key", F.coalesce("group", "fp").alias("group"))
    least = grouped.groupBy("group").agg(F.min("key").alias("v"))
    alike = grouped.withColumnRenamed("key", "u").join(least, "group").where("u <> v").select(F.col("v").alias("hub"), F.col("u").alias("key"))

    every, about = known.select("key", F.explode("h").alias("h")), known.select("key", "n", "fp")
    pivots = every.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("key")).where("c > 1").join(about, "key").select("h", F.struct("key", "n", "fp").alias("p"))
    bare = cut(every.join(pivots, "h").join(about, "key"))  # few texts share a band
    near = bare.where((F.col("key") != F.col("p.key")) & (F.least("n", "p.n") >= F.lit(threshold) * F.greatest("n", "p.n") - 1e-9))
    near = near.groupBy("key").agg(F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("p.fp"))).alias("d"), F.col("p.key").alias("o"))).alias("x"))
    first = cut(alike.unionByName(near.select(F.col("x.o").alias("hub"), "key")).distinct())
    sets = _sets(texts, first.select(F.explode(F.array("hub", "key")).alias("key")).unionByName(bare.select("key")))
    links, tried = _verified(sets, first, threshold), _tried(first)

    def still_open(rows: DataFrame, of: DataFrame) -> DataFrame:
        """rows with their component's root, and their bucket's main one, of the buckets that hold several."""
        rows = cut(rows.drop("root", "main").join(of, "key", "left").withColumn("root", F.coalesce("root", "key")))
        return _several(rows)

    def roots() -> DataFrame:
        return star_components(links).withColumnsRenamed({"u": "key", "v": "root"})

    rows = cut(still_open(bare.select("h", "key", "n"), roots()).join(known.select("key", "odd"), "key"))
    drop_cut(bare)
    for turn in range(ROUNDS):
        pivots = rows.groupBy("h").agg(F.min(F.struct(F.xxhash64("key", "h", F.lit(turn)).alias("r"), "key", "n", "odd", "root")).alias("p"))
        chosen = rows.join(pivots, "h").where((F.col("root") != F.col("p.root")) & _may(F.col("n"), F.col("p.n"), F.col("odd"), F.col("p.odd"), threshold))
        nearest = chosen.groupBy("key").agg(F.min(F.struct(_apart(F.col("odd"), F.col("p.odd")).alias("d"), F.col("p.key").alias("o"))).alias("x"))
        stars = _untried(nearest.select(F.col("x.o").alias("hub"), "key"), tried)
        if stars.isEmpty():
            break
        tried, links = tried.unionByName(_tried(stars)), links.unionByName(_verified(sets, stars, threshold))
        fewer = cut(still_open(rows, roots()))
        drop_cut(rows)
        rows = fewer
    near = _untried(_nearest(rows, threshold), tried)
    tried, links = tried.unionByName(_tried(near)), links.unionByName(_verified(sets, near, threshold))
    fewer = cut(still_open(rows, roots()))
    drop_cut(rows)
    rows = fewer
    large = rows.groupBy("h").agg(F.count_if(F.col("root") != F.col("main")).alias("c")).where(F.col("c") > MANY).select("h")
    texts_of = rows.join(large, "h", "left_semi").select("key", "n", "root", "odd").dropDuplicates(["key"])
    divided = _rarest(sets, texts_of.select("key"), threshold).join(texts_of, "key")
    rest = _untried(_across(rows.join(large, "h", "left_anti"), threshold).unionByName(_across(_several(cut(divided)), threshold)), tried)
    found = star_components(links.unionByName(_verified(sets, rest, threshold)))
    for done in (known, sets, rows, first, near, rest):
        drop_cut(done)
    return found


def _rarest(sets: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """h, key: of each text of keys its rarest shingles among them that others have too.

    Of a text's n shingles, in any one order, a similar text has one of the first n - ceil(threshold * n) + 1; the rarest come first.
    Shingles that make up a thousandth of all, so at most a thousand, are broadcast, others joined."""
    every = sets.join(keys, "key", "left_semi").select("key", F.size("s").alias("n"), F.explode("s").alias("h"))
    counts = cut(every.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    bound = (counts.agg(F.sum("c")).first()[0] or 0) / 1000
    common = F.broadcast(counts.where(F.col("c") > bound))
    shared = every.join(common, "h").unionByName(every.join(common, "h", "left_anti").join(counts.where(F.col("c") <= bound), "h"))
    held = shared.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("x"))
    alone = F.col("n") - F.size("x")
    first = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-6) + 1 - alone).cast("int")
    return held.select("key", F.explode(F.slice("x", F.lit(1), F.greatest(first, F.lit(0)))).alias("x")).select("x.h", "key")


def _several(rows: DataFrame) -> DataFrame:
    """rows of the buckets that hold several components, with the one of most texts as main."""
    roots = rows.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    return rows.join(roots.where("roots > 1").select("h", "main"), "h")


def _nearest(rows: DataFrame, threshold: float) -> DataFrame:
    """hub, key: of each text outside its bucket's main component, the NEAREST ones of other components that may be similar, by their parities.

    A bucket's texts lie in blocks of about BLOCK_ROWS; those outside pass all of them, one at a time."""
    sizes = rows.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = rows.join(sizes, "h").select("h", "blocks", "key", "n", "root", "odd", (F.col("root") != F.col("main")).cast("int").alias("asks"))
    held = rows.select("h", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("asks"), "key", "n", "root", "odd")
    asking = rows.where("asks = 1").select("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "asks", "key", "n", "root", "odd")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, []
        near, factor = (1 - threshold) / (1 + threshold), threshold
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            h, part, asks, keys, sizes, roots = (batch.column(i).to_numpy() for i in range(6))
            odd = batch.column(6).flatten().to_numpy().view("u8").reshape(-1, PARITIES)
            starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])]))
            for a, b in zip(starts, [*starts[1:], len(h)], strict=True):
                if now != (h[a], part[a]):
                    now, block = (h[a], part[a]), []
                if not asks[a]:
                    block.append((keys[a:b], sizes[a:b], roots[a:b], odd[a:b]))
                    continue
                if len(block) > 1:
                    block = [tuple(np.concatenate(x) for x in zip(*block, strict=True))]
                for i in range(a, b) if block else ():
                    others, m, r, parity = block[0]
                    d = np.bitwise_count(parity ^ odd[i]).sum(axis=1, dtype=np.int64)
                    fits = np.flatnonzero((r != roots[i]) & (np.minimum(m, sizes[i]) >= factor * np.maximum(m, sizes[i]) - 1e-9) & (d <= near * (m + sizes[i]) + 1e-9))
                    best = fits[np.argsort(d[fits], kind="stable")[:NEAREST]]
                    out += zip(others[best].tolist(), [int(keys[i])] * len(best), d[best].tolist(), strict=True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["hub", "key", "d"])

    dealt = held.unionByName(asking).repartition("h", "block").sortWithinPartitions("h", "block", "asks")
    found = dealt.mapInArrow(run, "hub long, key long, d long").distinct().groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "hub"))), 1, NEAREST).alias("x"))
    return found.select("key", F.explode("x").alias("x")).select("x.hub", "key")


def _across(rows: DataFrame, threshold: float) -> DataFrame:
    """hub, key: pairs of a bucket of different components, unless their parities rule them out."""
    left = rows.where("root <> main").select("h", F.col("key").alias("hub"), F.col("n").alias("m"), F.col("root").alias("r"), F.col("odd").alias("even"))
    both = (F.col("root") != F.col("r")) & _may(F.col("n"), F.col("m"), F.col("odd"), F.col("even"), threshold)
    return left.join(rows, "h").where(both).select("hub", "key")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without those whose group has another of smaller (doc_id, text hash), nulls last; of rows equal in both one stays.

    Groups are told by their root's text hash: a doc_id may be null or stand in several groups."""
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"))
    found = cut(rows.join(linked_texts(texts), F.col("text_hash") == F.col("u"), "left").select("doc_id", "text_hash", F.coalesce("v", "text_hash").alias("root")))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("h"))
    first = found.groupBy("root").agg(F.min(rank).alias("first"))
    lost = found.join(first, "root").where(rank != F.col("first"))
    lost = lost.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    twice = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.struct(*docs.columns).alias("_row"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h"))
    rows = rows.join(lost, same, "left_anti")
    once = rows.join(twice, same, "left_anti")
    many = rows.join(twice, same, "left_semi").dropDuplicates(["doc_id", "_th"])
    return once.unionByName(many).select("_row.*")
