"""SimHash near-duplicates: 64-bit fingerprints, self-joined over binary tries, and their connected components.

Two fingerprints that differ in at most three bits agree in one of four blocks of 16 bits. So each distinct
fingerprint goes, rotated, to four tries, one below each block value; in a trie, pairs of nodes are walked down
together, the differing bits on their paths are summed, and a pair is dropped once they exceed the budget. A trie of
more than HOT fingerprints is divided: its nodes six levels down form pairs, each pair within the budget a task of its
own. Tasks return no pairs, only a star for each group that they link; the stars are joined to components.

Defined cases: null text is empty; texts without words have fingerprint zero, linked like any other; repeated rows share a fingerprint,
each keeps its row; null doc_ids are never a component's name unless it has no other; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_words, cut
from .components import link, star_components

BITS, BLOCK, SPLIT = 64, 16, 6
HOT = 20_000
#: Rows that a task joins at a time, besides one trie; node pairs that it walks at a time.
RUN_ROWS, FRONTIER = 400_000, 200_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned SimHash of a text's word shingles (XXH64, seed 42), repeats included."""
    words = byte_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e + i for i, e in enumerate(itertools.accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[: max(0, len(words) - width)])]
    ones, n, h = np.zeros(BITS, dtype=np.int64), len(starts), xxhash.xxh64_intdigest
    spans = zip(starts, ends[min(width, len(words)) - 1 :], strict=True)
    while part := [h(joined[a:b], 42) for a, b in itertools.islice(spans, 100_000)]:
        ones += np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (to tell rows of one doc_id apart), fp (signed) for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), dtype="u8", count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view("i8"))], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def trie_join(values: np.ndarray, frontier: tuple[np.ndarray, ...], depth: int, budget: int) -> np.ndarray:
    """For each place in values (sorted within each node), the least place that it is linked to, over others or directly.

    frontier: node pairs as arrays (start a, end a, start b, end b, bits that differ so far), all at one depth; a pair of
    a node with itself stands for the pairs inside it."""
    root = np.arange(len(values))
    ones: dict[int, np.ndarray] = {}
    stack = [(depth, frontier)]
    changes = np.arange(len(values))  # grows where neighbours are not known to be linked

    while stack:
        depth, pairs = stack.pop()
        if len(pairs[0]) > FRONTIER:
            stack += [(depth, tuple(x[i : i + FRONTIER] for x in pairs)) for i in range(0, len(pairs[0]), FRONTIER)]
            continue
        alo, ahi, blo, bhi, diff = pairs
        same = alo == blo
        live = ~same | (ahi - alo > 1)
        # both nodes lie in one group already: nothing to learn
        known = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (root[alo] == root[blo])
        alo, ahi, blo, bhi, diff, same = (x[live & ~known] for x in (alo, ahi, blo, bhi, diff, same))
        # two leaves, or nodes at the end of the paths
        leaf = (ahi - alo == 1) & (bhi - blo == 1) & ~same
        near = np.bitwise_count(values[alo[leaf]] ^ values[blo[leaf]]) <= budget
        u, v = alo[leaf][near], blo[leaf][near]
        alo, ahi, blo, bhi, diff, same = (x[~leaf] for x in (alo, ahi, blo, bhi, diff, same))
        # so few levels are left that all below the two nodes is within the budget
        full = diff + (BITS - depth) <= budget
        if full.any():
            for a, ae, b, be in zip(alo[full], ahi[full], blo[full], bhi[full], strict=True):
                u = np.concatenate([u, np.arange(a + 1, ae), np.arange(b, be)])
                v = np.concatenate([v, np.full(ae - a - 1, a), np.full(be - b, a)])
            alo, ahi, blo, bhi, diff, same = (x[~full] for x in (alo, ahi, blo, bhi, diff, same))
        if len(u):
            link(root, u, v)
            changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        if not len(alo):
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((values >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)])
        count = ones[depth]
        amid, bmid = ahi - (count[ahi] - count[alo]), bhi - (count[bhi] - count[blo])
        down = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff), (alo, amid, bmid, bhi, diff + 1)]
        down.append(tuple(x[~same] for x in (amid, ahi, blo, bmid, diff + 1)))
        below = tuple(np.concatenate(x) for x in zip(*down, strict=True))
        keep = (below[1] > below[0]) & (below[3] > below[2]) & (below[4] <= budget)
        stack.append((depth + 1, tuple(x[keep] for x in below)))
    return root


def fingerprint_links(fps: DataFrame, budget: int = 3, hot: int = HOT) -> DataFrame:
    """u, v (signed fingerprints): links within the budget, or paths of such links, that connect all that are linked.

    fps: distinct fp. Any budget up to 3."""
    if not 0 <= budget < BITS // BLOCK:
        raise ValueError("the four blocks find pairs of up to 3 differing bits")
    turned = F.explode(F.array(*[F.struct(F.lit(r).alias("turn"), F.shiftleft("fp", BLOCK * r).bitwiseOR(F.shiftrightunsigned("fp", BITS - BLOCK * r) if r else F.lit(0).cast("long")).alias("value")) for r in range(BITS // BLOCK)]))
    rows = fps.select(turned.alias("x")).select("x.turn", F.shiftrightunsigned("x.value", BITS - BLOCK).cast("int").alias("block"), "x.value")
    sizes = rows.groupBy("turn", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    node = F.shiftrightunsigned("value", BITS - BLOCK - SPLIT).bitwiseAND(F.lit((1 << SPLIT) - 1).cast("long")).cast("int")
    flips = [x for x in range(1 << SPLIT) if x.bit_count() <= budget]
    paired = F.transform(F.array(*map(F.lit, flips)), lambda x: F.struct(F.least(node, node.bitwiseXOR(x)).alias("a"), F.greatest(node, node.bitwiseXOR(x)).alias("b")))
    whole = F.array(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b")))
    dealt = rows.join(sizes, ["turn", "block"]).select("turn", "block", "value", F.explode(F.when(F.col("n") > hot, paired).otherwise(whole)).alias("p")).select("turn", "block", "p.a", "p.b", "value")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, key, values in _tries(batches):
            root = _join_run(key, values, budget)
            at = np.flatnonzero(root != np.arange(len(root)))
            u, v = (np.where(turn[at] == 0, x, (x >> s) | (x << (np.uint64(BITS) - s) % np.uint64(BITS))) for x in (values[at], values[root[at]]) for s in [(np.uint64(BLOCK) * turn[at].astype("u8")) % np.uint64(BITS)])
            yield pa.RecordBatch.from_arrays([pa.array(u.view("i8")), pa.array(v.view("i8"))], names=["u", "v"])

    return dealt.repartition("turn", "block", "a", "b").sortWithinPartitions("turn", "block", "a", "b").mapInArrow(run, "u long, v long")


def _tries(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole tries (turn, their keys, values), some RUN_ROWS rows at a time, sorted by key and value."""
    held: list[list[np.ndarray]] = []

    def ready(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        turn, block, a, b, value = cols
        key = (((turn.astype("i8") << 16 | block) << 8 | (a + 1)) << 8) | (b + 1)
        order = np.lexsort((value.view("u8"), key))
        return turn[order], key[order], value.view("u8")[order]

    for batch in batches:
        held.append([np.asarray(c) for c in batch.columns])
        if sum(len(x[0]) for x in held) >= RUN_ROWS:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = np.logical_and.reduce([c[:] == c[-1] for c in cols[:4]])
            held = [[c[last] for c in cols]]
            if not last.all():
                yield ready([c[~last] for c in cols])
    if held and sum(len(x[0]) for x in held):
        yield ready([np.concatenate(c) for c in zip(*held, strict=True)])


def _join_run(key: np.ndarray, values: np.ndarray, budget: int) -> np.ndarray:
    """trie_join over many tries at once: undivided ones start below their block, node pairs of divided ones below SPLIT more bits."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.concatenate([starts[1:], [len(key)]])
    a, b = (key[starts] >> 8 & 255) - 1, (key[starts] & 255) - 1
    root = np.arange(len(values))
    for depth, some in ((BLOCK, a < 0), (BLOCK + SPLIT, (a >= 0) & (a == b)), (BLOCK + SPLIT, (a >= 0) & (a != b))):
        lo, hi = starts[some], ends[some]
        if not len(lo):
            continue
        zero = np.zeros(len(lo), dtype=np.int64)
        if (a[some] != b[some]).any():
            nodes = values >> np.uint64(BITS - BLOCK - SPLIT) & np.uint64((1 << SPLIT) - 1)
            mid = np.array([s + np.searchsorted(nodes[s:e], x, side="right") for s, e, x in zip(lo, hi, a[some].astype("u8"), strict=True)], dtype=np.int64)
            pairs = (lo, mid, mid, hi, np.bitwise_count(a[some] ^ b[some]).astype(np.int64))
            pairs = tuple(x[(mid > lo) & (hi > mid)] for x in pairs)
        else:
            pairs = (lo, hi, lo, hi, zero)
        found = trie_join(values, pairs, depth, budget)
        at = np.flatnonzero(found != np.arange(len(found)))
        link(root, at, found[at])
    return root


def near_duplicates(docs: DataFrame, budget: int = 3) -> DataFrame:
    """doc_id, text_hash, fp, component_id for every row; component_id: the least doc_id that links reach."""
    fps = cut(fingerprints(docs))
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    stars = star_components(fingerprint_links(groups.select("fp"), budget))
    rooted = groups.join(stars.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")
