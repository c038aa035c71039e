"""Spelling variants: words one edit apart, found by two-dimensional range reporting, and the form each rare one belongs to.

Words are points: a word's rank in forward order by its rank in reverse order. For each edit position, what has the word's prefix up to it is an
interval of the forward order, what has the suffix behind it one of the reverse order; a wavelet matrix over the reverse ranks
reports the words in both. Words of one length answer replacements, words of a length and the next one insertions.

No task holds all words. Two near words agree before the edit or behind it, so the edit positions of a length are halved: words that
share the first half meet in a shard for edits in the second, and the other way round. A shard of more than HOT words is
halved again, down to single positions, where words differ in two letters at most, so that no more than 90 * 91 meet. Each near pair has one
shard: an insertion counts at its leftmost position only. Tasks return a row for each word and shard (how many are near, the best of them), not pairs.

Defined cases: null text has no words; a null doc_id is written as nothing in what is hashed; repeated rows count again; a word may be of any length;
ties of n go to the smaller word; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A run of letters, once A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, RATIO, TYPO = 6, 5, 5, 199
#: Words of a shard before it is halved; rows that a task indexes at a time; queries that it answers at a time; counts that it keeps.
HOT, INDEX_ROWS, QUERY_ROWS, COUNT_ROWS = 20_000, 200_000, 1_000_000, 300_000
#: Letters that are compared at a time.
MATRIX_LETTERS = 2_000_000


def with_typos(doc_id: object, runs: Iterable[str], every: int = TYPO) -> Counter[str]:
    """How often a document has each word: runs as they are, but where every divides the hash of document and run, without one code point."""
    out: Counter[str] = Counter()
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(runs).items():
        h = zlib.crc32(run.encode(), head)
        if h % every == 0:
            run = run[: (at := h % len(run))] + run[at + 1 :]
        out[run] += n
    return out


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough. docs: doc_id, text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                low = (text.as_py() or "").encode().lower().decode()  # bytes: A-Z alone
                for word, n in with_typos(doc_id.as_py(), (x for x in RUN.findall(low) if len(x) >= least_length)).items():
                    if len(word) >= least_length:
                        seen[word] += n
                if len(seen) > COUNT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class WaveletMatrix:
    """A permutation of 0 to n - 1, of which it reports what lies in an interval of places and in one of values."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """query, value: of each query, the values from least to before beyond at places from lo to before hi."""
        query, value = np.arange(len(lo)), np.zeros(len(lo), dtype=np.int64)
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            width = 1 << (self.bits - 1 - i)
            a, b = ones[lo], ones[hi]
            down = [(query, lo - a, hi - b, value), (query, zeros + a, zeros + b, value + width)]
            query, lo, hi, value = (np.concatenate(x) for x in zip(*down, strict=True))
            live = (hi > lo) & (value < beyond[query]) & (value + width > least[query])
            query, lo, hi, value = query[live], lo[live], hi[live], value[live]
        return query, value


class Grid:
    """Points of words, by shard: forward rank, reverse rank, and how far neighbours in each order agree."""

    def __init__(self, shard: np.ndarray, text: list[str]):
        back, groups = [w[::-1] for w in text], shard.tolist()
        forward, reverse = (np.array(sorted(range(len(text)), key=list(zip(groups, x, strict=True)).__getitem__), dtype=np.int64) for x in (text, back))
        self.at, self.back_at = np.empty_like(forward), np.empty_like(reverse)
        self.at[forward], self.back_at[reverse] = np.arange(len(text)), np.arange(len(text))
        self.agree, self.back_agree = self._agree(shard, text, forward), self._agree(shard, back, reverse)
        self.reverse, self.matrix = reverse, WaveletMatrix(self.back_at[forward])

    @staticmethod
    def _agree(shard: np.ndarray, text: list[str], order: np.ndarray) -> np.ndarray:
        """For each place, the letters that its word shares with the one before; -1 at a shard's first."""
        out = np.full(len(order), -1, dtype=np.int64)
        within = np.flatnonzero(shard[order[1:]] == shard[order[:-1]]) + 1
        width = max(map(len, text))
        step = max(1, MATRIX_LETTERS // width)
        for i in range(0, len(within), step):
            k = within[i : i + step]
            a, b = (np.array([text[x] for x in order[k - d]], dtype=f"U{width}").view(np.uint32).reshape(len(k), width) for d in (1, 0))
            differ = a != b  # at the shorter one's end at the latest: words of a shard are distinct
            out[k] = differ.argmax(axis=1)
        return out

    @staticmethod
    def _intervals(agree: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each place's interval of words that share length letters begins and ends."""
        starts = np.flatnonzero(agree < length)
        nth = np.cumsum(agree < length) - 1
        return starts[nth], np.append(starts, len(agree))[nth + 1]

    def near(self, of: np.ndarray, length: np.ndarray, lo: np.ndarray, hi: np.ndarray, skipped: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """word, found, position: for the words of, at each edit position from lo to before hi, the other points with its prefix up to the position
        and its suffix from skipped letters behind it."""
        tails: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held, size = [], 0
        for i in range(int(lo.min(initial=0)), int(hi.max(initial=0))):
            some = np.flatnonzero((lo <= i) & (i < hi))
            if not len(some):
                continue
            first, end = (x[self.at[of[some]]] for x in self._intervals(self.agree, i))
            some, first, end = some[end - first > 1], first[end - first > 1], end[end - first > 1]
            tail = length[some] - i - skipped
            least, beyond = np.empty_like(first), np.empty_like(first)
            for n in np.unique(tail):
                if n not in tails:
                    tails[n] = self._intervals(self.back_agree, n)
                    if len(tails) > 64:
                        tails.pop(next(iter(tails)))
                here = tail == n
                least[here], beyond[here] = (x[self.back_at[of[some[here]]]] for x in tails[n])
            open_ = beyond - least > 1
            if open_.any():
                held.append((of[some[open_]], np.full(int(open_.sum()), i), first[open_], end[open_], least[open_], beyond[open_]))
                size += int(open_.sum())
            if size >= QUERY_ROWS:
                yield from self._answer(held)
                held, size = [], 0
        if held:
            yield from self._answer(held)

    def _answer(self, held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        word, position, *box = (np.concatenate(x) for x in zip(*held, strict=True))
        for i in range(0, len(word), QUERY_ROWS // 4):
            part = slice(i, i + QUERY_ROWS // 4)
            query, value = self.matrix.report(*(x[part] for x in box))
            found = self.reverse[value]
            apart = found != word[part][query]
            yield word[part][query[apart]], found[apart], position[part][query[apart]]


def near_pairs(shard: np.ndarray, text: list[str], base: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """u, v: places in text of near words, each pair of a shard both ways.

    Of each row: its shard; the shard's word length (rows hold words of it and of one more) and its edit positions."""
    size = np.fromiter(map(len, text), dtype=np.int64, count=len(text))
    short = np.flatnonzero(size == base)
    if len(short):
        same = Grid(shard[short], [text[i] for i in short])
        here = np.arange(len(short))
        for u, v, _ in same.near(here, size[short], lo[short], np.minimum(hi[short], size[short]), 1):
            yield short[u], short[v]
    if 0 < len(short) < len(text):
        grid = Grid(shard, text)
        for u, v, i in grid.near(short, size[short], lo[short], hi[short], 0):
            # an inserted letter that repeats the one before it was found one position further left
            left = np.fromiter((p == 0 or text[x][p - 1] != text[x][p] for x, p in zip(v.tolist(), i.tolist(), strict=True)), dtype=bool, count=len(v))
            u, v = u[left], v[left]
            yield u, v
            yield v, u


SHARD = "key string, base int, lo int, hi int, word string, n long"


def _key(base: str, lo: str, hi: str) -> str:
    """What the words of a shard share: the letters before lo, and those that an edit before hi leaves alone."""
    return f"concat_ws(':', {base}, {lo}, {hi}, left(word, {lo}), right(word, greatest({base} - {hi}, 0)))"


def shards(known: DataFrame) -> DataFrame:
    """Each word under the two halves of its length's edit positions and, as a longer word, of those of the length before.

    Positions of a length L are 0 to L (one may insert behind the last letter); an edit before hi leaves the last L - hi letters alone."""
    size = F.length("word")
    both = F.explode(F.array(size, size - 1)).alias("base")
    rows = known.select("word", "n", both).select("word", "n", "base", F.lit(0).alias("lo"), (F.col("base") + 1).alias("hi"))
    return _halved(rows)


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))).alias("p")
    rows = rows.select("word", "n", "base", parts).select("word", "n", "base", "p.lo", "p.hi")
    return rows.select(F.expr(_key("base", "lo", "hi")).alias("key"), "base", "lo", "hi", "word", "n")


NEAR = "word string, n_near long, best_n long, best string"


def near_words(known: DataFrame, hot: int = HOT) -> DataFrame:
    """word, n_near, best_n, best: how many words are near, and the most frequent of them. known: word, n, a row for each word."""
    rows, done = shards(known), []
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("hi") - F.col("lo")).alias("wide"))
        wide = cut(sizes.where((F.col("size") > hot) & (F.col("wide") > 1)).select("key"))
        if wide.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(wide, "key", "left_anti"))
        rows = cut(_halved(rows.join(wide, "key", "left_semi")))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    found = every.repartition("key").sortWithinPartitions("base", "key").mapInArrow(_search, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word and shard that has near words."""
    for key, base, lo, hi, word, n in _runs(batches):
        shard = np.cumsum(np.fromiter((i == 0 or key[i] != key[i - 1] for i in range(len(key))), dtype=np.int64, count=len(key)))
        rank = np.empty(len(word), dtype=np.int64)  # by n, the largest last; of equal ones the smallest word last
        rank[sorted(range(len(word)), key=word.__getitem__, reverse=True)] = np.arange(len(word))
        order = np.lexsort((rank, n))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        near, best = np.zeros(len(word), dtype=np.int64), np.full(len(word), -1, dtype=np.int64)
        for u, v in near_pairs(shard, word, base, lo, hi):
            np.add.at(near, u, 1)
            np.maximum.at(best, u, place[v])
        at = np.flatnonzero(near)
        top = order[best[at]]
        yield pa.RecordBatch.from_arrays([pa.array([word[i] for i in at], pa.string()), pa.array(near[at]), pa.array(n[top]), pa.array([word[i] for i in top], pa.string())], names=["word", "n_near", "best_n", "best"])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Whole shards of two rows or more, some INDEX_ROWS rows at a time and of lengths that do not differ much."""
    held: list[tuple] = []
    part: list[tuple] = []

    def columns() -> tuple:
        key, base, lo, hi, word, n = zip(*held, strict=True)
        return list(key), *(np.array(x, dtype=np.int64) for x in (base, lo, hi)), list(word), np.array(n, dtype=np.int64)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part and part[0][0] != row[0]:
                if len(part) > 1:
                    if held and (len(held) + len(part) > INDEX_ROWS or part[0][1] > 2 * held[0][1]):
                        yield columns()
                        held = []
                    held += part
                part = []
            part.append(row)
    if len(part) > 1:
        held += part
    if held:
        yield columns()


def variants(known: DataFrame, ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of known (word, n)."""
    near = cut(near_words(known, hot))
    rows = known.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best_n") >= ratio * F.col("n"), F.struct(F.col("best").alias("form"), F.col("best_n").alias("form_n"))).alias("f"))
    rows = cut(rows.select("word", "n", "n_near", "f.form", "f.form_n"))
    return rows.join(_roots(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """word, root: the last that steps lead to; each round doubles their reach, and n grows by the ratio at each step, so rounds are few."""
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if further.where("moved").isEmpty():
            return further.drop("moved")
        steps = further.drop("moved")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n for every frequent word of docs (doc_id, text)."""
    return variants(cut(words(docs, least_length, least_count)), ratio, hot)
