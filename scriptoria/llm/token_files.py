"""Token-ID files: documents' token ids, concatenated in ascending doc_id order, with Elias-Fano coded boundaries.

The format is a Parquet table with one row for each chunk of some CHUNK_IDS ids: shard and chunk (its order), n_docs,
n_ids, doc_ids (little-endian 64-bit; nulls: a bitmap), ids (little-endian, id_bytes each), and the ends of its documents
as an Elias-Fano sequence: low_bits, low (packed low bits), high (unary coded high parts), samples (ones before each block
of BLOCK bytes of high, for select). A document is never divided; its boundaries take about 2 + log2(mean length) bits.

Defined cases: null text is empty: the end id alone; documents are ordered by (doc_id, text), null ids first; repeated
rows are documents like any other; a very long text is one document, coded whole; other columns are ignored, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

END_ID = 2
CHUNK_IDS, BATCH_CHARS, BLOCK = 1 << 20, 1_000_000, 64
READ_DOCS = 1024  # read at a time; a multiple of 8


class EliasFano:
    """A sequence of n ascending numbers below universe, with select in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, "<u4")

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, int(universe // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.packbits((values[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(universe >> bits) + n + 1, dtype=np.uint8)
        unary[places] = 1
        high = np.packbits(unary, bitorder="little")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1:BLOCK]
        return EliasFano(n, bits, low.tobytes(), high.tobytes(), before.astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        bits = np.unpackbits(self.low[i * self.low_bits // 8 : ((i + 1) * self.low_bits + 7) // 8], bitorder="little")[i * self.low_bits % 8 :][: self.low_bits]
        return int((bits.astype(np.int64) << np.arange(len(bits))).sum())

    def select(self, i: int) -> int:
        """The i-th number, from 0: the sample's block, then the byte, then the bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.samples, i, side="right")) - 1
        part = self.high[block * BLOCK : (block + 1) * BLOCK]
        place = int(np.flatnonzero(np.unpackbits(part, bitorder="little"))[i - int(self.samples[block])]) + block * BLOCK * 8
        return (place - i) << self.low_bits | self._low(i)

    def select_range(self, first: int, last: int) -> np.ndarray:
        """The numbers from the first-th on, before the last-th: only their blocks of the high part, and their low bits, are read."""
        if not 0 <= first < last <= self.n:
            raise IndexError((first, last))
        one, two = (int(np.searchsorted(self.samples, i, side="right")) - 1 for i in (first, last - 1))
        part, skip = self.high[one * BLOCK : (two + 1) * BLOCK], int(self.samples[one])
        places = np.flatnonzero(np.unpackbits(part, bitorder="little"))[first - skip : last - skip] + one * BLOCK * 8
        begin = first * self.low_bits
        bits = np.unpackbits(self.low[begin // 8 : (last * self.low_bits + 7) // 8], bitorder="little")[begin % 8 :][: (last - first) * self.low_bits]
        low = (bits.reshape(last - first, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return (places - np.arange(first, last)) << self.low_bits | low


#: The characters whose classes all Unicode versions share, by which texts are divided here; texts with others are coded whole.
_SURE = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028))]
_LETTER, _NUMBER = ("".join(c for c in _SURE if unicodedata.category(c)[0] == k) for k in "LN")
_SPACE = "\\t-\\r \\x85\\xa0"
#: How byte-level BPE divides a text before merging; no merge crosses a piece.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
UNSURE = re.compile(r"[^\x00-\u024f\u2010-\u2027]")
KNOWN_PIECES, RUN_PIECES = 600_000, 1024


class Coder:
    """Texts to id bytes by the tokenizers library. For byte-level BPE each distinct piece is coded once and remembered (some
    KNOWN_PIECES, and as many from before, of which those in use are kept); texts with special tokens, or with characters whose class may differ between Unicode versions, are coded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.bytes = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        about = json.loads(self.tok.to_str())
        split = about["pre_tokenizer"] or {}
        self.special = [a["content"] for a in about["added_tokens"]]
        self.by_piece = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not about["normalizer"] and not any(re.fullmatch(r"[\w ]+", x) for x in self.special)
        vocab = self.tok.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values(), default=0) + 1, dtype=np.int64)  # of byte-level tokens: a character stands for a byte
        self.n_bytes[list(vocab.values())] = [len(x) for x in vocab]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype=f"<u{self.bytes}").tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Pieces that are a space and letters: coded in runs, which the tokenizer divides into the same pieces again."""
        out: list[bytes] = []
        for i in range(0, len(words), RUN_PIECES):
            run = words[i : i + RUN_PIECES]
            ids = self._whole(["".join(run)])[0]
            reached = np.cumsum(self.n_bytes[np.frombuffer(ids, f"<u{self.bytes}")])
            ends = np.cumsum([len(x.encode()) for x in run])
            at = np.searchsorted(reached, ends)
            if not np.array_equal(reached[at], ends):
                raise ValueError("the tokenizer's ids do not keep to the pieces of byte-level BPE")
            cuts = [0, *((at + 1) * self.bytes).tolist()]
            out += [ids[a:b] for a, b in itertools.pairwise(cuts)]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._whole(texts)
        plain = [not UNSURE.search(t) and not any(x in t for x in self.special) for t in texts]
        whole = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        parts = [PIECES.findall(t) if p else None for t, p in zip(texts, plain, strict=True)]
        if len(self.known) > KNOWN_PIECES:
            self.known, self.before = {}, self.known
        new = set().union(*(p for p in parts if p)).difference(self.known)
        again = new & self.before.keys()
        self.known.update((x, self.before[x]) for x in again)
        new -= again
        words = [x for x in new if x[0] == " " and x[1:].isalpha()]
        self.known.update(zip(words, self._words(words), strict=True))
        others = list(new.difference(words))
        self.known.update(zip(others, self._whole(others), strict=True))
        known = self.known.__getitem__
        return [next(whole) if p is None else b"".join(map(known, p)) for p in parts]


@cache
def _coder(path: str) -> Coder:
    return Coder(path)


CHUNKS = "shard int, chunk int, n_docs long, n_ids long, doc_ids binary, nulls binary, id_bytes int, ids binary, low_bits int, low binary, high binary, samples binary"
_CHUNKS = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("nulls", pa.binary()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """The chunks of docs (doc_id, text). tokenizer: a tokenizers file, which all executors have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer)
        width = coder.bytes
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        shard, chunk, held_ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def closed() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // width for x in held])
            ef = EliasFano.encode(ends, int(ends[-1]))
            null = np.packbits(np.array([d is None for d in held_ids], dtype=np.uint8), bitorder="little").tobytes()
            row = (shard, chunk, len(held), int(ends[-1]), np.array([d or 0 for d in held_ids], dtype="<i8").tobytes(), null, width, b"".join(held), ef.low_bits, ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _CHUNKS, strict=True)], schema=_CHUNKS)

        for batch in batches:
            for ids, texts in _parts(batch):
                for doc_id, coded in zip(ids, coder(texts), strict=True):
                    held_ids.append(doc_id)
                    held.append(coded + end)
                    size += len(held[-1]) // width
                    if size >= chunk_ids:
                        yield closed()
                        chunk, held_ids, held, size = chunk + 1, [], [], 0
        if held:
            yield closed()

    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")  # one id, or none, on many rows is more than one task
    return ordered.mapInArrow(run, CHUNKS)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of some BATCH_CHARS characters at a time."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
        ids.append(doc_id.as_py())
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= BATCH_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_documents(chunks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from chunks as they were written."""
    sizes = chunks.select("shard", "chunk", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("shard_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("at", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(shards, "shard").select("shard", "chunk", (F.col("at") + F.col("shard_start")).alias("base"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                ef = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])
                ids = np.frombuffer(row["ids"], dtype=f"<u{row['id_bytes']}")
                known, nulls = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["nulls"], np.uint8)
                before = 0
                for i in range(0, ef.n, READ_DOCS):
                    j = min(ef.n, i + READ_DOCS)
                    ends = ef.select_range(i, j)
                    starts = np.concatenate([[before], ends[:-1]])
                    before = int(ends[-1])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                    null = np.unpackbits(nulls[i // 8 : (j + 7) // 8], bitorder="little", count=j - i).astype(bool)
                    yield pa.RecordBatch.from_arrays([pa.array(known[i:j], mask=null), pa.array(starts + row["base"]), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return chunks.join(starts, ["shard", "chunk"]).mapInArrow(run, READ)


def write_tokens(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the chunks to the shared folder and returns the table, as read from there."""
    return cut(encode_documents(docs, tokenizer, **options))
