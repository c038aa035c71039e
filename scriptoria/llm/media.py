"""Media columns: Netpbm and BMP images as bytes in columns, decoded to numpy arrays, resized by area through integral
images, written as NPY tiles, and told apart by difference hashes.

decode() reads binary and plain PBM, PGM and PPM (8-bit samples) and uncompressed BMP (8-bit palette, 24 and 32 bits).

Samples are taken as they are stored, whatever the largest that a header names; bitmaps of one bit are 0 and 255.

Defined cases: null, empty or undecodable media give null tiles and hashes; a very long text is one tall image, held whole by its task; null text is stored as 64 zero bytes; equal media give equal
values; rows are independent of each other, so repeated rows and extra columns do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without

WIDTH = 64  # samples of a row, for payloads
TILE = (32, 32)


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit samples (rows, columns) as a binary PGM."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, dtype=np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey samples as a BMP with a grey palette; rows bottom up, padded to four bytes."""
    height, width = samples.shape
    padded = np.zeros((height, (width + 3) // 4 * 4), dtype=np.uint8)
    padded[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    palette[:, 3] = 0
    start = 54 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + padded.size, 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, padded.size, 2835, 2835, 256, 256) + palette.tobytes() + padded.tobytes()


_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("header")
        fields.append(int(m[1]))
        at = m.end()
    width, height = fields[:2]
    most, planes = fields[2] if len(fields) > 2 else 1, 3 if kind in (3, 6) else 1
    if not 0 < most < 256 or not width or not height:
        raise ValueError("images of 8-bit samples only, and not empty")
    shape = (height, width, planes)[: 2 + (planes > 1)]
    if kind >= 4:
        raw = np.frombuffer(data, dtype=np.uint8, offset=at + 1)
        if kind == 4:
            stride = (width + 7) // 8
            return (1 - np.unpackbits(raw[: stride * height].reshape(height, stride), axis=1)[:, :width]) * np.uint8(255)
        return raw[: height * width * planes].reshape(shape)
    plain = re.sub(rb"#[^\n]*", b"", data[at:])
    values = [c - 48 for c in plain if c in b"01"] if kind == 1 else list(map(int, plain.split()))
    if max(values, default=0) > most:
        raise ValueError("a sample above the largest")
    out = np.array(values[: height * width * planes], dtype=np.uint8).reshape(shape)
    return (1 - out) * np.uint8(255) if kind == 1 else out


def _bmp(data: bytes) -> np.ndarray:
    start, = struct.unpack_from("<I", data, 10)
    head, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits, and not empty")
    stride, rows = (width * bits // 8 + 3) // 4 * 4, abs(height)
    raw = np.frombuffer(data, dtype=np.uint8, count=stride * rows, offset=start).reshape(rows, stride)[:, : width * bits // 8]
    raw = raw[::-1] if height > 0 else raw
    if bits == 8:
        colours = (start - 14 - head) // 4
        palette = np.frombuffer(data, dtype=np.uint8, count=colours * 4, offset=14 + head).reshape(-1, 4)
        if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all():
            return palette[:, 0][raw]
        return palette[raw][:, :, 2::-1]
    return raw.reshape(rows, width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """An image's 8-bit samples: (rows, columns), or (rows, columns, 3) in red, green, blue."""
    if data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, exact for any ratio, by interpolating the integral image at the areas' corners."""
    grey = samples.mean(axis=2) if samples.ndim == 3 else samples.astype(np.float64)
    table = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    table[1:, 1:] = grey.cumsum(axis=0).cumsum(axis=1)

    def at(edges: np.ndarray, t: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), t.shape[0] - 2)
        return t[low] + (edges - low)[:, None] * (t[low + 1] - t[low])

    ys, xs = np.linspace(0, grey.shape[0], height + 1), np.linspace(0, grey.shape[1], width + 1)
    corners = at(xs, at(ys, table).T).T
    area = (grey.shape[0] / height) * (grey.shape[1] / width)
    return (corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]) / area


def difference_hash(samples: np.ndarray) -> str:
    """64 bits, as 16 hexadecimal digits: whether each of 9 by 8 areas is lighter than its right neighbour."""
    small = np.round(area_resize(samples, 8, 9), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy_tile(samples: np.ndarray, shape: tuple[int, int] = TILE) -> bytes:
    """The image resized to shape, as an NPY file's bytes."""
    out = io.BytesIO()
    np.save(out, np.clip(np.round(area_resize(samples, *shape)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def payload(text: str | None) -> tuple[int, np.ndarray]:
    """The text's length in bytes, and its bytes with zeros up to a positive multiple of 64, as rows of WIDTH samples."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    return len(raw), np.frombuffer(padded, dtype=np.uint8).reshape(-1, WIDTH)


def tiles(media: DataFrame, column: str = "media", shape: tuple[int, int] = TILE) -> DataFrame:
    """media with height, width, tile (an NPY file) and feature (the difference hash) of the image in the column, in place of columns of these names."""
    media = without(media, *({"height", "width", "tile", "feature"} - {column}))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(0).to_pylist():
                try:
                    image = decode(data)
                    found.append((image.shape[0], image.shape[1], npy_tile(image, shape), difference_hash(image)))
                except (ValueError, TypeError, struct.error, IndexError):  # what a broken image raises
                    found.append((None,) * 4)
            cols = list(zip(*found, strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["_row", "height", "width", "tile", "feature"])

    packed = media.select(F.col(column).alias("_media"), F.struct(*media.columns).alias("_row"))
    schema = packed.select("_row").schema.add("height", "integer").add("width", "integer").add("tile", "binary").add("feature", "string")
    return packed.mapInArrow(run, schema).select("_row.*", "height", "width", "tile", "feature")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"


def text_media(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """doc_id, n_bytes, media: each text's padded payload as an image in the named form (pgm or bmp)."""
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                each = [payload(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in each], pa.int64()), pa.array([encode(s) for _, s in each], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Digests of text_media()'s result, from the stored bytes read back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = decode(data)
                back = image.tobytes()
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image), hashlib.sha256(npy_tile(image)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = [x.split()[0] for x in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGESTS)
