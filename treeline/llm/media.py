"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized, tiled to NPY, with difference hashes.

Images travel as a binary column. `media_tiles` decodes each, cuts it into square tiles, serialises the stack of tiles
as one .npy value and adds a 64-bit difference hash of the area-resized image; the table is written to the shared
folder, and features are computed from what is read back. `text_media` first makes an image of a text's bytes.

Defined cases: a null text is an empty one; a null or undecodable image gives null tiles and hash and an `error`; an
empty table gives an empty one; equal images or texts give equal values; repeated rows stay; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import per_row, small_batches, written

#: Side of a tile. 24 * 24 bytes, 576, is what a text's payload is padded to a multiple of.
TILE = 24


def netpbm_fields(data: bytes, n: int) -> tuple[list[int], int]:
    """The n numbers of a Netpbm header after its magic, comments skipped, and where the samples start."""
    at, found = 2, []
    token = re.compile(rb"(?:\s|#[^\n]*\n?)*(\d+)")
    for _ in range(n):
        m = token.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        found.append(int(m[1]))
        at = m.end()
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as height x width (x 3) uint8, or uint16 where the maximum is over 255. Bitmaps: 1 is black, 0."""
    kind = int(data[1:2])
    bitmap, colour = kind in (1, 4), kind in (3, 6)
    head, at = netpbm_fields(data, 2 if bitmap else 3)
    width, height = head[:2]
    shape = (height, width, 3) if colour else (height, width)
    count = int(np.prod(shape))
    if kind == 1:
        bits = re.sub(rb"#[^\n]*|\s", b"", data[at - 1 :])
        return np.where(np.frombuffer(bits, dtype=np.uint8, count=count) == 49, 0, 255).astype(np.uint8).reshape(shape)
    if kind == 4:
        stride = (width + 7) // 8
        rows = np.frombuffer(data, dtype=np.uint8, count=stride * height, offset=at).reshape(height, stride)
        return np.where(np.unpackbits(rows, axis=1)[:, :width] == 1, 0, 255).astype(np.uint8)
    if kind in (2, 3):
        values = np.array(re.sub(rb"#[^\n]*", b"", data[at - 1 :]).split()[:count], dtype=np.int64)
        if len(values) < count:
            raise ValueError("too few samples")
        return values.astype(np.uint8 if head[2] < 256 else np.uint16).reshape(shape)
    samples = np.frombuffer(data, dtype=np.uint8 if head[2] < 256 else ">u2", count=count, offset=at)
    return samples.astype(samples.dtype.newbyteorder("="), copy=False).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits, either row order, as height x width x 3 uint8 (red first)."""
    start, header = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if header == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", data, 18)
        packing, colours, entry = 0, 0, 3
    else:
        width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
        colours, entry = struct.unpack_from("<I", data, 46)[0], 4
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP of packing {packing} and {bits} bits")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, dtype=np.uint8, count=stride * rows, offset=start).reshape(rows, stride)
    if bits >= 24:
        step = bits // 8
        image = raw[:, : width * step].reshape(rows, width, step)[:, :, 2::-1]
    else:
        n = colours or 1 << bits
        palette = np.frombuffer(data, dtype=np.uint8, count=n * entry, offset=14 + header).reshape(n, entry)[:, 2::-1]
        index = raw if bits == 8 else np.unpackbits(raw, axis=1) if bits == 1 else np.stack([raw >> 4, raw & 15], axis=2).reshape(rows, -1)
        image = palette[index[:, :width]]
    return np.ascontiguousarray(image if height < 0 else image[::-1])


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    """Luma in thousandths, as integers, so that equal images give equal values on every machine."""
    if image.ndim == 2:
        return image.astype(np.int64) * 1000
    return image.astype(np.int64) @ np.array([299, 587, 114], dtype=np.int64)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell, from the integral image; cells that cut pixels weigh them by the part inside."""
    table = np.zeros((image.shape[0] + 1, image.shape[1] + 1), dtype=np.int64)
    np.cumsum(image, axis=0, out=table[1:, 1:])
    np.cumsum(table[1:, 1:], axis=1, out=table[1:, 1:])

    def edges(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(n + 1) * size
        return np.minimum(at // n, size - 1), at / n - np.minimum(at // n, size - 1)

    (y, fy), (x, fx) = edges(image.shape[0], height), edges(image.shape[1], width)
    rows = table[y] * (1 - fy)[:, None] + table[y + 1] * fy[:, None]
    both = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    cells = both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]
    return cells * (height * width / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as hex: whether each cell of the 8 x 9 thumbnail is brighter than its left neighbour."""
    small = area_resize(grey(image), 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-6).tobytes().hex()


def tiles_of(image: np.ndarray, side: int = TILE) -> np.ndarray:
    """The image cut into side x side tiles, row by row, edge tiles filled with zeros: n x side x side (x 3)."""
    rows, cols = -(-image.shape[0] // side), -(-image.shape[1] // side)
    full = np.zeros((rows * side, cols * side, *image.shape[2:]), dtype=image.dtype)
    full[: image.shape[0], : image.shape[1]] = image
    parts = full.reshape(rows, side, cols, side, *image.shape[2:]).swapaxes(1, 2)
    return np.ascontiguousarray(parts.reshape(rows * cols, side, side, *image.shape[2:]))


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def npy_array(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def media_tiles(images: DataFrame, id_col: str = "media_id", data_col: str = "data", side: int = TILE) -> DataFrame:
    """images(id, data binary) -> id, height, width, npy binary, dhash, error: written to the shared folder and read back."""
    out = pa.schema([("id", pa.int64()), ("height", pa.int64()), ("width", pa.int64()), ("npy", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])

    def make():
        def each(key, data):
            try:
                image = decode(data or b"")
                if image.size == 0:
                    raise ValueError("no pixels")
            except (ValueError, struct.error) as e:
                return key, None, None, None, None, str(e) or type(e).__name__
            return key, image.shape[0], image.shape[1], npy_bytes(tiles_of(image, side)), difference_hash(image), None

        return each

    small_batches(images.sparkSession)
    rows = images.select(F.col(id_col).cast("long").alias("id"), F.col(data_col).alias("data"))
    made = rows.mapInArrow(per_row(make, out), "id long, height long, width long, npy binary, dhash string, error string")
    return written(made, "tiles").withColumnRenamed("id", id_col)


def payload_image(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 bytes, filled with bytes 255 to a positive multiple of 576, as a P5 image 24 pixels wide."""
    data = (text or "").encode("utf-8")
    full = max(1, -(-len(data) // (TILE * TILE))) * TILE * TILE
    return len(data), b"P5\n%d %d\n255\n" % (TILE, full // TILE) + data.ljust(full, b"\xff")


def text_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A text's image is decoded, tiled and stored as .npy values in a written table; everything but n_bytes comes from
    the stored bytes read back.
    """
    first = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("npy", pa.binary())])

    def make_store():
        def each(doc_id, text):
            n_bytes, image = payload_image(text)
            return doc_id, n_bytes, npy_bytes(tiles_of(decode(image)))

        return each

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored = written(rows.mapInArrow(per_row(make_store, first), "doc_id long, n_bytes long, npy binary"), "text-tiles")
    last = pa.schema([(n, pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for n in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])

    def make_read():
        def each(doc_id, n_bytes, npy):
            tiles = npy_array(npy)
            payload = tiles.tobytes()
            image = tiles.reshape(-1, tiles.shape[-1])
            return (
                doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                len(npy), hashlib.sha256(npy).hexdigest(), difference_hash(image),
            )

        return each

    return stored.mapInArrow(per_row(make_read, last), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
