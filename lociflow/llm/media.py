"""Media columns: lossless PNG images in binary columns, and hashes of them.

The writer makes a PNG of 8-bit grey samples: signature, IHDR, zlib-compressed
IDAT chunks of filtered rows, IEND, each chunk with its crc. The reader tests
signature, chunk checksums and sizes, inflates and undoes the row filters with
numpy. The feature is a hash of the low-frequency coefficients of a cosine
transform over an image shrunk to 32 x 32 by block means.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from lociflow.llm.common import map_texts

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of one row of samples; payloads are multiples of it.
WIDTH = 64
LEVEL = 1
#: Largest IDAT chunk.
CHUNK = 1 << 20
#: Side of the shrunken image, and coefficients kept along each axis.
SIDE, LOW = 32, 8


def payload(text: str | None) -> bytes:
    """UTF-8 of the text and zero bytes up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(data: bytes, width: int = WIDTH) -> bytes:
    """A grey PNG whose samples are data, a positive multiple of width.

    Each row takes the filter (none, sub or up) with the least sum of absolute
    signed values, the first of equal ones.
    """
    height, rest = divmod(len(data), width)
    if rest or not height:
        raise ValueError("samples must fill whole rows")
    image = np.frombuffer(data, np.uint8).reshape(height, width)
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = image
    least = _cost(image)
    for kind, shifted in ((1, (image[:, 1:], image[:, :-1])), (2, (image[1:], image[:-1]))):
        made = image.copy()
        made[(slice(None), slice(1, None)) if kind == 1 else (slice(1, None),)] = shifted[0] - shifted[1]
        cost = _cost(made)
        better = cost < least
        rows[better, 0], rows[better, 1:] = kind, made[better]
        least = np.minimum(least, cost)
    packed = zlib.compress(rows.tobytes(), LEVEL)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _cost(rows: np.ndarray) -> np.ndarray:
    return np.abs(rows.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64)


def read_png(blob: bytes) -> np.ndarray:
    """Samples of a PNG of 8-bit grey, RGB or RGBA without interlace; ValueError if it is damaged."""
    if blob[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(blob) and not ended:
        if at + 12 > len(blob):
            raise ValueError("a chunk is cut off")
        size, kind = struct.unpack(">I4s", blob[at : at + 8])
        data = blob[at + 8 : at + 8 + size]
        if len(data) < size or blob[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(data, zlib.crc32(kind))):
            raise ValueError(f"checksum of chunk {kind!r} does not hold")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("only 8-bit grey, RGB and RGBA without interlace")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(f"damaged samples: {e}") from None
    stride = width * channels
    if len(raw) != height * (stride + 1):
        raise ValueError("wrong number of samples")
    rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    return unfilter(rows[:, 0], rows[:, 1:], channels).reshape((height, width, channels)[: 3 if channels > 1 else 2])


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters 0 to 4 (none, sub, up, average, Paeth), modulo 256.

    Sub rows are sums along themselves. Up rows are sums down from the last row
    of another kind: the sum from the top, less the sum down to before that row.
    Average and Paeth samples need the ones to their left, above and between;
    with such rows the samples are undone along anti-diagonals, in each of which
    none needs another.
    """
    if not kinds.any():
        return rows
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    if (kinds > 2).any():
        return _undo_diagonals(kinds, rows, step)
    out = rows.copy()
    for c in range(step):
        sub = kinds == 1
        out[sub, c::step] = np.add.accumulate(out[sub, c::step], axis=1, dtype=np.uint8)
    _undo_up(kinds, out)
    return out


def _undo_up(kinds: np.ndarray, out: np.ndarray) -> None:
    """Undo the up rows in place, where the others are done."""
    if not (kinds == 2).any():
        return
    base = kinds != 2
    base[0] = True  # above the top row all is zero
    last = np.maximum.accumulate(np.where(base, np.arange(len(base)), 0))
    total = np.add.accumulate(out, axis=0, dtype=np.uint8)
    above = np.vstack([np.zeros_like(total[:1]), total])[last]
    out[...] = total - above


def _undo_diagonals(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undo any filters, a whole anti-diagonal of samples at a time."""
    height, width = len(rows), rows.shape[1] // step
    raw = rows.reshape(height, width, step)
    done = np.zeros((height + 1, width + 1, step), np.int16)  # a row and a column of zeros lie around
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height - 1, d) + 1)
        x = d - y
        left, up, corner = done[y + 1, x], done[y, x + 1], done[y, x]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        kind = kinds[y][:, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, left + up >> 1, paeth], np.int16(0))
        done[y + 1, x + 1] = raw[y, x] + guess & 255
    return done[1:, 1:].astype(np.uint8).reshape(rows.shape)


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None] * np.arange(k)[:, None])


COSINES = _cosines(SIDE, LOW)


def shrink(image: np.ndarray) -> np.ndarray:
    """Block means of a grey image on a 32 x 32 grid; small images repeat rows and columns."""
    grid = image.astype(np.float64) if image.ndim == 2 else image[..., :3].astype(np.float64).mean(2)
    for axis in (0, 1):
        n = grid.shape[axis]
        edge = np.arange(SIDE + 1) * n // SIDE
        if n >= SIDE:
            sizes = np.diff(edge)
            grid = np.add.reduceat(grid, edge[:-1], axis=axis) / (sizes[:, None] if axis == 0 else sizes)
        else:
            grid = np.take(grid, edge[:-1], axis=axis)
    return grid


def feature(image: np.ndarray) -> str:
    """64 bits in hex: which low-frequency cosine coefficients lie above their median; the mean counts as above."""
    low = COSINES @ shrink(image) @ COSINES.T
    flat = np.round(low.ravel(), 6)
    bits = flat > np.median(flat[1:])
    bits[0] = True
    return np.packbits(bits).tobytes().hex()


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_bytes and media (PNG) of every row.

    Null and empty texts become one row of zero samples; equal texts get equal
    media; an empty table gives an empty table; other columns are not read.
    """

    def go(_, texts):
        data = [payload(t) for t in texts]
        return {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "media": [write_png(d) for d in data]}

    return map_texts(docs, go, "n_bytes long, media binary", keep=keep)


def decode(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The kept columns and what the stored bytes hold, read back by the reader of this module.

    A null medium has nulls; a damaged one fails the job with the reader's reason.
    """
    import pyarrow as pa

    from lociflow.llm.common import _arrow

    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    out_schema = _arrow(media, list(keep), schema)

    def go(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = []
                for v in part.column("media"):
                    blob = v.as_py()
                    if blob is None:
                        rows.append((None,) * 6)
                        continue
                    image = read_png(blob)
                    data = image.tobytes()
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(image)))
                made = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), list(out_schema)[len(keep) :])]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, schema=out_schema)

    kept = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    return media.select(*keep, "media").mapInArrow(go, f"{kept}, {schema}")
