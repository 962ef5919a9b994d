import hashlib
import struct
import zlib

import numpy as np
import pytest

from lociflow.llm import media


def filtered_png(image, kinds):
    """An image written with given row filters, by the filters' definitions."""
    h, w, c = image.shape
    raw = b""
    flat = image.reshape(h, w * c).astype(int)
    for y, kind in enumerate(kinds):
        row = []
        for x in range(w * c):
            a = flat[y, x - c] if x >= c else 0
            b = flat[y - 1, x] if y else 0
            d = flat[y - 1, x - c] if y and x >= c else 0
            p = a + b - d
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            row.append((flat[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        raw += bytes([kind, *row])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return media.SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"k\0v") + chunk(b"IDAT", (z := zlib.compress(raw))[:7]) + chunk(b"IDAT", z[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_every_filter_is_undone(channels):
    rng = np.random.RandomState(channels)
    image = rng.randint(0, 256, (15, 9, channels)).astype(np.uint8)
    for kinds in ([i % 5 for i in range(15)], [2] * 15, [1] * 15, [0] * 15, [2, 2, 1, 2, 0, 2, 2, 4, 2, 2, 3, 3, 2, 1, 2], rng.randint(0, 3, 15).tolist()):
        got = media.read_png(filtered_png(image, kinds))
        assert (got.reshape(image.shape) == image).all()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 1 << 21])
def test_round_trip(n):
    data = media.payload("é" * (n // 2) + "x" * (n % 2))
    assert len(data) % 64 == 0 and len(data) >= max(64, n)
    assert media.read_png(media.write_png(data)).tobytes() == data


def test_writer_filters_rows():
    data = media.payload("".join(chr(97 + i % 26) for i in range(4000)))
    raw = zlib.decompress(media.write_png(data)[41:-16])
    assert set(raw[:: media.WIDTH + 1]) & {1, 2}


def test_damage_is_found():
    blob = media.write_png(media.payload("some text" * 50))
    for at in (3, 20, len(blob) // 2, len(blob) - 5):
        with pytest.raises(ValueError):
            media.read_png(blob[:at] + bytes([blob[at] ^ 1]) + blob[at + 1 :])
    with pytest.raises(ValueError):
        media.read_png(blob[:-12])


def test_feature_follows_low_frequencies():
    rng = np.random.RandomState(0)
    smooth = np.kron(rng.randint(0, 256, (8, 8)), np.ones((16, 16)))  # every low frequency has a share
    noisy = np.clip(smooth + rng.normal(0, 4, smooth.shape), 0, 255)
    bits = lambda f: np.unpackbits(np.frombuffer(bytes.fromhex(f), np.uint8))
    near = (bits(media.feature(smooth)) != bits(media.feature(noisy))).sum()
    far = (bits(media.feature(smooth)) != bits(media.feature(rng.randint(0, 256, (128, 128))))).sum()
    assert near < far and near <= 20


def test_cosines_by_definition():
    x = np.random.RandomState(1).rand(media.SIDE)
    want = [sum(x[j] * np.cos(np.pi / media.SIDE * (j + 0.5) * k) for j in range(media.SIDE)) for k in range(media.LOW)]
    assert np.allclose(media.COSINES @ x, want)


def test_table(odd, none):
    got = {r.doc_id: r for r in media.decode(media.encode(odd)).collect()}
    for r in odd.select("doc_id", "text").collect():
        data = media.payload(r.text)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len((r.text or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert got[4].media_sha256 == got[5].media_sha256 and media.decode(media.encode(none)).count() == 0
