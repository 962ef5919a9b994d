"""SentencePiece encoding and decoding that keeps offsets.

A text is normalised from left to right: at each place the longest prefix that
the model's compiled character map knows is replaced, other characters stay,
and the source byte of every normalised byte is recorded. The normalised text
is cut where no piece can span, each part is encoded by the library once and
remembered, and the lengths of the pieces, through the alignment, give each
piece's byte span in the source.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from lociflow.llm.common import map_texts

SPACE = "▁"
#: Parts that a worker remembers; beyond it it starts anew.
REMEMBER = 250_000
PART = re.compile(r" +[^ \n]*|[^ \n]+|\n")


class CharMap:
    """A compiled character map: a double-array trie of UTF-8 keys, and the strings that replace them."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that data has at a place."""
        units, found = self.units, None
        node = _offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1] : end]


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 1 << 9) >> 6)


class Pieces:
    """A model with its normaliser, kept by each worker."""

    _kept: dict[str, Pieces] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str):
        with open(path, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.squeeze, self.prefix = spec.remove_extra_whitespaces, spec.add_dummy_prefix
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.own = tuple(p.piece for p in proto.pieces if p.type == kinds.USER_DEFINED)
        names = [p.piece for p in proto.pieces]
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode() if p.type != kinds.CONTROL else b"" for p in proto.pieces]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        # parts are independent if no piece goes from another character to a space, or over a line end
        free = not any(SPACE in n.lstrip(SPACE) or "\n" in n for n in names)
        self.by_parts = free and self.prefix and not self.own and not self.squeeze and not proto.trainer_spec.treat_whitespace_as_suffix and spec.escape_whitespaces and self.map is None
        self.by_bytes = proto.trainer_spec.byte_fallback
        self.space = self.library.piece_to_id(SPACE)
        self.wide = np.uint16 if len(names) < 1 << 16 else np.uint32
        self.parts: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text (spaces unescaped, with the prefix), and for each of its bytes and its end the source byte."""
        data = text.encode("utf-8", "surrogatepass")
        if self.map is None and not self.squeeze:
            if not data:
                return "", np.zeros(1, np.int64)
            ahead = " " if self.prefix else ""
            return ahead + text, np.concatenate([np.zeros(len(ahead), np.int64), np.arange(len(data) + 1)])
        out, source, at = [], [], 0
        begin = 0
        while at < len(data):
            size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            found = next(((len(k.encode()), k.encode()) for k in self.own if data.startswith(k.encode(), at)), None) or (self.map.longest(data, at) if self.map else None)
            size, new = found or (size, data[at : at + size])
            for b in new:
                if self.squeeze and b == 32 and (not out or out[-1] == 32):
                    continue
                out.append(b)
                source.append(at)
            at += size
            if not out:
                begin = at
        while self.squeeze and out and out[-1] == 32:
            out.pop()
            at = source.pop()
        if out and self.prefix:
            out.insert(0, 32)
            source.insert(0, begin)
        return bytes(out).decode("utf-8", "surrogatepass"), np.array([*source, at], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, exactly as the library gives them."""
        out: list = [None] * len(texts)
        cut: list = [None] * len(texts)
        wanted: set[str] = set()
        for i, t in enumerate(texts):
            if not t:
                out[i] = np.empty(0, self.wide)
            elif not self.by_parts or SPACE in t:
                out[i] = np.array(self.library.encode(t, num_threads=1), self.wide)
            else:
                cut[i] = PART.findall(" " + t)
                wanted.update(cut[i])
        missing = wanted.difference(self.parts)
        if len(self.parts) + len(missing) > REMEMBER:
            self.parts.clear()
            missing = wanted
        self._learn(list(missing))
        of = self.parts.__getitem__
        for i, parts in enumerate(cut):
            if parts is not None:
                out[i] = np.frombuffer(b"".join(map(of, parts)), self.wide)
        return out

    def _learn(self, parts: list[str]) -> None:
        spaced = [p for p in parts if p[0] == " " and p != " "]
        for p, ids in zip(spaced, self.library.encode([p[1:] for p in spaced], num_threads=1) if spaced else ()):
            self.parts[p] = np.array(ids, self.wide).tobytes()
        # a line end keeps what follows from merging with the prefix; its ids come first
        inner = [p for p in parts if p[0] != " "]
        ahead = len(self.library.encode("\n", num_threads=1))
        for p, ids in zip(inner, self.library.encode(["\n" + p for p in inner], num_threads=1) if inner else ()):
            self.parts[p] = np.array(ids[ahead:], self.wide).tobytes()
        if " " in parts:
            self.parts[" "] = np.array([self.space], self.wide).tobytes()

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Source byte where each piece ends; it begins where the one before ends."""
        if not len(ids):
            return np.empty(0, np.int64)
        normal, source = self.normalise(text)
        sizes = self.sizes[ids].copy()
        unknown = ids == self.library.unk_id()
        if SPACE in normal:  # written in the text itself: three bytes, not a space
            sizes = self._sizes(normal, ids)
        elif unknown.any():
            sizes = self._unknown(normal, ids, unknown)
        ends = np.cumsum(sizes)
        return source[np.minimum(ends, len(source) - 1)]

    def _sizes(self, normal: str, ids: np.ndarray) -> np.ndarray:
        data, at, sizes = normal.encode("utf-8", "surrogatepass"), 0, []
        for b in ids.tolist():
            begin, piece = at, self.bytes[b]
            if len(piece) == 1 and self.library.is_byte(b):
                at += 1
            else:
                for c in piece.decode():
                    at += 3 if c == " " and data[at] != 32 else len(c.encode())
            sizes.append(at - begin)
        return np.array(sizes, np.int64)

    def _unknown(self, normal: str, ids: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        """Unknown pieces stand for all up to the next known piece."""
        data, at, sizes = normal.encode("utf-8", "surrogatepass"), 0, []
        for k, i in enumerate(ids.tolist()):
            if not unknown[k]:
                size = len(self.bytes[i])
            elif k + 1 < len(ids):
                size = max(1, data.find(self.bytes[int(ids[k + 1])], at + 1) - at)
            else:
                size = len(data) - at
            sizes.append(size)
            at += size
        return np.array(sizes, np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library's decode gives it."""
        if not self.by_bytes:
            return self.library.decode(ids.tolist())
        data = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return self.library.decode(ids.tolist())
        return text[1:] if self.prefix and text[:1] == " " else text


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The kept columns, ids, the source byte where each piece ends, and (decoded) the digest of the text decoded from the ids.

    A piece begins where the one before ends, the first at byte 0. Null and
    empty texts have no ids; equal texts get equal ids; an empty table gives an
    empty table; other columns are not read. The model file must be at the same
    path on every executor.
    """

    def go(_, texts):
        m = Pieces.of(path)
        ids = m.encode(texts)
        out = {"ids": ids, "ends": [m.spans(t, i).astype(np.int32) for t, i in zip(texts, ids)]}
        if decoded:
            out["decoded_sha256"] = [_digest(m, i) for i in ids]
        return out

    return map_texts(docs, go, "ids array<int>, ends array<int>" + (", decoded_sha256 string" if decoded else ""), keep=keep)


def _digest(m: Pieces, ids) -> str:
    return hashlib.sha256(m.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()


def round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Digests of what encode gives for each row and of the text decoded from the ids.

    Rows are treated as by encode. Ids are written in decimals with commas
    between them; spans_crc32 is of the ends as little-endian 64-bit integers.
    """

    def go(_, texts):
        m = Pieces.of(path)
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "spans_crc32": []}
        written = _written(len(m.bytes))
        for t, ids in zip(texts, m.encode(texts)):
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(written.__getitem__, ids.tolist())).encode()).hexdigest())
            out["decoded_sha256"].append(_digest(m, ids))
            out["spans_crc32"].append(zlib.crc32(m.spans(t, ids).astype("<i8").tobytes()))
        return out

    return map_texts(docs, go, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long", keep=keep)


def _written(n: int) -> list[str]:
    global _DECIMALS
    if len(_DECIMALS) < n:
        _DECIMALS = [str(i) for i in range(n)]
    return _DECIMALS


_DECIMALS: list[str] = []
