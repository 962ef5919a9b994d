"""Token ids in shard files, each a wavelet matrix.

A shard holds the ids of consecutive documents. Its distinct ids, sorted, are
its alphabet; each token becomes a place in it, and the bits of the places make
the planes of a wavelet matrix: plane by plane, from the highest bit, tokens are
split stably into those with bit 0 and those with bit 1. With counts of ones at
fixed steps, the one file answers access, counting and occurrence lookup
without being unpacked, and takes log2(alphabet) bits a token and a little more.

File: magic, eight little-endian 64-bit numbers (part, shard of the part, tokens
of the part before it, documents, tokens, planes, alphabet, step), document ids,
their null flags, document ends, alphabet, then for each plane its number of
zeros, counts of ones and bits, and the crc32 of all that.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lociflow.llm.common import runs, texts_of

MAGIC = b"WVMX0001"
HEAD = struct.Struct("<8q")
#: Tokens from which a shard is closed; only a single document can make it larger than that and a run of texts.
SHARD_TOKENS = 1 << 20
#: Bits for each count of ones.
STEP = 1024
#: Words that a worker remembers.
REMEMBER = 500_000


class WordBpe:
    """A word-level BPE of the tokenizers library; ids of words are remembered.

    Texts of Latin letters are cut into words here, by the tokenizer's own
    pattern, and every word's ids come from the library's model once. Other
    texts, and those that may hold a special token, go to the library whole.
    """

    _kept: dict[str, WordBpe] = {}

    @classmethod
    def of(cls, path: str) -> WordBpe:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        plain = [chr(i) for i in range(0x180)]
        of = lambda *kinds: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] in kinds)
        letters, numbers, spaces = of("L"), of("N"), re.escape("\t\n\v\f\r \x85\xa0")
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")
        # outside it: other scripts, and the one letter whose lower case is two characters
        self.other = re.compile("[^\0-\u017f]|İ|<\\|")
        self.units = _byte_units()
        self.known = self._probe()
        self.words: dict[str, bytes] = {}

    def _probe(self) -> bool:
        """Whether cutting here gives what the library gives, on texts that try each rule."""
        tries = ["It's A  Test's 12 x²½ don'T\néÉß \xa0-- a_b 'S'D ll'll", "".join(chr(i) + "a " for i in range(0x180) if i != 0x130), "".join(chr(i) for i in range(0x180) if i != 0x130)]
        return all(self._ids(t) == self.library.encode(t, add_special_tokens=False).ids for t in tries)

    def _ids(self, text: str) -> list[int]:
        return [t.id for w in self.word.findall(text.lower()) for t in self.model.tokenize(self._mapped(w))]

    def _mapped(self, word: str) -> str:
        return word if word.isascii() and word.isalnum() else "".join(map(self.units.__getitem__, word.encode()))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, as the library gives them without special tokens."""
        out, words, model = [], self.words, self.model
        for t in texts:
            if not self.known or self.other.search(t):
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32))
                continue
            cut = self.word.findall(t.lower())
            try:
                ids = b"".join(map(words.__getitem__, cut))
            except KeyError:
                missing = set(cut).difference(words)
                if len(words) + len(missing) > REMEMBER:
                    words.clear()
                    missing = set(cut)
                for w in missing:
                    words[w] = np.array([x.id for x in model.tokenize(self._mapped(w))], np.uint32).tobytes()
                ids = b"".join(map(words.__getitem__, cut))
            out.append(np.frombuffer(ids, np.uint32))
        return out


def _byte_units() -> list[str]:
    """Characters that stand for bytes: printable Latin-1 ones for themselves, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Shard:
    """A wavelet matrix over the tokens of a shard, with the documents' ends."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC or int.from_bytes(blob[-4:], "little") != zlib.crc32(blob[:-4]):
            raise ValueError("not a whole shard file")
        self.part, self.seq, self.before, docs, self.n, planes, letters, self.step = HEAD.unpack_from(blob, 8)
        at = 8 + HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(blob, kind, n, at)
            at += got.nbytes
            return got

        self.doc_ids, self.nulls, self.ends = take("<i8", docs), take("u1", docs), take("<i8", docs)
        self.alphabet = take("<u4", letters)
        self.planes = []
        for _ in range(planes):
            zeros = int(take("<i8", 1)[0])
            self.planes.append((zeros, take("<u4", -(-self.n // self.step) + 1), take("u1", -(-self.n // 8))))

    def _rank(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        _, counts, bits = self.planes[plane]
        block = i // self.step
        begin = block * self.step // 8
        part = np.unpackbits(bits[begin : -(-i // 8)], bitorder="little")
        return int(counts[block]) + int(part[: i - block * self.step].sum())

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][2][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        """The i-th token."""
        place = 0
        for p, (zeros, _, _) in enumerate(self.planes):
            bit = self._bit(p, i)
            ones = self._rank(p, i)
            place, i = place << 1 | bit, zeros + ones if bit else i - ones
        return int(self.alphabet[place])

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int] | None:
        place = int(np.searchsorted(self.alphabet, token))
        if place == len(self.alphabet) or self.alphabet[place] != token:
            return None
        for p, (zeros, _, _) in enumerate(self.planes):
            a, b = self._rank(p, lo), self._rank(p, hi)
            lo, hi = (zeros + a, zeros + b) if place >> len(self.planes) - 1 - p & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a token stands among the tokens lo to hi."""
        got = self._range(token, lo, self.n if hi is None else hi)
        return got[1] - got[0] if got else 0

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of a kind in a plane."""
        _, counts, bits = self.planes[plane]
        marks = counts.astype(np.int64) if bit else np.minimum(np.arange(len(counts)) * self.step, self.n) - counts
        block = int(np.searchsorted(marks, k, "right")) - 1
        begin = block * self.step
        part = np.unpackbits(bits[begin // 8 : (begin + self.step) // 8], bitorder="little")[: self.n - begin]
        return begin + int(np.flatnonzero(part == bit)[k - int(marks[block])])

    def find(self, token: int, k: int = 0) -> int | None:
        """Place of the k-th occurrence of a token."""
        got = self._range(token, 0, self.n)
        if not got or not 0 <= k < got[1] - got[0]:
            return None
        i, place = got[0] + k, int(np.searchsorted(self.alphabet, token))
        for p in reversed(range(len(self.planes))):
            bit = place >> len(self.planes) - 1 - p & 1
            i = self._select(p, bit, i - self.planes[p][0] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens: from the last plane up, the two halves are dealt back by the plane's bits."""
        places = np.zeros(self.n, np.uint32)
        for p in reversed(range(len(self.planes))):
            zeros, _, packed = self.planes[p]
            bits = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, np.uint32)
            up[~bits] = places[:zeros]
            up[bits] = places[zeros:] | np.uint32(1 << len(self.planes) - 1 - p)
            places = up
        return self.alphabet[places]


def write_shard(part: int, seq: int, before: int, doc_ids: list, ids: list[np.ndarray]) -> bytes:
    """The file of a shard."""
    tokens = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    n = len(tokens)
    seen = np.zeros(int(tokens.max()) + 1 if n else 0, bool)
    seen[tokens] = True
    alphabet = np.flatnonzero(seen).astype("<u4")
    place = np.cumsum(seen, dtype=np.uint32) - 1
    planes = max(1, int(len(alphabet) - 1).bit_length()) if n else 0
    now = place[tokens].astype(np.uint16 if planes <= 16 else np.uint32) if n else tokens
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    out = [MAGIC, HEAD.pack(part, seq, before, len(doc_ids), n, planes, len(alphabet), STEP), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(), np.cumsum([len(i) for i in ids]).astype("<i8").tobytes(), alphabet.tobytes()]
    for p in range(planes):
        bits = (now >> (planes - 1 - p) & 1).astype(bool)
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros(-(-n // STEP) * STEP // 8, np.uint8)
        padded[: len(packed)] = packed
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, STEP // 64).sum(1, dtype=np.int64)
        out += [struct.pack("<q", n - int(ones.sum())), np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes(), packed.tobytes()]
        now = np.concatenate([now[~bits], now[bits]])
    blob = b"".join(out)
    return blob + zlib.crc32(blob).to_bytes(4, "little")


def _store(folder: str, name: str, blob: bytes) -> str:
    """Write a file under a name of its own and rename it, so that a task that runs twice leaves one whole file."""
    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    own = f"{base}/.{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(own) as f:
        f.write(blob)
    where.move(own, f"{base}/{name}")
    return f"{folder}/{name}"


def write(docs: DataFrame, folder: str, path: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the ids of all documents, in ascending doc_id order, as shard files; returns the tokens of each part.

    folder is a new folder that all executors share (any URI that pyarrow
    opens). Each document's ids end with end_id; null and empty texts have it
    alone. Documents without an id come first, rows that repeat an id follow
    each other by text. An empty table writes no shard. Other columns are not
    read. The result (part, tokens, shards) has a row for each task and is a
    table written beside the shards.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def go(batches):
        from pyspark import TaskContext

        part, bpe = TaskContext.get().partitionId(), WordBpe.of(path)
        end = np.array([end_id], np.uint32)
        total = seq = size = 0
        doc_ids: list = []
        ids: list[np.ndarray] = []

        def close():
            nonlocal total, seq, size, doc_ids, ids
            _store(folder, f"{part:06d}-{seq:06d}.wvm", write_shard(part, seq, total, doc_ids, ids))
            total, seq, size, doc_ids, ids = total + size, seq + 1, 0, [], []

        for b in batches:
            texts, kept = texts_of(b), b.column("doc_id").to_pylist()
            for r in runs(texts):
                for d, i in zip(kept[r], bpe.encode(texts[r])):
                    doc_ids.append(d)
                    ids.append(np.concatenate([i, end]))
                    size += len(ids[-1])
                    if size >= shard_tokens:
                        close()
        if doc_ids:
            close()
        yield pa.RecordBatch.from_pydict({"part": [part], "tokens": [total], "shards": [seq]}, schema=pa.schema([("part", pa.int64()), ("tokens", pa.int64()), ("shards", pa.int64())]))

    ordered.mapInArrow(go, "part long, tokens long, shards long").write.mode("overwrite").parquet(f"{folder}/_parts")
    return docs.sparkSession.read.parquet(f"{folder}/_parts")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shard files.

    start counts the ids of all documents before it: those of earlier tasks, of
    which there are few, from the parts table; of the task's earlier shards from
    the shard's head; of the shard from its documents' ends.
    """
    parts = spark.read.parquet(f"{folder}/_parts").where("shards > 0").orderBy("part").collect()
    begins, total = {}, 0
    for p in parts:
        begins[p[0]] = total
        total += p[1]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not parts:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(begins)
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def go(batches):
        for b in batches:
            for blob in b.column("content"):
                shard = Shard(blob.as_py())
                tokens = shard.tokens().astype("<u4", copy=False)
                starts = np.concatenate([[0], shard.ends[:-1]])
                crcs = [zlib.crc32(tokens[s:e]) for s, e in zip(starts.tolist(), shard.ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=shard.nulls.astype(bool)), pa.array(shared.value[shard.part] + shard.before + starts), pa.array(shard.ends - starts), pa.array(crcs, pa.int64())], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder)
    return files.select("content").mapInArrow(go, schema)
