"""Quality by a factorisation machine.

Fields of a document: hashed words (one of 2**16 buckets each, together of unit
length), structure statistics (each in one of a few bins) and metadata columns
(in bins by power of two). The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

where the sum-of-squares identity gives all pairwise interactions in time
linear in the number of features.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import Rows, labelled_sample, logistic, map_texts

BUCKETS = 1 << 16
BINS = 12
RANK = 8
#: Bound of the training sample: rows of each label.
PER_CLASS = 2000
#: Words are counted in blocks of about this many characters, so that a long text's words aren't all held at once.
BLOCK = 1 << 20
SPACE = re.compile(r"\s")

STATS = ("length", "upper", "digit", "symbol", "pipe", "mean_word", "distinct", "repeat_next", "repeat_line", "line_words", "non_ascii", "top_word")

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[9, 10, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 5
_CLASS[[ord("|")]] = 7
_CLASS[[i for i in range(33, 127) if _CLASS[i] == 0]] = 6
_CLASS[128:] = 8


class Words(dict):
    """Bucket of a word, remembered; forgets all beyond a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = got = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return got


def blocks(text: str, size: int = BLOCK):
    """Parts of a text, each cut at the first white space after `size` characters, so that no word is cut."""
    begin = 0
    while len(text) - begin > size and (m := SPACE.search(text, begin + size)):
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:]


def features(text: str, meta: list, words: Words, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one document's features; the size of blocks changes nothing."""
    counts: Counter = Counter()
    n = same = chars = 0
    last = None
    for b in blocks(text, size):
        w = b.split()
        if not w:
            continue
        counts.update(w)
        n += len(w)
        chars += sum(map(len, w))
        same += sum(map(str.__eq__, w, w[1:])) + (last == w[0])
        last = w[-1]
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=9)
    total, ink = max(1, kinds.sum()), max(1, kinds.sum() - kinds[4])
    lines = text.split("\n")
    stats = (
        np.log2(1 + n) / 16,
        kinds[1] / max(1, kinds[1] + kinds[2]),
        min(1.0, 5 * kinds[3] / ink),
        min(1.0, 4 * kinds[6] / ink),
        min(1.0, 4 * kinds[7] / ink),
        min(1.0, chars / max(1, n) / 16),
        len(counts) / max(1, n),
        same / max(1, n - 1),
        1 - len(set(lines)) / len(lines),
        min(1.0, n / len(lines) / 200),
        kinds[8] / total,
        max(counts.values(), default=0) / max(1, n),
    )
    at = [BUCKETS + k * BINS + min(BINS - 1, int(np.sqrt(max(0.0, s)) * BINS)) for k, s in enumerate(stats)]
    first = BUCKETS + len(STATS) * BINS
    at += [first + k * 64 + (63 if v is None or v != v else int(min(62.0, np.log2(1 + abs(float(v)))))) for k, v in enumerate(meta)]
    hashed = np.fromiter({words[w] for w in counts}, np.int64)
    values = np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed))), np.float32)
    return np.concatenate([hashed, at]), np.concatenate([values, np.ones(len(at), np.float32)])


class Machine:
    """A factorisation machine of the second order."""

    def __init__(self, n: int, rank: int = RANK, seed: int = 7):
        self.w0 = np.float32(0)
        self.w = np.zeros(n, np.float32)
        self.v = np.random.RandomState(seed).normal(0, 0.05, (n, rank)).astype(np.float32)

    def raw(self, rows: Rows) -> np.ndarray:
        """Scores before the sigmoid, by the sum-of-squares identity."""
        starts = rows.ptr[:-1]
        vx = self.v[rows.idx] * rows.val[:, None]
        linear = np.add.reduceat(self.w[rows.idx] * rows.val, starts)
        return self.w0 + linear + 0.5 * (np.add.reduceat(vx, starts) ** 2 - np.add.reduceat(vx**2, starts)).sum(1)

    def fit(self, rows: Rows, y: np.ndarray, epochs: int = 15, rate: float = 0.08, decay: float = 1e-4, batch: int = 64, seed: int = 3) -> Machine:
        """Adagrad on logistic loss; the order is seeded, so reruns agree."""
        rng = np.random.RandomState(seed)
        g0, gw, gv = 1e-6, np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6)
        for _ in range(epochs):
            order = rng.permutation(rows.n)
            for i in range(0, rows.n, batch):
                part = rows.take(which := order[i : i + batch])
                starts, row = part.ptr[:-1], np.repeat(np.arange(part.n), np.diff(part.ptr))
                vx = self.v[part.idx] * part.val[:, None]
                sums = np.add.reduceat(vx, starts)
                raw = self.w0 + np.add.reduceat(self.w[part.idx] * part.val, starts) + 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(1)
                d = ((logistic(raw) - y[which]) / part.n).astype(np.float32)
                used, inv = np.unique(part.idx, return_inverse=True)
                dx = d[row] * part.val
                dw = np.bincount(inv, dx, len(used)).astype(np.float32) + decay * self.w[used]
                dv = np.zeros((len(used), self.v.shape[1]), np.float32)
                each = dx[:, None] * (sums[row] - vx)
                for f in range(dv.shape[1]):
                    dv[:, f] = np.bincount(inv, each[:, f], len(used))
                dv += decay * self.v[used]
                g0 += float(d.sum()) ** 2
                gw[used] += dw**2
                gv[used] += dv**2
                self.w0 -= np.float32(rate * d.sum() / np.sqrt(g0))
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
        return self


def train(docs: DataFrame, labels: DataFrame, held_out: Column, metadata: tuple[str, ...] = (), label: str = "quality", per_class: int = PER_CLASS) -> Machine:
    """Fit on at most 2 * per_class labelled rows, whose features are made on the executors.

    Both labels weigh alike, however rare one is. No labelled rows, or none of
    one label, give a machine that knows little beyond the prior.
    """
    sample = labelled_sample(docs, labels, label, held_out, per_class, also=metadata)
    keep = ("doc_id", "label", *metadata)
    words = Words()

    def featurise(kept, texts):
        got = [features(t, [k[i].as_py() for k in kept[2:]], words) for i, t in enumerate(texts)]
        return {"idx": [g[0].astype(np.int32).tobytes() for g in got], "val": [g[1].tobytes() for g in got]}

    rows = sorted(map_texts(sample, featurise, "idx binary, val binary", keep=keep).select("doc_id", "label", "idx", "val").collect(), key=lambda r: (r[0], r[2], r[3]))
    machine = Machine(BUCKETS + len(STATS) * BINS + 64 * len(metadata))
    y = np.array([r[1] for r in rows], np.float32)
    if rows:
        machine.fit(Rows([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows]), y)
    return machine


def score(docs: DataFrame, machine: Machine, metadata: tuple[str, ...] = (), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and score (0 to 1) of every row.

    Null and empty texts are scored by their structure alone; null metadata and
    NaN have a bin of their own; repeated rows get equal scores; an empty table gives an
    empty table. Columns beyond `keep`, metadata and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    words = Words()
    extra = tuple(f"__meta{i}" for i in range(len(metadata)))

    def go(kept, texts):
        meta = kept[len(keep) :]
        rows = Rows([features(t, [m[i].as_py() for m in meta], words) for i, t in enumerate(texts)])
        return {"score": logistic(shared.value.raw(rows).astype(np.float64))}

    return map_texts(docs.select(*keep, "text", *(F.col(m).alias(e) for m, e in zip(metadata, extra))), go, "score double", keep=(*keep, *extra)).drop(*extra)
