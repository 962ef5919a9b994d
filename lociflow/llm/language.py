"""Language identification by error-correcting output codes.

Each language has a codeword of bits; for each bit a linear classifier on
hashed byte n-grams (of 2 to 4 bytes) tells whether the bit is set. A document
goes to the language whose codeword has the least loss, each bit weighed by how
well its classifier does on its own sample: loss-weighted decoding. Where the
second codeword is about as near, the result is flagged ambiguous.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.llm.common import checkpoint, map_texts

UND = "und"
BUCKETS = 1 << 13
#: Bounds of the training sample: rows of each language, and rows in all.
PER_LANG = 300
MOST_ROWS = 2400
#: Below this lead of the best codeword over the second a result is ambiguous.
AMBIGUOUS = 0.1
LETTER = re.compile("[A-Za-z]")
#: Bytes to bytes for n-grams: all but letters become a space.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
BLOCK = 1 << 20


def has_letter(text: str) -> bool:
    """Whether a text has a letter of any script; signs such as superscript digits are none."""
    return bool(LETTER.search(text)) or any(map(str.isalpha, text))


def features(text: str, block: int = BLOCK) -> np.ndarray:
    """Hashed counts of byte n-grams, damped and of unit length; all zero without letters. The size of blocks changes nothing."""
    counts = np.zeros(BUCKETS, np.float64)
    data = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN)
    for begin in range(0, len(data), block):  # in blocks that share three bytes, so that every n-gram counts once
        b = np.frombuffer(data[max(0, begin - 3) : begin + block], np.uint8).astype(np.uint32)
        h = b * _MULT[0]
        for n in range(1, 4):
            if len(b) <= n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + b[n:] * _MULT[n]
            skip = min(begin, 3) - n if begin > n else 0
            counts += np.bincount((h[skip:] ^ (h[skip:] >> np.uint32(13))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    counts = np.log1p(counts).astype(np.float32)
    norm = float(np.sqrt(counts @ counts))
    return counts / norm if norm else counts


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k codewords of -1 and 1: of many drawn, those whose least distance is largest."""
    if k < 3:
        return np.array([[1, 1, 1], [-1, -1, -1]][:k], np.float32).reshape(k, 3)
    bits = max(15, 5 * int(np.ceil(np.log2(k))))
    rng, best, least = np.random.RandomState(seed), None, -1
    for _ in range(300):
        code = np.where(rng.rand(k, bits) < 0.5, -1, 1).astype(np.float32)
        same = np.abs(code.sum(0)) == k
        code[0, same] *= -1  # a bit that all share tells nothing
        d = ((bits - code @ code.T) / 2)[~np.eye(k, dtype=bool)].min()
        if d > least:
            best, least = code, d
    return best


class Coder:
    """Codewords, and the linear classifiers of their bits."""

    def __init__(self, langs: list[str]):
        self.langs, self.code = langs, codewords(len(langs))
        self.w = np.zeros((BUCKETS, self.code.shape[1]), np.float32)
        self.bias = np.zeros(self.code.shape[1], np.float32)
        self.weight = np.ones(self.code.shape[1], np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> Coder:
        """One ridge regression in its dual form for all bits; each row counts 1 / rows of its language."""
        t = self.code[y]
        share = np.sqrt(len(y) / len(self.langs) / np.bincount(y, minlength=len(self.langs))[y]).astype(np.float32)
        self.bias = np.average(t, axis=0, weights=share**2).astype(np.float32)
        xs = x
        xs *= share[:, None]
        gram = xs @ xs.T
        own = np.linalg.inv(gram + ridge * np.eye(len(y), dtype=np.float32))
        dual = own @ ((t - self.bias) * share[:, None])
        self.w = (xs.T @ dual).astype(np.float32)
        # leave-one-out margins tell how far each bit can be trusted
        left = t - self.bias - (dual / np.diag(own)[:, None]) / share[:, None] + self.bias
        wrong = np.average(left * t <= 0, axis=0, weights=share**2)
        self.weight = (np.log((1 - wrong + 0.01) / (wrong + 0.01)).clip(0.05) / 4.0).astype(np.float32)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, its score, and whether it is ambiguous, of each row."""
        margin = x @ self.w + self.bias
        loss = np.log1p(np.exp(-np.clip(3 * margin[:, None, :] * self.code[None], -30, 30)))
        loss = (loss * self.weight).sum(2) / self.weight.sum()
        order = np.argsort(loss, axis=1, kind="stable")
        p = np.exp(-6 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        first = order[:, 0]
        rows = np.arange(len(x))
        lead = loss[rows, order[:, 1]] - loss[rows, first] if len(self.langs) > 1 else np.ones(len(x))
        return first, p[rows, first], lead < AMBIGUOUS


def train(docs: DataFrame, held_out: Column, per_lang: int = PER_LANG, most: int = MOST_ROWS) -> Coder | None:
    """Fit on at most per_lang rows of each language and `most` rows in all; None without any.

    Rows are drawn by a hash of their id, so reruns agree: first ids, thinned by
    their language's size, then the texts of those chosen. The languages are
    those of the training rows with letters; each gets rows. Only beyond `most`
    languages those with the fewest rows get none, since each needs one.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out)
    counts = {r[0]: r[1] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not counts:
        return None
    per_lang = max(1, min(per_lang, most // len(counts)))
    share = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.5 * per_lang / n + 20 / n))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    ids = known.where(F.element_at(share, F.col("lang")) > draw).select("doc_id", "lang", F.xxhash64("text").alias("__hash")).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "__hash"))
    picked = checkpoint(ids.withColumn("__place", place).where(F.col("__place") <= per_lang).drop("__place"))  # at most `most` rows
    rows = docs.select("doc_id", "lang", "text").withColumn("__hash", F.xxhash64("text"))
    p = F.broadcast(picked.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), F.col("__hash").alias("__own")))
    sample = rows.join(p, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("lang") == F.col("__lang")) & (F.col("__hash") == F.col("__own"))).select("doc_id", "lang", "__hash", "text")

    def featurise(_, texts):
        out = {"at": [], "x": []}
        for t in texts:
            x = features(t)
            at = np.flatnonzero(x)
            out["at"].append(at.astype(np.uint16).tobytes())
            out["x"].append(x[at].astype(np.float16).tobytes())
        return out

    got = map_texts(sample, featurise, "at binary, x binary", keep=("doc_id", "lang", "__hash")).dropDuplicates(["doc_id", "lang", "__hash"]).collect()
    got.sort(key=lambda r: (r[1], r[0] is None, r[0], r[2]))
    langs = sorted({r[1] for r in got})
    y = np.array([langs.index(r[1]) for r in got])
    x = np.zeros((len(y), BUCKETS), np.float32)
    for row, r in zip(x, got):
        row[np.frombuffer(r[3], np.uint16)] = np.frombuffer(r[4], np.float16)
    return Coder(langs).fit(x, y)


def predict(docs: DataFrame, coder: Coder | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred, score (0 to 1) and ambiguous of every row.

    Null texts and texts without a letter are `und` with score 0, as is every
    text if nothing was learned. Equal texts get equal results; an empty table
    gives an empty table. Columns beyond `keep` and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(coder)

    def go(_, texts):
        coder = shared.value
        out = {"lang_pred": [UND] * len(texts), "score": [0.0] * len(texts), "ambiguous": [True] * len(texts)}
        if coder is None:
            return out
        at = [i for i, t in enumerate(texts) if has_letter(t)]
        for k in range(0, len(at), 256):
            part = at[k : k + 256]
            first, p, unsure = coder.decode(np.stack([features(texts[i]) for i in part]))
            for i, f, s, u in zip(part, first, p, unsure):
                out["lang_pred"][i], out["score"][i], out["ambiguous"][i] = coder.langs[f], float(s), bool(u)
        return out

    return map_texts(docs, go, "lang_pred string, score double, ambiguous boolean", keep=keep)
