"""Document fingerprints by winnowing, with DataFrame functions only.

Every word is hashed once. The hash of k words in a row is the rolling one,

    h(i) = sum over j < k of word(i + j) * BASE ** (k - 1 - j)   mod PRIME,

made for all places at once: runs of 1, 2, 4, ... words are joined from runs of
half their length by one multiplication, so a place costs about log k steps and
no word is hashed again. (Subtracting the word that leaves, place by place,
gives the same number; as an expression over an array it would copy the array
at each step.) Of each window of w such hashes the least is chosen, the
rightmost among equal ones, and kept with its position. Two texts that share
k + w - 1 words in a row share a fingerprint, whatever surrounds them, and no
match shorter than k words is seen.

A hash and its position are one positive long: 31 bits of hash above 32 bits
that fall as the position grows, so the least long is the least hash and, among
equal ones, the rightmost. Minima over w come from minima over halves of w.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociflow.llm.common import checkpoint

K = 5
WINDOW = 16
SPACE = "\t\n\x0b\x0c\r "
LAST = (1 << 32) - 1
PRIME = (1 << 31) - 1
BASE = 1_000_003


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once a row."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Words between ASCII white space; none for null and blank texts."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def rolling(values: Column, k: int) -> Column:
    """Rolling hashes of the runs of k values, from the values (an array of at least k)."""

    def join(a: Column, n: int, b: Column, m: int) -> Column:
        """Runs of n + m from runs of n, and runs of m that begin n later."""
        places = F.size(b) - n
        return F.zip_with(F.slice(a, 1, places), F.slice(b, n + 1, places), lambda x, y: (x * F.lit(pow(BASE, m, PRIME)) + y) % F.lit(PRIME))

    def grow(power: Column, n: int, done: Column | None, m: int) -> Column:
        """power: runs of n; done: runs of the low m values of k's binary form that are joined already."""
        rest = k // n
        if rest & 1:
            done, m = (power, n) if done is None else (join(power, n, done, m), n + m)
        if rest == 1:
            return done
        double = lambda d: _let(join(power, n, power, n), lambda p: grow(p, 2 * n, d, m))
        return double(None) if done is None else _let(done, double)

    return _let(values, lambda v: grow(v, 1, None, 0))


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The chosen hashes with their positions, in order of position; window is a power of two.

    A text of fewer than k words has one hash, of them all; fewer hashes than a
    window are one window; a text without words has none.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("window must be a power of two")

    def grams(values: Column) -> Column:
        short = F.aggregate(values, F.lit(0).cast("long"), lambda h, v: (h * F.lit(BASE) + v) % F.lit(PRIME))
        return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).when(F.size(values) < k, F.array(short)).otherwise(rolling(values, k))

    def packed(hashed: Column) -> Column:
        return F.transform(hashed, lambda h, i: h * F.lit(1 << 32) + (F.lit(LAST) - i.cast("long")))

    def least(step: int):
        return lambda a: F.zip_with(a, F.slice(a, step + 1, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.least(x, y))

    def chosen(g: Column) -> Column:
        out, step = g, 1
        while step < window:
            out, step = _let(out, least(step)), 2 * step
        return F.array_distinct(F.slice(out, 1, F.greatest(F.size(g) - (window - 1), F.lit(1))))

    values = F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))
    return _let(packed(_let(values, grams)), chosen)


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, 32)))


def written(chosen: Column) -> Column:
    """Fingerprint as text: hash in hex and position of the first word, in order of position."""
    return F.concat_ws(" ", F.transform(chosen, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 32))), F.lit("@"), (F.lit(LAST) - x.bitwiseAND(F.lit(LAST))).cast("string"))))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two lists of hashes; two empty ones are alike."""
    shared, total = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(total == 0, 1.0).otherwise(shared / total)


def fingerprint(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id and chosen hashes of every row; null texts, empty and blank ones have none."""
    return docs.select("doc_id", winnow(F.col("text"), k, window).alias("chosen"))


def before(docs: DataFrame) -> DataFrame:
    """(doc_id, prev_id, prev_n): the document before in ascending doc_id order and its code points.

    The one before the first is the last. Ids alone are ordered, in ranges; what
    goes over a range's edge is one row for each range.
    """
    ids = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    # the thin rows are written first, so that texts are not read again to find the ranges
    ids = checkpoint(checkpoint(ids).repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    ends = [r[0] | {"part": r[1]} for r in ((r[1].asDict(), r[0]) for r in ids.groupBy("part").agg(F.max(F.struct("doc_id", "n"))).orderBy("part").collect())]
    edges = [(e["part"], ends[i - 1]["doc_id"], ends[i - 1]["n"]) for i, e in enumerate(ends)]
    if not edges:
        return ids.select("doc_id", F.col("doc_id").alias("prev_id"), F.col("n").alias("prev_n"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = docs.sparkSession.createDataFrame(edges, f"part int, edge_id {kind}, edge_n long")
    own = Window.partitionBy("part").orderBy("doc_id")
    row = ids.withColumn("at", F.row_number().over(own)).withColumn("lag_id", F.lag("doc_id").over(own)).withColumn("lag_n", F.lag("n").over(own))
    joined = row.join(F.broadcast(first), "part")  # one row for each range
    return joined.select("doc_id", F.when(F.col("at") == 1, F.col("edge_id")).otherwise(F.col("lag_id")).alias("prev_id"), F.when(F.col("at") == 1, F.col("edge_n")).otherwise(F.col("lag_n")).alias("prev_n"))


def compare(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The last quarter of the edited text, in code points and rounded down, is
    replaced by the first as many of the next document; after the last comes
    the first, and a single document follows itself. Null texts are empty.
    Rows that repeat an id all stand before the next id; where they differ in
    text, the one whose text has the least hash is the next document of the id
    before. Other columns are not read; an empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"), winnow(text, k, window).alias("chosen"))
    ahead = before(docs).select(F.col("doc_id").alias("__id"), "prev_id", "prev_n")
    nexts = own.join(ahead, F.col("doc_id").eqNullSafe(F.col("__id"))).select("prev_id", F.left("text", F.floor(F.col("prev_n") / 4).cast("int")).alias("head"), hashes(F.col("chosen")).alias("next_hashes"))
    nexts = nexts.groupBy("prev_id").agg(F.min_by(F.struct("head", "next_hashes"), F.xxhash64("head", "next_hashes")).alias("next"))
    both = own.join(nexts, F.col("doc_id").eqNullSafe(F.col("prev_id")))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - quarter), F.left("next.head", quarter))
    step = both.select("doc_id", n.cast("long").alias("n_chars"), "chosen", F.col("next.next_hashes").alias("next_hashes"), edited.alias("edited"))
    step = step.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "chosen", winnow(F.col("edited"), k, window).alias("edited_chosen"), "next_hashes")
    mine = hashes(F.col("chosen"))
    return step.select(
        "doc_id", "n_chars", "edited_sha256",
        written(F.col("chosen")).alias("fingerprint"), written(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(mine, hashes(F.col("edited_chosen"))).alias("near_edited"), likeness(mine, F.col("next_hashes")).alias("near_next"),
    )
