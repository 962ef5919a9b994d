"""Jaccard join on word n-grams by MinHash banding.

Texts with equal n-gram sets are copies and stand for one set. Signatures of
the sets are cut into bands whose number and rows are chosen for the recall
wanted at the threshold, and band hashes are shuffled. Within a bucket the full
signatures are compared, large buckets in pairs of blocks; sets that may be
similar are joined into candidate groups by spanning links only. Within a
group, again in pairs of blocks, every pair is verified on its full n-gram
sets. Blocks are bounded by rows and by bytes, so that a group is sent as seldom
as memory allows. What leaves a block is each set's number of links and a
spanning tree of small degree, so no stage makes rows for all pairs of a group,
and no node is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import checkpoint, gram_hashes, map_texts, mix, stored, word_hashes
from lociflow.llm.components import components

NGRAM = 5
THRESHOLD = 0.8
#: Share of the pairs at the threshold that must meet in a bucket.
RECALL = 0.9999
MOST_HASHES = 160
#: Rows of a block of signatures, and rows and n-grams of a block of n-gram sets (8 bytes each).
SIG_BLOCK = 8192
SET_BLOCK = 512
SET_GRAMS = 1_000_000
#: Children of a node in the trees that span what is linked.
FAN = 32
#: Keys over which a large group is dealt where its size is joined.
SALTS = 8
#: Copies of more than one in so many rows are a hot set: there are at most so many.
HOT_SETS = 1000
#: N-grams that are compared at a time.
COLUMNS = 8192


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): of those with the recall at the threshold, the most rows that `most` hashes allow."""
    best = None
    for rows in range(1, most + 1):
        meet = threshold**rows
        bands = 1 if meet >= 1 else int(np.ceil(np.log(1 - recall) / np.log(1 - meet)))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach this recall with so few hashes")
    return best


def ngram_set(text: str, n: int = NGRAM) -> np.ndarray:
    """Sorted hashes of a text's different word n-grams; a shorter text is one n-gram, one without words has none."""
    return np.unique(gram_hashes(word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)), n))


def signature(grams: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash signature: the least value under each of `hashes` multiply-add permutations."""
    mult, add = _permutations(hashes)
    out = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 512):
        part = grams[i : i + 512, None] * mult[None] + add[None]
        np.minimum(out, part.min(0), out=out)
    return out


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _PERMUTATIONS:
        rng = np.random.RandomState(20)
        draw = lambda: rng.randint(0, 1 << 32, n, np.uint64) << np.uint64(32) | rng.randint(0, 1 << 32, n, np.uint64)
        _PERMUTATIONS[n] = (draw() | np.uint64(1), draw())
    return _PERMUTATIONS[n]


_PERMUTATIONS: dict = {}


def sketches(docs: DataFrame, bands: int, rows: int, n: int = NGRAM) -> DataFrame:
    """doc_id, text_hash, key and size of the n-gram set, band hashes, and one byte of each signature value."""
    seeds = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def go(_, texts):
        out = {"key": [], "size": [], "bands": [], "sig": []}
        for t in texts:
            grams = ngram_set(t, n)
            out["key"].append(set_key(grams))
            out["size"].append(len(grams))
            s = signature(grams, bands * rows)
            h = seeds.copy()
            for r in range(rows):
                h = mix(h ^ s[r::rows][:bands])
            out["bands"].append(h.view(np.int64) if len(grams) else [])
            out["sig"].append((mix(s) >> np.uint64(56)).astype(np.uint8).tobytes())
        return out

    return map_texts(docs.where("doc_id is not null"), go, "key binary, size long, bands array<long>, sig binary", keep=("doc_id", "text_hash"))


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row that each of n rows can reach by the pairs a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    while (label[label] != label).any():
        label = label[label]
    return label


def _groups(batches, names: list[str]) -> Iterator[list[np.ndarray | pa.Array]]:
    """Runs of whole groups, by the first column of rows sorted by it; a group is never cut."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]).select(names)
        held = pa.concat_tables([held, t]) if held is not None else t
        key = held.column(0).combine_chunks().to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(key, key[-1], "left")) if np.issubdtype(key.dtype, np.number) else len(key) - int(np.argmax(key[::-1] != key[-1]))
        if 0 < last < len(key):
            yield [c.combine_chunks() for c in held.slice(0, last).columns]
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield [c.combine_chunks() for c in held.columns]


def _tree(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, child) rows of a tree over the rows of each label, of at most FAN children a node."""
    order = np.argsort(label, kind="stable")
    sorted_ = label[order]
    first = np.flatnonzero(np.diff(sorted_, prepend=sorted_[0] - 1 if len(sorted_) else 0))
    place = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    child = np.flatnonzero(place > 0)
    parent = child - place[child] + (place[child] - 1) // FAN
    return order[parent], order[child]


def _dealt(df: DataFrame, group: str, node: str, blocks) -> DataFrame:
    """Rows of groups of more than one block go once to each pair of blocks; `cell` names group and pair."""
    df = df.withColumn("__blocks", blocks)
    own = F.pmod(F.xxhash64(node), F.col("__blocks")).cast("int")
    return df.withColumn("__own", own).withColumn("__with", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).withColumn("cell", F.xxhash64(group, F.least("__own", "__with"), F.greatest("__own", "__with"))).drop("__blocks", "__with")


def _blocks(size: str, most: int):
    return F.ceil(F.col(size) / F.lit(most)).cast("int")


def candidate_links(reps: DataFrame, bands: int, rows: int, threshold: float, block: int = SIG_BLOCK) -> DataFrame:
    """(a, b): spanning links of sets that share a bucket and whose signatures agree about enough.

    A pair is dropped only if its signatures agree five standard deviations less
    than the threshold lets expect.
    """
    hashes = bands * rows
    # bytes agree by chance once in 256
    least = int(np.floor(hashes * (threshold - 5 * np.sqrt(threshold * (1 - threshold) / hashes))))
    entries = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("sets")).where("sets > 1")
    # entries of a large bucket are dealt over SALTS keys
    shared = shared.select("bucket", "sets", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    entries = entries.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    inside = entries.join(shared, ["bucket", "salt"]).join(reps.select(F.col("rep").alias("__rep"), "sig"), F.col("rep") == F.col("__rep")).select("bucket", "sets", "rep", "sig")
    dealt = _dealt(inside, "bucket", "rep", _blocks("sets", block)).select("cell", "rep", "sig")

    def go(batches):
        for cell, rep, sig in _groups(batches, ["cell", "rep", "sig"]):
            cell, rep = cell.to_numpy(), rep.to_numpy()
            s = np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(len(rep), -1)
            found_a, found_b = [], []
            a = np.arange(len(rep))
            d = 0
            while True:
                d += 1
                a = a[: np.searchsorted(a, len(rep) - d)]
                a = a[cell[a] == cell[a + d]]
                if not len(a):
                    break
                for i in range(0, len(a), 16384):
                    x = a[i : i + 16384]
                    x = x[(s[x] == s[x + d]).sum(1) >= least]
                    found_a.append(x)
                    found_b.append(x + d)
            if found_a:
                up, down = _tree(_labels(len(rep), np.concatenate(found_a), np.concatenate(found_b)))
                yield pa.RecordBatch.from_pydict({"a": rep[up], "b": rep[down]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(go, "a long, b long")


def _verify(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets are similar enough, by their full n-gram sets; memory is bounded by COLUMNS."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    grams, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    place = np.cumsum(common) - 1
    keep = common[at]
    row, at = row[keep], place[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int(common.sum()), COLUMNS):
        i, j = np.searchsorted(at, [begin, begin + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, int(common.sum()) - begin)), np.float32)
        x[row[i:j], at[i:j] - begin] = 1
        both += x @ x.T
    union = sizes[:, None] + sizes[None] - both
    alike = both + 1e-6 >= threshold * union
    np.fill_diagonal(alike, False)
    return alike


def verified_links(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): for each set of a cell its number of similar sets and a link of a spanning tree (a = b at its root).

    members: cell, own (the row's block), rep, grams. Pairs within a block
    count only in the cell of that block with itself.
    """

    def go(batches):
        for cell, own, rep, grams in _groups(batches, ["cell", "__own", "rep", "grams"]):
            cell, own, rep = cell.to_numpy(), own.to_numpy(), rep.to_numpy()
            edges = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1, append=cell[-1] + 1))
            out_a, out_b, out_n = [], [], []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if j - i < 2:
                    continue
                alike = _verify([np.frombuffer(g.as_buffer(), np.uint64) for g in grams[i:j]], threshold)
                mine = own[i:j]
                if (mine != mine[0]).any():
                    alike &= mine[:, None] != mine[None]
                n = alike.sum(1)
                if n.any():
                    up, down = _tree(_labels(j - i, *np.nonzero(alike)))
                    to = np.arange(j - i)
                    to[down] = up
                    at = np.flatnonzero(n)
                    out_a.append(rep[i:j][to[at]])
                    out_b.append(rep[i:j][at])
                    out_n.append(n[at])
            if out_a:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "links": np.concatenate(out_n).astype(np.int64)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())]))

    return members.select("cell", "__own", "rep", "grams").repartition("cell").sortWithinPartitions("cell").mapInArrow(go, "a long, b long, links long")


def _sets(drawn: DataFrame) -> tuple[DataFrame, bool]:
    """(one row for each n-gram set, whether ids repeat with other sets).

    A set is known by `node`: the least id of its rows, or, where sets share
    that id, a hash of the set's key. Copies are told apart by aggregation
    alone, so a set of very many copies is joined with nothing.
    """
    least = F.min_by(F.struct("doc_id", "text_hash", "size", "bands", "sig"), F.struct("doc_id", "text_hash")).alias("m")
    named = stored(drawn.groupBy("key").agg(least, F.count("*").alias("n_copies")).select("key", "n_copies", F.col("m.doc_id").alias("copy_id"), F.col("m.text_hash").alias("copy_hash"), "m.size", "m.bands", "m.sig"))
    again = named.groupBy(F.col("copy_id").alias("again")).agg(F.count("*").alias("sets")).where("sets > 1").drop("sets")
    if not again.limit(1).collect():
        return named.withColumn("rep", F.col("copy_id")), False
    node = F.when(F.col("again").isNotNull(), F.xxhash64("key")).otherwise(F.col("copy_id"))
    return stored(named.join(again, F.col("copy_id") == F.col("again"), "left").withColumn("rep", node).drop("again")), True


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL, sig_block: int = SIG_BLOCK, set_block: int = SET_BLOCK, set_grams: int = SET_GRAMS) -> DataFrame:
    """doc_id, class_id, copy_id, n_copies, n_links, text_hash and first of every document with an id.

    copy_id is the least id with the same n-gram set, n_copies the rows that
    share it. n_links is the number of other n-gram sets whose Jaccard
    similarity is at least the threshold. class_id is the least id that links
    lead to, and `first` marks the row (by id and hash of its text) that stands
    for its class. Null texts, empty ones and those without words are copies of
    each other and have no links. Rows without an id can't be named in a link
    and are left out; rows that repeat an id are copies if their texts are, and
    sets of their own if not. An empty table gives an empty table. doc_id must
    be an integer; other columns are not read.
    """
    bands, rows = choose_bands(threshold, recall)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    drawn = stored(sketches(source, bands, rows, n))
    total = drawn.count()
    reps, repeated = _sets(drawn)
    links = checkpoint(candidate_links(reps, bands, rows, threshold, sig_block))
    groups = components(links)
    sized = groups.join(reps.select("rep", "size", "copy_id", "key"), F.col("node") == F.col("rep")).select("component", "rep", "copy_id", "key", "size")
    sized = checkpoint(sized.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")))
    sizes = sized.groupBy("component").agg(F.count("*").alias("sets"), F.sum("size").alias("grams"))
    sizes = sizes.select("component", F.greatest(_blocks("sets", set_block), _blocks("grams", set_grams)).alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    placed = sized.join(sizes, ["component", "salt"]).select("component", "blocks", "rep", F.col("copy_id").alias("__id"), F.col("key").alias("__key"))
    wanted = source.join(placed.select(F.col("__id").alias("doc_id")), "doc_id", "left_semi")

    def full(_, texts):
        found = [ngram_set(t, n) for t in texts]
        return {"key": [set_key(g) for g in found], "grams": [g.tobytes() for g in found]}

    grams = map_texts(wanted, full, "key binary, grams binary")
    inside = placed.join(grams, (F.col("__id") == F.col("doc_id")) & (F.col("__key") == F.col("key"))).select("component", "blocks", "rep", "grams").dropDuplicates(["rep"])
    found = checkpoint(verified_links(_dealt(inside, "component", "rep", F.col("blocks")), threshold))
    counts = found.groupBy("b").agg(F.sum("links").alias("n_links"))
    classes = components(found.where("a <> b").select("a", "b"))
    whole = (
        reps.select("key", "rep", "copy_id", "copy_hash", "n_copies")
        .join(counts, F.col("rep") == F.col("b"), "left")
        .join(classes, F.col("rep") == F.col("node"), "left")
        .select("key", "copy_id", "copy_hash", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "rep").alias("class_id"))
    )
    if repeated:  # nodes are no ids: the class is named by its least id, and its first set by id and key
        whole = stored(whole)
        least = whole.groupBy(F.col("class_id").alias("__class")).agg(F.min(F.struct("copy_id", "key")).alias("__least"))
        whole = whole.join(least, F.col("class_id") == F.col("__class")).select("key", "copy_id", "copy_hash", "n_copies", "n_links", F.col("__least.copy_id").alias("class_id"), (F.col("key") == F.col("__least.key")).alias("leads"))
    else:
        whole = whole.withColumn("leads", F.col("copy_id") == F.col("class_id"))
    whole = stored(whole)
    # sets of very many copies are few, by their definition, and so are broadcast; no other key is hot
    hot = F.col("n_copies") * HOT_SETS > total
    mine = drawn.select("doc_id", "text_hash", "key")
    common = mine.join(F.broadcast(whole.where(hot)), "key")
    rare = mine.join(F.broadcast(whole.where(hot).select("key")), "key", "left_anti").join(whole.where(~hot), "key")
    first = F.col("leads") & (F.col("doc_id") == F.col("copy_id")) & (F.col("text_hash") == F.col("copy_hash"))
    return common.unionByName(rare).select("doc_id", "class_id", "copy_id", "n_copies", "n_links", "text_hash", first.alias("first"))
