import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from lociflow.llm import fingerprints as fp

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rolled(values, k):
    """Rolling hashes: the first run in full, then each by taking out the value that leaves and adding the one that comes."""
    h = 0
    for v in values[:k]:
        h = (h * fp.BASE + v) % fp.PRIME
    out, top = [h], pow(fp.BASE, k - 1, fp.PRIME)
    for old, new in zip(values, values[k:]):
        h = ((h - old * top) * fp.BASE + new) % fp.PRIME
        out.append(h)
    return out


def plain(text, k=fp.K, w=fp.WINDOW):
    """Winnowing written down word for word."""
    words = WORDS.findall(text or "")
    if not words:
        return []
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    grams = rolled([signed(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed=42)) % fp.PRIME for x in words], min(k, len(words)))
    chosen = []
    for i in range(max(1, len(grams) - w + 1)):
        window = range(i, min(len(grams), i + w))
        best = min(window, key=lambda j: (grams[j], -j))
        if not chosen or chosen[-1] != (grams[best], best):
            chosen.append((grams[best], best))
    return chosen


def text_of(chosen):
    return " ".join(f"{h:x}@{p}" for h, p in chosen)


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_compare_equals_plain(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    got = sorted(fp.compare(docs).collect())
    for i, (r, g) in enumerate(zip(rows, got, strict=True)):
        nxt = rows[(i + 1) % len(rows)].text
        q = len(r.text) // 4
        edited = r.text[: len(r.text) - q] + nxt[:q]
        assert (g.doc_id, g.n_chars, g.edited_sha256) == (r.doc_id, len(r.text), hashlib.sha256(edited.encode()).hexdigest())
        assert g.fingerprint == text_of(plain(r.text)) and g.edited_fingerprint == text_of(plain(edited))
        assert abs(g.near_edited - like(plain(r.text), plain(edited))) < 1e-9 and abs(g.near_next - like(plain(r.text), plain(nxt))) < 1e-9


def test_rolling_hashes_of_any_length(spark):
    values = [(7 * i * i + 3) % fp.PRIME for i in range(40)]
    rows = spark.createDataFrame([(values,)], "v array<long>")
    for k in (1, 2, 3, 4, 5, 6, 7, 8, 11, 16, 23, 40):
        assert rows.select(fp.rolling(F.col("v"), k).alias("h")).first().h == rolled(values, k)


def test_rightmost_of_equal_hashes(spark):
    text = "a b c d e " * 12
    got = spark.createDataFrame([(text,)], "text string").select(fp.written(fp.winnow(F.col("text"))).alias("f")).first().f
    assert got == text_of(plain(text))


def test_a_shared_passage_is_found(spark):
    shared = " ".join(f"s{i}" for i in range(fp.K + fp.WINDOW - 1))
    rows = [(1, " ".join(f"a{i}" for i in range(50)) + " " + shared + " tail"), (2, "other " * 30 + shared)]
    a, b = (set(r.h) for r in spark.createDataFrame(rows, "doc_id long, text string").select(fp.hashes(fp.winnow(F.col("text"))).alias("h")).collect())
    assert a & b


def test_odd_rows(spark, odd, none):
    got = fp.compare(odd).collect()
    by = {r.doc_id: r for r in got}
    assert by[6].fingerprint == text_of(plain(odd.where("doc_id = 6").first().text)) and by[9].n_chars == 300_000
    assert len(got) == 11 and by[0].fingerprint == by[1].fingerprint == by[2].fingerprint == "" and by[0].n_chars == 0
    assert by[4].fingerprint == by[5].fingerprint and by[0].near_next == 1.0
    assert fp.compare(none).count() == 0
    one = fp.compare(spark.createDataFrame([(None, "one two three four")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_main_path_is_native(spark, small):
    plan = fp.compare(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
