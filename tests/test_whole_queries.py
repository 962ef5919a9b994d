"""Queries over all rows, held against loops in Python."""

import __spark_entry__ as entry
from lociflow.plans import adapters as A
from lociflow.plans.adapters import CONFIG

DATA = "/root/testdata/sf0.001"


def test_masks_of_every_block(spark):
    cut = {(r.sample_id, r.window_start): r.sequence for r in entry.queries()["sliding_windows"](spark, DATA).collect()}
    spans = {}
    for r in A.spans(spark, DATA).collect():
        spans.setdefault(r.sample_id, []).append((r.start, r.end, r.category))
    sums, unions = {}, {}
    for (i, w0), seq in cut.items():
        w1, kinds, at = w0 + CONFIG.window_size, {"filtered": 0, "no_call": 0, "other": 0}, set()
        for a, b, kind in spans.get(i, []):
            held = range(max(a, w0), min(b, w1))
            kinds[kind] += len(held)
            at.update(held)
        sums[i, w0] = tuple(kinds.values())
        unions[i, w0] = (len(at), len(at) if int(i) % 2 == 0 else max(len(at), seq.count("N")))
    assert any(w0 >= CONFIG.locus_block_size for _, w0 in cut)
    got = entry.queries()["mask_overlap"](spark, DATA).collect()
    assert len(got) == len(cut) and {(r.sample_id, r.window_start): (r.filtered_bases, r.no_call_bases, r.other_masked_bases) for r in got} == sums
    got = entry.queries()["mask_unique"](spark, DATA).collect()
    assert len(got) == len(cut) and {(r.sample_id, r.window_start): (r.covered_bases, r.masked_bases) for r in got} == unions


def test_loci_on_every_document(spark):
    text = {r.sample_id: r.sequence for r in A.raw_sequences(spark, DATA).collect()}
    lines = A.table(spark, DATA, "lineitem").select("l_orderkey", "l_partkey").collect()
    loci = {(str(r.l_orderkey % len(text)), r.l_partkey) for r in lines}
    assert len({c for c, _ in loci}) > 150
    held = {(c, p) for c, p in loci if c in text and 1 <= p <= len(text[c])}
    want = {(c, p, text[c][p - 257 : p - 1] + "T" + text[c][p : p + 255]) for c, p in held if p > 256 and p + 255 <= len(text[c])}
    assert sorted(map(tuple, entry.queries()["locus_window"](spark, DATA).collect())) == sorted(want)
    want = {(c, p, text[c][p - 1]) for c, p in held if text[c][p - 1] != "A"}
    assert want and sorted(map(tuple, entry.queries()["ref_base_mismatch"](spark, DATA).collect())) == sorted(want)


def test_order_keys_reach_documents_beyond_a_fixed_number(spark, tmp_path):
    """1,200 documents: those from id 1,000 on have spans and loci."""
    spark.range(1200).selectExpr("id AS doc_id", "repeat('ACGT', 100) AS text", "'en' AS lang", "'s' AS source").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = "id AS l_orderkey", "300L AS l_partkey", "1 AS l_linenumber", "10 AS l_quantity", "'A' AS l_returnflag"
    spark.range(2400).selectExpr(*rows).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    d = f"file://{tmp_path}"
    ids = {str(i) for i in range(1200)}
    assert {r.sample_id for r in entry.queries()["mask_overlap"](spark, d).where("filtered_bases > 0").collect()} == ids
    assert {r.contig for r in entry.queries()["ref_base_mismatch"](spark, d).collect()} == ids
