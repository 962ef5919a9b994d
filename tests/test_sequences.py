import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from lociflow.functions import sequence as S
from lociflow.operators import guards, intervals, prepare, windows
from lociflow.plans.contracts import Export, Preprocessing, Tokenizer

SPANS = "array<struct<start:bigint,end:bigint,category:string>>"
SCHEMA = f"sample_id string, individual_id string, contig string, sequence string, source string, sequence_start long, mask_spans {SPANS}"


def config(least, ambiguity, size, stride, block, **kw):
    return Preprocessing(min_sequence_length=least, max_ambiguity_fraction=ambiguity, window_size=size, window_stride=stride, locus_block_size=block, **kw)


def records(spark, *rows):
    full = [(f"s{i}", f"i{i}", r.get("contig", "chr1"), r["sequence"], r.get("source", "consensus"), r.get("start", 0), r.get("spans", [])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def cut(spark, cfg, *rows):
    retained, _ = prepare.prepare(records(spark, *rows), cfg)
    return intervals.with_masks(windows.windows(windows.blocks(retained, cfg), cfg)).orderBy("sample_id", "window_start").collect()


def test_filter_reasons(spark):
    retained, rejected = prepare.prepare(records(spark, {"sequence": "acgtnn"}, {"sequence": "ACG"}, {"sequence": "NNNNTA"}), config(6, 0.34, 4, 2, 8))
    r = retained.collect()
    assert [(x.sequence, x.gc_fraction, round(x.ambiguity_fraction, 6)) for x in r] == [("ACGTNN", 0.5, 0.333333)]
    assert sorted(x.reason for x in rejected.collect()) == ["high_ambiguity", "short_sequence"]
    assert prepare.report(retained).first().mean_gc_fraction == 0.5
    assert prepare.report(retained.where("false")).first().mean_gc_fraction == 0.0


@pytest.mark.parametrize("raw,want", [("acgtRysw?-", "ACGTNNNNNN"), (" a c\n\tg t ", "ACGT"), ("ß", "NN"), ("é.日", "NNN"), ("", "")])
def test_masking(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(S.checked(S.normalize(F.col("s")))).first()[0] == want


@pytest.mark.parametrize("raw,mode", [("ACGR", "reject"), ("AC1", "mask"), ("AC*", "mask")])
def test_unsupported_bases_fail(spark, raw, mode):
    with pytest.raises(SparkRuntimeException, match="Unsupported base"):
        spark.createDataFrame([(raw,)], "s string").select(S.checked(S.normalize(F.col("s"), mode))).collect()


def test_null_sequence_is_empty(spark):
    _, rejected = prepare.prepare(spark.createDataFrame([("s", "i", "c", None, "reference", 0, [])], SCHEMA), config(1, 1.0, 1, 1, 1))
    assert rejected.first().reason == "short_sequence"


def test_mask_provenance(spark):
    got = cut(spark, config(8, 1.0, 4, 4, 8), {"sequence": "ACGTNNNN", "spans": [(4, 5, "filtered"), (5, 6, "no_call"), (6, 8, "heterozygous")]})[1]
    assert (got.unique_masked_bases, got.filtered_bases, got.no_call_bases, got.other_masked_bases) == (4, 1, 1, 2)
    assert [tuple(x) for x in got.masked_base_counts] == [("filtered", 1), ("heterozygous", 2), ("no_call", 1)]


def test_overlapping_spans(spark):
    got = cut(spark, config(8, 1.0, 4, 4, 8), {"sequence": "ACGTNNNN", "spans": [(4, 8, "filtered"), (4, 8, "no_call")]})[1]
    assert (got.unique_masked_bases, got.filtered_bases, got.no_call_bases) == (4, 4, 4)


def test_source_aware_counts(spark):
    cfg = config(6, 1.0, 6, 6, 6)
    assert cut(spark, cfg, {"sequence": "ACGNAA", "source": "reference"})[0].unique_masked_bases == 1
    assert cut(spark, cfg, {"sequence": "ACGNAA"})[0].unique_masked_bases == 0


def test_window_ambiguity_and_its_boundary(spark):
    got = cut(spark, config(8, 0.25, 4, 4, 8), {"sequence": "ACGTNNAC"})
    assert [(x.window_start, x.window_end, x.sequence) for x in got] == [(0, 4, "ACGT")]
    assert len(cut(spark, config(510, 0.5, 510, 255, 510), {"sequence": "A" * 255 + "N" * 255})) == 1


def test_bad_source_fails_even_if_the_row_is_filtered(spark):
    with pytest.raises(guards.ContractError):
        prepare.prepare(records(spark, {"sequence": "A", "source": "consensus_typo"}), config(8, 1.0, 4, 4, 8))


def test_shared_locus_has_one_split(spark):
    got = cut(spark, config(8, 0.5, 4, 2, 8), {"sequence": "ACGTACGT"}, {"sequence": "ACGTACGT"})
    assert {x.locus_id for x in got} == {"chr1:0-8"} and len({x.split for x in got}) == 1


def test_windows_and_bytes(spark):
    got = cut(spark, config(510, 1.0, 510, 255, 50_000), {"sequence": "A" * 1020})
    assert len(got) == 3 and sum(len(x.sequence) for x in got) == 1530
    assert len(cut(spark, Preprocessing(), {"sequence": "ACGT" * 12_500})) == 129


def brute(row, cfg):
    """Windows, counters and all, written as loops."""
    out, s, start = [], row["sequence"], row.get("start", 0)
    b = start // cfg.locus_block_size * cfg.locus_block_size
    while b < start + len(s):
        lo, hi = max(b, start), min(b + cfg.locus_block_size, start + len(s))
        w = lo
        while w + cfg.window_size <= hi:
            seq = s[w - start : w - start + cfg.window_size]
            if seq.count("N") / len(seq) <= cfg.max_ambiguity_fraction:
                hit = [k for a, e, k in row.get("spans", []) for _ in range(max(0, min(e, w + cfg.window_size) - max(a, w)))]
                cover = {p for a, e, _ in row.get("spans", []) for p in range(max(a, w), min(e, w + cfg.window_size))}
                out.append((w, seq, f"{row.get('contig', 'chr1')}:{b}-{b + cfg.locus_block_size}", len(cover), hit.count("filtered"), hit.count("no_call"), len(hit) - hit.count("filtered") - hit.count("no_call")))
            w += cfg.window_stride
        b += cfg.locus_block_size
    return out


def test_windows_equal_loops(spark):
    rng = random.Random(5)
    cfg = config(5, 0.4, 7, 3, 20)
    rows = [{"sequence": "".join(rng.choice("ACGTN") for _ in range(rng.randint(5, 90))), "start": rng.randint(0, 50), "spans": [(a, a + rng.randint(0, 15), rng.choice(["filtered", "no_call", "x", "y"])) for a in (rng.randint(0, 140) for _ in range(rng.randint(0, 6)))]} for _ in range(40)]
    rows = [r for r in rows if r["sequence"].count("N") / len(r["sequence"]) <= 0.4]
    got = cut(spark, cfg, *rows)
    by = {}
    for x in got:
        by.setdefault(x.sample_id, []).append((x.window_start, x.sequence, x.locus_id, x.unique_masked_bases, x.filtered_bases, x.no_call_bases, x.other_masked_bases))
    for i, r in enumerate(rows):
        assert by.get(f"s{i}", []) == brute(r, cfg)


def test_overlap_join_equals_carried_spans(spark):
    rng = random.Random(6)
    spans = [("s0", a, a + rng.randint(0, 30), rng.choice(["filtered", "no_call", "z"])) for a in (rng.randint(0, 300) for _ in range(60))]
    w = spark.createDataFrame([("s0", k, k + 16, "A" * 16) for k in range(0, 300, 8)] + [("s1", 0, 16, "A" * 16)], "sample_id string, window_start long, window_end long, sequence string")
    s = spark.createDataFrame(spans, "sample_id string, start long, end long, category string")
    o = intervals.overlap_join(w, s, ["sample_id"], 16)
    got = {(r.sample_id, r.window_start): r.covered_bases for r in intervals.union_lengths(o, ["sample_id", "window_start"]).collect()}
    for (sample, a), n in got.items():
        assert n == len({p for k, x, y, _ in spans if k == sample for p in range(max(a, x), min(a + 16, y))})
    assert got["s1", 0] == 0 and len(got) == w.count()


def test_overlap_across_splits(spark):
    bad = spark.createDataFrame([("l1", "chr1", 0, 6, "train"), ("l2", "chr1", 4, 10, "validation"), ("l3", "chr2", 4, 10, "validation")], "locus_id string, contig string, window_start long, window_end long, split string")
    assert [(r.window_start_l, r.window_start_r) for r in guards.overlaps_across_splits(bad, 8).collect()] == [(0, 4)]
    with pytest.raises(guards.SplitLeakError):
        guards.require_split_safety(bad, 8)
    guards.require_split_safety(bad.where("locus_id <> 'l2'"), 8)


def test_contracts():
    for kw in ({"window_size": 600, "locus_block_size": 512}, {"max_ambiguity_fraction": 1.5}, {"window_stride": True}, {"split_weights": (("a", 0.0),)}, {"split_weights": (("a", 1.0), ("a", 1.0))}):
        with pytest.raises(ValueError):
            Preprocessing(**kw)
    for make in (lambda: Tokenizer(trust_remote_code=1), lambda: Tokenizer(revision=""), lambda: Export(keep_hash=1), lambda: Export(format="csv"), lambda: Export(partition_keys=("x",))):
        with pytest.raises(ValueError):
            make()
