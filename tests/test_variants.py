import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.functions import variants as V
from lociflow.operators import effects, genotypes, guards
from lociflow.plans import genotype
from lociflow.sources import fasta, tables, vcf

CASES = [("0/0", 0), ("0/1", 1), ("1|0", 1), ("1/1", 2), ("./.", -1), ("0/.", -1), ("", -1), (None, -1), ("1", -1), ("0/1/1", -1), ("1/2", 3)]


def write_fasta(path, contigs):
    text = "".join(f">{c} a reference\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for c, s in contigs.items())
    if str(path).endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return f"file://{path}"


def write_vcf(path, records, samples=("cat_1",), header="##contig=<ID=chr1,length=1024>\n"):
    rows = "".join("\t".join(map(str, (c, p, ".", r, a, 50, f, ".", fmt, *fields))) + "\n" for c, p, r, a, f, fmt, *fields in records)
    path.write_text("##fileformat=VCFv4.2\n##reference=x.fa\n" + header + "\t".join(("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples)) + "\n" + rows)
    return f"file://{path}"


@pytest.fixture
def found(spark, tmp_path):
    reference = write_fasta(tmp_path / "r.fa", {"chr1": "A" * 1024})

    def run(*records, samples=("cat_1",), wanted=None, **kw):
        path = write_vcf(tmp_path / "v.vcf", records, samples, **kw)
        w, absent = genotype.finetune_windows(spark, path, reference, wanted)
        return [(r.locus_pos, r.sequence[256], r.is_heterozygous, len(r.sequence), r.sample_id) for r in w.orderBy("line_no", "sample_id", "allele_no").collect()], absent

    return run


def rec(pos, ref="A", alt="T", filt="PASS", gt="1/1", contig="chr1", fmt="GT"):
    return (contig, pos, ref, alt, filt, fmt, gt)


def test_window_for_each_carried_allele(found):
    assert found(rec(300))[0] == [(300, "T", False, 512, "cat_1")]
    for gt in ("0/1", "0|1", "1|0"):
        assert [x[1:3] for x in found(rec(300, gt=gt))[0]] == [("A", True), ("T", True)]
    got = found(rec(260, gt="0/1"), rec(400, alt="G"), rec(500, gt="0/0"))[0]
    assert [x[:2] for x in got] == [(260, "A"), (260, "T"), (400, "G")]


def test_records_without_windows(found):
    assert found(rec(300, gt="0/0"), rec(301, alt="AT"), rec(302, ref="AT"), rec(303, alt="T,G", gt="1/2"), rec(304, alt="T,G"), rec(305, filt="LowQual"), rec(306, gt="./."), rec(307, alt="."), rec(1), rec(1024))[0] == []


@pytest.mark.parametrize("bad", [rec(300, contig="chrZ"), rec(300, contig="chrZ", filt="LowQual"), rec(300, gt="1/?"), rec(300, gt="0/1/1"), rec(300, fmt="DP"), rec(300, alt="R"), rec(300, ref="C"), ("chr1", 300, "A", "T", "PASS", "GT")])
def test_contract_breaks_fail(found, bad):
    with pytest.raises(guards.ContractError):
        found(bad)


def test_a_filtered_row_with_bad_alleles_is_dropped(found):
    assert found(rec(300, alt="R", filt="LowQual"))[0] == []


def test_many_samples_and_an_absent_one(found):
    got, absent = found(("chr1", 300, "A", "T", "PASS", "DP:GT", "9:1/1", "9:0/1"), samples=("cat_1", "cat_2"), wanted=["cat_1", "cat_99"])
    assert [x[4] for x in got] == ["cat_1"] and absent == ["cat_99"]


def test_header_contig_outside_the_reference(found):
    with pytest.raises(guards.ContractError):
        found(rec(300), header="##contig=<ID=chr9,length=5>\n")


def test_genotype_codes(spark):
    df = spark.createDataFrame(CASES, "gt string, want int")
    assert all(r.g == r.want for r in df.select("want", V.encoded(F.col("gt")).alias("g")).collect())
    assert [r[0] for r in spark.createDataFrame([("1/?",), ("0/1",), (".",)], "gt string").select(V.malformed_gt(F.col("gt"))).collect()] == [True, False, False]


def test_evidence(spark):
    df = spark.createDataFrame([("chr1 Panthera-ONCA v2",), ("panthera leo",)], "h string")
    assert [r[0] for r in df.select(V.evidence_matches(F.col("h"), ("panthera", "onca"), ("leo",))).collect()] == [True, False]


def test_fasta_scans(spark, tmp_path):
    for name in ("a.fa", "b.fa.gz"):
        path = write_fasta(tmp_path / name, {"c1": "ACGT" * 40, "c2": "TT"})
        assert {r.contig: r.sequence for r in fasta.scan(spark, path).collect()} == {"c1": "ACGT" * 40, "c2": "TT"}
        assert {r.contig for r in fasta.headers(spark, path).collect()} == {"c1", "c2"}
    odd = tmp_path / "odd.fa"
    odd.write_text("\n  \n>c1 x\r\nAC\r\n\r\n GT \r\n>c2\n>c1 y\nTTT")
    got = fasta.scan(spark, f"file://{odd}").collect()
    assert sorted((r.contig, r.header, r.sequence) for r in got) == [("c1", "c1 x", "ACGT"), ("c1", "c1 y", "TTT"), ("c2", "c2", "")]
    assert {r.contig: r.sequence for r in fasta.scan(spark, f"file://{odd}", strict=False).collect()} == {"c1": "TTT", "c2": ""}
    bad = tmp_path / "bad.fa"
    bad.write_text("ACGT\n>c1\nAC\n")
    with pytest.raises(guards.ContractError):
        fasta.scan(spark, f"file://{bad}")
    assert [(r.contig, r.sequence) for r in fasta.scan(spark, f"file://{bad}", strict=False).collect()] == [("c1", "AC")]
    (tmp_path / "none.fa").write_text("\n")
    with pytest.raises(guards.ContractError):
        fasta.scan(spark, f"file://{tmp_path}/none.fa")


def test_tiles_hold_every_window(spark):
    rng = np.random.RandomState(0)
    seq = "".join(rng.choice(list("ACGT"), 3000))
    ref = spark.createDataFrame([("c", seq)], "contig string, sequence string")
    from lociflow.operators.variants import with_reference

    loci = spark.createDataFrame([("c", p, "T") for p in range(1, 3001)], "contig string, pos long, alt string")
    p = with_reference(loci, fasta.tiles(ref, 600, 512), 600)
    got = p.select("pos", "base", V.centred_window(F.col("bases"), F.col("tile_start"), F.col("pos"), F.col("alt"), F.col("contig_length")).alias("w")).collect()
    assert len(got) == 3000
    for r in got:
        assert r.base == seq[r.pos - 1]
        i = r.pos - 1
        assert r.w == (seq[i - 256 : i] + "T" + seq[i + 1 : i + 256] if i >= 256 and i + 255 < 3000 else None)


def write_metadata(path, rows):
    path.write_text("sample_id,individual_id,biome_population_label,latitude,longitude,extra\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    return f"file://{path}"


def test_metadata(spark, tmp_path):
    path = write_metadata(tmp_path / "m.csv", [("a", "i1", "Amazon", 1, 2, "x"), ("a", "i2", "Cerrado", 3, 4, "y"), ("", "i3", "Amazon", 0, 0, "z")])
    assert [(r.sample_id, r.individual_id, r.latitude, r.extra) for r in tables.metadata(spark, path).collect()] == [("a", "i2", 3.0, "y")]
    with pytest.raises(guards.ContractError):
        tables.metadata(spark, write_metadata(tmp_path / "n.csv", [("a", "i1", "Amazon", "north", 2, "x")]))
    (tmp_path / "o.csv").write_text("sample_id\na\n\n b \na\n")
    assert tables.sample_list(spark, f"file://{tmp_path}/o.csv") == ["a", "b", "a"]
    with pytest.raises(guards.ContractError):
        tables.metadata(spark, f"file://{tmp_path}/o.csv")


def test_matrix_and_frequencies(spark, tmp_path):
    calls = [("chr1", 10, "A", "T", "PASS", "GT", "0/0", "0/1", "1/1"), ("chr1", 20, "A", "G", ".", "GT:DP", "./.:1", "1|1:2", "0/1:3"), ("chr1", 30, "A", "R", "PASS", "GT", "0/1", "0/1", "0/1"), ("chr1", 40, "A", "T", "LowQual", "GT", "1/1", "1/1", "1/1"), ("chr1", 50, "A", "T", "PASS", "DP", "1", "1", "1")]
    v = write_vcf(tmp_path / "v.vcf", calls, ("a", "b", "zz"))
    m = write_metadata(tmp_path / "m.csv", [("a", "ia", "Amazon", 1, 2, ""), ("b", "ib", "Cerrado", 3, 4, ""), ("q", "iq", "Amazon", 3, 4, "")])
    cells, matched = genotype.matrix(spark, v, m)
    assert {r.sample_id for r in matched.collect()} == {"a", "b"}
    assert {r.sample_id: r.genotypes for r in genotypes.dense_rows(cells).collect()} == {"a": [0, -1], "b": [1, 2]}
    assert {r.locus_key: (r.frequency, r.known) for r in genotypes.allele_frequency(cells).collect()} == {"chr1:10": (0.25, 2), "chr1:20": (1.0, 1)}
    loo = {(r.sample_id, r.locus_key): r.frequency for r in genotypes.leave_one_out_frequency(cells).collect()}
    assert loo == {("a", "chr1:10"): 0.5, ("b", "chr1:10"): 0.0, ("a", "chr1:20"): 1.0, ("b", "chr1:20"): 0.0}
    filled = genotypes.imputed(genotypes.leave_one_out_frequency(cells), 3)
    assert [r.g_imputed for r in filled.where("g IS NULL").collect()] == [2]
    other = write_metadata(tmp_path / "x.csv", [("nobody", "i", "Amazon", 1, 2, "")])
    with pytest.raises(guards.ContractError):
        genotype.matrix(spark, v, other)


def test_imputation_follows_the_frequency(spark):
    rows = [(f"i{k}", "l", None, 0.3) for k in range(4000)]
    df = spark.createDataFrame(rows, "individual_id string, locus_key string, g int, frequency double")
    got = [r.g_imputed for r in genotypes.imputed(df, 1).collect()]
    assert abs(np.mean(got) - 0.6) < 0.05 and abs(np.var(got) - 0.42) < 0.05
    assert got == [r.g_imputed for r in genotypes.imputed(df, 1).collect()] != [r.g_imputed for r in genotypes.imputed(df, 2).collect()]


def test_scores_and_failures(spark):
    def scorer(refs, alts):
        if any(a == "bad" for a in alts):
            raise RuntimeError
        return np.array([len(a) - len(r) for r, a in zip(refs, alts)], float)

    df = spark.createDataFrame([("k1", "A", "TTT"), ("k2", "A", "bad"), ("k3", None, "T"), ("k4", "AA", "T")], "locus_key string, ref_window string, alt_window string")
    s = effects.score(df, scorer)
    assert {r.locus_key: (r.score, r.failed) for r in s.collect()} == {"k1": (2.0, False), "k2": (0.0, True), "k3": (0.0, True), "k4": (-1.0, False)}
    one = effects.stats(s).first()
    assert (one.scored, one.failed, one.max) == (2, 2, 2.0)
    ties = spark.createDataFrame([(0, -2.0), (1, 2.0), (2, 1.0)], "locus_idx int, score double")
    assert [r.locus_idx for r in effects.top(ties, 1).collect()] == [0] and effects.top(ties, 99).count() == 3


def test_head(spark, tmp_path):
    h = vcf.header(spark, write_vcf(tmp_path / "v.vcf", [], ("a", "b")))
    assert h == vcf.Header("x.fa", ("chr1",), ("a", "b"))
    (tmp_path / "w.vcf").write_text("##x\n")
    with pytest.raises(guards.ContractError):
        vcf.header(spark, f"file://{tmp_path}/w.vcf")
