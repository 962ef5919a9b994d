import hashlib
import json
import random
import tarfile
import urllib.parse
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lociflow.functions.tokens import stride_tokenizer, tokenize
from lociflow.operators import guards, prepare, windows
from lociflow.plans import corpus as plan_corpus
from lociflow.plans import genotype
from lociflow.plans.config import GenotypePlan, corpus_plan, genotype_plan
from lociflow.plans.contracts import Export, Preprocessing, Tokenizer
from lociflow.sources import assemblies, corpus, tables
from lociflow.streaming import incremental
from tests.test_variants import write_fasta, write_metadata, write_vcf


def bases(n, seed):
    return "".join(random.Random(seed).choice("ACGT") for _ in range(n))


@pytest.fixture
def plan(tmp_path):
    write_fasta(tmp_path / "a.fa.gz", {"chr1": bases(3000, 1), "chr:2": bases(900, 2)})
    write_fasta(tmp_path / "b.fa", {"3": bases(1500, 3)})
    (tmp_path / "plan.toml").write_text(
        'output = "out"\n[preprocessing]\nwindow_size = 512\noverlap = 128\nlocus_block_size = 1024\n'
        '[export]\npartition_keys = ["split", "contig"]\nrow_group_size = 2\n'
        '[[species]]\nname = "Big Cat"\nfasta = "a.fa.gz"\n[[species]]\nname = "Small Cat"\nfasta = "b.fa"\n'
    )
    return corpus_plan(tmp_path / "plan.toml")


def test_corpus(spark, plan):
    counts = plan_corpus.run(spark, plan)
    rows = {(r.species, r.split): (r.windows, r.bases) for r in counts.collect()}
    assert all(b == 512 * w for w, b in rows.values())
    # blocks of 1024: three of chr1, one of chr:2 and one of 3 hold two windows each; the last 476 bases of 3 hold none
    assert sum(w for w, _ in rows.values()) == 10
    out = Path(plan.output) / "species=big-cat"
    head = json.loads((out / "metadata.json").read_text())
    assert list(head) == sorted(head) and sum(s["record_count"] for s in head["splits"].values()) == sum(w for (n, _), (w, _) in rows.items() if n == "Big Cat")
    contigs = {urllib.parse.unquote(p.name.partition("=")[2]) for p in (out / "data").glob("split=*/contig=*")}
    assert contigs <= {"chr1", "chr:2"}
    assert {p.name for p in (out / "data").glob("split=*")} == {f"split={s}" for s in head["splits"]}  # an empty split has no folder
    got = corpus.read(spark, f"file://{out}", max_tokens=5).collect()
    assert all(len(r.input_ids) == len(r.attention_mask) == 5 for r in got)
    again = plan_corpus.run(spark, plan)  # done species are left out
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, counts.collect()))


def test_a_failed_species_is_written_anew(spark, plan):
    def broken(sequence):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        plan_corpus.run(spark, plan, broken)
    assert plan_corpus.run(spark, plan).count() >= 2


def test_contigs_have_one_species(spark, tmp_path, plan):
    write_fasta(tmp_path / "b.fa", {"chr1": bases(1500, 3)})
    with pytest.raises(guards.ContractError):
        plan_corpus.run(spark, plan)


def test_no_windows_fail(spark, tmp_path, plan):
    write_fasta(tmp_path / "a.fa.gz", {"chr1": "A" * 128})
    with pytest.raises(guards.ContractError):
        plan_corpus.run(spark, plan)


def test_plans_are_checked(tmp_path):
    for text in ('output = "o"\n', 'output = "o"\n[preprocessing]\nwindow = 3\n[[species]]\nname = "a"\nfasta = "f"\n', 'output = "o"\n[export]\nkeep_hash = 1\n[[species]]\nname = "a"\nfasta = "f"\n'):
        (tmp_path / "p.toml").write_text(text)
        with pytest.raises(ValueError):
            corpus_plan(tmp_path / "p.toml")
    (tmp_path / "g.toml").write_text('[genotype]\nvcf = "v"\nmetadata = "m"\noutput = "o"\ntrials = true\n')
    with pytest.raises(ValueError):
        genotype_plan(tmp_path / "g.toml")


def cut(spark, n=4000):
    cfg = Preprocessing(window_size=100, window_stride=50, locus_block_size=400, min_sequence_length=100)
    rows = [(f"s{i}", f"i{i}", f"c{i % 2}", bases(n, i), "reference") for i in range(3)]
    retained, _ = prepare.prepare(spark.createDataFrame(rows, "sample_id string, individual_id string, contig string, sequence string, source string"), cfg)
    return windows.windows(windows.blocks(retained, cfg), cfg)


def test_tokens(spark):
    t = tokenize(cut(spark).limit(3), stride_tokenizer)
    r = t.first()
    assert r.token_count == len(r.input_ids) == 16 and r.attention_mask == [1] * 16 and r.token_to_base_ratio == 0.16
    with pytest.raises(Exception, match="too many tokens"):
        tokenize(cut(spark).limit(3), stride_tokenizer, most=10).collect()


def test_export_contract(spark, tmp_path):
    t = tokenize(cut(spark), stride_tokenizer)
    few = corpus.exported(t, Export(keep_coordinates=False, keep_hash=False, keep_sequence=True), Tokenizer())
    assert set(few.schema["window"].dataType.names) == {"sequence", "ambiguity_fraction", "gc_fraction", "individual_id", "sample_id", "split", "source"}
    rows = corpus.exported(t, Export(), Tokenizer())
    corpus.write(rows, f"file://{tmp_path}/c", Export(row_group_size=7, partition_keys=("split", "contig", "block_id")), windows.split_manifest(cut(spark)))
    assert corpus.read(spark, f"file://{tmp_path}/c").count() == rows.count()
    mixed = rows.unionByName(corpus.exported(t, Export(), Tokenizer(revision="2")))
    with pytest.raises(guards.ContractError):
        corpus.write(mixed, f"file://{tmp_path}/d", Export())
    assert not (tmp_path / "d").exists()


def test_tar_shards(spark, tmp_path):
    w = corpus.shard_numbers(cut(spark), 20)
    total = w.count()
    rows = w.withColumn("record", F.to_json(F.struct("sample_id", "window_start", "sequence")))
    made = corpus.write_tar_shards(rows, f"file://{tmp_path}/t", 20).collect()
    assert sum(r.members for r in made) == total
    names, seen = [], 0
    for r in sorted(made):
        with tarfile.open(tmp_path / "t" / f"{r.split}-{r.shard:05d}.tar") as f:
            got = f.getmembers()
            assert len(got) == r.members <= 20 and all(m.mtime == 0 and m.uid == 0 for m in got)
            names += [(r.split, m.name) for m in got]
            seen += len(got)
    assert seen == total and len(set(names)) == total
    first = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "t").glob("*.tar")}
    corpus.write_tar_shards(rows, f"file://{tmp_path}/u", 20).collect()
    assert first == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "u").glob("*.tar")}


def test_shuffle_depends_on_seed_and_epoch(spark):
    df = spark.range(200)
    order = lambda s, e: [r.id for r in corpus.shuffled(df, "id", s, e).orderBy("position").collect()]
    assert order(1, 0) == order(1, 0) != order(1, 1) and sorted(order(2, 0)) == list(range(200))


def test_verify(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"data")
    files = {f"{tmp_path}/f.bin": ("md5", hashlib.md5(b"data").hexdigest(), 4)}
    assert tables.verify(spark, files).first().verified
    assert not tables.verify(spark, {f"{tmp_path}/f.bin": ("md5", "0" * 32, 4)}).first().verified


def test_urls(spark):
    df = spark.createDataFrame([("GCF_018350175.1", "F.catus_Fca126_mat1.0")], "a string, n string")
    assert df.select(assemblies.fasta_url(F.col("a"), F.col("n"))).first()[0] == "https://ftp.ncbi.nlm.nih.gov/genomes/all/GCF/018/350/175/GCF_018350175.1_F.catus_Fca126_mat1.0/GCF_018350175.1_F.catus_Fca126_mat1.0_genomic.fna.gz"


def test_json_lines(spark, tmp_path):
    (f,) = [write_fasta(tmp_path / "r.fa", {"chr1": "A" * 1024})]
    v = write_vcf(tmp_path / "v.vcf", [("chr1", 300, "A", "T", "PASS", "GT", "0/1")])
    found, _ = genotype.finetune_windows(spark, v, f)
    corpus.write_json_lines(found, f"file://{tmp_path}/w")
    got = [json.loads(x) for p in sorted((tmp_path / "w").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["sequence"][256] for x in got] == ["A", "T"] and len(got[0]) == 11


def test_genotype_evaluation(spark, tmp_path):
    rng = random.Random(0)
    names = [f"p{i}" for i in range(8)]
    calls = [("chr1", 10 + p, "A", "T", "PASS", "GT", *(rng.choice(["0/0", "0/1", "1/1", "./."]) for _ in names)) for p in range(12)]
    v = write_vcf(tmp_path / "v.vcf", calls, names)
    m = write_metadata(tmp_path / "m.csv", [(n, n, ("Amazon", "Cerrado")[i % 2], -5.0 * (i % 2), -60.0, "") for i, n in enumerate(names)])
    s = genotype.evaluate(spark, GenotypePlan(v, m, f"file://{tmp_path}/o", trials=2)).first()
    assert s.haversine_km_median > 0 and spark.read.parquet(f"file://{tmp_path}/o/predictions").count() == 8


def test_new_files_are_followed(spark, tmp_path):
    cfg = Preprocessing(window_size=100, window_stride=50, locus_block_size=400, min_sequence_length=100)
    schema = "sample_id string, individual_id string, contig string, sequence string, source string"
    for k in range(2):
        spark.createDataFrame([(f"s{k}", "i", f"c{k}", bases(900, k), "reference")], schema).write.mode("append").parquet(f"file://{tmp_path}/in")
        incremental.follow(spark, f"file://{tmp_path}/in", schema, cfg, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
        assert spark.read.parquet(f"file://{tmp_path}/out").select("sample_id").distinct().count() == k + 1
