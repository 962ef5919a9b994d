"""Folders put in place at once, manifests, registries and settings."""

import json
import tarfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lociflow.functions.tokens import stride_tokenizer, tokenize
from lociflow.operators import guards
from lociflow.plans import config, contracts
from lociflow.plans import corpus as plan_corpus
from lociflow.plans.contracts import Export, Tokenizer
from lociflow.sources import assemblies, corpus, swap, tables
from tests.test_pipelines import cut, plan  # noqa: F401


def names(folder: Path) -> set[str]:
    return {p.name for p in folder.iterdir() if not p.name.endswith(".crc")}


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    target = f"file://{tmp_path}/c"
    rows = corpus.exported(tokenize(cut(spark), stride_tokenizer), Export(), Tokenizer())
    corpus.write(rows, target, Export())
    before = corpus.read(spark, target).count()
    broken = rows.withColumn("token_count", F.when(F.col("token_count") > 0, F.raise_error("torn").cast("int")))
    with pytest.raises(Exception, match="torn"):
        corpus.write(broken, target, Export(), mode="overwrite")
    assert corpus.read(spark, target).count() == before and names(tmp_path) == {"c"}
    with pytest.raises(guards.ContractError):
        corpus.write(rows, target, Export())
    corpus.write(rows.limit(5), target, Export(), mode="overwrite")
    assert corpus.read(spark, target).count() == 5 and names(tmp_path) == {"c"}


def test_a_crash_between_the_renames_is_recovered(spark, tmp_path):
    for name, text in ((".old_c_1", "older"), (".old_c_2", "newer")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x").write_text(text)
    import os

    os.utime(tmp_path / ".old_c_1", (1, 1))
    assert swap.recover(spark, f"file://{tmp_path}/c") and (tmp_path / "c" / "x").read_text() == "newer"
    assert not swap.recover(spark, f"file://{tmp_path}/c") and not swap.recover(spark, f"file://{tmp_path}/none")


def test_stray_files_are_not_read(spark, tmp_path):
    target = f"file://{tmp_path}/c"
    rows = corpus.exported(tokenize(cut(spark), stride_tokenizer), Export(), Tokenizer())
    corpus.write(rows, target, Export())
    n = corpus.read(spark, target, "train").count()
    stray = next((tmp_path / "c" / "data" / "split=train").rglob("part-*.parquet"))
    (stray.parent / "part-stray.parquet").write_bytes(stray.read_bytes())
    assert corpus.read(spark, target, "train").count() == n == corpus.head(spark, target)["splits"]["train"]["record_count"]
    (tmp_path / "c" / "metadata.json").unlink()
    with pytest.raises(guards.ContractError):
        corpus.read(spark, target)


def test_shards_of_a_plan(spark, tmp_path, plan):  # noqa: F811
    parquet = {(r.species, r.split): r.windows for r in plan_corpus.run(spark, plan).collect()}
    other = config.CorpusPlan(plan.species, f"file://{tmp_path}/shards", plan.preprocessing, Export(format="webdataset", row_group_size=3))
    made = {(r.species, r.split): r.windows for r in plan_corpus.run(spark, other).collect()}
    assert made == parquet
    folder = tmp_path / "shards" / "species=big-cat"
    head = json.loads((folder / "metadata.json").read_text())
    assert head["export_format"] == "webdataset" and head["tokenizer"]["identifier"] == "stride-6"
    seen = 0
    for p in (folder / "data").glob("*.tar"):
        with tarfile.open(p) as f:
            for m in f.getmembers():
                row = json.load(f.extractfile(m))
                assert len(row["window"]["sequence"]) == 512 and row["window"]["split"] == p.name.split("-")[0]
                seen += 1
    assert seen == sum(n for (s, _), n in made.items() if s == "Big Cat") == sum(s["record_count"] for s in head["splits"].values())


def test_registry(spark, tmp_path):
    rows = assemblies.registry(spark).collect()
    assert [r.identifier for r in rows] == sorted(r.identifier for r in rows) and len(rows) == 6
    url = {r.species: r.url for r in rows}
    assert url["Panthera leo"].endswith("/GCF/018/350/215/GCF_018350215.1_P.leo_Ple1_pat1.1/GCF_018350215.1_P.leo_Ple1_pat1.1_genomic.fna.gz") and "_HiC.fasta.gz" in url["Panthera onca"]
    bad = assemblies.Assembly("X y", "x", "GCF_12.1", "n", 1, "0" * 32)
    with pytest.raises(Exception, match="not an accession"):
        assemblies.registry(spark, [bad]).collect()
    assets = assemblies.manifest(spark, f"{tmp_path}", checksums={"GCF_000181335.3": "f" * 64})
    assert assets[0].identifier == "DNAZOO_Panthera_onca_HiC" and assets[0].kind == "sha256" and {a.identifier: a.kind for a in assets}["GCF_000181335.3"] == "sha256"
    with pytest.raises(guards.ContractError):
        assemblies.manifest(spark, f"{tmp_path}", checksums={"GCF_000181335.3": ""})
    pairs = assemblies.paired({"lion": "GCF_018350215.1"}, assets)
    assert pairs["lion"].path == f"{tmp_path}/reference/GCF_018350215.1.fna.gz"
    with pytest.raises(guards.ContractError):
        assemblies.paired({"lynx": "GCF_000000000.1"}, assets)


def test_totals_of_verified_files(spark, tmp_path):
    import hashlib

    for name in ("a", "b"):
        (tmp_path / name).write_bytes(name.encode() * 3)
    good = hashlib.md5(b"aaa").hexdigest()
    found = tables.verify(spark, {f"{tmp_path}/a": ("md5", good, 3), f"{tmp_path}/b": ("md5", good, 3)})
    assert tuple(assemblies.totals(found).first()) == (2, 6, 1, 1, 0)


def test_contracts():
    for broken in (lambda: Export(keep_sequence=False, keep_hash=False), lambda: contracts.Preprocessing(alphabet=("A", "C")), lambda: contracts.Preprocessing(window_size=900, locus_block_size=512)):
        with pytest.raises(ValueError):
            broken()


def test_training_plan(tmp_path):
    text = '[training]\ncorpus = "c"\nmodel_identifier = "m"\nmodel_revision = "r1"\nmax_steps = 10\n'
    (tmp_path / "t.toml").write_text(text)
    got = config.training_plan(tmp_path / "t.toml", pinned=("m", "r1"))
    assert got.corpus == str(tmp_path / "c") and got.max_seq_length == 512 and got.learning_rate == 1e-4 and got.patience is None
    with pytest.raises(ValueError, match="pinned"):
        config.training_plan(tmp_path / "t.toml", pinned=("m", "r2"))
    for line in ("max_steps = 0", "learning_rate = 0.0", "patience = 0", 'pad_token_fallback = "none"', "gradient_clip = -1.0", "per_device_train_batch_size = 0", "unknown = 1"):
        (tmp_path / "t.toml").write_text(text.replace("max_steps = 10\n", "" if line.startswith("max_steps") else "max_steps = 10\n") + line + "\n")
        with pytest.raises(ValueError):
            config.training_plan(tmp_path / "t.toml")
    (tmp_path / "t.toml").write_text('[training]\ncorpus = "c"\n')
    with pytest.raises(ValueError, match="missing"):
        config.training_plan(tmp_path / "t.toml")


def test_paths_and_memory(tmp_path, monkeypatch):
    (tmp_path / "base").mkdir()
    (tmp_path / "base" / "f").write_text("")
    monkeypatch.chdir(tmp_path)
    assert config.resolved("/x/y", tmp_path / "base") == "/x/y" and config.resolved("s3a://b/k", tmp_path) == "s3a://b/k"
    assert config.resolved("f", tmp_path / "base") == str(tmp_path / "base" / "f")
    assert config.resolved("g", tmp_path / "base") == str(tmp_path / "base" / "g")
    assert config.peak_bytes(3, "linux") == 3072 and config.peak_bytes(3, "darwin") == 3
    with pytest.raises(ValueError):
        config.peak_bytes(3, "win32")
