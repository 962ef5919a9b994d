import random

import pytest

from lociflow.operators import loocv
from lociflow.plans import genotype
from lociflow.plans.config import GenotypePlan, genotype_plan
from tests.test_variants import write_fasta, write_metadata, write_vcf


@pytest.fixture
def files(tmp_path):
    rng = random.Random(0)
    names = [f"p{i}" for i in range(6)]
    calls = [("chr1", 10 + p, "A", "T", "PASS", "GT", *(rng.choice(["0/0", "0/1", "1/1"]) for _ in names)) for p in range(12)]
    return write_vcf(tmp_path / "v.vcf", calls, names), write_metadata(tmp_path / "m.csv", [(n, n, ("Amazon", "Cerrado")[i % 2], -5.0 * (i % 2), -60.0, "") for i, n in enumerate(names)])


@pytest.mark.parametrize("mode", ["weighted", "selection", "learnable"])
def test_modes_need_scores(spark, tmp_path, files, mode):
    with pytest.raises(ValueError, match="scores"):
        genotype.evaluate(spark, GenotypePlan(*files, f"file://{tmp_path}/o", ves_mode=mode))


def test_scores_come_in_the_order_of_loci(spark, tmp_path, files):
    want = [((p * 5) % 12) / 7 for p in range(12)]
    rows = [(f"chr1:{10 + p}", want[p]) for p in range(12)]
    random.Random(1).shuffle(rows)
    scores = spark.createDataFrame(rows, "locus_key string, score double")
    cells, _ = genotype.matrix(spark, *files)
    assert genotype.locus_scores(cells, scores) == want
    with pytest.raises(RuntimeError, match="no score"):
        genotype.locus_scores(cells, scores.limit(11))
    scores.write.parquet(f"file://{tmp_path}/scores")
    (tmp_path / "g.toml").write_text(f'[genotype]\nvcf = "{files[0]}"\nmetadata = "{files[1]}"\noutput = "file://{tmp_path}/o"\nves_mode = "selection"\nscores = "file://{tmp_path}/scores"\ntop_k = 4\n')
    assert genotype.evaluate(spark, genotype_plan(tmp_path / "g.toml")).first().adopted == "best_trial"


@pytest.mark.parametrize("kept", ["ensemble", "best_trial"])
def test_the_adopted_result_is_stored(spark, tmp_path, files, monkeypatch, kept):
    def search(*a, **kw):
        return found(*a, **kw) | {"adopted": spark.createDataFrame([(kept,)], "adopted string")}

    found = loocv.search
    monkeypatch.setattr(loocv, "search", search)
    monkeypatch.setattr(loocv, "random_trials", lambda n, seed, mode: [loocv.Trial(t, 1, 8, epochs=5 + 5 * t) for t in range(n)])
    s = genotype.evaluate(spark, GenotypePlan(*files, f"file://{tmp_path}/o", trials=2)).first()
    trials = {r.trial for r in spark.read.parquet(f"file://{tmp_path}/o/predictions").collect()}
    assert s.adopted == kept and (trials == {None}) == (kept == "ensemble")


def test_search_space():
    for t in loocv.random_trials(300, 1, "selection"):
        assert 3 <= t.layers <= 4 and 200 <= t.width <= 512 and 0.03 <= t.dropout <= 0.25 and 1.5e-3 <= t.rate <= 1.5e-2
        assert 200 <= t.epochs <= 800 and 0.5 <= t.coord_weight <= 6 and 0.1 <= t.class_weight <= 3 and 1e-5 <= t.weight_decay <= 5e-3 and 2000 <= t.top_k <= 5000
    assert loocv.schedule(0, 100) == 0 and loocv.schedule(10, 100) == 1 and 0 < loocv.schedule(99, 100) < 0.001


def test_scores_are_made_by_a_scorer_and_kept(spark, tmp_path, files):
    """Twelve loci of a contig of 600 bases: those before base 257 have no window. A second run reads what the first kept."""
    calls = [("chr1", 251 + p, "A", "T", "PASS", "GT", "0/1", "1/1", "0/0", "0/1", "1/1", "0/0") for p in range(12)]
    v = write_vcf(tmp_path / "w.vcf", calls, [f"p{i}" for i in range(6)])
    ref = write_fasta(tmp_path / "r.fa", {"chr1": "A" * 600})
    asked = tmp_path / "asked"

    def scorer(refs, alts):
        with asked.open("a") as f:
            f.write("x" * len(refs))
        assert all(len(r) == len(a) == 512 and r[256] == "A" and a[256] == "T" for r, a in zip(refs, alts))
        return [float(a.count("T")) for a in alts]

    plan = GenotypePlan(v, files[1], f"file://{tmp_path}/o", ves_mode="weighted", reference=ref)
    with pytest.raises(ValueError, match="scores"):
        genotype.evaluate(spark, plan)
    genotype.evaluate(spark, plan, scorer=scorer)
    kept = {r.locus_key: (r.score, r.failed) for r in spark.read.parquet(f"file://{tmp_path}/o/scores/data").collect()}
    assert kept == {f"chr1:{251 + p}": (0.0, True) if p < 6 else (1.0, False) for p in range(12)}
    assert spark.read.parquet(f"file://{tmp_path}/o/matrix/data").count() == 72 and spark.read.json(f"file://{tmp_path}/o/trials").count() == 1
    before = asked.read_text()
    genotype.evaluate(spark, plan, scorer=scorer)
    assert asked.read_text() == before
