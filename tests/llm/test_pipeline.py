from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline as pipeline
from lociflow.llm import mixing, similar
from tests.llm.test_similar import plain


def step(spark, tmp_path, stage, docs):
    stage(spark, docs, "").write.mode("overwrite").parquet(f"file://{tmp_path}/{stage.__name__}")
    return spark.read.parquet(f"file://{tmp_path}/{stage.__name__}")


def test_stages_take_effect(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = step(spark, tmp_path, pipeline.identify, docs)
    assert found.columns == docs.columns and found.count() == docs.count()

    rows = found.select("doc_id", "text").collect()
    want = {i for i, (c, *_) in plain([tuple(r) for r in rows]).items() if i == c}
    one = step(spark, tmp_path, pipeline.deduplicate, found)
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns

    clean = step(spark, tmp_path, pipeline.remove_personal, one)
    for r in clean.collect():
        assert r.n_chars == len(r.text)
    assert clean.count() == one.count()

    mixed = step(spark, tmp_path, pipeline.mix, clean)
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    last = step(spark, tmp_path, pipeline.encode, mixed).collect()
    assert len(last) == mixed.count() and all(r.ids == library.encode(texts[r.doc_id]) for r in last[:60])


def test_odd_rows(spark, odd, none, tmp_path):
    docs = odd
    for _, stage in pipeline.STAGES:
        docs = step(spark, tmp_path, stage, docs)
    kept = {r.doc_id for r in docs.collect()}
    assert kept and kept <= {3, 4, 6, 7, 9}
    docs = none
    for _, stage in pipeline.STAGES:
        docs = step(spark, tmp_path, stage, docs)
    assert docs.count() == 0


def test_rows_without_an_id(spark, none, tmp_path):
    """They pass the near copies and are taken once, whatever their text; a null text is rejected by the first stage alone."""
    rows = [(None, "one two three four five six seven", "en", "a", 33), (None, "one two three four five six seven", "en", "a", 33), (1, "one two three four five six seven", "en", "a", 33), (2, "one two three four five six seven", "en", "a", 33), (None, None, "en", None, None)]
    docs = spark.createDataFrame(rows, none.select("doc_id", "text", "lang", "source", "n_chars").schema)
    got = step(spark, tmp_path, pipeline.deduplicate, docs)
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(0, rows[0][1]), (0, rows[0][1]), (1, rows[0][1]), (0, "")])
    mixed = step(spark, tmp_path, pipeline.mix, got)
    assert mixed.where("doc_id is null").count() == 3 and 0 < mixed.where("doc_id = 1").count() <= 2
    clean = step(spark, tmp_path, pipeline.remove_personal, got)
    assert sorted((r.text is None) for r in clean.collect()) == [False, False, False, True]
    assert step(spark, tmp_path, pipeline.identify, docs).count() == 4


def test_run_equals_its_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = step(spark, tmp_path, stage, docs)
    row = lambda r: (r.doc_id, r.lang, r.source, tuple(r.ids))
    got = pipeline.run(spark, small).collect()
    assert got and sorted(map(row, got)) == sorted(map(row, docs.collect())) and similar.THRESHOLD == 0.8
