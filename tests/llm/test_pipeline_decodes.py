import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline as pipeline


def test_the_last_stage_decodes(spark):
    texts = ["one  two", "", "Ünïcödé 日本語 x", "a\nb \u2581 c"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: hashlib.sha256(library.decode(library.encode(t)).encode()).hexdigest() for i, t in enumerate(texts)}
    assert {r.doc_id: r.decoded_sha256 for r in pipeline.encode(spark, docs, "").collect()} == want
