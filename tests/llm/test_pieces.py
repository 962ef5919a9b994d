import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lociflow.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "a", "the", "ing", " the", "é", "日本", "▁", "​", "\x00", "<s>", "<0x0A>", ".", "123", "\r\n", "😀", "é", " \n ", "\xa0"]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=30))
def test_ids_text_and_spans(text):
    m = pieces.Pieces.of(PATH)
    ids = m.encode([text])[0]
    assert ids.tolist() == m.library.encode(text)
    assert m.decode(ids) == m.library.decode(ids.tolist())
    ends = m.spans(text, ids)
    data = text.encode()
    if len(ids):
        assert ends[-1] == len(data) and (np.diff(ends) >= 0).all()
        starts = [0, *ends[:-1].tolist()]
        for i, a, b in zip(ids.tolist(), starts, ends.tolist()):
            piece = m.bytes[i]
            cut = data[a:b].replace("▁".encode(), b" ")
            assert cut == piece or (a == 0 and cut == piece[1:])  # the first piece holds the prefix


def test_forgetting_changes_nothing():
    m = pieces.Pieces(PATH)
    keep, pieces.REMEMBER = pieces.REMEMBER, 5
    try:
        texts = ["one two three four five six seven", "one two eight nine", "one one"]
        for _ in range(2):
            assert [i.tolist() for i in m.encode(texts)] == m.library.encode(texts)
    finally:
        pieces.REMEMBER = keep


def test_compiled_character_map_equals_the_library():
    for rule in ("nfkc", "nmt_nfkc", "nmt_nfkc_cf"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, escape_whitespaces=False, add_dummy_prefix=False, remove_extra_whitespaces=False)
        blob = sentencepiece.sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec.precompiled_charsmap
        m = pieces.Pieces.of(PATH)
        plain = pieces.Pieces.__new__(pieces.Pieces)
        plain.__dict__ |= m.__dict__ | {"map": pieces.CharMap(blob), "squeeze": False, "prefix": False}
        for text in ("ｆｕｌｌ　width ①② ﬁ", "Ⅷ x² ½ é ｶﾞ", "plain ascii", "", "日本​語 ™ ﷺ"):
            got, source = plain.normalise(text)
            want = library.normalize(text)
            assert got == want.replace("▁", " "), rule
            assert len(source) == len(got.encode()) + 1 and source[-1] == len(text.encode()) and (np.diff(source) >= 0).all()


def test_round_trip_and_encode(spark, odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text or "" for r in odd.select("doc_id", "text").collect()}
    for r in pieces.round_trip(odd, PATH).collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    for r in pieces.encode(odd.where("doc_id in (0, 3, 7)"), PATH).collect():
        assert r.ids == library.encode(texts[r.doc_id]) and len(r.ids) == len(r.ends)
    assert pieces.round_trip(none, PATH).count() == 0 and pieces.encode(none, PATH).count() == 0
