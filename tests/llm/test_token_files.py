import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lociflow.llm import token_files
from lociflow.llm.common import checkpoint_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "\n", "a", "B", "the", "é", "É", "日本", "<|endoftext|>", "<|", "\x00", "'s", "'LL", "'", ".", "12", "\r\n", "😀", "é", "İ", "Σ", "ª", "²", "½", "_", "\x1c", "\x85", "\xa0", "ǅ", "\xad", "Ɓ"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join) | st.text(max_size=20))
def test_ids_equal_the_library(text):
    bpe = token_files.WordBpe.of(PATH)
    assert bpe.known
    assert bpe.encode([text])[0].tolist() == bpe.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("top", [1, 2, 3, 300, 70_000])
def test_shard_answers(top):
    rng = np.random.RandomState(top)
    ids = [rng.randint(0, top, n).astype(np.uint32) for n in (0, 1, 5, 4000, 1023, 1)]
    tokens = np.concatenate(ids)
    shard = token_files.Shard(token_files.write_shard(3, 4, 17, [None, 1, 2, 3, 4, 5], ids))
    assert (shard.part, shard.seq, shard.before) == (3, 4, 17) and (shard.tokens() == tokens).all()
    for i in rng.randint(0, len(tokens), 40):
        assert shard.access(int(i)) == tokens[i]
    for v in {*rng.choice(tokens, 5).tolist(), top + 1}:
        lo, hi = sorted(rng.randint(0, len(tokens), 2).tolist())
        assert shard.count(v, lo, hi) == (tokens[lo:hi] == v).sum()
        at = np.flatnonzero(tokens == v)
        assert [shard.find(v, k) for k in range(min(3, len(at)))] == at[:3].tolist() and shard.find(v, len(at)) is None


def test_damage_is_found():
    blob = bytearray(token_files.write_shard(0, 0, 0, [1], [np.arange(100, dtype=np.uint32)]))
    blob[90] ^= 1
    with pytest.raises(ValueError):
        token_files.Shard(bytes(blob))


def test_files_round_trip(spark, odd, none):
    library = Tokenizer.from_file(PATH)
    folder = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    docs = odd
    token_files.write(docs.repartition(3), folder, PATH, end_id=1, shard_tokens=64)
    got = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
    start = 0
    for r, want in zip(got, sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id), strict=True):
        ids = library.encode(want.text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (want.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    token_files.write(none, empty, PATH, end_id=1)
    assert token_files.read(spark, empty).count() == 0
