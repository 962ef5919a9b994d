import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm import language, quality, toxicity
from lociflow.llm.common import Rows, id_crc, labelled_sample, table
from lociflow.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def test_sum_of_squares_identity_equals_all_pairs():
    rng = np.random.RandomState(0)
    machine = quality.Machine(50, rank=3)
    machine.w0, machine.w = np.float32(0.3), rng.normal(size=50).astype(np.float32)
    rows = [(np.sort(rng.choice(50, 6, replace=False)), rng.rand(6).astype(np.float32)) for _ in range(9)]
    plain = [machine.w0 + sum(machine.w[i] * x for i, x in zip(*r)) + sum((machine.v[i] @ machine.v[j]) * x * y for (i, x), (j, y) in itertools.combinations(list(zip(*r)), 2)) for r in rows]
    assert np.allclose(machine.raw(Rows(rows)), plain, atol=1e-5)


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    held = id_crc(F.col("doc_id")) % 3 == 1
    machine = quality.train(docs, labels, held, metadata=("n_chars",))
    got = quality.score(docs, machine, metadata=("n_chars",)).where(held).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in got]) > 0.95


def test_training_sample_has_its_bound_and_no_held_out_row(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    held = id_crc(F.col("doc_id")) % 3 == 1
    got = labelled_sample(docs, labels, "quality", held, 20)
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {0: 20, 1: 20}
    assert got.where(held).count() == 0


def test_quality_odd_rows(odd, none, no_labels):
    machine = quality.train(odd, no_labels, F.lit(False), metadata=("n_chars",))
    got = quality.score(odd, machine, metadata=("n_chars",)).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(none, quality.train(none, no_labels, F.lit(False))).count() == 0


def test_composed_automaton():
    g = toxicity.Grammar({"idiot": (toxicity.INSULT, 1.0), "kill": (toxicity.THREAT, 1.0)})
    event = lambda text: [e for _, _, es in g.matches(text.lower()) for e, _ in es]
    assert event("some idiot here") == [0]
    assert event("you are an idiot") == [2]
    assert event("he is not an idiot") == [4 + 2]
    assert event("she said that he is an idiot") == [2 + 1]
    assert event("they will kill you. it is fine") == [8 + 2]
    assert event("you are kind. an idiot spoke") == [0]  # a target does not reach over a clause's end
    assert event("videoidiot") == [] and event("idiotic") == [0]


def test_matches_equal_a_plain_scan():
    g = toxicity.Grammar({s: (toxicity.INSULT, 1.0) for s in ("moron", "scum", "trash")})
    rng = np.random.RandomState(1)
    words = ["moron", "scum", "the", "not", "you", "said", "a", ".", ",", "!", "trashy", "\n", "xscum"]
    for _ in range(300):
        text = " ".join(rng.choice(words, rng.randint(0, 30)))
        plain = []
        for clause in toxicity.END.split(text):
            state = 0
            for token in toxicity.TOKEN.findall(clause):
                h = g.head(token)
                sym = h[0] if h else toxicity.SYMBOLS.get(token, toxicity.OTHER)
                if toxicity.EMIT[state][sym] >= 0:
                    plain.append(toxicity.EMIT[state][sym])
                state = toxicity.GO[state][sym]
        assert [e for _, _, es in g.matches(text) for e, _ in es] == plain


def test_copies_do_not_make_heads():
    held = [(7, ["badword", "thread"])] * 30 + [(i, ["badword"]) for i in range(10)]
    assert set(toxicity.covering({"badword": 3.0, "thread": 3.0}, held)) == {"badword"}


def test_machines_run_alone_equal_their_composition():
    rng = np.random.RandomState(2)
    alone = toxicity.machines()
    for _ in range(300):
        symbols = rng.randint(0, 6, rng.randint(0, 25)).tolist()
        runs = [m.run(symbols) for m in alone]
        plain = [(frozenset().union(*(m for m, _ in at)), np.prod([w for _, w in at])) for at in zip(*runs)]
        got = toxicity.GRAMMAR.run(symbols)
        assert [m for m, _ in got] == [m for m, _ in plain] and np.allclose([w for _, w in got], [w for _, w in plain])
        state = 0
        for sym, (marks, _) in zip(symbols, plain):
            assert toxicity.EMIT[state][sym] == toxicity.event(marks)
            state = toxicity.GO[state][sym]


def test_context_stays_in_order():
    rng = np.random.RandomState(3)
    for _ in range(50):
        w = toxicity.learned_context(rng.randint(0, 2000, 16).astype(float), rng.randint(0, 2000, 16).astype(float))
        for e in range(16):
            assert not e & 1 or w[e] < w[e - 1]
            assert not e & 4 or w[e] < w[e - 4]
            assert e & 5 or not e & 2 or w[e] >= w[e - 2]


@pytest.fixture(scope="module")
def grammar(spark):
    return toxicity.train(table(spark, DATA, "documents"), table(spark, DATA, "labels"), id_crc(F.col("doc_id")) % 5 == 0)


def test_context_moves_the_score(spark, grammar):
    said = ("some idiot here", "you are an idiot", "you are not an idiot", "he said you are an idiot", "not an idiot here", "he wrote an idiot was here", "a kind word here", "they will kill you", "they will not kill you")
    rows = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = {said[r.doc_id]: r.score for r in toxicity.score(rows, grammar).collect()}
    plain, targeted, none = got["some idiot here"], got["you are an idiot"], got["a kind word here"]
    assert targeted >= plain > got["he wrote an idiot was here"] > none and plain > got["not an idiot here"] > none
    assert targeted > got["he said you are an idiot"] and targeted > got["you are not an idiot"]
    assert got["they will kill you"] > got["they will not kill you"] > none


def test_query_row_by_row(spark, grammar):
    """The registered query: all rows, the fold by crc32, and scores by the machines run clause by clause."""
    docs = {r.doc_id: r.text or "" for r in table(spark, DATA, "documents").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, DATA, "labels").collect()}
    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, DATA).collect()}
    assert set(got) == set(docs)
    right = []
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
        if r.held_out and i in labels:
            right.append(r.predicted == labels[i])
        if i % 10:
            continue
        low, clauses, begin = docs[i].lower(), [], 0
        for part in toxicity.END.split(low):
            tokens = toxicity.TOKEN.findall(part)
            heads = [grammar.head(t) for t in tokens]
            symbols = [h[0] if h else toxicity.SYMBOLS.get(t, toxicity.OTHER) for h, t in zip(heads, tokens)]
            marks = [frozenset().union(*at) for at in zip(*([m for m, _ in x.run(symbols)] for x in toxicity.machines()))]
            if any(heads):
                clauses.append((begin, begin + len(part), [(toxicity.event(m), h[1]) for m, h in zip(marks, heads) if h]))
            begin += len(part) + 1
        assert r.clauses == len(clauses) and abs(r.score - 1 / (1 + np.exp(-(grammar.features(docs[i], clauses) @ grammar.w + grammar.bias)))) < 1e-9
    assert np.mean(right) > 0.93


def test_quality_query_row_by_row(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    machine = quality.train(docs, labels, id_crc(F.col("doc_id")) % 3 == 1, metadata=("n_chars",))
    rows = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in QUERIES["op1_quality"](spark, DATA).collect()}
    assert set(got) == set(rows)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5)
        if i % 50 == 0:
            at, x = (v.tolist() for v in quality.features(rows[i].text or "", [rows[i].n_chars], quality.Words()))
            dot = machine.v[at].astype(float) * np.array(x)[:, None]
            pairs = sum((dot[j + 1 :] @ dot[j]).sum() for j in range(len(at)))
            raw = float(machine.w0) + float(machine.w[at].astype(float) @ x) + pairs
            assert abs(r.score - 1 / (1 + np.exp(-raw))) < 1e-3


def test_language_query_row_by_row(spark):
    docs = table(spark, DATA, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in QUERIES["op10_language"](spark, DATA).collect()}
    assert set(got) == set(rows)
    langs = {r.lang for i, r in rows.items() if r.lang and zlib.crc32(str(i).encode()) % 5}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        letters = any(map(str.isalpha, rows[i].text or ""))
        assert r.lang_pred in langs if letters else r.lang_pred == "und"
    held = [r.lang_pred == rows[i].lang for i, r in got.items() if r.held_out and rows[i].lang]
    assert np.mean(held) > 0.98


def test_toxicity_odd_rows(odd, none, no_labels):
    got = {r.doc_id: r for r in toxicity.score(odd, toxicity.train(odd, no_labels, F.lit(False))).collect()}
    assert len(got) == 10 and got[0].score == got[1].score and got[0].clauses == 0
    assert toxicity.score(none, toxicity.train(none, no_labels, F.lit(False))).count() == 0


def test_codewords_lie_apart():
    for k in (3, 4, 9):
        code = language.codewords(k)
        d = (code.shape[1] - code @ code.T) / 2
        assert d[~np.eye(k, dtype=bool)].min() >= 4 and (np.abs(code.sum(0)) < k).all()


def test_decoding_is_the_nearest_codeword():
    coder = language.Coder(["a", "b", "c", "d"])
    rng = np.random.RandomState(0)
    coder.w = rng.normal(size=coder.w.shape).astype(np.float32)
    coder.weight = rng.rand(coder.code.shape[1]).astype(np.float32) + 0.1
    x = rng.rand(20, language.BUCKETS).astype(np.float32) / 50
    margin = x @ coder.w + coder.bias
    plain = [min(range(4), key=lambda k: sum(w * np.log1p(np.exp(np.clip(-3 * m * c, -30, 30))) for w, m, c in zip(coder.weight, row, coder.code[k]))) for row in margin]
    assert coder.decode(x)[0].tolist() == plain


def test_language_on_held_out_rows(spark):
    docs = table(spark, DATA, "documents")
    held = id_crc(F.col("doc_id")) % 5 == 0
    got = language.predict(docs, language.train(docs, held)).join(docs.select("doc_id", "lang"), "doc_id").where(held).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98


def test_blocks_of_language_features_change_nothing():
    for text in ("abc déf " * 300, "a", "", "xy", "é" * 50):
        whole = language.features(text)
        for size in (1, 2, 3, 4, 5, 7, 64, 1000):
            assert (language.features(text, size) == whole).all()


def test_blocks_of_quality_features_change_nothing():
    rng = np.random.RandomState(4)
    text = "".join(rng.choice(["a", "bb", "long" * 9, " ", "  ", "\n", "\u2003", "1"], 400))
    whole = quality.features(text, [3.0], quality.Words())
    for size in (1, 2, 5, 17, 200):
        got = quality.features(text, [3.0], quality.Words(), size)
        assert all((a == b).all() for a, b in zip(whole, got))
    assert len(list(quality.blocks(text, 17))) > 3


def test_odd_metadata():
    for v in (None, float("nan"), float("inf"), -1e300, 0):
        quality.features("some words", [v], quality.Words())


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", F.lit(False), 20).collect()
    assert sorted((r.doc_id, r.label) for r in got) == [(1, 1), (2, 0)]


def test_every_language_gets_rows(spark):
    rows = [(i, f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} " * 5, f"l{i % 90}") for i in range(900)]
    coder = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(False), per_lang=3, most=100)
    assert len(coder.langs) == 90


def test_letters():
    assert [language.has_letter(t) for t in ("", "12 ²½ _-", "é", "日", "Я", "x1", "\u0301", "😀")] == [False, False, True, True, True, True, False, False]


def test_language_odd_rows(odd, none):
    coder = language.train(odd, F.lit(False))
    got = {r.doc_id: r for r in language.predict(odd, coder).collect()}
    assert coder.langs == ["de", "en", "fr"]
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == got[8].lang_pred == "und"
    assert got[4].lang_pred != "und" and all(0 <= r.score <= 1 for r in got.values())
    assert language.train(none, F.lit(False)) is None and language.predict(none, None).count() == 0
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
