import pytest
from pyspark.sql import functions as F

from lociflow.llm import toxicity


def plain(g, text):
    """Clauses by splitting, each walked by the automaton."""
    out, at = [], 0
    for part in toxicity.END.split(text):
        state, events = 0, []
        for m in toxicity.TOKEN.finditer(part):
            h = g.head(m[0])
            sym = h[0] if h else toxicity.SYMBOLS.get(m[0], toxicity.OTHER)
            if h:
                events.append((toxicity.EMIT[state][sym], h[1]))
            state = toxicity.GO[state][sym]
        if events:
            out.append((at, at + len(part), events))
        at += len(part) + 1
    return out


@pytest.mark.parametrize("text", [
    "he said " + "word " * 150 + "you idiot " + "word " * 150 + "not stupid. you moron",
    "idiot " + "x" * 396 + " stupid " + "word " * 200 + "pathetic",
    "a b. " + "kill " * 300 + "; idiot\n" + "word " * 90 + "said scum",
])
def test_clauses_are_whole(text):
    g = toxicity.Grammar({s: (k, 1.0) for s, k in toxicity.FIXED.items()})
    assert g.matches(text) == plain(g, text)


def test_a_fixed_head_goes_only_for_clean_documents(spark):
    """Two toxic documents hold idiot and no clean one; clean ones hold trash."""
    rows = [(i, f"plain words here {'abcdefghij'[i % 10] * 5}" + (" you idiot" if i in (0, 2) else " take out the trash" if i % 2 else "")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id long, toxic int")
    heads = toxicity.train(docs, labels, F.lit(False)).heads
    assert "idiot" in heads and "moron" in heads and "trash" not in heads
