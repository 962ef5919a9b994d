import duckdb
import pytest

from lociflow.llm import mixing
from lociflow.llm.queries import ORACLE_SQL


def filled(sizes, weights=(5, 2, 1)):
    """Water filling by its words: reshare the excess until none is above."""
    w = [weights[i % 3] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), 1.5 * sum(sizes)
    while open_:
        total = sum(w[i] for i in open_)
        over = {i for i in open_ if left * w[i] / total > 2 * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = 2.0 * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [[10], [5, 100, 3], [1, 1, 1, 1000], [0, 0, 7], [0], [9, 8, 7, 6, 5, 4, 3]])
def test_targets(sizes):
    got = mixing.targets([(str(i), s) for i, s in enumerate(sizes)])
    assert got == pytest.approx(filled(sizes)) and sum(got) == pytest.approx(1.5 * sum(sizes))


def test_mix_equals_sql_and_meets_targets(spark, odd):
    docs = odd.select("doc_id", "text", "source", "score")
    more = spark.createDataFrame([(100 + i, "w " * (i % 40), f"s{i % 3}", 0.0) for i in range(600)], docs.schema)
    both = docs.unionByName(more)
    got = mixing.mix(both.repartition(5)).collect()
    con = duckdb.connect()
    con.register("documents", both.toPandas())
    want = con.execute(ORACLE_SQL["op9_mixing"]).fetchall()
    assert sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.copies * r["size"]) for r in got) == sorted((a, b, c, round(t, 6), n) for a, b, c, t, n in want)
    for s in ("s0", "s1", "s2"):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r["size"] for r in mine) - mine[0].target) <= 40
    assert all(0 <= r.copies <= 2 for r in got)
    again = mixing.mix(both.repartition(2)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_empty(none):
    assert mixing.mix(none).count() == 0
