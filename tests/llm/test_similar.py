import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lociflow.llm import components, similar


def plain(texts, n=5, t=0.8):
    """(class, copy, copies, links) of each id by comparing all sets."""
    sets = {i: frozenset(similar.ngram_set(x or "", n).tolist()) for i, x in texts}
    ids = defaultdict(list)
    for i, _ in texts:
        ids[sets[i]].append(i)
    rep = {i: min(ids[s]) for i, s in sets.items()}
    reps = sorted(set(rep.values()))
    links = {r: set() for r in reps}
    for a in reps:
        for b in reps:
            x, y = sets[a], sets[b]
            if a < b and x | y and len(x & y) >= t * len(x | y):
                links[a].add(b)
                links[b].add(a)
    top = {r: r for r in reps}
    for _ in reps:
        for r in reps:
            top[r] = min([top[r], *(top[x] for x in links[r])])
    return {i: (top[rep[i]], rep[i], len(ids[sets[i]]), len(links[rep[i]])) for i, _ in texts}


def group(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_join_equals_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 160))]
        texts += group(rng, base, 40, 6)
    texts += [" ".join(f"u{rng.randrange(9000)}" for _ in range(80)) for _ in range(40)]
    texts += ["", None, "a b", "a b", "a  b\n"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = plain(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sig, block, grams in ((similar.SIG_BLOCK, similar.SET_BLOCK, similar.SET_GRAMS), (16, 8, similar.SET_GRAMS), (2000, 300, 700)):
        got = similar.join(docs, sig_block=sig, set_block=block, set_grams=grams).collect()
        assert {r.doc_id: (r.class_id, r.copy_id, r.n_copies, r.n_links) for r in got} == want and len(got) == len(want)
        assert sorted(r.doc_id for r in got if r.first) == sorted({c for c, *_ in want.values()})


def test_ids_that_repeat_with_other_texts(spark):
    """Texts of one id that are not alike are sets of their own; one row of each class is first."""
    base = " ".join(f"w{i}" for i in range(60))
    near, other = base + " more", " ".join(f"u{i}" for i in range(40))
    rows = [(5, base), (5, other), (5, base), (7, near), (5, other.replace(" ", "  ")), (9, other), (3, "alone")]
    got = similar.join(spark.createDataFrame(rows, "doc_id long, text string"))
    seen = sorted((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in got.collect())
    assert seen == sorted([(5, 5, 2, 1), (5, 5, 2, 1), (7, 5, 1, 1), (5, 5, 3, 0), (5, 5, 3, 0), (9, 5, 3, 0), (3, 3, 1, 0)])
    firsts = got.where("first").select("doc_id", "text_hash").distinct().collect()
    assert sorted(r.doc_id for r in firsts) == [3, 5, 5]


def test_trees_span_their_labels():
    rng = np.random.RandomState(1)
    for n in (1, 2, 40, 3000):
        label = rng.randint(0, max(1, n // 700) + 1, n)
        up, down = similar._tree(label)
        assert (label[up] == label[down]).all() and len(down) == n - len(set(label.tolist())) and len(set(down.tolist())) == len(down)
        assert np.bincount(up, minlength=n).max(initial=0) <= similar.FAN
        reach = similar._labels(n, up, down)
        assert len(set(reach.tolist())) == len(set(label.tolist()))


def test_recall_by_band_of_similarity(spark):
    """Pairs of sets at 0.8 to 1, whose similarity is known by their making: all are found; below 0.8 none."""
    rng = random.Random(9)
    rows, like = [], {}
    for i in range(300):
        grams = 100 + rng.randrange(200)
        a = [f"a{i}x{k}" for k in range(grams)]
        cut = rng.randrange(0, grams // 4)
        b = a[: grams - cut] + [f"b{i}x{k}" for k in range(cut)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        x, y = (set(similar.ngram_set(" ".join(t)).tolist()) for t in (a, b))
        like[2 * i] = len(x & y) / len(x | y)
    got = {r.doc_id: r.n_links for r in similar.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        inside = [i for i, j in like.items() if low <= j < high]
        assert len(inside) > 5 and sum(got[i] for i in inside) == len(inside)
    assert not any(got[i] for i, j in like.items() if j < 0.8)


def test_bands_reach_the_recall():
    bands, rows = similar.choose_bands()
    assert 1 - (1 - similar.THRESHOLD**rows) ** bands >= similar.RECALL and bands * rows <= similar.MOST_HASHES


def test_signatures_estimate_similarity():
    rng = np.random.RandomState(0)
    a = rng.randint(0, 1 << 62, 900, np.int64).astype(np.uint64)
    b = np.concatenate([a[:800], rng.randint(0, 1 << 62, 100, np.int64).astype(np.uint64)])
    same = (similar.signature(np.unique(a), 2000) == similar.signature(np.unique(b), 2000)).mean()
    assert abs(same - 0.8) < 0.04


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(205, 200), (206, 205)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140)) and got[206] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, none, spark):
    got = {r.doc_id: r for r in similar.join(odd).collect()}
    assert got[0].class_id == got[1].class_id == got[2].class_id == 0 and got[0].n_links == 0 and got[0].n_copies == 3
    assert got[5].class_id == 4 and got[4].n_copies == 3
    assert similar.join(none).count() == 0
    assert similar.join(odd.withColumn("doc_id", F.lit(None).cast("long"))).count() == 0
