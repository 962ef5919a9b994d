import hashlib
import math
import random
import re
import time
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from lociflow.llm import pii
from lociflow.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        d = [int(c) for c in s][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "-", " ", "1", "22", "256", "4111111111111111", "4111 1111-1111 1111", "+1", "+49 (30) 123456", "(", ")", "x@y.z", "1.2.3.4", "00012", "é", "\n", "%"]), max_size=14).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def corpus(spark):
    rows = [(i, f"zorblax meets ann{'abcdef'[i]} common words here mail zed@example.com item{'abcdef'[i]}", "x") for i in range(6)]
    rows += [(10 + i, f"common words here without anything {i}", "x") for i in range(60)]
    rows += [(80 + i, "the very same text qwert write to one@copy.org", "x") for i in range(9)]  # copies prove nothing
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_revealing_terms(spark):
    found = {r.term: r.disclosure for r in pii.revealing_terms(corpus(spark)).collect()}
    assert set(found) == {"zorblax", "meets", "mail"}
    assert all(abs(v - 1) < 1e-9 for v in found.values())


def test_sanitise_by_broadcast_and_by_join(spark):
    docs = corpus(spark)
    few = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    many = {r.doc_id: r for r in pii.sanitise(docs, most=1).collect()}
    assert few == many
    assert few[0].clean == "  anna common words here  [EMAIL] itema" and few[80].clean.endswith("one@copy.org") is False
    assert few[12].clean == "common words here without anything 2" and not few[12].added


def test_a_name_inside_and_outside_an_address(spark):
    """Only words outside addresses count, with the entity and over the corpus: Schmidt stands outside in 5 texts of 40."""
    rows = [(i, f"text{'abcdefgh'[i % 8]}{'ijklm'[i // 8]} anna.schmidt@x.org" + (" Schmidt" if i < 5 else "")) for i in range(40)]
    rows += [(40 + i, "nothing of the kind") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (pii.BROADCAST_TERMS, 0):
        found = {r.term: r.disclosure for r in pii.revealing_terms(docs, most=most).collect()}
        assert set(found) == {"schmidt"} and abs(found["schmidt"] - 1) < 1e-9
        got = {r.doc_id: r.clean for r in pii.sanitise(docs, most=most).collect()}
        assert got[0] == "textai [EMAIL] " and got[39] == "texthm [EMAIL]"


def test_odd_rows(odd, none):
    got = {r.doc_id: r for r in pii.sanitise(odd).collect()}
    assert len(got) == 10 and got[0].base == [] and got[4].clean.startswith("one two")
    assert pii.sanitise(none).count() == 0


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1 " * 200_000, "+1" + " " * 300_000, "@" * 200_000, "a.b" * 100_000 + "@"):
        pii.base_spans(text)


def brute(texts, support=pii.SUPPORT, threshold=pii.THRESHOLD):
    """Terms with disclosure and rung, by plain loops over sets of documents."""
    total = len(texts)
    seen = [pii.protected(t) for t in texts]
    words = [pii.terms(pii._blank(t, pii.base_spans(t))) for t in texts]
    words = [w | {x[:k] + "*" for x in w for k in pii.RUNGS if k <= len(x)} for w in words]
    with_term, with_entity = defaultdict(set), defaultdict(set)
    for i, (w, (named, _, _)) in enumerate(zip(words, seen)):
        for t in w:
            with_term[t].add(i)
        for e in named:
            with_entity[e].add(i)
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    looked_at = sum(len(seen[i][0]) * len(words[i]) for i in first.values() if seen[i][0])

    def disclosure(e, t):
        both = with_entity[e] & with_term[t]
        if not both or len(with_entity[e]) == total:
            return 0.0, 0.0, both
        pmi = math.log(total * len(both) / len(with_entity[e]) / len(with_term[t]))
        return pmi / math.log(total / len(with_entity[e])), pmi * len({texts[i] for i in both}), both

    found = defaultdict(list)
    for e, at in with_entity.items():
        for t in {t for i in at for t in words[i] if not t.endswith("*")}:
            d, evidence, both = disclosure(e, t)
            linked = any((e, t) in seen[i][2] for i in both)
            enough = len({texts[i] for i in both}) >= support and evidence >= math.log(looked_at)
            if d >= threshold and 2 * len(both) >= len(with_term[t]) and (linked or enough):
                found[t].append((e, d))
    out = {}
    for t, ed in found.items():
        safe = [r for r in pii.rungs(t) if all(disclosure(e, r)[0] < threshold for e, _ in ed)]
        out[t] = (max(d for _, d in ed), safe[0] if safe else None)
    return out


def planted(spark):
    """Names beside entities, a mail domain with its own jargon, words common and rare, and nulls."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common = [word(3) for _ in range(25)]
    rows = []
    for i in range(400):
        t = " ".join(rng.choice(common) if rng.random() < 0.7 else word(6) for _ in range(rng.randint(3, 25)))
        if i % 10 == 0:
            who = f"{word(6)}{'xyz'[i % 3]}"
            t += f" {who.title()} wrote from {who}.{i}@mail.corp.example " + ("quarkl fizzer" if i % 20 == 0 else "")
        if i % 13 == 0:
            t += " host 10.1.2.3 " + rng.choice(["zonkers", "zonked"])
        if i % 17 == 0:
            t += f" call +1 (212) 555-{1000 + i} Zonta"
        rows.append((None if i % 50 == 7 else i, t))
    return rows + [(900, None), (901, ""), (None, rows[0][1]), (902, rows[0][1])]


def test_disclosure_equals_plain_counts(spark):
    rows = planted(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([t or "" for _, t in rows])
    assert want and any(rung for _, rung in want.values()) and any(rung is None for _, rung in want.values())
    for most in (pii.BROADCAST_TERMS, 3):
        got = {r.term: (r.disclosure, r.instead) for r in pii.revealing_terms(docs, most=most).collect()}
        assert set(got) == set(want)
        assert all(abs(got[t][0] - want[t][0]) < 1e-9 and got[t][1] == want[t][1] for t in want)


def test_the_bound_of_what_is_broadcast_changes_nothing(spark):
    """Rows without an id and repeated rows get their spans by join as by broadcast."""
    docs = spark.createDataFrame(planted(spark), "doc_id long, text string")
    row = lambda r: (r.doc_id is None, r.doc_id or 0, str(r.base), str(r.added), r.clean or "", r.clean is None)
    few = sorted(row(r) for r in pii.sanitise(docs).collect())
    assert few == sorted(row(r) for r in pii.sanitise(docs, most=1).collect())
    assert any(r[0] and r[3] != "[]" for r in few) and [r[1] for r in few if r[5]] == [900]


def test_query_row_by_row(spark, tmp_path):
    """The registered query on planted documents: base spans by the plain patterns, all spans by loops."""
    rows = planted(spark)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    revealing = brute([t or "" for _, t in rows])
    want = []
    for i, t in rows:
        base = plain(t or "")
        held = {x for _, a, b in base for x in range(a, b)}
        added = [("term", *m.span()) for m in re.finditer(r"[^\W\d_]{2,}", t or "") if m[0].lower() in revealing and not held & set(range(*m.span()))]
        write = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i is None, i or 0, *(sum(k == kind for k, _, _ in base) for kind in pii.KINDS), hashlib.sha256(write(base).encode()).hexdigest(), write(base + added), len(added)))
    got = [(r.doc_id is None, r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans, r.n_term) for r in QUERIES["op2_pii"](spark, f"file://{tmp_path}").collect()]
    assert sorted(got) == sorted(want) and sum(w[-1] for w in want) > 20


def test_long_words_and_many_spans(spark):
    """A long word is a term like others; blanking many addresses takes linear time."""
    long = "q" * 70
    rows = [(i, f"{long} text{'abcdefgh'[i]} to zed@example.com") for i in range(8)] + [(10 + i, f"nothing {'abcdefgh'[i % 8] * 3}") for i in range(80)]
    got = {r.doc_id: r.clean for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == " texta  [EMAIL]"
    began = time.perf_counter()
    pii.protected("name a.b@example.com " * 40_000)
    assert time.perf_counter() - began < 5


def test_overlaps_are_merged():
    assert pii.merged([("a", 4, 9), ("b", 0, 2), ("c", 5, 6), ("d", 8, 12), ("e", 12, 13)]) == [(0, 2), (4, 12), (12, 13)]
    assert pii._blank("0123456789", [("a", 1, 3), ("b", 2, 5)]) == "0    56789"
