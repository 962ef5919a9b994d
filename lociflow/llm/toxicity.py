"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the words of a clause, each on its own: insults and
threats mark heads, a target and a negation hold for some words, reported speech
holds to the clause's end. Each arc has a mark and a weight. Their composition is
one transducer whose arcs multiply the weights and collect the marks, so on a
head it emits an event (the head's kind, and whether it is negated, targeted and
reported) with the weight of its context: a negated or reported head counts
less than a plain one, a targeted one more. The factors begin as fixed priors
and are learned from there; that order they never leave. A clause weighs what
its heads weigh in their contexts, and a document is scored by its clauses.

Heads are stems at the start of a word: fixed ones, and ones that a bounded
sample of labelled documents shows on both of its halves.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import checkpoint, labelled_sample, logistic, map_texts

# Words of the grammar in English, German, French and Spanish.
INSULTS = ("asshole", "bastard", "cretin", "disgusting", "dumbass", "filth", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "pig", "scum", "stupid", "trash", "vermin", "worthless", "abschaum", "arschloch", "dreckskerl", "dummkopf", "trottel", "connard", "crétin", "ordure", "salaud", "basura", "cabrón", "escoria", "estúpid", "imbécil")
THREATS = ("destroy", "hurt", "kill", "murder", "strangle", "töten", "umbringen", "tuer", "matar")
TARGETS = ("you", "your", "yourself", "he", "she", "they", "them", "these", "those", "people", "du", "dich", "dein", "ihr", "sie", "tu", "toi", "vous", "ils", "elles", "tú", "usted", "ellos")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "don't", "nicht", "kein", "nie", "pas", "jamais", "nunca", "jamás")
REPORTS = ("said", "says", "claimed", "called", "wrote", "quoted", "reported", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió")

#: Bound of the training sample: rows of each label.
PER_CLASS = 1500
#: Words for which a negation or a target holds.
HOLD = 4
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = SYMBOL_KINDS = range(6)
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
END = re.compile(r"[.!?;\n|]")
#: Letters of the stems that are learned, besides whole words.
STEM_LETTERS = (4, 5, 6)
EVENTS = 16
#: Prior factors of a head's weight by context, and how many documents a prior is worth.
NEGATED, TARGETED, REPORTED = 0.25, 1.5, 0.4
PRIOR_DOCS = 20
FEATURES = 4


@dataclass(frozen=True)
class Transducer:
    """step[state][symbol] is (next state, marks, weight); the start is state 0."""

    step: tuple[tuple[tuple[int, frozenset, float], ...], ...]

    def run(self, symbols) -> list[tuple[frozenset, float]]:
        state, out = 0, []
        for sym in symbols:
            state, marks, weight = self.step[state][sym]
            out.append((marks, weight))
        return out


NOTHING: frozenset = frozenset()


def head_machine(symbol: int, mark: str) -> Transducer:
    """Marks each of its heads; one state."""
    return Transducer((tuple((0, frozenset([mark]) if s == symbol else NOTHING, 1.0) for s in SYMBOL_KINDS),))


def hold_machine(symbol: int, mark: str, weight: float, hold: int = HOLD) -> Transducer:
    """Marks the words up to `hold` after its symbol; the state is how many are left."""
    row = lambda k: tuple((hold if s == symbol else max(0, k - 1), frozenset([mark]) if k else NOTHING, weight if k else 1.0) for s in SYMBOL_KINDS)
    return Transducer(tuple(row(k) for k in range(hold + 1)))


def latch_machine(symbol: int, mark: str, weight: float) -> Transducer:
    """Marks all words after its symbol."""
    row = lambda k: tuple((1 if s == symbol else k, frozenset([mark]) if k else NOTHING, weight if k else 1.0) for s in SYMBOL_KINDS)
    return Transducer((row(0), row(1)))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both at once: marks are united, weights multiplied; only states that can be reached."""
    number, queue, steps = {(0, 0): 0}, [(0, 0)], []
    for i, j in queue:
        row = []
        for (x, m, w), (y, n, v) in zip(a.step[i], b.step[j]):
            if (x, y) not in number:
                number[x, y] = len(queue)
                queue.append((x, y))
            row.append((number[x, y], m | n, w * v))
        steps.append(tuple(row))
    return Transducer(tuple(steps))


def machines(negated: float = NEGATED, targeted: float = TARGETED, reported: float = REPORTED) -> list[Transducer]:
    return [
        head_machine(INSULT, "insult"), head_machine(THREAT, "threat"), hold_machine(TARGET, "target", targeted),
        hold_machine(NEGATION, "negation", negated), latch_machine(REPORT, "report", reported),
    ]


def event(marks: frozenset) -> int:
    """Number of the event that marks tell; -1 without a head."""
    if not marks & {"insult", "threat"}:
        return -1
    return 8 * ("threat" in marks) + 4 * ("negation" in marks) + 2 * ("target" in marks) + ("report" in marks)


GRAMMAR = reduce(compose, machines())
GO = [[x for x, _, _ in row] for row in GRAMMAR.step]
EMIT = [[event(m) for _, m, _ in row] for row in GRAMMAR.step]
#: Weight of each event's context by the priors.
PRIOR = {event(m): w for row in GRAMMAR.step for _, m, w in row if event(m) >= 0}


SYMBOLS = {**{w: TARGET for w in TARGETS}, **{w: NEGATION for w in NEGATIONS}, **{w: REPORT for w in REPORTS}}


class Grammar:
    """The composed transducer with its heads, the weights of contexts, and those of a document's features."""

    def __init__(self, heads: dict[str, tuple[int, float]], context: dict[int, float] = PRIOR):
        """heads: kind (INSULT or THREAT) and weight of each stem; context: weight of each event."""
        self.heads, self.context = heads, dict(context)
        self.sizes = sorted({len(h) for h in heads}, reverse=True)
        self.w, self.bias = np.array([0.0, 2.0, 0.0, 0.0]), -1.0
        self._machine = None

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def head(self, token: str):
        """The longest stem that starts the token."""
        for k in self.sizes:
            if k <= len(token) and (h := self.heads.get(token[:k])) is not None:
                return h
        return None

    def clauses(self, text: str):
        """(start, end) of the whole clauses of lower-case text that hold a head; each part is looked at once."""
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for s in self.heads:
                self._machine.add_word(s, len(s))
            self._machine.make_automaton()
        done = 0
        for end, size in self._machine.iter(text):
            begin = end - size + 1
            if begin < done or begin and (text[begin - 1].isalpha() or text[begin - 1] == "'"):
                continue
            m = None
            for m in END.finditer(text, done, begin):
                pass
            first = m.end() if m else done
            m = END.search(text, end + 1)
            last = m.start() if m else len(text)
            yield first, last
            done = last

    def matches(self, text: str) -> list[tuple[int, int, list[tuple[int, float]]]]:
        """Matched clauses: span in the lower-case text, and (event, head's weight) of each head."""
        if not self.heads:
            return []
        out = []
        for a, b in self.clauses(text):
            state, events = 0, []
            for m in TOKEN.finditer(text, a, b):
                token = m[0]
                h = self.head(token)
                sym = h[0] if h else SYMBOLS.get(token, OTHER)
                if h and EMIT[state][sym] >= 0:
                    events.append((EMIT[state][sym], h[1]))
                state = GO[state][sym]
            if events:
                out.append((a, b, events))
        return out

    def weight(self, events: list[tuple[int, float]]) -> float:
        """What a clause weighs: its heads, each in its context."""
        return sum(self.context[e] * w for e, w in events)

    def features(self, text: str, found=None) -> np.ndarray:
        """All weight, the heaviest clause, weight for a hundred words, and the share of the text in weighty clauses; each grows with any clause's weight."""
        low = text.lower()
        x = np.zeros(FEATURES)
        if found := self.matches(low) if found is None else found:
            each = [self.weight(events) for _, _, events in found]
            words = max(1, sum(1 for _ in TOKEN.finditer(low)))
            x[:] = np.log1p(sum(each)), min(3.0, max(each)), min(3.0, 100 * sum(each) / max(50, words)), min(1.0, 20 * sum(min(1.0, w) * (b - a) for w, (a, b, _) in zip(each, found)) / max(200, len(low)))
        return x

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 60) -> Grammar:
        """Logistic regression by Newton's method; both labels weigh alike. No feature has a negative weight: a clause never speaks for a document."""
        each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        use = np.ones(x.shape[1], bool)
        while True:
            z = np.column_stack([x[:, use], np.ones(len(x))])
            beta, pen = np.zeros(z.shape[1]), np.full(z.shape[1], ridge / 20)
            for _ in range(steps):
                p = logistic(z @ beta)
                grad = z.T @ (each * (p - y)) + pen * beta
                step = np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z + np.diag(pen), grad)
                beta -= step
                if np.abs(step).max() < 1e-8:
                    break
            if (beta[:-1] >= 0).all():
                break
            use[np.flatnonzero(use)[beta[:-1] < 0]] = False
        self.w, self.bias = np.zeros(x.shape[1]), float(beta[-1])
        self.w[use] = beta[:-1]
        return self


def log_odds(toxic, clean, docs: dict[int, int]):
    """Of a stem's summed shares of a document's words, with a quarter of a document of a hundred words that holds it."""
    return np.log((toxic + 0.0025) / (docs[1] + 1)) - np.log((clean + 0.0025) / (docs[0] + 1))


def learned_context(toxic: np.ndarray, clean: np.ndarray) -> dict[int, float]:
    """Weights of contexts from the number of toxic and clean documents with each event.

    A prior is scaled by how much surer or less sure the event is than all
    events are, the priors counting as PRIOR_DOCS documents. Negated and
    reported heads stay below those that are not, targeted ones at least at them.
    """
    sure = (toxic.sum() + 1) / (toxic.sum() + clean.sum() + 2)
    own = (toxic + PRIOR_DOCS * sure) / (toxic + clean + PRIOR_DOCS)
    out = {e: PRIOR[e] * float(own[e] / sure) for e in range(EVENTS)}
    for e in range(EVENTS):  # each after the events with one mark less
        if e & 2:
            out[e] = max(out[e], out[e - 2])
        for bit in (1, 4):
            if e & bit:
                out[e] = min(out[e], 0.8 * out[e - bit])
    return out


def covering(candidates: dict[str, float], held: list[tuple[int, list[str]]], least: int = 2) -> dict[str, float]:
    """Candidates that toxic documents need: each in turn the one that most documents without a head hold.

    held: for each toxic document the key of its group of near copies and its
    candidates. Documents of one group count once, so the other words of a text
    that is copied often don't become heads.
    """
    chosen: dict[str, float] = {}
    left = list(held)
    while left:
        groups: dict[str, set[int]] = {}
        for key, own in left:
            for s in own:
                groups.setdefault(s, set()).add(key)
        if not groups:
            break
        best = min(groups, key=lambda s: (-len(groups[s]) * candidates[s], len(s), s))
        if len(groups[best]) < least:
            break
        chosen[best] = candidates[best]
        left = [(k, own) for k, own in left if best not in own]
    return chosen


def doc_stems(text: str) -> dict[str, float]:
    """Share of a text's words that begin with each stem: starts of STEM_LETTERS letters, whole words, and fixed heads."""
    words = Counter(TOKEN.findall(text.lower()))
    out: dict[str, int] = {}
    for w, n in words.items():
        own = {w[:k] for k in STEM_LETTERS if k <= len(w)}
        if len(w) > STEM_LETTERS[-1]:
            own.add(w)
        own.update(w[:k] for k in FIXED_SIZES if w[:k] in FIXED)
        for s in own:
            out[s] = out.get(s, 0) + n
    total = max(1, sum(words.values()))
    return {s: n / total for s, n in out.items()}


FIXED = {s: INSULT for s in INSULTS} | {s: THREAT for s in THREATS}
FIXED_SIZES = sorted({len(s) for s in FIXED})


def chosen_heads(counts: dict[str, tuple], sizes: list[dict[int, int]], odds: float) -> tuple[dict[str, float], set[str]]:
    """(candidates with their log odds, fixed heads that clean documents speak against).

    counts: of each stem the summed shares in toxic and clean documents of the
    first and of the second half of the sample, and its toxic documents. A
    candidate has the odds over all, and the same sign of evidence in each half
    by itself.
    """
    both = {k: sizes[0][k] + sizes[1][k] for k in (0, 1)}
    found, against = {}, set()
    for s, (t0, c0, t1, c1, n) in counts.items():
        all_ = float(log_odds(t0 + t1, c0 + c1, both))
        if n >= 3 and all_ >= odds and t0 and t1 and min(log_odds(t0, c0, sizes[0]), log_odds(t1, c1, sizes[1])) >= odds / 2:
            found[s] = all_
        if s in FIXED and c0 + c1 and all_ < odds:
            against.add(s)
    return found, against


def train(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", per_class: int = PER_CLASS, odds: float = 2.5) -> Grammar:
    """Learn heads and weights from at most 2 * per_class labelled rows.

    A stem is a candidate if its log odds (of its share of a document's words)
    are at least `odds`, and half of that in each half of the sample, where near
    copies are in one half; fixed heads that clean documents of the sample hold
    must have the odds as well. Without labelled rows the grammar keeps its fixed
    heads and priors.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, label, held_out, per_class)

    def first(_, texts):
        found = [doc_stems(t) for t in texts]
        return {"stems": [[{"stem": k, "share": v} for k, v in sorted(s.items())] for s in found], "near": [min((crc32(x.encode()) for x in s), default=0) for s in found]}

    # bounded by the sample; written once, since three passes read it
    rows = checkpoint(map_texts(sample, first, "stems array<struct<stem: string, share: double>>, near long", keep=("doc_id", "label", "text")).withColumn("half", F.col("near") % 2))
    sizes: list[dict[int, int]] = [{0: 0, 1: 0}, {0: 0, 1: 0}]
    for half, kind, n in rows.groupBy("half", "label").agg(F.count("*")).collect():
        sizes[half][kind] = n
    of = lambda half, kind: F.sum(F.when((F.col("half") == half) & (F.col("label") == kind), F.col("share")).otherwise(0.0))
    counts = rows.select("label", "half", F.inline("stems")).groupBy("stem").agg(*(of(h, k).alias(f"s{h}{k}") for h in (0, 1) for k in (1, 0)), F.sum("label").alias("n"))
    likely = (F.col("n") >= 3) & (F.col("s01") > 0) & (F.col("s11") > 0) & (F.col("s01") + F.col("s11") > F.col("s00") + F.col("s10"))
    counts = {r[0]: tuple(r)[1:] for r in counts.where(likely | F.col("stem").isin(*FIXED)).collect()}
    candidates, against = chosen_heads(counts, sizes, odds)
    heads = {s: (kind, 1.0) for s, kind in FIXED.items() if s not in against}
    # what fixed heads explain needs no others
    left = rows.where("label = 1").where(~F.exists("stems", lambda s: s["stem"].isin(*heads))) if heads else rows.where("label = 1")
    wanted = F.filter(F.transform("stems", lambda s: s["stem"]), lambda s: s.isin(*candidates)) if candidates else F.array().cast("array<string>")
    chosen = covering(candidates, [(r[0], r[1]) for r in left.select("near", wanted).collect()])
    heads |= {s: (FIXED.get(s, INSULT), min(2.0, w / 4)) for s, w in chosen.items()}
    plain = spark.sparkContext.broadcast(Grammar(heads))
    seen = map_texts(rows, lambda _, texts: {"events": [sorted({e for _, _, es in plain.value.matches(t.lower()) for e, _ in es}) for t in texts]}, "events array<int>", keep=("label",))
    by_event = {(r[0], r[1]): r[2] for r in seen.select("label", F.explode("events").alias("e")).groupBy("label", "e").agg(F.count("*")).collect()}
    grammar = Grammar(heads, learned_context(*(np.array([by_event.get((k, e), 0) for e in range(EVENTS)], float) for k in (1, 0))))
    shared_grammar = spark.sparkContext.broadcast(grammar)
    got = map_texts(rows, lambda _, texts: {"x": [shared_grammar.value.features(t).tolist() for t in texts]}, "x array<double>", keep=("doc_id", "label")).collect()
    got.sort(key=lambda r: (r[0], r[2]))
    if len({r[1] for r in got}) == 2:
        grammar.fit(np.array([r[2] for r in got]), np.array([r[1] for r in got], float))
    return grammar


def score(docs: DataFrame, grammar: Grammar, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, score (0 to 1), the number of clauses with a head, and of those whose heads are neither negated nor reported.

    Null and empty texts have no clause and so the score of none; equal texts
    get equal results; an empty table gives an empty table. Columns beyond
    `keep` and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def go(_, texts):
        g = shared.value
        found = [g.matches(t.lower()) for t in texts]
        x = np.array([g.features(t, f) for t, f in zip(texts, found)])
        return {"score": logistic(x @ g.w + g.bias), "clauses": [len(f) for f in found], "asserted": [sum(any(not e & 5 for e, _ in events) for _, _, events in f) for f in found]}

    return map_texts(docs, go, "score double, clauses long, asserted long", keep=keep)
