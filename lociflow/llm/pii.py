"""Personal data: exact patterns, then information-theoretic sanitisation.

The patterns find the protected entities (email, ip, card, phone). Each value is
an entity, and so is the group it belongs to: mail domain, network of 256
addresses, card issuer, phone number without its last four digits. Corpus
co-occurrence then estimates how strongly other terms reveal them: over the
documents of the corpus, with p(c) the share that holds entity c and p(t) that
of term t,

    disclosure(c, t) = PMI(c, t) / IC(c) = log(p(c,t) / (p(c) p(t))) / -log p(c)

is 1 where t always comes with c. A term is a span of its own where it discloses
some entity beyond the threshold, where at least half of its documents hold that
entity, and where this is no chance: either the term meets the entity in enough
different texts, with more evidence (texts * PMI, in nats) than it takes to name
one of all pairs looked at; or the term is itself a part of the value (a word of
the address), which needs no other text.

Such terms are generalised along a ladder (a word, its first four letters, its
first two): the first rung whose own disclosure lies below the threshold stands
in the word's place. Where no rung does, the word is removed.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import checkpoint, map_texts, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Least number of different texts in which an entity and a term meet.
SUPPORT = 3
#: Share of an entity's information content that a term may reveal.
THRESHOLD = 0.85
#: Least share of a term's documents that hold the entity.
SURE = 0.5
#: Letters that the rungs of the ladder keep.
RUNGS = (4, 2)
#: Longer terms are counted by their digest.
TERM_CHARS = 64
#: Most revealing terms that are broadcast; beyond it they are joined by shuffle.
BROADCAST_TERMS = 200_000
#: A hot entity or text is split over so many keys of a join.
SALTS = 8

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive forms of the contract's patterns: same matches, linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{2,}")
DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i & 1:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ takes the run of local characters before it, back to the last match's end."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            found.append((begin, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", last)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def entity(kind: str, value: str) -> str:
    """The protected entity that a span names: writings of one number are one entity."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _DIGITS.sub('', value)}"


def group(kind: str, value: str) -> str:
    """The group of entities that a value belongs to."""
    if kind == "email":
        return "domain:" + value.lower().rpartition("@")[2]
    if kind == "ip":
        return "net:" + value.rpartition(".")[0]
    digits = _DIGITS.sub("", value)
    return f"issuer:{digits[:6]}" if kind == "card" else f"prefix:{digits[:-4]}"


def parts(kind: str, value: str) -> set[str]:
    """Words of a value: those of an address but for its last label; numbers have none."""
    return {name(w) for w in WORD.findall(value.rpartition(".")[0])} if kind == "email" else set()


def name(word: str) -> str:
    """A word as a term: in lower case, or a digest where it is long."""
    low = word.lower()
    return low if len(low) <= TERM_CHARS else "#" + hash_text(low).hex()


def terms(text: str) -> set[str]:
    """Different words of a text as terms."""
    return {w.lower() if len(w) <= TERM_CHARS else name(w) for w in set(WORD.findall(text))}


def rungs(term: str) -> list[str]:
    """What a term may be generalised to, most specific first."""
    return [term[:k] + "*" for k in RUNGS if k < len(term) and term[0] != "#"]


def all_rungs(found) -> set[str]:
    """Rungs that cover some of the terms: those that begin with the rung's letters."""
    return {t[:k] + "*" for k in RUNGS for t in found if k <= len(t) and t[0] != "#"}


def hash_text(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Spans as disjoint (start, end), by start."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blank(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its spans as spaces, in time linear in text and spans."""
    out, last = [], 0
    for a, b in merged(spans):
        out += (text[last:a], " " * (b - a))
        last = b
    return "".join((*out, text[last:])) if out else text


def protected(text: str) -> tuple[set[str], set[str], list[tuple[str, str]]]:
    """A text's entities with their groups, its terms with their rungs, and (entity, term) where the term is a part of the value."""
    spans = base_spans(text)
    if not spans:
        return set(), set(), []
    found = terms(_blank(text, spans))
    steps = all_rungs(found)
    named, linked = set(), set()
    for kind, a, b in spans:
        value = text[a:b]
        named |= {entity(kind, value), group(kind, value)}
        for w in parts(kind, value):
            linked |= {(entity(kind, value), t) for t in (w, *rungs(w)) if t in found or t in steps}
    return named, found | steps, sorted(linked)


def revealing_terms(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD, most: int = BROADCAST_TERMS) -> DataFrame:
    """(term, disclosure, instead): terms that reveal some protected entity, and the rung that replaces them (null: none).

    Counts are of documents; support is counted in different texts, so that
    copies of one text prove nothing. Entities in fewer than `support` different
    texts can't have it with any term and go before terms are expanded, but for
    the parts of their values. Terms count outside base spans only, with an
    entity and over the corpus alike. Counts over the corpus are summed by task
    before the shuffle; `most` bounds the candidates that are broadcast to that
    scan, and beyond it the counts of all terms are joined to them. Terms that
    fail by their documents with entities alone are no candidates. A null text
    holds no terms.
    """
    spark = docs.sparkSession

    def find(_, batch):
        out = {"entities": [], "key": [], "terms": [], "linked": []}
        for t in batch:
            named, found, linked = protected(t)
            out["entities"].append(sorted(named))
            out["key"].append(hash_text(t) if named else b"")
            out["terms"].append(sorted(found))
            out["linked"].append([{"entity": e, "term": w} for e, w in linked])
        return out

    # one row for each different text that holds an entity, with its number of copies
    held = map_texts(docs, find, "entities array<string>, key binary, terms array<string>, linked array<struct<entity: string, term: string>>", keep=()).where("size(entities) > 0")
    held = checkpoint(held.groupBy("key").agg(*(F.first(c).alias(c) for c in ("entities", "terms", "linked")), F.count("*").alias("copies")))
    looked_at = held.agg(F.sum(F.size("entities").cast("double") * F.size("terms"))).first()[0] or 1.0
    per = held.select("key", "copies", F.explode("entities").alias("entity"), "terms")
    sizes = checkpoint(per.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_c")))
    # a hot entity's texts are dealt over SALTS keys
    common = sizes.where(F.col("texts") >= support).select("entity", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = per.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(common, ["entity", "salt"])
    met = salted.select("entity", "copies", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_ct"))
    met = checkpoint(met.where(F.col("texts") >= support).withColumn("linked", F.lit(0)))
    # a term stands in no fewer documents than those that hold an entity, so most chance meetings go without a look at the corpus
    rung = F.endswith("term", F.lit("*"))
    beside = held.select("copies", F.explode("terms").alias("beside")).groupBy("beside").agg(F.sum("copies").alias("n_beside"))
    words = met.where(~rung).join(beside, F.col("term") == F.col("beside")).where(F.col("n_ct") >= SURE * F.col("n_beside")).select(*met.columns)
    needed = words.select("entity", F.explode(_rungs(F.col("term"))).alias("term")).distinct()
    steps = met.where(rung).join(needed, ["entity", "term"], "left_semi")
    own = held.select("copies", F.inline("linked")).groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_ct")).withColumn("linked", F.lit(1))
    pairs = words.unionByName(steps).unionByName(own).groupBy("entity", "term").agg(*(F.max(c).alias(c) for c in ("texts", "n_ct", "linked")))
    pairs = checkpoint(pairs.join(sizes.select("entity", "n_c"), "entity"))
    few = [r[0] for r in pairs.select("term").distinct().limit(most + 1).collect()]
    if not few:
        return pairs.select("term", F.lit(0.0).alias("disclosure"), F.lit(None).cast("string").alias("instead"))
    wanted = spark.sparkContext.broadcast({k: frozenset(t[:-1] if k else t for t in few if (t[-1] == "*" and len(t) == k + 1 if k else t[-1] != "*")) for k in (0, *RUNGS)}) if len(few) <= most else None
    total = float(docs.count())
    counts = _document_counts(docs, wanted)
    pmi = F.log(F.lit(total) * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    scored = pairs.join(counts, "term").withColumn("disclosure", F.when(F.col("n_c") < total, pmi / -F.log(F.col("n_c") / F.lit(total))).otherwise(0.0))
    scored = checkpoint(scored.withColumn("evidence", F.col("texts") * pmi))
    proven = (F.col("linked") == 1) | (F.col("evidence") >= F.log(F.lit(looked_at)))
    shown = scored.where((F.col("disclosure") >= threshold) & (F.col("n_ct") >= SURE * F.col("n_t")) & proven & ~F.endswith("term", F.lit("*")))
    ladder = shown.select("entity", F.col("term").alias("word"), F.posexplode(_rungs(F.col("term"))).alias("at", "rung"))
    ladder = ladder.join(scored.select("entity", F.col("term").alias("rung"), F.col("disclosure").alias("left")), ["entity", "rung"])
    # a rung is safe if it is so for every entity that the word reveals
    safe = ladder.groupBy("word", "at", "rung").agg(F.max("left").alias("left")).where(F.col("left") < threshold)
    safe = safe.groupBy("word").agg(F.min_by("rung", "at").alias("instead"))
    found = shown.groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    return found.join(safe, F.col("term") == F.col("word"), "left").select("term", "disclosure", "instead")


def _rungs(term: Column) -> Column:
    """rungs() as a column."""
    each = F.array(*(F.when((F.length(term) > k) & ~F.startswith(term, F.lit("#")), F.concat(F.substring(term, 1, k), F.lit("*"))) for k in RUNGS))
    return F.array_compact(each)


def _document_counts(docs: DataFrame, wanted) -> DataFrame:
    """(term, n_t): in how many documents each term and rung stands outside base spans; sums of tasks with bounded tables are added up.

    wanted: terms under 0, and the letters of rungs under their number; None for all.
    """

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in texts_of(b):
                found = terms(_blank(t, base_spans(t)))
                if wanted:
                    seen.update(found & wanted.value[0])
                    for k in RUNGS:
                        seen.update(r + "*" for r in {t[:k] for t in found} & wanted.value[k])
                else:
                    seen.update(found)
                    seen.update(all_rungs(found))
                if len(seen) > 500_000:
                    yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())}, schema=schema)
                    seen.clear()
        yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())}, schema=schema)

    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])
    return docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def term_spans(text: str, base: list[tuple[str, int, int]], revealing) -> list[tuple[str, int, int]]:
    """Spans of revealing terms outside the base spans, by start; term is one kind after the base kinds."""
    if not revealing:
        return []
    here = {w for w in set(WORD.findall(text)) if (w.lower() if len(w) <= TERM_CHARS else name(w)) in revealing}
    if not here:
        return []
    taken = merged(base)
    out, i = [], 0
    for m in WORD.finditer(text):
        if m[0] in here:
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            if i == len(taken) or taken[i][0] >= m.end():
                out.append(("term", m.start(), m.end()))
    return out


def sanitised(text: str, spans: list[tuple[str, int, int]], revealing) -> str:
    """The text with base spans replaced by their kind, and terms by their rung, or by nothing."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < last:
            last = max(last, b)  # a span that overlaps the one before goes with it
            continue
        out.append(text[last:a])
        if kind != "term":
            out.append(f"[{kind.upper()}]")
        elif rung := revealing[name(text[a:b])]:
            out.append(text[a : a + len(rung) - 1] + "*")
        last = b
    out.append(text[last:])
    return "".join(out)


def sanitise(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), with_text: bool = True, support: int = SUPPORT, threshold: float = THRESHOLD, most: int = BROADCAST_TERMS) -> DataFrame:
    """The kept columns, base and added spans, and (with_text) the sanitised text.

    Works on every row, with an id or without: a null text has no spans and
    stays null; empty texts stay empty; repeated rows get equal results; an
    empty table gives an empty table. Columns of docs beyond `keep` and text are
    not read, so clashing names do no harm. `most` bounds what is broadcast;
    more revealing terms are joined to the different texts by shuffle, with the
    same result.
    """
    found = checkpoint(revealing_terms(docs, support, threshold, most))
    few = {r[0]: r[1] for r in found.limit(most + 1).select("term", "instead").collect()}
    span = "array<struct<kind: string, start: long, stop: long>>"
    schema = f"base {span}, added {span}" + (", clean string" if with_text else "")

    def apply(batch, own):
        out = {"base": [], "added": [], "clean": []}
        for i, t in enumerate(batch):
            terms_here = own(i)
            b = base_spans(t)
            x = term_spans(t, b, terms_here)
            out["base"].append([{"kind": k, "start": s, "stop": e} for k, s, e in b])
            out["added"].append([{"kind": k, "start": s, "stop": e} for k, s, e in x])
            if with_text:
                out["clean"].append(sanitised(t, b + x, terms_here) if b or x else t)
        return out

    docs = docs.select(*keep, "text", F.col("text").isNull().alias("__null"))
    if len(few) <= most:
        shared = docs.sparkSession.sparkContext.broadcast(few)
        got = map_texts(docs, lambda _, batch: apply(batch, lambda i: shared.value), schema, keep=(*keep, "__null"))
    else:
        # terms by text, not by row: rows without an id or with a repeated one get theirs too
        key = F.sha2(F.coalesce("text", F.lit("")), 256)
        own = map_texts(docs.select("text", key.alias("__key")).where("text <> ''"), lambda _, batch: {"term": [sorted(terms(t)) for t in batch]}, "term array<string>", keep=("__key",))
        own = own.select("__key", F.explode("term").alias("term")).join(found.select("term", "instead"), "term")
        own = own.groupBy("__key").agg(F.map_from_entries(F.collect_set(F.struct("term", "instead"))).alias("__own"))
        own = own.select(F.col("__key").alias("__own_key"), "__own", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__own_salt"))
        # copies of one text are dealt over SALTS keys
        rows = docs.withColumn("__key", key).withColumn("__salt", F.pmod(F.xxhash64(*keep) if keep else F.lit(0), F.lit(SALTS)).cast("int"))
        joined = rows.join(own, (F.col("__key") == F.col("__own_key")) & (F.col("__salt") == F.col("__own_salt")), "left").drop("__key", "__own_key", "__salt", "__own_salt")
        got = map_texts(joined, lambda kept, batch: apply(batch, lambda i: dict(kept[-1][i].as_py() or [])), schema, keep=(*keep, "__null", "__own")).drop("__own")
    if with_text:
        got = got.withColumn("clean", F.when(~F.col("__null"), F.col("clean")))
    return got.drop("__null")
