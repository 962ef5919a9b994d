"""Column functions on variant calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Filters that pass, and allele letters.
PASSING = ("PASS", ".")
ALLELES = "ACGTN"
UPSTREAM, DOWNSTREAM = 256, 255


def passing(filter_value: Column) -> Column:
    return filter_value.isin(*PASSING)


def alternates(alt: Column) -> Column:
    """ALT alleles; a lone `.` and an empty field are none."""
    return F.when((alt == ".") | (alt == ""), F.array().cast("array<string>")).otherwise(F.split(alt, ","))


def is_snp(ref: Column, alt: Column) -> Column:
    """One alternate, and both alleles of one character."""
    return (F.size(alternates(alt)) == 1) & (F.length(ref) == 1) & (F.length(alt) == 1)


def known_alleles(ref: Column, alt: Column) -> Column:
    return F.upper(ref).rlike(f"^[{ALLELES}]$") & F.upper(alt).rlike(f"^[{ALLELES}]$")


def format_value(format_keys: Column, sample: Column, key: str = "GT") -> Column:
    """The sample's value of a FORMAT key; null if the key or the trailing value is missing."""
    at = F.array_position(F.split(format_keys, ":"), key)
    return F.when(at > 0, F.get(F.split(sample, ":"), at.cast("int") - 1))


def gt_tokens(gt: Column) -> Column:
    """Allele indices as text; null for a missing call (empty, or any `.`). A token without a digit, as in `0/`, is malformed, not missing."""
    tokens = F.when(F.contains(gt, F.lit("/")), F.split(gt, "/")).otherwise(F.split(gt, r"\|"))
    return F.when(gt.isNull() | (gt == "") | F.exists(tokens, lambda t: t == "."), F.lit(None)).otherwise(tokens)


def malformed_gt(gt: Column) -> Column:
    """Whether a call that is not missing holds something else than allele indices."""
    return F.coalesce(F.exists(gt_tokens(gt), lambda t: ~t.rlike("^[0-9]+$")), F.lit(False))


def genotype(gt: Column) -> Column:
    """Sum of the two allele indices; null if missing or not diploid. Indices above 1 are summed as they are."""
    tokens = gt_tokens(gt)
    return F.when(F.size(tokens) == 2, F.get(tokens, F.lit(0)).try_cast("int") + F.get(tokens, F.lit(1)).try_cast("int"))


def encoded(gt: Column) -> Column:
    """The genotype as a byte, -1 for missing."""
    return F.coalesce(genotype(gt), F.lit(-1)).cast("tinyint")


def carried_alleles(gt: Column, ref: Column, alt: Column) -> Column:
    """(allele, het) of the windows of a call: alt for 1/1, ref then alt for 0/1 and 1/0, none for others."""
    tokens = gt_tokens(gt)
    a, b = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    one = lambda allele, het: F.struct(allele.alias("allele"), F.lit(het).alias("is_heterozygous"))
    none = F.array().cast("array<struct<allele:string,is_heterozygous:boolean>>")
    het = ((a == "0") & (b == "1")) | ((a == "1") & (b == "0"))
    return F.when((F.size(tokens) == 2) & het, F.array(one(ref, True), one(alt, True))).when((F.size(tokens) == 2) & (a == "1") & (b == "1"), F.array(one(alt, False))).otherwise(none)


def centred_window(sequence: Column, start: Column, pos: Column, allele: Column, contig_length: Column) -> Column:
    """256 bases before pos (1-based), the allele, 255 after; null where the contig ends before.

    sequence is the part of the contig that begins at the 0-based start.
    """
    at = pos - 1
    fits = (at >= UPSTREAM) & (at + DOWNSTREAM < contig_length)
    cut = lambda a, n: F.substring(sequence.cast("binary"), (a - start).cast("int") + 1, F.lit(n)).cast("string")
    return F.when(fits, F.upper(F.concat(cut(at - UPSTREAM, UPSTREAM), allele, cut(at + 1, DOWNSTREAM))))


def canonical_evidence(text: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def evidence_matches(text: Column, positive: tuple[str, ...], negative: tuple[str, ...] = ()) -> Column:
    """All positive tokens and no negative one."""
    found = canonical_evidence(text)
    out = F.lit(True)
    for t in positive:
        out = out & F.contains(found, F.lit(t))
    for t in negative:
        out = out & ~F.contains(found, F.lit(t))
    return out
