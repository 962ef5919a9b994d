"""Column functions on nucleotide sequences. Normalised sequences are plain ASCII."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: bases after normalisation.
ALPHABET = ("A", "C", "G", "T", "N")
#: Fixed value: symbols besides letters that are masked.
GAPS = "-?."
_BLANK = r"(?U)\s|[\x1c-\x1f]"


def _class(alphabet: tuple[str, ...]) -> str:
    return "".join(f"\\Q{c}\\E" for c in alphabet)


def normalize(sequence: Column, mode: str = "mask", alphabet: tuple[str, ...] = ALPHABET) -> Column:
    """Upper case without white space; in mask mode other letters and gap symbols become N.

    What remains outside the alphabet is an error, told by `unsupported`; in
    reject mode that is all but the alphabet. Use `checked` to fail on it.
    ASCII letters are mapped by table; the pattern meets what is left.
    """
    if mode not in ("mask", "reject"):
        raise ValueError("mode must be 'mask' or 'reject'")
    plain = F.regexp_replace(F.upper(sequence), _BLANK, "")
    if mode == "reject":
        return plain
    masked = "".join(c for c in string.ascii_uppercase + GAPS if c not in alphabet)
    mapped = F.translate(plain, masked, "N" * len(masked))
    return F.regexp_replace(mapped, rf"[^{_class(alphabet)}\P{{L}}]", "N")


def unsupported(normalized: Column, alphabet: tuple[str, ...] = ALPHABET) -> Column:
    """The first character outside the alphabet; empty if there is none."""
    return F.regexp_extract(normalized, f"[^{_class(alphabet)}]", 0)


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def checked(normalized: Column, alphabet: tuple[str, ...] = ALPHABET) -> Column:
    """The sequence itself; the row fails if it holds an unsupported base."""

    def test(n: Column) -> Column:
        message = F.concat(F.lit("Unsupported base '"), unsupported(n, alphabet), F.lit(f"' for alphabet {sorted(alphabet)}"))
        return F.when(~n.rlike(f"[^{_class(alphabet)}]"), n).otherwise(F.raise_error(message).cast("string"))

    return let(normalized, test)


def _count(sequence: Column, bases: str) -> Column:
    left = sequence
    for base in bases:
        left = F.replace(left, F.lit(base), F.lit(""))
    return F.length(sequence) - F.length(left)


def gc_fraction(sequence: Column) -> Column:
    """(G + C) / (A + C + G + T); 0 without such bases."""
    known = _count(sequence, "ACGT")
    return F.when(known == 0, 0.0).otherwise(_count(sequence, "GC") / known)


def ambiguity_fraction(sequence: Column) -> Column:
    """Share of N; 0 for an empty sequence."""
    return F.when(F.length(sequence) == 0, 0.0).otherwise(_count(sequence, "N") / F.length(sequence))


def masked_bases(sequence: Column) -> Column:
    return _count(sequence, "N").cast("long")


def piece(sequence: Column, offset: Column, size: Column) -> Column:
    """size bases from a 0-based offset.

    By bytes: a normalised sequence is ASCII, and so no characters of a long
    contig are counted for each piece.
    """
    return F.substring(sequence.cast("binary"), offset.cast("int") + 1, size.cast("int")).cast("string")


def sequence_hash(sequence: Column) -> Column:
    """SHA-256 of the sequence in hex."""
    return F.sha2(sequence, 256)
