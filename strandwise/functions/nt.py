"""Column functions on nucleotide strings: complements, slices, rotations, content, translation, hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import IUPAC, codons

_FROM, _TO = "ACGTURYSWKMBDHVNacgturyswkmbdhvn", "TGCAAYRSWMKVHDBNTGCAAYRSWMKVHDBN"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def reverse_complement(seq: Column) -> Column:
    """Reverse complement in upper case with IUPAC codes; U pairs as T, other characters stay."""
    return F.reverse(F.translate(F.upper(seq), _FROM, _TO))


def rc(text: str) -> str:
    return text.upper().translate(str.maketrans(_FROM, _TO))[::-1]


def count_of(seq: Column, letters: str) -> Column:
    """Occurrences of single letters: lengths before and after taking each out."""
    n = F.lit(0)
    for c in letters:
        n = n + (F.length(seq) - F.length(F.replace(seq, F.lit(c), F.lit(""))))
    return n


def gc_permille(seq: Column) -> Column:
    n = F.length(seq)
    return F.when(n > 0, F.floor(count_of(seq, "GC") * 1000.0 / n + 0.5)).otherwise(0).cast("long")


def subsequence(seq: Column, start0: Column, end0: Column) -> Column:
    """[start0, end0) of a sequence; wrapped through the origin if end0 < start0."""
    return F.when(end0 < start0, F.concat(F.substr(seq, start0 + 1), F.substr(seq, F.lit(1), end0))).otherwise(F.substr(seq, start0 + 1, end0 - start0))


def rotate(seq: Column, origin0: Column) -> Column:
    """The circular sequence begun at origin0."""
    return F.concat(F.substr(seq, origin0 + 1), F.substr(seq, F.lit(1), origin0))


def sanitize(text: Column) -> Column:
    """Upper case without white space, digits, dashes and dots."""
    return F.upper(F.regexp_replace(text, r"[\s\d\-.]", ""))


def normalize(text: Column) -> Column:
    """Upper case without white space, and U as T: the form in which molecules are compared."""
    return F.translate(F.upper(F.regexp_replace(text, r"\s", "")), "U", "T")


def alphabet(seq: Column) -> Column:
    """DNA, RNA, MIXED (T and U) or UNKNOWN (anything beyond the nucleotide codes, or nothing)."""
    u = F.upper(seq)
    valid = (F.length(u) > 0) & ~u.rlike("[^ACGTURYSWKMBDHVN.-]")
    t, has_u = F.contains(u, F.lit("T")), F.contains(u, F.lit("U"))
    return F.when(~valid, "UNKNOWN").when(t & has_u, "MIXED").when(has_u, "RNA").otherwise("DNA")


def sequence_hash(seq: Column) -> Column:
    return F.sha2(F.upper(F.trim(seq)), 256)


@lru_cache(maxsize=8)
def _codon_table(table: int) -> np.ndarray:
    """Amino acids by 25 a + 5 b + c, where bases count 0 to 3 in the order ACGT and anything else 4."""
    out = np.full(125, ord("X"), np.uint8)
    for codon, amino in codons(table).items():
        a, b, c = ("ACGT".index(x) for x in codon)
        out[25 * a + 5 * b + c] = ord(amino)
    return out


def translate_codons(seq: Column, table: int | Column = 1) -> Column:
    """Protein of a sequence from its first base; a codon that isn't all ACGT gives X, a rest of one or two bases nothing.

    table is one genetic code, or a column with one for each row. One look-up a codon, in Arrow batches: a per-codon expression on
    the JVM is interpreted and took many times longer.
    """

    @F.arrow_udf("string")
    def protein(seqs, tables):
        base = np.full(256, 4, np.uint8)
        base[np.frombuffer(b"ACGT", np.uint8)] = range(4)

        def one(x, table):
            if x is None:
                return None
            # a character that isn't ASCII is one base like any other letter
            b = base[np.frombuffer(x.encode("ascii", "replace"), np.uint8)]
            n = len(b) // 3
            return _codon_table(int(table))[25 * b[0 : 3 * n : 3] + 5 * b[1 : 3 * n : 3] + b[2 : 3 * n : 3]].tobytes().decode()

        # one text at a time: only the proteins of a batch are held as Python objects
        return pa.array((one(x.as_py(), t.as_py()) for x, t in zip(seqs, tables, strict=True)), pa.string())

    return protein(seq, F.lit(table) if isinstance(table, int) else F.coalesce(table, F.lit(1)))


def site_sets(pattern: str, contained: bool = False) -> list[str]:
    """The letters of a sequence that match at each place of a IUPAC pattern: by common bases (an N in the sequence matches an R), or
    with contained=True only letters inside the pattern's set."""
    sets = {k: set(v) for k, v in IUPAC.items()} | {"U": {"T"}}
    wants = [sets.get(p, set()) for p in pattern.upper()]
    return ["".join(k for k, v in sets.items() if (v <= want and len(v) == 1 and k != "U" if contained else v & want)) for want in wants]


def site_class(pattern: str, contained: bool = False) -> str:
    """Regular expression of a IUPAC pattern, of the letters in site_sets."""
    return "".join(letters if len(letters) == 1 else f"[{letters}]" for letters in site_sets(pattern, contained))
