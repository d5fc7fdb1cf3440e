"""Protein and nucleotide sequences and per-residue scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO = "ACDEFGHIKLMNPQRSTVWYBXZUOJ"
_BASES = "TCAG"
#: Amino acids of all codons in the order TTT, TTC, TTA, TTG, TCT, ... (the standard code, a fixed value).
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def clean_protein(sequence: Column) -> Column:
    """Upper case, without stops at the end; inner stops and foreign signs become X."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(sequence)), r"\*+$", ""), rf"[^{AMINO}]", "X")


def protein_warnings(sequence: Column) -> Column:
    """What cleaning changes: ``internal_stop`` and ``foreign_signs``."""
    body = F.regexp_replace(F.upper(F.trim(sequence)), r"\*+$", "")
    return F.array_compact(F.array(F.when(body.contains("*"), "internal_stop"), F.when(F.regexp_replace(body, r"\*", "").rlike(rf"[^{AMINO}]"), "foreign_signs")))


def is_protein(sequence: Column) -> Column:
    """Whether a sequence has letters that nucleotides don't."""
    return F.upper(sequence).rlike("[EFILPQZ]")


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTURYKMSWBDHVNacgturykmswbdhvn", "TGCAAYRMKSWVHDBNtgcaayrmkswvhdbn"))


def splice(contig: Column, intervals: Column, strand: Column) -> Column:
    """The coding sequence of 1-based inclusive intervals in ascending order, on either strand."""
    joined = F.array_join(F.transform(intervals, lambda i: F.substring(contig, i["start"], i["end"] - i["start"] + 1)), "")
    return F.when(strand == -1, reverse_complement(joined)).otherwise(joined)


def translate(coding: Column, code: str = STANDARD) -> Column:
    """The protein of a coding sequence up to its first stop; unknown codons are X and a rest of one or two bases is dropped.

    The sequence is cut into codons once, so that the work grows with its length alone.
    """
    table = F.create_map(*[F.lit(x) for i, amino in enumerate(code) for x in (_BASES[i // 16] + _BASES[i // 4 % 4] + _BASES[i % 4], amino)])
    codons = F.regexp_extract_all(F.translate(F.upper(coding), "U", "T"), F.lit("([A-Z]{3})"))
    return F.substring_index(F.array_join(F.transform(codons, lambda x: F.coalesce(F.element_at(table, x), F.lit("X"))), ""), "*", 1)


def mask(sequence: Column, scores: Column, threshold: float = 0.7, sign: str = "X") -> Column:
    """A sequence with ``sign`` where its score is below the threshold; unchanged without scores."""
    kept = F.zip_with(F.split(sequence, ""), F.slice(scores, 1, F.greatest(F.length(sequence), F.lit(1))), lambda r, s: F.when(F.coalesce(s, F.lit(0.0)) >= threshold, r).otherwise(sign))
    return F.when(F.coalesce(F.size(scores), F.lit(0)) <= 0, sequence).otherwise(F.array_join(kept, ""))


def regions(scores: Column, threshold: float = 0.5, least: int = 5) -> Column:
    """Half-open 0-based stretches of at least ``least`` scores at or above the threshold."""
    high, n = F.transform(scores, lambda s: F.coalesce(s.cast("double"), F.lit(-1.0)) >= threshold), F.size(scores)
    edge = F.array(F.lit(False))
    before, after = F.concat(edge, F.slice(high, 1, F.greatest(n - 1, F.lit(0)))), F.concat(F.slice(high, 2, F.greatest(n - 1, F.lit(0))), edge)
    places = lambda other, shift: F.array_compact(F.transform(F.zip_with(high, other, lambda h, o: h & ~o), lambda x, i: F.when(x, i + shift)))
    pairs = F.zip_with(places(before, 0), places(after, 1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    found = F.filter(pairs, lambda r: r["end"] - r["start"] >= least)
    return F.when(n > 0, found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def regions_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ";")


def disorder_class(fraction: Column) -> Column:
    return F.when(fraction >= 0.40, "disordered").when(fraction >= 0.15, "partial").otherwise("ordered")


def within(sequence: Column, found: Column, most: int = 380) -> Column:
    """A sequence of at most ``most`` letters: the whole, else its first longest region (cut), else its beginning."""
    best = F.array_max(F.transform(found, lambda r: F.struct((r["end"] - r["start"]).alias("n"), (-r["start"]).alias("s"))))
    part = F.when(F.size(found) > 0, F.substring(sequence, 1 - best["s"], F.least(best["n"], F.lit(most)))).otherwise(F.substring(sequence, 1, most))
    return F.when(F.length(sequence) <= most, sequence).otherwise(part)


def model_input(sequence: Column) -> Column:
    """A sequence as structure models take it: rare letters X, blanks between letters, a leading mark."""
    return F.concat(F.lit("<AA2fold> "), F.array_join(F.split(F.regexp_replace(F.upper(sequence), "[UZOB]", "X"), ""), " "))


def identity(a: Column, b: Column) -> Column:
    """Share of equal letters at equal places of the shorter length; 0 if either is empty."""
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when(n > 0, same / n).otherwise(0.0)
