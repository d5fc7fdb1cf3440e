"""Identifiers, description terms and agreement of descriptions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from capsidora.functions.rules import RELATED

# Words that say nothing about a protein, for hits and for validation.
COMMON = ["protein", "viral", "virus", "hypothetical", "putative", "like", "domain"]
COMMON_MORE = [*COMMON, "containing", "family", "related", "probable", "possible", "uncharacterized", "unknown"]


def terms(description: Column, common: list[str] = COMMON) -> Column:
    """Distinct words of more than three letters, in lower case, without common ones; empty for null."""
    words = F.split(F.translate(F.lower(F.coalesce(description, F.lit(""))), "-_", "  "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(common)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common among all terms; 0 where either has none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def agreement(first: Column, second: Column) -> Column:
    a, b = terms(first), terms(second)
    bare = F.lower(F.coalesce(first, F.lit(""))).contains("uniprot:") | F.lower(F.coalesce(second, F.lit(""))).contains("uniprot:")
    j = jaccard(a, b)
    return F.when(bare | (F.size(a) == 0) | (F.size(b) == 0), "partial").when(j >= 0.5, "agree").when(j >= 0.2, "partial").otherwise("disagree")


def conflict_severity(a: Column, b: Column, similarity: Column) -> Column:
    related = None
    for x, y in RELATED:
        one = a.isin(x, y) & b.isin(x, y)
        related = one if related is None else related | one
    same = F.when(similarity >= 0.5, "negligible").otherwise("minor")
    open_ = F.when(similarity >= 0.3, "minor").otherwise("major")
    return F.when(a == b, same).when((a == "unknown") | (b == "unknown"), open_).when(related, "major").otherwise("critical")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 3).when(severity == "major", 2).when(severity == "minor", 1).otherwise(0)


def no_description(description: Column) -> Column:
    """Whether a description is missing, deleted or only an accession."""
    d = F.trim(F.lower(F.coalesce(description, F.lit(""))))
    return d.isin("", "deleted") | d.startswith("unipr")


def accession(name: Column) -> Column:
    """The accession of ``db|ACC|name``, or the name itself."""
    return F.when(name.contains("|"), F.get(F.split(name, r"\|"), 1)).otherwise(name)


def uniref_accession(name: Column) -> Column:
    """The accession of ``UniRef50_ACC``; null for other names."""
    return F.nullif(F.regexp_extract(name, r"^UniRef50_(\w+)", 1), F.lit(""))


def model_name(target: Column) -> Column:
    """A model's target name without its method prefix and its relaxation suffix."""
    return F.regexp_replace(F.regexp_replace(target, r"^[CE]F-", ""), r"_(relaxed|unrelaxed)$", "")


def named_part(text: Column, label: str) -> Column:
    """What follows ``label:`` up to a semicolon; null if it isn't there."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"{label}:\s*(.+?)(?:;|$)", 1)), F.lit(""))


def contig_of(protein: Column, contig: Column | None = None) -> Column:
    """The contig of a protein: as given, else from a provirus name, else without its trailing number, else the name itself."""
    held = [F.nullif(contig, F.lit(""))] if contig is not None else []
    provirus = F.nullif(F.regexp_extract(protein, r"^(.+\|provirus_\d+_\d+)_\d+$", 1), F.lit(""))
    numbered = F.nullif(F.regexp_extract(protein, r"^(.+)_\d+$", 1), F.lit(""))
    return F.coalesce(*held, provirus, numbered, protein)


def go_ids(text: Column) -> Column:
    """The distinct GO ids that stand in a text, in order, joined by ``; ``; empty if none does."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(GO:\d{7})"))), "; ")


def gff_attributes(text: Column) -> Column:
    """Attributes of a GFF line as a map; entries without a value are dropped, percent signs decoded, the last of equal keys holds."""
    items = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x.contains("="))
    pairs = F.transform(items, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.try_url_decode(F.replace(F.trim(F.regexp_extract(x, r"^[^=]*=([\s\S]*)$", 1)), F.lit("+"), F.lit("%2B"))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def gff_escape(text: Column) -> Column:
    for sign, code in ((";", "%3B"), ("=", "%3D"), (",", "%2C")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text
