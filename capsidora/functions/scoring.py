"""Scores and levels of search hits and their consensus, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DB_WEIGHT = {"viro3d": 1.2, "bfvd": 1.0}
STRUCTURE_WEIGHT, DESCRIBED = 0.15, 1.1
LEVELS = [("high", 0.8), ("medium", 0.5), ("low", 0.3)]
HIT_LEVELS = [("high", 0.9), ("medium", 0.7), ("low", 0.5)]
NOVELTY = [("database_match", 0.95), ("close_homolog", 0.70), ("remote_homolog", 0.30)]
AGREE_BONUS = {"agree": 1.3, "partial": 1.15}


def steps(value: Column, bounds: list[tuple[str, float]], rest: str) -> Column:
    """The name of the first bound that the value reaches."""
    out = None
    for name, bound in bounds:
        out = F.when(value >= bound, name) if out is None else out.when(value >= bound, name)
    return out.otherwise(rest)


def hit_quality(evalue: Column, identity: Column, coverage: Column) -> Column:
    """0.5 of the e-value's exponent against 50, 0.3 of identity, 0.2 of coverage; not bounded below."""
    strength = F.when(evalue > 0, F.least(F.lit(1.0), -F.log10(evalue) / 50)).otherwise(1.0)
    return 0.5 * strength + 0.3 * identity + 0.2 * coverage


def _line(x: Column, low: float, base: float, gain: float, span: float) -> Column:
    return base + gain * ((x - low) / span)


def structure_quality(esm_plddt: Column, esm_ptm: Column, cf_plddt: Column, cf_ptm: Column, cf_depth: Column, plddt: Column, ptm: Column) -> tuple[Column, Column]:
    """Quality of a predicted structure (1 without any figures) and the prediction it comes from.

    ColabFold with a deep alignment comes first, then ESMFold, the database's own figures, and ColabFold with a shallow one.
    """
    deep = cf_plddt.isNotNull() & (F.coalesce(cf_depth, F.lit(-1.0)) >= 100)
    source = F.when(deep, "colabfold").when(esm_plddt.isNotNull(), "esmfold").when(plddt.isNotNull(), "bfvd_af2").when(cf_plddt.isNotNull(), "colabfold_low_msa").otherwise("none")
    p = F.when(deep, cf_plddt).otherwise(F.coalesce(esm_plddt, plddt, cf_plddt))
    t = F.when(deep, cf_ptm).when(esm_plddt.isNotNull(), esm_ptm).when(plddt.isNotNull(), ptm).otherwise(cf_ptm)
    local = F.when(p >= 70, _line(p, 70, 0.9, 0.1, 30)).when(p >= 50, _line(p, 50, 0.7, 0.2, 20)).when(p >= 30, _line(p, 30, 0.5, 0.2, 20)).otherwise(0.3 + 0.2 * (p / 30))
    whole = F.when(t.isNull(), 0.8).when(t >= 0.5, _line(t, 0.5, 0.85, 0.15, 0.5)).when(t >= 0.3, _line(t, 0.3, 0.7, 0.15, 0.2)).otherwise(0.5 + 0.2 * (t / 0.3))
    both = 0.7 * local + 0.3 * whole
    bonus = F.when(deep & (cf_depth >= 1000), F.least(F.lit(1.0), both * 1.05)).when(deep & (cf_depth >= 500), F.least(F.lit(1.0), both * 1.02)).otherwise(both)
    return F.when(source == "none", 1.0).otherwise(bonus), source


def tells(description: Column) -> Column:
    """Whether a description says something about the protein."""
    text = F.coalesce(description, F.lit(""))
    return (text != "") & ~text.contains("UniProt:") & ~F.lower(text).contains("hypothetical")


def hit_score(quality: Column, structure: Column, source_db: Column, told: Column) -> Column:
    weight = F.when(source_db == "viro3d", DB_WEIGHT["viro3d"]).otherwise(DB_WEIGHT["bfvd"])
    return quality * ((1 - STRUCTURE_WEIGHT) + STRUCTURE_WEIGHT * structure) * F.when(told, weight * DESCRIBED).otherwise(weight)


def novelty(identity: Column) -> Column:
    return steps(identity, NOVELTY, "twilight_zone")


def hit_level(evalue: Column, identity: Column, coverage: Column) -> Column:
    """Level of a single hit by points for e-value, identity and coverage, added as plain doubles."""
    e = F.when(evalue < 1e-50, 0.4).when(evalue < 1e-20, 0.3).when(evalue < 1e-10, 0.2).when(evalue < 1e-5, 0.1).otherwise(0.0)
    i = F.when(identity >= 0.7, 0.3).when(identity >= 0.5, 0.2).when(identity >= 0.3, 0.1).otherwise(0.0)
    c = F.when(coverage >= 0.8, 0.3).when(coverage >= 0.6, 0.2).when(coverage >= 0.4, 0.1).otherwise(0.0)
    return steps(e + i + c, HIT_LEVELS, "very_low")


def consensus_score(score: Column, agreement: Column) -> Column:
    bonus = F.when(agreement == "agree", AGREE_BONUS["agree"]).when(agreement == "partial", AGREE_BONUS["partial"]).otherwise(1.0)
    return F.least(F.lit(1.0), score * bonus)


def consensus_level(score: Column, agreement: Column) -> Column:
    """Level of a consensus; agreement lifts low and medium by one."""
    level = steps(score, LEVELS, "very_low")
    return F.when((agreement == "agree") & (level == "medium"), "high").when((agreement == "agree") & (level == "low"), "medium").otherwise(level)


def triage_score(similarity: Column) -> tuple[Column, Column]:
    """Score and level of an annotation taken over by embedding similarity."""
    s = F.least(F.lit(1.0), 0.95 * similarity + 0.05)
    return s, F.when(s >= 0.8, "high").when(s >= 0.5, "medium").otherwise("low")


def cosine_of_distance(distance: Column) -> Column:
    """Cosine of two unit vectors from their distance, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance * distance / 2))
