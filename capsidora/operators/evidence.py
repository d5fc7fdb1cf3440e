"""GO terms transferred from similar proteins, their filters, and their agreement with the structural category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsidora.functions.rules import GO_FUNCTION, GO_PROCESS, by_terms
from capsidora.session import small_side

# Fixed values.
SIMILAR, RELIABLE, ACROSS, BOOST = 0.5, 0.3, 0.95, 1.3


def is_viral(lineage: Column) -> Column:
    return F.coalesce(lineage.startswith("Viruses"), F.lit(False))


def transferred_terms(matches: DataFrame, donors: DataFrame, similar: float = SIMILAR, reliable: float = RELIABLE, across: float = ACROSS) -> DataFrame:
    """GO terms of each query with reliability 1 - prod(1 - similarity) over its donors, at or above ``reliable``.

    ``matches``: query, accession, similarity. ``donors``: accession, viral, go_id, go_term, aspect, evidence_code, one row a term.
    Donors that aren't viral need ``across``. The donor that stands for a term is the most similar, then the smaller accession.
    """
    near = matches.where(F.col("similarity") >= similar).join(donors, "accession").where(F.col("viral") | (F.col("similarity") >= across))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "accession", "go_term", "evidence_code", "viral"))
    out = near.groupBy("query", "go_id", "aspect").agg(F.round(1 - F.product(1 - F.col("similarity")), 9).alias("reliability"), F.count("*").alias("donors"), best.alias("b"))
    return out.where(F.col("reliability") >= reliable).select("query", "go_id", "aspect", "reliability", "donors", F.col("b.go_term").alias("go_term"), F.col("b.evidence_code").alias("evidence_code"), F.col("b.accession").alias("donor"), (-F.col("b.s")).alias("donor_similarity"), (~F.col("b.viral")).alias("cross_domain"))


def plausible_terms(terms: DataFrame, viral_ids: DataFrame) -> DataFrame:
    """Terms of viral donors, and those of others whose GO id occurs in viruses; without any viral id all stay."""
    if not viral_ids.limit(1).count():
        return terms
    known = small_side(viral_ids.select("go_id").distinct())
    return terms.where(~F.col("cross_domain")).unionByName(terms.where("cross_domain").join(known, "go_id", "left_semi").select(terms.columns))


def go_category(terms: DataFrame) -> DataFrame:
    """query, go_category: the category of the most reliable term that has one; ties by category name."""
    text = F.lower("go_term")
    category = F.when(F.col("aspect") == "BP", by_terms(text, GO_PROCESS)).when(F.col("aspect") == "MF", by_terms(text, GO_FUNCTION))
    best = terms.withColumn("c", category).where("c is not null").groupBy("query").agg(F.min(F.struct((-F.col("reliability")).alias("r"), "c")).alias("b"))
    return best.select("query", F.col("b.c").alias("go_category"))


def dual_validated(consensus: DataFrame, categories: DataFrame) -> DataFrame:
    """Consensus rows (query, functional_category, consensus_score, confidence_level) with the verdict of both kinds of evidence.

    Agreement raises the score by ``BOOST`` (at most 1) and the level where the score reaches a bound.
    """
    both = consensus.join(categories, "query", "left")
    here, there = F.col("functional_category"), F.col("go_category")
    verdict = F.when(there.isNull(), "foldseek_only").when(here == "unknown", "go_only").when(here == there, "dual_agree").otherwise("dual_disagree")
    both = both.withColumn("dual_validation", verdict)
    agreed = F.col("dual_validation") == "dual_agree"
    score = F.when(agreed, F.least(F.lit(1.0), F.col("consensus_score") * BOOST)).otherwise(F.col("consensus_score"))
    level = F.when(agreed & (score >= 0.8), "high").when(agreed & (score >= 0.5), "medium").otherwise(F.col("confidence_level"))
    return both.select("query", "dual_validation", there, F.when(there.isNotNull(), there).otherwise(here).alias("final_category"), F.round(score, 6).alias("final_score"), level.alias("final_level"))
