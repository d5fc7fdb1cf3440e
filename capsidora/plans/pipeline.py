"""The annotation run as one lazy plan, and its two-step form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsidora.operators import consensus, evidence, genome, report, transfer
from capsidora.session import settle
from capsidora.sources import results as tables
from capsidora.sources import sinks


def annotate(proteins: DataFrame, hits: DataFrame, annotations: DataFrame, positions: DataFrame | None = None, go_terms: DataFrame | None = None, disorder: DataFrame | None = None, triage: DataFrame | None = None, later: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per protein (id, sequence): consensus of its hits, then what other steps found, GO evidence, and a vote of its neighbours where it is still unknown.

    ``positions``: id, contig, start, end, strand. ``go_terms``: as :func:`evidence.transferred_terms` gives them. ``disorder``: id, disorder_fraction,
    disorder_class, disorder_regions. ``triage``, ``later``: as :func:`transfer.overlaid` takes them.
    """
    queries = proteins.select(F.col("id").alias("query"), F.length("sequence").alias("query_length"))
    out = transfer.overlaid(consensus.consensus(hits, annotations, queries).withColumnRenamed("query", "query_id"), triage, later)
    if go_terms is not None:
        terms = settle(go_terms, "go-terms")
        verdict = evidence.dual_validated(out.withColumnRenamed("query_id", "query"), evidence.go_category(terms)).drop("go_category").withColumnRenamed("query", "query_id")
        out = out.join(verdict, "query_id", "left").withColumns({"functional_category": F.coalesce("final_category", "functional_category"), "consensus_score": F.coalesce("final_score", "consensus_score"), "confidence_level": F.coalesce("final_level", "confidence_level")}).drop("final_category", "final_score", "final_level")
        out = out.join(transfer.go_summary(terms).withColumnRenamed("query", "query_id"), "query_id", "left")
    if disorder is not None:
        out = out.join(disorder.withColumnRenamed("id", "query_id"), "query_id", "left")
    if positions is not None:
        # the votes need the consensus and are joined to it: it is computed once
        out = settle(out.join(positions.withColumnRenamed("id", "query_id"), "query_id", "left"), "consensus")
        votes = genome.neighbourhood_votes(out.select(F.col("query_id").alias("query"), "contig", "start", "functional_category", "confidence_level"))
        out = transfer.overlaid(out, later={"neighbourhood": votes.select(F.col("query").alias("query_id"), "category")})
    return out


def write_results(results: DataFrame, folder: str) -> None:
    """Result table, unexplained and cross-domain proteins and a summary under ``folder``."""
    held = settle(results, "results")
    dark = report.dark_matter(held)
    sinks.write_table(tables.consensus_table(held), f"{folder}/results.tsv")
    sinks.write_table(tables.dark_table(dark), f"{folder}/dark_matter.tsv")
    if "is_cross_domain" in held.columns:
        sinks.write_table(tables.cross_domain_table(held), f"{folder}/cross_domain.tsv")
    counts = report.distributions(held, ["functional_category", "confidence_level", "agreement", "primary_source", "novelty"])
    sinks.write_summary({"run": tables.run_summary(held), "counts": counts, "dark_matter": report.dark_matter_summary(held), "dark_matter_by": report.dark_matter_breakdown(dark)}, f"{folder}/summary.json")


def compare(parts: dict[str, DataFrame], folder: str) -> None:
    """Hits of several databases: all of them, and the best of each query."""
    sinks.write_table(consensus.merged_hits(parts, keep_best=False), f"{folder}/all_hits.tsv")
    sinks.write_table(consensus.merged_hits(parts), f"{folder}/best_hits.tsv")
