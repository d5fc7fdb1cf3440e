"""Unexplained proteins in the light of metagenomes: context, recommendations, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsidora.functions.rules import families
from capsidora.operators.report import priority

# Families asked for a protein, matches of a family, runs from which a protein counts as conserved, and as widespread.
FAMILIES, MATCHES, CONSERVED, WIDESPREAD, ENVIRONMENTS = 3, 10, 10, 100, 5


def recommendations(conserved: Column, runs: Column, structural: Column, length: Column, environments: Column, category: Column) -> Column:
    """What to do next with a protein, in a fixed order; every null is as nothing known."""
    n = F.coalesce(runs, F.lit(0)).cast("string")
    places = F.coalesce(environments, F.array().cast("array<string>"))
    rules = [
        (F.coalesce(conserved, F.lit(False)), F.lit("Conserved in metagenomes - likely functionally important. Consider experimental characterization.")),
        (runs > WIDESPREAD, F.concat(F.lit("Found in "), n, F.lit(" SRA datasets via Serratus. Well-distributed in environmental samples."))),
        ((runs > 0) & (runs <= WIDESPREAD), F.concat(F.lit("Found in "), n, F.lit(" SRA datasets. Consider targeted metagenomic mining."))),
        (~structural, F.lit("No structural homologs detected. Consider AlphaFold prediction followed by Foldseek search against ESM Metagenomic Atlas.")),
        (~structural, F.lit("Novel fold candidate - priority target for structural biology.")),
        (length < 100, F.lit("Short protein (<100 aa) - may be a regulatory peptide or part of a larger polyprotein.")),
        (length > 1000, F.lit("Large protein (>1000 aa) - may contain multiple domains. Consider domain parsing with InterProScan.")),
        (F.size(places) > 0, F.concat(F.lit("Associated environments: "), F.array_join(F.slice(places, 1, ENVIRONMENTS), ", "), F.lit(". May provide clues about host range or ecology."))),
        (category == "unknown", F.lit("Unknown function with structural evidence. Consider remote homology search with HHpred or DALI.")),
    ]
    return F.array_compact(F.array(*[F.when(test, text) for test, text in rules]))


def context(dark: DataFrame, matches: DataFrame) -> DataFrame:
    """query_id, family_hits, runs, best_identity, conserved, conservation of unexplained proteins (query_id, description).

    ``matches``: family, run, identity, as a provider of family searches gives them; of each family the ten best count (largest identity,
    then run), and of each protein the first three families that its description hints at.
    """
    asked = dark.select("query_id", F.posexplode(F.slice(families(F.col("description")), 1, FAMILIES)).alias("i", "family"))
    best = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("identity")).alias("d"), "run"))), 1, MATCHES)
    top = _top_matches(matches).groupBy("family").agg(best.alias("m"))
    found = asked.join(top, "family").groupBy("query_id").agg(F.array_sort(F.collect_list("family")).alias("family_hits"), F.sum(F.size("m")).alias("runs"), F.max(-F.col("m")[0]["d"]).alias("best_identity"))
    out = dark.select("query_id").join(found, "query_id", "left")
    out = out.withColumns({"runs": F.coalesce("runs", F.lit(0)), "best_identity": F.coalesce("best_identity", F.lit(0.0)), "family_hits": F.coalesce("family_hits", F.array().cast("array<string>"))})
    conserved = F.col("runs") >= CONSERVED
    return out.withColumns({"conserved": conserved, "conservation": F.when(conserved, F.least(F.lit(1.0), F.col("runs") / WIDESPREAD)).otherwise(0.0)})


def _top_matches(matches: DataFrame) -> DataFrame:
    """At most ten matches of each family before they are gathered; a family with millions of runs is cut in the window's own map side."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("identity"), "run"))
    return matches.where("family is not null and run is not null and identity is not null").distinct().withColumn("r__", place).where(F.col("r__") <= MATCHES).drop("r__")


def characterized(dark: DataFrame, matches: DataFrame) -> DataFrame:
    """Unexplained proteins (a consensus table with dark_category) with context, priority, reasons and recommendations."""
    whole = dark.join(context(dark, matches), "query_id")
    score, reasons = priority(F.col("dark_category"), F.col("conserved"), F.col("query_length"), F.col("confidence_level"))
    told = recommendations(F.col("conserved"), F.col("runs"), F.col("dark_category") != "no_hits", F.col("query_length"), F.array().cast("array<string>"), F.lit("unknown"))
    return whole.withColumns({"priority": score, "reasons": reasons, "recommendations": told})


def with_atlas(dark: DataFrame, predicted: DataFrame, rollup: DataFrame) -> DataFrame:
    """Unexplained proteins that have a predicted structure (predicted: id), with the atlas hits (rollup: query, hits, best_evalue, best_identity, novel, clusters) that they got; 0 hits where none."""
    searched = dark.join(predicted.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_semi")
    out = searched.join(rollup.withColumnRenamed("query", "query_id"), "query_id", "left")
    return out.withColumns({"hits": F.coalesce("hits", F.lit(0)), "novel": F.coalesce("novel", F.lit(False)), "clusters": F.coalesce("clusters", F.lit(0))})


def atlas_summary(searched: DataFrame) -> DataFrame:
    """One row: proteins searched, with hits, with a new fold, and their clusters."""
    return searched.agg(F.count("*").alias("searched"), F.count_if(F.col("hits") > 0).alias("with_hits"), F.count_if("novel").alias("novel_folds"), F.coalesce(F.sum("clusters"), F.lit(0)).alias("clusters"))
