"""Agreement of the annotations that several databases give the same query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsidora.functions.text import COMMON_MORE, conflict_severity, jaccard, severity_rank, terms


def database_pairs(annotations: DataFrame) -> DataFrame:
    """Pairs of databases of each query: query, db1 < db2, similarity, categories, e-values, severity, conflict, resolution.

    ``annotations``: query, source_db, description, category, evalue; at most one row per query and database, which is gathered
    per query (a handful of databases) so that one exchange serves all pairs.
    """
    told = annotations.where("coalesce(description, '') <> ''").withColumn("terms", terms(F.col("description"), COMMON_MORE))
    held = told.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("source_db", "terms", "category", "evalue"))).alias("d"))
    pairs = held.select("query", F.posexplode("d").alias("i", "a"), "d").select("query", "a", F.explode(F.slice("d", F.col("i") + 2, F.greatest(F.size("d") - F.col("i") - 1, F.lit(0)))).alias("b"))
    sim = F.round(jaccard(F.col("a.terms"), F.col("b.terms")), 9)
    out = pairs.select("query", F.col("a.source_db").alias("db1"), F.col("b.source_db").alias("db2"), sim.alias("similarity"), F.col("a.category").alias("category1"), F.col("b.category").alias("category2"), F.col("a.evalue").alias("evalue1"), F.col("b.evalue").alias("evalue2"))
    conflict = (F.col("similarity") < 0.2) | (F.col("category1") != F.col("category2"))
    better = F.when(F.col("evalue1") < F.col("evalue2") / 10, F.concat(F.lit("Prefer "), "db1", F.lit(" (better e-value)"))).when(F.col("evalue2") < F.col("evalue1") / 10, F.concat(F.lit("Prefer "), "db2", F.lit(" (better e-value)"))).otherwise("Manual review recommended")
    return out.withColumns({"conflict": conflict, "severity": F.when(conflict, conflict_severity(F.col("category1"), F.col("category2"), F.col("similarity"))), "resolution": F.when(conflict, better)})


def validated(annotations: DataFrame) -> DataFrame:
    """Status of each query: validated, partial, conflicting, single_source; mean similarity, reliability, conflicts."""
    one = annotations.where("coalesce(description, '') <> ''").groupBy("query").agg(F.count("*").alias("databases"), F.countDistinct("category").alias("kinds"))
    pairs = database_pairs(annotations).groupBy("query").agg(F.round(F.avg("similarity"), 9).alias("similarity"), F.count_if("conflict").alias("conflicts"))
    both = one.join(pairs, "query", "left")
    s = F.col("similarity")
    status = F.when(s.isNull(), "single_source").when(s >= 0.5, "validated").when(s >= 0.2, "partial").otherwise("conflicting")
    reliability = F.when(s.isNull(), 0.5).otherwise(0.3 * F.least(F.lit(1.0), F.col("databases") / 3) + 0.5 * s + 0.2 * F.when(F.col("kinds") == 1, 1.0).otherwise(0.5))
    return both.select("query", "databases", status.alias("status"), F.coalesce(s, F.lit(0.0)).alias("similarity"), F.round(reliability, 6).alias("reliability"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


def conflicts_from(pairs: DataFrame, least: str = "minor") -> DataFrame:
    """Conflicts of at least a severity."""
    return pairs.where("conflict").where(severity_rank(F.col("severity")) >= severity_rank(F.lit(least)))


def worst_conflicts(pairs: DataFrame, most: int = 10) -> DataFrame:
    """The ``most`` worst conflicts of a report: by severity, then smaller similarity, then query and databases."""
    return conflicts_from(pairs).orderBy(severity_rank(F.col("severity")).desc(), "similarity", "query", "db1", "db2").limit(most)


def consistency(annotations: DataFrame) -> DataFrame:
    """For each pair of databases: queries in both, in one only, agreeing, partly, not; equal categories; score."""
    total = annotations.agg(F.countDistinct("query").alias("total"))
    held = annotations.where("coalesce(description, '') <> ''").groupBy("source_db").agg(F.count("*").alias("n"))
    pairs = database_pairs(annotations).groupBy("db1", "db2").agg(
        F.count("*").alias("both"),
        F.count_if(F.col("similarity") >= 0.5).alias("agree"),
        F.count_if((F.col("similarity") >= 0.2) & (F.col("similarity") < 0.5)).alias("partial"),
        F.count_if(F.col("similarity") < 0.2).alias("disagree"),
        F.count_if(F.col("category1") == F.col("category2")).alias("same_category"),
    )
    out = pairs.join(held.toDF("db1", "n1"), "db1").join(held.toDF("db2", "n2"), "db2").crossJoin(F.broadcast(total))
    share = lambda a: F.when(F.col("both") > 0, a / F.col("both")).otherwise(0.0)
    score = 0.6 * share(F.col("agree")) + 0.3 * share(F.col("same_category")) + 0.1 * F.least(F.lit(1.0), F.col("both") * 2 / F.greatest(F.lit(1), F.col("total")))
    return out.select("db1", "db2", "both", (F.col("n1") - F.col("both")).alias("only1"), (F.col("n2") - F.col("both")).alias("only2"), "agree", "partial", "disagree", "same_category", F.round(score, 9).alias("score"))


def status_report(results: DataFrame) -> DataFrame:
    """Queries, mean and true median of reliability by status."""
    return results.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("reliability"), 5).alias("mean_reliability"), F.round(F.median("reliability"), 5).alias("median_reliability"), F.sum("conflicts").alias("conflicts"))


def reliability_bins(results: DataFrame) -> DataFrame:
    """bin, n: validated queries by reliability; empty bins have no row."""
    r = F.col("reliability")
    name = F.when(r >= 0.8, "high (>=0.8)").when(r >= 0.5, "medium (0.5-0.8)").when(r >= 0.3, "low (0.3-0.5)").otherwise("very_low (<0.3)")
    return results.where(r.isNotNull()).groupBy(name.alias("bin")).agg(F.count("*").alias("n"))
