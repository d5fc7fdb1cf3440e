"""Unexplained proteins, run summaries, priorities of follow-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsidora.session import small_side

# When a hit is weak.
WEAK_EVALUE, WEAK_IDENTITY, WEAK_SCORE = 1e-5, 0.3, 0.3


def dark_category(has_hit: Column, category: Column, evalue: Column, identity: Column, score: Column) -> Column:
    """``no_hits``, ``weak_hits``, ``unknown_function``, or null for an explained protein."""
    weak = (evalue > WEAK_EVALUE) | (identity < WEAK_IDENTITY)
    return F.when(~has_hit, "no_hits").when((category == "unknown") & F.coalesce(weak, F.lit(False)), "weak_hits").when(category == "unknown", "unknown_function").when(score < WEAK_SCORE, "weak_hits")


def upper_median(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The value at place n // 2 (from 0) of each group, exactly.

    Quantiles close around the middle, whose rank error is bounded, give a narrow range; rows below it are counted, and only the distinct values within it are ordered.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v__"))
    near = rows.groupBy(*keys).agg(F.count("*").alias("n__"), F.percentile_approx("v__", [0.499, 0.501], 100_000).alias("q__"))
    placed = rows.join(small_side(near), keys) if keys else rows.crossJoin(F.broadcast(near))
    below = F.col("v__") < F.col("q__")[0]
    kept = placed.where(F.col("v__") <= F.col("q__")[1]).groupBy(*keys, F.when(~below, F.col("v__")).alias("v__")).agg(F.count("*").alias("c__"), F.first("n__").alias("n__"))
    upto = F.sum("c__").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("v__").asc_nulls_first()))
    return kept.withColumn("u__", upto).where("v__ is not null and u__ > floor(n__ / 2)").groupBy(*keys).agg(F.min("v__").alias("median"))


def dark_matter(consensus: DataFrame) -> DataFrame:
    """Unexplained proteins of a consensus table with their category."""
    has_hit = F.col("primary_target").isNotNull()
    return consensus.withColumn("dark_category", dark_category(has_hit, F.col("functional_category"), F.col("primary_evalue"), F.col("primary_identity"), F.col("consensus_score"))).where("dark_category is not null")


def dark_matter_summary(consensus: DataFrame) -> DataFrame:
    """One row: numbers by category, rate, and the lengths' least, greatest, mean and upper median."""
    dark = dark_matter(consensus)
    kinds = [F.count_if(F.col("dark_category") == k).alias(k) for k in ("no_hits", "weak_hits", "unknown_function")]
    head = dark.agg(F.count("*").alias("dark"), *kinds, F.min("query_length").alias("least"), F.max("query_length").alias("greatest"), F.round(F.avg("query_length"), 6).alias("mean"))
    total = consensus.agg(F.count("*").alias("total"))
    return total.crossJoin(head).crossJoin(upper_median(dark, "query_length", [])).withColumn("rate", F.round(F.when(F.col("total") > 0, F.col("dark") / F.col("total")).otherwise(0.0), 9))


def dark_matter_breakdown(dark: DataFrame) -> DataFrame:
    """kind, value, n: unexplained proteins by category, by confidence and, where it was predicted, by class of disorder."""
    held = dark if "disorder_class" in dark.columns else dark.withColumn("disorder_class", F.lit(None).cast("string"))
    out = distributions(held, ["dark_category", "confidence_level", "disorder_class"])
    return out.where("field <> 'disorder_class' or value is not null").withColumnRenamed("field", "kind")


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, value, n: the counts of each column's values, all from one pass (grouping sets)."""
    sets = [[c] for c in columns]
    grouped = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).groupingSets([[F.col(x) for x in s] for s in sets], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    which = None
    k = len(columns)
    for i, c in enumerate(columns):
        bit = (1 << k) - 1 - (1 << (k - 1 - i))
        which = F.when(F.col("g") == bit, F.struct(F.lit(c).alias("f"), F.col(c).alias("v"))) if which is None else which.when(F.col("g") == bit, F.struct(F.lit(c).alias("f"), F.col(c).alias("v")))
    return grouped.select(which.alias("x"), "n").select(F.col("x.f").alias("field"), F.col("x.v").alias("value"), "n")


def priority(dark: Column, conserved: Column, length: Column, level: Column) -> tuple[Column, Column]:
    """Score of follow-up, at most 1, and the reasons."""
    rules = [
        (dark == "no_hits", 0.4, "No structural homologs detected"),
        (conserved, 0.3, "Conserved across metagenomes"),
        (length.between(100, 500), 0.1, "Optimal length for single-domain protein"),
        ((dark == "unknown_function") & level.isin("high", "medium"), 0.2, "Strong structural match but unknown function"),
    ]
    score = None
    for test, points, _ in rules:
        one = F.when(test, points).otherwise(0.0)
        score = one if score is None else score + one
    return F.least(F.lit(1.0), F.round(score, 9)), F.array_compact(F.array(*[F.when(test, text) for test, _, text in rules]))


def metagenome_rollup(hits: DataFrame, identity: float = 0.3, coverage: float = 0.5) -> DataFrame:
    """Per query: hits at or above the bounds, best e-value and identity, whether a fold is new, and distinct clusters (target up to its first underscore)."""
    good = hits.where((F.col("fident") >= identity) & (F.col("qcov") >= coverage))
    new = F.col("target").contains("ESM") | F.col("target").contains("MGY")
    cluster = F.when(F.col("target").contains("_"), F.substring_index("target", "_", 1))
    return good.groupBy("query").agg(F.count("*").alias("hits"), F.min("evalue").alias("best_evalue"), F.max("fident").alias("best_identity"), F.bool_or(new).alias("novel"), F.countDistinct(cluster).alias("clusters"))


def hit_coverage(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: queries (query), those with a hit, hits, distinct targets, and mean hits of a query that has any."""
    asked = queries.select("query").distinct().agg(F.count("*").alias("queries"))
    some = hits.agg(F.countDistinct("query").alias("with_hits"), F.count("*").alias("hits"), F.countDistinct("target").alias("targets"))
    return asked.crossJoin(F.broadcast(some)).withColumn("mean_hits", F.round(F.when(F.col("with_hits") > 0, F.col("hits") / F.col("with_hits")).otherwise(0.0), 9))
