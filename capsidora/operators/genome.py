"""Genes on contigs: neighbourhood votes, overlapping calls, containment, features of several parts, repeated names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weight of a neighbour's vote by its confidence.
VOTE = {"high": 1.0, "medium": 0.7, "low": 0.4, "very_low": 0.2}
OTHER_VOTE = 0.1


def vote_weight(level: Column) -> Column:
    out = None
    for name, w in VOTE.items():
        out = F.when(level == name, w) if out is None else out.when(level == name, w)
    return out.otherwise(OTHER_VOTE)


def neighbourhood_votes(genes: DataFrame, window: int = 5, least: int = 2, share: float = 0.5) -> DataFrame:
    """query, category, share: for genes of unknown category, the one that their neighbours vote for.

    ``genes``: query, contig, start, functional_category, confidence_level. The ``window`` genes on either side vote with the weight
    of their confidence over one plus their distance; at least ``least`` must vote and the winner needs ``share`` of the weight.
    Genes of a contig are ordered by start, then query; ties between categories go to the smaller name.
    """
    along = Window.partitionBy("contig").orderBy("start", "query")
    near = F.collect_list(F.struct("i", "functional_category", "confidence_level")).over(along.rowsBetween(-window, window))
    placed = genes.where("contig is not null").withColumn("i", F.row_number().over(along)).withColumn("near", near)
    votes = placed.where("functional_category = 'unknown'").select("query", "i", F.explode("near").alias("n")).where("n.i <> i and n.functional_category <> 'unknown'")
    weight = vote_weight(F.col("n.confidence_level")) / (1 + F.abs(F.col("n.i") - F.col("i")))
    sums = votes.groupBy("query", F.col("n.functional_category").alias("category")).agg(F.round(F.sum(weight), 9).alias("w"), F.count("*").alias("n"))
    best = sums.groupBy("query").agg(F.min(F.struct((-F.col("w")).alias("w"), "category")).alias("b"), F.sum("w").alias("total"), F.sum("n").alias("n"))
    part = F.round(-F.col("b.w") / F.col("total"), 9)
    return best.where((F.col("n") >= least) & (part >= share)).select("query", F.col("b.category").alias("category"), F.round(part, 3).alias("vote_share"))


def uncovered(second: DataFrame, first: DataFrame, keys: list[str], share: float = 0.5, width: int = 512) -> DataFrame:
    """Intervals (keys, start, end) of ``second`` that no interval of ``first`` with equal keys overlaps by ``share`` of either.

    Intervals meet in bins of ``width`` places, each pair in the first bin that both reach, so a contig is never compared whole.
    """
    def binned(df: DataFrame, tag: str) -> DataFrame:
        cols = [*keys, F.col("start").alias(f"s{tag}"), F.col("end").alias(f"e{tag}")]
        return df.select(*cols).distinct().withColumn("bin", F.explode(F.sequence(F.floor(F.col(f"s{tag}") / width), F.floor(F.col(f"e{tag}") / width))))

    pairs = binned(second, "2").join(binned(first, "1"), [*keys, "bin"]).where(F.col("bin") == F.floor(F.greatest("s1", "s2") / width))
    common = F.least("e1", "e2") - F.greatest("s1", "s2") + 1
    shorter = F.least(F.col("e1") - F.col("s1"), F.col("e2") - F.col("s2")) + 1
    covered = pairs.where((common > 0) & (common / shorter >= share)).select(*keys, F.col("s2").alias("start"), F.col("e2").alias("end")).distinct()
    return second.join(covered, [*keys, "start", "end"], "left_anti")


def merged_calls(first: DataFrame, second: DataFrame, share: float = 0.5) -> DataFrame:
    """All calls of the first caller and those of the second that don't overlap them (contig, strand, start, end, ...)."""
    return first.unionByName(uncovered(second, first, ["contig", "strand"], share))


def containing(parts: DataFrame, wholes: DataFrame, width: int = 512) -> DataFrame:
    """part_id, whole_id: the first whole (smallest ord) on the contig that contains each part (contig, start, end).

    Wholes are laid into bins of ``width`` places, and a part meets those in the bin of its start, so a contig is never compared whole.
    """
    p = parts.select("contig", "part_id", F.col("start").alias("ps"), F.col("end").alias("pe"), F.floor(F.col("start") / width).alias("bin"))
    w = wholes.select("contig", "ord", "whole_id", F.col("start").alias("ws"), F.col("end").alias("we"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("bin"))
    inside = p.join(w, ["contig", "bin"]).where("ws <= ps and we >= pe")
    return inside.groupBy("part_id").agg(F.min(F.struct("ord", "whole_id")).alias("b")).select("part_id", F.col("b.whole_id").alias("whole_id"))


def without_polyproteins(wholes: DataFrame, contained: DataFrame, least: int = 2) -> DataFrame:
    """Wholes that have fewer than ``least`` parts."""
    split = contained.groupBy("whole_id").count().where(F.col("count") >= least)
    return wholes.join(split, "whole_id", "left_anti")


def merged_parts(features: DataFrame, keys: list[str]) -> DataFrame:
    """Features of several rows as one: smallest start, largest end, and the intervals in order."""
    return features.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_set(F.struct("start", "end"))).alias("intervals"))


def distinct_names(rows: DataFrame, name: str, order: list[str], out: str = "name") -> DataFrame:
    """Rows with a name of their own: the second of a name gets ``_dup1`` and so on, skipping names that exist already."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    taken = rows.select(F.regexp_extract(F.col(name), r"^(.*)_dup(\d+)$", 1).alias("base"), F.regexp_extract(F.col(name), r"^(.*)_dup(\d+)$", 2).alias("k")).where("k <> ''")
    taken = taken.groupBy("base").agg(F.array_sort(F.collect_set(F.expr("try_cast(k as int)"))).alias("used")).withColumnRenamed("base", "b__")
    placed = rows.withColumn("n__", n).join(taken, F.col(name) == F.col("b__"), "left")
    # the n-th free number: count up past the numbers in use
    free = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), F.col("n__"), lambda k, u: F.when(u <= k, k + 1).otherwise(k))
    return placed.withColumn(out, F.when(F.col("n__") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_dup"), free.cast("string")))).drop("n__", "b__", "used")
