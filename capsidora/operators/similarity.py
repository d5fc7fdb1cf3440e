"""Exact similarity search of query vectors in reference vectors, retrieval figures and triage.

Both sides are packed into blocks of bounded size, one row each; every block of queries meets every block of references in a task,
where they are multiplied as matrices, and only the best of each pair of blocks go on to the merge. Nothing goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block.
BLOCK = 4096


def _packed(df: DataFrame, blocks: int) -> DataFrame:
    """b, ids, m: the vectors of each block as unit vectors in double, in the order of their ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        for block in sorted(set(t["b"].to_pylist())):
            own = t.filter(pa.compute.equal(t["b"], block)).sort_by("id")
            x = own["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([own["id"].to_pylist()], pa.list_(pa.string())), pa.array([x.tobytes()])], names=["b", "ids", "m"])

    rows = df.select("id", F.col("embedding").cast("array<double>").alias("embedding"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
    return rows.repartition(blocks, "b").mapInArrow(pack, "b int, ids array<string>, m binary")


def top_similar(queries: DataFrame, references: DataFrame, k: int = 1, threshold: float = -1.0, same: bool = False) -> DataFrame:
    """query, target, similarity, place (from 1): the ``k`` references with the largest cosine at or above ``threshold``.

    Both tables have id (string, unique) and embedding (non-zero, of one length). Cosines are rounded to 9 decimals, ties go to the
    smaller target. With ``same`` a vector isn't compared with its own id. An empty side gives no rows.
    """
    spark = queries.sparkSession
    nq, nr = (max(1, ceil(df.count() / BLOCK)) for df in (queries, references))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = min(nr, max(1, ceil(parts / nq)))
    left = _packed(queries, nq).withColumnRenamed("b", "qb").select("qb", F.col("ids").alias("qi"), F.col("m").alias("qm"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"))
    right = _packed(references, nr).select((F.col("b") % spread).alias("part"), F.col("ids").alias("ri"), F.col("m").alias("rm"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, ids = row["qi"], row["ri"]
                a, b = (np.frombuffer(m, np.float64).reshape(len(n), -1) for m, n in ((row["qm"], names), (row["rm"], ids)))
                own = {t: j for j, t in enumerate(ids)} if same else {}
                for s in range(0, len(names), 1024):
                    sims = np.round(a[s : s + 1024] @ b.T, 9) + 0.0
                    for i, n in enumerate(names[s : s + 1024]):
                        if n in own:
                            sims[i, own[n]] = -2.0
                    at = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                    value = np.take_along_axis(sims, at, 1)
                    q, c = np.nonzero(value >= max(threshold, -1.5))
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array([names[s + i] for i in q]), pa.array([ids[j] for j in at[q, c]]), pa.array(value[q, c])], names=["query", "target", "similarity"])

    met = left.join(right, ["qb", "part"]).select("qi", "qm", "ri", "rm").mapInArrow(best, "query string, target string, similarity double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "target"))
    return met.withColumn("place", place).where(F.col("place") <= k)


def triage(queries: DataFrame, best: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Queries with their best match (place 1) and whether it reaches the threshold."""
    top = best.where("place = 1").select(F.col("query").alias("id"), "target", "similarity")
    return queries.select("id").join(top, "id", "left").withColumn("matched", F.coalesce(F.col("similarity") >= threshold, F.lit(False)))


def retrieval_figures(ranked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Mean average precision and NDCG at ``k`` over queries; ranked: query, target, place; labels: id, label."""
    hit = ranked.join(labels.toDF("query", "ql"), "query").join(labels.toDF("target", "tl"), "target").withColumn("rel", (F.col("ql") == F.col("tl")).cast("int"))
    upto = Window.partitionBy("query").orderBy("place")
    scored = hit.withColumn("p", F.sum("rel").over(upto) / F.col("place")).groupBy("query").agg(
        F.sum(F.col("rel") * F.col("p")).alias("ap"), F.sum("rel").alias("n"), F.sum(F.col("rel") / F.log2(F.col("place") + 1)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    each = scored.select(F.when(F.col("n") > 0, F.col("ap") / F.col("n")).otherwise(0.0).alias("ap"), F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))
    return each.agg(F.count("*").alias("queries"), F.round(F.avg("ap"), 8).alias(f"map_at_{k}"), F.round(F.avg("ndcg"), 8).alias(f"ndcg_at_{k}"))


def threshold_sweep(top: DataFrame, labels: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 of taking over the best match's label at each threshold."""
    own = top.where("place = 1").join(labels.toDF("query", "ql"), "query").join(labels.toDF("target", "tl"), "target")
    each = own.select("similarity", (F.col("ql") == F.col("tl")).alias("right"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    over = F.col("similarity") >= F.col("threshold")
    m = each.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(over).alias("matched"), F.count_if(over & F.col("right")).alias("correct"))
    p, r = F.when(F.col("matched") > 0, F.col("correct") / F.col("matched")).otherwise(0.0), F.col("correct") / F.col("n")
    return m.select("threshold", "n", "matched", "correct", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 9).alias("f1"))


def histogram(values: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts of values by the greatest edge at or below them; values below the first edge don't count."""
    bin_ = None
    for e in sorted(edges, reverse=True):
        bin_ = F.when(F.col(value) >= e, F.lit(e)) if bin_ is None else bin_.when(F.col(value) >= e, F.lit(e))
    return values.select(bin_.alias("edge")).where("edge is not null").groupBy("edge").agg(F.count("*").alias("n"))
