"""Consensus annotation of queries from the hits of several databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsidora.functions import scoring
from capsidora.functions.rules import by_evidence
from capsidora.functions.text import agreement
from capsidora.session import small_side

#: Order of databases with equal scores.
DB_ORDER = ["bfvd", "viro3d"]
#: What an annotation tells beside its description.
EVIDENCE = ["gene", "organism", "uniprot_id", "pfam", "go_bp", "go_mf", "go_cc", "superfamily"]


def db_rank(db: Column) -> Column:
    out = F.when(db == DB_ORDER[0], 0)
    for i, name in enumerate(DB_ORDER[1:], 1):
        out = out.when(db == name, i)
    return out.otherwise(len(DB_ORDER))


def scored_hits(hits: DataFrame, annotations: DataFrame) -> DataFrame:
    """Hits (query, target, source_db, fident, evalue, qcov) with their weighted score.

    Of the annotations (target, source_db, description, perhaps structure_quality) only two small values go to the hits, and by a broadcast
    where the table is small enough; texts are fetched by :func:`described` for the hits that are left.
    """
    structure = F.coalesce(F.col("structure_quality"), F.lit(1.0)) if "structure_quality" in annotations.columns else F.lit(1.0)
    factors = small_side(annotations.select("target", "source_db", structure.alias("q__"), scoring.tells(F.col("description")).alias("t__")))
    quality = scoring.hit_quality(F.col("evalue"), F.col("fident"), F.col("qcov"))
    score = scoring.hit_score(quality, F.coalesce("q__", F.lit(1.0)), F.col("source_db"), F.coalesce("t__", F.lit(False)))
    return hits.join(factors, ["target", "source_db"], "left").withColumn("score", F.round(score, 9)).drop("q__", "t__")


def best_per_database(scored: DataFrame) -> DataFrame:
    """The best hit of each query and database: largest score, then smaller e-value, then smaller target; with the number of hits.

    An aggregate, so each task keeps one row a group before the exchange, however many hits a query has.
    """
    rest = [c for c in ("fident", "qcov") if c in scored.columns]
    best = scored.groupBy("query", "source_db").agg(F.min(F.struct((-F.col("score")).alias("s"), "evalue", "target", *rest)).alias("b"), F.count("*").alias("hits"))
    return best.select("query", "source_db", (-F.col("b.s")).alias("score"), "b.evalue", "b.target", *[f"b.{c}" for c in rest], "hits")


def described(best: DataFrame, annotations: DataFrame) -> DataFrame:
    """Best hits with all that the annotations tell of their targets; texts that are missing are null."""
    out = best.join(annotations, ["target", "source_db"], "left")
    return out.withColumns({c: F.lit(None).cast("string") for c in EVIDENCE if c not in annotations.columns} | {c: F.lit(None).cast(k) for c, k in (("structure_quality", "double"), ("structure_source", "string")) if c not in annotations.columns})


def consensus(hits: DataFrame, annotations: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query (query, query_length), with or without hits; columns as in the result table.

    The category comes from the strongest evidence that the best hit's annotation has: Pfam, SUPERFAMILY, GO process, GO function, else keywords of description and gene.
    """
    best = described(best_per_database(scored_hits(hits, annotations)), annotations)
    place = F.struct((-F.col("score")).alias("s"), db_rank(F.col("source_db")).alias("r"), F.col("source_db").alias("db"), "target", "evalue", "fident", "qcov", "description", *EVIDENCE, "structure_quality", "structure_source", "hits")
    # at most one entry per database
    ranked = best.groupBy("query").agg(F.sort_array(F.collect_list(place)).alias("p"))
    first, second = F.get("p", 0), F.get("p", 1)
    agree = F.when(F.size("p") > 1, agreement(first["description"], second["description"])).otherwise("single")
    of = lambda db: F.coalesce(F.get(F.filter("p", lambda x: x["db"] == db), 0)["hits"], F.lit(0)).alias(f"{db}_hits")
    out = ranked.select("query", first.alias("a"), second.alias("b"), agree.alias("agreement"), F.array_sort(F.transform("p", lambda x: x["db"])).alias("databases"), of("bfvd"), of("viro3d"))
    description = F.coalesce(F.nullif(F.col("a.description"), F.lit("")), F.lit("hypothetical protein"))
    category, source = by_evidence(description, F.col("a.gene"), F.col("a.pfam"), F.col("a.superfamily"), F.col("a.go_bp"), F.col("a.go_mf"))
    score = scoring.consensus_score(-F.col("a.s"), F.col("agreement"))
    out = out.select(
        "query", F.col("a.db").alias("primary_source"), F.col("a.target").alias("primary_target"), F.col("a.evalue").alias("primary_evalue"), F.col("a.fident").alias("primary_identity"), F.col("a.qcov").alias("primary_coverage"),
        description.alias("description"), category.alias("functional_category"), source.alias("classification_source"), scoring.novelty(F.col("a.fident")).alias("novelty"),
        F.round(F.coalesce("a.structure_quality", F.lit(1.0)), 3).alias("structure_quality_score"), F.coalesce("a.structure_source", F.lit("none")).alias("structure_quality_source"), *[F.col(f"a.{c}").alias(c) for c in EVIDENCE],
        F.col("b.db").alias("secondary_source"), F.col("b.target").alias("secondary_target"), F.col("b.evalue").alias("secondary_evalue"), F.col("b.fident").alias("secondary_identity"), "agreement", F.round(score, 6).alias("consensus_score"),
        scoring.consensus_level(F.round(score, 9), F.col("agreement")).alias("confidence_level"), "databases", "bfvd_hits", "viro3d_hits",
    )
    empty = {"description": "hypothetical protein", "functional_category": "unknown", "agreement": "none", "confidence_level": "none", "consensus_score": 0.0, "bfvd_hits": 0, "viro3d_hits": 0}
    return queries.join(out, "query", "left").fillna(empty)


def merged_hits(parts: dict[str, DataFrame], keep_best: bool = True) -> DataFrame:
    """Hits of several databases as one table with their source_db; with ``keep_best`` the smallest e-value of each query."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("source_db", F.lit(name))
        out = df if out is None else out.unionByName(df)
    if keep_best:
        rest = [c for c in out.columns if c not in ("query", "evalue", "target")]
        best = out.groupBy("query").agg(F.min(F.struct("evalue", "target", *rest)).alias("b"))
        out = best.select("query", "b.*")
    return out


def best_hits(hits: DataFrame, by: str = "evalue") -> DataFrame:
    """The best hit of each query by a column: the smallest e-value, else the largest value; ties by target."""
    key = F.col(by) if by == "evalue" else -F.col(by)
    return hits.groupBy("query").agg(F.min(F.struct(key.alias("k"), "target", "source_db")).alias("b")).select("query", "b.target", "b.source_db")
