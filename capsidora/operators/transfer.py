"""Annotation taken over from single hits, from similar embeddings and from other steps, by precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsidora.functions import scoring
from capsidora.functions.rules import by_evidence
from capsidora.operators import evidence, similarity

#: Steps that may fill in a category, in order; each changes only what is still unknown.
STEPS = ["triage", "classifier", "disorder_search", "disorder_classifier", "language_model", "neighbourhood"]


def single_hit(hits: DataFrame, annotations: DataFrame, queries: DataFrame) -> DataFrame:
    """Annotation by the hit of smallest e-value alone, for all queries (query, query_length): the leading columns of the single-hit table.

    Ties in e-value go to the smaller target, then the smaller database. Without a hit the description is hypothetical protein and the level none.
    """
    best = hits.groupBy("query").agg(F.min(F.struct("evalue", "target", "source_db", "fident", "qcov", "bits")).alias("b"), F.count("*").alias("num_hits")).select("query", "num_hits", "b.*")
    known = annotations.select("target", "source_db", *[F.col(c) if c in annotations.columns else F.lit(None).cast("string").alias(c) for c in ("description", "organism", "gene", "uniprot_id")])
    told = best.join(known, ["target", "source_db"], "left")
    out = told.select("query", F.coalesce(F.nullif("description", F.lit("")), F.lit("hypothetical protein")).alias("description"), scoring.hit_level(F.col("evalue"), F.col("fident"), F.col("qcov")).alias("confidence_level"), "source_db", F.col("target").alias("target_id"), "evalue", F.col("fident").alias("identity"), F.col("qcov").alias("coverage"), "bits", "organism", "gene", "uniprot_id", "num_hits")
    return queries.join(out, "query", "left").fillna({"description": "hypothetical protein", "confidence_level": "none", "num_hits": 0}).withColumnRenamed("query", "query_id")


def triaged(matches: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotation taken over from the best similar embedding: matches (id, target, source_db, similarity, matched).

    Only matched queries have rows; a target that no annotation knows gives hypothetical protein.
    """
    score, level = scoring.triage_score(F.col("similarity"))
    texts = ["description", "gene", "pfam", "superfamily", "go_bp", "go_mf"]
    known = annotations.select("target", "source_db", *[F.col(c) if c in annotations.columns else F.lit(None).cast("string").alias(c) for c in texts])
    told = matches.where("matched").join(known, ["target", "source_db"], "left").withColumn("description", F.coalesce(F.nullif("description", F.lit("")), F.lit("hypothetical protein")))
    category, source = by_evidence(*[F.col(c) for c in texts])
    return told.select("id", "target", "source_db", "similarity", "description", category.alias("functional_category"), F.concat(F.lit("embedding:"), source).alias("classification_source"), F.round(score, 6).alias("consensus_score"), level.alias("confidence_level"))


def overlaid(results: DataFrame, triage: DataFrame | None = None, later: dict[str, DataFrame] | None = None) -> DataFrame:
    """Results (query_id, functional_category, classification_source, ...) with what other steps found.

    ``triage`` (id and result columns) takes precedence over hits. ``later``: step to (query_id, category), taken in the order of ``STEPS``, each
    filling in only what is still unknown and naming itself as source; an unknown step is an error.
    """
    out = results
    if triage is not None:
        cols = [c for c in triage.columns if c != "id" and c in out.columns]
        t = triage.select(F.col("id").alias("query_id"), F.lit(True).alias("t__"), *[F.col(c).alias(f"t_{c}") for c in cols])
        out = out.join(t, "query_id", "left").withColumns({c: F.when(F.col("t__"), F.col(f"t_{c}")).otherwise(F.col(c)) for c in cols}).drop("t__", *[f"t_{c}" for c in cols])
    later = later or {}
    if unknown := set(later) - set(STEPS):
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    for step in STEPS:
        if step in later:
            new = later[step].where("category is not null and category <> 'unknown'").groupBy("query_id").agg(F.min("category").alias("n__"))
            out = out.join(new, "query_id", "left")
            fills = (F.col("functional_category") == "unknown") & F.col("n__").isNotNull()
            out = out.withColumns({"classification_source": F.when(fills, step).otherwise(F.col("classification_source")), "functional_category": F.when(fills, F.col("n__")).otherwise(F.col("functional_category"))}).drop("n__")
    return out


def to_reclassify(results: DataFrame) -> DataFrame:
    """Annotated proteins whose category is unknown and came from keywords or an embedding."""
    return results.where("primary_target is not null and functional_category = 'unknown' and (classification_source = 'keywords' or classification_source like 'embedding%')")


def go_terms_of(queries: DataFrame, references: DataFrame, donors: DataFrame, viral_ids: DataFrame | None = None, k: int = 10) -> DataFrame:
    """GO terms of queries (id, embedding) from the ``k`` most similar references (id is the accession, embedding): similar vectors, their terms, reliability, and the plausible ones only."""
    near = similarity.top_similar(queries, references, k, evidence.SIMILAR)
    terms = evidence.transferred_terms(near.select("query", F.col("target").alias("accession"), "similarity"), donors)
    return evidence.plausible_terms(terms, viral_ids) if viral_ids is not None else terms


def go_summary(terms: DataFrame) -> DataFrame:
    """query, go_transfer_ri, go_transfer_best_match, go_transfer_similarity, go_evidence_codes, is_cross_domain of transferred terms: those of the most reliable term, ties by GO id."""
    best = F.min(F.struct((-F.col("reliability")).alias("r"), "go_id", "donor", "donor_similarity", "cross_domain"))
    codes = F.array_join(F.sort_array(F.collect_set("evidence_code")), "|")
    out = terms.groupBy("query").agg(best.alias("b"), codes.alias("go_evidence_codes"))
    return out.select("query", (-F.col("b.r")).alias("go_transfer_ri"), F.col("b.donor").alias("go_transfer_best_match"), F.col("b.donor_similarity").alias("go_transfer_similarity"), "go_evidence_codes", F.col("b.cross_domain").alias("is_cross_domain"))


def labels_of(ids: DataFrame, annotations: DataFrame) -> DataFrame:
    """protein_id, source_db, category of reference ids (protein_id, source_db) that their annotation classifies; unknown ones are left out."""
    texts = ["description", "gene", "pfam", "superfamily", "go_bp", "go_mf"]
    known = annotations.select(F.col("target").alias("protein_id"), "source_db", *[F.col(c) if c in annotations.columns else F.lit(None).cast("string").alias(c) for c in texts])
    category, _ = by_evidence(*[F.col(c) for c in texts])
    return ids.select("protein_id", "source_db").distinct().join(known, ["protein_id", "source_db"]).select("protein_id", "source_db", category.alias("category")).where("category <> 'unknown'")


def merged_labels(*tables: DataFrame) -> DataFrame:
    """protein_id, category of several tables; a later table's label holds."""
    out = None
    for i, t in enumerate(tables):
        t = t.select("protein_id", "category", F.lit(i).alias("o"))
        out = t if out is None else out.unionByName(t)
    return out.groupBy("protein_id").agg(F.max(F.struct("o", "category")).alias("m")).select("protein_id", "m.category")


def dataset(rows: DataFrame, excluded: DataFrame, labels: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Rows (protein_id, ...) without excluded ids, with their label; an extra label stands in where there is none or unknown."""
    out = rows.join(excluded.select("protein_id").distinct(), "protein_id", "left_anti").join(labels.select("protein_id", "category"), "protein_id", "left")
    if extra is not None:
        out = out.join(extra.select("protein_id", F.col("category").alias("x__")), "protein_id", "left")
        out = out.withColumn("category", F.when(F.coalesce("category", F.lit("unknown")) == "unknown", F.coalesce("x__", "category")).otherwise(F.col("category"))).drop("x__")
    return out.withColumn("category", F.coalesce("category", F.lit("unknown")))


def informative_unknowns(rows: DataFrame, least: int = 2) -> DataFrame:
    """description, n: what unclassified rows (description, category) that say something call themselves, by at least ``least`` rows."""
    told = rows.where((F.col("category") == "unknown") & scoring.tells(F.col("description")) & ~F.lower("description").rlike("uncharacteri[sz]ed|unknown"))
    return told.groupBy(F.lower(F.trim("description")).alias("description")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
