"""The core's queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsidora import oracle
from capsidora.functions import rules, scoring, sequences, text
from capsidora.operators import benchmark, consensus, evidence, export, genome, report, similarity, validation
from capsidora.operators.packed import split_packed
from capsidora.session import settle, small_side, table

Query = Callable[[SparkSession, str], DataFrame]
BLANKS = r"^\s+|\s+$"
#: Edges of the similarity histogram and thresholds of the sweep (fixed values).
EDGES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
SWEEP = [0.3, 0.5, 0.7, 0.8, 0.9, 0.95]


def _label(c: Column) -> Column:
    key = F.regexp_replace(F.lower(F.regexp_replace(c, BLANKS, "")), r"[ _-]+", "_")
    return F.when(F.coalesce(key, F.lit("")) == "", "unknown").otherwise(key)


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits with query, target, database and e-value; databases written in one way."""
    h = table(spark, d, "foldseek_hits").select("query", "target", F.lower(F.regexp_replace("source_db", BLANKS, "")).alias("source_db"), "fident", "evalue", "bits", "qstart", "qend", "qlen", "qcov", "tcov")
    return h.where("query is not null and target is not null and source_db is not null and evalue is not null")


def results(spark: SparkSession, d: str) -> DataFrame:
    """The latest consensus row of each query, with its category written in one way."""
    runs = table(spark, d, "consensus_results").where("query_id is not null").withColumn("functional_category", _label(F.col("functional_category")))
    rest = [c for c in runs.columns if c not in ("query_id", "run_at", "databases")]
    return runs.groupBy("query_id").agg(F.max(F.struct("run_at", *rest, "databases")).alias("m")).select("query_id", "m.*")


def pick(key: Column, salt: str, values: list[str | None]) -> Column:
    """One of some values by a digest of a key."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 6), 16, 10).cast("int") % len(values)
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), place + 1)


#: Evidence texts for tables that have none of their own.
SUPERFAMILIES = ["Zincins", "Ankyrin repeat", "P-loop containing nucleoside triphosphate hydrolases", "winged helix", "", None]
PROCESSES = ["viral DNA genome packaging", "viral release from host cell", "metabolic process", "", None]
FUNCTIONS = ["RNA-directed RNA polymerase activity", "structural molecule activity", "endonuclease activity", "binding", "", None]


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """What is known of a target: the greatest description that earlier runs gave it, gene and Pfam of the gold standard, evidence texts, and a structure quality from figures drawn for it."""
    told = results(spark, d).where("primary_target is not null and primary_source is not null")
    g = table(spark, d, "gold_standard").where("protein_id is not null").groupBy("protein_id").agg(F.max("gene").alias("gene"), F.max("pfam_domains").alias("pfam"), F.max("uniprot_id").alias("uniprot_id"))
    told = told.join(g, F.col("query_id") == F.col("protein_id"), "left")
    t = told.groupBy(F.col("primary_target").alias("target"), F.lower(F.regexp_replace("primary_source", BLANKS, "")).alias("source_db")).agg(F.max("description").alias("description"), F.max("gene").alias("gene"), F.max("pfam").alias("pfam"), F.max("uniprot_id").alias("uniprot_id"))
    key, none = F.col("target"), F.lit(None).cast("double")
    figure = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 6), 16, 10).cast("int") % 101
    quality, source = scoring.structure_quality(none, none, none, none, none, F.when(F.col("source_db") == "bfvd", figure("plddt").cast("double")), F.when(figure("ptm") > 10, figure("ptm") / 100))
    return t.withColumns({"structure_quality": quality, "structure_source": source, "superfamily": pick(key, "s", SUPERFAMILIES), "go_bp": pick(key, "p", PROCESSES), "go_mf": pick(key, "f", FUNCTIONS)})


def gold(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gold_standard").where("protein_id is not null")
    return g.groupBy("protein_id").agg(F.max(_label(F.col("true_category"))).alias("truth"), F.max("true_function").alias("function"), F.max("viral_family").alias("family"), F.max("pfam_domains").alias("pfam"), F.max("go_terms").alias("go"), F.max("uniprot_id").alias("uniprot_id"), F.max("gene").alias("gene"))


def proteins(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "prediction_results").where("sequence_id is not null")
    return p.groupBy("sequence_id").agg(F.max("aa_sequence").alias("aa"), F.max("three_di_sequence").alias("di"), F.max("confidence_scores").alias("scores"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "swissprot_entries").where("accession is not null")
    return e.groupBy("accession").agg(F.max("organism").alias("organism"), F.max("lineage").alias("lineage"), F.max("sequence").alias("sequence"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """id, embedding, label of the labelled embeddings."""
    return table(spark, d, "embeddings").select(F.format_string("v%07d", "vec_id").alias("id"), "embedding", "label")


def consensus_best_hits(spark: SparkSession, d: str) -> DataFrame:
    """Consensus annotation of every predicted protein, with or without hits."""
    queries = proteins(spark, d).select(F.col("sequence_id").alias("query"), F.length(F.coalesce("aa", F.lit(""))).alias("query_length"))
    out = consensus.consensus(hits(spark, d), settle(annotations(spark, d), "annotations"), queries)
    return out.withColumn("databases", F.array_join("databases", ","))


def hit_scores(spark: SparkSession, d: str) -> DataFrame:
    s = consensus.scored_hits(hits(spark, d), annotations(spark, d))
    return s.groupBy("source_db").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.max("score").alias("best_score"), F.min("score").alias("least_score"))


def best_per_database(spark: SparkSession, d: str) -> DataFrame:
    return consensus.best_per_database(consensus.scored_hits(hits(spark, d), annotations(spark, d))).select("query", "source_db", "target", "score")


def hit_merge_best(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).select("query", "target", "evalue", "source_db")
    parts = {s: h.where(F.col("source_db") == s).drop("source_db") for s in ("bfvd", "viro3d", "esmatlas")}
    return consensus.merged_hits(parts).select("query", "evalue", "target")


def best_hits_by_bits(spark: SparkSession, d: str) -> DataFrame:
    return consensus.best_hits(hits(spark, d).where("bits is not null"), "bits")


def hit_levels(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d)
    return h.groupBy("source_db", scoring.hit_level(F.col("evalue"), F.col("fident"), F.col("qcov")).alias("level")).agg(F.count("*").alias("n"))


def novelty_distribution(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).groupBy("source_db", scoring.novelty(F.col("fident")).alias("novelty")).agg(F.count("*").alias("n"), F.round(F.avg("fident"), 6).alias("mean_identity"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.distributions(results(spark, d), ["functional_category", "confidence_level", "primary_source"])


def score_statistics(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    stats = r.groupBy("confidence_level").agg(F.min("consensus_score").alias("least"), F.max("consensus_score").alias("greatest"), F.round(F.avg("consensus_score"), 6).alias("mean"))
    return stats.join(report.upper_median(r, "consensus_score", ["confidence_level"]), "confidence_level")


def structure_quality(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    even = (F.col("p_partkey") % 2) == 0
    plddt, ptm = (F.col("p_size") * 2).cast("double"), (F.col("p_partkey") % 100) / 100.0
    depth = (F.col("p_partkey") % 13 * 100).cast("double")
    third = (F.col("p_partkey") % 3) == 0
    q, source = scoring.structure_quality(F.when(third, plddt), F.when(third & even, ptm), F.when(even, plddt), F.when(even, ptm), depth, F.when(~even & (F.col("p_partkey") % 5 != 0), plddt), ptm)
    return p.select("p_partkey", F.round(q, 9).alias("quality"), source.alias("quality_source"))


def keyword_classify(spark: SparkSession, d: str) -> DataFrame:
    """Category of each true function by keywords."""
    return gold(spark, d).select("protein_id", "function", rules.by_keywords(F.col("function")).alias("category"))


def evidence_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Category of each gold-standard protein by the strongest of five kinds of evidence."""
    g, key = gold(spark, d), F.col("protein_id")
    g = g.withColumns({"superfamily": pick(key, "s", SUPERFAMILIES), "go_bp": pick(key, "p", PROCESSES), "go_mf": pick(key, "f", FUNCTIONS)})
    c, s = rules.by_evidence(F.col("function"), F.col("gene"), F.col("pfam"), F.col("superfamily"), F.col("go_bp"), F.col("go_mf"))
    return g.select("protein_id", c.alias("category"), s.alias("classification_source"))


def term_agreement(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d).join(results(spark, d), F.col("protein_id") == F.col("query_id"))
    return g.select("protein_id", text.agreement(F.col("function"), F.col("description")).alias("agreement"), F.round(text.jaccard(text.terms(F.col("function")), text.terms(F.col("description"))), 9).alias("similarity"))


def _told(spark: SparkSession, d: str) -> DataFrame:
    known = settle(annotations(spark, d), "annotations")
    best = consensus.described(consensus.best_per_database(consensus.scored_hits(hits(spark, d), known)), known)
    return best.where("description is not null").select("query", "source_db", "description", "evalue", rules.simple_category(F.col("description")).alias("category"))


def cross_db_validation(spark: SparkSession, d: str) -> DataFrame:
    return validation.validated(_told(spark, d))


def cross_db_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return validation.conflicts_from(validation.database_pairs(_told(spark, d))).select("query", "db1", "db2", "similarity", "severity", "resolution")


def db_consistency(spark: SparkSession, d: str) -> DataFrame:
    return validation.consistency(_told(spark, d))


def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return validation.status_report(validation.validated(_told(spark, d)))


def dark_matter_report(spark: SparkSession, d: str) -> DataFrame:
    return report.dark_matter_summary(results(spark, d))


def dark_matter_proteins(spark: SparkSession, d: str) -> DataFrame:
    dark = report.dark_matter(results(spark, d))
    score, reasons = report.priority(F.col("dark_category"), F.lit(False), F.col("query_length"), F.col("confidence_level"))
    return dark.select("query_id", "query_length", "dark_category", score.alias("priority"), F.array_join(reasons, "; ").alias("reasons"))


def viral_families(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("query_id", F.array_join(rules.families(F.col("description")), ",").alias("families"))


def metagenome_rollup(spark: SparkSession, d: str) -> DataFrame:
    return report.metagenome_rollup(hits(spark, d).where("source_db = 'esmatlas'"))


def neighbourhood_vote(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).select(F.col("query_id").alias("query"), text.contig_of(F.col("query_id")).alias("contig"), F.regexp_extract("query_id", r"_(\d+)$", 1).cast("int").alias("start"), "functional_category", "confidence_level")
    return genome.neighbourhood_votes(r)


def _intervals(spark: SparkSession, d: str, db: str) -> DataFrame:
    return hits(spark, d).where((F.col("source_db") == db) & F.col("qstart").isNotNull() & F.col("qend").isNotNull()).select(F.col("query").alias("contig"), F.lit(1).alias("strand"), F.col("qstart").alias("start"), F.col("qend").alias("end")).distinct()


def gene_overlap_merge(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of queries that only one database covers, beside all of the other's."""
    out = genome.merged_calls(_intervals(spark, d, "bfvd"), _intervals(spark, d, "viro3d"))
    return out.groupBy("contig").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


def multipart_merge(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).where("qstart is not null and qend is not null").select("query", "target", F.col("qstart").alias("start"), F.col("qend").alias("end"))
    m = genome.merged_parts(h, ["query", "target"])
    return m.select("query", "target", "start", "end", F.size("intervals").alias("parts"))


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "swissprot_entries").where("accession is not null").select("accession", "loaded_at")
    return genome.distinct_names(rows, "accession", ["loaded_at"]).groupBy("name").agg(F.count("*").alias("n"))


def disorder_regions(spark: SparkSession, d: str) -> DataFrame:
    found = sequences.regions(F.col("scores"))
    p = proteins(spark, d).where("scores is not null").select("sequence_id", "scores", found.alias("r"))
    covered = F.aggregate("r", F.lit(0), lambda s, x: s + x["end"] - x["start"])
    share = F.when(F.size("scores") > 0, covered / F.size("scores")).otherwise(0.0)
    return p.select("sequence_id", sequences.regions_text(F.col("r")).alias("regions"), F.round(share, 9).alias("fraction"), sequences.disorder_class(share).alias("class"))


def confidence_mask(spark: SparkSession, d: str) -> DataFrame:
    p = proteins(spark, d).where("di is not null")
    same = F.col("scores").isNull() | (F.size("scores") == F.length("di"))
    return p.where(same).select("sequence_id", sequences.mask(F.col("di"), F.col("scores")).alias("masked"))


def confidence_stats(spark: SparkSession, d: str) -> DataFrame:
    p = proteins(spark, d).where("size(scores) > 0")
    mean = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0))) / F.size("scores")
    return p.select(F.round(mean, 6).alias("m")).groupBy((F.col("m") >= 0.5).alias("kept")).agg(F.count("*").alias("n"), F.round(F.avg("m"), 5).alias("mean"), F.min("m").alias("least"), F.max("m").alias("greatest"))


def sequence_validate(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d).where("sequence is not null")
    ascii_ = F.regexp_replace("sequence", r"[^!-~]", "")
    clean = sequences.clean_protein(ascii_)
    return e.select("accession", F.md5(clean).alias("digest"), F.length(clean).alias("length"), F.array_join(sequences.protein_warnings(ascii_), ",").alias("warnings"), sequences.is_protein(ascii_).alias("protein"))


def sequence_identity(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d).join(proteins(spark, d), F.col("protein_id") == F.col("sequence_id")).join(entries(spark, d), F.col("uniprot_id") == F.col("accession"))
    a, b = (F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z]", "")) for c in ("aa", "sequence"))
    return g.select("protein_id", "accession", F.round(sequences.identity(a, b), 9).alias("identity"))


def viral_share(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).groupBy(evidence.is_viral(F.col("lineage")).alias("viral")).agg(F.count("*").alias("n"), F.countDistinct("organism").alias("organisms"))


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d).select("accession")
    model = F.concat(F.lit("CF-"), "accession", F.lit("_relaxed"))
    return e.select("accession", text.accession(F.concat(F.lit("sp|"), "accession", F.lit("|NAME"))).alias("from_pipe"), text.uniref_accession(F.concat(F.lit("UniRef50_"), "accession")).alias("from_cluster"), text.model_name(model).alias("from_model"), text.named_part(F.concat(F.lit("Gene: x; Product: part of "), "accession", F.lit("; Note: y")), "Product").alias("product"))


def go_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select("protein_id", text.go_ids(F.col("go")).alias("go_ids"))


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).select(F.col("query_id").alias("protein_id"), F.col("functional_category").alias("predicted"), F.col("consensus_score").alias("score"), "primary_identity")
    return benchmark.evaluated(gold(spark, d), r)


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.annotated_matrix(_evaluated(spark, d))


def category_metrics(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.category_matrices(_evaluated(spark, d))


def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.calibration_bins(_evaluated(spark, d))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.calibration(_evaluated(spark, d))


def stratified_metrics(spark: SparkSession, d: str) -> DataFrame:
    bins = F.when(F.col("primary_identity") < 0.2, "0.0-0.2").when(F.col("primary_identity") < 0.3, "0.2-0.3").when(F.col("primary_identity") < 0.4, "0.3-0.4").when(F.col("primary_identity") < 0.5, "0.4-0.5").when(F.col("primary_identity") < 1.0, "0.5-1.0").otherwise("none")
    rows = _evaluated(spark, d).select(bins.alias("identity_bin"), "truth", "predicted", F.coalesce("family", F.lit("-")).alias("family"), F.col("truth").alias("category"))
    return benchmark.stratified(rows, ["identity_bin", "category", "family"]).drop("level")


def baseline_compare(spark: SparkSession, d: str) -> DataFrame:
    base = gold(spark, d).select("protein_id", rules.by_keywords(F.col("function")).alias("baseline"))
    return benchmark.head_to_head(_evaluated(spark, d).join(base, "protein_id", "left"))


def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.holdout(gold(spark, d).select("protein_id", "truth"), "protein_id", "truth")


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.class_weights(gold(spark, d), "truth")


def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.macro_f1(_evaluated(spark, d))


def pfam_label_space(spark: SparkSession, d: str) -> DataFrame:
    first = split_packed(table(spark, d, "gold_standard"), "protein_id", {"pfam_domains": "PF"}).where("pos = 1").select(F.substring("value", 1, 7).alias("pfam"))
    return benchmark.label_space(first, "pfam", 2)


def export_anvio(spark: SparkSession, d: str) -> DataFrame:
    return export.anvio_functions(results(spark, d).select("query_id", "description", "primary_target", "primary_evalue", "functional_category"))


def export_genomes(spark: SparkSession, d: str) -> DataFrame:
    return export.genome_lengths(results(spark, d))


def export_dramv(spark: SparkSession, d: str) -> DataFrame:
    return export.dramv_annotations(results(spark, d)).select("scaffold", "gene_position", "description", "category", "confidence")


def export_network(spark: SparkSession, d: str) -> DataFrame:
    return export.network_genes(results(spark, d))


def export_gff(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).withColumn("contig", text.contig_of(F.col("query_id"))).withColumn("start", F.lit(1)).withColumn("end", F.col("query_length")).withColumn("strand", F.lit(1))
    return export.gff_lines(r.drop("primary_evalue"))


def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return similarity.top_similar(v, v, 3, same=True).select("query", "place", "target", "similarity")


def triage_split(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    t = similarity.triage(v, similarity.top_similar(v, v, 1, same=True), 0.3)
    s, level = scoring.triage_score(F.col("similarity"))
    return t.select("id", "matched", F.round(s, 8).alias("score"), level.alias("level"))


def retrieval_map_ndcg(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return similarity.retrieval_figures(similarity.top_similar(v, v, 10, same=True), v.select("id", "label"), 10)


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return similarity.threshold_sweep(similarity.top_similar(v, v, 1, same=True), v.select("id", "label"), SWEEP)


def sim_histogram(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return similarity.histogram(similarity.top_similar(v, v, 5, same=True), "similarity", EDGES)


def _transfer(spark: SparkSession, d: str) -> DataFrame:
    """GO terms of gold-standard entries, carried to the other queries that hit the same targets."""
    h = hits(spark, d).where("fident >= 0.5").select("query", "target", "fident").groupBy("query", "target").agg(F.max("fident").alias("similarity"))
    keepers = gold(spark, d).where("uniprot_id is not null").select(F.col("protein_id").alias("query"), F.col("uniprot_id").alias("accession"))
    own = hits(spark, d).select("query", "target").distinct().join(small_side(keepers), "query").groupBy("target").agg(F.min("accession").alias("accession"))
    matches = h.join(own, "target").groupBy("query", "accession").agg(F.max("similarity").alias("similarity"))
    e = table(spark, d, "swissprot_entries").where("accession is not null").select("accession", evidence.is_viral(F.col("lineage")).alias("viral"), F.explode("go_annotations").alias("g"))
    donors = e.select("accession", "viral", "g.go_id", "g.aspect", "g.go_term", "g.evidence_code").where("go_id is not null and aspect is not null")
    donors = donors.groupBy("accession", "go_id", "aspect").agg(F.max("viral").alias("viral"), F.max("go_term").alias("go_term"), F.max("evidence_code").alias("evidence_code"))
    return evidence.transferred_terms(matches, donors)


def go_transfer(spark: SparkSession, d: str) -> DataFrame:
    return _transfer(spark, d).select("query", "go_id", "aspect", "reliability", "donors", "donor", "cross_domain")


def go_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "swissprot_entries").where(evidence.is_viral(F.col("lineage"))).select(F.explode("go_annotations.go_id").alias("go_id"))
    return evidence.plausible_terms(_transfer(spark, d), e).groupBy("cross_domain", "aspect").agg(F.count("*").alias("n"))


def dual_validation(spark: SparkSession, d: str) -> DataFrame:
    t = _transfer(spark, d)
    r = results(spark, d).select(F.col("query_id").alias("query"), "functional_category", "consensus_score", "confidence_level")
    return evidence.dual_validated(r, evidence.go_category(t))


def go_evidence_codes(spark: SparkSession, d: str) -> DataFrame:
    return _transfer(spark, d).where("evidence_code is not null").groupBy("query").agg(F.array_join(F.sort_array(F.collect_set("evidence_code")), "|").alias("codes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each value of lineage, go_terms and pfam_domains with its position."""
    lineage = split_packed(table(spark, d, "swissprot_entries"), "accession", {"lineage": None})
    return lineage.unionByName(split_packed(table(spark, d, "gold_standard"), "protein_id", {"go_terms": "GO:", "pfam_domains": "PF"}))


NAMES = [
    *("consensus_best_hits", "hit_scores", "best_per_database", "hit_merge_best", "best_hits_by_bits", "hit_levels", "novelty_distribution", "run_summary", "score_statistics", "structure_quality"),
    *("keyword_classify", "evidence_hierarchy", "term_agreement", "cross_db_validation", "cross_db_conflicts", "db_consistency", "validation_report", "dark_matter_report", "dark_matter_proteins", "viral_families", "metagenome_rollup"),
    *("neighbourhood_vote", "gene_overlap_merge", "multipart_merge", "duplicate_ids", "disorder_regions", "confidence_mask", "confidence_stats", "sequence_validate", "sequence_identity", "viral_share", "identifiers", "go_identifiers"),
    *("confusion_matrix", "category_metrics", "calibration_bins", "calibration", "stratified_metrics", "baseline_compare", "holdout_split", "class_weights", "macro_f1", "pfam_label_space"),
    *("export_anvio", "export_genomes", "export_dramv", "export_network", "export_gff", "embedding_topk", "triage_split", "retrieval_map_ndcg", "threshold_sweep", "sim_histogram", "go_transfer", "go_filter", "dual_validation", "go_evidence_codes", "p4_found"),
]


def queries() -> dict[str, Query]:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
