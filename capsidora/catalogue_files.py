"""Queries that read files of every kind, written from the test tables beforehand, and queries of the steps around the consensus; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsidora import catalogue as c
from capsidora import oracle as o
from capsidora.functions import rules, tools
from capsidora.operators import benchmark, export, genome, metagenome, report, transfer, validation
from capsidora.session import settle, shared_path, table
from capsidora.sources import databases, files, genomes, results, sinks

Query = Callable[[SparkSession, str], DataFrame]
#: A codon for each amino acid, to write genes of proteins.
CODONS = dict(zip("ACDEFGHIKLMNPQRSTVWY", "GCT TGT GAT GAA TTT GGT CAT ATT AAA CTG ATG AAT CCT CAA CGT TCT ACT GTT TGG TAT".split(), strict=True))


def _proteins(spark: SparkSession, d: str) -> DataFrame:
    """id, sequence of the predicted proteins, of the 20 amino acids alone; empty ones are left out."""
    p = c.proteins(spark, d).select(F.col("sequence_id").alias("id"), F.regexp_replace(F.upper(F.coalesce("aa", F.lit(""))), "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("sequence"))
    return p.where("sequence <> ''")


def _gene(sequence: Column) -> Column:
    codons = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    return F.concat(F.array_join(F.transform(F.split(sequence, ""), lambda x: F.element_at(codons, x)), ""), F.lit("TAA"))


def _lines(df: DataFrame, path: str) -> str:
    df.write.text(path)
    return path


_PROTEINS_SQL = o._PROTEINS + """,
p as (select sequence_id as id, regexp_replace(upper(coalesce(aa, '')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') as s from proteins)"""


def read_fasta(spark: SparkSession, d: str) -> DataFrame:
    """Proteins written as FASTA and read again."""
    path = shared_path(spark, "fasta")
    sinks.write_fasta(_proteins(spark, d), path)
    return files.read_fasta(spark, path).select("id", F.length("sequence").alias("length"), F.md5("sequence").alias("digest"))


def read_gff(spark: SparkSession, d: str) -> DataFrame:
    """Genes written as GFF3 with embedded contigs, read and translated by the code that a header names."""
    g = _proteins(spark, d).withColumn("gene", _gene(F.col("sequence"))).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(16)))
    feature = F.concat_ws("\t", "id", F.lit("made"), F.lit("CDS"), F.lit("1"), F.length("gene").cast("string"), F.lit("."), F.lit("+"), F.lit("0"), F.concat(F.lit("ID=g."), "id", F.lit(";product=a%2Cb")))
    rows = F.array(F.struct(F.lit(0).alias("k"), F.lit("# made; transl_table=11").alias("value")), F.struct(F.lit(1).alias("k"), feature.alias("value")), F.struct(F.lit(2).alias("k"), F.lit("##FASTA").alias("value")), F.struct(F.lit(3).alias("k"), F.concat(F.lit(">"), "id", F.lit("\n"), "gene").alias("value")))
    path = _lines(g.select("part", "id", F.explode(rows).alias("r")).repartition(16, "part").sortWithinPartitions("r.k", "id").select("r.value"), shared_path(spark, "gff"))
    features, contigs = files.read_gff(spark, path)
    code = genomes.code(genomes.table_of(features, files.read_gff_comments(spark, path)))
    return files.coding_proteins(features, contigs, code).select("id", "contig", "start", "end", "strand", F.md5("sequence").alias("digest"))


def read_gff_with_proteins(spark: SparkSession, d: str) -> DataFrame:
    """Features of one file, proteins of another, joined by name."""
    p = _proteins(spark, d)
    feature = F.concat_ws("\t", F.substring_index("id", "_", 1), F.lit("made"), F.lit("CDS"), F.lit("1"), (F.length("sequence") * 3).cast("string"), F.lit("."), F.lit("-"), F.lit("0"), F.concat(F.lit("ID="), "id", F.lit(";gene=x1")))
    features, _ = files.read_gff(spark, _lines(p.select(feature), shared_path(spark, "gff")))
    path = shared_path(spark, "faa")
    sinks.write_fasta(p.where("length(sequence) % 2 = 0"), path)
    placed = genomes.features_with_proteins(features, files.read_fasta(spark, path), min_length=50)
    return placed.select("id", "description", "contig", "end", "strand", F.md5("sequence").alias("digest"))


def read_genbank(spark: SparkSession, d: str) -> DataFrame:
    """Proteins written as GenBank records and read again."""
    p = _proteins(spark, d)
    record = F.concat(F.lit("LOCUS       "), "id", F.lit(" 9 bp DNA\nFEATURES             Location/Qualifiers\n     CDS             complement(4.."), (F.length("sequence") * 3 + 6).cast("string"), F.lit(')\n                     /protein_id="'), "id", F.lit('"\n                     /translation="'), F.regexp_replace("sequence", "(.{58})(?=.)", "$1\n                     "), F.lit('"\nORIGIN\n//'))
    path = _lines(p.select(record), shared_path(spark, "genbank"))
    return files.genbank_proteins(files.read_genbank(spark, path)).select("id", "contig", "start", "end", "strand", F.md5("sequence").alias("digest"))


def read_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits written as the search program writes them, with broken lines among them: the good ones and the broken ones by number."""
    h = table(spark, d, "foldseek_hits").where("query is not null and target is not null")
    fields = [F.col(f).cast("string") for f in "query target fident alnlen mismatch gapopen qstart qend tstart tend evalue bits qlen tlen qcov tcov".split()]
    path = _lines(h.select(F.concat_ws("\t", *fields)), shared_path(spark, "hits"))
    good = files.read_hits(spark, path).agg(F.lit("good").alias("kind"), F.count("*").alias("n"), F.sum("alnlen").alias("columns"), F.min("evalue").alias("best"))
    return good.unionByName(files.broken_hits(spark, path).agg(F.lit("broken").alias("kind"), F.count("*").alias("n"), F.lit(None).cast("bigint").alias("columns"), F.lit(None).cast("double").alias("best")))


def read_obo(spark: SparkSession, d: str) -> DataFrame:
    """GO terms written as OBO, read again, and their ids found by the names in a text."""
    t = table(spark, d, "swissprot_entries").where("accession is not null").select("accession", F.explode("go_annotations").alias("g")).select("accession", "g.go_id", "g.go_term").where("go_id is not null and go_term is not null and go_term not like '%;%'")
    names = t.groupBy("go_id").agg(F.max("go_term").alias("name"))
    terms = files.read_terms(spark, _lines(names.select(F.concat(F.lit("[Term]\nid: "), "go_id", F.lit("\nname: "), "name", F.lit("\n"))), shared_path(spark, "obo")))
    rows = t.join(names, "go_id").groupBy("accession").agg(F.array_join(F.sort_array(F.collect_set("name")), "; ").alias("terms"))
    return files.resolved_terms(rows, "accession", "terms", settle(terms, "terms"))


def read_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings written as .npz archives and read again."""
    v = c.vectors(spark, d).select(F.col("id").alias("protein_id"), F.concat(F.lit("db"), F.col("label").cast("string")).alias("source_db"), "embedding")
    path = shared_path(spark, "npz")
    sinks.write_embeddings(v, path)
    e = files.read_embeddings(spark, path)
    return e.groupBy("source_db").agg(F.count("*").alias("n"), F.min("protein_id").alias("first"), F.round(F.sum(F.col("embedding")[0].cast("double")), 6).alias("sum"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "swissprot_entries").where("accession is not null and go_annotations is not null")
    return e.groupBy("accession").agg(F.max("name").alias("name"), F.max("organism").alias("organism"), F.max("lineage").alias("lineage"), F.max_by("go_annotations", F.to_json("go_annotations")).alias("go"))


def read_swissprot_json(spark: SparkSession, d: str) -> DataFrame:
    """Entries written as one JSON object and read again."""
    e = _entries(spark, d).select("accession", F.concat(F.lit(","), F.to_json(F.create_map("accession", F.struct("name", "organism", "lineage", F.col("go").alias("go_annotations")))).substr(F.lit(2), F.lit(1 << 30))).alias("line"))
    body = F.expr("substring(line, 1, length(line) - 1)")
    ends = spark.createDataFrame([("", '{"_":{}'), ("~", "}")], "accession string, line string")
    lines = e.select("accession", body.alias("line")).unionByName(ends).coalesce(1).sortWithinPartitions("accession").select("line")
    out = databases.read_swissprot_json(spark, _lines(lines, shared_path(spark, "json"))).where("accession <> '_'")
    return out.select("accession", "name", "lineage", F.size("go_annotations").alias("terms"))


def read_swissprot_xml(spark: SparkSession, d: str) -> DataFrame:
    """Entries written as XML and read again: viral ones with experimental terms, which alone are kept."""
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    known = {v: k for k, v in databases.EVIDENCE.items()}
    eco = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.col("x__")), F.lit("ECO:0000501"))
    e = _entries(spark, d).where("lineage is not null")
    terms = e.select("accession", F.posexplode("go").alias("i", "g")).where("g.go_id is not null and g.go_term is not null").withColumn("x__", F.coalesce("g.evidence_code", F.lit("-")))
    ref = F.concat(F.lit('<dbReference type="GO" id="'), "g.go_id", F.lit('"><property type="term" value="'), F.when(F.col("g.aspect") == "BP", "P").when(F.col("g.aspect") == "MF", "F").otherwise("C"), F.lit(":"), safe(F.col("g.go_term")), F.lit('"/><property type="evidence" value="'), eco, F.lit('"/></dbReference>'))
    refs = terms.groupBy("accession").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", ref.alias("r")))), lambda x: x["r"]), "").alias("refs"))
    taxa = F.transform(F.split(F.col("lineage"), ";"), lambda t: F.concat(F.lit("<taxon>"), safe(F.trim(t)), F.lit("</taxon>")))
    rows = e.join(refs, "accession").select(F.concat(F.lit("<entry><accession>"), "accession", F.lit("</accession><name>"), F.coalesce("name", F.lit("-")), F.lit("</name><organism><lineage>"), F.array_join(taxa, ""), F.lit("</lineage></organism>"), "refs", F.lit("</entry>")))
    ends = spark.createDataFrame([("!", "<all>"), ("~", "</all>")], "k string, line string")
    whole = rows.toDF("line").select(F.lit("-").alias("k"), "line").unionByName(ends).coalesce(1).sortWithinPartitions("k").select("line")
    out = databases.read_swissprot_xml(spark, _lines(whole, shared_path(spark, "xml")))
    return out.select("accession", F.size("go_annotations").alias("terms"), F.array_join(F.transform("go_annotations", lambda t: F.concat_ws(":", t["go_id"], t["aspect"], t["evidence_code"])), ",").alias("codes"))


def _drawn(key: Column, salt: str, n: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 6), 16, 10).cast("int") % n


def bfvd_annotation(spark: SparkSession, d: str) -> DataFrame:
    """Targets annotated from a structure table and an enriched one: exact ids, ids that only contain the target, accessions told twice."""
    targets = c.hits(spark, d).where("source_db = 'bfvd'").select("target").distinct()
    key = F.col("target")
    held = F.when(_drawn(key, "h", 4) == 0, F.concat(F.lit("X-"), key, F.lit(".1"))).otherwise(key)
    meta = F.concat_ws("\t", held, F.concat(F.lit("s-"), key), _drawn(key, "plddt", 101).cast("string"), (_drawn(key, "ptm", 100) / 100).cast("string"), F.lit("0"), F.lit("made"))
    metadata = databases.read_bfvd(spark, _lines(targets.where(_drawn(key, "h", 4) < 3).select(meta), shared_path(spark, "bfvd")))
    name = lambda n: F.concat_ws("\t", key, F.when(_drawn(key, "n", 3) > 0, F.concat(F.lit(f"protein {n} of "), key)).otherwise(""), F.lit("g1"), F.lit("virus x"), F.lit("viral release"), F.lit(""), F.lit("PF1"), F.lit(""), F.lit(""), F.lit("Viruses"))
    path = shared_path(spark, "enriched")
    told = targets.where(_drawn(key, "e", 2) == 0)
    head = "\t".join(["uniprot_accession", "protein_name", "gene_name", "organism", "go_bp", "go_mf", "pfam_domains", "keywords", "function_cc", "lineage"])
    lines = spark.createDataFrame([("", 0, head)], "k string, i int, line string").unionByName(told.select(key.alias("k"), F.lit(1).alias("i"), name(1).alias("line"))).unionByName(told.select(key.alias("k"), F.lit(2).alias("i"), name(2).alias("line")))
    _lines(lines.coalesce(1).sortWithinPartitions("k", "i").select("line"), path)
    out = databases.bfvd_annotations(targets, metadata, databases.read_bfvd_enriched(spark, path))
    return out.select("target", "uniprot_id", "description", "gene", "pfam", F.round("structure_quality", 9).alias("structure_quality"), "structure_source")


def viro3d_annotation(spark: SparkSession, d: str) -> DataFrame:
    """Targets annotated from a protein list and its expansions: by model name, by GenBank id, with several annotations an id."""
    targets = c.hits(spark, d).where("source_db = 'viro3d'").select("target").distinct()
    key = F.col("target")
    ident = F.concat(key, F.lit("_77"))
    whole = F.when(_drawn(key, "h", 4) == 0, F.concat(F.lit("other_"), key)).otherwise(ident)
    title = F.when(_drawn(key, "n", 3) == 0, F.concat(F.lit("Gene: g"), _drawn(key, "g", 9).cast("string"), F.lit("; Product: part of "), key)).when(_drawn(key, "n", 3) == 1, "hypothetical protein").otherwise("")
    rows = targets.where(_drawn(key, "h", 4) < 3).select(whole.alias("Viro3D ID"), title.alias("Viro3D Name"), F.lit("species").alias("ICTV Species"), F.concat(F.lit("GB"), key).alias("GenBank Protein ID"), F.lit("U").alias("UniProt ID"), F.lit("9").alias("Protein Length"), _drawn(key, "plddt", 101).cast("string").alias("ESMFold pLDDT"), (_drawn(key, "ptm", 100) / 100).cast("string").alias("ESMFold pTM"))
    path = shared_path(spark, "viro3d")
    rows.write.option("header", True).csv(path)
    folder = shared_path(spark, "expansions")
    several = targets.select("target", F.explode(F.sequence(F.lit(0), _drawn(key, "m", 3))).alias("i"))
    for kind in ("pfam", "superfamily", "go_bp"):
        name, column = databases.EXPANSIONS[kind]
        own = several.where(_drawn(key, kind, 2) == 0).select(ident.alias("Viro3D ID"), F.concat(F.lit(f"{kind} {{"), F.col("i").cast("string"), F.lit("}, made")).alias(column), (_drawn(F.concat(key, F.col("i").cast("string")), kind, 1000) / 1000).cast("string").alias(databases.RATIO))
        own.write.option("header", True).csv(f"{folder}/Viro3D_proteins_with_{name}_annotation_expansion.csv")
    models = targets.select(F.concat(F.lit("CF-"), ident, F.lit("_relaxed")).alias("target"))
    expansions = databases.best_expansions(databases.read_expansions(spark, folder))
    out = databases.viro3d_annotations(models, databases.read_viro3d(spark, ["/no/such/list.csv", path]), expansions)
    return out.select("target", "description", "gene", "pfam", "superfamily", "go_bp", F.round("structure_quality", 9).alias("structure_quality"), "structure_source")


def result_table(spark: SparkSession, d: str) -> DataFrame:
    """The consensus table written with all its columns and read again."""
    r = c.results(spark, d).withColumns({"novelty": F.lit("new"), "go_bp": F.lit(None).cast("string")})
    path = shared_path(spark, "results")
    sinks.write_table(results.consensus_table(r), path)
    t = results.load_results(spark, path)
    return t.select("query_id", "query_length", "description", "consensus_score", "primary_evalue", "novelty", "go_bp", F.lit(len(t.columns)).alias("columns"))


def dark_table(spark: SparkSession, d: str) -> DataFrame:
    dark = report.dark_matter(c.results(spark, d))
    return results.dark_table(dark).drop("disorder_class", "disorder_fraction")


def dark_matter_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return report.dark_matter_breakdown(report.dark_matter(c.results(spark, d)))


def run_figures(spark: SparkSession, d: str) -> DataFrame:
    return results.run_summary(c.results(spark, d))


def cross_domain_table(spark: SparkSession, d: str) -> DataFrame:
    """Proteins whose most reliable GO term comes from a donor that isn't viral."""
    summary = transfer.go_summary(c._transfer(spark, d)).withColumnRenamed("query", "query_id")
    t = results.cross_domain_table(c.results(spark, d).join(summary, "query_id"))
    return t.select("query_id", "functional_category", "go_transfer_ri", "go_transfer_best_match", "go_transfer_similarity", "go_evidence_codes")


def go_summary(spark: SparkSession, d: str) -> DataFrame:
    return transfer.go_summary(c._transfer(spark, d))


def search_database(spark: SparkSession, d: str) -> DataFrame:
    return results.search_database(_proteins(spark, d))[1]


def prediction_files(spark: SparkSession, d: str) -> DataFrame:
    p = c.proteins(spark, d).where("scores is null or size(scores) = length(di)").select(F.col("sequence_id").alias("id"), F.col("di").alias("three_di"), "scores")
    _, masked, mean = results.predictions(p)
    return masked.join(mean, "id").select("id", "sequence", "length", F.round(F.col("mean_confidence").cast("double"), 2).alias("mean"))


def single_hit_transfer(spark: SparkSession, d: str) -> DataFrame:
    queries = c.proteins(spark, d).select(F.col("sequence_id").alias("query"), F.length(F.coalesce("aa", F.lit(""))).alias("query_length"))
    out = transfer.single_hit(c.hits(spark, d), settle(c.annotations(spark, d), "annotations"), queries)
    return out.select("query_id", "description", "confidence_level", "source_db", "target_id", "evalue", "identity", "gene", "num_hits")


def step_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Categories that later steps fill in where it is unknown, by their order."""
    r = c.results(spark, d).select("query_id", "functional_category", F.lit("keywords").alias("classification_source"))
    step = lambda salt: r.select("query_id", c.pick(F.col("query_id"), salt, ["lysis", "entry", "unknown", None, None]).alias("category"))
    return transfer.overlaid(r, later={"neighbourhood": step("w"), "classifier": step("k"), "language_model": step("l")})


def triage_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Annotation taken over from a similar target takes precedence over that of hits."""
    r = c.results(spark, d).select("query_id", "description", "functional_category", F.lit("keywords").alias("classification_source"), "consensus_score", "confidence_level")
    best = c.hits(spark, d).groupBy("query").agg(F.min(F.struct((-F.col("fident")).alias("f"), "target", "source_db")).alias("b"))
    matches = best.select(F.col("query").alias("id"), "b.target", "b.source_db", (-F.col("b.f")).alias("similarity")).withColumn("matched", F.col("similarity") >= 0.6)
    t = transfer.triaged(matches, settle(c.annotations(spark, d), "annotations"))
    return transfer.overlaid(r, triage=t.drop("target", "source_db", "similarity"))


def to_reclassify(spark: SparkSession, d: str) -> DataFrame:
    r = c.results(spark, d).withColumn("classification_source", c.pick(F.col("query_id"), "r", ["keywords", "embedding:keywords", "pfam:x"]))
    return transfer.to_reclassify(r).groupBy("classification_source").agg(F.count("*").alias("n"))


def label_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Reference ids with the labels of two tables, without excluded ids, with extra labels where there is none."""
    ids = c.hits(spark, d).select(F.col("target").alias("protein_id"), "source_db").distinct()
    labels = transfer.labels_of(ids, settle(c.annotations(spark, d), "annotations"))
    drawn = lambda salt: ids.select("protein_id", c.pick(F.col("protein_id"), salt, ["lysis", "entry", None]).alias("category")).where("category is not null").distinct()
    merged = transfer.merged_labels(labels.groupBy("protein_id").agg(F.min("category").alias("category")), drawn("m").where("category = 'lysis'"))
    out = transfer.dataset(ids.select("protein_id").distinct(), ids.where(_drawn(F.col("protein_id"), "x", 5) == 0), merged, drawn("y"))
    return out.groupBy("category").agg(F.count("*").alias("n"))


def informative_unknowns(spark: SparkSession, d: str) -> DataFrame:
    return transfer.informative_unknowns(c.results(spark, d).select("description", F.col("functional_category").alias("category")))


def limited_hits(spark: SparkSession, d: str) -> DataFrame:
    return tools.limited(c.hits(spark, d).select("query", "target", "source_db", "evalue", "bits").distinct(), 1e-3, 3).groupBy("query").agg(F.count("*").alias("n"), F.max("evalue").alias("worst"))


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    dark = report.dark_matter(c.results(spark, d))
    runs = F.col("query_length") % 150
    told = metagenome.recommendations(runs >= 10, runs, F.col("dark_category") != "no_hits", F.col("query_length"), F.sort_array("databases"), F.col("functional_category"))
    return dark.select("query_id", F.array_join(told, " | ").alias("recommendations"))


def metagenomic_context(spark: SparkSession, d: str) -> DataFrame:
    """Unexplained proteins with the matches of the families that their description hints at."""
    r = c.results(spark, d)
    matches = r.select(F.explode(rules.families(F.col("description"))).alias("family"), F.col("query_id").alias("run"), F.round(F.col("consensus_score") * 100, 6).alias("identity"))
    out = metagenome.characterized(report.dark_matter(r), settle(matches, "matches"))
    return out.select("query_id", F.array_join("family_hits", ",").alias("families"), F.col("runs").cast("bigint").alias("runs"), F.round("best_identity", 6).alias("best_identity"), "conserved", F.round("conservation", 9).alias("conservation"), "priority")


def atlas_context(spark: SparkSession, d: str) -> DataFrame:
    dark = report.dark_matter(c.results(spark, d))
    predicted = c.proteins(spark, d).where("di is not null").select(F.col("sequence_id").alias("id"))
    return metagenome.atlas_summary(metagenome.with_atlas(dark, predicted, report.metagenome_rollup(c.hits(spark, d).where("source_db = 'esmatlas'"))))


def class_cosines(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.class_cosines(c.vectors(spark, d))


def silhouette(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.silhouette(c.vectors(spark, d))


def _baseline(spark: SparkSession, d: str) -> DataFrame:
    base = c.gold(spark, d).select("protein_id", rules.by_keywords(F.col("function")).alias("baseline"))
    return c._evaluated(spark, d).join(base, "protein_id", "left")


def baseline_three_way(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.three_way(_baseline(spark, d))


def dark_reduction(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.dark_reduction(_baseline(spark, d))


def family_scorecard(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.scorecard(c._evaluated(spark, d).withColumn("family", F.coalesce("family", F.lit("-"))), "family")


def filtered_dataset(spark: SparkSession, d: str) -> DataFrame:
    rows = benchmark.selected(c._evaluated(spark, d), ("primary_identity", 0.5), ["structural", "replication", "unknown"])
    return rows.groupBy("truth").agg(F.count("*").alias("n"))


def identity_bins(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("fident")
    bin_ = F.when(f < 0.2, "twilight").when(f < 0.3, "remote").when(f < 0.5, "moderate").otherwise("easy")
    return benchmark.identity_bins(c.hits(spark, d).where("fident is not null"), bin_)


def matched_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids written in other ways, matched with those of the gold standard."""
    g = c.gold(spark, d).select("protein_id")
    way = _drawn(F.col("protein_id"), "q", 4)
    queries = g.select(F.when(way == 0, F.col("protein_id")).when(way == 1, F.concat("protein_id", F.lit("|virus"))).when(way == 2, F.concat("protein_id", F.lit(".1"))).otherwise(F.expr("substring(protein_id, 1, length(protein_id) - 1)")).alias("query"))
    return benchmark.matched_ids(queries, g.withColumnRenamed("protein_id", "key"))


def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return validation.reliability_bins(validation.validated(c._told(spark, d)))


def contained_features(spark: SparkSession, d: str) -> DataFrame:
    """Stretches that one database covers, within those of the other."""
    parts = c._intervals(spark, d, "viro3d").withColumn("part_id", F.concat_ws(":", "contig", F.col("start").cast("string"), F.col("end").cast("string")))
    wholes = c._intervals(spark, d, "bfvd").withColumns({"whole_id": F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string")), "ord": F.col("start") * 100_000 + F.col("end")})
    return genome.containing(parts, wholes)


def spread_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every third protein of 80 to 150 letters, in the order of ids."""
    p = _proteins(spark, d).where(F.length("sequence").between(80, 150))
    return export.numbered(p.select("id"), ["id"], "n").where("n % 3 = 0").select("id", "n")


def called_genes(spark: SparkSession, d: str) -> DataFrame:
    """The longest open frame of each written gene is the gene itself, where it begins with a start codon."""
    p = _proteins(spark, d).where("sequence like 'M%' and length(sequence) >= 40")
    genes = genomes.called_genes(p.select(F.col("id").alias("contig"), _gene(F.col("sequence")).alias("sequence")))
    own = genes.where("start = 1 and strand = 1").groupBy("contig").agg(F.max_by("protein_sequence", "end").alias("s"), F.max("end").alias("end"))
    return own.select("contig", "end", F.md5("s").alias("digest"))


def aligned_identity(spark: SparkSession, d: str) -> DataFrame:
    """Gold-standard proteins aligned with their reference entries, and whether the match stays."""
    from capsidora.functions import providers

    g = c.gold(spark, d).where("uniprot_id is not null").select(F.col("protein_id").alias("id"), F.col("uniprot_id").alias("target"), F.lit("bfvd").alias("source_db"))
    clean = lambda x: F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z]", "")
    refs = c.entries(spark, d).select(F.col("accession").alias("name"), F.lit("bfvd").alias("source_db"), clean(F.col("sequence")).alias("sequence"))
    out = providers.realigned(g, c.proteins(spark, d).select(F.col("sequence_id").alias("id"), clean(F.col("aa")).alias("sequence")), refs)
    return out.select("id", "target", F.round("identity", 6).alias("identity"), "kept")


def worst_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return validation.worst_conflicts(validation.database_pairs(c._told(spark, d)), 25).select("query", "db1", "db2", "similarity", "severity")


def dataset_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Categories and families of the gold standard by number."""
    return report.distributions(c.gold(spark, d), ["truth", "family"])


def hit_coverage(spark: SparkSession, d: str) -> DataFrame:
    return report.hit_coverage(c.hits(spark, d), c.proteins(spark, d).select(F.col("sequence_id").alias("query")))


NAMES = [
    *("worst_conflicts", "dataset_distribution", "hit_coverage"),
    *("read_fasta", "read_gff", "read_gff_with_proteins", "read_genbank", "read_hits", "read_obo", "read_embeddings", "read_swissprot_json", "read_swissprot_xml", "bfvd_annotation", "viro3d_annotation"),
    *("result_table", "dark_table", "dark_matter_breakdown", "run_figures", "cross_domain_table", "go_summary", "search_database", "prediction_files", "single_hit_transfer", "step_overlay", "triage_overlay", "to_reclassify"),
    *("label_dataset", "informative_unknowns", "limited_hits", "recommendations", "metagenomic_context", "atlas_context", "class_cosines", "silhouette", "baseline_three_way", "dark_reduction", "family_scorecard", "filtered_dataset"),
    *("identity_bins", "matched_ids", "reliability_bins", "contained_features", "spread_sample", "called_genes", "aligned_identity"),
]


def queries() -> dict[str, Query]:
    return {n: globals()[n] for n in NAMES}


def _h(key: str, salt: str, n: int) -> str:
    return f"cast(cast('0x' || substr(md5('{salt}' || {key}), 1, 6) as bigint) % {n} as integer)"


def _quality(p: str, t: str) -> str:
    return (
        f"0.7::double * (case when {p} >= 70 then 0.9::double + 0.1::double * (({p} - 70) / 30) when {p} >= 50 then 0.7::double + 0.2::double * (({p} - 50) / 20) when {p} >= 30 then 0.5::double + 0.2::double * (({p} - 30) / 20) else 0.3::double + 0.2::double * ({p} / 30) end)"
        f" + 0.3::double * (case when {t} >= 0.5 then 0.85::double + 0.15::double * (({t} - 0.5::double) / 0.5::double) when {t} >= 0.3 then 0.7::double + 0.15::double * (({t} - 0.3::double) / 0.2::double) else 0.5::double + 0.2::double * ({t} / 0.3::double) end)"
    )


def oracle_sql() -> dict[str, str]:
    w = o._with
    proteins = w(_PROTEINS_SQL)
    told = (o._HITS, o._RESULTS, o._NOTES, o._SCORED, o._BEST, o._TOLD, o._PAIRS)
    evaluated = (o._GOLD, o._RESULTS, o._EVALUATED)
    text_ = "lower(coalesce(function, '') || ' ')"
    base = f"based as (select e.*, {o._by_keywords('rule', 't')} as baseline from (select *, {text_} as t, {o._first(text_, rules.KEYWORDS)} as rule from evaluated) e)"
    entries = """e as (
  select accession, max(name) as name, max(lineage) as lineage, arg_max(go_annotations, cast(to_json(go_annotations) as varchar)) as go
  from swissprot_entries where accession is not null and go_annotations is not null group by accession)"""
    families = ", ".join(f"case when contains(lower(coalesce(description, '')), {o._q(k)}) then [{', '.join(map(o._q, v))}] else []::varchar[] end" for k, v in rules.FAMILIES.items())
    level = "case when evalue < 1e-50 then 0.4::double when evalue < 1e-20 then 0.3::double when evalue < 1e-10 then 0.2::double when evalue < 1e-5 then 0.1::double else 0::double end + case when fident >= 0.7 then 0.3::double when fident >= 0.5 then 0.2::double when fident >= 0.3 then 0.1::double else 0::double end + case when qcov >= 0.8 then 0.3::double when qcov >= 0.6 then 0.2::double when qcov >= 0.4 then 0.1::double else 0::double end"
    ladder = o._ladder("t", "rule")
    told_text, label_text = "lower(description || ' ' || coalesce(gene, ''))", "lower(coalesce(description, '') || ' ' || coalesce(gene, ''))"
    expansions = lambda kind: f"""x_{kind} as (select id, arg_max('{kind} {{' || i || '}}, made', struct_pack(c := r, o := -i)) as a from (
      select target || '_77' as id, i, ({_h("target || cast(i as varchar)", kind, 1000)}) / 1000.0::double as r from (select target, unnest(range(0, {_h('target', 'm', 3)} + 1)) as i from t) where {_h('target', kind, 2)} = 0) group by id)"""  # noqa: E731
    best_go = "g as (select query, arg_min(struct_pack(r := reliability, d := b.donor, s := b.similarity, c := not b.viral), struct_pack(r := -reliability, g := go_id, d := b.donor)) as b, string_agg(distinct b.evidence_code, '|' order by b.evidence_code) as codes from transfer group by query)"
    transferred = (o._HITS, o._GOLD, o._TRANSFER.replace("viral := viral)", "viral := viral, similarity := similarity)"))
    severity = "case severity when 'critical' then 3 when 'major' then 2 when 'minor' then 1 else 0 end"
    return {
        "worst_conflicts": w(*told) + f"select query, db1, db2, similarity, severity from pairs where conflict and {severity} >= 1 order by {severity} desc, similarity, query, db1, db2 limit 25",
        "dataset_distribution": w(o._GOLD) + "select 'truth' as field, truth as value, count(*) as n from gold group by all union all select 'family', family, count(*) from gold group by all",
        "hit_coverage": w(o._PROTEINS, o._HITS) + "select (select count(*) from proteins) as queries, count(distinct query) as with_hits, count(*) as hits, count(distinct target) as targets, round(count(*)::double / count(distinct query), 9) as mean_hits from hits",
        "read_fasta": proteins + "select id, cast(length(s) as integer) as length, md5(s) as digest from p where s <> ''",
        "read_gff": proteins + "select 'g.' || id as id, id as contig, 1 as start, cast(length(s) * 3 + 3 as integer) as \"end\", 1 as strand, md5(s) as digest from p where s <> ''",
        "read_gff_with_proteins": proteins + "select id, 'x1' as description, split_part(id, '_', 1) as contig, cast(length(s) * 3 as integer) as \"end\", -1 as strand, md5(s) as digest from p where length(s) >= 50 and length(s) % 2 = 0",
        "read_genbank": proteins + "select id, id as contig, 4 as start, cast(length(s) * 3 + 6 as integer) as \"end\", -1 as strand, md5(s) as digest from p where s <> ''",
        "read_hits": "with h as (select *, fident is not null and alnlen is not null and mismatch is not null and gapopen is not null and qstart is not null and qend is not null and tstart is not null and tend is not null and evalue is not null and bits is not null and qlen is not null and tlen is not null and qcov is not null and tcov is not null as ok from foldseek_hits where query is not null and target is not null) select 'good' as kind, count(*) filter (ok) as n, cast(sum(alnlen) filter (ok) as bigint) as columns, min(evalue) filter (ok) as best from h union all select 'broken', count(*) filter (not ok), null, null from h",
        "read_obo": """with t as (select accession, unnest(go_annotations, recursive := true) from swissprot_entries where accession is not null),
k as (select accession, go_id, go_term from t where go_id is not null and go_term is not null and go_term not like '%;%'),
names as (select go_id, max(go_term) as name from k group by 1), ids as (select lower(trim(name)) as n, min(go_id) as go_id from names group by 1),
own as (select distinct accession, name from k join names using (go_id)),
pos as (select accession, name, row_number() over (partition by accession order by name) as i from own),
found as (select accession, go_id, min(i) as i from pos join ids on n = lower(trim(name)) group by all)
select accession, string_agg(go_id, '; ' order by i) as go_ids from found group by accession""",
        "read_embeddings": "select 'db' || cast(label as varchar) as source_db, count(*) as n, min(printf('v%07d', vec_id)) as first, round(sum(embedding[1]::double), 6) as sum from embeddings group by 1",
        "read_swissprot_json": w(entries) + "select accession, name, lineage, cast(len(go) as integer) as terms from e",
        "read_swissprot_xml": w(entries, "x as (select accession, i, g from (select accession, unnest(go) as g, generate_subscripts(go, 1) as i from e where starts_with(trim(split_part(lineage, ';', 1)), 'Viruses')))") + "select accession, cast(count(*) as integer) as terms, string_agg(g.go_id || ':' || (case when g.aspect in ('BP', 'MF') then g.aspect else 'CC' end) || ':' || g.evidence_code, ',' order by i) as codes from x where g.go_id is not null and g.go_term is not null and g.evidence_code in ('EXP', 'IDA', 'IMP', 'IGI', 'IPI', 'IEP', 'HDA', 'HMP', 'HGI', 'HEP', 'HTP') group by 1",
        "bfvd_annotation": w(o._HITS, f"t as (select distinct target, {_h('target', 'h', 4)} as h, {_h('target', 'e', 2)} as e, {_h('target', 'n', 3)} as n, {_h('target', 'plddt', 101)}::double as p, {_h('target', 'ptm', 100)} / 100.0::double as m from hits where source_db = 'bfvd')",
            "u as (select *, case when h = 0 then 'X-' || target || '.1' else target end as uniprot_id from t where h < 3)")
        + f"select target, uniprot_id, case when e = 0 and h > 0 and n > 0 then 'protein 2 of ' || target else 'UniProt:' || uniprot_id end as description, case when e = 0 and h > 0 then 'g1' end as gene, case when e = 0 and h > 0 then 'PF1' end as pfam, round({_quality('p', 'm')}, 9) as structure_quality, 'bfvd_af2' as structure_source from u",
        "viro3d_annotation": w(o._HITS, f"t as (select distinct target, {_h('target', 'h', 4)} as h, {_h('target', 'n', 3)} as n, {_h('target', 'g', 9)} as g, {_h('target', 'plddt', 101)}::double as p, {_h('target', 'ptm', 100)} / 100.0::double as m from hits where source_db = 'viro3d')", expansions("pfam"), expansions("superfamily"), expansions("go_bp"))
        + f"select 'CF-' || target || '_77_relaxed' as target, case when n = 0 then 'part of ' || target when xp.a is not null then xp.a when xs.a is not null then xs.a when n = 1 then 'hypothetical protein' else 'viral protein' end as description, case when n = 0 then 'g' || g end as gene, xp.a as pfam, xs.a as superfamily, xg.a as go_bp, round({_quality('p', 'm')}, 9) as structure_quality, 'esmfold' as structure_source from t left join x_pfam xp on xp.id = target || '_77' left join x_superfamily xs on xs.id = target || '_77' left join x_go_bp xg on xg.id = target || '_77' where h < 3",
        "result_table": w(o._RESULTS) + "select query_id, query_length, nullif(description, '') as description, round(consensus_score, 3) as consensus_score, primary_evalue, 'new' as novelty, null::varchar as go_bp, 44 as columns from results",
        "dark_table": w(o._RESULTS, o._dark()) + """select query_id, query_length, dark_category as category, case when dark_category = 'no_hits' then 'No structural homologs detected in any database' when dark_category = 'unknown_function' then 'Structural homologs found but function is uncharacterized'
  when functional_category = 'unknown' then 'Only weak structural homologs (e-value: ' || printf('%.2e', coalesce(primary_evalue, 0)) || ', identity: ' || printf('%.1f', coalesce(primary_identity, 0) * 100) || '%)' else 'Low confidence annotation (score: ' || printf('%.3f', consensus_score) || ')' end as reason,
  case when primary_evalue <> 0 then primary_evalue end as best_evalue, case when primary_identity <> 0 then primary_identity end as best_identity, confidence_level, case when consensus_score > 0 then consensus_score end as consensus_score, description, coalesce(array_to_string(databases, ','), '') as databases_with_hits from dark""",
        "dark_matter_breakdown": w(o._RESULTS, o._dark()) + "select 'dark_category' as kind, dark_category as value, count(*) as n from dark group by all union all select 'confidence_level', confidence_level, count(*) from dark group by all",
        "run_figures": w(o._RESULTS, "x as (select *, case when primary_target is not null then consensus_score end as s from results)") + "select count(*) as proteins, count(primary_target) as annotated, round(count(primary_target)::double / count(*), 9) as share, min(s) as least_score, max(s) as greatest_score, round(avg(s), 9) as mean_score, round(median(s), 9) as median_score from x",
        "cross_domain_table": w(o._RESULTS, *transferred, best_go) + "select query_id, functional_category, round(b.r, 3) as go_transfer_ri, b.d as go_transfer_best_match, round(b.s, 3) as go_transfer_similarity, coalesce(codes, '') as go_evidence_codes from results join g on g.query = query_id where b.c",
        "go_summary": w(*transferred, best_go) + "select query, b.r as go_transfer_ri, b.d as go_transfer_best_match, b.s as go_transfer_similarity, coalesce(codes, '') as go_evidence_codes, b.c as is_cross_domain from g",
        "search_database": proteins + "select row_number() over (order by id) - 1 as i, cast(coalesce(sum(length(s) + 2) over (order by id rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\", cast(length(s) + 2 as integer) as length from p where s <> ''",
        "prediction_files": w(o._PROTEINS, "x as (select *, len(scores) as n from proteins where di is not null and (scores is null or len(scores) = length(di)))")
        + "select sequence_id as id, case when coalesce(n, 0) = 0 then di else array_to_string(list_transform(range(1, length(di) + 1), lambda i: case when coalesce(scores[i]::double, 0::double) >= 0.7::double then di[i] else 'X' end), '') end as sequence, cast(length(di) as integer) as length, case when coalesce(n, 0) > 0 then round(round(list_sum(list_transform(scores, lambda s: coalesce(s::double, 0))) / n, 4), 2) else 0 end as mean from x",
        "single_hit_transfer": w(o._PROTEINS, o._HITS, o._RESULTS, o._NOTES, "k as (select query, count(*) as num_hits from hits group by 1)", f"b as (select *, {level} as points from (select *, row_number() over (partition by query order by evalue, target, source_db, fident nulls first, qcov nulls first, bits nulls first) as o from hits) where o = 1)")
        + f"select sequence_id as query_id, coalesce(nullif(n.description, ''), 'hypothetical protein') as description, case when b.query is null then 'none' else {o._steps('points', o.HIT_LEVELS, 'very_low')} end as confidence_level, b.source_db, b.target as target_id, b.evalue, b.fident as identity, n.gene, coalesce(num_hits, 0) as num_hits from proteins left join b on b.query = sequence_id left join notes n on n.target = b.target and n.source_db = b.source_db left join k on k.query = sequence_id",
        "step_overlay": w(o._RESULTS, "x as (select query_id, functional_category as f, " + ", ".join(f"nullif({o._drawn('query_id', s, ['lysis', 'entry', 'unknown', None, None])}, 'unknown') as {s}" for s in "wkl") + " from results)")
        + "select query_id, case when f = 'unknown' then coalesce(k, l, w, f) else f end as functional_category, case when f <> 'unknown' then 'keywords' when k is not null then 'classifier' when l is not null then 'language_model' when w is not null then 'neighbourhood' else 'keywords' end as classification_source from x",
        "triage_overlay": w(o._HITS, o._RESULTS, o._NOTES, "b as (select query, arg_min(target, struct_pack(f := -fident, t := target, s := source_db)) as target, arg_min(source_db, struct_pack(f := -fident, t := target, s := source_db)) as source_db, max(fident) as similarity from hits where fident is not null group by 1)",
            f"d as (select b.query, b.similarity, coalesce(nullif(description, ''), 'hypothetical protein') as description, n.* exclude (target, source_db, description) from b left join notes n on n.target = b.target and n.source_db = b.source_db where similarity >= 0.6)",
            f"e as (select *, lower(description || ' ' || coalesce(gene, '')) as t, {o._first(told_text, rules.KEYWORDS)} as rule from d)", f"f as (select query, description, {ladder[0]} as category, 'embedding:' || {ladder[1]} as source, round(least(1.0::double, 0.95::double * similarity + 0.05::double), 6) as score, least(1.0::double, 0.95::double * similarity + 0.05::double) as s from e)")
        + "select query_id, coalesce(f.description, r.description) as description, coalesce(category, functional_category) as functional_category, coalesce(source, 'keywords') as classification_source, coalesce(score, consensus_score) as consensus_score, case when f.query is null then confidence_level when s >= 0.8 then 'high' when s >= 0.5 then 'medium' else 'low' end as confidence_level from results r left join f on f.query = query_id",
        "to_reclassify": w(o._RESULTS, f"x as (select *, {o._drawn('query_id', 'r', ['keywords', 'embedding:keywords', 'pfam:x'])} as classification_source from results)") + "select classification_source, count(*) as n from x where primary_target is not null and functional_category = 'unknown' and classification_source <> 'pfam:x' group by 1",
        "label_dataset": w(o._HITS, o._RESULTS, o._NOTES, "ids as (select distinct target, source_db from hits)", f"a as (select i.target, n.* exclude (target, source_db), lower(coalesce(description, '') || ' ' || coalesce(gene, '')) as t, {o._first(label_text, rules.KEYWORDS)} as rule from ids i join notes n using (target, source_db))",
            f"l as (select target, min(category) as category from (select target, {ladder[0]} as category from a) where category <> 'unknown' group by 1)", f"x as (select distinct i.target, l.category as own, {o._drawn('i.target', 'm', ['lysis', 'entry', None])} as m, {o._drawn('i.target', 'y', ['lysis', 'entry', None])} as y from ids i left join l using (target) where {_h('i.target', 'x', 5)} <> 0)")
        + "select coalesce(case when m = 'lysis' then 'lysis' end, own, y, 'unknown') as category, count(*) as n from x group by 1",
        "informative_unknowns": w(o._RESULTS) + "select lower(trim(description)) as description, count(*) as n from results where functional_category = 'unknown' and coalesce(description, '') <> '' and not contains(description, 'UniProt:') and not regexp_matches(lower(description), 'hypothetical|uncharacteri[sz]ed|unknown') group by 1 having count(*) >= 2",
        "limited_hits": w(o._HITS, "x as (select *, row_number() over (partition by query order by evalue, bits desc nulls last, target) as r from (select distinct query, target, source_db, evalue, bits from hits) where evalue <= 1e-3)") + "select query, count(*) as n, max(evalue) as worst from x where r <= 3 group by 1",
        "recommendations": w(o._RESULTS, o._dark(), "x as (select *, query_length % 150 as runs from dark)")
        + """select query_id, array_to_string(list_filter([case when runs >= 10 then 'Conserved in metagenomes - likely functionally important. Consider experimental characterization.' end,
  case when runs > 100 then 'Found in ' || runs || ' SRA datasets via Serratus. Well-distributed in environmental samples.' when runs > 0 then 'Found in ' || runs || ' SRA datasets. Consider targeted metagenomic mining.' end,
  case when dark_category = 'no_hits' then 'No structural homologs detected. Consider AlphaFold prediction followed by Foldseek search against ESM Metagenomic Atlas.' end, case when dark_category = 'no_hits' then 'Novel fold candidate - priority target for structural biology.' end,
  case when query_length < 100 then 'Short protein (<100 aa) - may be a regulatory peptide or part of a larger polyprotein.' when query_length > 1000 then 'Large protein (>1000 aa) - may contain multiple domains. Consider domain parsing with InterProScan.' end,
  case when len(databases) > 0 then 'Associated environments: ' || array_to_string(list_sort(databases)[1:5], ', ') || '. May provide clues about host range or ecology.' end,
  case when functional_category = 'unknown' then 'Unknown function with structural evidence. Consider remote homology search with HHpred or DALI.' end], lambda r: r is not null), ' | ') as recommendations from x""",
        "metagenomic_context": w(o._RESULTS, o._dark(), f"fam as (select query_id, list_sort(list_distinct(flatten([{families}]))) as f, consensus_score from results)", "m as (select distinct unnest(f) as family, query_id as run, round(consensus_score * 100, 6) as identity from fam)", "top as (select * from (select *, row_number() over (partition by family order by identity desc, run) as r from m where identity is not null) where r <= 10)",
            "sizes as (select family, count(*) as n, max(identity) as best from top group by 1)", "asked as (select query_id, unnest(f[1:3]) as family from fam)", "x as (select query_id, string_agg(family, ',' order by family) as families, cast(sum(n) as bigint) as runs, max(best) as best from asked join sizes using (family) group by 1)",
            "y as (select d.*, coalesce(families, '') as families, coalesce(runs, 0) as runs, coalesce(best, 0.0::double) as best from dark d left join x using (query_id))")
        + "select query_id, families, runs, round(best, 6) as best_identity, runs >= 10 as conserved, round(case when runs >= 10 then least(1.0::double, runs / 100.0::double) else 0.0::double end, 9) as conservation, least(1.0::double, round(case when dark_category = 'no_hits' then 0.4::double else 0 end + case when runs >= 10 then 0.3::double else 0 end + case when query_length between 100 and 500 then 0.1::double else 0 end + case when dark_category = 'unknown_function' and confidence_level in ('high', 'medium') then 0.2::double else 0 end, 9)) as priority from y",
        "atlas_context": w(o._PROTEINS, o._HITS, o._RESULTS, o._dark(), "r as (select query, count(*) as hits, bool_or(contains(target, 'ESM') or contains(target, 'MGY')) as novel, count(distinct case when contains(target, '_') then split_part(target, '_', 1) end) as clusters from hits where source_db = 'esmatlas' and fident >= 0.3 and qcov >= 0.5 group by 1)", "s as (select r.* from dark join proteins on sequence_id = query_id and di is not null left join r on r.query = query_id)") + "select count(*) as searched, count(*) filter (hits > 0) as with_hits, count(*) filter (novel) as novel_folds, cast(coalesce(sum(clusters), 0) as bigint) as clusters from s",
        "class_cosines": w(o._VECTORS, "p as (select a.label as l, b.label as m, list_inner_product(a.e, b.e) / (a.n * b.n) as s from vec a join vec b on a.id <> b.id)", "k as (select label, count(*) as n from vec group by 1)") + "select label, k.n as n, round(avg(s) filter (l = m), 8) as intra_cos, round(avg(s) filter (l <> m), 8) as inter_cos from k join p on l = label where k.n > 1 group by all",
        "silhouette": w(o._VECTORS, "p as (select a.id, 1 - avg(list_inner_product(a.e, b.e) / (a.n * b.n)) filter (a.label = b.label) as x, 1 - avg(list_inner_product(a.e, b.e) / (a.n * b.n)) filter (a.label <> b.label) as y from vec a join vec b on a.id <> b.id group by 1)") + "select count(*) as n, round(coalesce(avg((y - x) / greatest(x, y)), 0), 8) as silhouette from p where x is not null and y is not null",
        "baseline_three_way": w(*evaluated, base, "c as (select count(*) as n, count(*) filter (predicted = truth and baseline = truth) as \"both\", count(*) filter (predicted = truth and baseline <> truth) as only_first, count(*) filter (predicted <> truth and baseline = truth) as only_second, count(*) filter (predicted <> truth and baseline <> truth) as neither, count(*) filter (baseline = 'unknown') as baseline_dark, count(*) filter (predicted = 'unknown') as dark, count(*) filter (predicted not in ('', 'unknown')) as p, count(*) filter (baseline not in ('', 'unknown')) as b, count(*) filter (predicted = truth and predicted not in ('', 'unknown')) as pc, count(*) filter (baseline = truth and baseline not in ('', 'unknown')) as bc, count(*) filter (predicted not in ('', 'unknown') and truth not in ('', 'unknown')) as ptp, count(*) filter (baseline not in ('', 'unknown') and truth not in ('', 'unknown')) as btp, count(*) filter (truth not in ('', 'unknown')) as t from based)",
            "f as (select *, round(case when ptp = 0 then 0 else 2.0::double * ptp / (p + t) end, 9) as pf, round(case when btp = 0 then 0 else 2.0::double * btp / (b + t) end, 9) as bf from c)")
        + "select n, \"both\", only_first, only_second, neither, baseline_dark, dark, baseline_dark - dark as reduction, round(case when baseline_dark > 0 then (baseline_dark - dark)::double / baseline_dark else 0 end, 9) as reduction_rate, round(p::double / n - b::double / n, 9) as rate_gain, round(case when p > 0 then pc::double / p else 0 end - case when b > 0 then bc::double / b else 0 end, 9) as accuracy_gain, round(pf - bf, 9) as f1_gain from f",
        "dark_reduction": w(*evaluated, base, "c as (select count(*) as n, count(*) filter (baseline = 'unknown') as baseline_dark, count(*) filter (predicted = 'unknown') as dark from based)") + "select n, baseline_dark, round(baseline_dark::double / n, 9) as baseline_rate, dark, round(dark::double / n, 9) as rate, baseline_dark - dark as reduction, round(case when baseline_dark > 0 then (baseline_dark - dark)::double / baseline_dark else 0 end, 9) as reduction_rate from c",
        "family_scorecard": w(*evaluated) + "select coalesce(family, '-') as family, count(*) as n, count(*) filter (predicted not in ('', 'unknown')) as annotated, count(*) filter (predicted = truth) as correct, round(count(*) filter (predicted = truth)::double / count(*), 9) as accuracy from evaluated group by 1",
        "filtered_dataset": w(*evaluated) + "select truth, count(*) as n from evaluated where primary_identity <= 0.5 and truth in ('structural', 'replication', 'unknown') group by 1",
        "identity_bins": w(o._HITS, "h as (select *, case when fident < 0.2 then 'twilight' when fident < 0.3 then 'remote' when fident < 0.5 then 'moderate' else 'easy' end as bin from hits where fident is not null)", "b as (select * from (select *, row_number() over (partition by query order by evalue, target, source_db, fident) as o from h) where o = 1)", "k as (select bin, count(*) as n, round(avg(fident), 9) as i, round(avg(evalue), 9) as e from b group by 1)") + "select h.bin, coalesce(any_value(n), 0) as best_hits, count(*) as hits, coalesce(any_value(i), 0.0::double) as mean_identity, coalesce(any_value(e), 0.0::double) as mean_evalue from h left join k using (bin) group by h.bin",
        "matched_ids": w(o._GOLD, f"q as (select distinct case {_h('protein_id', 'q', 4)} when 0 then protein_id when 1 then protein_id || '|virus' when 2 then protein_id || '.1' else left(protein_id, length(protein_id) - 1) end as query from gold)", "a as (select query, case when query = protein_id then 0 when split_part(query, '|', 1) = protein_id then 1 else 2 end as o, protein_id as key from q join gold on query = protein_id or split_part(query, '|', 1) = protein_id or starts_with(query, protein_id) or starts_with(protein_id, query))") + "select query, arg_min(key, struct_pack(o := o, k := key)) as key from a group by 1",
        "reliability_bins": w(*told, o._VALIDATED) + "select case when reliability >= 0.8 then 'high (>=0.8)' when reliability >= 0.5 then 'medium (0.5-0.8)' when reliability >= 0.3 then 'low (0.3-0.5)' else 'very_low (<0.3)' end as bin, count(*) as n from validated group by 1",
        "contained_features": w(o._HITS, "i as (select distinct source_db, query as contig, qstart as s, qend as e from hits where qstart is not null and qend is not null)") + "select p.contig || ':' || p.s || ':' || p.e as part_id, arg_min(w.s || ':' || w.e, struct_pack(o := w.s * 100000 + w.e, k := w.s || ':' || w.e)) as whole_id from i p join i w on p.contig = w.contig and w.s <= p.s and w.e >= p.e where p.source_db = 'viro3d' and w.source_db = 'bfvd' group by 1",
        "spread_sample": proteins + "select id, n from (select id, row_number() over (order by id) - 1 as n from p where length(s) between 80 and 150) where n % 3 = 0",
        "called_genes": proteins + "select id as contig, cast(length(s) * 3 + 3 as integer) as \"end\", md5(s) as digest from p where s like 'M%' and length(s) >= 40",
    }

