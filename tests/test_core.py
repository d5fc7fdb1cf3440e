import math

import pytest
from pyspark.sql import functions as F

from capsidora.functions import providers, rules, scoring, sequences, text
from capsidora.operators import benchmark, consensus, evidence, export, genome, report, similarity, validation


def one(spark, **cols):
    return list(spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first())


def test_keywords(spark):
    cases = {
        "major capsid protein": "structural", "RNA-dependent RNA polymerase": "replication", "3C-like proteinase": "protease", "host nuclease inhibitor": "host_interaction",
        "polymerase inhibitor": "host_interaction", "portal protein": "structural", "endolysin": "lysis", "movement protein": "movement", "hypothetical protein": "unknown", "": "unknown",
    }
    rows = spark.createDataFrame(list(cases.items()), "d string, want string").select("want", rules.by_keywords(F.col("d")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)
    assert one(spark, c=rules.by_keywords(F.lit(None).cast("string"), F.lit("holin")))[0] == "lysis"


def test_evidence_ladder(spark):
    none = F.lit(None).cast("string")
    c, s = rules.by_evidence(F.lit("capsid"), none, F.lit("Peptidase C3"), none, F.lit("dna replication"), none)
    assert one(spark, c=c, s=s) == ["protease", "pfam:Peptidase C3"]
    c, s = rules.by_evidence(F.lit("capsid"), none, none, none, F.lit("dna replication"), none)
    assert one(spark, c=c, s=s) == ["replication", "go_bp:dna replication"]


def test_scores(spark):
    q = scoring.hit_quality(F.lit(1e-50), F.lit(1.0), F.lit(1.0))
    z = scoring.hit_quality(F.lit(0.0), F.lit(0.5), F.lit(0.5))
    assert one(spark, q=q, z=z) == pytest.approx([1.0, 0.75])
    assert one(spark, a=scoring.hit_level(F.lit(1e-60), F.lit(0.9), F.lit(0.9)), b=scoring.hit_level(F.lit(1e-60), F.lit(0.9), F.lit(0.7)), c=scoring.hit_level(F.lit(1.0), F.lit(0.1), F.lit(0.1))) == ["high", "medium", "very_low"]
    none = F.lit(None).cast("double")
    s, src = scoring.structure_quality(none, none, F.lit(90.0), F.lit(0.9), F.lit(1000.0), none, none)
    want = min(1.0, (0.7 * (0.9 + 0.1 * 20 / 30) + 0.3 * (0.85 + 0.15 * 0.8)) * 1.05)
    assert one(spark, s=s, src=src) == [pytest.approx(want), "colabfold"]
    assert one(spark, s=scoring.structure_quality(none, none, none, none, none, none, none)[0])[0] == 1.0


def test_agreement(spark):
    a = lambda x, y: one(spark, a=text.agreement(F.lit(x), F.lit(y)))[0]
    assert [a("major capsid protein", "major capsid"), a("capsid alpha beta", "capsid gamma delta"), a("capsid", "helicase"), a("", "capsid"), a("UniProt:X", "capsid")] == ["agree", "partial", "disagree", "partial", "partial"]
    sev = lambda x, y, s: one(spark, a=text.conflict_severity(F.lit(x), F.lit(y), F.lit(s)))[0]
    assert [sev("lysis", "lysis", 0.6), sev("lysis", "lysis", 0.1), sev("unknown", "lysis", 0.1), sev("structural", "packaging", 0.0), sev("lysis", "protease", 0.0)] == ["negligible", "minor", "major", "major", "critical"]


def test_sequences(spark):
    assert one(spark, s=sequences.clean_protein(F.lit("mk*l?q**")), w=F.array_join(sequences.protein_warnings(F.lit("mk*l?q**")), ",")) == ["MKXLXQ", "internal_stop,foreign_signs"]
    assert one(spark, t=sequences.translate(F.lit("ATGGCCTAA")), r=sequences.reverse_complement(F.lit("ATGC")), x=sequences.translate(F.lit("ATGNNNGG")), e=sequences.translate(F.lit(""))) == ["MA", "GCAT", "MX", ""]
    scores = F.array(*map(F.lit, [0.9] * 5 + [0.1] * 2 + [0.8] * 4 + [0.2] + [0.7] * 6))
    assert one(spark, r=sequences.regions_text(sequences.regions(scores)))[0] == "0-5;12-18"
    assert one(spark, m=sequences.mask(F.lit("ABC"), F.array(F.lit(0.9), F.lit(0.1), F.lit(0.7))), u=sequences.mask(F.lit("ABC"), F.lit(None).cast("array<double>"))) == ["AXC", "ABC"]
    assert one(spark, i=sequences.identity(F.lit("ABCD"), F.lit("ABXDQ")), z=sequences.identity(F.lit(""), F.lit("A"))) == [0.75, 0.0]


def test_names(spark):
    assert one(spark, a=text.contig_of(F.lit("c_1|provirus_5_9_3")), b=text.contig_of(F.lit("NV1_22")), c=text.contig_of(F.lit("plain")), d=text.model_name(F.lit("EF-Q1_unrelaxed"))) == ["c_1|provirus_5_9", "NV1", "plain", "Q1"]
    m = one(spark, m=text.gff_attributes(F.lit("ID=a; Note=x%3By+z;flag;ID=b;url=k=v")))[0]
    assert m == {"Note": "x;y+z", "ID": "b", "url": "k=v"}
    df = spark.createDataFrame([("p", 1), ("p", 2), ("p_dup1", 3), ("p", 4)], "id string, o int")
    assert [r.name for r in genome.distinct_names(df, "id", ["o"]).orderBy("o").collect()] == ["p", "p_dup2", "p_dup1", "p_dup3"]


def test_consensus(spark):
    hits = spark.createDataFrame([("q", "t1", "bfvd", 0.9, 1e-50, 0.9), ("q", "t2", "viro3d", 0.8, 1e-40, 0.9), ("q", "t3", "viro3d", 0.1, 1.0, 0.1)], "query string, target string, source_db string, fident double, evalue double, qcov double")
    notes = spark.createDataFrame([("t1", "bfvd", "major capsid protein"), ("t2", "viro3d", "major capsid")], "target string, source_db string, description string")
    queries = spark.createDataFrame([("q", 10), ("r", 20)], "query string, query_length int")
    got = {r.query: r for r in consensus.consensus(hits, notes, queries).collect()}
    assert (got["q"].primary_source, got["q"].agreement, got["q"].functional_category, got["q"].confidence_level, got["q"].novelty) == ("viro3d", "agree", "structural", "high", "close_homolog")
    assert (got["r"].confidence_level, got["r"].consensus_score, got["r"].description) == ("none", 0.0, "hypothetical protein")


def test_go_transfer(spark):
    matches = spark.createDataFrame([("q", "a", 0.85), ("q", "b", 0.70), ("q", "c", 0.90)], "query string, accession string, similarity double")
    donors = spark.createDataFrame([("a", True, "GO:1", "viral capsid assembly", "BP", "IDA"), ("b", True, "GO:1", "viral capsid assembly", "BP", "EXP"), ("c", False, "GO:2", "x", "MF", "IDA")], "accession string, viral boolean, go_id string, go_term string, aspect string, evidence_code string")
    t = evidence.transferred_terms(matches, donors)
    r = t.first()
    assert t.count() == 1 and r.reliability == pytest.approx(0.955) and (r.donor, r.donors) == ("a", 2)
    c = spark.createDataFrame([("q", "structural", 0.7, "medium"), ("z", "lysis", 0.7, "medium")], "query string, functional_category string, consensus_score double, confidence_level string")
    got = {x.query: x for x in evidence.dual_validated(c, evidence.go_category(t)).collect()}
    assert (got["q"].dual_validation, got["q"].final_level, got["z"].dual_validation) == ("dual_agree", "high", "foldseek_only")


def test_intervals(spark):
    kind = "contig string, strand int, start int, end int"
    a = spark.createDataFrame([("c", 1, 1, 1000)], kind)
    b = spark.createDataFrame([("c", 1, 400, 700), ("c", -1, 400, 700), ("c", 1, 950, 2000), ("d", 1, 1, 9)], kind)
    got = sorted((r.contig, r.strand, r.start) for r in genome.uncovered(b, a, ["contig", "strand"]).collect())
    assert got == [("c", -1, 400), ("c", 1, 950), ("d", 1, 1)]


def test_neighbours(spark):
    rows = [(f"g{i}", "c", i, "lysis" if i != 3 else "unknown", "high") for i in range(6)] + [("alone", "d", 1, "unknown", "high")]
    got = genome.neighbourhood_votes(spark.createDataFrame(rows, "query string, contig string, start int, functional_category string, confidence_level string")).collect()
    assert [tuple(r) for r in got] == [("g3", "lysis", 1.0)]


def test_benchmark(spark):
    rows = spark.createDataFrame([("a", "lysis", "lysis", 0.95), ("b", "lysis", "unknown", 0.15), ("c", "unknown", "lysis", 0.35), ("d", "unknown", "unknown", 1.0)], "protein_id string, truth string, predicted string, score double")
    m = benchmark.annotated_matrix(rows).first()
    assert (m.tp, m.fp, m.fn, m.tn, m.correct, m.sensitivity, m.mcc) == (1, 1, 1, 1, 1, 0.5, 0.0)
    bins = benchmark.calibration_bins(rows).orderBy("bin").collect()
    assert [b.n for b in bins] == [0, 1, 0, 1, 0, 0, 0, 0, 0, 2] and bins[4].confidence == 0.45
    held = benchmark.holdout(rows, "protein_id", "truth").where("held_out").count()
    assert held == 2


def test_validation(spark):
    rows = spark.createDataFrame([("q", "a", "capsid shell", "structural", 1e-9), ("q", "b", "capsid shell", "structural", 1e-5), ("q", "c", "helicase", "replication", 1e-3), ("s", "a", "capsid", "structural", 1.0)], "query string, source_db string, description string, category string, evalue double")
    got = {r.query: r for r in validation.validated(rows).collect()}
    assert (got["q"].status, got["q"].databases, got["q"].conflicts) == ("partial", 3, 2) and (got["s"].status, got["s"].reliability) == ("single_source", 0.5)
    assert validation.conflicts_from(validation.database_pairs(rows), "critical").count() == 2


def test_similarity_and_median(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "id string, embedding array<double>")
    got = similarity.top_similar(v, v, 1, same=True).orderBy("query").collect()
    assert [(r.query, r.target) for r in got] == [("a", "b"), ("b", "a"), ("c", "b")]
    df = spark.createDataFrame([(1,), (2,), (2,), (9,)], "x int")
    assert report.upper_median(df, "x", []).first().median == 2


def test_export(spark):
    r = spark.createDataFrame([("c_1", "capsid; x=1", "t", 1e-9, "structural", "high", 10, "c", 1, 30, -1), ("c_2", None, None, None, "unknown", "none", 5, None, None, None, None)], "query_id string, description string, primary_target string, primary_evalue double, functional_category string, confidence_level string, query_length int, contig string, start int, end int, strand int")
    out = export.export(r)
    assert [x.source for x in out["anvio"].orderBy("gene_callers_id", "source").collect()] == ["capsidora_category", "capsidora_structural", "capsidora_category"]
    assert out["genome_lengths"].first().length == 15
    assert [x.line for x in out["gff3"].collect()] == ["c\tcapsidora\tCDS\t1\t30\t1.0E-9\t-\t.\tID=c_1;Name=capsid%3B x%3D1;category=structural;confidence=high"]
    with pytest.raises(ValueError):
        export.export(r, ["nothing"])


def test_providers(spark):
    assert providers.align("ACDEF", "ACEF")[1] == 1.0 and providers.align("AAAA", "AATA")[1] == 0.75
    df = spark.createDataFrame([("MKV",), (None,)], "s string")
    assert [r.p for r in providers.predict(df, "s", providers.flat_structure, "p", "string").collect()] == ["DDD", ""]
    gene = "ATG" + "GCA" * 40 + "TAA"
    g = providers.reading_frames(spark.createDataFrame([("c", "CC" + gene + "C")], "contig string, sequence string")).where("strand = 1").first()
    assert (g.start, g.end) == (3, 2 + len(gene))
    assert math.isclose(sum(x * x for x in providers.composition()(["ACC"])[0]), 1)
