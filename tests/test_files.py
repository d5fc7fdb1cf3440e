import gzip
import json

import numpy as np

from capsidora.plans import pipeline
from capsidora.sources import files, genomes, sinks
from capsidora.streaming import ingest


def write(folder, name, text):
    p = folder / name
    p.write_text(text)
    return str(p)


def test_fasta(spark, tmp_path):
    path = write(tmp_path, "a.faa", ">p1 first\nMKV\r\nL*\n>p2\nmk?\n>p1 again\nAAA\n>empty\n\n")
    got = {r.id: r for r in files.read_fasta(spark, path).collect()}
    assert {k: v.sequence for k, v in got.items()} == {"p1": "MKVL", "p2": "MKX", "p1_dup1": "AAA"}
    assert got["p2"].warnings == ["foreign_signs"] and got["p1"].description == "p1 first"
    assert files.read_fasta(spark, path, min_length=4).count() == 1
    sinks.write_fasta(files.read_fasta(spark, path).select("id", "sequence"), str(tmp_path / "out"), width=2)
    again = {r.id: r.sequence for r in files.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert again == {k: v.sequence for k, v in got.items()}


def test_packed_fasta(spark, tmp_path):
    folder = tmp_path / "several"
    folder.mkdir()
    (folder / "a.faa").write_bytes(gzip.compress(b">p1\nMK\n>p2\nMV\n"))
    (folder / "b.faa.gz").write_bytes(gzip.compress(b">p3\nML\n"))
    write(folder, "c.faa", ">p4\nMA\n")
    assert {r.id: r.sequence for r in files.read_fasta(spark, str(folder)).collect()} == {"p1": "MK", "p2": "MV", "p3": "ML", "p4": "MA"}


def test_gff(spark, tmp_path):
    lines = ["##gff-version 3", "c\tx\tCDS\t1\t3\t.\t+\t0\tID=g1", "c\tx\tCDS\t7\t9\t.\t+\t0\tID=g1", "c\tx\tCDS\t1\t9\t.\t-\t0\tID=g2;Note=a%2Cb", "broken", "##FASTA", ">c", "ATGCCC", "GCCTAA"]
    p = tmp_path / "x.gff3"
    p.write_bytes(gzip.compress("\n".join(lines).encode()))
    features, contigs = files.read_gff(spark, str(p))
    got = {r.id: (r.start, r.end, r.sequence) for r in files.coding_proteins(features, contigs).collect()}
    assert got == {"g1": (1, 9, "MA"), "g2": (1, 9, "GGH")}
    assert genomes.table_of(features, files.read_gff_comments(spark, str(p))) == 1 and files.format_of("a/b.GFF3.gz") == "gff"


def test_genbank(spark, tmp_path):
    text = """LOCUS       C1 30 bp DNA
FEATURES             Location/Qualifiers
     CDS             1..30
                     /protein_id="poly"
                     /translation="MAMA
                     MAMAM"
     mat_peptide     1..6
                     /locus_tag="m1"
     mat_peptide     join(7..9,13..15)
                     /locus_tag="m2"
     CDS             complement(2..7)
                     /locus_tag="one"
                     /translation="MK"
ORIGIN
        1 atggccatgg ccatggccat ggccatggcc
//
"""
    f = files.read_genbank(spark, write(tmp_path, "a.gb", text))
    got = {r.id: r for r in files.genbank_proteins(f).collect()}
    assert set(got) == {"m1", "m2", "one"}
    assert (got["m1"].sequence, got["m2"].sequence, got["m2"].parent, got["one"].strand) == ("MA", "MM", "poly", -1)


def test_tables(spark, tmp_path):
    obo = write(tmp_path, "go.obo", 'format\n\n[Term]\nid: GO:0000001\nname: Capsid Assembly\nsynonym: "shell" EXACT []\n\n[Term]\nid: GO:0000002\nname: old\nis_obsolete: true\n')
    terms = files.read_terms(spark, obo)
    assert {r.name: r.go_id for r in terms.collect()} == {"capsid assembly": "GO:0000001", "shell": "GO:0000001"}
    rows = spark.createDataFrame([("a", "Shell; other"), ("b", "x GO:0000009"), ("c", None)], "k string, t string")
    assert {r.k: r.go_ids for r in files.resolved_terms(rows, "k", "t", terms).collect()} == {"a": "GO:0000001", "b": "GO:0000009", "c": ""}
    np.savez(tmp_path / "e.npz", protein_ids=np.array(["p"]), source_dbs=np.array(["bfvd"]), embeddings=np.ones((1, 4), np.float16))
    assert files.read_embeddings(spark, str(tmp_path / "e.npz")).first().embedding == [1.0] * 4
    g = write(tmp_path, "g.json", json.dumps({"entries": [{"protein_id": "p", "true_category": "lysis"}]}))
    assert files.read_gold_standard(spark, g).first().true_category == "lysis"
    u = spark.createDataFrame([(json.dumps({"primaryAccession": "Q1", "proteinDescription": {"recommendedName": {"fullName": {"value": "Spike"}}}, "uniProtKBCrossReferences": [{"database": "Pfam", "id": "PF1"}, {"database": "GO", "id": "GO:1"}]}),), ("broken",)], "entry string")
    r = files.uniprot_fields(u).collect()
    assert len(r) == 1 and (r[0].description, r[0].pfam, r[0].go_terms) == ("Spike", "PF1", "GO:1")
    t = spark.createDataFrame([(1,), (2,)], "k int")
    assert [sinks.append_missing(t, str(tmp_path / "t"), "k") for _ in range(2)] == [2, 0]


HIT = "{}\tt1\t0.9\t9\t0\t0\t1\t9\t1\t9\t1e-50\t90\t9\t9\t1.0\t1.0"


def test_run(spark, tmp_path):
    fasta = write(tmp_path, "a.faa", ">g_1\nMKVLL\n>g_2\nMKV\n>g_3\nMKVLA\n")
    hits = files.read_hits(spark, write(tmp_path, "h.tsv", HIT.format("g_1") + "\n" + HIT.format("g_3") + "\n"), "bfvd")
    notes = spark.createDataFrame([("t1", "bfvd", "major capsid protein")], "target string, source_db string, description string")
    places = spark.createDataFrame([(f"g_{i}", "g", i, i, 1) for i in (1, 2, 3)], "id string, contig string, start int, end int, strand int")
    out = pipeline.annotate(files.read_fasta(spark, fasta), hits, notes, places)
    got = {r.query_id: r for r in out.collect()}
    assert (got["g_1"].functional_category, got["g_2"].functional_category, got["g_2"].classification_source) == ("structural", "structural", "neighbourhood")
    pipeline.write_results(out, str(tmp_path / "o"))
    assert json.loads((tmp_path / "o" / "summary.json").read_text())["dark_matter"][0]["total"] == 3
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "o" / "results.tsv")).count() == 3


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a.faa", ">x\nMK*\n>y\nAA\n")
    s = ingest.protein_stream(spark, str(tmp_path / "in"))
    ingest.run_available(s, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert {r.id: r.sequence for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"x": "MK", "y": "AA"}
