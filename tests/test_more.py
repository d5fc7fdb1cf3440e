import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from capsidora import session
from capsidora.__main__ import main
from capsidora.functions import providers, sequences, tools
from capsidora.operators import benchmark, metagenome, report, transfer
from capsidora.sources import databases, files, genomes, results, sinks

HIT = "{}\t{}\t0.9\t9\t0\t0\t1\t9\t1\t9\t1e-50\t90\t9\t9\t1.0\t1.0"


def write(folder, name, text):
    p = folder / name
    p.write_text(text)
    return str(p)


def test_shared_folder(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "is_local", lambda s: False)
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError, match="share"):
            session.shared_dir(spark)
    monkeypatch.undo()
    monkeypatch.setattr(session, "shared_dir", lambda s: str(tmp_path))
    df = session.settle(spark.range(3), "x")
    path = session._settled[-1][1]
    assert df.count() == 3 and session.exists(spark, path)
    held = session._settled[:-1]
    session._settled[:] = session._settled[-1:]
    session.release(spark)
    assert not session.exists(spark, path) and not session._settled
    session._settled[:] = held


def test_genetic_codes(spark):
    text = "ATGTGATAGCTGATATAA"
    told = spark.range(1).select(*[sequences.translate(F.lit(text), genomes.code(t)).alias(f"c{t}") for t in (1, 2, 4, 6, 12)]).first()
    assert list(told) == ["M", "MW", "MW", "M", "M"]
    assert spark.range(1).select(sequences.translate(F.lit("ATGNNNCTGAT"), genomes.code(12))).first()[0] == "MXS"
    with pytest.raises(ValueError, match="genetic code"):
        genomes.code(99)


def test_inputs(spark, tmp_path):
    nt, aa = write(tmp_path, "a.fa", ">c\nATGGCCAAATAACCGGT\n"), write(tmp_path, "b.fa", ">p\nMKVLEFW\n")
    assert genomes.is_nucleotide_fasta(spark, nt) and not genomes.is_nucleotide_fasta(spark, aa) and not genomes.is_nucleotide_fasta(spark, str(tmp_path / "none"))
    gff = write(tmp_path, "x.gff", "##gff-version 3\n# Model: transl_table=4\nc\tx\tmRNA\t1\t12\t.\t+\t.\tID=m1\nc\tx\tCDS\t1\t3\t.\t+\t0\tParent=m1\nc\tx\tCDS\t7\t12\t.\t+\t0\tParent=m1\n")
    features, _ = files.read_gff(spark, gff)
    assert genomes.table_of(features, files.read_gff_comments(spark, gff)) == 4 and genomes.table_of(features) == 1
    gene = genomes.spliced_genes(features).first()
    assert (gene.gene_id, gene.start, gene.end, gene.is_spliced) == ("m1", 1, 12, True)
    lines = [r.line for r in genomes.gene_lines(genomes.spliced_genes(features)).collect()]
    assert len(lines) == 3 and "exon2;Parent=m1" in lines[2]
    proteins, places = genomes.read_proteins(spark, gff, nt)
    assert proteins.first().sequence == "MK" and places.first().contig == "c"
    long = write(tmp_path, "g.fna", ">k\n" + "ATG" + "GCT" * 40 + "TAA\n")
    proteins, places = genomes.read_proteins(spark, long)
    assert "M" + "A" * 40 in [r.sequence for r in proteins.collect()] and places.count() == proteins.count()


def test_broken_hits(spark, tmp_path):
    path = write(tmp_path, "h.tsv", HIT.format("q", "t") + "\textra\nq\tt\t0.9\n\n" + HIT.format("q", "t2").replace("1e-50", "x") + "\n")
    assert [r.target for r in files.read_hits(spark, path).collect()] == ["t"] and files.broken_hits(spark, path).count() == 2


def test_lookup_and_ids(spark):
    table = spark.createDataFrame([(0, "A1"), (1, "X-B2.1"), (2, "B2-y"), (3, None)], "ord bigint, k string")
    keys = spark.createDataFrame([("A1",), ("B2",), ("zz",)], "key string")
    assert {r.key: r.ord for r in databases.looked_up(keys, "key", table, "k").collect()} == {"A1": 0, "B2": 1}
    hits = spark.createDataFrame([("P1",), ("sp|P2|N",), ("other",)], "query string")
    ids = spark.createDataFrame([("sp|P1|A", 0), ("sp|P1|B", 1), ("sp|P2|N", 2)], "id string, ord bigint")
    assert sorted(r.query for r in databases.restored_ids(hits, ids).collect()) == ["other", "sp|P1|B", "sp|P2|N"]


def test_json_files(spark, tmp_path):
    a = write(tmp_path, "a.json", json.dumps({"entries": [{"protein_id": "p", "true_category": "lysis"}]}))
    b = write(tmp_path, "b.json", json.dumps({"proteins": {"q": {"expected_category": "entry"}, "r": {"category": "lysis"}}}))
    assert sorted((r.protein_id, r.true_category) for p in (a, b) for r in databases.read_truth(spark, p).collect()) == [("p", "lysis"), ("q", "entry"), ("r", "lysis")]
    c = write(tmp_path, "c.json", json.dumps({"Q1": {"description": "spike"}}))
    assert databases.read_lookup_cache(spark, c).first().description == "spike"
    assert databases.read_lookup_cache(spark, write(tmp_path, "d.json", "{broken")).count() == 0 and databases.read_lookup_cache(spark, str(tmp_path / "none")).count() == 0
    g = write(tmp_path, "g.tsv", "protein_id\tsequence\ttrue_function\ttrue_category\tevidence_code\np\tMK\tx\tlysis\tEXP\nshort\tM\n")
    assert [r.protein_id for r in databases.read_gold_table(spark, g).collect()] == ["p"]


def test_search_database(spark, tmp_path):
    rows = spark.createDataFrame([("b", "MKV"), ("a", "DDDDD"), ("c", "")], "id string, sequence string")
    results.write_search_database(rows, str(tmp_path / "db"))
    assert (tmp_path / "db.index").read_text() == "0\t0\t7\n1\t7\t5\n2\t12\t2\n"
    assert {r.name: r.sequence for r in databases.read_search_database(spark, str(tmp_path / "db")).collect()} == {"a": "DDDDD", "b": "MKV", "c": ""}


def test_alignment(spark):
    assert providers.align("ACDEF", "ACEF")[1] == 1.0 and providers.align("", "A") == (0.0, 0.0)
    m = providers.substitutions()
    assert (m == m.T).all() and m[ord("W"), ord("W")] == 11 and m[ord("B"), ord("D")] == 4
    matches = spark.createDataFrame([("q", "t", "bfvd"), ("q", "gone", "bfvd"), ("far", "t", "bfvd")], "id string, target string, source_db string")
    refs = spark.createDataFrame([("t", "bfvd", "MKVLATWWHH")], "name string, source_db string, sequence string")
    got = providers.realigned(matches, spark.createDataFrame([("q", "MKVLATWWHH"), ("far", "GGGGGGGGGG")], "id string, sequence string"), refs)
    assert {(r.id, r.target): r.kept for r in got.collect()} == {("q", "t"): True, ("q", "gone"): True, ("far", "t"): False}


def test_networks(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 8))
    y = (x[:, 0] > 0).astype(int)
    net, f1 = providers.train(x, y, 2, (16,), 20)
    assert f1 > 0.9
    net.save(str(tmp_path / "n.npz"))
    again = providers.Network.load(str(tmp_path / "n.npz"))
    assert np.allclose(again.probabilities(x[:5]), net.probabilities(x[:5])) and providers.Network.load(str(tmp_path / "none.npz")) is None
    norm = providers.Network([(np.eye(8), np.zeros(8)), (np.eye(8)[:, :2], np.zeros(2))], [(np.ones(8), np.zeros(8))])
    assert norm.probabilities(x[:3]).shape == (3, 2)
    rows = spark.createDataFrame([(v.tolist(), "ab"[k]) for v, k in zip(x[:600], y[:600], strict=True)], "e array<double>, l string")
    fitted, _ = providers.fit(rows, "e", "l", ["a", "b"], hidden=(16,), epochs=40, batch=32)
    assert providers.classify(rows, "e", fitted, ["a", "b"]).where("category = l").count() > 500
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert providers.contrastive_loss(u[:50], y[:50]) > providers.contrastive_loss(np.eye(2)[y[:50]] + 0.0, y[:50])
    assert all(len(b) == 8 and (np.bincount(y[b]) == 4).all() for b in providers.balanced_batches(y, 4, 3))
    assert providers.confidences(np.zeros((2, 4)), 3) == pytest.approx([0.25] * 3) and providers.confidences(np.zeros((0, 4)), 2) == [1.0, 1.0]


def test_answers(spark):
    told = {"a": '```json\n{"category": "Lysis", "reason": "holin"}\n```', "b": '{"category": "poetry"}', "c": "no"}
    df = spark.createDataFrame([(k,) for k in told], "k string")
    got = {r.k: r.category for r in providers.answers(df, F.col("k"), lambda: lambda texts: [told[t] for t in texts], ["lysis", "entry"]).collect()}
    assert got == {"a": "lysis", "b": None, "c": None}
    terms = spark.createDataFrame([("q", "GO:1"), ("q", "GO:2")], "query string, go_id string")
    assert [tuple(r) for r in providers.rescued_terms(terms, lambda: lambda t: ['["GO:2", "GO:9"]' for _ in t]).collect()] == [("q", "GO:2")]


def test_tools(spark, tmp_path):
    echo = tools.Tool("echo")
    assert echo.available and echo.run("x").out == "x\n" and not tools.Tool("no-such-program").available and tools.Tool("no-such-program").run().code == 127
    assert tools.Tool("sleep").run(5, timeout=0.2).code == 124
    with pytest.raises(RuntimeError):
        tools.Tool("false").run(check=True)
    assert tools.search(spark, "q", "d", str(tmp_path / "s"), "bfvd", tools.Tool("no-such-program")).count() == 0
    assert tools.structural_alignment("q", "p", tools.Tool("no-such-program")) == {} and tools.spliced_alignment(spark, "c", "p", str(tmp_path), tools.Tool("no-such-program")) is None


def test_overlay(spark):
    r = spark.createDataFrame([("a", "unknown", "keywords"), ("b", "lysis", "keywords")], "query_id string, functional_category string, classification_source string")
    later = {"neighbourhood": spark.createDataFrame([("a", "entry"), ("b", "entry")], "query_id string, category string"), "classifier": spark.createDataFrame([("a", "unknown")], "query_id string, category string")}
    assert {x.query_id: (x.functional_category, x.classification_source) for x in transfer.overlaid(r, later=later).collect()} == {"a": ("entry", "neighbourhood"), "b": ("lysis", "keywords")}
    with pytest.raises(ValueError, match="steps"):
        transfer.overlaid(r, later={"guess": r})


def test_medians_and_holdout(spark):
    rows = spark.createDataFrame([("a", i) for i in (5, 1, 9, 3)] + [("b", 2), ("b", None)], "k string, v int")
    assert {r.k: r["median"] for r in report.upper_median(rows, "v", ["k"]).collect()} == {"a": 5, "b": 2}
    assert report.upper_median(rows.where("k = 'z'"), "v", []).first()["median"] is None
    many = spark.range(5000).selectExpr("cast(id as string) as id", "if(id < 4990, 'big', 'small') as s")
    held = benchmark.holdout(many, "id", "s").where("held_out").groupBy("s").count()
    assert {r.s: r["count"] for r in held.collect()} == {"big": 998, "small": 2}


def test_context(spark):
    dark = spark.createDataFrame([("p", "phage capsid protein")], "query_id string, description string")
    none = spark.createDataFrame([], "family string, run string, identity double")
    r = metagenome.context(dark, none).first()
    assert (r.runs, r.conserved, r.conservation) == (0, False, 0.0)


def test_command_line(spark, tmp_path):
    fasta = write(tmp_path, "a.faa", ">g_1\nMKVLL\n>g_2\nMKV\n")
    hits = write(tmp_path, "h.tsv", HIT.format("g_1", "T1") + "\n")
    bfvd = write(tmp_path, "m.tsv", "T1\ts\t90.0\t0.9\t0\tx\n")
    rich = write(tmp_path, "e.tsv", "uniprot_accession\tprotein_name\tgene_name\nT1\tmajor capsid protein\tcp\n")
    main(["run", "--input", fasta, "--hits", f"bfvd={hits}", "--bfvd", bfvd, "--enriched", rich, "--output", str(tmp_path / "o"), "--export", "all"])
    got = {r.query_id: r for r in results.load_results(spark, str(tmp_path / "o" / "results.tsv")).collect()}
    assert (got["g_1"].functional_category, got["g_1"].gene, got["g_1"].structure_quality_source, got["g_2"].description) == ("structural", "cp", "bfvd_af2", "hypothetical protein")
    assert got["g_1"].structure_quality_score < 1 and (tmp_path / "o" / "export" / "anvio").exists()
    main(["compare", "--hits", f"bfvd={hits}", "--output", str(tmp_path / "c")])
    main(["genes", "--input", write(tmp_path, "g.fna", ">k\n" + "ATG" + "GCT" * 40 + "TAA\n"), "--output", str(tmp_path / "g")])
    assert "k_1" in sinks.json.dumps([r.value for r in spark.read.text(str(tmp_path / "g" / "genes.gff3")).collect()])
    main(["installed", "--folder", str(tmp_path)])
