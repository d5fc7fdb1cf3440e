"""Command line: predict structures, search, compare hits, annotate proteins, call genes, align, export, tell what is installed."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from capsidora.functions import providers, tools
from capsidora.operators.export import FORMATS, export
from capsidora.plans import pipeline
from capsidora.sources import databases, files, genomes, results, sinks


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="capsidora")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("compare", "run"):
        p = sub.add_parser(name)
        p.add_argument("--hits", action="append", required=True, metavar="DB=PATH")
        p.add_argument("--evalue", type=float, default=tools.EVALUE)
        p.add_argument("--most", type=int, default=tools.MOST, help="hits of a query and database")
        p.add_argument("--output", required=True)
        if name == "run":
            p.add_argument("--input", required=True, help="FASTA, GenBank or GFF3, packed or not")
            p.add_argument("--beside", help="for GFF3: FASTA of contigs or of proteins")
            p.add_argument("--min-length", type=int, default=1)
            p.add_argument("--max-length", type=int)
            p.add_argument("--code", type=int, help="genetic code; by default what the file tells")
            p.add_argument("--annotations", help="Parquet: target, source_db, description, and further evidence")
            p.add_argument("--bfvd", help="metadata table of the bfvd database")
            p.add_argument("--enriched", help="enriched metadata of the bfvd database")
            p.add_argument("--viro3d", help="protein list of the viro3d database")
            p.add_argument("--expansions", help="folder of its annotation expansions")
            p.add_argument("--triage", help="Parquet: id, target, source_db, similarity, matched")
            p.add_argument("--export", action="append", choices=[*FORMATS, "all"])
    p = sub.add_parser("search")
    p.add_argument("--query", required=True)
    p.add_argument("--database", action="append", required=True, metavar="DB=PATH")
    p.add_argument("--threads", type=int, default=4)
    p.add_argument("--output", required=True)
    p = sub.add_parser("predict")
    p.add_argument("--input", required=True)
    p.add_argument("--model", required=True, help="ONNX file")
    p.add_argument("--tokens", required=True, help="JSON: tokens, states, start, end")
    p.add_argument("--output", required=True)
    p = sub.add_parser("genes")
    p.add_argument("--input", required=True)
    p.add_argument("--code", type=int, default=11)
    p.add_argument("--output", required=True)
    p = sub.add_parser("align")
    p.add_argument("--query", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--refine", type=int, default=0)
    p = sub.add_parser("export")
    p.add_argument("--results", required=True, help="result table with header")
    p.add_argument("--output", required=True)
    p.add_argument("--format", action="append", choices=[*FORMATS, "all"])
    p = sub.add_parser("installed")
    p.add_argument("--folder", required=True)
    return parser


def _hits(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    return {db: tools.limited(files.read_hits(spark, path), args.evalue, args.most) for db, path in (h.split("=", 1) for h in args.hits)}


def _annotations(spark: SparkSession, args: argparse.Namespace, parts: dict[str, DataFrame]) -> DataFrame:
    """All annotations that the options name; a database without any leaves its targets undescribed."""
    out = spark.read.parquet(args.annotations) if args.annotations else None
    found = []
    if args.bfvd and "bfvd" in parts:
        enriched = databases.read_bfvd_enriched(spark, args.enriched) if args.enriched else None
        found.append(databases.bfvd_annotations(parts["bfvd"], databases.read_bfvd(spark, args.bfvd), enriched))
    if args.viro3d and "viro3d" in parts:
        expansions = databases.best_expansions(databases.read_expansions(spark, args.expansions)) if args.expansions else None
        found.append(databases.viro3d_annotations(parts["viro3d"], databases.read_viro3d(spark, args.viro3d), expansions))
    for df in found:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "target string, source_db string, description string")


def _export(rows: DataFrame, formats: list[str] | None, folder: str) -> None:
    for name, df in export(rows, formats).items():
        (sinks.write_lines if name == "gff3" else sinks.write_table)(df, f"{folder}/{name}")


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    parts = _hits(spark, args)
    hits = None
    for db, df in parts.items():
        df = df.selectExpr("*", f"'{db}' as source_db")
        hits = df if hits is None else hits.unionByName(df)
    proteins, positions = genomes.read_proteins(spark, args.input, args.beside, args.min_length, args.max_length, args.code)
    hits = databases.restored_ids(hits, proteins.selectExpr("id", "monotonically_increasing_id() as ord"))
    annotations = _annotations(spark, args, parts)
    triage = None
    if args.triage:
        from capsidora.operators import transfer

        triage = transfer.triaged(spark.read.parquet(args.triage), annotations).drop("target", "source_db", "similarity")
    pipeline.write_results(pipeline.annotate(proteins, hits, annotations, positions, triage=triage), args.output)
    if args.export:
        _export(results.load_results(spark, f"{args.output}/results.tsv"), args.export, f"{args.output}/export")


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "run":
        _run(spark, args)
    elif args.command == "compare":
        pipeline.compare(_hits(spark, args), args.output)
    elif args.command == "search":
        found = tools.search_all(spark, args.query, dict(d.split("=", 1) for d in args.database), args.output, threads=args.threads)
        sinks.write_table(found, f"{args.output}/hits.tsv")
    elif args.command == "predict":
        told = json.loads(spark.read.text(args.tokens, wholetext=True).first()[0])
        load = providers.onnx_structure(args.model, told["tokens"], {int(k): v for k, v in told["states"].items()}, told["start"], told["end"])
        proteins, _ = genomes.read_proteins(spark, args.input)
        sinks.write_fasta(providers.predict(proteins.select("id", "sequence"), "sequence", load, "states", "string").selectExpr("id", "states as sequence"), f"{args.output}/raw_3di.fasta", 0)
    elif args.command == "genes":
        genes = genomes.called_genes(files.read_contigs(spark, args.input), args.code)
        sinks.write_lines(genomes.gene_lines(genes), f"{args.output}/genes.gff3")
        sinks.write_fasta(genes.selectExpr("gene_id as id", "protein_sequence as sequence"), f"{args.output}/genes.faa")
    elif args.command == "align":
        print(results.alignment_summary(tools.structural_alignment(args.query, args.output, refine=args.refine), 0, 0))
    elif args.command == "export":
        _export(results.load_results(spark, args.results), args.format, args.output)
    else:
        print(json.dumps(databases.installed(spark, args.folder)))


if __name__ == "__main__":
    main()
