"""Readers of sequence, feature, hit, term and embedding files."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capsidora import schemas
from capsidora.functions import sequences
from capsidora.functions.text import gff_attributes
from capsidora.operators.genome import containing, distinct_names, merged_parts
from capsidora.session import first_bytes

SUFFIXES = {"genbank": (".gb", ".gbk", ".genbank", ".gbff"), "gff": (".gff", ".gff3"), "nucleotide": (".fna", ".ffn"), "fasta": (".fa", ".faa", ".fasta", ".fas")}


def format_of(path: str) -> str:
    """The format that a file's suffix names, without .gz; FASTA for any other."""
    bare = re.sub(r"\.gz$", "", path.lower())
    return next((f for f, ends in SUFFIXES.items() if bare.endswith(ends)), "fasta")


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, text of whole files, unpacked where their first bytes say gzip, whatever their suffix."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["text"] = [(gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c).decode("utf-8", "replace") for c in map(bytes, f.content)]
            yield f[["path", "text"]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "path string, text string")


def parse_fasta(records: DataFrame, record: str = "value", order: str = "ord") -> DataFrame:
    """ord, id, description, sequence of FASTA records (with or without their leading mark)."""
    text = F.regexp_replace(F.regexp_replace(record, "\r", ""), "^>", "")
    head = F.trim(F.substring_index(text, "\n", 1))
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(F.expr(f"substring({_sql(record)}, instr({_sql(record)}, '\n') + 1)"), r"\s", "")).otherwise("")
    return records.where(F.trim(F.col(record)) != "").select(F.col(order).alias("ord"), F.regexp_extract(head, r"^(\S+)", 1).alias("id"), head.alias("description"), body.alias("sequence"))


def _sql(column: str) -> str:
    return f"regexp_replace(regexp_replace(`{column}`, '\r', ''), '^>', '')"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """value, ord: the records of FASTA files, split by the reader, so that a large file is read in parallel.

    Files whose first two bytes are gzip's but whose names don't say so are unpacked whole; only those two bytes of each file are read beforehand.
    """
    names = [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    packed = [n for n in names if not n.endswith(".gz") and first_bytes(spark, n, 2) == b"\x1f\x8b"]
    plain = [n for n in names if n not in set(packed)]
    out = spark.read.option("lineSep", "\n>").text(plain) if plain else spark.createDataFrame([], "value string")
    if packed:
        whole = read_texts(spark, packed).select(F.explode(F.split("text", r"\n(?=>)")).alias("value"))
        out = out.unionByName(whole)
    return out.withColumn("ord", F.monotonically_increasing_id())


def read_fasta(spark: SparkSession, path: str, min_length: int = 1, max_length: int | None = None) -> DataFrame:
    """Protein records: ord, id (unique), description, sequence, warnings. Records are split by the reader, so one large file is read in parallel.

    Sequences are upper-cased, stops at the end dropped, foreign signs X; records that are then too short or too long, and empty ones, are left out.
    """
    raw = parse_fasta(read_records(spark, path))
    clean = raw.withColumn("warnings", sequences.protein_warnings(F.col("sequence"))).withColumn("sequence", sequences.clean_protein(F.col("sequence")))
    kept = clean.where(F.length("sequence") >= max(1, min_length))
    if max_length is not None:
        kept = kept.where(F.length("sequence") <= max_length)
    return distinct_names(kept, "id", ["ord"], "name").drop("id").withColumnRenamed("name", "id").select("ord", "id", "description", "sequence", "warnings")


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """contig, sequence of a nucleotide FASTA; the first record of a name holds."""
    raw = parse_fasta(read_records(spark, path))
    return raw.groupBy(F.col("id").alias("contig")).agg(F.upper(F.min_by("sequence", "ord")).alias("sequence"))


def read_gff(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Features and the sequences embedded behind ``##FASTA``.

    Features: path, ord, contig, source, type, start, end, strand (1, -1, 0), phase, attributes; lines with fewer than nine fields and
    comments are left out. Sequences: contig, sequence.
    """
    whole = read_texts(spark, path)
    lines = whole.select("path", F.posexplode(F.split(F.substring_index("text", "##FASTA", 1), r"\r?\n")).alias("ord", "line")).where(~F.col("line").startswith("#"))
    f = lines.select("path", "ord", F.split("line", "\t").alias("f")).where(F.size("f") >= 9)
    features = f.select("path", "ord", F.col("f")[0].alias("contig"), F.col("f")[1].alias("source"), F.col("f")[2].alias("type"), F.col("f")[3].cast("int").alias("start"), F.col("f")[4].cast("int").alias("end"), F.when(F.col("f")[6] == "+", 1).when(F.col("f")[6] == "-", -1).otherwise(0).alias("strand"), F.col("f")[7].alias("phase"), gff_attributes(F.col("f")[8]).alias("attributes"))
    embedded = whole.where(F.col("text").contains("##FASTA")).select(F.posexplode(F.split(F.substring_index("text", "##FASTA", -1), r"(?:^|\n)\s*>")).alias("ord", "value"))
    return features, parse_fasta(embedded).groupBy(F.col("id").alias("contig")).agg(F.upper(F.min_by("sequence", "ord")).alias("sequence"))


def read_gff_comments(spark: SparkSession, path: str) -> DataFrame:
    """ord, line of the comments before any embedded sequences."""
    whole = read_texts(spark, path)
    return whole.select(F.posexplode(F.split(F.substring_index("text", "##FASTA", 1), r"\r?\n")).alias("ord", "line")).where(F.col("line").startswith("#"))


def coding_proteins(features: DataFrame, contigs: DataFrame, code: str = sequences.STANDARD) -> DataFrame:
    """Proteins of the CDS features: parts of one ID (or Parent) are spliced in the order of the strand, then translated up to the first stop.

    The name is the first of ID, protein_id, locus_tag, Name and contig_CDS_n. Features on contigs without a sequence are left out.
    """
    a = F.col("attributes")
    cds = features.where("type = 'CDS'").withColumn("key", F.coalesce(F.element_at(a, "ID"), F.element_at(a, "Parent")))
    n = F.row_number().over(Window.partitionBy("contig").orderBy("ord"))
    name = F.coalesce(*[F.nullif(F.element_at(a, k), F.lit("")) for k in ("ID", "protein_id", "locus_tag", "Name")], F.concat_ws("_", "contig", F.lit("CDS"), n.cast("string")))
    cds = cds.withColumn("name", name).withColumn("key", F.coalesce("key", "name"))
    whole = merged_parts(cds, ["contig", "key", "strand"]).join(cds.groupBy("contig", "key", "strand").agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord")), ["contig", "key", "strand"])
    spliced = whole.join(contigs, "contig").withColumn("coding", sequences.splice(F.col("sequence"), F.col("intervals"), F.col("strand")))
    return spliced.select("ord", F.col("name").alias("id"), "contig", "start", "end", "strand", sequences.translate(F.col("coding"), code).alias("sequence"))


_LOCATION = re.compile(r"<?(\d+)(?:\.\.>?(\d+))?")


def parse_genbank(record: str) -> Iterator[tuple]:
    """Features of one GenBank record, as rows of the feature schema."""
    lines = record.replace("\r", "").split("\n")
    locus = next((x.split()[1] for x in lines if x.startswith("LOCUS") and len(x.split()) > 1), None)
    if locus is None:
        return
    contig = next((x.split()[1] for x in lines if x.startswith("VERSION") and len(x.split()) > 1), locus)
    origin = next((i for i, x in enumerate(lines) if x.startswith("ORIGIN")), len(lines))
    bases = "".join(re.sub(r"[^A-Za-z]", "", x) for x in lines[origin + 1 :]).upper() or None
    blocks: list[tuple[str, list[str]]] = []
    inside = False
    for x in lines[:origin]:
        if x.startswith("FEATURES"):
            inside = True
        elif inside and x[:5] == "     " and x[5:6].strip():
            blocks.append((x[5:21].strip(), [x[21:].strip()]))
        elif inside and x.startswith(" " * 21) and blocks:
            blocks[-1][1].append(x[21:].strip())
        elif inside and x[:1].strip():
            inside = False
    for n, (kind, body) in enumerate(blocks):
        at = next((i for i, x in enumerate(body) if x.startswith("/")), len(body))
        place = "".join(body[:at])
        spans = sorted((int(a), int(b or a)) for a, b in _LOCATION.findall(place))
        quals: dict[str, str] = {}
        key = None
        for x in body[at:]:
            if x.startswith("/") and (m := re.match(r"/(\w+)(?:=(.*))?$", x)):
                key = m[1]
                quals.setdefault(key, (m[2] or "").strip('"'))
            elif key:
                quals[key] += ("" if key == "translation" else " ") + x.strip('"')
        if spans:
            yield contig, n, kind, spans[0][0], max(b for _, b in spans), -1 if "complement" in place else 1, [{"start": a, "end": b} for a, b in spans], quals, bases


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """All features of GenBank files, one row each, with contig sequence."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for text in f.text for record in re.split(r"(?m)^//\s*$", text) for r in parse_genbank(record)]
            yield pd.DataFrame(rows, columns=schemas.FEATURE.names)

    return read_texts(spark, path).mapInPandas(parse, schemas.FEATURE)


def genbank_proteins(features: DataFrame) -> DataFrame:
    """Proteins of CDS features with a translation, and of mature peptides cut from the CDS around them; CDS with two or more peptides are left out.

    A peptide's protein is the translation of its own bases. Columns: id, contig, start, end, strand, sequence, feature_type, parent.
    """
    q = F.col("qualifiers")
    name = F.coalesce(*[F.nullif(F.element_at(q, k), F.lit("")) for k in ("protein_id", "locus_tag")], F.concat_ws("_", "contig", F.element_at(q, "gene")), F.concat_ws("_", "contig", "type", F.col("ord").cast("string")))
    named = features.withColumn("id", name)
    cds = named.where("type = 'CDS'").where(F.element_at(q, "translation").isNotNull())
    peptides = named.where("type = 'mat_peptide' and contig_sequence is not null")
    parts = peptides.select("contig", "start", "end", F.struct("contig", "ord").alias("part_id"))
    parent = containing(parts, cds.select("contig", "start", "end", "ord", F.col("id").alias("whole_id"))).select("part_id.contig", "part_id.ord", F.col("whole_id").alias("parent"))
    placed = peptides.join(parent, ["contig", "ord"], "left")
    split = placed.where("parent is not null").groupBy("contig", F.col("parent").alias("id")).count().where("count >= 2")
    cols = ["id", "contig", "start", "end", "strand", "sequence", F.col("type").alias("feature_type"), "parent"]
    kept = cds.join(split, ["contig", "id"], "left_anti").withColumns({"sequence": sequences.clean_protein(F.element_at(q, "translation")), "parent": F.lit(None).cast("string")})
    cut = placed.withColumn("sequence", sequences.translate(sequences.splice(F.col("contig_sequence"), F.col("intervals"), F.col("strand"))))
    return kept.select(*cols).unionByName(cut.select(*cols))


def read_hits(spark: SparkSession, path: str, source_db: str | None = None) -> DataFrame:
    """Search hits of 16 tab-separated columns (more are ignored) without a header; :func:`broken_hits` has the lines that aren't such hits."""
    hits = _hit_lines(spark, path).where("broken is null").drop("broken")
    return hits.withColumn("source_db", F.lit(source_db)) if source_db else hits


def broken_hits(spark: SparkSession, path: str) -> DataFrame:
    """Lines (broken) that have fewer than 16 fields or a number that can't be read; empty lines aren't among them."""
    return _hit_lines(spark, path).where("broken is not null").select("broken")


def _hit_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.split("value", "\t").alias("f"))
    cols = [F.get("f", i).try_cast(x.dataType).alias(x.name) for i, x in enumerate(schemas.HITS.fields)]
    good = F.size("f") >= len(cols)
    for i, x in enumerate(schemas.HITS.fields):
        if x.dataType.typeName() != "string":
            good = good & F.get("f", i).try_cast(x.dataType).isNotNull()
    return lines.select(*cols, F.when(~good, F.col("value")).alias("broken"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """name, go_id: names and exact synonyms of the terms of an OBO file, in lower case; obsolete terms are left out."""
    t = spark.read.option("lineSep", "[Term]").text(path).where(F.col("value").contains("id: GO:") & ~F.col("value").contains("is_obsolete: true"))
    names = F.concat(F.regexp_extract_all("value", F.lit(r"(?m)^name: (.+)$")), F.regexp_extract_all("value", F.lit(r'(?m)^synonym: "([^"]+)" EXACT')))
    return t.select(F.regexp_extract("value", r"(?m)^id: (GO:\d{7})", 1).alias("go_id"), F.explode(names).alias("name")).select(F.lower(F.trim("name")).alias("name"), "go_id").groupBy("name").agg(F.min("go_id").alias("go_id"))


def resolved_terms(rows: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """key, go_ids: the ids in a text, else those of its ``;``-separated names, in order."""
    inline = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(GO:\d{7})"))
    names = rows.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), ";")).alias("i", "n")).select(key, "i", F.lower(F.trim("n")).alias("name")).join(terms, "name").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "go_id"))).alias("l"))
    both = rows.select(key, F.array_distinct(inline).alias("own")).join(names, key, "left")
    return both.select(key, F.array_join(F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce(F.array_distinct(F.transform("l", lambda x: x["go_id"])), F.array().cast("array<string>"))), "; ").alias("go_ids"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """protein_id, source_db, embedding of .npz files with arrays protein_ids, source_dbs and embeddings."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f.content:
                z = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                yield pd.DataFrame({"protein_id": z["protein_ids"].astype(str), "source_db": z["source_dbs"].astype(str), "embedding": list(z["embeddings"].astype(np.float32))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, schemas.EMBEDDING)


def read_gold_standard(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a gold-standard JSON: ``entries`` as a list; protein_id, true_function, true_category and what else they have."""
    return spark.read.option("multiLine", True).json(path).select(F.inline("entries"))


def uniprot_fields(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """accession, description, gene, organism, pfam, go_terms, keywords of UniProt entries in JSON text."""
    kind = "primaryAccession string, proteinDescription struct<recommendedName:struct<fullName:struct<value:string>>,submissionNames:array<struct<fullName:struct<value:string>>>>, genes array<struct<geneName:struct<value:string>>>, organism struct<scientificName:string>, uniProtKBCrossReferences array<struct<database:string,id:string,properties:array<struct<key:string,value:string>>>>, keywords array<struct<name:string>>"
    e = entries.select(F.from_json(entry, kind).alias("e")).where("e.primaryAccession is not null")
    refs = lambda db: F.array_join(F.transform(F.filter("e.uniProtKBCrossReferences", lambda x: x["database"] == db), lambda x: x["id"]), "; ")
    told = F.coalesce("e.proteinDescription.recommendedName.fullName.value", F.get(F.col("e.proteinDescription.submissionNames"), 0)["fullName"]["value"])
    return e.select(F.col("e.primaryAccession").alias("accession"), told.alias("description"), F.get(F.col("e.genes"), 0)["geneName"]["value"].alias("gene"), F.col("e.organism.scientificName").alias("organism"), refs("Pfam").alias("pfam"), refs("GO").alias("go_terms"), F.array_join(F.transform("e.keywords", lambda k: k["name"]), "; ").alias("keywords"))
