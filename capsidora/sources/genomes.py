"""Proteins of genomes: input of any format, proteins beside features, genetic codes, gene models of spliced alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsidora.functions import sequences
from capsidora.functions.providers import reading_frames
from capsidora.operators.genome import distinct_names
from capsidora.session import exists
from capsidora.sources import files

# Genetic codes by what they change in the standard one, and the letters of nucleotides.
CODES = {
    1: {}, 2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"}, 3: {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"}, 4: {"TGA": "W"}, 5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    6: {"TAA": "Q", "TAG": "Q"}, 9: {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"}, 10: {"TGA": "C"}, 11: {}, 12: {"CTG": "S"}, 13: {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"},
    14: {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"}, 15: {"TAG": "Q"}, 16: {"TAG": "L"}, 21: {"TGA": "W", "ATA": "M", "AGA": "S", "AGG": "S", "AAA": "N"}, 22: {"TCA": "*", "TAG": "L"},
    23: {"TTA": "*"}, 24: {"AGA": "S", "AGG": "K", "TGA": "W"}, 25: {"TGA": "G"}, 26: {"CTG": "A"},
}
NUCLEOTIDES = "ACGTUNRYMKSWBDHV"
SNIFF_RECORDS, SNIFF_LETTERS, SNIFF_SHARE = 10, 5000, 0.8


def code(table: int = 1) -> str:
    """The amino acids of all codons (TTT, TTC, TTA, TTG, TCT, ...) of a genetic code; an unknown table is an error."""
    if table not in CODES:
        raise ValueError(f"unknown genetic code {table}")
    out = list(sequences.STANDARD)
    for codon, amino in CODES[table].items():
        a, b, c = ("TCAG".index(x) for x in codon)
        out[a * 16 + b * 4 + c] = amino
    return "".join(out)


def is_nucleotide_fasta(spark: SparkSession, path: str) -> bool:
    """Whether the first letters (of ten records, at most 5,000) are mostly those of nucleotides; an absent or empty file isn't. A look at the head of a file, not a filter."""
    if not exists(spark, path):
        return False
    head = files.parse_fasta(files.read_records(spark, path)).orderBy("ord").limit(SNIFF_RECORDS).collect()
    text = "".join(r.sequence.upper() for r in head)[:SNIFF_LETTERS]
    return bool(text) and sum(c in NUCLEOTIDES for c in text) / len(text) >= SNIFF_SHARE


def table_of(features: DataFrame, comments: DataFrame | None = None) -> int:
    """The genetic code that features tell by their attribute, else that header comments (ord, line) tell, else 1."""
    told = F.element_at("attributes", "transl_table")
    row = features.where(told.rlike(r"^\d+$")).agg(F.min_by(told, F.struct("path", "ord")).alias("t")).first()
    if row.t is None and comments is not None:
        found = F.regexp_extract("line", r"transl_table=(\d+)", 1)
        row = comments.where(found != "").agg(F.min_by(found, "ord").alias("t")).first()
    return int(row.t) if row.t is not None else 1


def gff_name(attributes: Column, contig: Column, n: Column) -> Column:
    """The first of ID, protein_id, locus_tag and Name, else contig_CDS_n."""
    return F.coalesce(*[F.nullif(F.element_at(attributes, k), F.lit("")) for k in ("ID", "protein_id", "locus_tag", "Name")], F.concat_ws("_", contig, F.lit("CDS"), n.cast("string")))


def features_with_proteins(features: DataFrame, proteins: DataFrame, min_length: int = 1, max_length: int | None = None) -> DataFrame:
    """Proteins (id, sequence) placed by the CDS features of the same name; nothing is translated.

    Columns: id (unique), description, sequence, contig, start, end, strand, product, gene. Features without a protein are left out; the description is product, Name or gene.
    """
    a = F.col("attributes")
    cds = features.where("type = 'CDS'").withColumn("name", gff_name(a, F.col("contig"), F.col("ord")))
    told = lambda k: F.nullif(F.element_at(a, k), F.lit(""))
    joined = cds.join(proteins.select(F.col("id").alias("name"), "sequence"), "name").withColumn("sequence", sequences.clean_protein(F.col("sequence"))).where(F.length("sequence") >= max(1, min_length))
    if max_length is not None:
        joined = joined.where(F.length("sequence") <= max_length)
    joined = joined.select("name", "ord", F.coalesce(told("product"), told("Name"), told("gene"), F.lit("hypothetical protein")).alias("description"), "sequence", "contig", "start", "end", "strand", told("product").alias("product"), told("gene").alias("gene"))
    return distinct_names(joined, "name", ["ord", "start"], "id").drop("name", "ord")


def spliced_genes(features: DataFrame) -> DataFrame:
    """Gene models of a spliced alignment: each mRNA with its CDS rows: contig, gene_id, start, end, strand, intervals, is_spliced."""
    a = F.col("attributes")
    parents = features.where("type = 'mRNA'").select("contig", "strand", F.element_at(a, "ID").alias("gene_id"))
    parts = features.where("type = 'CDS'").select(F.element_at(a, "Parent").alias("gene_id"), "start", "end")
    models = parts.groupBy("gene_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("intervals"))
    return parents.join(models, "gene_id").withColumn("is_spliced", F.size("intervals") > 1)


def translated_genes(genes: DataFrame, contigs: DataFrame, table: int = 1) -> DataFrame:
    """Gene models with their protein_sequence; those on contigs without a sequence are left out."""
    coding = sequences.splice(F.col("sequence"), F.col("intervals"), F.col("strand"))
    return genes.join(contigs, "contig").withColumn("protein_sequence", sequences.translate(coding, code(table))).drop("sequence")


def read_proteins(spark: SparkSession, path: str, beside: str | None = None, min_length: int = 1, max_length: int | None = None, table: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Proteins of a file of any known format, and their positions (id, contig, start, end, strand), where it tells them.

    ``beside``: for GFF3, a FASTA of contigs or of proteins. Nucleotide FASTA goes to the gene caller. Proteins have id, description, sequence.
    """
    kind = files.format_of(path)
    if kind in ("fasta", "nucleotide") and (kind == "nucleotide" or is_nucleotide_fasta(spark, path)):
        genes = called_genes(files.read_contigs(spark, path), table or 11)
        return _placed(genes.select(F.col("gene_id").alias("id"), F.lit("").alias("description"), F.col("protein_sequence").alias("sequence"), "contig", "start", "end", "strand"), min_length, max_length)
    if kind == "fasta":
        return files.read_fasta(spark, path, min_length, max_length).drop("ord", "warnings"), None
    if kind == "genbank":
        p = files.genbank_proteins(files.read_genbank(spark, path)).withColumn("description", F.lit("")).withColumnRenamed("id", "name")
        return _placed(distinct_names(p, "name", ["contig", "start", "end"], "id"), min_length, max_length)
    features, embedded = files.read_gff(spark, path)
    if beside is not None and not is_nucleotide_fasta(spark, beside):
        return _placed(features_with_proteins(features, files.read_fasta(spark, beside)), min_length, max_length)
    contigs = files.read_contigs(spark, beside) if beside is not None else embedded
    used = table or table_of(features, files.read_gff_comments(spark, path))
    return _placed(files.coding_proteins(features, contigs, code(used)).withColumn("description", F.lit("")), min_length, max_length)


def _placed(p: DataFrame, min_length: int, max_length: int | None) -> tuple[DataFrame, DataFrame]:
    p = p.where(F.length("sequence") >= max(1, min_length))
    if max_length is not None:
        p = p.where(F.length("sequence") <= max_length)
    return p.select("id", "description", "sequence"), p.select("id", "contig", "start", "end", "strand")


def called_genes(contigs: DataFrame, table: int = 11, least: int = 90) -> DataFrame:
    """Genes of contigs by the built-in scan of open frames, named contig_n, with their proteins."""
    genes = reading_frames(contigs, least).withColumn("intervals", F.array(F.struct("start", "end"))).drop("protein_sequence", "caller")
    n = F.row_number().over(_along())
    return translated_genes(genes.withColumn("gene_id", F.concat_ws("_", "contig", n.cast("string"))), contigs, table).withColumn("caller", F.lit("frames"))


def _along() -> object:
    from pyspark.sql import Window

    return Window.partitionBy("contig").orderBy("start", "end", "strand")


def gene_lines(genes: DataFrame, source: str = "capsidora") -> DataFrame:
    """GFF3 lines of genes: a gene row, and one row an exon where it is spliced; in order of contig and start."""
    strand = F.when(F.col("strand") == 1, "+").when(F.col("strand") == -1, "-").otherwise(".")

    def line(kind: str, start: Column, end: Column, attributes: Column) -> Column:
        return F.concat_ws("\t", F.col("contig"), F.lit(source), F.lit(kind), start.cast("string"), end.cast("string"), F.lit("."), strand, F.lit("0" if kind == "CDS" else "."), attributes)

    whole = F.array(line("CDS", F.col("start"), F.col("end"), F.concat(F.lit("ID="), "gene_id")))
    exons = F.transform("intervals", lambda x, i: line("exon", x["start"], x["end"], F.concat(F.lit("ID="), "gene_id", F.lit(".exon"), (i + 1).cast("string"), F.lit(";Parent="), "gene_id")))
    lines = F.when(F.size("intervals") > 1, F.concat(whole, exons)).otherwise(whole)
    return genes.select("contig", "start", "gene_id", F.posexplode(lines).alias("i", "line")).orderBy("contig", "start", "gene_id", "i").select("line")
