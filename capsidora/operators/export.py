"""Result tables in the layouts of downstream tools; writing them is up to the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsidora.functions.text import contig_of, gff_escape
from capsidora.session import settle


def _text(df: DataFrame, name: str, rest: str = "") -> Column:
    """A column as text; ``rest`` for null, for NaN, and where the column is missing."""
    if name not in df.columns:
        return F.lit(rest)
    c = F.col(name)
    if dict(df.dtypes)[name] in ("double", "float"):
        c = F.when(~F.isnan(c), c)
    return F.coalesce(c.cast("string"), F.lit(rest))


def _number(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _strand(df: DataFrame, rest: str) -> Column:
    s = _number(df, "strand", "int")
    return F.when(s == 1, "+").when(s == -1, "-").otherwise(rest)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in a global order, without one task for all: sorted ranges are counted, then offset."""
    placed = df.orderBy(*order).withColumn("p__", F.spark_partition_id()).withColumn("m__", F.monotonically_increasing_id())
    placed = settle(placed, "numbered").withColumn("r__", F.col("m__") - (F.col("p__").cast("long") * (1 << 33)))
    sizes = {r.p__: r.n for r in placed.groupBy("p__").agg(F.count("*").alias("n")).collect()}
    start, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, start))
        start += sizes[p]
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    offset = F.create_map(*[F.lit(x) for pair in starts for x in pair])
    return placed.withColumn(name, (F.col("r__") + F.element_at(offset, F.col("p__"))).cast("long")).drop("p__", "m__", "r__")


def anvio_functions(results: DataFrame, prefix: str = "capsidora", order: list[str] | None = None) -> DataFrame:
    """gene_callers_id, source, accession, function, e_value: up to five rows a protein, the category always."""
    rows = numbered(results, order or ["query_id"], "gene_callers_id")
    text = lambda n: _text(rows, n)

    def row(keep: Column, source: str, acc: Column, function: Column, e: Column) -> Column:
        return F.when(keep, F.struct(F.lit(f"{prefix}_{source}").alias("source"), acc.alias("accession"), function.alias("function"), e.alias("e_value")))

    zero = F.lit(0.0)
    kinds = F.array(
        row((text("description") != "") & (text("description") != "hypothetical protein"), "structural", text("primary_target"), text("description"), F.coalesce(_number(rows, "primary_evalue", "double"), zero)),
        row(text("pfam") != "", "Pfam", F.trim(F.substring_index(text("pfam"), ";", 1)), text("pfam"), zero),
        row(text("go_bp") != "", "GO_BP", text("go_bp_ids"), text("go_bp"), zero),
        row(text("go_mf") != "", "GO_MF", text("go_mf_ids"), text("go_mf"), zero),
        row(F.lit(True), "category", _text(rows, "functional_category", "unknown"), _text(rows, "functional_category", "unknown"), zero),
    )
    return rows.select("gene_callers_id", F.inline(F.array_compact(kinds)))


def _contig(df: DataFrame) -> Column:
    return contig_of(F.col("query_id"), F.col("contig") if "contig" in df.columns else None)


def gene_to_genome(results: DataFrame) -> DataFrame:
    return results.select(F.col("query_id").alias("protein_id"), _contig(results).alias("genome_id"))


def genome_lengths(results: DataFrame) -> DataFrame:
    """The sum of the lengths of each genome's proteins."""
    return results.groupBy(_contig(results).alias("genome_id")).agg(F.sum(F.coalesce(F.col("query_length"), F.lit(0)).cast("long")).alias("length"))


def network_genes(results: DataFrame) -> DataFrame:
    """protein_id, contig_id, keywords: description, if it says something, and category."""
    told, category = _text(results, "description", "hypothetical protein"), _text(results, "functional_category", "unknown")
    words = F.when(told.isin("", "hypothetical protein"), category).otherwise(F.concat_ws("; ", told, category))
    return results.select(F.col("query_id").alias("protein_id"), _contig(results).alias("contig_id"), words.alias("keywords"))


def dramv_annotations(results: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Annotations by scaffold and the gene's place on it."""
    scaffold = _contig(results)
    rows = results.withColumn("scaffold", scaffold)
    place = F.row_number().over(Window.partitionBy("scaffold").orderBy(*(order or ["query_id"])))
    return rows.select(
        "scaffold", place.alias("gene_position"), _text(rows, "start").alias("start_position"), _text(rows, "end").alias("end_position"), _strand(rows, "").alias("strandedness"),
        _text(rows, "description").alias("description"), _text(rows, "functional_category", "unknown").alias("category"), _text(rows, "confidence_level", "none").alias("confidence"),
        _text(rows, "pfam").alias("pfam"), _text(rows, "go_bp").alias("go_bp"), _text(rows, "go_mf").alias("go_mf"),
    )


def gff_lines(results: DataFrame, source: str = "capsidora") -> DataFrame:
    """One GFF3 line of each protein that has contig, start and end; none where the table has no such columns."""
    missing = {c: F.lit(None).cast("string" if c == "contig" else "int") for c in ("contig", "start", "end") if c not in results.columns}
    rows = (results.withColumns(missing) if missing else results).where("contig is not null and start is not null and end is not null")
    ids = F.array_compact(F.array(*[F.nullif(F.replace(_text(rows, n), F.lit("; "), F.lit(",")), F.lit("")) for n in ("go_bp_ids", "go_mf_ids")]))
    pfam = _text(rows, "pfam")
    attributes = F.array_compact(F.array(
        F.concat(F.lit("ID="), "query_id"),
        F.concat(F.lit("Name="), gff_escape(_text(rows, "description", "hypothetical protein"))),
        F.concat(F.lit("category="), _text(rows, "functional_category", "unknown")),
        F.concat(F.lit("confidence="), _text(rows, "confidence_level", "none")),
        F.when(pfam != "", F.concat(F.lit("Dbxref=Pfam:"), gff_escape(pfam))),
        F.when(F.size(ids) > 0, F.concat(F.lit("Ontology_term="), F.array_join(ids, ","))),
    ))
    kind = F.when(_text(rows, "feature_type") != "", _text(rows, "feature_type")).otherwise("CDS")
    return rows.select(F.concat_ws("\t", "contig", F.lit(source), kind, F.col("start").cast("string"), F.col("end").cast("string"), _text(rows, "primary_evalue", "."), _strand(rows, "."), F.lit("."), F.array_join(attributes, ";")).alias("line"))


FORMATS = {"anvio": anvio_functions, "vcontact2": network_genes, "gene2genome": gene_to_genome, "genome_lengths": genome_lengths, "dramv": dramv_annotations, "gff3": gff_lines}


def export(results: DataFrame, formats: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of the wanted formats, all by default; an unknown format is an error."""
    wanted = list(FORMATS) if not formats or formats == ["all"] else formats
    if unknown := set(wanted) - set(FORMATS):
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    return {f: FORMATS[f](results) for f in wanted}
