"""Metadata of reference databases, and the annotation of search targets from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsidora.functions import scoring
from capsidora.functions.text import model_name, named_part
from capsidora.session import exists, local_path

# Columns of the files, names of the expansion files and of their annotation column.
BFVD_COLUMNS = "uniprot_id string, structure_id string, plddt double, ptm double, flag string, source string"
TAXONOMY_COLUMNS = "structure_file string, taxid string"
VIRO3D_COLUMNS = {
    "viro3d_id": ("Viro3D ID", "string"), "name": ("Viro3D Name", "string"), "organism": ("ICTV Species", "string"), "genbank_id": ("GenBank Protein ID", "string"), "uniprot_id": ("UniProt ID", "string"),
    "protein_length": ("Protein Length", "int"), "esm_plddt": ("ESMFold pLDDT", "double"), "esm_ptm": ("ESMFold pTM", "double"), "cf_plddt": ("ColabFold pLDDT", "double"), "cf_ptm": ("ColabFold pTM", "double"), "cf_depth": ("ColabFold median MSA depth", "double"),
}
EXPANSIONS = {
    "pfam": ("Pfam", "Pfam Annotation"), "go_bp": ("GO_biological_process", "Biological Process Annotation"), "go_mf": ("GO_molecular_function", "Molecular Function Annotation"),
    "go_cc": ("GO_cellular_component", "Cellular Component Annotation"), "superfamily": ("SUPERFAMILY", "SUPERFAMILY Annotation"), "gene3d": ("Gene3D", "Gene3D Annotation"),
}
RATIO = "Annotation Expansion Ratio"
#: Evidence codes of the experimental terms that are kept, by their evidence ontology ids.
EVIDENCE = {
    "ECO:0000269": "EXP", "ECO:0000314": "IDA", "ECO:0000315": "IMP", "ECO:0000316": "IGI", "ECO:0000353": "IPI", "ECO:0000270": "IEP",
    "ECO:0007005": "HDA", "ECO:0007001": "HMP", "ECO:0007003": "HGI", "ECO:0007007": "HEP", "ECO:0006056": "HTP",
}
#: What an annotation table has beside target and source_db.
ANNOTATION = ["description", "gene", "organism", "uniprot_id", "structure_quality", "structure_source", "pfam", "go_bp", "go_mf", "go_cc", "superfamily", "gene3d"]


def _ordered(df: DataFrame) -> DataFrame:
    """With the place of each row in its files, as ``ord``."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def read_bfvd(spark: SparkSession, path: str) -> DataFrame:
    """Structures of a table without header: uniprot_id, structure_id, plddt, ptm, flag, source, ord."""
    return _ordered(spark.read.schema(BFVD_COLUMNS).option("sep", "\t").csv(path))


def read_bfvd_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return _ordered(spark.read.schema(TAXONOMY_COLUMNS).option("sep", "\t").csv(path))


def last_of(df: DataFrame, key: str) -> DataFrame:
    """The last row of each non-empty key, by ``ord``."""
    rest = [c for c in df.columns if c not in (key, "ord")]
    best = df.where(f"coalesce({key}, '') <> ''").groupBy(key).agg(F.max_by(F.struct(*rest), "ord").alias("r"))
    return best.select(key, "r.*")


def read_bfvd_enriched(spark: SparkSession, path: str) -> DataFrame:
    """Functional annotation with header, all text; the last row of an accession holds. An absent file is an empty table."""
    kinds = ["uniprot_accession", "protein_name", "gene_name", "organism", "go_bp", "go_mf", "pfam_domains", "keywords", "function_cc", "lineage"]
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(k, T.StringType()) for k in kinds]))
    raw = spark.read.option("header", True).option("sep", "\t").option("quote", "\"").csv(path)
    cols = [F.col(f"`{k}`").cast("string").alias(k) if k in raw.columns else F.lit(None).cast("string").alias(k) for k in kinds]
    return last_of(_ordered(raw.select(*cols)), "uniprot_accession")


def read_viro3d(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """The protein list, from the first path that exists, with short column names and ord; columns that a file lacks are null."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    path = next((p for p in paths if exists(spark, p)), None)
    if path is None:
        raise FileNotFoundError(f"no protein list at {paths}")
    raw = spark.read.option("header", True).option("quote", "\"").option("escape", "\"").csv(path)
    cols = [F.expr(f"try_cast(`{name}` as {kind})").alias(short) if name in raw.columns else F.lit(None).cast(kind).alias(short) for short, (name, kind) in VIRO3D_COLUMNS.items()]
    return _ordered(raw.select(*cols))


def read_expansions(spark: SparkSession, folder: str) -> DataFrame:
    """viro3d_id, kind, annotation, confidence, ord of the expansion files that are there; none gives an empty table."""
    out = spark.createDataFrame([], "viro3d_id string, kind string, annotation string, confidence double, ord bigint")
    for kind, (name, column) in EXPANSIONS.items():
        path = f"{folder}/Viro3D_proteins_with_{name}_annotation_expansion.csv"
        if exists(spark, path):
            raw = spark.read.option("header", True).option("quote", "\"").option("escape", "\"").csv(path)
            ratio = F.expr(f"try_cast(`{RATIO}` as double)") if RATIO in raw.columns else F.lit(1.0)
            out = out.unionByName(_ordered(raw.select(F.col("`Viro3D ID`").alias("viro3d_id"), F.lit(kind).alias("kind"), F.col(f"`{column}`").alias("annotation"), ratio.alias("confidence"))))
    return out


def best_expansions(rows: DataFrame) -> DataFrame:
    """One row an id: of each kind the annotation of highest confidence (the first of equal ones) and that confidence; a missing one counts 1."""
    sure = F.coalesce(F.nanvl("confidence", F.lit(None).cast("double")), F.lit(1.0))
    held = rows.where("coalesce(viro3d_id, '') <> '' and coalesce(annotation, '') <> ''").withColumn("o", F.struct((-sure).alias("c"), "ord"))
    each = [F.min(F.when(F.col("kind") == k, F.struct("o", "annotation"))).alias(f"_{k}") for k in EXPANSIONS]
    wide = held.groupBy("viro3d_id").agg(*each)
    return wide.select("viro3d_id", *[F.col(f"_{k}.annotation").alias(k) for k in EXPANSIONS], *[(-F.col(f"_{k}.o.c")).alias(f"{k}_confidence") for k in EXPANSIONS])


def looked_up(keys: DataFrame, key: str, table: DataFrame, exact: str, needle: Column | None = None, within: str | None = None) -> DataFrame:
    """``keys`` (distinct) with the first row of ``table`` (by ord) whose ``exact`` equals the key; else the first whose ``within`` contains the needle.

    The fallback needs no pairing of all keys with all rows: rows are cut into their substrings of the lengths that the missed
    needles have, and these are joined.
    """
    rest = F.struct(*[c for c in table.columns])
    first = table.where(F.col(exact).isNotNull()).groupBy(F.col(exact).alias(key)).agg(F.min_by(rest, "ord").alias("r"))
    one = keys.join(first, key)
    missed = keys.join(first, key, "left_anti").withColumn("n__", needle if needle is not None else F.col(key)).where("length(n__) > 0")
    lengths = sorted(r[0] for r in missed.select(F.length("n__")).distinct().collect())
    if not lengths:
        return one.select(key, "r.*")
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("t__") - n + 1, F.lit(1))), lambda i: F.substring(F.col("t__"), i, F.lit(n)))
    parts = table.withColumn("t__", F.col(within or exact)).where("t__ is not null").select(rest.alias("r"), "ord", F.explode(F.array_distinct(F.concat(*[cut(n) for n in lengths]))).alias("n__"))
    found = missed.join(parts, "n__").groupBy(key).agg(F.min_by("r", "ord").alias("r"))
    return one.unionByName(found.select(key, "r")).select(key, "r.*")


def _filled(df: DataFrame, source: str) -> DataFrame:
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ANNOTATION]
    return df.select("target", F.lit(source).alias("source_db"), *cols)


def bfvd_annotations(targets: DataFrame, metadata: DataFrame, enriched: DataFrame | None = None, cache: DataFrame | None = None) -> DataFrame:
    """Annotation of targets (target): the structure's figures, and the text of enriched metadata, else of a lookup cache, else the accession.

    ``cache``: accession, description, gene, organism, as :func:`capsidora.sources.files.uniprot_fields` gives. Unknown targets give no row.
    """
    found = looked_up(targets.select("target").distinct(), "target", metadata, "uniprot_id")
    none = F.lit(None).cast("double")
    quality, source = scoring.structure_quality(none, none, none, none, none, F.col("plddt"), F.col("ptm"))
    found = found.select("target", "uniprot_id", quality.alias("structure_quality"), source.alias("structure_source"))
    told = lambda c: F.nullif(F.col(c), F.lit(""))
    if enriched is not None:
        e = enriched.select(F.col("uniprot_accession").alias("uniprot_id"), F.lit(True).alias("rich"), told("protein_name").alias("d1"), told("gene_name").alias("g1"), told("organism").alias("o1"), told("go_bp").alias("go_bp"), told("go_mf").alias("go_mf"), told("pfam_domains").alias("pfam"))
        found = found.join(e, "uniprot_id", "left")
    else:
        found = found.withColumns({"rich": F.lit(None).cast("boolean"), **{c: F.lit(None).cast("string") for c in ("d1", "g1", "o1", "go_bp", "go_mf", "pfam")}})
    if cache is not None:
        found = found.join(cache.select(F.col("accession").alias("uniprot_id"), told("description").alias("d2"), told("gene").alias("g2"), told("organism").alias("o2")), "uniprot_id", "left")
    else:
        found = found.withColumns({c: F.lit(None).cast("string") for c in ("d2", "g2", "o2")})
    pick = lambda a, b: F.when(F.col("rich"), F.col(a)).otherwise(F.col(b))
    return _filled(found.withColumns({"description": F.coalesce(pick("d1", "d2"), F.concat(F.lit("UniProt:"), "uniprot_id")), "gene": pick("g1", "g2"), "organism": pick("o1", "o2")}), "bfvd")


def viro3d_annotations(targets: DataFrame, metadata: DataFrame, expansions: DataFrame | None = None) -> DataFrame:
    """Annotation of targets (target), matched by the model's name, else by its GenBank id.

    The description is the product that the name tells, else the name; one that says nothing gives way to the Pfam, else to the SUPERFAMILY annotation.
    """
    wanted = targets.select("target").distinct().withColumn("key", model_name(F.col("target")))
    keys = wanted.select("key").distinct()
    found = looked_up(keys, "key", metadata, "viro3d_id", F.substring_index("key", "_", 1), "genbank_id")
    none = F.lit(None).cast("double")
    quality, source = scoring.structure_quality(F.col("esm_plddt"), F.col("esm_ptm"), F.col("cf_plddt"), F.col("cf_ptm"), F.col("cf_depth"), none, none)
    described = F.coalesce(named_part(F.col("name"), "Product"), F.nullif(F.col("name"), F.lit("")), F.lit("viral protein"))
    found = found.select("key", "organism", "uniprot_id", quality.alias("structure_quality"), source.alias("structure_source"), described.alias("description"), named_part(F.col("name"), "Gene").alias("gene"))
    if expansions is not None:
        found = found.join(expansions.withColumnRenamed("viro3d_id", "key"), "key", "left")
        poor = F.col("description").isin("viral protein", "", "hypothetical protein")
        found = found.withColumn("description", F.when(poor, F.coalesce("pfam", "superfamily", "description")).otherwise(F.col("description")))
    return _filled(wanted.join(found, "key").drop("key"), "viro3d")


def restored_ids(hits: DataFrame, ids: DataFrame, column: str = "query") -> DataFrame:
    """Hits whose shortened id is replaced by the whole one: ``ids`` (id, ord); a whole id stays, else the last id with that accession, else the hit's own."""
    whole = ids.select(F.col("id").alias(column), F.lit(True).alias("w__")).distinct()
    part = F.when(F.col("id").contains("|"), F.get(F.split("id", r"\|"), 1)).otherwise(F.regexp_extract("id", r"^(\S+)", 1))
    short = ids.select("id", "ord", part.alias(column)).where(F.col(column) != F.col("id")).groupBy(column).agg(F.max_by("id", "ord").alias("full__"))
    out = hits.join(whole, column, "left").join(short, column, "left")
    return out.withColumn(column, F.when(F.col("w__"), F.col(column)).otherwise(F.coalesce("full__", column))).drop("w__", "full__").select(hits.columns)


def read_swissprot_json(spark: SparkSession, path: str) -> DataFrame:
    """accession, name, organism, lineage, length, go_annotations of a JSON object from accession to entry."""
    entry = "struct<name:string,organism:string,lineage:string,length:int,go_annotations:array<struct<go_id:string,go_term:string,aspect:string,evidence_code:string>>>"
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("accession", "e"))
    return rows.select("accession", "e.*")


def available_scope(spark: SparkSession, folder: str) -> str | None:
    """The widest reference that a folder has: ``all``, ``viral`` or none."""
    return next((s for s in ("all", "viral") if exists(spark, f"{folder}/swissprot_{s}_metadata.json")), None)


def evidence_code(eco: Column) -> Column:
    """The evidence code of an evidence ontology id; null for codes that aren't experimental."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in EVIDENCE.items() for x in pair]), eco)


def read_swissprot_xml(spark: SparkSession, path: str, viral: bool = True, require_go: bool = True) -> DataFrame:
    """Entries of a reviewed-protein XML file, split by the reader: accession, name, organism, lineage, sequence, length, go_annotations.

    Only terms with an experimental evidence code are kept; with ``viral`` only entries whose lineage begins with Viruses; with
    ``require_go`` only entries that keep a term.
    """
    prop = T.StructType([T.StructField("_type", T.StringType()), T.StructField("_value", T.StringType())])
    ref = T.StructType([T.StructField("_type", T.StringType()), T.StructField("_id", T.StringType()), T.StructField("property", T.ArrayType(prop))])
    evidence = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_type", T.StringType())])
    organism = T.StructType([T.StructField("name", T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_type", T.StringType())]))), T.StructField("lineage", T.StructType([T.StructField("taxon", T.ArrayType(T.StringType()))]))])
    schema = T.StructType([T.StructField("accession", T.ArrayType(T.StringType())), T.StructField("name", T.StringType()), T.StructField("organism", organism), T.StructField("dbReference", T.ArrayType(ref)), T.StructField("evidence", T.ArrayType(evidence)), T.StructField("sequence", T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_length", T.IntegerType())]))])
    raw = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    value = lambda x, kind: F.get(F.filter(x["property"], lambda p: p["_type"] == kind), 0)["_value"]
    aspect = F.create_map(*[F.lit(x) for pair in {"P": "BP", "F": "MF", "C": "CC"}.items() for x in pair])
    terms = F.transform(F.filter("dbReference", lambda x: x["_type"] == "GO"), lambda x: F.struct(x["_id"].alias("go_id"), F.substring_index(value(x, "term"), ":", -1).alias("go_term"), F.element_at(aspect, F.substring(value(x, "term"), 1, 1)).alias("aspect"), evidence_code(value(x, "evidence")).alias("evidence_code")))
    lineage = F.array_join("organism.lineage.taxon", "; ")
    sci = F.get(F.filter("organism.name", lambda n: n["_type"] == "scientific"), 0)["_VALUE"]
    seq = F.regexp_replace("sequence._VALUE", r"\s", "")
    out = raw.select(F.get("accession", 0).alias("accession"), "name", sci.alias("organism"), lineage.alias("lineage"), seq.alias("sequence"), F.coalesce("sequence._length", F.length(seq)).alias("length"), F.filter(F.coalesce(terms, F.array().cast("array<struct<go_id:string,go_term:string,aspect:string,evidence_code:string>>")), lambda t: t["evidence_code"].isNotNull()).alias("go_annotations"))
    out = out.where("accession is not null")
    out = out.where(F.col("lineage").startswith("Viruses")) if viral else out
    return out.where("size(go_annotations) > 0") if require_go else out


def read_search_database(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence of a search database: index files (id, offset, length) over data files, joined with its headers (``_h``).

    The ranges are read by the tasks, each opening the data file at its offsets; no file is read whole.
    """
    from collections.abc import Iterator

    import pandas as pd

    def ranges(part: str) -> DataFrame:
        index = spark.read.schema("id string, at bigint, size bigint").option("sep", "\t").csv(f"{path}{part}.index")

        def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with open(local, "rb") as f:
                for x in frames:
                    texts = []
                    for at, size in zip(x["at"], x["size"], strict=True):
                        f.seek(int(at))
                        texts.append(f.read(int(size)).rstrip(b"\x00\n").decode("utf-8", "replace"))
                    yield pd.DataFrame({"id": x["id"], "text": texts})

        local = local_path(f"{path}{part}")
        return index.mapInPandas(load, "id string, text string")

    heads = ranges("_h").select("id", F.regexp_extract("text", r"^(\S+)", 1).alias("name"))
    return heads.join(ranges("").withColumnRenamed("text", "sequence"), "id").select("name", "sequence")


def read_gold_table(spark: SparkSession, path: str) -> DataFrame:
    """Gold standard of a tab-separated file with header: protein_id, sequence, true_function, true_category, evidence_code; short rows are left out and their number told.

    Returns the rows; a row with fewer fields has a null evidence_code and isn't among them.
    """
    lines = spark.read.text(path).where("value <> ''").withColumn("ord", F.monotonically_increasing_id())
    f = lines.select("ord", F.split("value", "\t").alias("f")).where((F.size("f") >= 5) & (F.col("f")[0] != "protein_id"))
    return f.select("ord", *[F.col("f")[i].alias(n) for i, n in enumerate(("protein_id", "sequence", "true_function", "true_category", "evidence_code"))])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """protein_id, true_category of a ground-truth JSON in any of its layouts: ``entries`` as a list, ``proteins`` by id with category or expected_category."""
    entry = "struct<protein_id:string,true_category:string,category:string,expected_category:string>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"entries array<{entry}>, proteins map<string,{entry}>").alias("j"))
    listed = whole.select(F.explode("j.entries").alias("e")).select("e.protein_id", F.coalesce("e.true_category", "e.category", "e.expected_category").alias("true_category"))
    mapped = whole.select(F.explode("j.proteins").alias("protein_id", "e")).select("protein_id", F.coalesce("e.category", "e.expected_category", "e.true_category").alias("true_category"))
    return listed.unionByName(mapped).where("protein_id is not null and true_category is not null")


def read_lookup_cache(spark: SparkSession, path: str) -> DataFrame:
    """accession, description, gene, organism of a cache JSON by accession; an absent or broken file is an empty cache."""
    entry = "struct<description:string,gene:string,organism:string>"
    if not exists(spark, path):
        return spark.createDataFrame([], "accession string, description string, gene string, organism string")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("accession", "e")).select("accession", "e.*")


def read_protein_search(spark: SparkSession, path: str) -> DataFrame:
    """Hits of a metagenomic search: 16 columns and more, lines with fewer left out."""
    from capsidora.sources.files import read_hits

    return read_hits(spark, path, "esmatlas")


def catalog(folder: str, names: Sequence[str] = ("bfvd", "viro3d", "embeddings", "swissprot")) -> dict[str, str]:
    """Paths of installed databases by name; files are brought there by other means."""
    return {n: f"{folder.rstrip('/')}/{n}" for n in names}


def installed(spark: SparkSession, folder: str) -> dict[str, bool]:
    return {n: exists(spark, p) for n, p in catalog(folder).items()}
