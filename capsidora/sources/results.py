"""Result tables in their file layouts, and writing and reading them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsidora.functions import sequences
from capsidora.sources import sinks

# The columns of the result tables, in order.
HIT_COLUMNS = "query_id query_length description confidence_level source_db target_id evalue identity coverage bits organism gene uniprot_id pdb_id num_hits".split()
CONSENSUS_COLUMNS = (
    "query_id query_length description confidence_level consensus_score agreement functional_category classification_source novelty structure_quality_score structure_quality_source "
    "primary_source primary_target primary_evalue primary_identity primary_coverage secondary_source secondary_target secondary_evalue secondary_identity organism gene uniprot_id pfam "
    "go_bp go_bp_ids go_mf go_mf_ids go_cc go_cc_ids superfamily bfvd_hits viro3d_hits disorder_fraction disorder_class disorder_regions go_transfer_ri go_transfer_best_match "
    "go_transfer_similarity go_evidence_codes dual_validation is_cross_domain cross_domain_organism"
).split()
DARK_COLUMNS = "query_id query_length category reason best_evalue best_identity confidence_level consensus_score description databases_with_hits disorder_class disorder_fraction".split()
CROSS_COLUMNS = "query_id query_length description functional_category go_transfer_ri go_transfer_best_match go_transfer_similarity go_evidence_codes dual_validation cross_domain_organism".split()
#: Columns written with three decimals.
ROUNDED = {"consensus_score", "structure_quality_score", "disorder_fraction", "go_transfer_ri", "go_transfer_similarity"}
def in_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns that exist, in order, then all others."""
    first = [c for c in columns if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in columns])


def flat(df: DataFrame) -> DataFrame:
    """A wide result as one flat row: arrays joined by commas, figures rounded as they are written; every column stays, empty where it isn't set."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(name)
        if name in ROUNDED:
            c = F.round(c, 3)
        return (F.array_join(c, ",") if kind.startswith("array") else c).alias(name)

    return df.select(*[cell(n, k) for n, k in df.dtypes])


def consensus_table(results: DataFrame, unannotated: bool = True) -> DataFrame:
    """All 43 columns of the consensus table in order, null where a step didn't run, then extra ones; without ``unannotated`` only proteins with a hit."""
    missing = {c: F.lit(None).cast("string") for c in CONSENSUS_COLUMNS if c not in results.columns}
    out = results.withColumns(missing) if missing else results
    out = out if unannotated else out.where("primary_target is not null")
    return in_order(flat(out.drop("databases")), CONSENSUS_COLUMNS)


def hit_table(results: DataFrame, unannotated: bool = True) -> DataFrame:
    """The table of single-hit transfer: its leading columns, then extra ones."""
    out = results if unannotated else results.where("target_id is not null")
    return in_order(flat(out), HIT_COLUMNS)


def _unless_zero(c: Column) -> Column:
    return F.when(c != 0, c)


def dark_table(dark: DataFrame) -> DataFrame:
    """Unexplained proteins (a consensus table with dark_category); figures that are zero are empty."""
    has = lambda n, kind: F.col(n) if n in dark.columns else F.lit(None).cast(kind)
    weak = F.format_string("Only weak structural homologs (e-value: %.2e, identity: %.1f%%)", F.coalesce("primary_evalue", F.lit(0.0)), F.coalesce("primary_identity", F.lit(0.0)) * 100)
    reason = (
        F.when(F.col("dark_category") == "no_hits", "No structural homologs detected in any database")
        .when(F.col("dark_category") == "unknown_function", "Structural homologs found but function is uncharacterized")
        .when(F.col("functional_category") == "unknown", weak)
        .otherwise(F.format_string("Low confidence annotation (score: %.3f)", "consensus_score"))
    )
    databases = F.array_join("databases", ",") if dict(dark.dtypes).get("databases", "").startswith("array") else has("databases", "string")
    values = [
        F.col("query_id"), F.col("query_length"), F.col("dark_category"), reason, _unless_zero(F.col("primary_evalue")), _unless_zero(F.col("primary_identity")), F.col("confidence_level"),
        F.when(F.col("consensus_score") > 0, F.col("consensus_score")), F.col("description"), F.coalesce(databases, F.lit("")), F.nullif(has("disorder_class", "string"), F.lit("")), F.round(has("disorder_fraction", "double"), 3),
    ]
    return dark.select(*[v.alias(n) for v, n in zip(values, DARK_COLUMNS, strict=True)])


def cross_domain_table(results: DataFrame) -> DataFrame:
    """Proteins whose best donor of GO terms isn't viral."""
    missing = {c: F.lit(None).cast("string") for c in CROSS_COLUMNS if c not in results.columns}
    out = (results.withColumns(missing) if missing else results).where("is_cross_domain")
    three = lambda c: F.round(_unless_zero(F.col(c)), 3).alias(c)
    return out.select(*[three(c) if c in ("go_transfer_ri", "go_transfer_similarity") and dict(out.dtypes)[c] != "string" else F.col(c) for c in CROSS_COLUMNS])


def predictions(df: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of predicted structures (id, three_di, scores): raw and masked sequences (id, sequence) and mean confidences (id, length, mean_confidence with four decimals)."""
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
    mean = F.when(F.size("scores") > 0, total / F.size("scores")).otherwise(0.0)
    raw = df.where("three_di is not null")
    return raw.select("id", F.col("three_di").alias("sequence")), raw.select("id", sequences.mask(F.col("three_di"), F.col("scores"), threshold).alias("sequence")), raw.select("id", F.length("three_di").alias("length"), F.format_string("%.4f", mean).alias("mean_confidence"))


def write_predictions(df: DataFrame, folder: str, threshold: float = 0.7) -> None:
    raw, masked, mean = predictions(df, threshold)
    sinks.write_fasta(raw, f"{folder}/raw_3di.fasta", 0)
    sinks.write_fasta(masked, f"{folder}/masked_3di.fasta", 0)
    sinks.write_table(mean, f"{folder}/confidence.tsv")


def search_database(records: DataFrame, spark: SparkSession | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A search database of records (id, sequence): data lines, index (i, offset, length) and lookup (i, id, i), in the order of ids.

    Entries are a sequence, a line end and a zero byte. Offsets are running sums, taken range by range: ranges are sorted and summed,
    and of each range one sum goes to the driver.
    """
    from capsidora.operators.export import numbered

    rows = numbered(records.select("id", "sequence", (F.octet_length("sequence") + 2).alias("size")), ["id"], "i")
    block = F.floor(F.col("i") / 65536)
    from pyspark.sql import Window

    inner = Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("block", block).withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    sums = placed.groupBy("block").agg(F.sum("size").alias("s"))
    before = sums.alias("a").join(sums.alias("b"), F.col("b.block") < F.col("a.block"), "left").groupBy(F.col("a.block").alias("block")).agg(F.coalesce(F.sum("b.s"), F.lit(0)).alias("before"))
    index = placed.join(before, "block").select("i", (F.col("before") + F.col("within")).alias("offset"), F.col("size").alias("length"), "id", "sequence")
    return index.select("i", "sequence"), index.select("i", "offset", "length"), index.select("i", "id", F.lit(0).alias("file"))


def write_search_database(records: DataFrame, path: str, kind: int = 0) -> None:
    """Files ``path``, ``.index``, ``.dbtype``, ``.lookup`` and the header database ``path_h``, on a folder that the driver sees; rows stream through it one at a time."""
    import struct

    def put(part: DataFrame, name: str, dbtype: int) -> None:
        data, index, lookup = search_database(part)
        with open(name, "wb") as f:
            for r in data.orderBy("i").toLocalIterator(prefetchPartitions=True):
                f.write(r.sequence.encode() + b"\n\x00")
        with open(f"{name}.index", "w") as f:
            for r in index.orderBy("i").toLocalIterator():
                f.write(f"{r.i}\t{r.offset}\t{r.length}\n")
        with open(f"{name}.dbtype", "wb") as f:
            f.write(struct.pack("<i", dbtype))
        if name == path:
            with open(f"{name}.lookup", "w") as f:
                for r in lookup.orderBy("i").toLocalIterator():
                    f.write(f"{r.i}\t{r.id}\t{r.file}\n")

    put(records, path, kind)
    put(records.select("id", F.col("id").alias("sequence")), f"{path}_h", 12)


def run_summary(results: DataFrame) -> DataFrame:
    """One row: proteins, annotated ones and their share, and least, greatest, mean and median of the consensus scores."""
    told = F.col("primary_target").isNotNull()
    return results.agg(F.count("*").alias("proteins"), F.count_if(told).alias("annotated"), F.round(F.coalesce(F.avg(told.cast("double")), F.lit(0.0)), 9).alias("share"), F.min(F.when(told, F.col("consensus_score"))).alias("least_score"), F.max(F.when(told, F.col("consensus_score"))).alias("greatest_score"), F.round(F.avg(F.when(told, F.col("consensus_score"))), 9).alias("mean_score"), F.round(F.percentile(F.when(told, F.col("consensus_score")), 0.5), 9).alias("median_score"))


def alignment_summary(files: dict[str, str], sequences_: int, columns: int) -> str:
    """The summary of a structural alignment as JSON text."""
    return json.dumps({"alignment_length": columns, "files": dict(sorted(files.items())), "n_sequences": sequences_}, indent=2, sort_keys=True)


def dataset_json(gold: DataFrame, name: str) -> DataFrame:
    """A benchmark dataset as lines of JSON, one record each, with the dataset's name."""
    return gold.select(F.to_json(F.struct(F.lit(name).alias("dataset"), *gold.columns)).alias("value"))


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """A result table with header; figures as numbers, all else as text."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    numbers = {"query_length": "int", "bfvd_hits": "int", "viro3d_hits": "int", "num_hits": "int", "start": "int", "end": "int", "strand": "int", "is_cross_domain": "boolean"}
    doubles = {"consensus_score", "structure_quality_score", "primary_evalue", "primary_identity", "primary_coverage", "secondary_evalue", "secondary_identity", "disorder_fraction", "go_transfer_ri", "go_transfer_similarity", "evalue", "identity", "coverage", "bits"}
    return raw.select(*[F.col(f"`{c}`").try_cast("double" if c in doubles else numbers.get(c, "string")).alias(c) for c in raw.columns])
