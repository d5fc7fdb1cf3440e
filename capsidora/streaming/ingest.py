"""Proteins and hits that arrive as files, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from capsidora import schemas
from capsidora.functions import scoring, sequences
from capsidora.sources.files import parse_fasta


def protein_stream(spark: SparkSession, folder: str) -> DataFrame:
    """id, description, sequence of FASTA files dropped into a folder; cleaned as the batch reader does, without renaming."""
    raw = spark.readStream.option("lineSep", "\n>").text(folder).withColumn("ord", F.lit(0))
    return parse_fasta(raw).withColumn("sequence", sequences.clean_protein(F.col("sequence"))).where(F.length("sequence") > 0).drop("ord")


def hit_stream(spark: SparkSession, folder: str, annotations: DataFrame) -> DataFrame:
    """Scored hits of tab-separated files dropped into a folder, joined with a static annotation table (target, description)."""
    hits = spark.readStream.schema(schemas.HITS).option("sep", "\t").csv(folder)
    quality = scoring.hit_quality(F.col("evalue"), F.col("fident"), F.col("qcov"))
    return hits.join(annotations, "target", "left").withColumn("quality", F.round(quality, 9))


def hourly_counts(events: DataFrame, at: str = "searched_at", late: str = "2 hours") -> DataFrame:
    """Hits per database and hour of search; rows later than ``late`` are left out by the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 hour"), "source_db").agg(F.count("*").alias("n"), F.min("evalue").alias("best_evalue"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there as Parquet, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
