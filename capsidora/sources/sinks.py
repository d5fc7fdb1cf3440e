"""Writers; tables are written by the tasks in parallel, summaries by the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsidora.session import local_path


def fasta_text(name: Column, sequence: Column, description: Column | None = None, width: int = 60) -> Column:
    head = name if description is None else F.concat_ws(" ", name, F.nullif(F.trim(description), F.lit("")))
    lines = F.regexp_replace(sequence, rf"(.{{{width}}})(?=.)", "$1\n") if width else sequence
    return F.concat(F.lit(">"), head, F.lit("\n"), lines)


def write_fasta(records: DataFrame, path: str, width: int = 60) -> None:
    """id, sequence (and description) as FASTA; ``width`` 0 writes one line each."""
    told = F.col("description") if "description" in records.columns else None
    records.select(fasta_text(F.col("id"), F.col("sequence"), told, width)).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """A table with header; arrays are joined by commas, nulls are empty."""
    flat = [F.array_join(F.col(c), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("sep", sep).option("emptyValue", "").csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, in whatever file system the path names; it replaces an older one at once."""
    jvm = spark._jvm
    part, at = jvm.org.apache.hadoop.fs.Path(f"{path}.part"), jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(at, False)
    if not fs.rename(part, at):
        raise OSError(f"can't write {path}")


def write_summary(tables: dict[str, DataFrame], path: str, most: int = 10_000) -> None:
    """Small tables of a report as one JSON file beside the tables; a table of more than ``most`` rows is an error."""
    out = {}
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        out[name] = [r.asDict(recursive=True) for r in rows]
    if spark is not None:
        put_text(spark, path, json.dumps(out, indent=2, default=str, sort_keys=True))


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the Parquet table at ``path`` doesn't have yet, so that a broken run can be resumed; gives their number."""
    spark = df.sparkSession
    try:
        held = spark.read.parquet(path).select(key)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        held = None
    new = (df if held is None else df.join(held, key, "left_anti")).cache()
    n = new.count()
    new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def write_embeddings(df: DataFrame, path: str, rows: int = 100_000) -> None:
    """protein_id, source_db, embedding as .npz archives of at most so many rows, in a folder that all executors see as a file system."""
    import io
    import os
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd
    from pyspark import TaskContext

    folder = local_path(path)
    os.makedirs(folder, exist_ok=True)

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = part = 0

        def save() -> None:
            nonlocal held, n, part
            if n:
                whole = pd.concat(held)
                out = io.BytesIO()
                np.savez(out, protein_ids=whole.protein_id.astype(str).to_numpy(str), source_dbs=whole.source_db.astype(str).to_numpy(str), embeddings=np.stack(whole.embedding.to_list()).astype(np.float32))
                name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{part:03d}.npz"
                with open(f"{name}.part", "wb") as f:
                    f.write(out.getvalue())
                os.replace(f"{name}.part", name)
            held, n, part = [], 0, part + 1

        for f in frames:
            held.append(f)
            n += len(f)
            if n >= rows:
                save()
        save()
        yield pd.DataFrame({"n": pd.Series([], dtype="int64")})

    df.select("protein_id", "source_db", "embedding").mapInPandas(put, "n bigint").count()
