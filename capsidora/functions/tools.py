"""External programs behind one wrapper; their results are read as tables."""

from __future__ import annotations

import shutil
import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capsidora import schemas
from capsidora.sources import files

# Bounds of a search.
EVALUE, SENSITIVITY, MOST = 1e-3, 9.5, 1000
#: What a search writes, in order.
OUTPUT = ",".join(schemas.HITS.names)


@dataclass
class Result:
    code: int
    out: str
    err: str

    @property
    def good(self) -> bool:
        return self.code == 0


class Tool:
    """A program on the path or at a place of its own."""

    def __init__(self, name: str, path: str | None = None) -> None:
        self.name, self.path = name, path or shutil.which(name)

    @property
    def available(self) -> bool:
        return self.path is not None and Path(self.path).exists()

    def run(self, *args: object, folder: str | None = None, timeout: float | None = None, check: bool = False) -> Result:
        """The program's code and output; code 127 where it is absent, 124 after ``timeout`` seconds. With ``check`` a failure is an error."""
        if not self.available:
            result = Result(127, "", f"{self.name} isn't installed")
        else:
            try:
                p = subprocess.run([self.path, *map(str, args)], cwd=folder, capture_output=True, text=True, timeout=timeout, check=False)
                result = Result(p.returncode, p.stdout, p.stderr)
            except subprocess.TimeoutExpired:
                result = Result(124, "", f"{self.name} took more than {timeout} s")
        if check and not result.good:
            raise RuntimeError(result.err)
        return result

    def version(self, flag: str = "version") -> str | None:
        r = self.run(flag, timeout=30)
        return r.out.strip().splitlines()[0] if r.good and r.out.strip() else None


def limited(hits: DataFrame, evalue: float = EVALUE, most: int = MOST) -> DataFrame:
    """Hits at or below an e-value, at most so many of each query: those of smallest e-value, then largest bits, then smaller target."""
    place = F.row_number().over(Window.partitionBy("query").orderBy("evalue", F.desc_nulls_last("bits"), "target"))
    return hits.where(F.col("evalue") <= evalue).withColumn("r__", place).where(F.col("r__") <= most).drop("r__")


def search(spark: SparkSession, query_db: str, database: str, folder: str, source_db: str, tool: Tool | None = None, evalue: float = EVALUE, sensitivity: float = SENSITIVITY, most: int = MOST, threads: int = 4, timeout: float | None = None) -> DataFrame:
    """Hits of a structural search by the external program; a search that fails or can't run gives an empty table."""
    tool = tool or Tool("foldseek")
    found, table = f"{folder}/{source_db}_hits", f"{folder}/{source_db}_hits.tsv"
    Path(folder).mkdir(parents=True, exist_ok=True)
    done = tool.run("search", query_db, database, found, f"{folder}/tmp_{source_db}", "-e", evalue, "-s", sensitivity, "--max-seqs", most, "--threads", threads, "-a", timeout=timeout)
    done = tool.run("convertalis", query_db, database, found, table, "--format-output", OUTPUT, "--threads", threads, timeout=timeout) if done.good else done
    if not done.good or not Path(table).exists():
        return spark.createDataFrame([], schemas.HITS).withColumn("source_db", F.lit(source_db))
    return files.read_hits(spark, f"file://{Path(table).absolute()}", source_db)


def search_all(spark: SparkSession, query_db: str, databases: dict[str, str], folder: str, **options: object) -> DataFrame:
    """Hits of several databases as one table; those whose search failed have none."""
    out = None
    for name, path in databases.items():
        own = search(spark, query_db, path, folder, name, **options)
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no database")
    return out


def structural_alignment(query_db: str, prefix: str, tool: Tool | None = None, threads: int = 4, refine: int = 0) -> dict[str, str]:
    """Files of a structural alignment of a query database by the external program: amino acids, structure states, guide tree; empty where it fails."""
    tool = tool or Tool("foldmason")
    done = tool.run("structuremsa", query_db, prefix, "--threads", threads, *(["--refine-iters", refine] if refine else []))
    wanted = {"aa": f"{prefix}_aa.fa", "3di": f"{prefix}_3di.fa", "tree": f"{prefix}.nw"}
    return {k: p for k, p in wanted.items() if done.good and Path(p).exists()}


def spliced_alignment(spark: SparkSession, contigs: str, proteins: str, folder: str, tool: Tool | None = None, threads: int = 4) -> DataFrame | None:
    """Gene models of proteins aligned to contigs by the external program; none where it is absent or fails."""
    from capsidora.sources import genomes

    tool = tool or Tool("miniprot")
    done = tool.run("--gff", "-t", threads, contigs, proteins)
    if not done.good:
        return None
    path = Path(folder) / "spliced.gff3"
    path.write_text("\n".join(x for x in done.out.splitlines() if not x.startswith("##PAF")))
    return genomes.spliced_genes(files.read_gff(spark, str(path))[0])
