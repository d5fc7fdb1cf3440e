"""Samples whose categories follow target proportions.

Of each category an acceptance probability comes from the ratio of wanted to observed records, a little above it;
records are accepted independently, by a hash of their identifier that is the same in every run. Counts are then corrected
to the exact number: a histogram of the accepted hashes places the cut in one narrow bin, and only that bin is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsidora.session import settle, small_side

#: Bins in which the accepted part of the hash range is counted; ranking touches one of them per category.
BINS = 4096
#: Standard deviations by which acceptance exceeds the wanted number.
OVERSAMPLE = 6.0
_RANGE = float(1 << 52)


def category_key(c: Column) -> Column:
    """A category without regard to case, white space around it and how its words are joined; null and blank are ``unknown``."""
    key = F.regexp_replace(F.regexp_replace(F.lower(c.cast("string")), r"^[\s\u00a0_-]+|[\s\u00a0_-]+$", ""), r"[\s\u00a0_-]+", "_")
    return F.when(F.coalesce(key, F.lit("")) == "", "unknown").otherwise(key)


def spin(*parts: Column, seed: int) -> Column:
    """A number from 0 to below 1 that depends on the parts alone: the first 52 bits of a digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / _RANGE


def draw(records: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """A sample and its report.

    ``records``: record_set, record_id, category, each record once. ``targets``: record_set, category, target_share,
    min_rows, sample_size. The sample has the columns of ``records``, the category spelt as in ``targets``. The report has a
    row per target: record_set, category, wanted, observed, taken, deficit. Wanted is the greater of min_rows and
    target_share x sample_size rounded half up; null parts count as 0. Taken is counted in the drawn sample, and the deficit is
    what it lacks. Of a category with fewer records than wanted all are taken. Records with a null id or set take no part; a
    category without a target gives no sample rows; targets that name one category in two spellings count once, with the
    greater number. Empty records make every target fall short; empty targets give an empty sample and report.

    ``records`` is read once: its keys and hashes are written to the shared folder, and so are the accepted ones.
    """
    wants = targets.where("record_set is not null").select(
        "record_set",
        F.col("category").alias("spelling"),
        category_key(F.col("category")).alias("key"),
        F.greatest(F.coalesce(F.col("min_rows").cast("long"), F.lit(0)), F.floor(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)) * F.coalesce(F.col("sample_size").cast("long"), F.lit(0)) + 0.5)).alias("wanted"),
    )
    wants = wants.groupBy("record_set", "key").agg(F.min("spelling").alias("spelling"), F.max("wanted").alias("wanted"))
    by = ["record_set", "key"]
    keyed = records.where("record_set is not null and record_id is not null").select("record_set", F.col("record_id").cast("string").alias("record_id"), category_key(F.col("category")).alias("key"))
    keyed = settle(keyed.withColumn("spin", spin(F.col("record_set"), F.col("record_id"), seed=seed)), "records")
    observed = keyed.groupBy(*by).agg(F.count("*").alias("observed"))
    plan = wants.join(observed, by, "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    aim = F.col("wanted") + OVERSAMPLE * F.sqrt("wanted") + OVERSAMPLE * OVERSAMPLE
    plan = settle(plan.withColumn("rate", F.when(F.col("observed") <= aim, 1.0).otherwise(aim / F.col("observed"))), "targets")

    accepted, counts = _accept(keyed, plan)
    got = counts.groupBy(*by).agg(F.sum("n").alias("got"))
    short = plan.join(got, by, "left").where("coalesce(got, 0) < least(wanted, observed)").select(*by, F.lit(1.0).alias("whole"))
    if not short.isEmpty():  # too few accepted by chance (about once in 10^9 categories): such a category is accepted whole
        plan = settle(plan.join(short, by, "left").withColumn("rate", F.coalesce("whole", "rate")).drop("whole"), "targets")
        accepted, counts = _accept(keyed, plan)

    upto = Window.partitionBy(*by).orderBy("bin")
    running = counts.withColumn("before", F.coalesce(F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = running.join(plan.select(*by, "spelling", "wanted"), by).where("before < wanted").select(*by, "bin", "spelling", (F.col("wanted") - F.col("before")).alias("room"), "n")
    placed = accepted.join(small_side(settle(cut, "cuts")), [*by, "bin"])
    ranked = placed.where("n > room").withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("spin", "record_id"))).where("r <= room")
    sample = placed.where("n <= room").select("record_set", "record_id", F.col("spelling").alias("category")).unionByName(ranked.select("record_set", "record_id", F.col("spelling").alias("category")))

    taken = sample.groupBy("record_set", "category").agg(F.count("*").alias("taken"))
    report = plan.select("record_set", F.col("spelling").alias("category"), "wanted", "observed").join(taken, ["record_set", "category"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return sample, report.withColumn("deficit", F.col("wanted") - F.col("taken"))


def _accept(keyed: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The accepted records with the bin of their hash, and the number of records of each bin."""
    accepted = keyed.join(small_side(plan.select("record_set", "key", "rate")), ["record_set", "key"]).where("spin < rate")
    accepted = settle(accepted.withColumn("bin", F.least(F.floor(F.col("spin") / F.col("rate") * BINS), F.lit(BINS - 1))).drop("rate"), "accepted")
    return accepted, accepted.groupBy("record_set", "key", "bin").agg(F.count("*").alias("n"))
