"""Comparison of predictions with a gold standard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsidora.session import small_side

KNOWN = "{0} is not null and {0} not in ('', 'unknown')"


def evaluated(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold rows (protein_id, truth, ...) with their prediction (predicted, score); ``unknown`` and 0 where there is none."""
    return gold.join(predictions, "protein_id", "left").fillna({"predicted": "unknown", "score": 0.0})


def confusion(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """Sensitivity, specificity, precision, F1, accuracy and MCC; 0 where a denominator is 0."""
    part = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    recall, precision = part(tp, tp + fn), part(tp, tp + fp)
    mcc = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    figures = {
        "sensitivity": recall,
        "specificity": part(tn, tn + fp),
        "precision": precision,
        "f1": part(2.0 * precision * recall, precision + recall),
        "accuracy": part(tp + tn, tp + tn + fp + fn),
        "mcc": part(tp.cast("double") * tn - fp.cast("double") * fn, mcc),
    }
    return [F.round(c, 9).alias(n) for n, c in figures.items()]


def annotated_matrix(rows: DataFrame) -> DataFrame:
    """One row: the matrix of annotated against unknown, with its figures, and how many annotations are right."""
    p, t = F.expr(KNOWN.format("predicted")), F.expr(KNOWN.format("truth"))
    m = rows.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"), F.count_if(p & (F.col("predicted") == F.col("truth"))).alias("correct"))
    return m.select("*", *confusion(*map(F.col, ("tp", "fp", "fn", "tn"))))


def category_matrices(rows: DataFrame) -> DataFrame:
    """A matrix per category, one against the rest, from the contingency table's margins."""
    table = rows.groupBy("predicted", "truth").agg(F.count("*").alias("n"))
    sides = table.select(F.explode(F.array_distinct(F.array("predicted", "truth"))).alias("category"), "predicted", "truth", "n").where(KNOWN.format("category"))
    p, t = F.col("predicted") == F.col("category"), F.col("truth") == F.col("category")
    some = sides.groupBy("category").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(a) for a, c in (("tp", p & t), ("fp", p & ~t), ("fn", ~p & t))])
    total = table.agg(F.sum("n").alias("total"))
    some = some.crossJoin(F.broadcast(total)).withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn")).drop("total")
    return some.select("*", *confusion(*map(F.col, ("tp", "fp", "fn", "tn"))))


def calibration_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, accuracy, confidence of equal bins of the score; an empty one has accuracy 0 and its middle as confidence."""
    right = (F.col("predicted") == F.col("truth")).cast("int")
    held = rows.where(F.col("score").between(0, 1)).groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(right).alias("a"), F.avg("score").alias("c"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(F.broadcast(held), "bin", "left")
    return out.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("a", F.lit(0.0)), 9).alias("accuracy"), F.round(F.coalesce("c", (F.col("bin") + 0.5) / bins), 9).alias("confidence"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row: expected and maximum calibration error and Brier score."""
    held, gap = calibration_bins(rows, bins), F.abs(F.col("accuracy") - F.col("confidence"))
    errors = held.agg(F.round(F.sum(F.col("n") * gap) / F.sum("n"), 8).alias("ece"), F.round(F.max(F.when(F.col("n") > 0, gap)), 8).alias("mce"))
    off = F.col("score") - (F.col("predicted") == F.col("truth")).cast("double")
    return errors.crossJoin(rows.agg(F.round(F.avg(off * off), 8).alias("brier")))


def stratified(rows: DataFrame, strata: list[str]) -> DataFrame:
    """Right annotations and accuracy within each stratum and overall, by grouping sets."""
    sets = [*[[F.col(s)] for s in strata], []]
    p, right = F.expr(KNOWN.format("predicted")), F.col("predicted") == F.col("truth")
    out = rows.groupingSets(sets, *strata).agg(F.count("*").alias("n"), F.count_if(p).alias("annotated"), F.count_if(right).alias("correct"), F.grouping_id().cast("int").alias("level"))
    return out.withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 9))


def head_to_head(rows: DataFrame) -> DataFrame:
    """Counts of where two predictions (predicted, baseline) are right: both, one, neither."""
    a, b = F.col("predicted") == F.col("truth"), F.coalesce(F.col("baseline"), F.lit("unknown")) == F.col("truth")
    return rows.agg(F.count("*").alias("n"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"), F.count_if(~a & ~b).alias("neither"))


def holdout(rows: DataFrame, key: str, stratum: str, share: float = 0.2, seed: str = "42") -> DataFrame:
    """Rows with ``held_out``: of each stratum the floor of its share, at least one, in the order of a seeded digest of the key.

    A histogram of the digests' first digits places each stratum's cut; only the rows of that one bin are ranked.
    """
    marked = rows.withColumn("d__", F.md5(F.concat(F.lit(seed), F.col(key)))).withColumn("b__", F.substring("d__", 1, 3))
    counts = marked.groupBy(stratum, "b__").agg(F.count("*").alias("n"))
    every = Window.partitionBy(stratum)
    cut = counts.withColumns({"wanted": F.greatest(F.lit(1), F.floor(F.sum("n").over(every) * share)), "before": F.sum("n").over(every.orderBy("b__")) - F.col("n")})
    cut = cut.where("before < wanted").select(stratum, "b__", F.when(F.col("before") + F.col("n") > F.col("wanted"), F.col("wanted") - F.col("before")).alias("room"), F.lit(True).alias("in__"))
    placed = marked.join(small_side(cut), [stratum, "b__"], "left")
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("d__", key))
    edge = placed.where("room is not null").withColumn("held_out", rank <= F.col("room"))
    rest = placed.where("room is null").withColumn("held_out", F.coalesce("in__", F.lit(False)))
    return rest.unionByName(edge).select(*rows.columns, "held_out")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (classes x count) of each class."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", F.round(F.col("total") / (F.col("classes") * F.col("n")), 9).alias("weight"))


def macro_f1(rows: DataFrame) -> DataFrame:
    """Mean F1 of the classes that occur as truth."""
    return category_matrices(rows).where("tp + fn > 0").agg(F.round(F.avg("f1"), 8).alias("macro_f1"), F.count("*").alias("classes"))


def label_space(rows: DataFrame, label: str, least: int = 10) -> DataFrame:
    """Labels with at least ``least`` members, numbered by falling frequency."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.withColumn("index", F.row_number().over(Window.orderBy(F.desc("n"), label)) - 1)


def selected(gold: DataFrame, identity: tuple[str, float] | None = None, categories: list[str] | None = None, families: list[str] | None = None) -> DataFrame:
    """Gold rows below an identity to a database (column, greatest value; null identities stay out), of some categories, of some families."""
    out = gold
    if identity is not None:
        out = out.where(F.col(identity[0]) <= identity[1])
    if categories is not None:
        out = out.where(F.col("truth").isin(categories))
    if families is not None:
        out = out.where(F.col("family").isin(families))
    return out


def dark_reduction(rows: DataFrame) -> DataFrame:
    """One row: proteins that baseline and predictions leave unknown, their rates, and the reduction; 0 where a denominator is 0."""
    part = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 9)
    m = rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce("baseline", F.lit("unknown")) == "unknown").alias("baseline_dark"), F.count_if(F.col("predicted") == "unknown").alias("dark"))
    less = F.col("baseline_dark") - F.col("dark")
    return m.select("n", "baseline_dark", part(F.col("baseline_dark"), F.col("n")).alias("baseline_rate"), "dark", part(F.col("dark"), F.col("n")).alias("rate"), less.alias("reduction"), part(less, F.col("baseline_dark")).alias("reduction_rate"))


def three_way(rows: DataFrame) -> DataFrame:
    """Comparison of predictions and baseline with the truth: head to head, dark matter, and the gain in annotation rate, accuracy and F1."""
    own = annotated_matrix(rows).select("tp", "fp", "correct", F.col("f1").alias("f"))
    base = annotated_matrix(rows.withColumn("predicted", F.coalesce("baseline", F.lit("unknown")))).select(F.col("tp").alias("btp"), F.col("fp").alias("bfp"), F.col("correct").alias("bcorrect"), F.col("f1").alias("bf"))
    both = head_to_head(rows).crossJoin(dark_reduction(rows).drop("n")).crossJoin(own).crossJoin(base)
    rate, brate = F.col("tp") + F.col("fp"), F.col("btp") + F.col("bfp")
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return both.select(
        "n", "both", "only_first", "only_second", "neither", "baseline_dark", "dark", "reduction", "reduction_rate",
        F.round(part(rate, F.col("n")) - part(brate, F.col("n")), 9).alias("rate_gain"), F.round(part(F.col("correct"), rate) - part(F.col("bcorrect"), brate), 9).alias("accuracy_gain"), F.round(F.col("f") - F.col("bf"), 9).alias("f1_gain"),
    )


def scorecard(rows: DataFrame, group: str) -> DataFrame:
    """Proteins, annotated and right ones, and accuracy of each value of a column."""
    p, right = F.expr(KNOWN.format("predicted")), F.col("predicted") == F.col("truth")
    out = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(p).alias("annotated"), F.count_if(right).alias("correct"))
    return out.withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 9))


def identity_bins(hits: DataFrame, bin_: Column) -> DataFrame:
    """bin, best_hits, hits, mean_identity, mean_evalue: hits by a bin of identity, and the queries whose best hit (smallest e-value, then target) is in it."""
    h = hits.withColumn("bin", bin_)
    best = h.groupBy("query").agg(F.min(F.struct("evalue", "target", "source_db", "fident", "bin")).alias("b")).select("b.*")
    some = best.groupBy("bin").agg(F.count("*").alias("best_hits"), F.round(F.avg("fident"), 9).alias("mean_identity"), F.round(F.avg("evalue"), 9).alias("mean_evalue"))
    every = h.groupBy("bin").agg(F.count("*").alias("hits"))
    return every.join(some, "bin", "left").select("bin", F.coalesce("best_hits", F.lit(0)).alias("best_hits"), "hits", F.coalesce("mean_identity", F.lit(0.0)).alias("mean_identity"), F.coalesce("mean_evalue", F.lit(0.0)).alias("mean_evalue"))


def matched_ids(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """query, key: the truth's key (key) of each query (query): its own id, else its first field, else a key of which it is the beginning or that begins it (the smallest).

    Beginnings are joined as texts of the lengths that occur, not by comparing all with all.
    """
    keys = truth.select("key").where("key is not null").distinct()
    q = queries.select("query").where("query is not null").distinct()
    own = q.join(keys, F.col("query") == F.col("key")).select("query", "key")
    rest = q.join(own.select("query"), "query", "left_anti")
    field = rest.join(keys, F.substring_index("query", "|", 1) == F.col("key")).select("query", "key")
    rest = rest.join(field.select("query"), "query", "left_anti")
    begins = lambda df, c, lengths: df.select(c, F.explode(F.array_distinct(F.filter(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(F.length(c) >= n, F.substring(F.col(c), F.lit(1), n))), lambda x: x.isNotNull()))).alias("begin"))
    lengths = lambda df, c: sorted(r[0] for r in df.select(F.length(c)).distinct().collect())
    found = own.unionByName(field)
    lk, lq = lengths(keys, "key"), lengths(rest, "query")
    if lk and lq:
        longer = begins(rest, "query", lk).join(keys, F.col("begin") == F.col("key")).select("query", "key")
        shorter = begins(keys, "key", lq).join(rest, F.col("begin") == F.col("query")).select("query", "key")
        found = found.unionByName(longer.unionByName(shorter).groupBy("query").agg(F.min("key").alias("key")))
    return found


def _sums(vectors: DataFrame) -> DataFrame:
    """label, s (the sum of its vectors), n; unit vectors (id, embedding, label)."""
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("s"), F.max("n").alias("n"))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.select("id", F.transform("embedding", lambda x: x.cast("double") / size).alias("embedding"), "label")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _with_sums(vectors: DataFrame) -> DataFrame:
    own = _sums(vectors)
    whole = _sums(vectors.withColumn("label", F.lit(0))).select(F.col("s").alias("all_s"), F.col("n").alias("all_n"))
    return own.crossJoin(F.broadcast(whole))


def class_cosines(vectors: DataFrame) -> DataFrame:
    """label, n, intra_cos, inter_cos: mean cosine of pairs within each label (of two and more) and to all others, over all vectors, from the labels' sums alone."""
    s = _with_sums(unit_vectors(vectors)).where("n > 1")
    within, n, total = _dot(F.col("s"), F.col("s")), F.col("n"), F.col("all_n")
    across = _dot(F.col("s"), F.col("all_s")) - within
    return s.select("label", "n", F.round((within - n) / (n * (n - 1)), 8).alias("intra_cos"), F.round(F.when(total > n, across / (n * (total - n))), 8).alias("inter_cos"))


def silhouette(vectors: DataFrame) -> DataFrame:
    """One row: the mean over all vectors of (b - a) / max(a, b), with a and b the mean cosine distances to its label's others and to all other labels; vectors without one of them don't count."""
    unit = unit_vectors(vectors)
    rows = unit.join(small_side(_with_sums(unit)), "label").where("n > 1 and all_n > n")
    own, whole = _dot(F.col("embedding"), F.col("s")), _dot(F.col("embedding"), F.col("all_s"))
    a, b = 1 - (own - 1) / (F.col("n") - 1), 1 - (whole - own) / (F.col("all_n") - F.col("n"))
    return rows.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg((b - a) / F.greatest(a, b)), F.lit(0.0)), 8).alias("silhouette"))
