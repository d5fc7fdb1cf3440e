"""Near-duplicate sequences: banded MinHash candidates, Bayesian pruning of pairs, exact verification, groups.

Equal texts are one class, so copies cost nothing but their membership. Each class gets ``BANDS`` keys of ``WIDTH``
MinHash values; classes that share a key are a candidate pair. ``FRESH`` further values, not used for the keys, are
compared eight at a time: with a uniform prior the posterior probability that the similarity reaches the threshold,
given m agreements among n, is P(Bin(n + 1, threshold) <= m); a pair is dropped when it falls below ``TOLERANCE``.
Only then are the texts of the remaining pairs fetched and verified on the piece sets themselves.

Groups don't need all pairs: each class is first compared with the first class of each of its buckets, so that a family of
any size costs a pair a member and bucket; what these links leave apart within a bucket is then compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsidora.session import settle

PIECE = 5
BANDS, WIDTH, FRESH, LOOK = 64, 3, 48, 8
#: A pair is dropped when its similarity reaches the threshold with less than this probability.
TOLERANCE = 1e-5
#: Sequences whose values are computed at once.
BLOCK_ROWS = 1024
_LETTERS = 26


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return x ^ (x >> np.uint32(15))


def pieces(texts: pa.Array, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of ``size`` letters A to Z, and the row of each; texts hold only A to Z."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, 8 * raw.offset)
    b = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.int64) - 65
    runs = np.maximum(np.diff(offsets) - size + 1, 0)
    row = np.repeat(np.arange(len(raw)), runs)
    at = np.arange(runs.sum()) - np.repeat(np.r_[0, np.cumsum(runs)[:-1]], runs) + (offsets[:-1] - offsets[0])[row]
    code = np.zeros(len(at), np.int64)
    for k in range(size):
        code = code * _LETTERS + b[at + k]
    return code, row


def min_hashes(texts: pa.Array, count: int, seed: int = 5) -> np.ndarray:
    """``count`` MinHash values of each text; every text has a piece."""
    code, row = pieces(texts)
    x = _mixed(code)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    rng = np.random.default_rng(seed)
    factor, shift = rng.integers(0, 1 << 32, (2, count), dtype=np.uint32)
    out = np.empty((len(texts), count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(x * (factor[k] | np.uint32(1)) + shift[k], starts)
    return out


def band_keys(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit key for each ``width`` neighbouring values."""
    v = values.reshape(len(values), -1, width).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, v.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), v.shape[:2]).copy()
    for k in range(width):
        key = (key ^ v[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def fewest_agreements(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """For each number of values compared, the fewest agreements with which a pair stays."""
    out = []
    for n in range(LOOK, FRESH + 1, LOOK):
        below, m = 0.0, -1
        while below < tolerance and m < n:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def likely(a: np.ndarray, b: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """Row numbers of the pairs that no look at their values drops."""
    left = np.arange(len(a))
    agreed = np.zeros(len(a), np.int64)
    for n, m in least:
        agreed = agreed + (a[left, n - LOOK : n] == b[left, n - LOOK : n]).sum(1)
        stay = agreed >= m
        left, agreed = left[stay], agreed[stay]
    return left


def common_share(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of common and of all distinct pieces of each pair of texts."""
    span = _LETTERS**PIECE
    (ca, ra), (cb, rb) = pieces(a), pieces(b)
    ua, ub = np.unique(ra * span + ca), np.unique(rb * span + cb)
    both = np.sort(np.concatenate([ua, ub]))
    common = np.bincount((both[1:][both[1:] == both[:-1]] // span), minlength=len(a))
    total = np.bincount(ua // span, minlength=len(a)) + np.bincount(ub // span, minlength=len(a)) - common
    return common, total


def letters(c: Column) -> Column:
    """A sequence as its letters A to Z in upper case; null is empty."""
    return F.upper(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^A-Za-z]", ""))


def _signed(records: DataFrame, record_id: str, sequence: str) -> tuple[DataFrame, DataFrame]:
    """Membership (record_id, class_id), and classes with text, fresh values and bucket keys."""
    once = records.select(F.col(record_id).cast("string").alias("record_id"), letters(F.col(sequence)).alias("s")).where("record_id is not null")
    once = once.groupBy("record_id").agg(F.max("s").alias("s")).where(F.length("s") >= PIECE)
    once = settle(once.withColumn("class_id", F.unhex(F.md5("s"))), "sequences")
    classes = once.groupBy("class_id").agg(F.first("s").alias("s"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                s = part.column(1)
                values = min_hashes(s, BANDS * WIDTH + FRESH)
                keys = band_keys(values[:, : BANDS * WIDTH], WIDTH)
                fresh = np.ascontiguousarray(values[:, BANDS * WIDTH :].astype(np.uint16))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), s, pa.array([r.tobytes() for r in fresh], pa.binary()), lists], names=["class_id", "s", "fresh", "keys"])

    signed = settle(classes.mapInArrow(sign, "class_id binary, s string, fresh binary, keys array<bigint>"), "signatures")
    return once.select("record_id", "class_id"), signed


def _verified(pairs: DataFrame, signed: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Of candidate pairs (class_a, class_b) those at or above the threshold, with their similarity."""
    least = fewest_agreements(threshold, tolerance)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, FRESH) for i in (2, 3))
                stay = pa.array(likely(a, b, least))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(stay), batch.column(1).take(stay)], names=["class_a", "class_b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                common, total = common_share(part.column(2), part.column(3))
                good = common >= threshold * total
                own = pa.array(good)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(own), part.column(1).filter(own), pa.array(common[good] / total[good])], names=["class_a", "class_b", "similarity"])

    for column, work, kinds in (("fresh", prune, "class_a binary, class_b binary"), ("s", verify, "class_a binary, class_b binary, similarity double")):
        left = signed.select(F.col("class_id").alias("class_a"), F.col(column).alias("x"))
        right = signed.select(F.col("class_id").alias("class_b"), F.col(column).alias("y"))
        pairs = pairs.join(left, "class_a").join(right, "class_b").select("class_a", "class_b", "x", "y").mapInArrow(work, kinds)
    return pairs


def near_duplicates(records: DataFrame, record_id: str, sequence: str, threshold: float = 0.5, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Membership (record_id, class_id) and pairs of classes (class_a, class_b, similarity) at or above ``threshold``.

    Of a sequence only the letters count, in upper case; its pieces are its distinct runs of five letters, and the
    similarity of two is the share of common ones among all distinct ones. Records with equal sequences are one class; a
    record that comes several times counts once, with its greatest sequence. Records with a null id, and those with fewer
    than five letters (null and empty ones too), have no class. Empty tables give empty results; other columns aren't read.
    A pair at the threshold itself is missed with probability (1 - threshold**WIDTH)**BANDS, 0.0002 at one half, and less
    above it. No bucket is capped: hot ones are split by the adaptive skew join.
    """
    membership, signed = _signed(records, record_id, sequence)
    banded = signed.select(F.explode("keys").alias("k"), "class_id")
    pairs = banded.alias("x").join(banded.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.class_id") < F.col("y.class_id")))
    pairs = pairs.select(F.col("x.class_id").alias("class_a"), F.col("y.class_id").alias("class_b")).distinct()
    return membership, _verified(pairs, signed, threshold, tolerance)


def record_pairs(membership: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of records (id_a < id_b) that are in one class or in a pair of classes."""
    one, two = membership.toDF("id_1", "c_1"), membership.toDF("id_2", "c_2")
    across = pairs.join(one, F.col("class_a") == F.col("c_1")).join(two, F.col("class_b") == F.col("c_2"))
    across = across.select(F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"))
    copies = one.join(two, (F.col("c_1") == F.col("c_2")) & (F.col("id_1") < F.col("id_2"))).select(F.col("id_1").alias("id_a"), F.col("id_2").alias("id_b"))
    return across.unionByName(copies)


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component of each node of ``links`` (a, b), by alternating large-star and small-star steps.

    The links are written to the shared folder after each step; no node's links are gathered beyond a minimum.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        root = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(root, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        after = settle(small, "links")
        changed = after.join(edges, ["hi", "lo"], "left_anti").limit(1).count() or edges.join(after, ["hi", "lo"], "left_anti").limit(1).count()
        edges = after
        if not changed:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def near_duplicate_groups(records: DataFrame, record_id: str, sequence: str, threshold: float = 0.5, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per record: record_id and group_id, the smallest record of its group; cases as in :func:`near_duplicates`.

    Groups are the connected components of the pairs that :func:`near_duplicates` finds, without their number: first each
    class is compared with the first class of each of its buckets, a pair a class and bucket however hot that is; then, in
    buckets that still hold several components, all classes of different ones. No pair that could join two components is left out.
    """
    membership, signed = _signed(records, record_id, sequence)
    banded = signed.select(F.explode("keys").alias("k"), "class_id")
    first = banded.groupBy("k").agg(F.min("class_id").alias("class_a"), F.count("*").alias("n")).where("n > 1")
    star = banded.join(first, "k").where("class_id <> class_a").select("class_a", F.col("class_id").alias("class_b")).distinct()
    links = settle(_verified(star, signed, threshold, tolerance).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")), "stars")
    root = settle(components(links), "roots")
    placed = signed.join(root, signed.class_id == root.node, "left").select("class_id", F.coalesce("root", "class_id").alias("c"), F.explode("keys").alias("k"))
    mixed = placed.groupBy("k").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("k")
    open_ = settle(placed.join(mixed, "k", "left_semi"), "mixed")
    rest = open_.alias("x").join(open_.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.class_id") < F.col("y.class_id")) & (F.col("x.c") != F.col("y.c")))
    rest = rest.select(F.col("x.class_id").alias("class_a"), F.col("y.class_id").alias("class_b")).distinct()
    more = _verified(rest, signed, threshold, tolerance).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    whole = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    grouped = membership.join(whole, membership.class_id == whole.node, "left").select("record_id", F.coalesce("root", "class_id").alias("c"))
    names = grouped.groupBy("c").agg(F.min("record_id").alias("group_id"))
    return grouped.join(names, "c").select("record_id", "group_id")
