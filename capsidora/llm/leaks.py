"""Evaluation texts that stand, whole or in part, in corpus documents: a prefix-filtered join of shingles.

A case has ``RUN`` words in a row in common. Every window of that many words of an item must then occur whole, with all
of its five-word shingles in a row. In one pass over the corpus, the runs of a document whose shingles may all be shingles of
items (by a Bloom filter of bounded size) are cut out, if they are as long as a window; equal passages are kept once, with
the number of their documents. The shingles of the passages are then ordered by rarity, each window of an item is
represented by its rarest one (the prefix of a containment of one), and passages and windows are joined on it. Its offset in
the window fixes where the window must begin; windows that would leave the passage are dropped, the others compared word by word.

Neither items nor passages come to the driver; only the filters do, of at most 2 ** ``MOST_BITS`` bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsidora.llm.words import blocks, plain_words, shingles, word_hashes
from capsidora.session import settle

RUN, SHINGLE = 12, 5
#: Bits of a Bloom filter for each entry, as powers of two, and the least and most bits of all. Beyond the most the filter lets more pass, which costs time, not rows.
BITS_EACH, LEAST_BITS, MOST_BITS = 4, 16, 28
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def _probes(s: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return s >> shift, (s * _MIX) >> shift


def bloom(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter (64 bits a word) of the only column of ``hashes`` (bigint); built in the tasks, merged by words."""
    n = hashes.distinct().count()
    bits = min(MOST_BITS, max(LEAST_BITS, (n - 1).bit_length() + BITS_EACH))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits - 6, np.uint64)
        for batch in batches:
            for p in _probes(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits):
                np.bitwise_or.at(own, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at].view(np.int64))], names=["word", "bits"])

    out = np.zeros(1 << bits - 6, np.uint64)
    for r in hashes.mapInArrow(mark, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[r.word] = np.int64(r.bits).view(np.uint64)
    return out


def may_hold(filter_: np.ndarray, s: np.ndarray) -> np.ndarray:
    out = np.ones(len(s), bool)
    for p in _probes(s, len(filter_).bit_length() + 5):
        out &= (filter_[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def text_shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row of each word, and the shingle that begins there with whether it ends in the same row."""
    h, row = word_hashes(text)
    s = shingles(h, SHINGLE)
    return row, s, row[: len(s)] == row[SHINGLE - 1 : SHINGLE - 1 + len(s)]


def in_a_row(hit: np.ndarray, least: int) -> np.ndarray:
    """The places of ``hit`` that lie in a stretch of at least ``least`` true ones."""
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    out = np.zeros(len(hit), bool)
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= least:
            out[a:b] = True
    return out


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = RUN) -> DataFrame:
    """doc_id, item_id of every document and item that have at least ``run`` words in a row in common, once each.

    Words are runs of letters and digits in lower case; ``run`` is at least five. Null, empty and wordless texts, items with
    fewer than ``run`` words and empty tables give no rows; rows with a null id take no part; other columns aren't read.
    Repeated documents or items count once by their ids. The corpus is read once and isn't shuffled, only its passages are,
    equal ones once; an item that stands in a third of all documents is compared with its few distinct passages.
    """
    docs = documents.select(F.col(doc_id).alias("d"), plain_words(F.col(text)).alias("t")).where(f"d is not null and length(t) >= {2 * run - 1}")
    tests = items.select(F.col(item_id).alias("i"), plain_words(F.col(item_text)).alias("t")).where(f"i is not null and length(t) >= {2 * run - 1}").distinct()
    kinds = dict(docs.select("d").dtypes)["d"], dict(tests.select("i").dtypes)["i"]
    many = run - SHINGLE + 1

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each window of an item with its shingles."""
        for batch in batches:
            for part in blocks(batch, 1):
                row, s, _ = text_shingles(part.column(1))
                n = max(0, len(row) - run + 1)
                start = np.flatnonzero(row[:n] == row[run - 1 : run - 1 + n])
                if len(start):
                    held = s[start[:, None] + np.arange(many)].view(np.int64)
                    word = [w for t in part.column(1).to_pylist() for w in t.split(" ")]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1, dtype=np.int32) * many), pa.array(held.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[start])), pa.array([" ".join(word[a : a + run]) for a in start.tolist()]), lists], names=["i", "w", "s"])

    wanted = settle(tests.mapInArrow(windows, f"i {kinds[1]}, w string, s array<bigint>"), "windows")
    known = bloom(wanted.select(F.explode("s").alias("s")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The passages of documents that may hold a window."""
        for batch in batches:
            for part in blocks(batch, 1):
                row, s, inside = text_shingles(part.column(1))
                hit = in_a_row(may_hold(known, s) & inside, many)
                # a stretch never goes on from one text to the next: the last places of a text hold no shingle
                edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
                a, b = edges[::2], edges[1::2]
                if len(a):
                    first, held, passages = np.searchsorted(row, row[a]), {}, []
                    for r, z, x, y in zip(row[a].tolist(), first.tolist(), a.tolist(), b.tolist(), strict=True):
                        if r not in held:
                            held = {r: part.column(1)[r].as_py().split(" ")}
                        passages.append(" ".join(held[r][x - z : y - z + SHINGLE - 1]))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[a])), pa.array(passages, pa.string())], names=["d", "p"])

    found = settle(docs.mapInArrow(cut, f"d {kinds[0]}, p string").withColumn("h", F.unhex(F.md5("p"))), "passages")
    passages = settle(found.groupBy("h").agg(F.first("p").alias("p"), F.count("*").alias("n")), "distinct-passages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, 0):
                row, s, inside = text_shingles(part.column(0))
                at = np.flatnonzero(inside)
                yield pa.RecordBatch.from_arrays([pa.array(s[at].view(np.int64)), part.column(1).take(pa.array(row[at]))], names=["s", "n"])

    frequency = passages.select("p", "n").mapInArrow(count, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    # a window with a shingle that no passage has can't occur
    tokens = wanted.select("i", "w", F.posexplode("s").alias("offset", "s")).join(frequency, "s")
    rare = tokens.groupBy("i", "w").agg(F.min(F.struct("n", "s", "offset")).alias("r"), F.count("*").alias("held")).where(f"held >= {many}")
    rare = settle(rare.select("i", "w", F.col("r.s").alias("s"), F.col("r.offset").alias("offset")), "prefixes")
    prefixes = bloom(rare.select("s"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where passages may have a prefix, with the words from which a window there could begin to those where it could end."""
        for batch in batches:
            for part in blocks(batch, 1):
                row, s, inside = text_shingles(part.column(1))
                at = np.flatnonzero(may_hold(prefixes, s) & inside)
                if len(at):
                    word = [w for t in part.column(1).to_pylist() for w in t.split(" ")]
                    first, last = np.searchsorted(row, row[at]), np.searchsorted(row, row[at], side="right")
                    a, b = np.maximum(first, at - (many - 1)), np.minimum(last, at + run)
                    around = pa.array([" ".join(word[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[at])), pa.array(s[at].view(np.int64)), pa.array((at - a).astype(np.int32)), around], names=["h", "s", "before", "around"])

    placed = passages.select("h", "p").mapInArrow(places, "h binary, s bigint, before int, around string")
    fits = placed.join(rare, "s").where("before >= offset")
    same = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("offset") + 1, F.lit(run)), " ") == F.col("w")
    pairs = fits.where(same).select("h", "i").distinct()
    return found.select("d", "h").join(pairs, "h").select(F.col("d").alias(doc_id), F.col("i").alias(item_id)).distinct()
