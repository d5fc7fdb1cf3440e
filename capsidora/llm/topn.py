"""Top N items within every group, by simultaneous bisection of per-group cutoffs.

Scores become unsigned 64-bit codes whose order is the wanted order; the identifier follows as further
codes of eight bytes each. For all groups of a block at once, the interval of every group's cutoff is halved
by counting the rows at or below its midpoint, until a group holds exactly N rows or its cutoff is a single
code; rows tied at a cutoff go on to the next code. A block keeps at most N rows of a group, so a group that
holds a third of all rows sends N rows per block to the exchange instead of all its rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block that is bisected at once.
BLOCK_ROWS = 1 << 17
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def rising_code(values: np.ndarray) -> np.ndarray:
    """uint64 codes in the order of the doubles; -0.0 equals 0.0 and NaN comes last."""
    v = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = np.ascontiguousarray(v, dtype=np.float64).view(np.uint64)
    sign = np.uint64(1) << np.uint64(63)
    return np.where(bits & sign, ~bits, bits | sign)


def score_code(values: np.ndarray, valid: np.ndarray, descending: bool) -> np.ndarray:
    """Codes of a score column: ascending or descending, missing and NaN values last in either direction."""
    code = rising_code(-values if descending else values)
    return np.where(valid & ~np.isnan(values), code, TOP)


def text_codes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Codes of eight bytes each, then the length, in byte order of the texts."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    words = max(1, -(-int(size.max(initial=1)) // 8))
    packed = np.array(texts, dtype=f"S{8 * words}").view(">u8").reshape(len(texts), words)
    for w in range(words):
        yield packed[:, w].astype(np.uint64)
    yield size.astype(np.uint64)


def cutoffs(code: np.ndarray, group: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Of each group, a code at or below which it has ``need`` rows or, with ties, the least with more.

    Every group has at least ``need`` rows. All groups are halved at once; a group leaves when it is exact.
    """
    cut = np.full(len(need), TOP, np.uint64)
    lo = np.full(len(need), code.min() if len(code) else 0, np.uint64)
    hi = np.full(len(need), code.max() if len(code) else 0, np.uint64)
    open_ = np.ones(len(need), bool)
    while open_.any():
        mid = lo + ((hi - lo) >> np.uint64(1))
        held = np.bincount(group[code <= mid[group]], minlength=len(need))
        enough = held >= need
        done = open_ & ((held == need) | (enough & (lo >= hi)))
        cut[done] = mid[done]
        hi = np.where(enough, mid, hi)
        lo = np.where(enough, lo, np.minimum(mid, TOP - np.uint64(1)) + np.uint64(1))
        open_ &= ~done
        live = open_[group]
        if 2 * np.count_nonzero(live) < len(live):
            code, group = code[live], group[live]
    return cut


def keep_first(group: np.ndarray, n: int, codes: Sequence[np.ndarray], texts: list[bytes] | None = None) -> np.ndarray:
    """Row numbers of the first ``n`` rows of each group in the order of the codes, then of the texts; further ties by row number."""
    sizes = np.bincount(group)
    kept = [np.flatnonzero(sizes[group] <= n)]
    rows = np.flatnonzero(sizes[group] > n)
    need = np.where(sizes > n, n, 0)

    def step(rows: np.ndarray, code: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, g = np.unique(group[rows], return_inverse=True)
        cut = cutoffs(code, g, need[ids])
        below = code <= cut[g]
        fits = np.bincount(g[below], minlength=len(ids)) == need[ids]
        at = code == cut[g]
        take = below & (fits[g] | ~at)
        kept.append(rows[take])
        left = need.copy()
        left[ids] -= np.bincount(g[take], minlength=len(ids))
        return rows[below & ~take], left

    for code in codes:
        if len(rows):
            rows, need = step(rows, code[rows], need)
    if texts is not None and len(rows):
        first = rows
        for code in text_codes([texts[r] for r in first]):
            if not len(rows):
                break
            rows, need = step(rows, code[np.searchsorted(first, rows)], need)
    if len(rows):
        rows, need = step(rows, rows.astype(np.uint64), need)
    return np.sort(np.concatenate(kept))


def _codes(batch: pa.Table, keys: int, order: Sequence[bool]) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
    """Group numbers, score codes and identifiers of a block (columns: keys, scores, identifier)."""
    group = np.zeros(len(batch), np.int64)
    for k in range(keys):
        code = batch.column(k).combine_chunks().dictionary_encode()
        group = np.unique(group * (len(code.dictionary) + 1) + code.indices.to_numpy(), return_inverse=True)[1]
    codes = []
    for i, descending in enumerate(order):
        c = batch.column(keys + i).combine_chunks()
        codes.append(score_code(c.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(float), c.is_valid().to_numpy(zero_copy_only=False), descending))
    names = batch.column(keys + len(order)).combine_chunks().cast(pa.binary()).to_pylist()
    return group, codes, names


def best(batch: pa.Table, keys: int, order: Sequence[bool], n: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """At most ``n`` rows of each group with distinct identifiers, in order, with their groups and ranks."""
    group, codes, names = _codes(batch, keys, order)
    item = batch.column(keys + len(order)).combine_chunks().dictionary_encode()
    pair = np.unique(group * (len(item.dictionary) + 1) + item.indices.to_numpy(), return_inverse=True)[1]
    own = keep_first(pair, 1, codes)
    group, codes, names = group[own], [c[own] for c in codes], [names[i] for i in own]
    kept = keep_first(group, n, codes, names)
    group, codes, names = group[kept], [c[kept] for c in codes], [names[i] for i in kept]
    by_name = np.empty(len(kept), np.int64)
    by_name[sorted(range(len(kept)), key=names.__getitem__)] = np.arange(len(kept))
    at = np.lexsort([by_name, *codes[::-1], group])
    group = group[at]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(at) else np.empty(0, np.int64)
    rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)])) + 1
    return batch.take(pa.array(own[kept][at])), group, rank


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def top_n_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[tuple[str, str]], item: str, n: int, rank: str = "rank", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``n`` best distinct items of every group: columns ``groups``, ``rank`` (from 1), ``item``.

    ``order``: (column, "asc" or "desc") of numeric columns; missing and NaN scores come last, ties go to the smaller
    item in byte order. An item counts once per group, with its best row; repeated rows don't matter. Rows with a null
    group column, a null item or a null first score take no part. Empty groups and empty tables give no rows. Other
    columns of ``df`` aren't read, whatever their names. ``groups`` and ``item`` are read as strings.

    One exchange: blocks of ``block_rows`` rows are cut to ``n`` rows a group before it; behind it the groups come
    sorted, so that only one group at a time is carried from block to block.
    """
    keys, descending = len(groups), [d == "desc" for _, d in order]
    cols = [*[F.col(c).cast("string").alias(f"g{i}") for i, c in enumerate(groups)], *[F.col(c).cast("double").alias(f"s{i}") for i, (c, _) in enumerate(order)], F.col(item).cast("string").alias("item")]
    rows = df.select(*cols).where(" and ".join(f"{c} is not null" for c in [*[f"g{i}" for i in range(keys)], "s0", "item"]))
    schema = rows.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, block_rows):
            yield from best(block, keys, descending, n)[0].to_batches()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None
        for block in _blocks(batches, block_rows):
            block = pa.concat_tables([carried, block]) if carried is not None else block
            last = np.ones(len(block), bool)
            for k in range(keys):
                c = block.column(k).combine_chunks().dictionary_encode().indices.to_numpy()
                last &= c == c[-1]
            kept, _, place = best(block.filter(pa.array(~last)), keys, descending, n)
            carried = best(block.filter(pa.array(last)), keys, descending, n)[0]
            yield from ranked(kept, place)
        if carried is not None:
            yield from ranked(carried, np.arange(1, len(carried) + 1))

    def ranked(kept: pa.Table, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(kept):
            yield from pa.table([*kept.columns[:keys], pa.array(place.astype(np.int32)), kept.column("item")], names=names).to_batches()

    names = [*groups, rank, item]
    out = T.StructType([*[T.StructField(g, T.StringType()) for g in groups], T.StructField(rank, T.IntegerType()), T.StructField(item, T.StringType())])
    by = [f"g{i}" for i in range(keys)]
    return rows.mapInArrow(cut, schema).repartition(*by).sortWithinPartitions(*by).mapInArrow(finish, out)
