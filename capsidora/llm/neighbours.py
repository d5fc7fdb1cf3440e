"""The most similar vectors of every vector, by a forest of hash prefixes.

Each tree writes a vector as a string of digits: after a random rotation, a digit is the largest coordinate with its sign,
so that vectors with a small angle between them share digits. A tree is the sorted array of its strings. Every vector is
asked. It descends to its cell, the run of at most ``CELL`` strings around it that share the longest prefixes; from there all
trees ascend in step, to shorter and shorter prefixes, until the runs of that prefix hold enough candidates together. At the
last step only as many trees ascend as are needed. Candidates are compared by their cosines, and the best of all trees are merged.

The work is laid out in four exchanges of packed rows (arrays of many vectors in one row each), sorted by numpy:
ids and strings to the trees, which count the strings behind each prefix; counts, strings and vectors to blocks of ids, where
the ascent is settled; vectors with their depth to the trees, where runs are compared as matrices; the best of each tree
back to the blocks of ids. Equal vectors are one class, so copies don't crowd a run.

A dense cluster writes one string. Crowded strings are found on a bounded sample and lengthened by digits of the residual from
their mean, twice if need be; what is still equal is ordered by a random projection of each tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsidora.session import settle

SIDE = 64
#: Trees, and candidates of a query (those met in several trees count again), up to ``AT`` vectors. Beyond, candidates grow
#: with the power 0.3 of the number of vectors, trees with half that power.
TREES, CANDIDATES, AT = 36, 14_600, 50_000
#: Digits of a string, seven bits each; times that a crowded string is lengthened by as many digits of residuals.
DIGITS, LEVELS = 4, 2
#: Lengths of a prefix at which an ascent may stop.
STOPS = (0, 1, 2, 3, 4, 8, 12)
#: Strings of a cell, and of a run that is compared at once; a longer run is cut, and a query takes the part around it.
CELL, WIDE = 128, 4096
#: Vectors of a sample whose k-th nearest is a floor for the k nearest of all, and what cosines in single precision may err.
FLOOR_SAMPLE, MARGIN = 4096, 2e-6
#: Strings of a sorted array in one task; vectors packed at once; vectors of the sample for crowded strings and array borders.
PART, PACK, SAMPLE = 1 << 16, 1 << 15, 20_000
_RUN = 8
_PACKED = "target int, tree int, ids binary, h binary, more binary, extra binary, v binary"

def rotations(tree: int, count: int) -> np.ndarray:
    rng = np.random.default_rng([11, tree])
    return np.stack([np.linalg.qr(rng.normal(size=(SIDE, SIDE)))[0] for _ in range(count)]).astype(np.float32)


def digits(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    y = x @ rotation
    at = np.abs(y).argmax(1)
    return 2 * at + (y[np.arange(len(y)), at] < 0)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of unit length, in double; large and small ones are scaled first, so that no square overflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, SIDE)


def text(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    h = np.zeros(len(x), np.int64)
    for rotation in turn:
        h = h << 7 | digits(x, rotation)
    return h


def lengthened(x: np.ndarray, h: np.ndarray, centres: list[tuple[np.ndarray, np.ndarray]], turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The further digits of strings that are crowded (0 for others), and what is left of each vector; ``centres`` has the crowded strings of each level and their means."""
    more, rest = np.zeros(len(x), np.int64), x.copy()
    for level, (crowded, means) in enumerate(centres):
        name = h << 7 * DIGITS * level | more >> 7 * DIGITS * (LEVELS - level)
        at = np.minimum(np.searchsorted(crowded, name), len(crowded) - 1)
        inside = np.flatnonzero(crowded[at] == name)
        rest[inside] = x[inside] - means[at[inside]]
        more[inside] |= text(rest[inside].astype(np.float32), turn[DIGITS * level :][:DIGITS]) << 7 * DIGITS * (LEVELS - 1 - level)
    return more, rest


def crowds(x: np.ndarray, tree: int, most: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of a tree, the strings that more than ``most`` rows of a sample share, with their means; again for the lengthened strings."""
    turn = rotations(tree, DIGITS * (1 + LEVELS))
    first = digits(x.astype(np.float32), turn[0])
    x = x[np.bincount(first, minlength=2 * SIDE)[first] > most]
    h, out = text(x.astype(np.float32), turn[:DIGITS]), []
    for level in range(LEVELS):
        more, _ = lengthened(x, h, out, turn[DIGITS:])
        names, of, count = np.unique(h << 7 * DIGITS * level | more >> 7 * DIGITS * (LEVELS - level), return_inverse=True, return_counts=True)
        many = np.flatnonzero(count > most)
        if not len(many):
            break
        out.append((names[many], np.stack([x[of == i].mean(0) for i in many])))
    return out


def shared_digits(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """How many leading digits neighbours in a sorted array share."""
    shared = np.zeros(max(0, len(h) - 1), np.int8)
    for k in range(1, DIGITS + 1):
        part = h >> (7 * (DIGITS - k))
        shared += part[1:] == part[:-1]
    same = h[1:] == h[:-1]
    if same.any() and more.any():
        for k in range(1, LEVELS * DIGITS + 1):
            part = more >> (7 * (LEVELS * DIGITS - k))
            shared += same & (part[1:] == part[:-1])
    else:
        shared[same] = (1 + LEVELS) * DIGITS
    return shared


def cuts(shared: np.ndarray, most: int) -> list[int]:
    """Where a sorted array is cut, so that no part exceeds ``most``: within a part's second half, at the place where neighbours share the fewest digits."""
    out, at, n = [], 0, len(shared) + 1
    while n - at > most:
        half = shared[at + most // 2 - 1 : at + most]
        at += most // 2 + int(len(half) - 1 - half[::-1].argmin())
        out.append(at)
    return out


def runs(shared: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each stop and string, the run it meets there, from and to: its prefix's strings, or its cell where that is longer; at most ``WIDE``."""

    def spread(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(edges)
        return np.repeat(edges[:-1], size), np.repeat(edges[1:], size)

    cell = spread(np.array([0, *cuts(shared, CELL), n]))
    lo, hi = np.empty((len(STOPS), n), np.int32), np.empty((len(STOPS), n), np.int32)
    at = np.arange(n)
    for i, stop in enumerate(STOPS):
        a, b = spread(np.r_[0, np.flatnonzero(shared < stop) + 1, n])
        parts = -(-(b - a) // WIDE)
        step = -(-(b - a) // parts)
        a = a + (at - a) // step * step
        b = np.minimum(b, a + step)
        short = b - a < cell[1] - cell[0]
        lo[i], hi[i] = np.where(short, cell[0], a), np.where(short, cell[1], b)
    return lo, hi


def ascents(counts: np.ndarray, ids: np.ndarray, enough: int) -> np.ndarray:
    """The stop of each tree and query, from the strings met (trees x queries x stops): the deepest at which all trees together
    meet ``enough``; the trees that needn't ascend that far stay one stop below. Which trees ascend first goes by the id."""
    trees = len(counts)
    total = counts.sum(0, dtype=np.int64)
    last = len(STOPS) - 1
    stop = np.where((total >= enough).any(1), last - (total[:, ::-1] >= enough).argmax(1), 0)
    below = np.minimum(stop + 1, last)
    q = np.arange(len(ids))
    order = (np.arange(trees)[:, None] + ids[None, :]) % trees
    gain = counts[order, q, stop].astype(np.int64) - counts[order, q, below]
    reached = total[q, below] + np.cumsum(gain, 0) - gain
    out = np.empty((trees, len(ids)), np.uint8)
    out[order, q] = np.where(reached < enough, stop, below)
    return out


def floors(fast: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A cosine that the ``k`` nearest of each row surely reach, being reached by ``k`` members of the sample; with the pairs of rows and members that reach it."""
    out = np.full(len(fast), -2.0, np.float32)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n = len(sample) // _RUN * _RUN
    if n >= (k + 1) * _RUN:
        order = np.argsort(sample_ids[:n])
        at = order[np.minimum(np.searchsorted(sample_ids[order], ids), n - 1)]
        itself = np.flatnonzero(sample_ids[at] == ids)
        for a in range(0, len(fast), 1024):
            g = fast[a : a + 1024] @ sample[:n].T
            own = itself[(itself >= a) & (itself < a + 1024)]
            g[own - a, at[own]] = -2.0
            # the k-th largest of the greatest values of disjoint parts can't exceed the k-th largest value
            most = g.reshape(len(g), _RUN, -1).max(1)
            floor = np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k] - MARGIN
            out[a : a + 1024] = floor
            near = np.flatnonzero(g >= floor[:, None])
            left.append(a + near // n)
            right.append(near % n)
    return out, np.concatenate(left), np.concatenate(right)


def close_pairs(fast: np.ndarray, rows: np.ndarray, lo: int, hi: int, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one of the rows and another member of a run, among them the ``k`` nearest of each row that reach its floor."""
    left, right = [], []
    for a in range(0, len(rows), 512):
        own = rows[a : a + 512]
        g = fast[own] @ fast[lo:hi].T
        inside = np.flatnonzero((own >= lo) & (own < hi))
        g[inside, own[inside] - lo] = -3.0
        near = g >= floor[own, None]
        if np.count_nonzero(near) > 2 * k * len(own) and hi - lo > k:
            many = np.flatnonzero(near.sum(1) > 2 * k)
            g = g[many]
            near[many] = g >= np.partition(g, hi - lo - k, axis=1)[:, hi - lo - k, None] - MARGIN
        at = np.flatnonzero(near)
        left.append(own[at // (hi - lo)])
        right.append(lo + at % (hi - lo))
    return np.concatenate(left), np.concatenate(right)


def cosines(a: np.ndarray, left: np.ndarray, b: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of rows of ``a`` and ``b`` in 10**-9, rounded."""
    out = np.empty(len(left), np.int32)
    for i in range(0, len(left), 1 << 14):
        out[i : i + (1 << 14)] = np.rint(np.round(np.einsum("rd,rd->r", a[left[i : i + (1 << 14)]], b[right[i : i + (1 << 14)]]), 9) * 1e9)
    return out


def usable(e: Column) -> Column:
    """64 finite values that are not all zero."""
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(e) == SIDE) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


class Forest:
    """Rotations, crowded strings and array borders of all trees."""

    def __init__(self, sample: np.ndarray, n: int) -> None:
        grown = max(1.0, n / AT)
        self.trees, self.enough = ceil(TREES * grown**0.15), ceil(CANDIDATES * grown**0.3)
        self.parts = max(1, ceil(n / PART))
        self.centres: list[list[tuple[np.ndarray, np.ndarray]]] = [crowds(sample, t, max(3.0, WIDE / 2 * len(sample) / n)) if len(sample) else [] for t in range(self.trees)]
        self.across = [np.random.default_rng([12, t]).normal(size=SIDE) for t in range(self.trees)]
        self.turns: list[np.ndarray] = []
        self.borders: list[list[tuple[int, int, float]]] = []
        for t in range(self.trees if self.parts > 1 else 0):
            h, more, place = self.strings(sample, t)
            order = np.lexsort((place, more, h))
            at = order[(np.arange(1, self.parts) * len(order) // self.parts)] if len(order) else []
            self.borders.append([(int(h[i]), int(more[i]), float(place[i])) for i in at])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"turns": []}

    def strings(self, exact: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        while len(self.turns) <= t:
            self.turns.append(rotations(len(self.turns), DIGITS * (1 + len(self.centres[len(self.turns)]))))
        turn = self.turns[t]
        h = text(exact.astype(np.float32), turn[:DIGITS])
        return h, lengthened(exact, h, self.centres[t], turn[DIGITS:])[0], exact @ self.across[t]

    def part(self, t: int, h: np.ndarray, more: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The part of the sorted array in which each string lies."""
        if self.parts == 1:
            return np.zeros(len(h), np.int64)
        bh = np.array([b[0] for b in self.borders[t]])
        part, upto = np.searchsorted(bh, h, side="left"), np.searchsorted(bh, h, side="right")
        for i in np.flatnonzero(part < upto).tolist():  # strings equal to a border's go by the rest of it
            own = (int(h[i]), int(more[i]), float(place[i]))
            while part[i] < upto[i] and self.borders[t][part[i]] <= own:
                part[i] += 1
        return part


def _split(to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """The rows of each target, as bytes."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    edges = np.r_[0, np.flatnonzero(to[1:] != to[:-1]) + 1, len(to)] if len(to) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = order[a:b]
        yield int(to[a]), *(c[own].tobytes() for c in columns)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    names = ["target", "tree", "ids", "h", "more", "extra", "v"]
    filled = [(*r, *[None] * (7 - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in filled], k) for i, k in enumerate(kinds)], names=names)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors (columns 0 and 1) of up to about ``PACK`` rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= PACK:
            yield np.concatenate([b.column(0).to_numpy() for b in held]), np.concatenate([vectors(b.column(1)) for b in held])
            held, count = [], 0
    if held:
        yield np.concatenate([b.column(0).to_numpy() for b in held]), np.concatenate([vectors(b.column(1)) for b in held])


def _targets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The packed rows of each target of a partition."""
    held: dict[int, list[dict]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            held.setdefault(r["target"], []).append(r)
    for target in sorted(held):
        yield target, held.pop(target)


def _joined(rows: list[dict], column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), kind)


def _nearest_classes(classes: DataFrame, n: int, k: int) -> DataFrame:
    """id, ids, cosines of the nearest other classes of each class; ids run from 0 to n - 1."""
    sample = classes.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLE))) == 0).limit(SAMPLE).toPandas()
    known = unit(np.frombuffer(b"".join(map(bytes, sample.v)), np.float32).reshape(-1, SIDE)) if len(sample) else np.zeros((0, SIDE))
    forest = Forest(known, n)
    near_ids, near_known = sample.id.to_numpy()[:FLOOR_SAMPLE], known[:FLOOR_SAMPLE]
    blocks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(n / PART))
    block = max(1, ceil(n / blocks))
    arrays = forest.trees * forest.parts

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in _packs(batches):
            exact = unit(v)
            for t in range(forest.trees):
                h, more, place = forest.strings(exact, t)
                to = t * forest.parts + forest.part(t, h, more, place)
                yield _rows([(to, t, *rest) for to, *rest in _split(to, ids, h.astype(np.int32), more, place)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _targets(batches):
            ids, h, more, place = _joined(rows, "ids", np.int64), _joined(rows, "h", np.int32), _joined(rows, "more", np.int64), _joined(rows, "extra", np.float64)
            order = np.lexsort((place, more, h))
            lo, hi = runs(shared_digits(h[order].astype(np.int64), more[order]), len(h))
            met = np.ascontiguousarray((hi - lo).T.astype(np.uint16))
            ids, h, more = ids[order], h[order], more[order]
            yield _rows([(to, rows[0]["tree"], *rest) for to, *rest in _split(ids // block, ids, h, more, met)])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in _packs(batches):
            yield _rows([(to, -1, own, None, None, None, x) for to, own, x in _split(ids // block, ids, v)])

    def ascend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for target, rows in _targets(batches):
            size = min(block, n - target * block)
            own = [r for r in rows if r["tree"] < 0]
            v = np.empty((size, SIDE), np.float32)
            v[_joined(own, "ids", np.int64) - target * block] = _joined(own, "v", np.float32).reshape(-1, SIDE)
            h, more, met = np.zeros((forest.trees, size), np.int32), np.zeros((forest.trees, size), np.int64), np.zeros((forest.trees, size, len(STOPS)), np.uint16)
            for r in rows:
                if r["tree"] >= 0:
                    at = np.frombuffer(r["ids"], np.int64) - target * block
                    h[r["tree"], at], more[r["tree"], at] = np.frombuffer(r["h"], np.int32), np.frombuffer(r["more"], np.int64)
                    met[r["tree"], at] = np.frombuffer(r["extra"], np.uint16).reshape(-1, len(STOPS))
            ids = target * block + np.arange(size)
            stop = ascents(met, ids, forest.enough)
            exact = unit(v)
            floor, left, right = floors(exact.astype(np.float32), ids, near_known.astype(np.float32), near_ids, k)
            # neighbours in the sample are results, too; they go the way of the vectors
            yield _rows([(target % arrays, -1, ids[left].tobytes(), cosines(exact, left, near_known, right).tobytes(), near_ids[right].tobytes())])
            for t in range(forest.trees):
                place = exact @ forest.across[t]
                to = t * forest.parts + forest.part(t, h[t], more[t], place)
                extra = np.rec.fromarrays([place, floor, stop[t]], names="place,floor,stop")
                yield _rows([(to, t, *rest) for to, *rest in _split(to, ids, h[t], more[t], extra, v)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("place", np.float64), ("floor", np.float32), ("stop", np.uint8)])
        for _, rows in _targets(batches):
            for r in rows:
                if r["tree"] < 0:
                    q = np.frombuffer(r["ids"], np.int64)
                    yield _rows([(to, 0, *rest) for to, *rest in _split(q // block, q, np.frombuffer(r["h"], np.int32), np.frombuffer(r["more"], np.int64))])
            rows = [r for r in rows if r["tree"] >= 0]
            if not rows:
                continue
            ids, h, more, extra, v = (_joined(rows, c, d) for c, d in (("ids", np.int64), ("h", np.int32), ("more", np.int64), ("extra", kind), ("v", np.float32)))
            order = np.lexsort((extra["place"], more, h))
            ids, stop, floor, exact = ids[order], extra["stop"][order], extra["floor"][order], unit(v.reshape(-1, SIDE)[order])
            fast = exact.astype(np.float32)
            lo, hi = runs(shared_digits(h[order].astype(np.int64), more[order]), len(ids))
            at = np.arange(len(ids))
            lo, hi = lo[stop, at].astype(np.int64), hi[stop, at].astype(np.int64)
            by = np.argsort(lo * (len(ids) + 1) + hi, kind="stable")
            first = np.flatnonzero(np.r_[True, (lo[by][1:] != lo[by][:-1]) | (hi[by][1:] != hi[by][:-1])])
            pairs = [close_pairs(fast, by[a:b], int(lo[by[a]]), int(hi[by[a]]), floor, k) for a, b in zip(first, np.r_[first[1:], len(ids)], strict=True)]
            left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
            q = ids[left]
            yield _rows([(to, 0, *rest) for to, *rest in _split(q // block, q, cosines(exact, left, exact, right), ids[right])])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _targets(batches):
            yield _merged(_joined(rows, "ids", np.int64), _joined(rows, "more", np.int64), _joined(rows, "h", np.int32), k)

    met = classes.mapInArrow(write, _PACKED).repartitionById(arrays, F.col("target")).mapInArrow(count, _PACKED)
    asked = met.unionByName(classes.mapInArrow(keep, _PACKED)).repartitionById(blocks, F.col("target")).mapInArrow(ascend, _PACKED)
    found = asked.repartitionById(arrays, F.col("target")).mapInArrow(compare, _PACKED)
    return found.repartitionById(blocks, F.col("target")).mapInArrow(merge, "id bigint, ids array<bigint>, cosines array<double>")


def _merged(q: np.ndarray, other: np.ndarray, cosine: np.ndarray, k: int) -> pa.RecordBatch:
    order = np.lexsort((other, (q - q.min(initial=0)) << 32 | (1 << 31) - cosine.astype(np.int64)))
    q, other, cosine = q[order], other[order], cosine[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (other[1:] != other[:-1])]
    q, other, cosine = q[new], other[new], cosine[new]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    q, other, cosine = q[rank < k], other[rank < k], cosine[rank < k]
    ids, counts = np.unique(q, return_counts=True)
    offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(other)), pa.ListArray.from_arrays(offsets, pa.array(cosine / 1e9))], names=["id", "ids", "cosines"])


def nearest_vectors(rows: DataFrame, name: str = "protein_id", place: str = "source_db", embedding: str = "embedding", k: int = 5) -> DataFrame:
    """For each usable vector the ``k`` most similar others: name, place, nb_rank (from 1), nb_``name``, nb_``place``.

    Similar is the larger cosine, computed in double and rounded to 9 decimals; ties go to the smaller name, then the smaller
    place. A (name, place) counts once, with its greatest usable vector; rows with a null in either, and vectors without 64
    finite values that aren't all zero, take no part. Fewer than ``k`` others give fewer rows; empty tables give none; other
    columns aren't read. Every vector is indexed and asked; the result is approximate, see the README for measured recall.
    """
    once = rows.select(F.col(name).cast("string").alias("p"), F.col(place).cast("string").alias("s"), F.col(embedding).cast("array<float>").alias("e")).where("p is not null and s is not null").where(usable(F.col("e")))
    once = once.groupBy("p", "s").agg(F.max("e").alias("e"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            flat = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (4 * SIDE)).buffers()[1], pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], names=["p", "s", "v"])

    members = settle(once.mapInArrow(pack, "p string, s string, v binary").withColumn("c", F.unhex(F.md5("v"))), "vectors")
    # ids follow the order of the classes' smallest members, so that ties by id are ties by name and place; they are made dense
    # by the number of rows of the partitions before, of which the driver gets one count a partition
    loose = members.groupBy("c").agg(F.min(F.struct("p", "s")).alias("f"), F.first("v").alias("v")).orderBy("f").select(F.monotonically_increasing_id().alias("m"), "c", "v")
    loose = settle(loose, "classes")
    sizes = sorted((r.part, r.n) for r in loose.groupBy(F.shiftright("m", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    before = dict(zip([p for p, _ in sizes], np.r_[0, np.cumsum([c for _, c in sizes])].tolist(), strict=False))
    shift = F.create_map(*[F.lit(x) for p, b in before.items() for x in (int(p), int(b))]) if before else F.lit(None).cast("map<bigint,bigint>")
    classes = loose.select((F.element_at(shift, F.shiftright("m", 33)) + F.col("m").bitwiseAND((1 << 33) - 1)).alias("id"), "v", "c")
    near = _nearest_classes(classes.select("id", "v"), sum(c for _, c in sizes), k)

    named = settle(members.select("c", "p", "s").join(classes.select("c", "id"), "c").select("id", "p", "s"), "members")
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("p", "s"))).where(F.col("r") <= k + 1).select(F.col("id").alias("other"), F.col("p").alias("np"), F.col("s").alias("ns"))
    links = near.select("id", F.explode(F.arrays_zip("ids", "cosines")).alias("z")).select("id", F.col("z.ids").alias("other"), F.col("z.cosines").alias("c"))
    links = links.unionByName(named.select("id", F.col("id").alias("other"), F.lit(1.0).alias("c")).distinct())
    offers = links.join(first, "other").groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("d"), "np", "ns"))).alias("o"))
    ranked = named.join(offers, "id").select("p", "s", F.posexplode(F.slice(F.filter("o", lambda x: (x["np"] != F.col("p")) | (x["ns"] != F.col("s"))), 1, k)).alias("i", "o"))
    return ranked.select(F.col("p").alias(name), F.col("s").alias(place), (F.col("i") + 1).alias("nb_rank"), F.col("o.np").alias(f"nb_{name}"), F.col("o.ns").alias(f"nb_{place}"))
