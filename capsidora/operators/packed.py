"""Several values packed in one text field, as one row per value with its position.

A block of texts is read as one Arrow byte buffer. Quote signs become a running parity, parentheses a running
depth and delimiters a mask, all as arrays over the bytes; the bounds of the values follow from them, become child
offsets of a list array, and the list is flattened with its parents' ordinals. Rows whose quotes or parentheses don't
balance, or that hold JSON escapes, are read by a scanner of one text at a time with the same rules.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts by which a field says that it has no value, in lower case (fixed values).
NO_VALUE = ("-", "--", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "not available", "not applicable")
BLANK, DELIMITERS, QUOTES = b" \t\r\n\x0b\x0c", b";,|>\t\r\n", b"\"'"
#: Bytes of text that are split at once.
BLOCK_BYTES = 8 << 20

_IS_BLANK, _IS_DELIM, _IS_QUOTE, _IS_WORD = (np.zeros(256, bool) for _ in range(4))
_IS_BLANK[list(BLANK)] = _IS_DELIM[list(DELIMITERS)] = _IS_QUOTE[list(QUOTES)] = True
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def split_one(text: str, anchor: str | None = None) -> list[str]:
    """The values of one text, by scanning it; the rules are those of :func:`split_packed`."""
    s = text.strip(BLANK.decode())
    if s[:1] == "[" and s[-1:] == "]":
        try:
            held = json.loads(s)
            if isinstance(held, list) and all(isinstance(x, str) for x in held):
                return _kept([x.strip() for x in held])
        except ValueError:
            pass
        s = s[1:-1]
    pieces = _anchored(s, anchor) if anchor else _plain(s)
    return _kept(pieces)


def _kept(values: list[str]) -> list[str]:
    values = [v for v in values if v]
    return [] if len(values) == 1 and values[0].lower() in NO_VALUE else values


def _closing(s: str, i: int) -> int:
    """Where the quote that opens at ``i`` closes, or -1; a doubled sign doesn't close, nor does one inside a word."""
    q, j = s[i], i + 1
    while j < len(s):
        if s[j] == q:
            if s[j + 1 : j + 2] == q:
                j += 1
            elif not (q == "'" and s[j - 1].isalnum() and s[j + 1 : j + 2].isalnum()):
                return j
        j += 1
    return -1


def _plain(s: str) -> list[str]:
    out, start, i = [], 0, 0

    def put(end: int) -> None:
        v = s[start:end].strip(BLANK.decode())
        if len(v) > 1 and v[0] in "\"'" and v[-1] == v[0] and _closing(v, 0) == len(v) - 1:
            v = v[1:-1].replace(v[0] * 2, v[0]).strip(BLANK.decode())
        out.append(v)

    fresh = True
    while i < len(s):
        c = s[i]
        if fresh and c in "\"'" and (j := _closing(s, i)) > 0:
            i, fresh = j + 1, False
        elif c == "(" and (j := _matching(s, i)) > 0:
            i, fresh = j + 1, False
        elif c in DELIMITERS.decode() or (c == "/" and _lone(s, i)):
            put(i)
            start, fresh = i + 1, True
            i += 1
        else:
            fresh = fresh and c in BLANK.decode()
            i += 1
    put(len(s))
    return out


def _matching(s: str, i: int) -> int:
    depth = 0
    for j in range(i, len(s)):
        depth += (s[j] == "(") - (s[j] == ")")
        if not depth:
            return j
    return -1


def _lone(s: str, i: int) -> bool:
    around = (BLANK + DELIMITERS + QUOTES).decode()
    return (i == 0 or s[i - 1] in around) and (i + 1 == len(s) or s[i + 1] in around)


def _anchored(s: str, anchor: str) -> list[str]:
    starts, i = [], 0
    begin = re.compile(re.escape(anchor) + r"\d")
    around = (BLANK + DELIMITERS + QUOTES).decode()
    while i < len(s):
        c = s[i]
        before = i == 0 or s[i - 1] in around or (s[i - 1] == "/" and (i == 1 or s[i - 2] in around))
        if c in "\"'" and before and (j := _closing(s, i)) > 0:
            if begin.match(s, i + 1):
                starts.append(i + 1)
            i = j + 1
        elif c == "(" and (j := _matching(s, i)) > 0:
            i = j + 1
        else:
            if before and begin.match(s, i):
                starts.append(i)
            i += 1
    out = []
    for a, b in zip(starts, [*starts[1:], len(s)], strict=False):
        q = s[a - 1] if a and s[a - 1] in "\"'" else ""
        end = _closing(s, a - 1) if q else -1
        v = s[a:end] if end > 0 else _tail(s[a:b])
        out.append(v.replace(q * 2, q).strip(BLANK.decode()) if q else v)
    return out


def _tail(v: str) -> str:
    return re.sub(r"(?:\s|[;,|>\"']|(?<=[\s;,|>\"'])/)+$", "", v)


def _run(flag: np.ndarray, base: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Running count of a flag within each row, before each byte."""
    total = np.cumsum(flag, dtype=np.int64) - flag
    return total - np.r_[total, flag.sum()][base][row]


def _block(text: pa.Array, anchor: str | None) -> tuple[np.ndarray, pa.Array]:
    """Parent ordinals and values of a block of non-null texts, in order."""
    text = text.cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset)
    b = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    base = offsets[:-1] - offsets[0]
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(text)), size)
    n = len(b)
    before, after = np.r_[np.uint8(10), b[:-1]][:n], np.r_[b[1:], np.uint8(10)][:n]
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    first[base], last[(base + size - 1)[size > 0]] = True, True
    first, last = first[:n], last[:n]
    before, after = np.where(first, 10, before), np.where(last, 10, after)

    dq = b == 34
    in_dq = _run(dq, base, row) % 2 == 1
    sq = (b == 39) & ~(_IS_WORD[before] & _IS_WORD[after]) & ~(in_dq & ~dq)
    in_sq = _run(sq, base, row) % 2 == 1
    quoted = in_dq | in_sq
    opened, closed = (b == 40) & ~quoted, (b == 41) & ~quoted
    depth = _run(opened.astype(np.int8) - closed, base, row) if opened.any() or closed.any() else np.zeros(n, np.int64)
    deep = depth > 0

    def rows_with(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row[mask], minlength=len(text)) if n else np.zeros(len(text), np.int64)

    blank, soft = _IS_BLANK[b], _IS_BLANK[before] | _IS_DELIM[before] | (before == 91)
    opening = (dq & ~in_dq & ~in_sq) | (sq & ~in_sq & ~in_dq)
    doubled = opening & ((dq & (before == 34)) | (sq & (before == 39)))
    stray = opening & ~doubled & ~soft
    odd = (rows_with(dq) % 2 == 1) | (rows_with(sq) % 2 == 1) | (rows_with(opened) != rows_with(closed))
    odd |= (rows_with(depth < 0) > 0) | (rows_with(dq & in_sq) > 0) | (rows_with(stray) > 0) | (rows_with((b == 92)) > 0) | (rows_with(doubled & deep) > 0)
    odd |= (rows_with((b == 39) & ~sq & ~in_dq & (in_sq | _IS_QUOTE[before] | _IS_QUOTE[after])) > 0)
    if n:
        head = np.minimum.reduceat(np.where(blank, n, np.arange(n)), base[size > 0])
        tail = np.maximum.reduceat(np.where(blank, -1, np.arange(n)), base[size > 0])
        full = (head < n) & (tail >= 0)
        head, tail = head[full], tail[full]
        listed = (b[head] == 91) & (b[tail] == 93) & (head < tail)
        bracket = np.zeros(n, bool)
        bracket[head[listed]] = bracket[tail[listed]] = True
    else:
        bracket = np.zeros(0, bool)
    # brackets that don't enclose the text, and quotes that open upon another, are left to the scanner
    odd |= (rows_with(((b == 91) | (b == 93)) & ~bracket) > 0) | (rows_with(opening & (after == b)) > 0)
    guarded = quoted | deep
    lone = (b == 47) & (_IS_BLANK[before] | _IS_DELIM[before] | _IS_QUOTE[before] | first) & (_IS_BLANK[after] | _IS_DELIM[after] | _IS_QUOTE[after] | last)
    cut = ((_IS_DELIM[b] | lone) & ~guarded) | bracket

    if anchor:
        a = np.frombuffer(anchor.encode(), np.uint8)
        at = np.ones(n, bool)
        for k, byte in enumerate(a):
            at &= np.r_[b[k:], np.zeros(k, np.uint8)][:n] == byte
        digit = np.r_[b[len(a) :], np.zeros(len(a), np.uint8)][:n]
        at &= (digit >= 48) & (digit <= 57)
        at &= (soft | _IS_QUOTE[before] | (before == 47)) & ~deep
        odd |= (rows_with(at & (before == 47)) > 0) | (rows_with(doubled) > 0)
        just = np.r_[False, opening[:-1]][:n] & ~first
        at &= ~quoted | just
        starts = np.flatnonzero(at)
        ends = np.r_[starts[1:], n][: len(starts)]
        ends = np.minimum(ends, (base + size)[row[starts]]) if len(starts) else ends
        # a quoted value ends where the parity of its quote turns
        shut = np.flatnonzero((dq & in_dq & (after != 34)) | (sq & in_sq & (after != 39)))
        odd[row[shut[_IS_DELIM[before[shut]] | _IS_QUOTE[before[shut]]]]] = True
        if len(shut) and len(starts):
            nxt = np.searchsorted(shut, starts)
            end_q = shut[np.minimum(nxt, len(shut) - 1)]
            ends = np.where(just[starts] & (nxt < len(shut)), np.minimum(ends, end_q), ends)
        loose = blank | (_IS_DELIM[b]) | _IS_QUOTE[b] | bracket | lone
    else:
        edges = np.flatnonzero(cut)
        starts = np.sort(np.r_[base[size > 0], edges + 1])
        starts = starts[starts < n] if n else starts
        starts = np.unique(starts)
        ends = np.full(len(starts), n)
        if len(edges) and len(starts):
            nxt = np.searchsorted(edges, starts)
            ends = np.where(nxt < len(edges), edges[np.minimum(nxt, len(edges) - 1)], n)
        if len(starts):
            ends = np.minimum(ends, (base + size)[row[starts]])
        loose = blank
    # trim: the next kept byte at or after each start, the last kept one before each end
    if len(starts):
        ahead = np.where(blank, n, np.arange(n))
        ahead = np.r_[np.minimum.accumulate(ahead[::-1])[::-1], n]
        behind = np.r_[-1, np.maximum.accumulate(np.where(loose, -1, np.arange(n)))]
        starts, ends = np.minimum(ahead[starts], ends), behind[ends] + 1
        keep = ends > starts
        starts, ends = starts[keep], ends[keep]
        if not anchor and len(starts):
            wrapped = _IS_QUOTE[b[starts]] & (b[starts] == b[ends - 1]) & (ends - starts > 1) & opening[starts]
            loose_end = _IS_QUOTE[b[starts]] & opening[starts] & ~wrapped
            odd[row[starts[loose_end]]] = True
            starts, ends = starts + wrapped, ends - wrapped
            starts, ends = np.minimum(ahead[starts], ends), np.maximum(behind[ends] + 1, starts)
            keep = ends > starts
            starts, ends = starts[keep], ends[keep]
    parent = row[starts] if len(starts) else np.zeros(0, np.int64)
    ok = ~odd[parent] if len(parent) else np.zeros(0, bool)
    starts, ends, parent = starts[ok], ends[ok], parent[ok]

    # doubled quotes inside quotes lose their second sign
    second = np.r_[False, (dq & in_dq)[:-1] & dq[1:]][:n] | np.r_[False, (sq & in_sq)[:-1] & sq[1:]][:n] if n else np.zeros(0, bool)
    lens = ends - starts
    take = np.repeat(starts - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum()) if len(lens) else np.zeros(0, np.int64)
    drop = second[take] if n else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(lens)), lens)
    lens = lens - np.bincount(owner[drop], minlength=len(lens))
    child = np.r_[0, np.cumsum(lens)].astype(np.int64)
    values = pa.Array.from_buffers(pa.large_utf8(), len(lens), [None, pa.py_buffer(child.tobytes()), pa.py_buffer(b[take[~drop]].tobytes())])

    counts = np.bincount(parent, minlength=len(text))
    alone = np.flatnonzero(counts[parent] == 1)
    if len(alone):
        none = np.array(pc.is_in(pc.utf8_lower(values.take(pa.array(alone))), value_set=pa.array(NO_VALUE, pa.large_utf8())))
        mask = np.ones(len(parent), bool)
        mask[alone[none]] = False
        parent, values = parent[mask], values.filter(pa.array(mask))
    if odd.any():
        strange = np.flatnonzero(odd)
        own = [split_one(text[int(i)].as_py().decode(), anchor) for i in strange]
        parent = np.r_[parent, np.repeat(strange, [len(x) for x in own])]
        values = pa.concat_arrays([values, pa.array([v for x in own for v in x], pa.large_utf8())])
        at = np.argsort(parent, kind="stable")
        parent, values = parent[at], values.take(pa.array(at))
    return parent, values


def split_block(text: pa.Array, anchor: str | None = None) -> pa.ListArray:
    """The values of each text as a list array; null for null."""
    valid = np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False))
    parent, values = _block(text.take(pa.array(valid)), anchor)
    counts = np.bincount(valid[parent], minlength=len(text)) if len(parent) else np.zeros(len(text), np.int64)
    return pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)]), values)


def split_packed(df: DataFrame, record_id: str, fields: Mapping[str, str | None]) -> DataFrame:
    """One row per value of the text columns ``fields``: field, record_id, pos (from 1) and value.

    Values are parted by ``; , | >``, tab, line end, or a slash between blanks; not inside quotes (double or single,
    opened at the start of a value) nor inside parentheses. A field with an anchor, such as ``GO:``, holds values that each
    begin with it and a digit, and blanks alone part them too. A text in square brackets is a list, with JSON escapes.
    Values lose blanks and quotes around them; a quote sign doubled inside quotes is one sign; an apostrophe within a word
    is no quote; a quote or parenthesis that never closes is an ordinary sign. Empty values don't count. A text that is
    null, empty or blank, or only says that it has no value (:data:`NO_VALUE`), gives no row.

    A record that comes several times counts once, with the greatest of its texts in byte order; a null id gives no rows.
    Other columns aren't read. The only exchange is that of the records, behind partial aggregation.
    """
    once = df.select(F.col(record_id).cast("string").alias("i"), *[F.col(c).cast("string").alias(f"t{k}") for k, c in enumerate(fields)]).where("i is not null")
    once = once.groupBy("i").agg(*[F.max(f"t{k}").alias(f"t{k}") for k in range(len(fields))])
    out = T.StructType([T.StructField("field", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("value", T.StringType())])
    names, anchors = list(fields), list(fields.values())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (name, anchor) in enumerate(zip(names, anchors, strict=True)):
                text = batch.column(k + 1)
                step = max(1, int(len(text) * BLOCK_BYTES / max(1, text.nbytes)))
                for s in range(0, len(text), step):
                    lists = split_block(text.slice(s, step), anchor)
                    parent = pc.list_parent_indices(lists)
                    starts = np.asarray(lists.offsets)[np.asarray(parent)]
                    pos = np.arange(len(parent)) - starts + 1
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(parent), pa.string()), batch.column(0).slice(s, step).take(parent), pa.array(pos.astype(np.int32)), lists.flatten().cast(pa.string())], names=out.names)

    return once.mapInArrow(split, out)
