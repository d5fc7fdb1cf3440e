import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from capsidora.llm.topn import TOP, cutoffs, keep_first, rising_code, top_n_per_group


def test_codes_keep_order():
    v = np.array([-np.inf, -1.5, -1e-300, -0.0, 0.0, 5e-324, 1e-9, 3.0, np.inf, np.nan])
    c = rising_code(v)
    assert c[3] == c[4] and (np.diff(np.delete(c, 3).astype(object)) > 0).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from([0, 1, 2, 5, 2**64 - 1]), st.sampled_from([b"", b"a", b"ab", b"abcdefghi", b"b"])), max_size=40), st.integers(1, 4))
def test_keep_first_is_sorting(rows, n):
    g = np.array([r[0] for r in rows], np.int64)
    code = np.array([r[1] for r in rows], np.uint64)
    names = [r[2] for r in rows]
    want = []
    for k in set(g.tolist()):
        own = sorted((i for i in range(len(rows)) if g[i] == k), key=lambda i: (int(code[i]), names[i], i))
        want += own[:n]
    assert keep_first(g, n, [code], names).tolist() == sorted(want)


def test_cutoffs_hold_exactly():
    code = np.arange(100, dtype=np.uint64) * np.uint64(1 << 57)
    cut = cutoffs(code, np.zeros(100, np.int64), np.array([7]))
    assert (code <= cut[0]).sum() == 7 and cutoffs(np.full(3, TOP), np.zeros(3, np.int64), np.array([2]))[0] == TOP


def test_table(spark):
    rows = [("q", f"t{i % 50:02d}", float(i % 7), None if i % 3 else 1.0) for i in range(3000)] + [("r", "x", 0.0, 1.0), ("r", "x", 0.0, 1.0), ("r", None, 0.0, 1.0), ("r", "y", None, 1.0), (None, "z", 0.0, 1.0), ("s", "", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "g string, item string, e double, b double").selectExpr("*", "1 as rank", "g as g0", "e as s0")
    got = top_n_per_group(df, ["g"], [("e", "asc"), ("b", "desc")], "item", 5, block_rows=64).collect()
    best = {}
    for g, t, e, b in rows:
        if g == "q":
            key = (e, -(b if b is not None else -np.inf))
            best[t] = min(best.get(t, key), key)
    want = [("q", i + 1, t) for i, t in enumerate(sorted(best, key=lambda t: (*best[t], t))[:5])]
    assert sorted(tuple(r) for r in got) == sorted([*want, ("r", 1, "x"), ("s", 1, "")])
    assert top_n_per_group(df.limit(0), ["g"], [("e", "asc")], "item", 5).count() == 0
