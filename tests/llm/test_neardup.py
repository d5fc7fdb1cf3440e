import random

import numpy as np
from pyspark.sql import functions as F

from capsidora.llm.neardup import FRESH, LOOK, fewest_agreements, letters, likely, near_duplicate_groups, near_duplicates, record_pairs


def pieces(s):
    s = "".join(c for c in (s or "").upper() if "A" <= c <= "Z")
    return {s[i : i + 5] for i in range(len(s) - 4)}


def test_pairs_and_groups(spark):
    rnd = random.Random(4)
    make = lambda n: "".join(rnd.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    base = [make(rnd.randint(30, 200)) for _ in range(60)]
    rows = [(f"a{i:03d}", s) for i, s in enumerate(base)]
    for i, s in enumerate(base[:30]):
        for k in range(rnd.randint(1, 3)):
            cut = rnd.randrange(len(s) - 12)
            rows.append((f"b{i:03d}{k}", s[:cut] + make(rnd.randint(0, 8)) + s[cut + rnd.randint(0, 10) :]))
    rows += [("c1", base[0].lower() + "*\n"), ("c1", base[0]), ("d", None), ("e", ""), ("f", "ABCD"), (None, base[1]), ("g", "M" * 5000), ("h", "M" * 9)]
    df = spark.createDataFrame(rows, "id string, s string").selectExpr("*", "1 as class_id", "s as fresh")
    membership, pairs = near_duplicates(df, "id", "s")
    got = [tuple(r) for r in record_pairs(membership, pairs).collect()]
    sets = {i: pieces(s) for i, s in rows if i and pieces(s)}
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and set(got) == want and ("g", "h") in want
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in want:
            m = min(root[a], root[b])
            if (root[a], root[b]) != (m, m):
                root[a] = root[b] = m
                changed = True
    out = near_duplicate_groups(df, "id", "s").collect()
    assert {r.record_id: r.group_id for r in out} == root


def test_empty(spark):
    none = spark.createDataFrame([], "id string, s string")
    m, p = near_duplicates(none, "id", "s")
    assert m.count() == 0 and p.count() == 0 and record_pairs(m, p).count() == 0 and near_duplicate_groups(none, "id", "s").count() == 0


def test_a_hot_family_costs_a_pair_a_member_and_bucket(spark, monkeypatch):
    from capsidora.llm import neardup

    rnd = random.Random(6)
    base = [rnd.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(300)]
    rows = []
    for i in range(1500):
        s = list(base)
        for _ in range(6):
            s[rnd.randrange(300)] = rnd.choice("ACDEFGHIKLMNPQRSTVWY")
        rows.append((f"v{i:05d}", "".join(s)))
    seen = []
    real = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *rest: (seen.append(pairs.count()), real(pairs, *rest))[1])
    out = near_duplicate_groups(spark.createDataFrame(rows, "id string, s string"), "id", "s").collect()
    assert {r.group_id for r in out} == {"v00000"} and len(out) == 1500
    assert sum(seen) <= 64 * 1500 < 1500 * 1499 // 2


def test_pruning_keeps_similar_pairs():
    least = fewest_agreements(0.5, 1e-5)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 65536, (20000, FRESH)).astype(np.uint16)
    near = np.where(rng.random(a.shape) < 0.5, a, a + np.uint16(1))
    far = np.where(rng.random(a.shape) < 0.05, a, a + np.uint16(1))
    assert len(likely(a, near, least)) > 19980 and len(likely(a, far, least)) < 200 and least[0][0] == LOOK


def test_letters(spark):
    assert [r[0] for r in spark.createDataFrame([("a-b\n1é",), (None,)], "s string").select(letters(F.col("s"))).collect()] == ["AB", ""]
