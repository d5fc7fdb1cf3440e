import random
import re

import numpy as np

from capsidora.llm import leaks
from capsidora.llm.leaks import leaked_items


def words(t):
    return [w.lower() for w in re.findall(r"[^\W_]+", t or "")]


def brute(docs, items, run=12):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + run]), ()) if d is not None and i is not None}
    return out


def test_filter_and_stretches():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    f = np.zeros(1 << 10, np.uint64)
    for p in leaks._probes(s[:2000], 16):
        np.bitwise_or.at(f, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
    assert leaks.may_hold(f, s[:2000]).all() and leaks.may_hold(f, s[2000:]).mean() < 0.1
    hit = np.array([1, 1, 0, 1, 1, 1, 0, 0, 1, 1, 1, 1], bool)
    assert leaks.in_a_row(hit, 3).tolist() == [False] * 3 + [True] * 3 + [False] * 2 + [True] * 4


def test_against_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = ["alpha", "Beta", "γάμμα", "d4", "straße", "x", "the", "of"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.randint(8, 40))) for i in range(25)]
    shared = items[0][1] + " " + items[1][1]
    items += [(30, shared), (31, None), (32, ""), (33, "only eleven words " * 3), (None, shared), (0, items[0][1])]
    docs = []
    for d in range(400):
        _, t = rnd.choice([x for x in items if x[1]])
        w = t.split()
        a = rnd.randrange(max(1, len(w) - 5))
        body = w[a : a + rnd.randint(5, 20)]
        docs.append((d, text(rnd.randint(0, 30)) + "... " + rnd.choice([" ", "-", ",\n> ", " _ "]).join(body).upper() + "! " + text(rnd.randint(0, 30))))
    docs += [(500, None), (501, ""), (502, "  \n"), (None, items[0][1]), (503, "pad " * 40000 + items[2][1]), (0, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as i")
    e = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc_id")
    want = brute(docs, items)
    got = [tuple(r) for r in leaked_items(d, e).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert {tuple(r) for r in leaked_items(d, e, run=7).collect()} == brute(docs, items, 7)
    assert leaked_items(d.limit(0), e).count() == 0 and leaked_items(d, e.limit(0)).count() == 0
