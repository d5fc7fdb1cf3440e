import numpy as np

from capsidora.llm import neighbours as nb


def brute(names, x, k=5):
    u = nb.unit(x)
    c = np.round(u @ u.T, 9)
    return {(names[i], r + 1): names[j] for i in range(len(names)) for r, j in enumerate(sorted((j for j in range(len(names)) if j != i), key=lambda j: (-c[i, j], names[j]))[:k])}


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 64)).astype(np.float32)
    x[5:16] = x[4]
    x[20] = 8 * x[21]
    names = [(f"p{i:02d}", "a" if i % 2 else "b") for i in range(40)]
    rows = [(*n, v.tolist()) for n, v in zip(names, x, strict=True)]
    bad = [("z1", "a", None), ("z2", "a", [0.0] * 64), ("z3", "a", [1.0] * 63), ("z4", "a", [float("nan")] * 64), ("z5", "a", [None] * 64), ("z6", "a", [float("inf")] * 64), (None, "a", [1.0] * 64), ("z7", None, [1.0] * 64)]
    df = spark.createDataFrame(rows + rows[:3] + bad, "protein_id string, source_db string, embedding array<float>").selectExpr("*", "1 as id", "2 as nb_rank")
    got = {((r.protein_id, r.source_db), r.nb_rank): (r.nb_protein_id, r.nb_source_db) for r in nb.nearest_vectors(df).collect()}
    assert got == brute(names, x)
    assert nb.nearest_vectors(df.limit(0)).count() == 0
    assert nb.nearest_vectors(df.where("protein_id in ('p00', 'p01')")).count() == 2


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(nb, "TREES", 16)
    monkeypatch.setattr(nb, "CANDIDATES", 1600)
    monkeypatch.setattr(nb, "PART", 1500)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(150, 64))
    x = np.concatenate([centre.repeat(8, 0) + 0.4 * rng.normal(size=(1200, 64)), rng.normal(size=(800, 64))]).astype(np.float32)
    names = [(f"p{i:04d}", "a") for i in range(len(x))]
    df = spark.createDataFrame([(*n, v.tolist()) for n, v in zip(names, x, strict=True)], "protein_id string, source_db string, embedding array<float>")
    want = brute(names, x)
    got = {}
    for r in nb.nearest_vectors(df).collect():
        got.setdefault((r.protein_id, r.source_db), set()).add((r.nb_protein_id, r.nb_source_db))
    assert sum(v in got[k[0]] for k, v in want.items()) >= 0.9 * len(want)


def test_cuts():
    h = np.sort(np.r_[np.full(50, 1 << 21), np.full(50, 2 << 21), np.full(90, 3 << 21)])
    shared = nb.shared_digits(h, np.zeros(len(h), np.int64))
    assert nb.cuts(shared, 100) == [100] and nb.cuts(shared[:99], 100) == []


def test_ascents_go_in_step():
    # three trees; counts fall from the root to the full string
    one = np.array([100, 40, 10, 5, 5, 5, 5], np.uint16)
    counts = np.broadcast_to(one, (3, 2, 7)).copy()
    for enough in (1, 15, 16, 35, 60, 120, 121, 300, 301):
        stop = nb.ascents(counts, np.array([0, 1]), enough)
        met = one[stop].sum(0).astype(int)
        assert (stop.max(0) - stop.min(0) <= 1).all() and ((met >= enough) | (stop == 0).all(0)).all()
        assert (met - enough < 60).all() or enough < 15
    assert (nb.ascents(counts, np.array([0, 1]), 20)[:, 0] != nb.ascents(counts, np.array([0, 1]), 20)[:, 1]).any()


def test_recall_in_a_dense_cluster(spark, monkeypatch):
    monkeypatch.setattr(nb, "TREES", 16)
    monkeypatch.setattr(nb, "CANDIDATES", 1600)
    monkeypatch.setattr(nb, "PART", 1500)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=64)
    x = np.concatenate([centre / np.linalg.norm(centre) + 0.00625 * rng.normal(size=(1500, 64)), rng.normal(size=(3000, 64))]).astype(np.float32)
    names = [(f"p{i:04d}", "a") for i in rng.permutation(len(x))]
    df = spark.createDataFrame([(*n, v.tolist()) for n, v in zip(names, x, strict=True)], "protein_id string, source_db string, embedding array<float>")
    dense = set(names[:1500])
    want = {k: v for k, v in brute(names, x).items() if k[0] in dense}
    got = {((r.protein_id, r.source_db), r.nb_protein_id, r.nb_source_db) for r in nb.nearest_vectors(df).collect()}
    assert sum((k[0], *v) in got for k, v in want.items()) >= 0.95 * len(want)
