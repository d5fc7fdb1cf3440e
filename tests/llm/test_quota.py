from capsidora.llm.quota import draw


def test_draw(spark):
    rows = [("s", f"r{i:05d}", "Big  Class" if i % 10 else "rare") for i in range(20000)] + [("s", None, "rare"), (None, "x", "rare"), ("s", "u1", None), ("s", "u2", "  "), ("t", "only", "rare")]
    records = spark.createDataFrame(rows, "record_set string, record_id string, category string").selectExpr("*", "1 as wanted", "2 as key")
    targets = spark.createDataFrame([("s", "big_class", 0.5, 1, 1001), ("s", "rare", 0.499, 3000, 1001), ("s", "unknown", 0.001, 1, 1001), ("s", "none_such", 0.0, 4, 1001), ("t", "rare", None, None, None)], "record_set string, category string, target_share double, min_rows bigint, sample_size bigint")
    sample, report = draw(records, targets)
    r = {(x.record_set, x.category): x for x in report.collect()}
    assert {k: (x.wanted, x.observed, x.taken, x.deficit) for k, x in r.items()} == {("s", "big_class"): (501, 18000, 501, 0), ("s", "rare"): (3000, 2000, 2000, 1000), ("s", "unknown"): (1, 2, 1, 0), ("s", "none_such"): (4, 0, 0, 4), ("t", "rare"): (0, 1, 0, 0)}
    got = sample.collect()
    assert len({(x.record_set, x.record_id) for x in got}) == len(got) == 501 + 2000 + 1
    assert sum(x.category == "big_class" for x in got) == 501
    assert sorted(map(tuple, got)) == sorted(map(tuple, draw(records.repartition(7), targets)[0].collect()))


def test_empty(spark):
    records = spark.createDataFrame([], "record_set string, record_id string, category string")
    targets = spark.createDataFrame([("s", "a", 0.5, 2, 10)], "record_set string, category string, target_share double, min_rows bigint, sample_size bigint")
    sample, report = draw(records, targets)
    assert sample.count() == 0 and report.first().deficit == 5
    assert draw(records, targets.limit(0))[1].count() == 0
