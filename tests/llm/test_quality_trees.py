import zlib

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import quality_trees as q


def test_trees_learn_a_rule_with_two_columns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4_000, 6))
    y = ((x[:, 1] > 0) ^ (x[:, 4] > 0.5)).astype(float)
    trees = q.fit(x[:3_000], y[:3_000])
    assert ((trees.score(x[3_000:]) >= 0.5) == y[3_000:]).mean() > 0.97


def test_flat_trees_match_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    trees = q.fit(x, (x[:, 0] > 0.3).astype(float), trees=5)
    for row, got in zip(x[:50], trees.score(x[:50])):
        total = trees.base
        for t in range(5):
            node = 0
            while trees.child[t, node] != node:
                node = trees.child[t, node] + (row[trees.column[t, node]] > trees.threshold[t, node])
            total += trees.value[t, node]
        assert np.isclose(got, 1 / (1 + np.exp(-total)))


def test_one_label_or_none():
    assert np.allclose(q.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))), 0.5)
    assert q.fit(np.zeros((9, 3)), np.ones(9)).score(np.zeros((1, 3)))[0] > 0.9


def test_statistics_of_any_text():
    for text in (None, "", " \n", "a", "A B c!", "x" * 100_000, "é 日本 \U0001f600", "1|2|3\n" * 50):
        found = q.statistics(text)
        assert len(found) == q.WIDTH and np.isfinite(found).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = q.classify(docs, labels).filter("held_out").join(labels.select("doc_id", "quality"), "doc_id")
    right, rows = got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert rows > 500 and right > 0.98


def test_rows_and_columns(spark, docs, with_null_id, empty):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labels = labels.unionByName(spark.createDataFrame([(0, 0, 0), (0, 1, 0), (None, 1, 0), (5, None, None), (7, 9, 9)], "doc_id long, quality int, toxic int"))
    got = q.classify(with_null_id, labels).collect()
    assert len(got) == with_null_id.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    kept = q.keep_good(with_null_id, labels)
    assert kept.columns == with_null_id.columns and kept.count() == sum(r["predicted"] for r in got)
    assert q.classify(empty, labels).count() == 0 and q.keep_good(docs, labels.limit(0)).count() == docs.count()
