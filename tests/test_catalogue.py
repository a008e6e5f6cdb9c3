from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logharvest.operators import catalogue as R


def test_filter_repos(spark, rows):
    df = spark.createDataFrame([
        ("a/1", "PYTHON", "30"), ("a/2", "python", "30.5"), ("a/3", "Python", "abc"), ("a/4", "Python", None),
        ("a/5", None, "99"), ("a/6", "Jupyter Notebook", "99"), ("a/7", "Cython, Python", "31"), ("a/8", "Python", "NaN"),
    ], " full_name string, `language ` string, stars string")
    kept = R.filter_repos(df, 30)
    assert kept.columns == ["repository_full_name", "language", "stars"]
    assert rows(kept) == [("a/2", "python", 30.5), ("a/7", "Cython, Python", 31.0)]
    assert rows(R.filter_report(df, 30)) == [(8, 2)]


def test_standardize_key_leaves_existing_target(spark):
    df = spark.createDataFrame([("a", "b")], "full_name string, repository_full_name string")
    assert R.standardize_key(df).columns == df.columns


def test_require_columns(spark):
    with pytest.raises(ValueError, match="stars"):
        R.require_columns(spark.range(1), "id", "stars")


def test_status(spark, rows):
    responses = spark.createDataFrame(
        [("a/1", 200, None), ("a/2", 200, True), ("a/3", 404, False), ("a/4", None, None)],
        "repository_full_name string, status_code int, archived boolean")
    assert rows(R.classify_status(responses)) == [
        ("a/1", False, True), ("a/2", True, True), ("a/3", None, False), ("a/4", None, False)]


def test_attach_status_does_not_multiply_but_can_tell(spark, rows):
    repos = spark.createDataFrame([("a/1", 1), ("a/1", 2), (None, 3), ("a/9", 4)], "repository_full_name string, n int")
    status = spark.createDataFrame(
        [("a/1", False, True), ("a/1", None, False), (None, None, False)],
        "repository_full_name string, archived boolean, accessible boolean")
    assert rows(R.attach_status(repos, status)) == sorted(
        [("a/1", 1, False, True), ("a/1", 2, False, True), (None, 3, None, False), ("a/9", 4, None, None)], key=repr)
    # A plain join of names that occur k times on both sides has the sum of k² rows.
    assert R.attach_status(repos, status, count_lookups=True).agg(F.sum("n_lookups")).collect()[0][0] == 2 * 2 + 1 + 1


def test_active_repos(spark, rows):
    df = spark.createDataFrame(
        [("a", True, False), ("b", True, True), ("c", True, None), ("d", False, None)],
        "repository_full_name string, accessible boolean, archived boolean")
    assert rows(R.active_repos(df), "repository_full_name") == [("a",)]
    assert rows(R.active_repos(df.drop("archived")), "repository_full_name") == [("a",), ("b",), ("c",)]
    assert R.active_repos(df.select("repository_full_name")).count() == 4


def test_manifest(spark, rows):
    df = spark.createDataFrame([("o/r",), ("o/r",), (None,), ("nope",), ("a/b/c",)], "repository_full_name string")
    assert rows(R.clone_manifest(df, "/x/")) == [("o/r", "o", "r", "/x/o/r", "https://github.com/o/r.git")]
    assert rows(R.malformed_names(df)) == [("a/b/c",), ("nope",)]


def test_merge(spark, rows):
    a = spark.createDataFrame([("x", 1), ("x", 1), (None, None)], "name string, stars int")
    b = spark.createDataFrame([("x", 1.0), (None, None)], "name string, stars double")
    c = spark.createDataFrame([("x", True)], "name string, archived boolean")
    merged = R.merge_status_tables([a, b, c])
    assert rows(merged) == sorted([("x", 1.0, None), (None, None, None), ("x", None, True)], key=repr)


def test_distinct_by_key(spark, rows):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 1, None)], "k string, t int, v string")
    assert rows(R.distinct_by_key(df, ["k"], ["t"])) == [("a", 1, "early"), ("b", 1, None)]
    assert R.distinct_by_key(df, ["k"]).count() == 2


def test_batches_cover_everything_once(spark):
    df = spark.createDataFrame([(f"r{i:03d}",) for i in range(25)], "name string")
    seen, after = [], None
    while batch := [r.name for r in R.next_batch(df, "name", 10, after).collect()]:
        seen += batch
        after = batch[-1]
    assert seen == [f"r{i:03d}" for i in range(25)]


@pytest.mark.parametrize("start,size", [(0, 10), (100, 250), (4990, 50), (30, 1), (0, 6000), (7000, 5)])
def test_batch_slice_by_rank_equals_a_full_sort(spark, start, size):
    import random

    from logharvest.operators import catalogue as R2

    rng = random.Random(start)
    rows = [(rng.choice([None, *map(float, range(40))]) if i % 7 else rng.random() * 100, i % 13, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a double, b long, c long")
    got = [tuple(r) for r in R2.batch_slice(df, ["a", "b", "c"], start, size).collect()]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))[start : start + size]
    assert got == want
    plan = R2.batch_slice(df, ["a", "b", "c"], start, size)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan or start + size >= 5000 or start == 0
