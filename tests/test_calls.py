from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logharvest.operators import calls as C
from logharvest.operators import extraction as E
from logharvest.schemas import FILE_CALLS

FLAT = "snippet_id string, snippet string, library string, library_type string, function_name string, function string"


@pytest.fixture
def calls(spark):
    return spark.createDataFrame([
        ("s1", "logging.info(1)", "logging", "general-purpose", "f", "def f(): 1"),
        ("s2", "logging.warn (1)", "logging", "general-purpose", "f", "def f(): 1"),
        ("s3", "info(1)", "logging", "hybrid", "g", "  def g(): 1"),
        ("s4", "wandb.log(1)", "wandb", "ML-specific", "g", "def g(): 1"),
        ("s5", "wandb.log(2)", "wandb", "ML-specific", None, None),
        ("s6", "x()", None, None, "h", "def h(): 1"),
        ("s6", "x()", None, None, "h", "def h(): 1"),
        ("", "logging.info(3)", "logging", "general-purpose", "h", ""),
    ], FLAT)


def test_counts(calls, rows):
    assert rows(C.library_counts(calls)) == [("logging", 4), ("wandb", 2), (None, 2)]
    assert rows(C.total_calls(calls)) == [(8,)]
    assert rows(C.distinct_functions(calls)) == [(4,)]
    assert rows(C.distinct_functions(calls, approximate=True)) == [(4,)]
    assert rows(C.level_counts(calls)) == [("info", 2), ("warn", 1)]


def test_summary_equals_its_parts(calls, rows):
    assert rows(C.summarize_calls(calls)) == sorted([
        ("library", "logging", 4), ("library", "wandb", 2), ("library", None, 2),
        ("total", "number_of_logging_statements", 8), ("total", "number_of_functions", 4),
        ("log_level", "info", 2), ("log_level", "warn", 1),
    ], key=repr)


def test_unique_functions(calls, rows):
    assert rows(C.unique_function_counts(calls)) == sorted([
        ("logging", "info", 1), ("logging", "unknown", 1), ("logging", "warn", 1), ("wandb", None, 1), (None, None, 1)
    ], key=repr)
    assert ("logging", "unknown", "s3") in rows(C.unique_function_ids(calls))
    lists = rows(C.unique_functions(calls, 1), "library", "log_level", "part", "snippet_ids")
    assert (None, None, 0, ["s6"]) in lists


def test_unique_function_lists_split_large_groups_without_loss(spark, rows):
    ids = [f"id{i:05d}" for i in range(1000)]
    calls = spark.createDataFrame([(i, "wandb.log(1)", "wandb", "t", "f", "body") for i in ids], FLAT)
    parts = C.unique_functions(calls, shards=10).collect()
    assert len(parts) == 10
    assert sorted(i for p in parts for i in p.snippet_ids) == ids
    assert all(p.snippet_ids == sorted(p.snippet_ids) and p.unique_function_count == 1 for p in parts)


def nested(spark):
    def snip(i, text, name="f", code="def f(): 1"):
        return (i, text, (None, name, code, None, None), 1)

    return spark.createDataFrame([
        ("a", "p", "p/a.py", "logging", "general-purpose", "def f(): 1\nclass A: pass",
         [snip("1", "logging.info(1)"), snip("2", "logging.getLogger(1)"), snip("3", "logging.info(2)", None, None),
          snip("4", "tf.summary.scalar(1)"), snip("5", "tf.foo(1)"), snip("6", "logging.info(1)", "f", "")]),
        ("b", "p", "p/b.py", "wandb", "ML-specific", "oops(", [snip("7", "wandb.init()")]),
        ("c", "p", "p/c.py", "wandb", "hybrid", "", []),
    ], FILE_CALLS)


def test_filter_nested_and_flat_agree(spark, rows):
    data = nested(spark)
    kept = C.filter_file_calls(data)
    assert kept.columns == ["library", "library_type", "snippets"]
    assert rows(kept.select(F.transform("snippets", lambda s: s["snippet_id"]))) == [(["1", "4"],)]
    assert rows(C.filter_calls(E.explode_calls(data)), "snippet_id") == [("1",), ("4",)]


def test_only_with_calls(spark, rows):
    assert rows(E.only_with_calls(nested(spark)), "id") == [("a",), ("b",)]


def test_metrics(spark, rows):
    metrics = C.dataset_metrics(C.with_definitions(nested(spark)))
    assert rows(metrics) == [(3, 1, 1, 1, 1, 1, 7)]
    assert rows(C.dataset_metrics(C.with_definitions(nested(spark)).limit(0))) == [(0,) * 7]


def test_id_lists_of_queries_and_plans_are_sharded(spark, monkeypatch):
    from driver_queries import tables
    from logharvest.plans import code_study

    asked = []

    class Asked(Exception):
        pass

    def spy(calls, shards=1):
        asked.append(shards)
        raise Asked

    monkeypatch.setattr(C, "unique_functions", spy)
    monkeypatch.setattr(tables, "wanted", lambda *a: None)
    monkeypatch.setattr(tables, "stored", lambda *a: None)
    monkeypatch.setattr(code_study.X, "explode_calls", lambda df: df)
    for run in (lambda: tables.id_lists(spark, ""), lambda: code_study.summarize_unique(None, "")):
        try:
            run()
        except Asked:
            pass
    assert asked == [C.SHARDS] * 2 and C.SHARDS >= 1024
