from __future__ import annotations

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from logharvest import dictionaries as D
from logharvest.operators import sampling as W

IDS = "library string, log_level string, snippet_id string"


def key(i, seed=42):
    return (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i)


def population(spark, sizes):
    data = [(lib, lvl, f"{lib}-{lvl}-{i}") for (lib, lvl), n in sizes.items() for i in range(n)]
    return spark.createDataFrame(data, IDS)


def test_stratified_sample_is_the_lowest_keys_of_each_stratum(spark):
    sizes = {("logging", "Warn"): 300, ("logging", "warning"): 300, ("logging", "info"): 20, ("logging", "log"): 9,
             ("logging", "unknown"): 9, ("wandb", None): 500, ("other", None): 5}
    df = population(spark, sizes)
    sample = [(r.library, r.log_level, r.snippet_id) for r in W.stratified_sample(df).collect()]
    assert len({s[2] for s in sample}) == len(sample)
    of = lambda lib, lvl: {s[2] for s in sample if s[:2] == (lib, lvl)}
    everything = [(r.library, r.log_level, r.snippet_id) for r in df.collect()]
    warnings = [i for lib, lvl, i in everything if lvl in ("Warn", "warning")]
    assert of("logging", "warning") == set(sorted(warnings, key=key)[:293])
    assert len(of("logging", "info")) == 20
    wandb = [i for lib, _, i in everything if lib == "wandb"]
    assert of("wandb", None) == set(sorted(wandb, key=key)[:237])
    assert len(sample) == 293 + 20 + 237


def test_an_id_in_two_strata_is_drawn_once_and_for_the_first(spark):
    df = spark.createDataFrame([("logging", "info", "x"), ("logging", "warning", "x"), ("wandb", None, "x")], IDS)
    (row,) = W.stratified_sample(df).collect()
    assert tuple(row) == ("logging", "warning", "x")


def test_sample_ignores_partitioning_and_follows_the_seed(spark, rows):
    df = population(spark, {("logging", "info"): 1000})
    one, other = W.stratified_sample(df.repartition(1)), W.stratified_sample(df.repartition(7, "snippet_id"))
    assert rows(one) == rows(other)
    assert rows(one) != rows(W.stratified_sample(df, seed=7))


def test_quota_violations(spark, rows):
    df = population(spark, {("logging", "fatal"): 11, ("sacred", None): 3, ("none", None): 1})
    assert rows(W.quota_violations(df)) == sorted(
        [("logging", "fatal", 11), ("none", None, 1), ("sacred", None, 3)], key=repr)
    assert rows(W.quota_violations(W.stratified_sample(df))) == []


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 60), min_size=1, max_size=4), st.integers(1, 80))
def test_balanced_sample_properties(spark, sizes, size):
    df = population(spark, {(f"lib{i}", None): n for i, n in enumerate(sizes)})
    present = [n for n in sizes if n]
    chosen = [r.snippet_id for r in W.balanced_sample(df, size).collect()]
    assert len(set(chosen)) == len(chosen)
    if not present:
        assert chosen == []
        return
    quota = max(1, size // len(present))
    even = sum(min(quota, n) for n in present)
    assert len(chosen) == max(even, min(size, sum(present)))


def test_balanced_sample_may_exceed_its_size(spark):
    df = population(spark, {(f"lib{i}", None): 2 for i in range(5)})
    assert W.balanced_sample(df, 3).count() == 5


def test_balanced_sample_skips_selected_and_fills_from_nameless(spark, rows):
    df = spark.createDataFrame(
        [("a", "1", "yes"), ("a", "2", "no"), (None, "3", "no"), (None, "4", "no")],
        "library string, snippet_id string, selected string")
    assert rows(W.balanced_sample(df, 10)) == [("2",), ("3",), ("4",)]


def test_large_quota_beyond_the_map_side_limit(spark):
    df = population(spark, {("a", None): 6000})
    assert W.stratified_sample(df, [("a", None, 5000)]).count() == 5000


def test_flags(spark, rows):
    df = W.add_default_column(spark.createDataFrame([("a", "1"), ("a", "2"), ("a", None)], "library string, snippet_id string"))
    flagged = W.flag_selected(df, spark.createDataFrame([("2",), ("2",)], "snippet_id string"))
    assert rows(flagged) == sorted([("a", "1", "no"), ("a", "2", "yes"), ("a", None, "no")], key=repr)
    assert W.add_default_column(flagged).columns == flagged.columns


def test_functions_for_ids(spark, rows):
    calls = spark.createDataFrame(
        [("x", "old", "a.py", 1), ("x", "new", "a.py", 2), ("x", "", "b.py", 0), ("y", "f", "a.py", 1)],
        "snippet_id string, function string, file_path string, position int")
    ids = spark.createDataFrame([("x",), ("z",)], "snippet_id string")
    assert rows(W.functions_for_ids(calls, ids)) == [("x", "new")]


def test_hot_group_is_cut_before_the_shuffle(spark):
    """The planned sizes are within the map-side limit."""
    df = population(spark, {("logging", "info"): 10})
    plan = W.stratified_sample(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") >= 2 and "WindowGroupLimit" in plan
    assert max(n for _, _, n in D.SAMPLE_PLAN) <= int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
