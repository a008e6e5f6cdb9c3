from __future__ import annotations

import itertools
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from logharvest.operators import agreement as A
from logharvest.plans.agreement import compute_kappa

SCHEMA = "snippet_id string, smell string, rating string"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def plain_kappa(pairs):
    """Kappa of row pairs by its definition."""
    n = len(pairs)
    observed = Fraction(sum(a == b for a, b in pairs), n)
    left, right = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    expected = sum(Fraction(left[c] * right[c], n * n) for c in left)
    return None if expected == 1 else float((observed - expected) / (1 - expected))


cells = st.sampled_from(["yes", "no", "maybe", None])
sides = st.lists(st.tuples(st.sampled_from(["1", "2", "3", None]), st.sampled_from(["s", "t", None]), cells), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sides, sides)
def test_kappa_equals_brute_force_over_row_pairs(spark, a, b):
    """Repeated ids, null ids on both sides, missing ratings and categories."""
    joined = [(x, y) for x, y in itertools.product(a, b) if x[0] == y[0]]
    rated = [(x[1] or "<EMPTY>", x[2], y[2]) for x, y in joined if x[2] and y[2]]
    left, right = frame(spark, a), frame(spark, b)
    pairs = A.pair_annotations(left, right)
    found = {r.smell: (r.n_samples, r.kappa) for r in A.cohen_kappa_by(pairs).collect()}
    groups = {"ALL": rated} if rated else {}
    for row in rated:
        groups.setdefault(row[0], []).append(row)
    expected = {
        s: (len(g), plain_kappa([(x, y) for _, x, y in g]) if len(g) >= 2 else None) for s, g in groups.items()}
    assert found.keys() == expected.keys()
    for smell, (n, kappa) in expected.items():
        assert found[smell][0] == n
        assert found[smell][1] == (pytest.approx(kappa) if kappa is not None else None)
    meta = A.agreement_metadata(left, right, pairs).collect()[0]
    assert tuple(meta) == (len(a), len(b), len(joined), len(rated))


def test_perfect_and_symmetric(spark):
    a = frame(spark, [(str(i), "s", "yn"[i % 2]) for i in range(10)])
    b = frame(spark, [(str(i), "s", "ynn"[i % 3]) for i in range(10)])
    kappa = lambda x, y: A.cohen_kappa(A.pair_annotations(x, y)).collect()[0].kappa
    assert kappa(a, a) == 1.0
    assert kappa(a, b) == kappa(b, a)


def test_order_min_samples_and_a_category_called_all(spark):
    a = frame(spark, [("1", "ALL", "y"), ("2", "ALL", "n"), ("3", "b", "y"), ("4", None, "n")])
    result = A.cohen_kappa_by(A.pair_annotations(a, a), min_samples=2).collect()
    assert [tuple(r) for r in result] == [
        ("ALL", 4, 1.0), ("<EMPTY>", 1, None), ("ALL", 2, 1.0), ("b", 1, None)]


def test_large_counts_do_not_overflow(spark):
    pairs = spark.createDataFrame(
        [("x", "s", "a", "a", 10**12), ("y", "s", "b", "b", 10**12), ("z", "s", "a", "b", 10**12)],
        "snippet_id string, smell string, rating_a string, rating_b string, n_pairs bigint")
    row = A.cohen_kappa(pairs).collect()[0]
    assert row.n_samples == 3 * 10**12
    assert row.kappa == pytest.approx(plain_kappa([("a", "a"), ("b", "b"), ("a", "b")]))


def test_find_column():
    assert A.find_column_ci(["ID", "Snippet_Id"], "snippet_id") == "Snippet_Id"
    assert A.find_column_ci(["my snippet_id!", "x"], "snippet_id") == "my snippet_id!"
    assert A.find_column_ci(["Category", "smells"], ("smell", "category")) == "Category"
    assert A.find_column_ci(["x"], "smell") is None


def test_study(spark, rows):
    a = spark.createDataFrame([("1", "s", "y", "note"), ("2", "s", "n", None), ("3", "t", "y", None)],
                              "Snippet_ID string, Smell string, Agreement string, comment string")
    b = spark.createDataFrame([("1", "n", "other"), ("2", "n", None), ("9", "y", None)],
                              "snippet_id string, Agreement string, comment string")
    kappa, meta, differing = compute_kappa(a, b)
    assert [r.smell for r in kappa.collect()] == ["ALL", "s"]
    assert rows(meta) == [(3, 3, 2, 2)]
    assert differing.columns == ["Snippet_ID", "Smell", "Agreement_a", "comment_a", "snippet_id", "Agreement_b", "comment_b", "n_pairs"]
    assert rows(differing) == [("1", "s", "y", "note", "1", "n", "other", 1)]


def test_study_errors(spark):
    a = spark.createDataFrame([("1", "y")], "snippet_id string, Agreement string")
    other = spark.createDataFrame([("2", "y")], "snippet_id string, Agreement string")
    unrated = spark.createDataFrame([("1", None)], "snippet_id string, Agreement string")
    with pytest.raises(ValueError, match="snippet_id"):
        compute_kappa(a, other)
    with pytest.raises(ValueError, match="both ratings"):
        compute_kappa(a, unrated)
    with pytest.raises(ValueError, match="Agreement"):
        compute_kappa(a, other.select("snippet_id"))


def test_duplicate_ids(spark, rows):
    assert rows(A.duplicate_ids(frame(spark, [("1", None, "y"), ("1", None, "n"), ("2", None, "y")]))) == [("1", 2)]


def test_numbers_agree_as_numbers(spark, rows):
    a = spark.createDataFrame([("1", 1), ("2", 0), ("3", 1)], "snippet_id string, Agreement int")
    b = spark.createDataFrame([("1", 1.0), ("2", 0.0), ("3", 0.0)], "snippet_id string, Agreement double")
    kappa, metadata, differing = compute_kappa(a, b, files=("x.csv", "y.csv"))
    assert abs(kappa.filter("smell = 'ALL'").first().kappa - 0.4) < 1e-12
    assert rows(differing, "Agreement_a", "Agreement_b") == [(1, 0.0)]
    assert metadata.first().asDict() == {"file_a": "x.csv", "file_b": "y.csv", "rows_file_a": 3, "rows_file_b": 3,
                                         "rows_merged_after_join": 3, "rows_with_both_agreement": 3}


def test_rows_without_an_id_are_no_pairs_unless_asked(spark):
    make = lambda value: spark.createDataFrame(
        [(None, value, str(i)) for i in range(30)] + [("1", value, "x")], "snippet_id string, Agreement string, note string")
    kappa, _, differing = compute_kappa(make("y"), make("n"))
    assert differing.count() == 1
    assert kappa.filter("smell = 'ALL'").first().n_samples == 901
    assert compute_kappa(make("y"), make("n"), null_ids=True)[2].count() == 901
