from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logharvest.operators import survey as S
from logharvest.plans import survey as plan

HEADERS = {
    "Do you agree that\n 'Ambiguous logging' is bad?": "Agreement Ambiguous Logging",
    "How frequently do you see  PRINT-BASED metrics?": "Frequency Print-Based Metrics",
    "How relevant is log without context?": "Relevance Log Without Context",
    "How severe is Incorrect Log Level?": "Severity Incorrect Log Level",
    "Explain misleading logging": "Justification Misleading Logging",
    "Do you agree, and explain: heavy logging and print logging": "Agreement Heavy Logging",
    "Heavy Logging": "Heavy Logging",
    "How severe is it?": "How severe is it?",
}


def test_headers(spark):
    assert {h: S.simplify_header(h) for h in HEADERS} == HEADERS
    df = spark.createDataFrame([("a", "b", "c")], ["How severe is heavy logging", "how severe: Heavy Logging", "x.y"])
    assert S.simplify_headers(df).columns == ["Severity Heavy Logging", "Severity Heavy Logging (2)", "x.y"]


def test_metric_columns():
    columns = ["Agreement A", "A Agreement", "Severity Agreement B"]
    assert S.metric_columns(columns, "Agreement") == ["Agreement A"]
    assert S.metric_columns(columns, "Agreement", contains=True, without=["Severity"]) == columns[:2]


@pytest.fixture
def clean(spark):
    df = spark.createDataFrame([
        ("Agree", "Not sure", "Not sure / I can’t assess", "Rarely (a few times per year)", "Minor"),
        ("Agree", None, "Often (monthly)", "Never", "Severe"),
        ("Disagree", None, "Not sure", "no such option", "Minor"),
    ], ["Agreement Heavy Logging", "Agreement Print Logging", "Frequency Heavy Logging", "Frequency Print Logging", "role"])
    return S.normalize_likert(df)


def test_normalize_only_likert_columns(clean, rows):
    assert rows(clean, "role", "Frequency Heavy Logging") == [("Minor", "Neutral"), ("Minor", "Neutral"), ("Severe", "Often")]


def test_matrix(clean, rows):
    matrix = S.likert_matrix(clean, "Agreement")
    assert matrix.columns == ["topic", "Strongly disagree", "Disagree", "Neutral", "Agree", "Strongly agree"]
    assert rows(matrix) == [("Heavy Logging", 0, 1, 0, 2, 0), ("Print Logging", 0, 0, 1, 0, 0)]


def test_percent_of_listed_and_of_answered(clean, rows):
    listed = {r.topic: r for r in S.likert_percent(clean, "Frequency").collect()}
    assert (listed["Heavy Logging"]["Often"], listed["Print Logging"]["Never"]) == (100.0, 50.0)
    old = clean.select(F.col("Frequency Heavy Logging").alias("Heavy Agreement"), F.lit(None).cast("string").alias("None Agreement"))
    answered = {r.topic: r["Often"] for r in S.likert_percent_of_answered(old, "Agreement", ["Often"]).collect()}
    assert answered == {"Heavy": 1 / 3 * 100, "None": 0.0}


def test_unanswered_topic_stays_with_zeros(spark, rows):
    df = spark.createDataFrame([(None,)], "`Severity Heavy Logging` string")
    assert rows(S.likert_percent(df, "Severity")) == [("Heavy Logging", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]


def test_options_and_what_falls_off(clean, rows):
    assert [r.option for r in S.likert_options(clean, "Frequency").collect()] == ["Never", "Rarely", "Often"]
    assert rows(S.unlisted_answers(clean, "Frequency")) == [
        ("Heavy Logging", "Neutral", 2), ("Print Logging", "no such option", 1)]


def test_value_shares(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "x string")
    assert [tuple(r) for r in S.value_shares(df, "x").collect()] == [
        ("b", 2, 2 / 3 * 100, "2 (66.7%)"), ("a", 1, 1 / 3 * 100, "1 (33.3%)")]


def test_multi_select(spark, rows):
    df = spark.createDataFrame([("logging; wandb ",), ("wandb;",), (None,)], "libs string")
    found = {r.value: (r["count"], r.percent) for r in S.multi_select_counts(df, "libs").collect()}
    assert found == {"wandb": (2, 100.0), "logging": (1, 50.0), "": (1, 50.0)}


def test_survey_plan(spark):
    raw = spark.createDataFrame([("Minor", "x")], ["How severe is Heavy Logging?", "role"])
    clean = plan.clean_survey(raw)
    assert clean.collect()[0][0] == "Slightly severe"
    assert list(plan.likert_tables(clean)) == ["Severity"]
