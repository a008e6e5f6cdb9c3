from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from logharvest.plans import code_study as P
from logharvest.plans import repositories as R
from logharvest.plans.agreement import write_kappa_study
from logharvest.sources.tables import read_table_csv

SOURCE = """# comment

import logging
import wandb

logging.basicConfig()


def train(x):
    logging.{level}('start')
    wandb.init()
    wandb.log(x)
    print('logging.info(1)')
"""


@pytest.fixture
def tree(tmp_path):
    for i, level in enumerate(["info", "warn", "warning"]):
        folder = tmp_path / "tree" / f"own{i}" / "repo"
        folder.mkdir(parents=True)
        (folder / "__init__.py").write_text(SOURCE.format(level=level))
        (folder / "other.py").write_text("import os\n")
    book = {"nbformat": 4, "cells": [{"cell_type": "code", "source": ["import mlflow\n", "def f():\n", "    mlflow.log_metric('a', 1)"]}]}
    (tmp_path / "tree/own0/repo/book.ipynb").write_text(json.dumps(book))
    return tmp_path


def test_code_study(spark, tree, rows):
    at = lambda name: str(tree / name)
    files = P.clean_comments(P.ingest(spark, at("tree"), at("files")))
    P.extract_logging_files(files, at("logging_files"), root=at("tree"))
    kept = spark.read.parquet(at("logging_files"))
    assert rows(kept, "file_path") == [("own0/repo/__init__.py",), ("own0/repo/book.py",), ("own1/repo/__init__.py",), ("own2/repo/__init__.py",)]
    assert not kept.filter(F.startswith("content", F.lit("#"))).count()

    data = P.create_dataset(spark, files, at("dataset"), root=at("tree"))
    P.analyze(data, at("metrics"))
    assert rows(read_table_csv(spark, at("metrics"))) == [(4, 0, 1, 3, 4, 0, 13)]

    filtered = P.filter_dataset(spark, data, at("filtered"))
    P.summarize(filtered, at("summary"))
    summary = {(r.section, r.key): r["count"] for r in read_table_csv(spark, at("summary")).collect()}
    assert summary == {
        ("library", "logging"): 6, ("library", "mlflow"): 1, ("total", "number_of_logging_statements"): 7,
        ("total", "number_of_functions"): 4, ("log_level", "info"): 1, ("log_level", "warn"): 1,
        ("log_level", "warning"): 1,
    }
    P.summarize_unique(filtered, at("unique"))
    unique = read_table_csv(spark, at("unique"))
    assert ("logging", "unknown", 3) in rows(unique, "library", "log_level", "unique_function_count")

    P.sample(filtered, at("samples"))
    samples = read_table_csv(spark, at("samples"), "library string, log_level string, unique_function_count bigint, snippet_id string")
    assert rows(samples, "library", "log_level") == sorted(
        [("logging", "info"), ("logging", "warning"), ("logging", "warning"), ("mlflow", None)], key=repr)

    prompts = P.prompts(filtered, samples, size=3)
    assert prompts.count() == 3
    assert prompts.filter(F.contains("prompt", F.col("function"))).count() == 3
    responses = prompts.select("snippet_id", F.lit('[{"smell": "NO_SMELL"}]').alias("response"), F.lit(None).cast("string").alias("error"))
    P.labels(prompts, responses, at("labels"))
    labels = read_table_csv(spark, at("labels"), sep=";")
    assert labels.columns == ["snippet_id", "function", "smell", "rationale", "confidence"]
    assert rows(labels, "smell") == [("NO_SMELL",)] * 3


def test_repositories(spark, tmp_path, rows):
    at = lambda name: str(tmp_path / name)
    repos = spark.createDataFrame([("a/1", "Python", "40"), ("a/2", "Python", "50"), ("a/3", "C", "60")], "full_name string, language string, stars string")
    repos.write.parquet(at("catalogue"))
    report = R.select_repositories(spark, at("catalogue"), at("raw"), at("popular"), 30)
    assert rows(report) == [(3, 2)]
    popular = read_table_csv(spark, at("popular"))
    responses = spark.createDataFrame([("a/1", 200, None), ("a/2", 404, None)], "repository_full_name string, status_code int, archived boolean")
    R.collect_status(popular, responses, at("status"))
    R.merge_archived(spark, [at("status"), at("status")], at("merged"))
    merged = read_table_csv(spark, at("merged"))
    assert merged.count() == 2
    assert rows(R.manifest(merged, "/clones"), "repository_full_name") == [("a/1",)]


def test_kappa_study(spark, tmp_path, rows):
    for name, ratings in (("a", "y,n,y"), ("b", "y,n,n")):
        lines = [f"{i},s,{r}" for i, r in enumerate(ratings.split(","))]
        (tmp_path / f"{name}.csv").write_text("snippet_id,smell,Agreement\n" + "\n".join(lines) + "\n")
    write_kappa_study(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), str(tmp_path / "out"))
    kappa = {r.smell: r.kappa for r in read_table_csv(spark, str(tmp_path / "out/kappa_by_smell")).collect()}
    assert kappa["ALL"] == pytest.approx(0.4)
    differing = read_table_csv(spark, str(tmp_path / "out/disagreements"))
    assert rows(differing, "snippet_id", "Agreement_a", "Agreement_b") == [(2, "y", "n")]
