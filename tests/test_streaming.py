from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logharvest.operators import frameworks as M
from logharvest.operators.catalogue import KEY
from logharvest.streaming import scan

SCHEMA = f"{KEY} string, path string, content string"
FILES = [
    ("o/a", "o/a/1.py", "import logging"),
    ("o/b", "o/b/1.py", "x = 1"),
    ("o/a", "o/a/2.py", "import WANDB"),          # better, in a later batch
    ("o/c", "o/c/9.py", "import mlflow"),
    ("o/c", "o/c/1.py", "import mlflow as m"),    # same term, smaller path
    (None, "x.py", "import sacred"),
    ("o/a", "o/a/3.py", "import warnings"),
]


def arrive(spark, folder, rows):
    """One file per row, so that a repository is cut over several batches."""
    for row in rows:
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, checkpoint):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = scan.scan_frameworks(stream, out, checkpoint)
    query.awaitTermination()
    return query


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / n) for n in ("in", "out", "checkpoint")]


def test_stream_equals_batch_and_continues(spark, folders, rows):
    source, out, checkpoint = folders
    batch = lambda n: rows(M.first_match(spark.createDataFrame(FILES[:n], SCHEMA)))
    arrive(spark, source, FILES[:3])
    run(spark, source, out, checkpoint)
    assert rows(scan.framework_matches(spark, out)) == batch(3)
    arrive(spark, source, FILES[3:])
    run(spark, source, out, checkpoint)
    assert rows(scan.framework_matches(spark, out)) == batch(len(FILES))
    run(spark, source, out, checkpoint)  # nothing new
    assert rows(scan.framework_matches(spark, out)) == batch(len(FILES))
    found = {r[KEY]: (r.matched_framework, r.matched_file_name) for r in scan.framework_matches(spark, out).collect()}
    assert found == {"o/a": ("wandb", "2.py"), "o/c": ("mlflow", "1.py"), None: ("sacred", "x.py")}


def test_repeated_batch_changes_nothing(spark, folders, rows):
    """As after a failure between the write of a batch and its commit."""
    source, out, checkpoint = folders
    arrive(spark, source, FILES)
    run(spark, source, out, checkpoint)
    before = rows(scan.scan_results(spark, out))
    run(spark, source, out, checkpoint + "-lost")
    assert rows(scan.scan_results(spark, out)) == before


def test_nothing_scanned_yet(spark, folders):
    assert scan.scan_results(spark, folders[1]).count() == 0


def test_progress(spark, rows):
    files = spark.createDataFrame(FILES, SCHEMA)
    some = M.first_match(files.filter(F.col(KEY) != "o/c"), keep_unmatched=True)
    assert rows(M.scan_progress(files, some)) == [(3, 2, 1, False)]
    assert rows(M.scan_progress(files, M.first_match(files, keep_unmatched=True))) == [(3, 3, 2, True)]


def test_match_terms_and_repository(spark, rows):
    files = spark.createDataFrame([("own/repo/x/a.py", "import dowel")], "path string, content string")
    named = M.with_repository(files, "path")
    assert rows(M.match_terms(named)) == [("own/repo", "own/repo/x/a.py", 8, "dowel", "dowel")]


def run_with_state(spark, folder, out, checkpoint):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(folder)
    query = scan.scan_frameworks_with_state(stream, out, checkpoint)
    query.awaitTermination()


def test_stream_with_state_equals_batch_and_restarts(spark, folders, rows):
    source, out, checkpoint = folders
    matches = lambda df: rows(df.select(KEY, *M.MATCH_COLUMNS))
    batch = lambda n: matches(M.first_match(spark.createDataFrame(FILES[:n], SCHEMA), keep_unmatched=True))
    arrive(spark, source, FILES[:3])
    run_with_state(spark, source, out, checkpoint)
    assert matches(scan.scan_state_results(spark, out)) == batch(3)
    arrive(spark, source, FILES[3:])
    run_with_state(spark, source, out, checkpoint)  # started again: state from the checkpoint
    assert matches(scan.scan_state_results(spark, out)) == batch(len(FILES))
    run_with_state(spark, source, out, checkpoint)  # nothing new
    assert matches(scan.scan_state_results(spark, out)) == batch(len(FILES))


def test_files_that_cannot_win_are_not_searched(spark, folders, rows):
    source, out, checkpoint = folders
    first = [("o/p", f"o/p/{i}.py", "import comet_ml") for i in range(3)]  # priority 0, the best there is
    arrive(spark, source, first)
    run_with_state(spark, source, out, checkpoint)
    later = [("o/p", f"o/p/{i}.py", "import comet_ml") for i in range(5, 9)] + [("o/p", "o/p/00.py", "x")]
    arrive(spark, source, later)
    run_with_state(spark, source, out, checkpoint)
    (row,) = scan.scan_state_results(spark, out).collect()
    assert (row.matched_file_path, row.priority) == ("o/p/0.py", 0)
    # of 8 files, each salt searches its least path and what comes before it
    assert row.files_searched + row.files_skipped == 8
    assert row.files_skipped >= 8 - 2 * scan.SCAN_SALTS and row.files_searched <= 8


def test_stream_with_state_on_random_batches(spark, folders, rows):
    import random

    rng = random.Random(3)
    words = ["import wandb", "import mlflow", "import comet_ml", "x = 1", None, "import logging"]
    files = [(rng.choice(["r/a", "r/b", "r/c", None]), rng.choice([f"p{i}.py" for i in range(30)] + [None]),
              rng.choice(words)) for _ in range(60)]
    source, out, checkpoint = folders
    for i in range(0, 60, 12):
        spark.createDataFrame(files[i:i + 12], SCHEMA).repartition(3).write.mode("append").parquet(source)
    run_with_state(spark, source, out, checkpoint)
    want = M.first_match(spark.createDataFrame(files, SCHEMA), keep_unmatched=True)
    assert rows(scan.scan_state_results(spark, out).select(KEY, "priority", "matched_file_path")) == \
        rows(want.select(KEY, "priority", "matched_file_path"))
