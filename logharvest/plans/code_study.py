"""Source tree -> call data set -> summaries, samples and labels.

Each step stores a table, so a long study can be resumed at any step, lost
executors cost only the step at hand, and later steps never parse again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from logharvest import dictionaries as D
from logharvest.functions.text import id_columns, strip_leading_comments
from logharvest.operators import calls as C
from logharvest.operators import extraction as X
from logharvest.operators import labels as L
from logharvest.operators import sampling as W
from logharvest.operators.notebooks import broken_notebooks, flatten_notebooks
from logharvest.session import stored
from logharvest.sources import sinks
from logharvest.sources.code import read_notebook_tree, read_source_tree


def ingest(spark: SparkSession, root: str, target: str, notebooks: bool = True) -> DataFrame:
    """Source files, and notebooks as source files, into one Parquet table; notebooks
    that cannot be read go to ``<target>-broken``."""
    files = read_source_tree(spark, root)
    if notebooks:
        books = read_notebook_tree(spark, root)
        broken_notebooks(books).write.mode("overwrite").parquet(f"{target.rstrip('/')}-broken")
        files = files.unionByName(flatten_notebooks(books))
    files.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def clean_comments(files: DataFrame) -> DataFrame:
    """Files without the comments in front of their first import."""
    return files.withColumn("content", strip_leading_comments("content"))


def extract_logging_files(files: DataFrame, target: str, root: str | None = None) -> None:
    """Store the files that call a logging library, by project."""
    sinks.write_files(X.files_with_calls(X.parse_files(files, root=root)), target)


def create_dataset(
    spark: SparkSession, files: DataFrame, target: str, root: str | None = None,
    libraries: Sequence[str] = tuple(D.LIBRARIES),
) -> DataFrame:
    """Store the nested data set, and beside it, in ``<target>-refused``, the files
    that name a library but cannot be parsed or decoded."""
    # Stored: parsing costs far more than reading what was parsed.
    parsed = stored(X.parse_files(files, libraries, root=root), "parsed")
    refused = X.unparsable_files(parsed)
    refused.write.mode("overwrite").parquet(f"{target.rstrip('/')}-refused")
    X.build_call_dataset(parsed, libraries=libraries, bodies=False).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def analyze(dataset: DataFrame, target: str) -> None:
    sinks.write_metrics_row(C.dataset_metrics(dataset), target)


def filter_dataset(spark: SparkSession, dataset: DataFrame, target: str) -> DataFrame:
    """The wanted calls, nested; each file's functions once (``extraction.with_bodies`` for JSON)."""
    C.filter_file_calls(dataset).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def summarize(filtered: DataFrame, target: str) -> None:
    sinks.write_report(C.summarize_calls(X.explode_calls(filtered)), target)


def summarize_unique(filtered: DataFrame, target: str) -> None:
    sinks.write_csv(sinks.join_lists(C.unique_functions(X.explode_calls(filtered), C.SHARDS)), target)


def sample(filtered: DataFrame, target: str, seed: int = 42) -> None:
    calls = X.explode_calls(filtered)
    counts = C.unique_function_counts(calls)
    ids = C.unique_function_ids(calls)
    # Drawn first: the counts join a sample, not all ids. They belong to the level as it was.
    drawn = W.stratified_sample(ids.withColumn("own_level", F.col("log_level")), seed=seed)
    same = drawn["library"].eqNullSafe(counts["library"]) & drawn["own_level"].eqNullSafe(counts["log_level"])
    rows = drawn.join(counts, same).select(
        drawn["library"], drawn["log_level"], "unique_function_count", *reversed(id_columns(ids))
    )
    sinks.write_csv(rows, target)


def prompts(filtered: DataFrame, samples: DataFrame, size: int = D.LABEL_SAMPLE_SIZE, seed: int = 42) -> DataFrame:
    """Prompts for a balanced part of the sample."""
    chosen = W.balanced_sample(samples, size, seed)
    calls = X.explode_calls(filtered)
    order = ["line_number", "position", "function"]
    return L.build_prompts(W.functions_for_ids(calls, chosen, order))


def labels(functions: DataFrame, responses: DataFrame, target: str) -> None:
    """Model answers -> smells, as ``;``-separated CSV."""
    sinks.write_csv(L.parse_labels(L.label_join(functions, responses)), target, sep=";")
