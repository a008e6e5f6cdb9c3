"""Filtering, counting and summarising logging calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logharvest import dictionaries as D
from logharvest.functions import calls as C
from logharvest.functions.text import id_columns, strip
from logharvest.operators.facts import facts_udf
from logharvest.operators.layout import computed_once


# -- filters ----------------------------------------------------------------

def in_function_only(calls: DataFrame) -> DataFrame:
    """Calls within a function; told by a flag where there is one, so that bodies are not read."""
    flag = "in_function" in calls.columns
    return calls.filter(F.col("in_function") if flag else C.in_function("function_name", "function"))


def filter_calls(calls: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """Calls inside a function that log rather than configure (flat table)."""
    return in_function_only(calls).filter(C.is_wanted_call("snippet", prefixes))


def filter_file_calls(file_calls: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """The same on nested records; records without a call left are dropped.

    Works inside each row, so neither the file texts nor the calls are moved.
    """
    once = "functions" in file_calls.columns

    def keep(s: Column) -> Column:
        if once:
            inside = s["context"]["function_ix"].isNotNull()
        else:
            inside = C.in_function(s["context"]["function_name"], s["context"]["function"])
        return inside & C.is_wanted_call(s["snippet"], prefixes)

    # Computed once, for the size test and for the result.
    kept = computed_once(file_calls, "kept", F.filter("snippets", keep))
    return kept.filter(F.size("kept") > 0).select(
        "library", "library_type", F.col("kept").alias("snippets"), *(["functions"] if once else [])
    )


# -- counts -----------------------------------------------------------------

def with_definitions(file_calls: DataFrame, with_async: bool = False) -> DataFrame:
    """Count functions and classes from the stored file text, for records read
    back from a file. Records just extracted already carry the counts."""
    facts = facts_udf([], with_async=with_async)
    return (
        file_calls.withColumn("facts", facts("python_file_content"))
        .withColumns(
            {
                "n_functions": F.coalesce("facts.n_functions", F.lit(0)),
                "n_classes": F.coalesce("facts.n_classes", F.lit(0)),
            }
        )
        .drop("facts")
    )


def dataset_metrics(file_calls: DataFrame) -> DataFrame:
    """One row: files, files by type, functions, classes and calls."""
    def files_of(kind: str) -> Column:
        return F.count_if(F.col("library_type") == kind)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    return file_calls.agg(
        F.count(F.lit(1)).alias("number_of_python_files"),
        files_of("general-purpose").alias("number_of_general_purpose"),
        files_of("ML-specific").alias("number_of_ml_specific"),
        files_of("hybrid").alias("number_of_hybrid"),
        total(F.col("n_functions")).alias("number_of_functions"),
        total(F.col("n_classes")).alias("number_of_classes"),
        total(F.size("snippets")).alias("number_of_logging_statements"),
    )


def library_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("library").agg(F.count(F.lit(1)).alias("count"))


def total_calls(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count(F.lit(1)).alias("number_of_logging_statements"))


def function_digest(calls: DataFrame, trimmed: bool = False) -> Column:
    """What is compared and shuffled in place of a function body; null if empty.

    Calls straight from the sources carry it, so that counting need not read
    the bodies; for other stored calls it is computed.
    """
    ready = "trimmed_digest" if trimmed else "function_digest"
    if ready in calls.columns:
        return F.col(ready)
    text = strip("function") if trimmed else F.col("function")
    return F.when(F.col("function") != "", F.sha2(text, 256))


def distinct_functions(calls: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct non-empty function bodies, compared as stored."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return calls.agg(count(function_digest(calls)).alias("number_of_functions"))


def level_counts(calls: DataFrame) -> DataFrame:
    """Calls per level, for files of library ``logging``; no level, no row."""
    return (
        calls.filter(F.col("library") == "logging")
        .select(C.log_level("snippet").alias("log_level"))
        .filter(F.col("log_level").isNotNull())
        .groupBy("log_level")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def summarize_calls(calls: DataFrame, mode: str = "reference") -> DataFrame:
    """Library counts, totals and level counts as ``(section, key, count)``.

    One pass: each call contributes a few (section, key) rows, combined on the
    map side. Distinct functions ride along with their digest as key and are
    folded into one row by the second, small aggregation.
    """
    library = C.reassign_library("library", "library_type", "snippet", mode)
    level = F.when(library == "logging", C.log_level("snippet"))
    digest = function_digest(calls)

    def row(section: str, key: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"))

    facts = F.array(
        row("library", library),
        row("total", F.lit("number_of_logging_statements")),
        F.when(digest.isNotNull(), row("function", digest)),
        F.when(level.isNotNull(), row("log_level", level)),
    )
    counted = (
        calls.select(F.explode(F.array_compact(facts)).alias("fact"))
        .select("fact.*")
        .groupBy("section", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    is_function = F.col("section") == "function"
    return (
        counted.select(
            F.when(is_function, "total").otherwise(F.col("section")).alias("section"),
            F.when(is_function, "number_of_functions").otherwise(F.col("key")).alias("key"),
            F.when(is_function, F.lit(1)).otherwise(F.col("n")).alias("n"),
        )
        .groupBy("section", "key")
        .agg(F.sum("n").alias("count"))
    )


# -- unique functions -------------------------------------------------------

def _grouped_calls(calls: DataFrame) -> DataFrame:
    level = F.when(
        F.col("library") == "logging", F.coalesce(C.log_level("snippet"), F.lit("unknown"))
    )
    rows = calls.filter(F.col("snippet_id") != "").select(
        "library", level.alias("log_level"), *id_columns(calls),
        function_digest(calls, trimmed=True).alias("digest"),
    )
    return rows.filter(F.col("digest").isNotNull())


def unique_function_counts(calls: DataFrame) -> DataFrame:
    """Distinct trimmed function bodies per library, and per level for ``logging``."""
    return (
        _grouped_calls(calls)
        .groupBy("library", "log_level")
        .agg(F.count_distinct("digest").alias("unique_function_count"))
    )


def unique_function_ids(calls: DataFrame) -> DataFrame:
    """The call ids behind the counts, one row per id."""
    return _grouped_calls(calls).select("library", "log_level", *id_columns(calls)).distinct()


# Lists per group for tables of any size.
SHARDS = 1024


def unique_functions(calls: DataFrame, shards: int) -> DataFrame:
    """Counts with sorted id lists: ``(library, log_level, part, unique_function_count, snippet_ids)``.

    Every group is dealt over ``shards`` lists by a hash of its ids, whatever its
    size; a list has one entry per call, also where short ids collide. The
    number is the caller's to give: one list only for groups known to fit a
    row; others take ``SHARDS``. For ids
    without lists, which no group makes too long for a row, join
    ``unique_function_ids`` with ``unique_function_counts``.
    """
    keys = id_columns(calls)
    grouped = _grouped_calls(calls)
    counts = grouped.groupBy("library", "log_level").agg(
        F.count_distinct("digest").alias("unique_function_count")
    )
    listed = (
        grouped.select("library", "log_level", *keys).distinct()
        .groupBy("library", "log_level", F.pmod(F.xxhash64(keys[0]), F.lit(shards)).alias("part"))
        .agg(F.array_sort(F.collect_list("snippet_id")).alias("snippet_ids"))
    )
    # A few rows on either side: groups, and groups times shards.
    same_group = listed["library"].eqNullSafe(counts["library"]) & listed["log_level"].eqNullSafe(
        counts["log_level"]
    )
    return listed.join(counts, same_group).select(
        listed["library"], listed["log_level"], "part", "unique_function_count", "snippet_ids"
    )
