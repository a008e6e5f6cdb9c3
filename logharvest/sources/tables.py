"""Flat tables: CSV and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from logharvest import dictionaries as D
from logharvest.operators.catalogue import union_all


def read_table_csv(
    spark: SparkSession, path: str, schema: str | None = None, sep: str = ",",
    encoding: str | None = None, multiline: bool = True,
) -> DataFrame:
    """Headed CSV with quotes doubled inside quotes.

    Types are inferred unless a schema is given; give one for large files, it
    saves a pass. ``multiline=False`` lets Spark split a file whose cells hold
    no line breaks.
    """
    reader = (
        spark.read.option("header", True).option("sep", sep)
        .option("quote", '"').option("escape", '"').option("multiLine", multiline)
    )
    if encoding:
        reader = reader.option("encoding", encoding)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def read_many_csv(
    spark: SparkSession, paths: Sequence[str], schema: str | None = None, multiline: bool = True
) -> DataFrame:
    """Several CSV files or globs, each with its own header, united by column name.

    ``multiline=False`` as in :func:`read_table_csv`: then large files are split.
    """
    return union_all([read_table_csv(spark, p, schema, multiline=multiline) for p in paths])


def read_catalogue_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def null_tokens(df: DataFrame, tokens: Sequence[str] = tuple(D.NULL_TOKENS)) -> DataFrame:
    """Text cells that stand for "no value" become null."""
    text = [name for name, kind in df.dtypes if kind == "string"]
    return df.withColumns(
        {c: F.when(~F.col(f"`{c}`").isin(list(tokens)), F.col(f"`{c}`")) for c in text}
    )


def read_annotations(
    spark: SparkSession, path_a: str, path_b: str, schema: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Two annotators' tables (CSV, or Parquet by suffix); a missing one is an error."""
    def read(path: str) -> DataFrame:
        if path.rstrip("/").endswith(".parquet"):
            return null_tokens(spark.read.parquet(path))
        return null_tokens(read_table_csv(spark, path, schema))

    return read(path_a), read(path_b)


def read_survey_csv(spark: SparkSession, path: str, encoding: str = "windows-1252") -> DataFrame:
    """Survey export; headers and answers may hold line breaks. All columns are text.

    Spark reads only a few encodings unless ``spark.sql.legacy.javaCharsets``
    is on, which the session must say (see ``session.recommended``).
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.option("encoding", encoding).csv(path)


def read_parquet_if_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A stored table, or None where nothing has been stored yet."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
