"""Nested JSON documents: arrays of records and objects keyed by id.

One JSON array is one value, so Spark's multi-line reader gives the whole file
to one task. Indented files, which is how such data sets are usually written,
have a separator between records that cannot occur inside a record (JSON
escapes line breaks in strings, and deeper levels are indented further), and
splitting on it makes the file as parallel as JSON lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logharvest.operators.layout import computed_once
from logharvest.schemas import LABEL_ENTRY
from logharvest.sources import json_split

_STRICT = {"allowSingleQuotes": "false"}


def read_json_array(
    spark: SparkSession, path: str, schema: str, indent: int | None = 2
) -> DataFrame:
    """Records of a JSON array.

    ``indent`` is the column at which records start: 2 for an array written
    with two-space indentation, 0 where records begin at the line start. A file
    with that indentation is read by many tasks; one in any other layout is
    read whole, by one. Text that is no array of such records is an error.
    ``None`` reads files in any layout, compact ones too, by many tasks
    (``json_split``): a scan over the lexer's states finds the records.
    """
    if indent is None:
        return json_split.read_json_records(spark, path, schema)
    pad = " " * indent
    pieces = spark.read.text(path, lineSep=f"\n{pad}}},\n{pad}{{\n")
    value = F.regexp_replace("value", r"\A\x{FEFF}", "")
    # A piece of a file in that layout: only the first and the last carry the brackets of the array.
    first = F.regexp_replace(value, r"\A\s*\[", "")
    opened = F.when(value.rlike(r"\A\s*\["), first).otherwise(F.concat(F.lit("{"), value))
    is_last = value.rlike(rf"\n{pad}\}}\s*\]\s*\z")
    piece = F.when(is_last, F.regexp_replace(opened, r"\]\s*\z", "")).otherwise(F.concat(opened, F.lit("}")))
    # A file in any other layout is one piece, and holds all records.
    closed = value.rlike(r"(?s)\A\s*\[.*\]\s*\z")
    whole = F.when(closed, F.regexp_replace(first, r"\]\s*\z", "")).otherwise(F.lit("]"))

    def parsed(text: Column) -> Column:
        # Inside an object nothing can follow the records unnoticed.
        options = _STRICT | {"columnNameOfCorruptRecord": "__bad"}
        return F.from_json(
            F.concat(F.lit('{"r": ['), text, F.lit("]}")), f"r ARRAY<STRUCT<{schema}>>, __bad STRING", options
        )

    filled = pieces.filter(value.rlike(r"\S"))
    tried = computed_once(filled, "split", parsed(piece))
    tried = computed_once(tried, "whole", F.when(F.col("split.__bad").isNotNull(), parsed(whole)))
    fits = F.col("split.__bad").isNull()
    records = F.when(fits, F.col("split.r")).when(F.col("whole.__bad").isNull(), F.col("whole.r")).otherwise(
        F.raise_error(F.concat(F.lit("not a JSON array of such records: "), F.left("value", F.lit(200))))
    )
    return tried.select(F.explode(records).alias("r")).select("r.*")


def read_json_map(
    spark: SparkSession, path: str, entry: str = LABEL_ENTRY, indent: int | None = 2,
    key: str = "snippet_id",
) -> DataFrame:
    """Entries of a JSON object keyed by id, one row each.

    ``indent`` as in :func:`read_json_array`: the column at which keys start;
    ``None``: any layout, by many tasks, and a truncated file is an error.
    """
    schema = f"MAP<STRING, {entry}>"
    if indent is None:
        return json_split.read_json_entries(spark, path, entry, key)
    else:
        pieces = spark.read.text(path, lineSep="\n" + " " * indent + "},\n").withColumn("file", F.col("_metadata.file_path"))
        # A whole file has one piece that closes the object: a truncated one has none.
        closing = F.col("value").rlike("\n" + " " * indent + r"\}\s*\}\s*\z") | F.col("value").rlike(r"\A\s*\{\s*\}\s*\z")
        closes = pieces.groupBy(F.col("file").alias("f")).agg(F.sum(closing.cast("int")).alias("closes"))
        pieces = pieces.join(F.broadcast(closes), F.col("file") == F.col("f")).select(
            F.when(F.col("closes") == 1, F.col("value"))
            .otherwise(F.raise_error(F.concat(F.lit("not one whole JSON object: "), F.col("file"))))
            .alias("value")
        )
        body = F.regexp_replace("value", r"\A\s*\{", "")
        # The last piece ends with its own brace and that of the object.
        body = F.regexp_replace(body, "\n" + " " * indent + r"\}\s*\}\s*\z", "")
        filled = pieces.select(body.alias("body")).filter(F.col("body").rlike(r":\s*\{"))
        text = F.concat(F.lit("{"), F.col("body"), F.lit("}}"))
        parsed = filled.select(F.from_json(text, schema, _STRICT).alias("m"))
    return parsed.select(F.explode("m").alias(key, "v")).select(key, "v.*")
