"""Prompts and answers. Events stand for answers, conversations for calls to a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import table, texts
from logharvest.functions import labels as L
from logharvest.functions import text as X
from logharvest.functions.matching import smell_label
from logharvest.operators import labels as O

TEMPLATE = "Look at {{this}}:\n{function}\nEnd of {{function}}."


def prompts(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("snippet_id"), F.col("text").alias("function"))
    return O.build_prompts(docs, TEMPLATE).select("snippet_id", F.md5("prompt").alias("prompt_md5"))


_PROMPTS_SQL = """
SELECT doc_id AS snippet_id,
       md5('Look at {this}:' || chr(10) || text || chr(10) || 'End of {function}.') AS prompt_md5
FROM documents"""


def label_join(spark, sf_dir):
    """Every turn asks, and the next one answers; every third answer was an error."""
    turns = table(spark, sf_dir, "conversations")
    named = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    asked = turns.select(named(F.col("turn")).alias("snippet_id"), F.col("text").alias("function"))
    failed = F.col("conv_id") % 3 == 0
    answers = turns.filter("turn > 0").select(
        named(F.col("turn") - 1).alias("snippet_id"),
        F.when(~failed, F.col("text")).alias("response"),
        F.when(failed, F.col("role")).alias("error"))
    return O.label_join(asked, answers)


_JOIN_SQL = """
SELECT q.conv_id || '-' || q.turn AS snippet_id, q.text AS function,
       CASE WHEN a.conv_id IS NULL THEN NULL WHEN a.conv_id % 3 = 0 THEN 'LLM error: ' || a.role ELSE a.text END AS llm_output
FROM conversations q LEFT JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1"""


def _answer():
    """Eleven kinds of answers, by event: the valid ones hold the event's value."""
    number = F.get_json_object("props", "$.k")
    row = F.concat(F.lit('{"smell": "'), F.col("event_type"), F.lit('", "rationale": "k='), number,
                   F.lit('", "confidence": "High"}'))
    kind = F.col("event_id") % 11
    wrapped = lambda before, after: F.concat(F.lit(before), row, F.lit(after))
    return (
        F.when(kind == 0, wrapped(" [", "]\n"))
        .when(kind == 1, row)                                    # lone object
        .when(kind == 2, wrapped("```json\n[", "]\n```"))        # fenced
        .when(kind == 3, F.replace(wrapped("[", "]"), F.lit('"'), F.lit("'")))
        .when(kind == 4, wrapped("[", "] done"))                 # trailing text
        .when(kind == 5, F.lit("[]"))
        .when(kind == 6, F.concat(F.lit("["), number, F.lit("]")))
        .when(kind == 7, wrapped("[", ", 1]"))                   # mixed array
        .when(kind == 8, F.concat(F.lit('[{"smell": null, "confidence": "'), number, F.lit('"}]')))
        .when(kind == 9, F.concat(F.lit("LLM error: "), number))
        .otherwise(wrapped("[", "]"))
    )


def parsed_labels(spark, sf_dir):
    outputs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("snippet_id"), F.col("event_type").alias("function"),
        _answer().alias("llm_output"))
    return O.parse_labels(outputs)


_PARSED_SQL = """
WITH e AS (SELECT event_id, event_type, event_id % 11 AS kind, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id AS snippet_id, event_type AS function,
       CASE WHEN kind IN (0, 7, 10) THEN event_type WHEN kind = 8 THEN NULL ELSE '' END AS smell,
       CASE WHEN kind IN (0, 7, 10) THEN 'k=' || k ELSE '' END AS rationale,
       CASE WHEN kind IN (0, 7, 10) THEN 'High' WHEN kind = 8 THEN k ELSE '' END AS confidence
FROM e"""


def smell_labels(spark, sf_dir):
    """Which of some words occurs in a text, the first of them winning."""
    words = ("Where", "THERE", "which", "sich")
    return texts(spark, sf_dir, "documents").select(
        "doc_id", X.empty_bucket(smell_label("text", words)).alias("smell"))


_SMELL_SQL = """
SELECT doc_id, CASE WHEN contains(lower(text), 'where') THEN 'Where' WHEN contains(lower(text), 'there') THEN 'THERE'
                    WHEN contains(lower(text), 'which') THEN 'which' WHEN contains(lower(text), 'sich') THEN 'sich'
                    ELSE '<EMPTY>' END AS smell
FROM documents"""

QUERIES = {
    "prompts": (prompts, _PROMPTS_SQL),
    "label_join": (label_join, _JOIN_SQL),
    "parsed_labels": (parsed_labels, _PARSED_SQL),
    "smell_labels": (smell_labels, _SMELL_SQL),
}
