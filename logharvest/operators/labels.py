"""Prompts out, model answers in."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logharvest.functions import labels as L
from logharvest.functions.text import id_columns
from logharvest.operators.layout import computed_once


def build_prompts(functions: DataFrame, template: str = L.TEMPLATES["categories_or_new"]) -> DataFrame:
    """``(snippet_id, function)`` -> the same with ``prompt``."""
    return functions.withColumn("prompt", L.build_prompt("function", template))


def label_join(functions: DataFrame, responses: DataFrame) -> DataFrame:
    """Attach stored answers ``(snippet_id, response, error)``; a failed call keeps
    its row as ``LLM error: …``, one that was never made has a null answer."""
    keys = [c for c in id_columns(functions) if c in responses.columns]
    on = keys[0]
    joined = functions.select(*keys, "function").join(responses.select(on, "response", "error"), on, "left")
    return joined.select(
        *keys, "function", L.error_label("response", "error").alias("llm_output")
    )


def parse_labels(outputs: DataFrame) -> DataFrame:
    """``(snippet_id, function, llm_output)`` -> smell, rationale and confidence."""
    # As parse_smell, each answer being parsed once for its three fields.
    parsed = computed_once(outputs, "arrays", L.answer_arrays("llm_output"))
    found = computed_once(parsed, "found", L.first_object("arrays"))
    keys = id_columns(outputs)
    return found.select(*keys, "function", L.smell_fields("found").alias("label")).select(
        *keys, "function", "label.*"
    )
