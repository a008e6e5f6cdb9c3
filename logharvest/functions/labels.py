"""Prompts for, and answers from, an external labelling model."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F

from logharvest import dictionaries as D
from logharvest.functions.text import col
from logharvest.schemas import SMELL

_ANSWER_FORMAT = """
Answer with a JSON array of one object and nothing else:
[{{"smell": "<name or NO_SMELL>", "rationale": "<short reason>", "confidence": "<High|Medium|Low>"}}]

Function:

{function}
"""

_SMELL_LIST = "\n".join(f"- {name}" for name in D.SMELLS)

# Three ways to ask. Pass your own text to build_prompt for other wordings.
TEMPLATES = {
    "open": (
        "Read this one Python function of a machine-learning system. Name the single most "
        "important smell in how it logs, in your own terms." + _ANSWER_FORMAT
    ),
    "categories_or_new": (
        "Read this one Python function of a machine-learning system. Name the single most "
        "important smell in how it logs. Use one of these names, or a short new one if none "
        "fits:\n" + _SMELL_LIST + "\n" + _ANSWER_FORMAT
    ),
    "categories": (
        "Read this one Python function of a machine-learning system. Name the single most "
        "important smell in how it logs. Use one of these names only:\n" + _SMELL_LIST + "\n"
        + _ANSWER_FORMAT
    ),
}


def build_prompt(function: Column | str, template: str = TEMPLATES["categories_or_new"]) -> Column:
    """Fill ``{function}``; the template is a Python format string, so ``{{`` and
    ``}}`` stand for braces."""
    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        parts.append(F.lit(literal))
        if field is not None:
            if field != "function":
                raise ValueError(f"unknown placeholder {{{field}}}")
            parts.append(col(function))
    return F.concat(*parts)


def error_label(response: Column | str, error: Column | str) -> Column:
    """The response, or ``LLM error: …`` so that a failed call keeps its row."""
    return F.coalesce(col(response), F.concat(F.lit("LLM error: "), col(error)))


def answer_arrays(answer: Column | str) -> Column:
    """The answer as an array in an array, null unless it is a strict JSON array.

    ``try_parse_json`` is strict about quotes and fences and reads mixed arrays,
    which ``from_json`` does not, but it stops after the first value; inside
    brackets of our own, anything behind it shows as an error or second element.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), col(answer), F.lit("]")))
    return F.try_variant_get(wrapped, "$", "array<array<variant>>")


def first_object(arrays: Column | str) -> Column:
    """First element of the only array, as a map; null if it is no object."""
    arrays = col(arrays)
    first = F.when(F.size(arrays) == 1, F.get(F.get(arrays, F.lit(0)), F.lit(0)))
    return F.try_variant_get(first, "$", "map<string,variant>")


def smell_fields(found: Column | str) -> Column:
    """``struct(smell, rationale, confidence)`` of an answer object.

    A key that is absent gives an empty string, a key that holds null a null.
    """
    found = col(found)

    def field(name: str) -> Column:
        value = F.try_element_at(found, F.lit(name))
        text = F.when(value.isNotNull(), F.try_variant_get(value, "$", "string")).otherwise("")
        return text.alias(name)

    return F.struct(field("smell"), field("rationale"), field("confidence")).cast(SMELL)


def parse_smell(answer: Column | str) -> Column:
    """``struct(smell, rationale, confidence)`` of a model answer.

    Only a JSON array whose first element is an object counts; everything else
    gives empty strings.
    """
    return smell_fields(first_object(answer_arrays(answer)))
