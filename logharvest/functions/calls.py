"""Classification of a logging call by its text, and of a file by its libraries."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from logharvest import dictionaries as D
from logharvest.functions.text import PY_SPACE, col, lstrip


def starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    """One anchored pattern for all prefixes, tried on as many characters as the
    longest of them has: the cost does not depend on how long the text is."""
    head = F.substring(c, 1, max(len(p) for p in prefixes))
    return head.rlike(r"\A(?:" + "|".join(java_quote(p) for p in prefixes) + ")")


def java_quote(text: str) -> str:
    """Literal text inside a Java pattern."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def log_level(snippet: Column | str, levels: Sequence[str] = D.LOG_LEVELS) -> Column:
    """Level of ``logging.<level>(``; null for any other text."""
    text = lstrip(snippet)
    # Only the part up to the first bracket is looked at, however long the call.
    name = F.substring_index(text, "(", 1)
    found = F.regexp_extract(name, rf"\Alogging\.({_either(levels)})[{PY_SPACE}]*\z", 1)
    return F.nullif(F.when(F.contains(text, F.lit("(")), found), F.lit(""))


def _either(names: Sequence[str]) -> str:
    """Longer names first, so that "warning" does not stop at "warn"."""
    return "|".join(sorted(names, key=len, reverse=True))


def library_type(
    used: Column | str,
    general: Sequence[str] = D.GENERAL_LIBRARIES,
    known: Sequence[str] = D.LIBRARIES,
) -> Column:
    """hybrid, general-purpose, ML-specific or null for an array of libraries."""
    used = col(used)
    has_general = F.arrays_overlap(used, _literals(general))
    has_ml = F.arrays_overlap(used, _literals([k for k in known if k not in general]))
    return (
        F.when(has_general & has_ml, "hybrid")
        .when(has_general, "general-purpose")
        .when(has_ml, "ML-specific")
    )


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def reassign_library(
    library: Column | str,
    lib_type: Column | str,
    snippet: Column | str,
    mode: str = "reference",
    names: Sequence[str] = tuple(D.CONFIG_PREFIXES),
) -> Column:
    """Library of a call in a hybrid file that is filed under ``logging``.

    ``intended`` moves the call to the first library whose name, followed by a
    dot, is found in the call. ``reference`` leaves it: the published counts
    were made with a search that never matches.
    """
    if mode not in ("reference", "intended"):
        raise ValueError(f"mode must be 'reference' or 'intended', not {mode!r}")
    library = col(library)
    if mode == "reference":
        return library
    mentioned = F.coalesce(
        *[F.when(col(snippet).rlike(rf"\b{java_quote(n)}\."), F.lit(n)) for n in names]
    )
    applies = (library == "logging") & (col(lib_type) == "hybrid")
    return F.when(applies, F.coalesce(mentioned, library)).otherwise(library)


def is_tf_summary(snippet: Column | str) -> Column:
    return F.startswith(lstrip(snippet), F.lit("tf.summary"))


def is_tf_logging(snippet: Column | str) -> Column:
    """TensorFlow calls that do log: ``tf.summary…`` and the v1 logging module."""
    text = lstrip(snippet)
    name = F.substring_index(text, "(", 1)
    v1 = name.rlike(rf"\Atf\.compat\.v1\.logging\.(?:{_either(D.TF_LOG_LEVELS)})[{PY_SPACE}]*\z")
    is_v1 = F.startswith(text, F.lit("tf.compat.v1.logging.")) & F.contains(text, F.lit("(")) & v1
    return is_tf_summary(snippet) | is_v1


def is_tf_other(snippet: Column | str) -> Column:
    return starts_with_any(lstrip(snippet), D.TF_OTHER_PREFIXES)


def is_config_call(snippet: Column | str, prefixes: Sequence[str] | None = None) -> Column:
    """Starts with a configuration prefix of any library."""
    return starts_with_any(lstrip(snippet), prefixes or D.config_prefixes())


def is_config_call_of(
    snippet: Column | str,
    library: Column | str,
    prefixes: Mapping[str, Sequence[str]] = D.CONFIG_PREFIXES,
) -> Column:
    """Starts with a configuration prefix of its own library."""
    text, library = lstrip(snippet), col(library)
    hits = [(library == name) & starts_with_any(text, list(p)) for name, p in prefixes.items()]
    return F.coalesce(reduce(or_, hits), F.lit(False))


def in_function(function_name: Column | str, function: Column | str) -> Column:
    return F.coalesce((col(function_name) != "") & (col(function) != ""), F.lit(False))


def is_wanted_call(snippet: Column | str, prefixes: Sequence[str] | None = None) -> Column:
    """Kept by the call filter: logs through TensorFlow, or is neither another
    TensorFlow/Keras call nor configuration."""
    snippet = F.coalesce(col(snippet), F.lit(""))
    return is_tf_logging(snippet) | ~(is_tf_other(snippet) | is_config_call(snippet, prefixes))
