"""Source files -> logging calls.

Everything here is narrow: one file is one row from the scan to the exploded
call, so extraction needs no shuffle at any corpus size.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from logharvest import dictionaries as D
from logharvest.functions import text as X
from logharvest.functions.calls import java_quote, library_type
from logharvest.operators.facts import PARSED, facts_udf
from logharvest.operators.layout import computed_once

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def mentions_library(content: Column | str, libraries: Sequence[str] = D.LIBRARIES) -> Column:
    """Cheap test in front of the parser. A readable file with a call passes: an
    imported module's name and the word ``import`` are both in its text. What
    the parser then refuses is told by ``unparsable_files``."""
    content = X.col(content)
    names = "|".join(java_quote(name) for name in libraries)
    return F.contains(content, F.lit("import")) & content.rlike(names)


def parse_files(
    files: DataFrame,
    libraries: Sequence[str] = D.LIBRARIES,
    absolute_only: bool = False,
    with_async: bool = False,
    root: str | None = None,
    keep_all: bool = False,
) -> DataFrame:
    """Add ``file_path``, ``project_name`` and ``facts`` to ``(path, content, …)``.

    Files that mention no library are dropped before they reach the parser,
    unless ``keep_all`` asks for a status of every file.
    """
    if not keep_all:
        # Files without a text, such as undecodable ones, pass and are refused by name.
        files = files.filter(F.col("content").isNull() | mentions_library("content", libraries))
    # Bytes that are no UTF-8 cannot be handed to the parser; they become null.
    text = F.try_validate_utf8(X.unix_newlines("content"))
    # A byte order mark is no part of a program.
    bare = F.when(F.startswith(text, F.lit("\ufeff")), F.substring(text, 2, 2**31 - 1)).otherwise(text)
    files = files.withColumn("content", bare)
    facts = facts_udf(libraries, absolute_only, with_async)
    relative = X.relative_path("path", root) if root else F.col("path")
    return files.select(
        "*",
        relative.alias("file_path"),
        X.project("path", relative).alias("project_name"),
        facts("content").alias("facts"),
    )


def unparsable_files(parsed: DataFrame) -> DataFrame:
    """Files the parser refused, with the reason."""
    return parsed.filter(F.col("facts.status") != PARSED).select(
        "path", "project_name", F.col("facts.status").alias("reason")
    )


def _used_libraries() -> Column:
    """Libraries of a file's calls, by first use. The leading name of a call's
    text decides, so ``(logging).info()`` counts as a call but names none."""
    imported = F.col("facts.imported")
    named = F.transform(F.col("facts.calls"), lambda c: F.try_element_at(imported, X.root_name(c["text"])))
    return F.array_compact(named)


def _identity(call: Column) -> list[Column | str]:
    """Columns of a call's file, and what the parser says about where the call is."""
    return [
        X.file_key("path").alias("file_key"), X.file_id("path").alias("file_id"),
        "path", "file_path", "project_name", "library", "library_type", "position",
        call["library"].alias("call_library"), call["function_ix"].isNotNull().alias("in_function"),
    ]


def _snippet(call: Column, path: Column, lines: Column | None) -> dict[str, Column]:
    """Columns of a call, from its facts and, if given, the lines of its file."""
    around = {} if lines is None else {
        "lines_before": X.line_before(lines, call["line"]),
        "lines_after": X.line_after(lines, call["line"], call["end_line"]),
    }
    return {
        "call_key": X.call_key(path, call["line"], call["text"]),
        "snippet_id": X.snippet_id(path, call["line"], call["text"]),
        "snippet": X.strip(call["text"]),
        "class": call["class_name"],
        **around,
        "line_number": call["line"],
    }


def _function_text(function: Column, lines: Column) -> Column:
    return X.line_span(lines, function["first"], function["last"])


def with_libraries(parsed: DataFrame, general: Sequence[str] = D.GENERAL_LIBRARIES,
                   libraries: Sequence[str] = D.LIBRARIES) -> DataFrame:
    """Add ``library`` (first used in the file) and ``library_type``; keep files with calls."""
    used = _used_libraries()
    return parsed.filter(F.size("facts.calls") > 0).withColumns(
        {
            "library": F.get(used, F.lit(0)),
            "library_type": library_type(used, general, libraries),
        }
    )


def extract_calls(parsed: DataFrame, general: Sequence[str] = D.GENERAL_LIBRARIES,
                  libraries: Sequence[str] = D.LIBRARIES, texts: bool = True) -> DataFrame:
    """One row per call: file columns, ``library`` of the file, ``call_library`` of the call.

    ``function_digest`` and ``trimmed_digest`` identify the function's text, as
    stored and trimmed. Texts and digests are built once per function, not once
    per call in it, each in a column that is dropped where nobody reads it.
    ``texts=False`` leaves out all that is cut from the file's lines, neighbouring
    lines, functions and digests: enough to filter and count calls by name and
    level, without ever splitting a file.
    """
    with_calls = with_libraries(parsed, general, libraries)
    if not texts:
        rows = with_calls.select(
            "path", "file_path", "project_name", "library", "library_type",
            F.col("facts.functions.name").alias("names"), F.posexplode("facts.calls").alias("position", "call"))
        call = F.col("call")
        columns = _snippet(call, F.col("path"), None) | {"function_name": F.get("names", call["function_ix"])}
        return rows.select(*_identity(call), *[c.alias(name) for name, c in columns.items()])
    with_calls = computed_once(with_calls, "lines", X.source_lines("content"))
    functions, lines = F.col("facts.functions"), F.col("lines")

    def per_function(value) -> Column:
        return F.transform(functions, lambda f: value(_function_text(f, lines)))

    # A step of its own in front of the explode: expressions selected beside a
    # generator are evaluated after it, which here would be once per call.
    per_file = with_calls.select(
        "path", "file_path", "project_name", "library", "library_type", "lines", "facts.calls",
        F.col("facts.functions.name").alias("names"),
        per_function(lambda text: text).alias("texts"),
        per_function(lambda text: F.sha2(text, 256)).alias("digests"),
        per_function(lambda text: F.sha2(X.strip(text), 256)).alias("trimmed"),
    )
    exploded = per_file.select("*", F.posexplode("calls").alias("position", "call"))
    call = F.col("call")
    of_function = {
        "function_name": "names", "function": "texts", "function_digest": "digests",
        "trimmed_digest": "trimmed",
    }
    columns = _snippet(call, F.col("path"), F.col("lines"))
    columns |= {name: F.get(F.col(c), call["function_ix"]) for name, c in of_function.items()}
    return exploded.select(*_identity(call), *[c.alias(name) for name, c in columns.items()])


def build_call_dataset(parsed: DataFrame, general: Sequence[str] = D.GENERAL_LIBRARIES,
                       libraries: Sequence[str] = D.LIBRARIES, bodies: bool = True) -> DataFrame:
    """One row per file with calls, the calls nested in line order.

    With ``bodies`` every call carries the text of its function, as the JSON
    form of the data set does. Without, the row holds each function once, in
    ``functions``, and a call its number there, ``context.function_ix``; such a
    row is no longer than its file allows, however many calls share a function.
    ``with_bodies`` makes the first form of the second.
    """
    lines, functions = F.col("lines"), F.col("facts.functions")
    body = "function" if bodies else "function_ix"
    texts = F.transform(functions, lambda f: _function_text(f, lines)).alias("functions")

    def nested(call: Column) -> Column:
        c = _snippet(call, F.col("path"), lines)
        owner = F.get(functions, call["function_ix"])
        text = _function_text(owner, lines) if bodies else call["function_ix"]
        c |= {"function_name": owner["name"], body: text}
        context = ["class", "function_name", body, "lines_before", "lines_after"]
        return F.struct(
            c["call_key"].alias("call_key"),
            c["snippet_id"].alias("snippet_id"),
            c["snippet"].alias("snippet"),
            F.struct(*[c[name].alias(name) for name in context]).alias("context"),
            c["line_number"].alias("line_number"),
        )

    with_calls = computed_once(
        with_libraries(parsed, general, libraries), "lines", X.source_lines("content"))
    return with_calls.select(
        X.file_id("path").alias("id"),
        "project_name",
        "file_path",
        "library",
        "library_type",
        F.col("content").alias("python_file_content"),
        F.transform("facts.calls", nested).alias("snippets"), *([] if bodies else [texts]),
        F.col("facts.n_functions").alias("n_functions"),
        F.col("facts.n_classes").alias("n_classes"),
    )


def with_bodies(file_calls: DataFrame) -> DataFrame:
    """Function texts in every call again, for sinks that want them there."""
    functions = F.col("functions")

    def expanded(s: Column) -> Column:
        c = s["context"]
        context = F.struct(
            c["class"].alias("class"), c["function_name"].alias("function_name"),
            F.get(functions, c["function_ix"]).alias("function"),
            c["lines_before"].alias("lines_before"), c["lines_after"].alias("lines_after"))
        return s.withField("context", context)

    return file_calls.withColumn("snippets", F.transform("snippets", expanded)).drop("functions")


def explode_calls(file_calls: DataFrame) -> DataFrame:
    """Nested call records (full or filtered) -> one row per call."""
    kept = [c for c in ("id", "project_name", "file_path") if c in file_calls.columns]
    # Records written before there were whole digests have the short id only.
    keyed = "call_key" in file_calls.schema["snippets"].dataType.elementType.fieldNames()
    short = F.col("s.snippet_id")
    once = "functions" in file_calls.columns
    function = F.get(F.col("functions"), F.col("s.context.function_ix")) if once else F.col("s.context.function")
    flag = [F.col("s.context.function_ix").isNotNull().alias("in_function")] if once else []
    rows = file_calls.select(
        *kept, *(["functions"] if once else []), "library", "library_type", F.posexplode("snippets").alias("position", "s")
    )
    context = ["class", "function_name", "function", "lines_before", "lines_after"]
    return rows.select(
        *kept, "library", "library_type", "position",
        (F.coalesce("s.call_key", short) if keyed else short).alias("call_key"),
        short.alias("snippet_id"),
        F.col("s.snippet").alias("snippet"),
        *[function.alias(c) if c == "function" else F.col(f"s.context.{c}").alias(c) for c in context],
        *flag,
        F.col("s.line_number").alias("line_number"),
    )


def only_with_calls(file_calls: DataFrame) -> DataFrame:
    return file_calls.filter(F.size("snippets") > 0)


def files_with_calls(parsed: DataFrame) -> DataFrame:
    """Files with at least one library call; unparsable ones are not among them."""
    return parsed.filter(F.size("facts.calls") > 0).select(
        "path", "file_path", "project_name", "content"
    )


def count_definitions(parsed: DataFrame) -> DataFrame:
    """Functions and classes per file, zero where the file cannot be parsed."""
    return parsed.select(
        "path",
        F.coalesce("facts.n_functions", F.lit(0)).alias("n_functions"),
        F.coalesce("facts.n_classes", F.lit(0)).alias("n_classes"),
    )


def imported_names(parsed: DataFrame) -> DataFrame:
    """(path, name, library): what each file calls the libraries it imports."""
    return parsed.select("path", F.explode("facts.imported").alias("name", "library"))


_SCOPE_KINDS = ("function", "class")


def _sweep(batches):
    """Innermost scope of each kind per line, over events sorted by (path, place, starts first).

    Per kind a heap of open scopes, largest first on top (then largest name);
    scopes that ended before a line leave the top as it comes to them. State
    runs across batches: a path's events are consecutive in the partition.
    """
    import heapq

    import pandas as pd

    path, heaps = object(), {}
    for batch in batches:
        out_path, out_line, out = [], [], {kind: [] for kind in _SCOPE_KINDS}
        for p, place, is_line, kind, name, last in zip(
            batch["path"], batch["place"], batch["is_line"], batch["kind"], batch["name"], batch["last"], strict=True
        ):
            if p != path:
                path, heaps = p, {k: [] for k in _SCOPE_KINDS}
            if not is_line:
                if kind in heaps:
                    heapq.heappush(heaps[kind], (-place, _Descending(name), last, name))
                continue
            out_path.append(p)
            out_line.append(place)
            for k, heap in heaps.items():
                while heap and heap[0][2] < place:
                    heapq.heappop(heap)
                out[k].append(heap[0][3] if heap else None)
        yield pd.DataFrame({"path": out_path, "line": out_line, "function_name": out["function"], "class": out["class"]})


class _Descending:
    """Orders names from largest to smallest, for ties of ``first`` in a heap of smallest on top."""

    __slots__ = ("v",)

    def __init__(self, v):
        self.v = "" if v is None else v

    def __lt__(self, other):
        return self.v > other.v

    def __eq__(self, other):
        return self.v == other.v


def enclosing_scope(calls: DataFrame, scopes: DataFrame) -> DataFrame:
    """Innermost scope around each call, for tables kept apart.

    ``calls(path, line, …)``, ``scopes(path, kind, name, first, last)``. The
    innermost scope of a kind is the one around the line that starts last (then
    the largest name). One sorted stream per path of scope starts and distinct
    call lines, swept with a heap of open scopes per kind: n log n, one row per
    distinct (path, line), whatever the scopes' lengths and however they
    overlap. Paths are dealt by hash, so a path is one task; a path is a file.
    Calls outside any scope, and calls or scopes with a null path or line,
    stay with nulls.
    """
    path_type = calls.schema["path"].dataType.simpleString()
    line_type = calls.schema["line"].dataType.simpleString()
    starts = scopes.where(
        F.col("path").isNotNull() & F.col("first").isNotNull() & F.col("last").isNotNull() & (F.col("first") <= F.col("last"))
    ).select(
        F.col("path").cast(path_type).alias("path"), F.col("first").cast("bigint").alias("place"), F.lit(False).alias("is_line"),
        F.col("kind").cast("string").alias("kind"), F.col("name").cast("string").alias("name"), F.col("last").cast("bigint").alias("last"),
    )
    lines = calls.where(F.col("path").isNotNull() & F.col("line").isNotNull()).select(
        "path", F.col("line").cast("bigint").alias("place")
    ).distinct().select(
        "path", "place", F.lit(True).alias("is_line"), F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("last"),
    )
    events = starts.unionByName(lines).repartition("path").sortWithinPartitions("path", "place", "is_line")
    around = events.mapInPandas(
        _sweep, f"path {path_type}, line bigint, function_name string, class string"
    ).select("path", F.col("line").cast(line_type).alias("line"), "function_name", "class")
    return calls.join(around, ["path", "line"], "left")
