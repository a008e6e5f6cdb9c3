"""The one place where Python runs on the workers: a source file's facts.

The parser of the standard library is the only thing Spark has no expression
for. This leaf reports positions and names; ids, types, libraries, function
texts, neighbours and counts are derived from them by Spark expressions.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from logharvest.schemas import FILE_FACTS

PARSED = "parsed"

_PIECE_FILES = 256
_PIECE_CHARS = 1 << 20

# Ship this module with the job, so that workers need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _bindings(nodes: Iterable[ast.AST], modules: frozenset, absolute_only: bool) -> dict:
    """Local name -> module, for imports of exactly the given modules."""
    names = {}
    for node in nodes:
        if isinstance(node, ast.Import):
            pairs = [(a, a.name) for a in node.names]
        elif absolute_only and node.level:
            continue
        else:
            pairs = [(a, node.module) for a in node.names]
        names.update({a.asname or a.name: m for a, m in pairs if m in modules})
    return names


def _callee(call: ast.Call) -> str | None:
    """``x`` for ``x(…)`` and for ``x.attr(…)``; longer chains have none."""
    target = call.func.value if isinstance(call.func, ast.Attribute) else call.func
    return target.id if isinstance(target, ast.Name) else None


def _enclosing(scopes: list, lines: list[int]) -> Iterator[int | None]:
    """Index of the innermost scope around each line; lines and scopes ascend.

    Scopes nest, so one stack serves all lines in a single sweep.
    """
    open_scopes, upcoming = [], 0
    for line in lines:
        while upcoming < len(scopes) and scopes[upcoming].lineno <= line:
            open_scopes.append(upcoming)
            upcoming += 1
        while open_scopes and scopes[open_scopes[-1]].end_lineno < line:
            open_scopes.pop()
        yield open_scopes[-1] if open_scopes else None


def _segment(lines: list[bytes], node: ast.AST) -> str:
    first, last = node.lineno - 1, node.end_lineno - 1
    if first == last:
        return lines[first][node.col_offset:node.end_col_offset].decode()
    middle = lines[first + 1:last]
    parts = [lines[first][node.col_offset:], *middle, lines[last][:node.end_col_offset]]
    return b"\n".join(parts).decode()


def file_facts(
    text: str | None, modules: frozenset, absolute_only: bool = False, with_async: bool = False
) -> dict:
    """Facts of one file; a file that cannot be parsed has only a status."""
    if text is None:
        return {"status": "no text"}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        return {"status": type(problem).__name__}

    function_types = (ast.FunctionDef, ast.AsyncFunctionDef) if with_async else ast.FunctionDef
    imports, functions, classes, found = [], [], [], []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            found.append(node)
        elif isinstance(node, function_types):
            functions.append(node)
        elif isinstance(node, ast.ClassDef):
            classes.append(node)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            imports.append(node)

    imported = _bindings(imports, modules, absolute_only)
    found = [(imported[name], call) for call in found if (name := _callee(call)) in imported]
    found.sort(key=lambda item: (item[1].lineno, item[1].col_offset, -item[1].end_lineno))
    functions.sort(key=lambda f: f.lineno)
    classes.sort(key=lambda c: c.lineno)

    at = [call.lineno for _, call in found]
    function_at, class_at = list(_enclosing(functions, at)), list(_enclosing(classes, at))
    used = {ix: rank for rank, ix in enumerate(sorted({ix for ix in function_at if ix is not None}))}
    lines = text.encode().split(b"\n") if found else []
    return {
        "status": PARSED,
        "n_functions": len(functions),
        "n_classes": len(classes),
        "imported": list(imported.items()),
        "functions": [
            {"name": functions[ix].name, "first": functions[ix].lineno, "last": functions[ix].end_lineno}
            for ix in used
        ],
        "calls": [
            {
                "line": call.lineno,
                "end_line": call.end_lineno,
                "library": library,
                "text": _segment(lines, call),
                "function_ix": used.get(f),
                "class_name": None if c is None else classes[c].name,
            }
            for (library, call), f, c in zip(found, function_at, class_at)
        ],
    }


def _pieces(batch: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch in order, by at most ``_PIECE_FILES`` or once ``_PIECE_CHARS`` are reached."""
    texts, chars = [], 0
    for value in batch:
        text = value.as_py()
        texts.append(text)
        chars += len(text or "")
        if len(texts) == _PIECE_FILES or chars >= _PIECE_CHARS:
            yield texts
            texts, chars = [], 0
    if texts:
        yield texts


def facts_udf(modules: Sequence[str], absolute_only: bool = False, with_async: bool = False):
    """``udf(content) -> facts``, a piece of an Arrow batch at a time.

    Facts of a file take many times its size as Python objects. So they go out
    as soon as a piece's worth is there, however many files a batch holds.
    Marked non-deterministic on purpose: Catalyst would otherwise run the parser
    twice, once for a filter on its result and once for the projection.
    """
    schema = T._parse_datatype_string(FILE_FACTS)
    arrow_type = to_arrow_type(schema)
    wanted = frozenset(modules)

    @arrow_udf(schema)
    def facts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in _pieces(batch):
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    rows = [file_facts(text, wanted, absolute_only, with_async) for text in texts]
                yield pa.array(rows, type=arrow_type)

    return facts.asNondeterministic()
