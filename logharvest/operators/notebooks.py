"""Notebook documents -> Python source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A notebook magic or shell line, which is not Python.
_MAGIC = r"(?md)^([ \t]*)([%!?].*)$"


def notebook_source(document: Column | str) -> Column:
    """Code cells as they are, text cells as comments, magics commented out.

    Null if the document is no notebook. Reads format 4 and the older form with
    worksheets, in which code is stored as ``input``.
    """
    document = F.col(document) if isinstance(document, str) else document
    parsed = F.try_parse_json(document)
    cells = F.coalesce(
        F.try_variant_get(parsed, "$.cells", "array<variant>"),
        F.flatten(
            F.transform(
                F.try_variant_get(parsed, "$.worksheets", "array<variant>"),
                lambda w: F.coalesce(F.try_variant_get(w, "$.cells", "array<variant>"), F.array()),
            )
        ),
    )

    def rendered(cell: Column) -> Column:
        kind = F.try_variant_get(cell, "$.cell_type", "string")
        source = F.coalesce(_joined(cell, "source"), _joined(cell, "input"), F.lit(""))
        code = F.regexp_replace(source, _MAGIC, "$1# $2")
        comment = F.regexp_replace(source, r"(?md)^", "# ")
        return F.when(kind == "code", code).otherwise(comment)

    return F.concat(F.array_join(F.transform(cells, rendered), "\n\n"), F.lit("\n"))


def _joined(cell: Column, key: str) -> Column:
    return F.coalesce(
        F.array_join(F.try_variant_get(cell, f"$.{key}", "array<string>"), ""),
        F.try_variant_get(cell, f"$.{key}", "string"),
    )


def flatten_notebooks(notebooks: DataFrame) -> DataFrame:
    """``(path, content)`` of notebooks -> ``(path, content)`` of Python files."""
    return _converted(notebooks).filter(F.col("content").isNotNull())


def broken_notebooks(notebooks: DataFrame) -> DataFrame:
    """Paths of documents that are no notebooks."""
    return _converted(notebooks).filter(F.col("content").isNull()).select("path")


def _converted(notebooks: DataFrame) -> DataFrame:
    return notebooks.select(
        F.regexp_replace("path", r"\.ipynb$", ".py").alias("path"),
        notebook_source("content").alias("content"),
    )
