"""Text, path and line expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Characters Python's str.strip() removes: as they are, as the inside of a Java
# regex class, and the same class without the newline for use inside one line.
SPACE_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
PY_SPACE = r"\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PY_SPACE_IN_LINE = PY_SPACE.replace(r"\s", r" \t\x0b\f\r", 1)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim Python whitespace; Spark's plain ``trim`` only removes spaces."""
    return F.btrim(col(c), F.lit(SPACE_CHARS))


def lstrip(c: Column | str) -> Column:
    return F.ltrim(col(c), F.lit(SPACE_CHARS))


def collapse_whitespace(c: Column | str) -> Column:
    """Every run of whitespace becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), rf"[{PY_SPACE}]+", " "))


def unix_newlines(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, r"\r\n?", "\n")).otherwise(c)


def source_lines(c: Column | str) -> Column:
    """Lines as the Python grammar counts them (newlines only, no form feeds)."""
    return F.split(F.regexp_replace(unix_newlines(c), r"\n\z", ""), "\n")


def strip_leading_comments(c: Column | str) -> Column:
    """Drop blank and ``#`` lines in front of the first import line.

    The first import line is the first line that, trimmed, starts with
    ``import`` or ``from``. Other lines in front of it are kept, and without
    such a line the whole text counts as the front part. The text is cut in two
    once, so each part is scanned once whatever the file length.
    """
    # A leading newline makes a match on the very first line a cut like any other.
    cut = F.split(
        F.concat(F.lit("\n"), unix_newlines(c)),
        rf"(?md)(?=^[{PY_SPACE_IN_LINE}]*(?:import|from))",
        2,
    )
    front = F.regexp_replace(
        F.get(cut, F.lit(0)), rf"(?md)^[{PY_SPACE_IN_LINE}]*(?:#[^\n]*)?(?:\n|\z)", ""
    )
    return F.concat(front, F.coalesce(F.get(cut, F.lit(1)), F.lit("")))


def root_name(snippet: Column | str) -> Column:
    """``wb`` for ``wb.log(x)``: text before the first ``(`` and the first ``.``."""
    return F.substring_index(F.substring_index(col(snippet), "(", 1), ".", 1)


def line_span(lines: Column, first: Column, last: Column) -> Column:
    """Lines ``first``..``last`` (1-based, inclusive) joined by newlines."""
    return F.array_join(F.slice(lines, first, last - first + F.lit(1)), "\n")


def _line(lines: Column, number: Column) -> Column:
    return F.when(number >= 1, F.get(lines, number - 1))


def _stripped_or_null(line: Column) -> Column:
    return F.when(line != "", strip(line))


def line_before(lines: Column, first: Column) -> Column:
    """The line above ``first``; null at the top of the file or if empty."""
    return _stripped_or_null(_line(lines, first - 1))


def line_after(lines: Column, first: Column, last: Column) -> Column:
    """The line below ``last``; at the end of the file, the one below ``first``."""
    below = F.when(last < F.size(lines), last).otherwise(first)
    return _stripped_or_null(_line(lines, below + 1))


def source_segment(
    lines: Column, first: Column, last: Column, first_col: Column, last_col: Column
) -> Column:
    """Text between two positions; columns are UTF-8 byte offsets, last exclusive.

    The columns of a syntax tree count bytes, so both cuts are made on bytes.
    """
    whole = line_span(lines, first, last).cast("binary")
    tail = F.octet_length(_line(lines, last)) - last_col
    length = F.octet_length(whole) - first_col - tail
    return F.substring(whole, first_col + 1, length).cast("string")


def relative_path(path: Column | str, root: str) -> Column:
    """Path below ``root``; a URI scheme in front is ignored."""
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    return F.regexp_replace(
        col(path), rf"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?\Q{bare}\E/+", ""
    )


def project(path: Column | str, relative: Column | str | None = None) -> Column:
    """First folder of the relative path, else the folder that holds the file."""
    path = col(path)
    relative = path if relative is None else col(relative)
    return F.coalesce(
        F.when(F.contains(relative, F.lit("/")), F.substring_index(relative, "/", 1)),
        F.try_element_at(F.split(path, "/"), F.lit(-2)),
    )


def _digest(prefix: str, text: Column, short: bool) -> Column:
    digest = F.md5(text)
    return F.concat(F.lit(prefix), F.substring(digest, 1, 8) if short else digest)


def snippet_id(
    path: Column | str, line: Column | str, snippet: Column | str, short: bool = True
) -> Column:
    """Id of a call from its path, line and text.

    The short form has 32 bits and collides from some 77,000 calls on; join and
    count on the full digest (``short=False``) at scale.
    """
    return _digest(
        "snip_", F.concat_ws("_", col(path), col(line).cast("string"), col(snippet)), short
    )


def call_key(path: Column | str, line: Column | str, snippet: Column | str) -> Column:
    """The whole digest behind a ``snippet_id``: what calls are joined and counted on."""
    return F.md5(F.concat_ws("_", col(path), col(line).cast("string"), col(snippet)))


def file_key(path: Column | str) -> Column:
    return F.md5(col(path))


def id_columns(df) -> list[str]:
    """Columns that identify a call, the deciding one first; ``snippet_id`` alone is for show and may collide."""
    return [c for c in ("call_key", "snippet_id") if c in df.columns]


def file_id(path: Column | str, short: bool = True) -> Column:
    return _digest("file_", col(path), short)


def split_ids(ids: Column | str, sep: str = ";") -> Column:
    """Rows from a ``;``-joined list (use in a ``select``)."""
    return F.explode(F.split(col(ids), re.escape(sep)))


def percent_label(count: Column | str, percent: Column | str) -> Column:
    """``12 (34.5%)``. ``format_number`` rounds the exact binary value half-even,
    as C's printf does; ``format_string`` would round its decimal form half-up."""
    shown = F.replace(F.format_number(col(percent), 1), F.lit(","), F.lit(""))
    return F.concat(col(count).cast("string"), F.lit(" ("), shown, F.lit("%)"))


def empty_bucket(c: Column | str, name: str = "<EMPTY>") -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(name))


def to_number(c: Column | str) -> Column:
    """Number from text; anything else becomes null instead of an error."""
    return F.expr(f"try_cast({_sql_name(c)} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
