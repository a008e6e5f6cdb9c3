"""JSON arrays of records and objects of entries, in any layout, read by many tasks.

One JSON value is one record to Spark's multi-line reader, so a file is one
task. Here Spark's text reader cuts every file after each ``}`` (by byte ranges,
as for JSON lines), and a prefix scan over the pieces finds the records:

1. Per piece, the lexer's effect for each state it may start in (outside a
   string, inside one, just after a backslash inside one): the state it ends
   in and the change of depth. Effects compose, so each split of a file is
   summed up in one row.
2. The driver runs through the splits of each file in order (one small row
   each) and gives each split the state and depth it starts at.
3. Each split is read again from there; the text at depth 1 and below, cut at
   the commas of depth 1, is a record (arrays) or an entry (objects). Pieces of
   a record carry its number, which is the count of such commas before it.
4. Pieces of a record come together by a shuffle on (file, number), and
   ``from_json`` parses them.

A file's length (Spark's ``_metadata``) tells whether its last piece was
followed by a ``}``. Text that is not one array (object) of such records,
truncated files and trailing text raise an error. Empty arrays and objects give
no rows; so does an empty file, which the reader never sees.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logharvest.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUT, IN, ESCAPED = 0, 1, 2
_OPEN, _CLOSE = "{[", "}]"


def effect(text: str, state: int) -> tuple[int, int]:
    """(state at the end, change of depth) of the lexer over ``text``, from ``state``."""
    depth = 0
    for c in text:
        if state == ESCAPED:
            state = IN
        elif state == IN:
            if c == "\\":
                state = ESCAPED
            elif c == '"':
                state = OUT
        elif c == '"':
            state = IN
        elif c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
    return state, depth


def _then(first: list, second: list) -> list:
    """Effects of one text, then another: per starting state (state, depth)."""
    return [(second[s][0], d + second[s][1]) for s, d in first]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of text after each ``}``, with their file, split, place, and whether a ``}`` followed.

    A file is one byte longer than its pieces for each ``}`` the reader took
    away; so its last piece had one after it if the file is as long as its
    pieces and their number together.
    """
    raw = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("text"),
    )
    raw = stored(raw, "json-pieces")
    files = raw.groupBy("file").agg(
        F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"),
        F.max(F.struct("split", "at")).alias("last"),
    )
    lasts = files.select(
        "file", F.col("last.split").alias("split"), F.col("last.at").alias("at"),
        (F.col("size") != F.col("bytes") + F.col("n")).alias("open_end"),
    )
    return raw.join(F.broadcast(lasts), ["file", "split", "at"], "left").select(
        "file", "split", "at", "text", F.coalesce("open_end", F.lit(False)).alias("open_end")
    )


def records(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """``(file, number, text)``: the text of every record (``array``) or entry (``object``)."""
    opener = {"array": "[", "object": "{"}[layout]
    marked = _pieces(spark, path)

    def summarise(batches):
        import pandas as pd

        sums: dict = {}
        for batch in batches:
            for f, s, text, open_end in zip(batch["file"], batch["split"], batch["text"], batch["open_end"], strict=True):
                e = [effect(text if open_end else text + "}", st) for st in (OUT, IN, ESCAPED)]
                sums[(f, s)] = _then(sums[(f, s)], e) if (f, s) in sums else e
        yield pd.DataFrame(
            [(f, s, [st for st, _ in e], [d for _, d in e]) for (f, s), e in sums.items()],
            columns=["file", "split", "states", "depths"],
        )

    summary_schema = "file string, split long, states array<int>, depths array<long>"
    # Pieces of one split arrive in file order: the reader keeps it, and nothing moves them before this.
    summaries = marked.mapInPandas(summarise, summary_schema).collect()
    by_file: dict = {}
    for r in summaries:
        by_file.setdefault(r.file, []).append((r.split, list(r.states), list(r.depths)))
    starts = []
    for f, splits in by_file.items():
        state, depth = OUT, 0
        for k, (split, states, depths) in enumerate(sorted(splits)):
            starts.append((f, split, state, depth, k > 0))
            state, depth = states[state], depth + depths[state]
        if state != OUT or depth != 0:
            raise ValueError(f"not a whole JSON {layout} of records: {f} ends inside a value")
    entry = spark.createDataFrame(starts, "file string, split long, state int, depth long, later boolean")

    def cut(batches):
        import pandas as pd

        where: dict = {}
        for batch in batches:
            out = []
            for f, s, at, text, open_end, st, dp, later in zip(
                batch["file"], batch["split"], batch["at"], batch["text"], batch["open_end"], batch["state"], batch["depth"],
                batch["later"], strict=True,
            ):
                if (f, s) not in where:
                    # A later split that starts at depth 0 comes after the array (object).
                    where[(f, s)] = [int(st), int(dp), 0, bool(later)]
                state, depth, number, seen = where[(f, s)]
                piece = []
                for c in text if open_end else text + "}":
                    keep = True
                    if state == OUT and depth == 0 and c not in opener and not c.isspace() and c != "\ufeff":
                        raise ValueError(f"text outside the JSON {layout}: {f}")
                    if state == ESCAPED:
                        state = IN
                    elif state == IN:
                        state = ESCAPED if c == "\\" else OUT if c == '"' else IN
                    elif c == '"':
                        state = IN
                    elif c in _OPEN:
                        depth += 1
                        if depth == 1:
                            if seen or c != opener:
                                raise ValueError(f"not a JSON {layout} of records: {f}")
                            seen, keep = True, False
                    elif c in _CLOSE:
                        depth -= 1
                        keep = depth > 0
                        if depth < 0:
                            raise ValueError(f"not a JSON {layout} of records: {f}")
                    elif c == "," and depth == 1:
                        out.append((f, s, number, at, "".join(piece)))
                        piece, number, keep = [], number + 1, False
                        out.append((f, s, number, at, ""))  # so that the split's count of commas shows
                    if keep and depth >= 1:
                        piece.append(c)
                if piece:
                    out.append((f, s, number, at, "".join(piece)))
                where[(f, s)] = [state, depth, number, seen]
            yield pd.DataFrame(out, columns=["file", "split", "local", "at", "text"])

    withstart = marked.join(F.broadcast(entry), ["file", "split"])
    cut_schema = "file string, split long, local long, at long, text string"
    fragments = withstart.mapInPandas(cut, cut_schema)
    # Commas before each split: the last local number of the splits before it.
    counts = fragments.groupBy("file", "split").agg(F.max("local").alias("commas"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = entry.join(counts, ["file", "split"], "left").select(
        "file", "split", F.coalesce(F.sum(F.coalesce("commas", F.lit(0))).over(before), F.lit(0)).alias("offset")
    )
    numbered = fragments.join(F.broadcast(offsets), ["file", "split"]).select(
        "file", (F.col("offset") + F.col("local")).alias("number"), "split", "at", "text"
    )
    whole = numbered.groupBy("file", "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "at", "text"))), lambda p: p["text"]), "").alias("text")
    )
    return whole.where(F.col("text").rlike(r"\S"))


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON arrays of objects, in any layout."""
    found = records(spark, path, "array")
    parsed = F.from_json("text", f"{schema}, __bad STRING", {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "__bad"})
    rows = found.select(parsed.alias("r"))
    checked = F.when(F.col("r.__bad").isNull(), F.col("r")).otherwise(
        F.raise_error(F.concat(F.lit("not a JSON record: "), F.left("r.__bad", F.lit(200))))
    )
    return rows.select(checked.alias("r")).select("r.*").drop("__bad")


def read_json_entries(spark: SparkSession, path: str, entry: str, key: str = "snippet_id") -> DataFrame:
    """Entries of JSON objects keyed by id, in any layout: one row each."""
    found = records(spark, path, "object")
    parsed = F.from_json(F.concat(F.lit("{"), F.col("text"), F.lit("}")), f"MAP<STRING, {entry}>", {"allowSingleQuotes": "false"})
    checked = F.when(F.size(parsed) == 1, parsed).otherwise(
        F.raise_error(F.concat(F.lit("not a JSON entry: "), F.left("text", F.lit(200))))
    )
    return found.select(F.explode(checked).alias(key, "v")).select(key, "v.*")
