"""Boilerplate lines across sites: lines found on many distinct sites lose all but one document.

Per line hash, HyperLogLog sketches of its sites merge by aggregation, so a
line that a third of all documents share is one small sketch per task before it
is shuffled. A sketch is an estimate: lines whose estimate lies near the
threshold get their sites counted exactly, the rest is clear. Lines at or over
``min_sites`` are boilerplate; they stay in the document with the smallest id
that has them and go everywhere else, so no passage is lost altogether.

Lines are what stands between line feeds, compared without the spaces around
them; lines of fewer than ``min_words`` words are never boilerplate, since short
sentences recur by chance.

A document's verdicts come back as bit masks, 64 lines in a long, so neither a
document of a million lines nor a line in a million documents makes a large
group or a quadratic search.

Nulls: a null text is empty and comes back null; a null site counts as one site
of its own; null ids are larger than any id. Equal rows get equal results; of
rows that share an id but not their text each keeps the first lines of that id.
Empty tables give empty results. Other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logharvest.llm.common import row_key, whole, words
from logharvest.operators.layout import computed_once
from logharvest.session import stored

MIN_SITES = 3
MIN_WORDS = 3
# Estimates between these multiples of the threshold are settled exactly. The
# relative standard error of a sketch with 2^12 registers is 1.6 %.
NEAR = (0.75, 1.34)
LOG_REGISTERS = 12


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def hashed_lines(docs: DataFrame, site: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``(key, doc_id, site, at, h)``: one row per line; ``h`` is null for short lines."""
    rows = computed_once(docs.select("doc_id", site, "text"), "__lines", F.split(whole("text"), "\n", -1))
    rows = rows.select(
        row_key().alias("key"), "doc_id", F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("site"),
        F.posexplode("__lines").alias("at", "__line"),
    )
    # min_words words: that many runs of other characters.
    long_enough = F.size(words(F.col("__line"))) >= min_words
    line = _trimmed(F.col("__line"))
    h = F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))
    return rows.select("key", "doc_id", "site", "at", F.when(long_enough, h).alias("h"))


def line_sites(lines: DataFrame) -> DataFrame:
    """``(h, sketch, first_doc)`` per line; sketches merge with ``hll_union_agg``."""
    return lines.where("h IS NOT NULL").groupBy("h").agg(
        F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch"),
        F.min("doc_id").alias("first_doc"),
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``(h, n_sites, first_doc)`` of lines on at least ``min_sites`` distinct sites.

    ``n_sites`` is exact near the threshold and estimated well above it.
    """
    low, high = (min_sites * x for x in NEAR)
    estimated = stored(
        line_sites(lines).select("h", "first_doc", F.hll_sketch_estimate("sketch").alias("estimate"))
        .where(F.col("estimate") >= F.floor(F.lit(low))),
        "line-estimates",
    )
    near = estimated.where(F.col("estimate") <= F.ceil(F.lit(high)))
    exact = (
        lines.where("h IS NOT NULL").select("h", "site").join(near.select("h"), "h", "left_semi")
        .distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n_sites"))
    )
    settled = near.join(exact, "h").where(F.col("n_sites") >= min_sites).select("h", "n_sites", "first_doc")
    clear = estimated.where(F.col("estimate") > F.ceil(F.lit(high)))
    return settled.unionByName(clear.select("h", F.col("estimate").alias("n_sites"), "first_doc"))


def remove_boilerplate(
    docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and ``n_lines_removed``."""
    lines = stored(hashed_lines(docs, site, min_words), "lines")
    found = stored(boilerplate(lines, min_sites), "boilerplate")
    gone = (
        lines.where("h IS NOT NULL")
        .join(found.select("h", "first_doc"), "h")
        .where(F.col("doc_id").isNull() & F.col("first_doc").isNotNull() | (F.col("doc_id") > F.col("first_doc")))
        .select("key", "at")
    )
    block, bit = F.floor(F.col("at") / 64).cast("int"), F.expr("shiftleft(1L, cast(at % 64 AS int))")
    masks = (
        gone.select("key", block.alias("block"), bit.alias("bit"))
        .groupBy("key", "block").agg(F.bit_or("bit").alias("mask"))
        .groupBy("key").agg(
            F.sort_array(F.collect_list(F.struct("block", "mask"))).alias("__masks")
        )
    )
    # Masks of all blocks up to the last, so that a line finds its own by position.
    dense = F.aggregate(
        "__masks", F.array().cast("array<bigint>"),
        lambda acc, m: F.concat(acc, F.array_repeat(F.lit(0).cast("bigint"), m["block"] - F.size(acc)), F.array(m["mask"])),
    )
    masks = masks.select(F.col("key").alias("__key"), dense.alias("__masks"))
    joined = docs.withColumn("__key", row_key()).join(masks, "__key", "left")

    def stays(_line: Column, i: Column) -> Column:
        mask = F.coalesce(F.get("__masks", F.floor(i / 64).cast("int")), F.lit(0).cast("bigint"))
        return F.getbit(mask, i % 64) == 0

    split = F.split(F.col("text"), "\n", -1)
    kept = F.when(F.col("__masks").isNull(), F.col("text")).otherwise(F.array_join(F.filter(split, stays), "\n"))
    removed = F.coalesce(
        F.aggregate("__masks", F.lit(0), lambda n, mask: n + F.bit_count(mask)), F.lit(0)
    ).cast("long")
    columns = [kept.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, removed.alias("n_lines_removed"))


def oracle_sql(min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL for ``doc_id, text, n_lines_removed`` of the table ``documents``."""
    return f"""
WITH line AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, CASE WHEN len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {min_words}
                 THEN regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') END AS h FROM line
), spread AS (
  SELECT h, min(doc_id) AS first_doc FROM keyed WHERE h IS NOT NULL
  GROUP BY h HAVING count(DISTINCT source) >= {min_sites}
), judged AS (
  SELECT k.*, s.h IS NOT NULL AND k.doc_id > s.first_doc AS gone FROM keyed k LEFT JOIN spread s USING (h)
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       count(*) FILTER (WHERE gone) AS n_lines_removed
FROM judged GROUP BY doc_id
"""
