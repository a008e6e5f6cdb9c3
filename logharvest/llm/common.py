"""Words, lines and row keys shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Words are maximal runs of characters other than space and 0x09-0x0D.
SPACES = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text; a null is an empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES + "+"), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identifies a row by id and whole text; equal rows have equal keys.

    A struct of two hashes, 128 bits, so that ids that are null or given twice
    for different texts do not mix rows.
    """
    a = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    b = whole(text)
    return F.struct(F.xxhash64(a, b).alias("a"), F.xxhash64(b, F.lit(1), a).alias("b"))


def ngrams(hashes: str, n: int) -> Column:
    """Hash of each run of ``n`` consecutive elements of an array of hashes, in order.

    ``hashes`` names a column, so that nothing is computed again per element.
    """
    h = F.col(hashes)
    return F.when(
        F.size(h) >= n,
        F.transform(
            F.sequence(F.lit(0), F.size(h) - n),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
