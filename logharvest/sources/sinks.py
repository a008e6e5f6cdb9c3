"""Writers. All write folders of part files; none gathers data on the driver."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from logharvest.operators.layout import with_row_index
from logharvest.sources.tables import read_parquet_if_any

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_csv(df: DataFrame, path: str, sep: str = ",", single_file: bool = False) -> None:
    """Headed CSV. ``single_file`` is for reports of a few rows."""
    df = df.coalesce(1) if single_file else df
    (
        df.write.mode("overwrite").option("header", True).option("sep", sep)
        .option("quote", '"').option("escape", '"')
        # Spark's writer trims cells unless told not to.
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def join_lists(df: DataFrame, sep: str = ";") -> DataFrame:
    """Array-of-text columns as one text cell, for CSV."""
    lists = [name for name, kind in df.dtypes if kind == "array<string>"]
    return df.withColumns({c: F.array_join(c, sep) for c in lists})


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines, non-ASCII text and null fields kept as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", False).option("compression", compression).json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """Each partition one JSON array, a record per line, null fields kept."""
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    _write_document(df.select(record.alias("value")), path, "[", "]")


def write_json_map(df: DataFrame, path: str, key: str) -> None:
    """Each partition one JSON object of entries by ``key``, an entry per line, null fields kept."""
    name = F.regexp_extract(F.to_json(F.struct(F.col(key).cast("string").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    entry = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != key]), {"ignoreNullFields": "false"})
    _write_document(df.select(F.concat(name, F.lit(": "), entry).alias("value")), path, "{", "}")


def _write_document(records: DataFrame, path: str, opening: str, closing: str) -> None:
    """One text per record -> one document per partition, a batch in memory at a time."""
    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A record is held back until it is known whether a comma follows it.
        previous, comma = opening, ""
        for batch in batches:
            lines = []
            for record in batch.column(0).to_pylist():
                lines.append(previous + comma)
                previous, comma = record, ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": [previous, closing]})

    records.mapInArrow(document, "value STRING").write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    """A ``(section, key, count)`` report, or one row of metrics, as one CSV file."""
    columns = [c for c in ("section", "key") if c in report.columns]
    write_csv(report.orderBy(*columns) if columns else report, path, single_file=True)


write_metrics_row = write_report


def write_files(files: DataFrame, path: str, by: str = "project_name") -> None:
    """Matched files as Parquet, files of a project together.

    Rebalanced and sorted by project: a reader of one project skips the row
    groups of others by their statistics. Adaptive execution joins small
    projects into one task and splits one that holds a large share of all files.
    The project stays a column, so that its name comes back as it was, and
    there are no folders as many as projects.
    """
    balanced = files.hint("rebalance", F.col(by)).sortWithinPartitions(by)
    balanced.write.mode("overwrite").parquet(path)


# Folders of a keyed table and 32,768-bit bitmaps per folder in its key index;
# both are fixed once a table has rows.
KEY_BUCKETS = 64
CHUNKS_PER_BUCKET = 16
_BITS = 32768


def _key_slots(df: DataFrame, key: str) -> DataFrame:
    """``key_bucket`` (0 to KEY_BUCKETS - 1), ``__chunk`` and ``__bit`` of each key,
    from one 64-bit hash (a null key hashes like any value)."""
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(KEY_BUCKETS * CHUNKS_PER_BUCKET * _BITS)) + 1
    chunk = F.bitmap_bucket_number(slot)
    return df.withColumns({
        "__chunk": chunk,
        "__bit": F.bitmap_bit_position(slot),
        "key_bucket": F.pmod(chunk - 1, F.lit(KEY_BUCKETS)).cast("int"),
    })


def append_unique(batch: DataFrame, path: str, key: str, batch_id: int) -> list[int]:
    """Append the rows of ``batch`` whose key the table does not hold yet; return
    the key buckets of the table that had to be read.

    The table is partitioned by ``batch_id`` and ``key_bucket`` (a hash of the
    key). Beside it, ``_key_index`` (hidden from readers of the table) holds per
    batch and chunk of a bucket a bitmap of the keys' hash bits
    (``bitmap_construct_agg``). An append ORs the stored bitmaps per chunk
    (``bitmap_or_agg``) and reads only the buckets where they share a bit with
    its own keys: a few numbers reach the driver, never keys. The batch's index
    is written before its rows, so a run cut off between them leaves only a
    false alarm. The batch has its own folders, which a repeated run
    overwrites, and is compared with the other batches only: running it twice
    changes nothing. Of rows of the batch with one key, the least is kept; a
    null key is a key. An empty batch writes an empty batch.
    """
    base = path.rstrip("/")
    rest = [c for c in batch.columns if c != key]
    least = F.min(F.struct(*rest)).alias("__row") if rest else F.count(F.lit(1)).alias("__n")
    keyed = _key_slots(batch, key).groupBy("key_bucket", "__chunk", "__bit", key).agg(least).select(
        "key_bucket", "__chunk", "__bit",
        *[key if c == key else F.col("__row")[c].alias(c) for c in batch.columns])
    own = keyed.groupBy("__chunk").agg(F.bitmap_construct_agg("__bit").alias("bits"))
    index = read_parquet_if_any(batch.sparkSession, f"{base}/_key_index")
    buckets: list[int] = []
    if index is not None:
        sides = own.select("__chunk", "bits", F.lit(True).alias("mine")).unionByName(
            index.filter(F.col("batch_id") != batch_id).select("__chunk", "bits", F.lit(False).alias("mine")))
        shared = sides.groupBy("__chunk").agg(
            F.bitmap_count(F.bitmap_or_agg("bits")).alias("both"),
            F.bitmap_count(F.bitmap_or_agg(F.when(F.col("mine"), F.col("bits")))).alias("mine"),
            F.bitmap_count(F.bitmap_or_agg(F.when(~F.col("mine"), F.col("bits")))).alias("theirs"),
        ).filter((F.col("mine") > 0) & (F.col("theirs") > 0) & (F.col("both") < F.col("mine") + F.col("theirs")))
        found = shared.select(F.pmod(F.col("__chunk") - 1, F.lit(KEY_BUCKETS)).cast("int").alias("b")).distinct()
        buckets = sorted(r.b for r in found.collect())  # at most KEY_BUCKETS numbers
    rows = keyed.drop("__chunk", "__bit")
    if buckets:
        stored = batch.sparkSession.read.parquet(base)
        others = stored.filter((F.col("batch_id") != batch_id) & F.col("key_bucket").isin(buckets)).select(
            F.col("key_bucket").alias("__b"), F.col(key).alias("__stored"))
        rows = rows.join(others, (F.col("key_bucket") == F.col("__b")) & F.col(key).eqNullSafe(F.col("__stored")),
                         "left_anti")
    own.write.mode("overwrite").parquet(f"{base}/_key_index/batch_id={batch_id}")
    rows.repartition("key_bucket").write.mode("overwrite").partitionBy("key_bucket").parquet(
        f"{base}/batch_id={batch_id}")
    return buckets


def write_index_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV with a leading row index."""
    write_csv(with_row_index(df, order), path)


def write_kappa(kappa: DataFrame, metadata: DataFrame, disagreements: DataFrame, path: str) -> None:
    """The three tables of an agreement study below one folder."""
    base = path.rstrip("/")
    write_csv(kappa, f"{base}/kappa_by_smell", single_file=True)
    write_csv(metadata, f"{base}/metadata", single_file=True)
    write_csv(disagreements, f"{base}/disagreements")
