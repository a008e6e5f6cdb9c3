"""Source trees and notebook trees as ``(path, content)`` tables.

Spark's own file readers leave out names that begin with ``_`` or ``.``, which
in a Python tree means every ``__init__.py`` and private module. So the tree is
listed and read by Arrow's file systems inside Spark tasks: folders are the
rows of the listing, files the rows of the reading.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from fnmatch import fnmatch
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from logharvest.functions.text import unix_newlines
from logharvest.session import stored

# Ship this module with the job, so that workers need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BATCH_BYTES = 16 << 20
_TASK_BYTES = 64 << 20
_LISTED = 10_000


def _open(root: str) -> tuple[fs.FileSystem, str]:
    system, base = fs.FileSystem.from_uri(root)
    return system, base.rstrip("/")


def _lister(root: str, pattern: str):
    """Folders below the root -> their own entries: folders, and files whose name fits."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                infos = system.get_file_info(fs.FileSelector(f"{base}/{name}" if name else base))
                kept = [i for i in infos if i.type == fs.FileType.Directory
                        or i.type == fs.FileType.File and fnmatch(i.base_name, pattern)]
                for at in range(0, len(kept), _LISTED):
                    some = kept[at:at + _LISTED]
                    yield pa.RecordBatch.from_pydict({
                        "name": pa.array([i.path[len(base) + 1:] for i in some], pa.string()),
                        "size": pa.array([None if i.type == fs.FileType.Directory else i.size for i in some], pa.int64()),
                    })

    return listed


def _reader(root: str):
    """Files below the root -> their contents, in batches of bounded size."""
    def text(data: bytes) -> str | None:
        try:
            return data.decode()
        except UnicodeDecodeError:
            return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        names, contents, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"name": pa.array(names, pa.string()), "content": pa.array(contents, pa.string())})

        for incoming in batches:
            for name in incoming.column("name").to_pylist():
                with system.open_input_stream(f"{base}/{name}") as stream:
                    data = stream.read()
                names.append(name)
                contents.append(text(data))
                held += len(data)
                if held >= _BATCH_BYTES:
                    yield batch()
                    names, contents, held = [], [], 0
        if names:
            yield batch()

    return read


def read_tree(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """All files below ``root``, hidden ones included, whose name fits ``pattern``.

    The tree is listed level by level, each level's folders by as many tasks as
    there are cores, so that one owner's large tree is no single task's work;
    the file names are stored and dealt evenly over the readers, so a
    repository that holds a third of all files is read by a third of them.
    Bytes that are no UTF-8 give a null content rather than a failed job.
    """
    cores = spark.sparkContext.defaultParallelism
    folders, levels = spark.createDataFrame([("",)], "name STRING"), []
    while True:
        entries = folders.mapInArrow(_lister(root, pattern), "name STRING, size BIGINT")
        levels.append(stored(entries, "listing"))
        folders = levels[-1].filter("size IS NULL").select("name")
        n = folders.count()
        if n == 0:
            break
        folders = folders.repartition(min(n, 4 * cores), "name")
    names = reduce(DataFrame.unionByName, levels).filter("size IS NOT NULL")
    total = names.agg(F.sum("size")).collect()[0][0] or 0
    dealt = names.select("name").repartition(max(cores, -(-total // _TASK_BYTES)))
    files = dealt.mapInArrow(_reader(root), "name STRING, content STRING")
    path = F.concat(F.lit(root.rstrip("/") + "/"), F.col("name"))
    return files.select(path.alias("path"), unix_newlines("content").alias("content"))


def read_source_tree(spark: SparkSession, root: str) -> DataFrame:
    return read_tree(spark, root, "*.py")


def read_notebook_tree(spark: SparkSession, root: str) -> DataFrame:
    return read_tree(spark, root, "*.ipynb")
