"""WARC archives and an external merge of their indexes.

Writing: pages are deduplicated by payload. Of records with equal payloads of at
least ``REVISIT_BYTES`` bytes the one with the smallest id is a response, the
others are revisits that name it and carry no payload. Each task writes its
pages as gzipped WARC records into files of its own; a file's name is unique to
the attempt, and only the files of attempts that succeeded are listed, so retried
and speculative tasks leave no record twice.

Reading: each task reads archives from end to end and sorts their entries by
(URL key, time, id): a capture run. Runs are brought together by ranges of that
order, taken from the runs by sampling, so that one URL with very many captures
is several ranges; in each range the runs' slices are merged through a loser tree,
k ways at once. The ranges in turn are the globally ordered capture history. A
merging task holds the index entries of its range, never payloads.

Payloads move once, to meet the verdict on their digest; adaptive execution splits
a digest that a third of all pages share.

Archives lie in the shared folder of the session and are written and read with
Arrow's file systems, which know local, HDFS and object-store addresses.

Nulls: a null payload is empty, a null URL has an empty key, a null id comes last
and is never referred to unless all ids of a payload are null (then all are
responses). Rows with equal smallest ids are all responses. Empty tables give empty
results.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import sys
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logharvest.session import stored, work_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

REVISIT_BYTES = 100
FILE_BYTES = 256 << 20
CHUNK = 1 << 20
# Pages have no time of capture; in the driver's table one is derived from the id.
EPOCH = 1_700_000_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Ids pass pandas as text: beside a null it would make floats of them.
INDEX = (
    "page_id string, url string, url_key string, captured string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to string, file string, at bigint, size bigint"
)


def url_key(url: Column) -> Column:
    """Host names from the top down, then path and query, in lower case: what captures of one page share."""
    plain = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    plain = F.regexp_replace(F.regexp_replace(plain, "#.*$", ""), r"^(www[0-9]*\.|[^/@]*@)", "")
    host = F.regexp_extract(plain, r"^([^/?:]*)", 1)
    rest = F.regexp_extract(plain, r"^[^/?:]*(?::[0-9]+)?(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def with_roles(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages (page_id, url, html, captured)`` with ``payload``, digest, record type and reference."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "captured", payload.alias("payload")).select(
        "*", url_key(F.col("url")).alias("url_key"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
    )
    first = (
        rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    joined = rows.join(first, "payload_digest", "left")
    again = F.coalesce(
        (F.col("page_id") != F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull()), F.lit(False)
    )
    return joined.select(
        *rows.columns, F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def record(row) -> bytes:
    """One WARC record, uncompressed."""
    head = [
        "WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: <urn:page:{row.page_id or ''}>",
        f"WARC-Target-URI: {'' if row.url is None else _line(row.url)}", f"WARC-Date: {row.captured or ''}",
        f"WARC-Payload-Digest: sha256:{row.payload_digest}", f"X-Payload-Length: {row.payload_bytes}",
        f"X-URL-Key: {_line(row.url_key)}",
    ]
    body = row.payload
    if row.record_type == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{row.refers_to}>", f"WARC-Profile: {_PROFILE}"]
        body = b""
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _line(value: str) -> str:
    """A header is one line: control characters and the sign itself as %xx."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02x}", value)


def _plain(value: str) -> str:
    return re.sub(r"%([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), value)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else path.replace("file:", "file://", 1))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes archives below ``folder``; returns ``(file, n_records)`` of those that count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made, out, name, n, size = TaskContext.get().partitionId(), [], None, "", 0, 0
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    name = f"captures-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    out, n, size = files.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                data = gzip.compress(record(row), 6, mtime=0)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    made.append((f"{folder}/{name}", n))
                    out = None
        if out is not None:
            out.close()
            made.append((f"{folder}/{name}", n))
        yield pd.DataFrame(made, columns=["file", "n_records"])

    named = pages.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to", "captured")})
    return stored(named.mapInPandas(run, "file string, n_records bigint"), "archives")


def read_records(path: str) -> Iterator[tuple[int, int, dict, bytes]]:
    """``(at, size, headers, payload)`` of each gzip member of an archive, read in chunks."""
    files, inner = _open(path)
    with files.open_input_stream(inner, compression=None) as stream:
        at, data = 0, b""
        while True:
            packed = zlib.decompressobj(31)
            parts, used = [], 0
            while not packed.eof:
                if not data:
                    data = stream.read(CHUNK)
                    if not data:
                        if used:
                            raise ValueError(f"{path} ends within a record at {at}")
                        return
                parts.append(packed.decompress(data))
                used += len(data) - len(packed.unused_data)
                data = packed.unused_data
            whole = b"".join(parts)
            head, _, rest = whole.partition(b"\r\n\r\n")
            lines = head.decode("utf-8", "surrogatepass").split("\r\n")
            headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            yield at, used, headers, rest[: int(headers["Content-Length"])]
            at += used


def _page_id(value: str) -> str | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", value or "")
    return found[1] if found else None


def _entry(path: str, at: int, size: int, headers: dict, payload: bytes) -> tuple:
    kind = headers["WARC-Type"]
    if kind == "response":
        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if f"sha256:{digest}" != headers["WARC-Payload-Digest"]:
            raise ValueError(f"{path}: the record at {at} is damaged")
    else:
        n, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
    return (
        _page_id(headers["WARC-Record-ID"]), _plain(headers["WARC-Target-URI"]), _plain(headers["X-URL-Key"]), headers["WARC-Date"],
        n, digest, kind, _page_id(headers.get("WARC-Refers-To")), path, at, size,
    )


def order_of(entry) -> tuple:
    """URL key, time, id; ids that are null come last, equal ones by place."""
    page = entry[0]
    return entry[2], entry[3], page is None, int(page or 0), entry[8], entry[9]


def capture_runs(archives: DataFrame) -> DataFrame:
    """Index entries of archives, each archive a run sorted by ``order_of``; ``run`` tells them apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["file"]:
                entries = sorted((_entry(path, *r) for r in read_records(path)), key=order_of)
                frame = _frame(entries)
                yield frame.assign(run=zlib.crc32(path.rsplit("/", 1)[-1].encode()), place=range(len(frame)))

    # One archive is one task's work, for as many archives as there are.
    spread = archives.select("file").repartition(max(1, archives.count()), "file")
    return spread.mapInPandas(run, f"{INDEX}, run bigint, place bigint")


def _frame(entries: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(entries, columns=[c.split()[0] for c in INDEX.split(", ")])


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, the winner moves up.

    Taking the least element replays the matches on one path, log2(k) comparisons.
    """

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k  # None: the run has ended, it loses to all
        for i in range(len(runs)):
            self._next(i)
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _next(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _beats(self, i: int, j: int) -> bool:
        if self.keys[i] is None or self.keys[j] is None:
            return self.keys[j] is None and (self.keys[i] is not None or i < j)
        return (self.keys[i], i) < (self.keys[j], j)

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:  # while the tree is built: the first to arrive waits
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.keys[self.losers[0]] is not None:
            i = self.losers[0]
            yield self.heads[i]
            self._next(i)
            self._replay(i)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All runs' entries in one order: ``range`` numbers the parts of it, ``place`` counts within."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        slices: dict[int, list[tuple]] = {}
        for batch in batches:
            for number, entry in zip(batch["run"], batch[names].itertuples(index=False, name=None), strict=True):
                slices.setdefault(number, []).append(entry)
        merged: list[tuple] = []
        done = 0
        for entry in LoserTree([iter(s) for s in slices.values()], order_of):
            merged.append(entry)
            if len(merged) == 20_000:
                yield _frame(merged).assign(range=TaskContext.get().partitionId(), place=range(done, done + len(merged)))
                done, merged = done + len(merged), []
        if merged:
            yield _frame(merged).assign(range=TaskContext.get().partitionId(), place=range(done, done + len(merged)))

    # A range's rows arrive by run and place, as each run had sorted them.
    ranges = runs.repartitionByRange("url_key", "captured", F.col("page_id").cast("bigint").asc_nulls_last(), "file", "at")
    merged = ranges.sortWithinPartitions("run", "place").mapInPandas(run, f"{INDEX}, range int, place bigint")
    return merged.withColumns({c: F.col(c).cast("bigint") for c in ("page_id", "refers_to")})


def capture_history(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages (page_id, url, html, captured)`` as archives and returns their merged index."""
    folder = folder or work_folder(spark, "warc")
    archives = write_archives(with_roles(pages), folder)
    return merge_runs(stored(capture_runs(archives), "capture-runs"))


def captured_at(page_id: Column) -> Column:
    """A time of capture, derived from the id, as WARC dates are written."""
    seconds = F.lit(EPOCH) + F.pmod(F.xxhash64(page_id), F.lit(31_536_000))
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
