from __future__ import annotations

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from logharvest.llm import warc as W
from logharvest.session import work_folder

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (5001, "http://A.b/x", "é" * 60), (5000, None, "é" * 60), (5002, "http://www.x.de:80/a?b#c", None), (5003, "u\r\n%41: x", ""),
    (5004, "http://A.b/x", "é" * 60), (None, "http://A.b/x", "é" * 60), (None, "http://A.b/x", "z" * 160), (None, "http://A.b/y", "z" * 160),
    (7, "http://c.d/", "short"), (8, "http://c.d/", "short"), (9, "http://c.d/", "q" * 100), (9, "http://c.d/", "q" * 100),
    (10, "http://c.d/", "q" * 100), (2**60 + 1, "http://c.d/", "big " * 50), (2**60 + 3, "http://c.d/", "big " * 50), (11, "http://c.d/", "WARC/1.1\r\n\r\n" * 20),
]


def brute(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    out = collections.Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        f = first.get(data)
        again = f is not None and i != f
        out[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", f if again else None] += 1
    return out


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    many = [(i, f"https://h{rng.randrange(6)}.org/p{rng.randrange(9)}", rng.choice(["p" * 300, f"page {i} " * 30])) for i in range(600)]
    rows = ROWS + many
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return rows, df.withColumn("captured", W.captured_at(F.col("page_id")))


def test_read_back_and_global_order(spark, pages, clashing):
    rows, df = pages
    got = W.capture_history(spark, clashing(df)).collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows)
    keys = [(r.url_key, r.captured, r.page_id is None, r.page_id or 0) for r in sorted(got, key=lambda r: (r.range, r.place))]
    assert keys == sorted(keys)
    assert next(r for r in got if r.page_id == 5003).url == "u\r\n%41: x"


def test_small_files_and_random_access(spark, pages):
    _, df = pages
    folder = work_folder(spark, "warc-test")
    archives = W.write_archives(W.with_roles(df), folder, file_bytes=3000)
    assert archives.count() > 5
    index = W.capture_runs(archives)
    for r in index.where("record_type = 'response'").limit(5).collect():
        found = {at: payload for at, _, _, payload in W.read_records(r.file)}
        assert hashlib.sha256(found[r.at]).hexdigest() == r.payload_digest
    assert index.select("run").distinct().count() == archives.count()


def test_damage_is_noticed(spark, tmp_path):
    row = type("Row", (), {"page_id": 1, "url": "u", "url_key": "u)", "captured": "t", "payload": b"abc", "payload_bytes": 3,
                           "payload_digest": "0" * 64, "record_type": "response", "refers_to": None})
    import gzip

    path = tmp_path / "x.warc.gz"
    path.write_bytes(gzip.compress(W.record(row)))
    with pytest.raises(ValueError, match="damaged"):
        [W._entry(str(path), *r) for r in W.read_records(str(path))]
    path.write_bytes(gzip.compress(W.record(row))[:-9])
    with pytest.raises(ValueError, match="ends within"):
        list(W.read_records(str(path)))


@pytest.mark.parametrize("k", range(0, 10))
def test_loser_tree_merges_any_runs(k):
    rng = random.Random(k)
    for _ in range(40):
        runs = [sorted((rng.randrange(20), r) for _ in range(rng.randrange(9))) for r in range(k)]
        assert list(W.LoserTree([iter(r) for r in runs], lambda x: x[0])) == sorted(sum(runs, []))


def test_url_keys(spark):
    df = spark.createDataFrame([("http://www.A.co.uk:80/X?q=1#f",), (None,), ("",), ("ftp://u@h/p",), ("h",)], "u string")
    assert [r.k for r in df.select(W.url_key(F.col("u")).alias("k")).collect()] == ["uk,co,a)/x?q=1", ")", ")", "h)/p", "h)"]


def test_empty(spark, pages):
    assert W.capture_history(spark, pages[1].limit(0)).count() == 0
