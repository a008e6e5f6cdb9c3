from __future__ import annotations

import pytest

import corpus_pipeline as P
from logharvest.llm.queries import QUERIES

N = 1000
SMALL = "/root/testdata/sf0.001"


def test_ten_operators_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert set(range(1, 11)) <= set(numbers)


@pytest.fixture(scope="module")
def tables(spark, documents, prose, tmp_path_factory):
    """Documents with copies, boilerplate, toxic words, junk and benchmark passages, and what each stage must do."""
    folder = str(tmp_path_factory.mktemp("tables"))
    item = prose(50, 99_999)
    line = " ".join(prose(60, 77_777).split())
    rows, labels = [], []
    for i in range(N):
        body = prose(60 + i % 50, i)
        if i % 5 == 1:
            body = body.replace(" ", "### ")
        elif i % 5 == 2:
            body += " vileword"
        elif i % 25 == 3:
            body += "\n" + line
        elif i % 50 == 4:
            body += " " + " ".join(item.split())  # within a line of its own document
        rows.append((i, body, "en", f"src{i % 7}"))
        if i % 2:
            labels.append((i, int(i % 5 != 1), int(i % 5 == 2)))
    long = prose(900, 55_555)
    rows += [(4000, long, "en", "src1"), (4001, long, "en", "src1"), (4002, long.replace(long.split()[450], "changed", 1), "en", "src1")]
    documents(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, line


def test_each_stage_takes_effect(spark, tables):
    folder, rows, line = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {}
    for n, (name, stage) in enumerate(P.STAGES):
        docs = P.stored(stage(spark, docs, folder), "stage")
        ids[n] = {r.doc_id for r in docs.select("doc_id").collect()}
        if n < 4:
            assert docs.columns == columns, name
        if n == 1:
            # The first that the classifier kept has the passage still.
            holders = [i for i in ids[0] if i % 25 == 3 and i < N]
            assert [r.doc_id for r in docs.where(docs.text.contains(line)).collect()] == [min(holders)]
            assert docs.where("n_chars <> length(text)").count() == 0
    clean = {i for i in range(N) if i % 5 in (0, 3, 4)}
    # A classifier may err: on a thirtieth of the documents at most.
    assert len(clean ^ (ids[0] & set(range(N)))) <= N / 30
    assert {4000, 4001, 4002} <= ids[0]
    assert ids[1] == ids[0]
    assert ids[2] == ids[1] - {4001, 4002}
    assert ids[3] == ids[2] - {i for i in range(N) if i % 50 == 4}
    assert ids[4] == ids[3]


def test_run_on_a_driver_table(spark):
    out = P.run(spark, SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 50


def test_decontamination_broadcasts_no_rows_of_windows(
    spark, documents, contaminated, broadcast_rows, broadcast_limit, tmp_path
):
    rows, items = contaminated
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents([*rows, (1000, "clean words of no item at all")])
    clean = P.benchmark_decontamination(spark, docs, str(tmp_path))
    assert [r.doc_id for r in clean.collect()] == [1000]
    # A row takes far more than 64 bytes.
    assert broadcast_rows(clean) * 64 <= broadcast_limit
