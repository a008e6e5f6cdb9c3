from __future__ import annotations

import json
import random

import pytest

from logharvest.sources import documents, json_split as J

SCHEMA = "conv_id BIGINT, function STRING, llm_output STRING"


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def records(n=300, seed=1):
    rng = random.Random(seed)
    texts = ['a"}', "b,}]", "c\\\\", None, "{[x]}", "é\n{", ""]
    return [{"conv_id": i, "function": rng.choice(texts), "llm_output": "t" * rng.randint(0, 300)} for i in range(n)]


def test_compact_and_indented_arrays_by_many_tasks(spark, tmp_path, small_splits):
    recs = records()
    (tmp_path / "a.json").write_text(json.dumps(recs))
    (tmp_path / "b.json").write_text(json.dumps(recs[:5], indent=3) + "\n")
    assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 10
    got = documents.read_json_array(spark, str(tmp_path), SCHEMA, indent=None).collect()
    want = [(r["conv_id"], r["function"], r["llm_output"]) for r in recs + recs[:5]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_compact_objects(spark, tmp_path, small_splits):
    entries = {f"k{i}": {"function": r["function"], "llm_output": r["llm_output"]} for i, r in enumerate(records())}
    (tmp_path / "a.json").write_text(json.dumps(entries))
    got = documents.read_json_map(spark, str(tmp_path), "STRUCT<function: STRING, llm_output: STRING>", indent=None)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((k, v["function"], v["llm_output"]) for k, v in entries.items()), key=repr)


@pytest.mark.parametrize("kind", ["truncated array", "trailing text", "truncated object", "two arrays", "object for array"])
def test_broken_files_raise(spark, tmp_path, small_splits, kind):
    recs = json.dumps(records(100))
    entries = json.dumps({f"k{i}": {"function": "x"} for i in range(100)})
    text = {"truncated array": recs[:-1], "trailing text": recs + " x", "truncated object": entries[:-1],
            "two arrays": recs + recs, "object for array": entries}[kind]
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        if kind == "truncated object":
            J.read_json_entries(spark, str(tmp_path), "STRUCT<function: STRING>").collect()
        else:
            J.read_json_records(spark, str(tmp_path), "conv_id BIGINT").collect()


def test_empty_array_gives_no_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text(" [ ]\n")
    assert J.read_json_records(spark, str(tmp_path), "conv_id BIGINT").count() == 0


def test_indented_object_that_is_cut_off_raises(spark, tmp_path):
    entries = {f"k{i}": {"function": "x", "llm_output": "y"} for i in range(5)}
    text = json.dumps(entries, indent=2)
    (tmp_path / "a.json").write_text(text[: text.rindex("}")])
    with pytest.raises(Exception):
        documents.read_json_map(spark, str(tmp_path), "STRUCT<function: STRING, llm_output: STRING>").collect()
    (tmp_path / "a.json").write_text(text)
    assert documents.read_json_map(spark, str(tmp_path), "STRUCT<function: STRING, llm_output: STRING>").count() == 5
