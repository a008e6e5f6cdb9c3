from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException

from logharvest.functions import text as X
from logharvest.operators import labels as L
from logharvest.schemas import FILTERED_FILE_CALLS
from logharvest.session import shared_folder
from logharvest.sources import code, documents, sinks, tables


def test_csv_with_quotes_and_line_breaks(spark, tmp_path, rows):
    data = [("a/b", 'say "hi", é\nnext', 1.5), ("c/d", None, None)]
    sinks.write_csv(spark.createDataFrame(data, "name string, description string, stars double"), str(tmp_path / "t"))
    back = tables.read_table_csv(spark, str(tmp_path / "t"))
    assert back.dtypes == [("name", "string"), ("description", "string"), ("stars", "double")]
    assert rows(back) == sorted(data, key=repr)


def test_foreign_csv(spark, tmp_path, rows):
    (tmp_path / "x.csv").write_text('name,text,n\na,"one ""two"", three\nfour",2\n', encoding="utf-8")
    assert rows(tables.read_table_csv(spark, str(tmp_path / "x.csv"))) == [("a", 'one "two", three\nfour', 2)]


def test_many_csv_widen_types(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("name,stars\nx,2\n")
    (tmp_path / "b.csv").write_text("name,stars,forks\ny,2.5,1\n")
    both = tables.read_many_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert dict(both.dtypes)["stars"] == "double"
    assert rows(both) == [("x", 2.0, None), ("y", 2.5, 1)]


def test_semicolon_csv_and_lists(spark, tmp_path):
    df = spark.createDataFrame([("logging", ["a", "b"])], "library string, snippet_ids array<string>")
    sinks.write_csv(sinks.join_lists(df), str(tmp_path / "o"), sep=";", single_file=True)
    (part,) = (tmp_path / "o").glob("part-*.csv")
    assert part.read_text() == 'library;snippet_ids\nlogging;"a;b"\n'


def test_annotations(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("snippet_id,Agreement\n1,NA\n2,yes\n3,None\nnan,no\n")
    (tmp_path / "b.csv").write_text("snippet_id,Agreement\n1,yes\n")
    a, b = tables.read_annotations(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), "snippet_id string, Agreement string")
    assert rows(a) == sorted([("1", None), ("2", "yes"), ("3", None), (None, "no")], key=repr)
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        tables.read_annotations(spark, str(tmp_path / "a.csv"), str(tmp_path / "none.csv"))


def test_survey_in_windows_1252(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes('"How\nso?",x\n"I can’t – é",1\n'.encode("cp1252"))
    df = tables.read_survey_csv(spark, str(tmp_path / "s.csv"))
    assert (df.columns, df.collect()[0][0]) == (["How\nso?", "x"], "I can’t – é")


def test_source_tree(spark, tmp_path, rows):
    (tmp_path / "own/repo/deep").mkdir(parents=True)
    (tmp_path / "own/_private/.hidden").mkdir(parents=True)
    texts = {
        "own/repo/deep/a.py": "import x\r\né\n".encode(),
        "own/repo/__init__.py": b"",
        "own/_private/_b.py": b"b",
        "own/_private/.hidden/.c.py": b"c",
        "own/repo/bad.py": b"\xff\xfe",
        "top.py": b"t",
        "own/repo/n.ipynb": b"{}",
        "own/repo/c.txt": b"x",
    }
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        found = code.read_source_tree(spark, root)
        relative = found.select(X.relative_path("path", root), "content")
        assert {r[0]: r[1] for r in relative.collect()} == {
            "own/repo/deep/a.py": "import x\né\n", "own/repo/__init__.py": "", "own/_private/_b.py": "b",
            "own/_private/.hidden/.c.py": "c", "own/repo/bad.py": None, "top.py": "t"}
    assert rows(code.read_notebook_tree(spark, str(tmp_path)), "content") == [("{}",)]
    (tmp_path / "empty").mkdir()
    assert code.read_source_tree(spark, str(tmp_path / "empty")).count() == 0


def test_source_tree_in_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(code, "_BATCH_BYTES", 10)
    (tmp_path / "r").mkdir()
    for i in range(40):
        (tmp_path / f"r/{i}.py").write_text("x" * i)
    assert sorted(len(r.content) for r in code.read_source_tree(spark, str(tmp_path)).collect()) == list(range(40))


def snippet(i):
    context = {"class": None, "function_name": "f", "function": 'def f():\n  },\n  {\n"\\', "lines_before": "[", "lines_after": "]"}
    return {"snippet_id": f"s{i}", "snippet": "}\n]{", "context": context, "line_number": i}


RECORDS = [{"library": f"é{i}", "library_type": None, "snippets": [snippet(j) for j in range(i)]} for i in range(5)]
LAYOUTS = {
    "indented": (json.dumps(RECORDS, indent=2, ensure_ascii=False), 2),
    "four": (json.dumps(RECORDS, indent=4), 4),
    "at line start": ("[" + ",\n".join(json.dumps(r, indent=2) for r in RECORDS) + "]", 0),
    "compact": (json.dumps(RECORDS), None),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_json_array(spark, tmp_path, layout):
    text, indent = LAYOUTS[layout]
    (tmp_path / "d.json").write_text(text, encoding="utf-8")
    back = documents.read_json_array(spark, str(tmp_path / "d.json"), FILTERED_FILE_CALLS, indent)
    assert sorted((r.asDict(recursive=True) for r in back.collect()), key=lambda r: r["library"]) == RECORDS


@pytest.mark.parametrize("records", [[], RECORDS[:1]])
def test_json_array_of_few(spark, tmp_path, records):
    (tmp_path / "d.json").write_text(json.dumps(records, indent=2))
    assert documents.read_json_array(spark, str(tmp_path / "d.json"), FILTERED_FILE_CALLS).count() == len(records)


def test_json_array_is_split_between_tasks(spark, tmp_path):
    """Cut at any byte, every record is read exactly once."""
    records = [{"library": f"l{i}", "library_type": "x" * (i % 50), "snippets": []} for i in range(2000)]
    (tmp_path / "d.json").write_text(json.dumps(records, indent=2))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3333")
    try:
        back = documents.read_json_array(spark, str(tmp_path / "d.json"), FILTERED_FILE_CALLS)
        assert back.rdd.getNumPartitions() > 8
        assert sorted(r.library for r in back.collect()) == sorted(r["library"] for r in records)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


ENTRIES = {f"snip_{i}": {"function": "def f():\n    {}\n  },\n", "llm_output": f'[{{"smell": "é{i}"}}]'} for i in range(4)}


@pytest.mark.parametrize("indent", [2, None])
@pytest.mark.parametrize("size", [0, 1, 4])
def test_json_map(spark, tmp_path, indent, size):
    entries = dict(list(ENTRIES.items())[:size])
    (tmp_path / "m.json").write_text(json.dumps(entries, indent=indent))
    back = documents.read_json_map(spark, str(tmp_path / "m.json"), indent=indent)
    assert {r.snippet_id: {"function": r.function, "llm_output": r.llm_output} for r in back.collect()} == entries
    assert sorted(r.smell for r in L.parse_labels(back).collect()) == [f"é{i}" for i in range(size)]


def test_label_join_keeps_failures(spark, rows):
    functions = spark.createDataFrame([("1", "f"), ("2", "g"), ("3", "h")], "snippet_id string, function string")
    responses = spark.createDataFrame([("1", "[]", None), ("2", None, "timeout")], "snippet_id string, response string, error string")
    assert rows(L.label_join(functions, responses)) == [("1", "f", "[]"), ("2", "g", "LLM error: timeout"), ("3", "h", None)]


def test_write_files_by_project(spark, tmp_path, rows):
    files = spark.createDataFrame([(f"p{i % 3}/x{i}.py", f"c{i}", f"p{i % 3}") for i in range(30)], "path string, content string, project_name string")
    sinks.write_files(files, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert rows(back, *files.columns) == rows(files)


def test_project_names_come_back_as_text(spark, tmp_path, rows):
    files = spark.createDataFrame([("007/x.py", "c", "007"), ("1e3/y.py", "d", "1e3")], "path string, content string, project_name string")
    sinks.write_files(files, str(tmp_path / "f"))
    assert rows(spark.read.parquet(str(tmp_path / "f")), "project_name") == [("007",), ("1e3",)]


@pytest.mark.parametrize("layout", ["compact", "indent2", "indent4", "column0", "crlf", "lines", "bom"])
def test_json_arrays_in_any_layout(spark, tmp_path, layout):
    records = [{"id": i, "t": f"}},\n  {{ [{i}] \" ,", "l": [{"a": i}, {"a": 2}]} for i in range(5)]
    text = {
        "compact": json.dumps(records), "indent2": json.dumps(records, indent=2), "indent4": json.dumps(records, indent=4),
        "column0": "[" + ",\n".join(json.dumps(r, indent=2) for r in records) + "]",
        "crlf": json.dumps(records, indent=2).replace("\n", "\r\n"),
        "lines": "[\n" + ",\n".join(map(json.dumps, records)) + "\n]\n", "bom": "\ufeff" + json.dumps(records, indent=2),
    }[layout]
    (tmp_path / "x.json").write_bytes(text.encode())
    back = documents.read_json_array(spark, str(tmp_path / "x.json"), "id BIGINT, t STRING, l ARRAY<STRUCT<a: BIGINT>>").collect()
    assert sorted((r.id, r.t, [x.a for x in r.l]) for r in back) == [(r["id"], r["t"], [r["id"], 2]) for r in records]


@pytest.mark.parametrize("text", ['[{"id": 1} {"id": 2}]', '{"id": 1}\n{"id": 2}', '[{"id": 1}', '[\n  {\n    "id": 1\n  },\n  {\n    "id": }\n]'])
def test_what_is_no_json_array_is_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="not a JSON array"):
        documents.read_json_array(spark, str(tmp_path / "x.json"), "id BIGINT").collect()


def test_json_writers_keep_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1), ("b\n\"", "y", None)], "x string, y string, z int").coalesce(1)
    sinks.write_json_array(df, str(tmp_path / "a"))
    sinks.write_json_map(df, str(tmp_path / "m"), "x")
    sinks.write_json(df, str(tmp_path / "l"))
    read = lambda name: "".join(p.read_text() for p in (tmp_path / name).glob("part*"))
    assert json.loads(read("a")) == [{"x": "a", "y": None, "z": 1}, {"x": 'b\n"', "y": "y", "z": None}]
    assert json.loads(read("m")) == {"a": {"y": None, "z": 1}, 'b\n"': {"y": "y", "z": None}}
    assert '"y":null' in read("l")


def test_json_round_trip_writes_no_more_than_its_files_need(spark, tmp_path):
    """Many calls in one large function: the function is on disk once, and in every call that is read back."""
    from driver_queries.tables import json_round_trip

    text = "\n".join(f"{i} {i * i} some words of line {i % 89}" for i in range(400))
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING"
    docs = spark.createDataFrame([(1, text, "fr", "src1"), (2, None, "en", "src1")], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    base = Path(shared_folder(spark).removeprefix("file:"))
    there = set(base.glob("json-*"))
    calls = json_round_trip(spark, str(tmp_path)).collect()
    assert len(calls) > 80 and {r.library for r in calls} == {"mlflow"} and len({r.function_md5 for r in calls}) == 1
    folder, = set(base.glob("json-*")) - there
    assert sum(f.stat().st_size for f in folder.glob("part-*")) < 20 * len(text)


def test_csv_cells_keep_their_blanks(spark, tmp_path, rows):
    df = spark.createDataFrame([("    def f():\n        return 1\n",), ("   ",), ("\t",)], "x string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert rows(tables.read_table_csv(spark, str(tmp_path / "c"), "x STRING")) == rows(df)


def test_append_unique_with_repeats_in_a_batch(spark, tmp_path, rows):
    path = str(tmp_path / "m")
    batch = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    sinks.append_unique(batch(("a", 2), ("a", 1), (None, 3), (None, 4)), path, "k", 0)
    sinks.append_unique(batch((None, 5), ("b", 1), ("b", 1)), path, "k", 1)
    assert rows(spark.read.parquet(path), "k", "v") == sorted([("a", 1), (None, 3), ("b", 1)], key=repr)


def test_append_unique_is_idempotent(spark, tmp_path, rows):
    path = str(tmp_path / "m")
    batch = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    sinks.append_unique(batch(("a", 1), ("b", 1)), path, "k", 0)
    sinks.append_unique(batch(("b", 2), ("c", 2)), path, "k", 1)
    sinks.append_unique(batch(("b", 2), ("c", 2)), path, "k", 1)  # the same batch again
    assert rows(spark.read.parquet(path), "k", "v") == [("a", 1), ("b", 1), ("c", 2)]


def test_append_unique_reads_only_buckets_that_may_hold_its_keys(spark, tmp_path, rows):
    path = str(tmp_path / "m")
    batch = lambda keys: spark.createDataFrame([(k, 1) for k in keys], "k string, v int")
    assert sinks.append_unique(batch([f"k{i}" for i in range(3000)]), path, "k", 0) == []
    # one new key and one known key: at most two buckets are read
    read = sinks.append_unique(batch(["new", "k17", "k17"]), path, "k", 1)
    assert 1 <= len(read) <= 2
    assert rows(spark.read.parquet(path).filter("batch_id = 1"), "k") == [("new",)]
    # keys the table does not share a bit with read nothing
    assert sinks.append_unique(batch([]), path, "k", 2) == []
    assert spark.read.parquet(path).count() == 3001
    assert spark.read.parquet(path).select("k").distinct().count() == 3001


def test_append_unique_equals_a_plain_anti_join(spark, tmp_path, rows):
    import random

    rng = random.Random(5)
    path = str(tmp_path / "m")
    seen, want = set(), []
    for b in range(4):
        keys = [rng.choice([None, *map(str, range(400))]) for _ in range(300)]
        sinks.append_unique(spark.createDataFrame([(k, b) for k in keys], "k string, v int"), path, "k", b)
        for k in sorted(set(keys), key=repr):
            if k not in seen:
                seen.add(k)
                want.append((k, b))
    assert rows(spark.read.parquet(path), "k", "v") == sorted(want, key=repr)


def test_index_and_kappa_folders(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",)], "x string")
    sinks.write_index_csv(df, str(tmp_path / "i"), ["x"])
    assert tables.read_table_csv(spark, str(tmp_path / "i")).orderBy("index").collect() == [(0, "a"), (1, "b")]
    sinks.write_kappa(df, df, df, str(tmp_path / "k"))
    assert sorted(p.name for p in (tmp_path / "k").iterdir()) == ["disagreements", "kappa_by_smell", "metadata"]


def test_row_index_over_many_ranges(spark):
    from logharvest.operators.catalogue import batch_slice
    from logharvest.operators.layout import with_row_index

    df = spark.range(0, 5000, numPartitions=8).selectExpr("(id * 7919) % 5000 AS v")
    found = {(r["v"], r["index"]) for r in with_row_index(df, ["v"]).collect()}
    assert found == {(i, i) for i in range(5000)}
    assert sorted(r.v for r in batch_slice(df, ["v"], 4990, 500).collect()) == list(range(4990, 5000))
    assert with_row_index(df.filter("v < 0"), ["v"]).count() == 0
