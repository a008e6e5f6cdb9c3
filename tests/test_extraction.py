from __future__ import annotations

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logharvest import dictionaries as D
from logharvest.operators import calls as C
from logharvest.operators import extraction as E
from logharvest.operators.facts import facts_udf, file_facts
from logharvest.operators.notebooks import broken_notebooks, flatten_notebooks


def parse(spark, sources, **options):
    return E.parse_files(spark.createDataFrame(list(sources.items()), "path string, content string"), **options)


def calls_of(spark, source, **options):
    return E.extract_calls(parse(spark, {"own/repo/f.py": source}, **options)).orderBy("position").collect()


def test_call_forms(spark):
    source = "\n".join([
        "import logging",
        "import wandb as wb",
        "from mlflow import log_metric, log_param as lp",
        "import logging.config",
        "from tensorflow.summary import scalar",
        "from sacred import *",
        "logger = logging.getLogger('x')",       # counts
        "logger.info('no: local object')",
        "logging.getLogger('y').info('no: chain')",  # only the inner call
        "wb.log({})",
        "log_metric('a', 1)",
        "lp('b', 2)",
        "scalar('no: other module', 1)",
        "run('no: star import')",
        "logging.config.dictConfig({})",          # no: two dots
        "text = 'logging.info(1)'",
    ])
    found = [(c.line_number, c.snippet, c.call_library) for c in calls_of(spark, source)]
    assert found == [
        (7, "logging.getLogger('x')", "logging"),
        (9, "logging.getLogger('y')", "logging"),
        (10, "wb.log({})", "wandb"),
        (11, "log_metric('a', 1)", "mlflow"),
        (12, "lp('b', 2)", "mlflow"),
    ]


def test_context_is_innermost_and_async_is_ignored(spark):
    source = "\n".join([
        "import logging",
        "class A:",
        "    @logging.deco()",                    # above the def line
        "    def outer(self, x=logging.INFO()):",
        "        def inner():",
        "            logging.info(1)",
        "        logging.info(2)",
        "    async def later(self):",
        "        logging.info(3)",
        "def plain():",
        "    class B:",
        "        logging.info(4)",
        "logging.info(5)",
    ])
    context = {c.snippet: (c["class"], c.function_name) for c in calls_of(spark, source)}
    assert context == {
        "logging.deco()": ("A", None),
        "logging.INFO()": ("A", "outer"),
        "logging.info(1)": ("A", "inner"),
        "logging.info(2)": ("A", "outer"),
        "logging.info(3)": ("A", None),
        "logging.info(4)": ("B", "plain"),
        "logging.info(5)": (None, None),
    }
    with_async = {c.snippet: c.function_name for c in calls_of(spark, source, with_async=True)}
    assert with_async["logging.info(3)"] == "later"


def test_function_text_starts_at_def_and_keeps_indentation(spark):
    source = "import logging\nclass A:\n    @staticmethod\n    def f():\n        logging.info(\n            'é',\n        )\n        return 1\n"
    (call,) = calls_of(spark, source)
    assert call.function == "    def f():\n        logging.info(\n            'é',\n        )\n        return 1"
    assert call.snippet == "logging.info(\n            'é',\n        )"
    assert (call.lines_before, call.lines_after) == ("def f():", "return 1")
    raw = hashlib.sha256(call.function.encode()).hexdigest()
    trimmed = hashlib.sha256(call.function.strip().encode()).hexdigest()
    assert (call.function_digest, call.trimmed_digest) == (raw, trimmed)


def test_neighbours_at_the_edges(spark):
    (call,) = calls_of(spark, "import logging; logging.info(\n1)\n")
    # Last line of the file: the line below the first line of the call.
    assert (call.lines_before, call.lines_after) == (None, "1)")
    (call,) = calls_of(spark, "import logging\n\nlogging.info(1)")
    assert (call.lines_before, call.lines_after) == (None, None)


def test_ids(spark):
    (call,) = calls_of(spark, "import logging\nlogging.info(1)")
    text = hashlib.md5(b"own/repo/f.py_2_logging.info(1)").hexdigest()
    assert call.snippet_id == "snip_" + text[:8]
    assert call.file_id == "file_" + hashlib.md5(b"own/repo/f.py").hexdigest()[:8]
    assert call.project_name == "own"


def test_two_equal_calls_on_one_line_are_two_calls(spark):
    assert len(calls_of(spark, "import logging\nlogging.info(1); logging.info(1)")) == 2


def test_windows_lines_and_form_feeds(spark):
    source = "import logging\r\n\x0cx = 1\r\nlogging.info(1)\r\ny = 2\r\n"
    (call,) = calls_of(spark, source)
    assert (call.line_number, call.lines_before, call.lines_after) == (3, "x = 1", "y = 2")


def test_relative_imports(spark):
    source = "from .logging import info\ninfo(1)"
    assert len(calls_of(spark, source)) == 1
    assert calls_of(spark, source, absolute_only=True) == []


def test_misspelt_library_by_default(spark):
    source = "import warnings\nwarnings.warn(1)"
    assert calls_of(spark, source) == []
    fixed = D.libraries(fix_warnings=True)
    (call,) = calls_of(spark, source, libraries=fixed)
    assert call.call_library == "warnings"


def test_library_and_type_of_a_file(spark, rows):
    sources = {
        "o/r/general.py": "import logging\nlogging.info(1)",
        "o/r/ml.py": "import wandb as wb\nwb.log(1)",
        "o/r/hybrid.py": "import logging, wandb\nwandb.log(1)\nlogging.info(1)",
        "o/r/hidden.py": "import logging\n(logging).info(1)",
        "o/r/none.py": "import logging",
    }
    data = E.build_call_dataset(parse(spark, sources))
    assert rows(data, "file_path", "library", "library_type", F.size("snippets")) == [
        ("o/r/general.py", "logging", "general-purpose", 1),
        ("o/r/hidden.py", None, None, 1),
        ("o/r/hybrid.py", "wandb", "hybrid", 2),
        ("o/r/ml.py", "wandb", "ML-specific", 1),
    ]


def test_broken_files_are_reported_not_fatal(spark, rows):
    sources = {
        "a/bad.py": "import logging\nlogging.info(",
        "a/null.py": "import logging\nx = 'a\x00b'",
        "a/good.py": "import logging\ndef f():\n    logging.info(1)\nclass A: pass",
        "a/other.py": "x = 1",
        "a/undecodable.py": None,
    }
    every = parse(spark, sources, keep_all=True)
    assert rows(E.unparsable_files(every), "path") == [("a/bad.py",), ("a/null.py",), ("a/undecodable.py",)]
    assert rows(E.files_with_calls(every), "path") == [("a/good.py",)]
    assert ("a/good.py", 1, 1) in rows(E.count_definitions(every))
    assert ("a/bad.py", 0, 0) in rows(E.count_definitions(every))


def test_bytes_that_are_no_text(spark, rows):
    raw = spark.createDataFrame([("a.py", bytearray(b"import logging\n'\xff'"))], "path string, raw binary")
    files = raw.select("path", F.col("raw").cast("string").alias("content"))
    parsed = E.parse_files(files)
    assert rows(E.unparsable_files(parsed), "path", "reason") == [("a.py", "no text")]
    assert E.extract_calls(parsed).count() == 0


def test_deep_nesting_is_an_error_row():
    assert file_facts("import logging\nx = " + "(" * 5000 + ")" * 5000, frozenset(["logging"]))["status"] != "parsed"


def test_prefilter_keeps_every_file_with_a_call(spark, rows):
    sources = {"a.py": "from  \\\n logging import info\ninfo(1)", "b.py": "import os"}
    assert rows(E.extract_calls(parse(spark, sources)), "path") == [("a.py",)]


def test_each_file_is_split_and_parsed_once(spark):
    """The split of a text must not end up inside a lambda or a pushed-down
    filter, and the parser must appear once."""
    parsed = parse(spark, {"a.py": "import logging"})
    from logharvest.operators.calls import filter_file_calls, unique_function_ids, filter_calls

    for frame in (
        filter_file_calls(E.build_call_dataset(parsed)),
        unique_function_ids(filter_calls(E.extract_calls(parsed))),
        E.extract_calls(parsed).select("function"),
    ):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("facts(content") == 1
        # Long plans are cut in the middle of expressions, so count the word itself.
        assert plan.count("split(regexp_replace") <= 1


def test_functions_are_hashed_before_calls_are_exploded(spark):
    """Plans print from the top: the explode must come above the hashing."""
    from logharvest.operators.calls import distinct_functions

    frame = distinct_functions(E.extract_calls(parse(spark, {"a.py": "import logging"})))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1
    assert plan.index("posexplode") < plan.index("sha2(")


def test_enclosing_scope_of_separate_tables(spark, rows):
    calls = spark.createDataFrame([("p", 3), ("p", 3), ("p", 9), ("q", 3)], "path string, line int")
    scopes = spark.createDataFrame(
        [("p", "function", "f", 1, 5), ("p", "function", "g", 2, 4), ("p", "class", "C", 1, 8)],
        "path string, kind string, name string, first int, last int")
    assert rows(E.enclosing_scope(calls, scopes)) == [
        ("p", 3, "g", "C"), ("p", 3, "g", "C"), ("p", 9, None, None), ("q", 3, None, None)]


@pytest.mark.parametrize("n", [1, 7, 49])
def test_counts_follow_the_formula(spark, n):
    """Sources whose calls are known from a number, whatever the parser does."""
    def source(i):
        body = ["    logging.info(x)"] * (i % 5) + ["    logging.error(x)"] * (i % 2)
        tail = ["oops = ("] if i % 7 == 6 else []
        return "\n".join(["import logging", f"def f_{i}(x):", *body, "    return 'logging.info(1)'", *tail])

    frame = parse(spark, {f"r/{i}.py": source(i) for i in range(n)})
    expected = sum(i % 5 + i % 2 for i in range(n) if i % 7 != 6)
    assert E.extract_calls(frame).count() == expected


def test_notebooks(spark, rows):
    import json

    new = {"nbformat": 4, "cells": [
        {"cell_type": "markdown", "source": ["# T\n", "x"]},
        {"cell_type": "code", "source": "!pip install x\nimport os\n  %time f()"},
        {"cell_type": "code", "source": ["[1]\n", "100 % 7"]},
    ]}
    old = {"nbformat": 3, "worksheets": [{"cells": [{"cell_type": "code", "input": ["a = 1"]}]}]}
    books = spark.createDataFrame(
        [("a/n.ipynb", json.dumps(new)), ("a/o.ipynb", json.dumps(old)), ("a/bad.ipynb", "{oops"), ("a/no.ipynb", "[1]")],
        "path string, content string")
    assert rows(flatten_notebooks(books)) == [
        ("a/n.py", "# # T\n# x\n\n# !pip install x\nimport os\n  # %time f()\n\n[1]\n100 % 7\n"),
        ("a/o.py", "a = 1\n"),
    ]
    assert rows(broken_notebooks(books)) == [("a/bad.py",), ("a/no.py",)]


def test_a_byte_order_mark_is_no_part_of_the_program(spark, rows):
    files = spark.createDataFrame([("a.py", "\ufeffimport logging\nlogging.info(1)\n"), ("b.py", None)], "path string, content string")
    parsed = E.parse_files(files)
    assert rows(E.extract_calls(parsed), "path", "snippet") == [("a.py", "logging.info(1)")]
    assert rows(E.unparsable_files(parsed), "path", "reason") == [("b.py", "no text")]


def test_a_row_of_the_data_set_is_linear_in_its_file(spark, tmp_path):
    """Many calls in one large function: its text is there once, and comes back at the sink."""
    body = "\n".join(f"    logging.info({i})" for i in range(3000))
    files = spark.createDataFrame([("a.py", f"import logging\ndef f():\n{body}\n")], "path string, content string")
    data = E.build_call_dataset(E.parse_files(files), bodies=False)
    content, = data.select("python_file_content").first()
    size, n = data.select(F.length(F.to_json(F.struct("snippets", "functions"))), F.size("snippets")).first()
    assert n == 3000 and size < 20 * len(content)
    whole = E.build_call_dataset(E.parse_files(files))
    one = F.element_at("snippets", 3000)
    assert E.with_bodies(data).select(one.alias("s")).first() == whole.select(one.alias("s")).first()
    kept = C.filter_file_calls(data)
    assert E.explode_calls(kept).where(F.length("function") > 30_000).count() == 3000


def test_facts_leave_the_worker_in_pieces(spark):
    """A batch of any size: no more than 256 files, or a file more than 2**20 characters, are held as objects."""
    source = "import logging\nlogging.info(1)\n"
    texts = [source, None, "broken = ("] * 300 + [source + "# " + "x" * 700_000] * 5
    batches = [pa.array(texts, pa.string()), pa.array([], pa.string()), pa.array([source], pa.string())]
    pieces = list(facts_udf(["logging"]).func(iter(batches)))
    assert max(len(p) for p in pieces) <= 256 and len(pieces) == 7
    facts = [f for p in pieces for f in p.to_pylist()]
    assert [f["status"] for f in facts] == ["parsed", "no text", "SyntaxError"] * 300 + ["parsed"] * 6


def test_calls_with_one_short_id_stay_apart(spark, rows):
    """Everything that counts, lists, samples and joins calls goes by the whole digest."""
    from logharvest.operators import labels as L, sampling as W

    calls = spark.createDataFrame(
        [(f"{i:032x}", "snip_00000000", "wandb.log(1)", "wandb", "t", "f", f"body {i}", "p", i) for i in range(3)],
        "call_key string, snippet_id string, snippet string, library string, library_type string, function_name string, "
        "function string, file_path string, position int")
    ids = C.unique_function_ids(calls)
    assert ids.count() == 3
    assert C.unique_functions(calls, 1).first().snippet_ids == ["snip_00000000"] * 3
    assert W.stratified_sample(ids).count() == 3
    chosen = W.balanced_sample(ids, 2)
    assert chosen.count() == 2 and chosen.columns == ["call_key", "snippet_id"]
    assert W.exclude_used(ids, chosen).count() == 1
    assert W.flag_selected(W.add_default_column(ids), chosen).where("selected = 'yes'").count() == 2
    functions = W.functions_for_ids(calls, ids)
    assert rows(functions, "function") == [("body 0",), ("body 1",), ("body 2",)]
    answers = functions.select("call_key", F.lit(None).cast("string").alias("error"), F.col("function").alias("response"))
    joined = L.label_join(functions, answers)
    assert joined.where("llm_output = function").count() == joined.count() == 3


def test_enclosing_scopes_of_any_length(spark, rows):
    import random

    rng = random.Random(1)
    scopes = [("p", rng.choice(["function", "class"]), f"n{i}", (a := rng.randrange(1, 200)), a + rng.choice([0, 1, 5, 70]))
              for i in range(60)] + [("p", "class", "endless", 150, 2**31 - 1), ("q", "function", "other", 1, 9)]
    firsts = set()
    scopes = [s for s in scopes if (s[1], s[3]) not in firsts and not firsts.add((s[1], s[3]))]
    calls = [("p", line) for line in range(0, 300)] + [("p", 7), ("r", 1)]
    got = E.enclosing_scope(spark.createDataFrame(calls, "path string, line int"), spark.createDataFrame(
        scopes, "path string, kind string, name string, first int, last int"))
    inner = lambda path, line, kind: max(
        ((s[3], s[2]) for s in scopes if s[0] == path and s[1] == kind and s[3] <= line <= s[4]), default=(0, None))[1]
    want = [(p, n, inner(p, n, "function"), inner(p, n, "class")) for p, n in calls]
    assert rows(got, "path", "line", "function_name", "class") == sorted(want, key=repr)


def test_counting_splits_no_file(spark, rows):
    files = spark.createDataFrame([("a.py", "import logging\ndef f():\n    logging.info(1)\nlogging.info(2)\n")], "path string, content string")
    parsed = E.parse_files(files)
    kept = C.filter_calls(E.extract_calls(parsed, texts=False))
    assert rows(kept, "call_key", "snippet", "function_name") == rows(
        C.filter_calls(E.extract_calls(parsed)), "call_key", "snippet", "function_name")
    for count in (C.total_calls, C.level_counts, C.library_counts):
        plan = count(kept)._jdf.queryExecution().optimizedPlan().toString()
        assert "split(" not in plan and "sha2" not in plan


def test_enclosing_scope_sweep_on_a_large_path(spark):
    """100,000 calls and 2,000 overlapping, unnested scopes in one path, against a plain scan."""
    import numpy as np

    rng = np.random.default_rng(5)
    n, m = 100_000, 2_000
    lines = rng.integers(0, 200_000, n)
    first = rng.integers(0, 200_000, m)
    last = first + rng.choice([0, 3, 500, 20_000, 150_000], m)
    kinds = rng.choice(["function", "class"], m)
    names = [f"s{i % 1500}" for i in range(m)]  # equal starts are told apart by the larger name
    calls = spark.createDataFrame([("p", int(x)) for x in lines], "path string, line long")
    scopes = spark.createDataFrame(
        [("p", str(k), nm, int(a), int(b)) for k, nm, a, b in zip(kinds, names, first, last)],
        "path string, kind string, name string, first long, last long")
    got = E.enclosing_scope(calls, scopes).toPandas()
    assert len(got) == n
    for kind, column in (("function", "function_name"), ("class", "class")):
        best = np.full(n, -1)
        best_name = np.array([""] * n, dtype=object)
        for i in np.flatnonzero(kinds == kind):
            inside = (lines >= first[i]) & (lines <= last[i])
            better = inside & ((first[i] > best) | ((first[i] == best) & (best_name < names[i]).astype(bool)))
            best[better], best_name[better] = first[i], names[i]
        want = dict(zip(lines.tolist(), [x or None for x in best_name.tolist()]))
        assert [want[x] for x in got.line] == got[column].tolist()
