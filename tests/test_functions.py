from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logharvest import dictionaries as D
from logharvest.functions import calls as C
from logharvest.functions import labels as L
from logharvest.functions import matching as M
from logharvest.functions import text as X


def values(spark, expression, *inputs, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def test_space_classes_are_pythons():
    assert set(X.SPACE_CHARS) == set(SPACES)


def test_strip(spark):
    texts = [" a b ", "\t\n x\r\n", SPACES + "q" + SPACES, "", "  ", None]
    assert values(spark, X.strip("v"), *texts) == [t.strip() if t is not None else None for t in texts]


def test_collapse_whitespace(spark):
    texts = ["a\n b\t\tc ", "", "\u00a0x\u2003y"]
    assert values(spark, X.collapse_whitespace("v"), *texts) == [" ".join(t.split()) for t in texts]


def without_front_comments(text):
    lines = text.splitlines(keepends=True)
    cut = next((i for i, l in enumerate(lines) if l.strip().startswith(("import", "from"))), len(lines))
    front = [l for l in lines[:cut] if l.strip() and l.strip()[0] != "#"]
    return "".join(front + lines[cut:])


def test_strip_leading_comments(spark):
    texts = [
        "# a\n\nimport x\n# kept\n\nimport y\n",
        "import x\n# kept\n",
        "# a\nx = 1\n\n  # b\n",
        "'''doc\nfrom here it counts'''\n\n# kept\n",
        "important = 1\n# kept",
        "",
        "# only",
        "\n\n  \t\n# é 😀\nfrom a import b\n\n",
        "x = 1  # not a comment line\n#y\n   import z",
    ]
    assert values(spark, X.strip_leading_comments("v"), *texts) == [without_front_comments(t) for t in texts]


def test_root_name_and_paths(spark):
    assert values(spark, X.root_name("v"), "wb.log(x.y)", "lp(a.b)", "(logging).info()", "a") == ["wb", "lp", "", "a"]
    paths = ["file:/data/root/own/repo/a.py", "file:///data/root/a.py", "/data/root/own/b.py"]
    relative = X.relative_path("v", "file:/data/root/")
    assert values(spark, relative, *paths) == ["own/repo/a.py", "a.py", "own/b.py"]
    assert values(spark, X.project(F.col("v"), relative), *paths) == ["own", "root", "own"]


def test_split_ids(spark):
    assert values(spark, X.split_ids("v"), "a;b;", kind="string") == ["a", "b", ""]


def test_percent_label_rounds_as_printf(spark):
    numbers = [6.25, 18.75, 0.15, 0.05, 0.35, 33.333333, 100.0, 1234.55]
    expected = [f"1 ({n:.1f}%)" for n in numbers]
    assert values(spark, X.percent_label(F.lit(1), "v"), *numbers, kind="double") == expected


def test_source_segment_counts_bytes(spark):
    lines = F.split("v", "\n")
    one = X.source_segment(lines, F.lit(1), F.lit(1), F.lit(3), F.lit(5))
    assert values(spark, one, "é=xyz") == ["xy"]
    two = X.source_segment(lines, F.lit(2), F.lit(3), F.lit(2), F.lit(3))
    assert values(spark, two, "a\nü(1\né)z\nb") == ["(1\né)"]


def test_log_level(spark):
    texts = ["logging.info(1)", " logging.warn (x)", "logging.warning\n(x)", "logging.log(1)", "log.info(1)",
             "logging.infos(1)", "x logging.info(1)", "logging.info", "logging.info.x(1)", "", None]
    expected = ["info", "warn", "warning", "log"] + [None] * 7
    assert values(spark, C.log_level("v"), *texts) == expected


def test_library_type(spark):
    cases = [["logging", "wandb"], ["logging"], ["mlflow"], ["other"], [], None]
    expected = ["hybrid", "general-purpose", "ML-specific", None, None, None]
    assert values(spark, C.library_type("v"), *cases, kind="array<string>") == expected


def test_reassign_library(spark):
    frame = spark.createDataFrame(
        [("logging", "hybrid", "wandb.log(logging.x)"), ("logging", "hybrid", "f(1)"), ("logging", "general-purpose", "wandb.log(1)")],
        "library string, t string, s string")
    run = lambda mode: [r[0] for r in frame.select(C.reassign_library("library", "t", "s", mode)).collect()]
    assert run("reference") == ["logging"] * 3
    assert run("intended")[1:] == ["logging", "logging"]
    with pytest.raises(ValueError):
        run("other")


WANTED = {
    "tf.summary.scalar(1)": True, "tf.summaryx": True, "\ttf.summary(1)": True,
    "tf.compat.v1.logging.info(1)": True, "tf.compat.v1.logging.log_every_n (1)": True,
    "tf.compat.v1.logging.other(1)": False, "tf.foo()": False, "tf_x()": False, "tf_module.a()": False,
    "keras.x()": False, "tensorflow.x()": False, "logging.log(1)": False, "logging.info(1)": True,
    "util.x()": False, "utility()": False, "expand_dims(1)": False, "wandb.init()": False,
    "wandb.initx": False, "wandb.log()": True, "wandb.Api": True, "wandb.Api()": False, " basicConfig()": False,
    "x.util()": True, "": True,
}


def test_wanted_calls(spark):
    assert dict(zip(WANTED, values(spark, C.is_wanted_call("v"), *WANTED))) == WANTED


def test_config_prefixes_agree_with_startswith(spark):
    texts = [p + tail for p in D.config_prefixes() for tail in ("", "(1)", "x")] + ["a" + p for p in D.config_prefixes()]
    expected = [any(t.startswith(p) for p in D.config_prefixes()) for t in texts]
    assert values(spark, C.is_config_call("v"), *texts) == expected


def test_config_call_of_own_library(spark):
    frame = spark.createDataFrame(
        [("wandb.init()", "wandb"), ("wandb.init()", "mlflow"), ("wandb.init()", None), (None, "wandb"), ("x", "none")],
        "s string, l string")
    found = [r[0] for r in frame.select(C.is_config_call_of("s", "l")).collect()]
    assert found == [True, False, False, False, False]


def test_first_term(spark):
    texts = ["import MLflow", "mlflows", "from neptune.new import x; import logging", "use tensorboardX here",
             "semantic\n  kernel", None]
    terms = [*D.FRAMEWORK_TERMS, ("semantic_kernel", "semantic kernel")]
    found = values(spark, M.first_term(F.lower("v"), terms)["term"], *texts)
    assert found == ["mlflow", None, "neptune", "tensorboardX", "semantic kernel", None]


def test_import_mode(spark):
    texts = ["# wandb is fine", "import os, wandb", "from wandb.sdk import x", "import wandbx", "x = 1\n  import wandb as w"]
    found = values(spark, M.first_term(F.lower("v"), [("wandb", "wandb")], "import")["term"], *texts)
    assert found == [None, "wandb", "wandb", None, "wandb"]
    with pytest.raises(ValueError):
        M.term_pattern("x", "other")


def test_smell_label(spark):
    texts = ["this is HEAVY logging", "print logging and heavy logging", "none", None]
    assert values(spark, M.smell_label("v"), *texts) == ["Heavy Logging", "Heavy Logging", None, None]


ANSWERS = {
    '[{"smell": "Print Logging", "rationale": "uses \\"print\\"", "confidence": "High"}]':
        ("Print Logging", 'uses "print"', "High"),
    ' [\n{"smell": "A"}]\n': ("A", "", ""),
    '[{"smell": "A"}, 1]': ("A", "", ""),
    '[{"smell": null, "confidence": "Low"}]': (None, "", "Low"),
    '[{"smell": "é 😀"}]': ("é 😀", "", ""),
    # Anything that is not strictly an array starting with an object counts for nothing.
    **dict.fromkeys([
        '{"smell": "A"}', '```json\n[{"smell": "A"}]\n```', "[{'smell': 'A'}]", '[{"smell": "A"}] trailing',
        "[]", "[1]", "[null]", '["x"]', '[[{"smell": "A"}]]', '[1, {"smell": "A"}]', "LLM error: 429", "", "null",
        '[{"smell": "A"}][{"smell": "B"}]', '[{"smell": "A"}],[1]', '[{"smell": "A",}]', None,
    ], ("", "", "")),
}


def test_parse_smell(spark):
    found = [tuple(r) for r in values(spark, L.parse_smell("v"), *ANSWERS)]
    assert dict(zip(ANSWERS, found)) == ANSWERS


def test_prompts(spark):
    assert values(spark, L.build_prompt("v", "a {{b}} {function} c {{function}}"), "F{x}") == ["a {b} F{x} c {function}"]
    with pytest.raises(ValueError):
        L.build_prompt("v", "{other}")
    for template in L.TEMPLATES.values():
        (filled,) = values(spark, L.build_prompt("v", template), "def f(): pass")
        assert filled == template.format(function="def f(): pass")
