from __future__ import annotations

import random
import time

import pytest

from logharvest import dictionaries as D
from logharvest.operators import frameworks as M

FILES = "repository_full_name string, path string, content string"
TERMS = "priority long, framework string, term string"


def texts(n=400, seed=3):
    rng = random.Random(seed)
    words = ["import", "from", "tensorflow", "torch", "keras", "x", "langchain", "openai", "as", "\n", "\t", ";", "_", "(", "Torch"]
    extra = [t for _, t in D.FRAMEWORK_TERMS][:40]
    out = []
    for i in range(n):
        body = " ".join(rng.choice(words + extra) for _ in range(rng.randint(0, 60)))
        out.append((f"o/r{i % 13}", f"o/r{i % 13}/f{i}.py", body if i % 50 else None))
    return out


def chain(spark, files, terms, mode):
    return sorted(tuple(r) for r in M.match_terms(files, terms, mode).collect())


def table(spark, files, terms, mode):
    df = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(terms)], TERMS)
    return sorted(tuple(r) for r in M.match_term_table(files, df, mode).collect())


@pytest.mark.parametrize("mode", ["file", "import"])
def test_equals_the_chain_on_the_default_terms(spark, mode):
    files = spark.createDataFrame(texts(), FILES)
    terms = list(D.FRAMEWORK_TERMS)
    assert table(spark, files, terms, mode) == chain(spark, files, terms, mode)


def test_equal_priorities_and_null_rows(spark):
    files = spark.createDataFrame([("o/r", "o/r/a.py", "use  torch\nand keras"), ("o/r", "o/r/b.py", None)], FILES)
    terms = spark.createDataFrame([(1, "b", "keras"), (1, "a", "torch"), (None, "c", "use"), (2, "d", None)], TERMS)
    assert [tuple(r) for r in M.match_term_table(files, terms).collect()] == [("o/r", "o/r/a.py", 1, "a", "torch")]


def test_ten_thousand_terms_cost_about_what_thirteen_do(spark):
    files = spark.createDataFrame(texts(3000, 9), FILES).cache()
    files.count()
    rng = random.Random(1)
    many = [("f%d" % i, "".join(rng.choice("abcdefghij") for _ in range(8))) for i in range(10_000)] + list(D.FRAMEWORK_TERMS)[:13]
    few = list(D.FRAMEWORK_TERMS)[:13]

    def timed(terms):
        start = time.time()
        got = table(spark, files, terms, "file")
        return time.time() - start, got

    timed(few)
    t_few, got_few = timed(few)
    t_many, got_many = timed(many)
    assert t_many < 3 * t_few + 2
    assert got_many == chain(spark, files, many[:0] + many[-13:], "file") or len(got_many) >= len(got_few)
