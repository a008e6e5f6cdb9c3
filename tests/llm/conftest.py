from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(seed: int = 1, n: int = 400) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


@pytest.fixture(scope="session")
def prose():
    """``prose(n, seed)``: n random words, in lines of up to 12."""
    words = vocabulary()

    def make(n: int, seed: int) -> str:
        rng = random.Random(seed)
        out = [rng.choice(words) for _ in range(n)]
        return "\n".join(" ".join(out[i : i + 12]) for i in range(0, n, 12))

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """Rows ``(doc_id, text[, lang, source])`` as a table of documents."""

    def make(rows):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, "en", "src1")[:4] if len(r) == 2 else r
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def messy(documents, prose):
    """Nulls everywhere, empty, blank, very long and repeated texts, equal rows, ids given twice."""
    base = prose(80, 5)
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base, "en", "b"), (3, None, None, None), (4, "", "de", "c"),
        (5, " \n\t\n ", "en", None), (None, prose(60, 6), None, "a"), (None, None, None, None), (7, "one", "en", "a"),
        (8, "é 漢字 😀 ß\x00 \x85 x", "fr", "b"), (9, prose(30_000, 7), "en", "c"), (10, "word " * 5000, "en", "a"),
        (11, "x" * 60_000, "en", "a"), (12, "1" * 30_000 + " 1" * 30_000, "en", "b"), (1, prose(40, 8), "en", "c"),
        (2**60 + 1, prose(25, 9), "en", "a"),
    ]
    return documents(rows)


@pytest.fixture(scope="session")
def clashing():
    """Adds columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    def add(df):
        names = ["key", "words", "n", "h", "at", "size", "fp", "s", "start", "kind", "Text2", "a", "b"]
        return df.withColumns({c: F.lit(f"extra {c}") for c in names})

    return add


@pytest.fixture(scope="session")
def broadcast_rows():
    """``broadcast_rows(df)``: rows of the largest table that a frame's run broadcast; it has to have run."""

    def largest(df) -> int:
        found, plans = 0, [df._jdf.queryExecution().executedPlan()]
        while plans:
            plan = plans.pop()
            name = plan.nodeName()
            if name == "BroadcastExchange":
                found = max(found, plan.metrics().apply("numOutputRows").value())
            if name == "AdaptiveSparkPlan":
                plans.append(plan.executedPlan())
            elif name.endswith("QueryStage"):
                plans.append(plan.plan())
            children = plan.children()
            plans += [children.apply(i) for i in range(children.size())]
        return found

    return largest


@pytest.fixture
def broadcast_limit(spark):
    """Bytes up to which the session broadcasts a table of estimated size, for one test."""
    name, limit = "spark.sql.autoBroadcastJoinThreshold", 200_000
    before = spark.conf.get(name)
    spark.conf.set(name, limit)
    yield limit
    spark.conf.set(name, before)


@pytest.fixture(scope="session")
def contaminated(prose):
    """Rows with windows of their own around one of the items each, and the items, the last one without an id."""
    items = [(i if i else None, " ".join(prose(40, 900 + i).split())) for i in (1, 2, 3, 4, 0)]
    rows = []
    for d in range(200):
        a, b = prose(30, 3000 + d).split(), prose(30, 4000 + d).split()
        rows.append((d, " ".join([*a, items[d % 5][1], *b])))
    return rows, items
