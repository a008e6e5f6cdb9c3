from __future__ import annotations

import random

import pytest

import corpus_pipeline as P
from logharvest.llm import shingle_duplicates as S


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def similarity(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def pairs(prose):
    """Pairs of texts, similar from below 0.8 to 0.95, by words changed in one of them."""
    out = []
    for i in range(120):
        base = prose(300, 10_000 + i).split()
        other, rng = list(base), random.Random(i)
        for at in rng.sample(range(300), 2 + i % 14):
            other[at] = f"changed{i}x{at}"
        out.append((" ".join(base), " ".join(other)))
    return out


def test_stage_removes_pairs_of_similarity_from_080(spark, documents, pairs):
    docs = documents([(2 * i + k, t) for i, two in enumerate(pairs) for k, t in enumerate(two)])
    kept = {r.doc_id for r in P.near_dedup(spark, docs, "").collect()}
    values = [similarity(*two) for two in pairs]
    assert sum(0.8 <= v <= 0.95 for v in values) > 40 and sum(v < 0.8 for v in values) > 20
    assert kept == {2 * i + k for i, v in enumerate(values) for k in (0, 1) if not (k and v >= 0.8)}


def test_chunks_of_a_large_group_lose_no_link(documents, prose):
    base, rng = prose(200, 4).split(), random.Random(3)
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(200), 3 + i % 9):
            words[at] = f"w{i}x{at}"
        rows.append((i, " ".join(words)))
    parent = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(i):
                if similarity(rows[i][1], rows[j][1]) >= 0.8:
                    parent[i] = parent[j] = min(parent[i], parent[j])
    got = {r.doc_id for r in S.one_of_each(documents(rows), chunk=5).collect()}
    assert got == set(parent) and len(got) > 1


def test_messy_rows(messy, clashing, spark):
    docs = clashing(messy)
    got = S.one_of_each(docs)
    assert got.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect())
    assert len([x for x in ids if not x[2].strip()]) == 1
    assert len({x[1] for x in ids if x[1] in (1, 2)}) == 1
    assert S.one_of_each(docs.limit(0)).count() == 0
