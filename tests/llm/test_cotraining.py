from __future__ import annotations

import random

import numpy as np
import pytest

from logharvest.llm import cotraining as C


N = 1200


@pytest.fixture(scope="module")
def corpus(spark, documents, prose):
    """Low quality shows in the text and, weakly, in the source; toxicity in some words."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(N):
        low, toxic = i % 4 == 0, i % 7 == 0
        words = prose(rng.randint(40, 120), i).split()
        if low:
            words = [w + "###" if k % 3 == 0 else w for k, w in enumerate(words)]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vileword", "nastyword", "vilewords"]))
        source = f"bad{i % 3}" if low and i % 8 == 0 else f"src{i % 5}"
        rows.append((i, " ".join(words), "en", source))
        if i % 3:
            labels.append((i, int(not low), int(toxic)))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_held_out_accuracy(corpus):
    docs, labels, rows = corpus
    got = {r.doc_id: r for r in C.classify(docs, labels, n_exchanged=40).collect()}
    unseen = [i for i in range(N) if i % 3 == 0]
    right = sum(got[i].kept == (i % 4 != 0 and i % 7 != 0) for i in unseen)
    assert right >= 0.96 * len(unseen)
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in got.values())


def test_views_exchange_sure_pseudo_labels(corpus):
    docs, labels, _ = corpus
    model, table = C.train(docs, labels, rounds=1, n_exchanged=25)
    unlabelled = table.join(labels, "doc_id", "left_anti")
    x, y = model.matrix([], [], [])
    sets = [(x, np.array([])), (y, np.array([]))]
    grown = C._exchange(model, "low_quality", unlabelled, sets, 25, 0.6)
    # The metadata view learns from the text view, at most 25 of each class.
    assert 0 < len(grown[1][1]) <= 50 and set(grown[1][1]) <= {0.0, 1.0}
    assert len(grown[0][1]) <= 50


def test_keeps_columns_and_agrees_with_classify(corpus, clashing):
    docs, labels, _ = corpus
    more = clashing(docs)
    kept = C.keep_good(more, labels)
    assert kept.columns == more.columns
    want = {r.doc_id for r in C.classify(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want


def test_messy_labels_and_empty(spark, messy, clashing, corpus):
    docs, labels, _ = corpus
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 0, None), (3, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    both = clashing(messy).select(*docs.columns).unionByName(docs)
    out = C.classify(both, labels.where("doc_id > 20").unionByName(odd)).collect()
    assert len(out) == both.count() and all(r.kept is not None for r in out)
    assert C.classify(docs.limit(0), labels).count() == 0
    none = C.classify(messy, labels.limit(0))
    assert none.count() == none.where("kept AND p_toxic = 0").count() == messy.count()
    one_class = C.classify(docs, labels.where("quality = 1 AND toxic = 0"))
    assert one_class.where("NOT kept").count() == 0


def test_logistic_finds_the_boundary():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    w = C.logistic(x, y, penalty=1e-3)
    assert np.allclose(w, [2, -1, 0.5], atol=0.2)


def test_a_labelled_id_in_many_rows_counts_once(corpus, documents, prose, monkeypatch):
    docs, labels, _ = corpus
    many = documents([(1, prose(60, 5000 + i % 40), "en", f"copy{i % 40}") for i in range(2000)])
    samples = []
    real = C.select_tokens
    monkeypatch.setattr(C, "select_tokens", lambda s, *a: samples.append(s) or real(s, *a))
    model, _ = C.train(docs.unionByName(many), labels, rounds=0)
    assert samples and samples[0].count() == labels.select("doc_id").distinct().count()
    pages = [v for kind, v in model.categories if kind == "source" and v.startswith("copy")]
    assert len(pages) <= 1


def test_copies_teach_once(corpus, monkeypatch):
    docs, labels, _ = corpus
    unlabelled = docs.join(labels, "doc_id", "left_anti")
    copies = docs.sparkSession.range(10_000, 10_030).join(unlabelled.limit(20).drop("doc_id")).withColumnRenamed("id", "doc_id")
    pools, real = [], C._exchange
    monkeypatch.setattr(C, "_exchange", lambda model, target, pool, *rest: pools.append(pool) or real(model, target, pool, *rest))
    C.train(docs.unionByName(copies.select(*docs.columns)), labels, rounds=1, n_exchanged=15, confidence=0.6)
    assert pools and all(p.count() == p.select("f").distinct().count() for p in pools)


def test_rounds_hand_over_different_vectors(corpus):
    docs, labels, _ = corpus
    model, table = C.train(docs, labels, rounds=0)
    pool = table.join(labels, "doc_id", "left_anti").select("f").distinct()
    x, y = model.matrix([], [], [])
    taken: set[int] = set()
    C._exchange(model, "low_quality", pool, [(x, np.array([])), (y, np.array([]))], 10, 0.6, taken)
    first = set(taken)
    C._exchange(model, "low_quality", pool, [(x, np.array([])), (y, np.array([]))], 10, 0.6, taken)
    assert first and len(taken - first) >= 10
