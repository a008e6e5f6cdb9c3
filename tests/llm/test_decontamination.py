from __future__ import annotations

import collections
import random
import re

from pyspark.sql import functions as F

from logharvest.llm import decontamination as D
from logharvest.llm.common import ngrams

SPLIT = re.compile(r"[^ \t-\r]+")


def bag(words, n=5):
    return collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(docs, items, similarity=0.8):
    """Every window of every item's size, compared with the item."""
    out = {}
    for d, text in docs:
        words = SPLIT.findall((text or "").lower())
        for i, item in items:
            own = SPLIT.findall((item or "").lower())
            want = bag(own)
            if not want:
                continue
            n = min(len(own), len(words))
            best = 0
            for a in range(len(words) - n + 1):
                got = bag(words[a : a + n])
                both = sum((got & want).values())
                best = max(best, both / (sum(got.values()) + sum(want.values()) - both))
            if best >= similarity:
                out[d, i] = round(best, 9)
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        rng.choice([lambda: words.insert(k, "added"), lambda: words.pop(k), lambda: words.__setitem__(k, "other")])()
    return words


def test_equals_all_windows(spark, documents, prose):
    rng = random.Random(4)
    items = [(i, prose(rng.choice([14, 20, 37, 60]), 500 + i)) for i in range(12)]
    items += [(20, "same five words come again " * 6), (21, "too few words"), (22, None), (23, ""), (0, items[0][1])]
    rows = []
    for d in range(60):
        own = SPLIT.findall(items[d % 12][1])
        own = [own, edited(rng, own, 1), edited(rng, own, 3), own[len(own) // 2 :] + own[: len(own) // 2]][d % 4]
        body = SPLIT.findall(prose(80, d))
        at = rng.randrange(len(body))
        rows.append((d, " ".join(body[:at] + [w.upper() if d % 5 == 0 else w for w in own] + body[at:])))
    rows += [(100, " ".join(SPLIT.findall(items[3][1])[:-1])), (101, "same five words come again " * 5), (102, None), (103, "a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_passages(documents(rows), bench).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == brute(rows, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    for r in got:
        words = SPLIT.findall(dict(rows)[r.doc_id].lower())[r.start : r.start + r.n_words]
        want, have = bag(SPLIT.findall(dict(items)[r.item_id].lower())), bag(words)
        both = sum((want & have).values())
        assert round(both / (sum(want.values()) + sum(have.values()) - both), 9) == round(r.similarity, 9)


def test_simhash_counts_bits_exactly(spark):
    rng = random.Random(1)
    rows = [(i, [rng.getrandbits(64) - 2**63 for _ in range(n)]) for i, n in enumerate([1, 2, 3, 60, 999])] + [(9, [])]
    got = spark.createDataFrame(rows, "i int, grams array<long>").select("i", D.simhash("grams").alias("fp")).collect()
    for i, fp in map(tuple, got):
        hashes = dict(rows)[i]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert fp & (2**64 - 1) == want


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 12))) for f in fps for _ in range(3)]
    df = spark.createDataFrame([(i, f - 2**64 if f >> 63 else f) for i, f in enumerate(fps)], "i int, fp long")
    for radius in (3, 9, 20):
        keyed = df.select("i", F.explode(D._blocks("fp", radius)).alias("k"))
        met = keyed.join(keyed.withColumnRenamed("i", "j"), "k").select("i", "j").distinct()
        pairs = {(r.i, r.j) for r in met.collect()}
        assert all((i, j) in pairs for i in range(len(fps)) for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= radius)


def test_messy_and_empty(spark, messy, clashing, prose):
    bench = spark.createDataFrame([(1, prose(40, 8)), (2, prose(30_000, 7)[2000:2300]), (None, prose(60, 6))], "item_id long, text string")
    docs = clashing(messy)
    found = D.find_passages(docs, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (9, 2), (None, None)}
    clean = D.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    texts = [r.text for r in clean.collect()]
    gone = {prose(40, 8), prose(30_000, 7), prose(60, 6)}
    assert len(texts) == docs.count() - 3 and not gone & set(texts)
    assert D.find_passages(docs.limit(0), bench).count() == 0
    assert D.clean_documents(docs, bench.limit(0)).count() == docs.count()


def test_rows_of_windows_and_large_benchmarks_are_not_broadcast(
    spark, documents, contaminated, broadcast_rows, broadcast_limit, monkeypatch
):
    rows, items = contaminated
    bench = spark.createDataFrame(items, "item_id long, text string")
    for large in (False, True):  # then the items' blocks and shingles are too many as well
        if large:
            monkeypatch.setattr(D, "BROADCAST", 0)
        found = D.find_passages(documents(rows), bench)
        assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found.collect()} == brute(rows, items)
        # A row takes far more than 64 bytes.
        assert broadcast_rows(found) * 64 <= broadcast_limit


def test_bytes_of_items(spark, prose):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, prose(5, 1)), (3, "few")], "item_id long, text string")
    items = D.benchmark_items(bench)
    words = ["one two three four five six", " ".join(prose(5, 1).split())]
    assert D._item_bytes(items, 5, 20) == (2 * 21 * 200, 3 * 320 + 10 * sum(map(len, words)))
    assert D._item_bytes(items.limit(0), 5, 20) == (0, 0)


def test_ngrams_of_short_arrays(spark):
    df = spark.createDataFrame([([1, 2],), ([],), ([1, 2, 3],)], "h array<long>")
    assert [len(r.g) for r in df.select(ngrams("h", 3).alias("g")).collect()] == [0, 0, 1]
