from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from logharvest.llm import simhash_pivots as S
from logharvest.llm.components import connected_components


def brute_fingerprint(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[ \t-\r]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Union(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def brute_components(prints, radius=4):
    u = Union()
    for a in prints:
        u.root(a)
        for b in prints:
            if (a ^ b).bit_count() <= radius:
                u.join(a, b)
    return {p: u.root(p) for p in prints}


def test_fingerprint_equals_brute_force(messy, prose):
    texts = [r.text for r in messy.collect() if len(r.text or "") < 30_000] + [prose(n, n) for n in (1, 3, 4, 5, 200)]
    for t in [*texts, "Ünder SCORE ÀB c\x85d"]:
        assert S.fingerprint(t) == brute_fingerprint(t)


def family(rng, n, chains=6):
    """Fingerprints in chains and clouds around some centres, and far ones."""
    out = [0]
    for _ in range(chains):
        x = rng.getrandbits(64)
        for _ in range(n):
            out.append(x)
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                x ^= 1 << bit
    return list(dict.fromkeys(out + [rng.getrandbits(64) for _ in range(n)]))


@pytest.mark.parametrize("chunk", [2048, 6])
def test_components_over_links_equal_all_pairs(spark, chunk):
    prints = family(random.Random(chunk), 40)
    cloud = random.Random(9).getrandbits(64)
    prints += [cloud ^ (1 << i) for i in range(60)]  # one crowded bucket
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    df = spark.createDataFrame([(p,) for p in dict.fromkeys(signed)], "fp long")
    links = S.link_fingerprints(df, chunk=chunk).collect()
    u = Union()
    for a, b in ((x.a & (2**64 - 1), x.b & (2**64 - 1)) for x in links):
        assert (a ^ b).bit_count() <= 4
        u.join(a, b)
    assert {p: u.root(p) for p in prints} == brute_components(prints)


def test_near_duplicates_and_one_of_each(messy, clashing, documents, prose):
    base = prose(600, 3)
    near = base.replace(base.split()[300], "changed", 1)
    docs = messy.unionByName(documents([(30, base), (31, near), (29, base.upper()), (40, prose(50, 44))]))
    rows = docs.collect()
    got = S.near_duplicates(clashing(docs), chunk=4).collect()
    assert len(got) == len(rows)
    parts = brute_components(list({brute_fingerprint(r.text) for r in rows}))
    names = {}
    for r in rows:
        c = parts[brute_fingerprint(r.text)]
        if r.doc_id is not None:
            names[c] = min(names.get(c, r.doc_id), r.doc_id)
    for r in got:
        c = parts[int(r.fingerprint, 16)]
        assert r.component_id == names.get(c)
    kept = S.one_of_each(clashing(docs))
    assert kept.columns == clashing(docs).columns
    left = kept.collect()
    assert len(left) == len({parts[brute_fingerprint(r.text)] for r in rows})
    assert 29 in {r.doc_id for r in left} and 31 not in {r.doc_id for r in left}


def test_components_of_long_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(500)]
    star = [(1000, 1001 + i) for i in range(500)] + [(5000, None), (7000, 7000), (1001, 1000)]
    df = spark.createDataFrame(chain + star, "a long, b long")
    got = dict(map(tuple, connected_components(df).collect()))
    assert got == {i: 0 for i in range(501)} | {1000 + i: 1000 for i in range(501)}
    assert connected_components(df.limit(0)).count() == 0
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
