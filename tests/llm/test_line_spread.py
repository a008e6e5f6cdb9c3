from __future__ import annotations

import collections

from pyspark.sql import functions as F

from logharvest.llm import line_spread as L


def brute(rows, min_sites=3, min_words=3):
    ws = " \t\n\x0b\f\r"
    sites, first = collections.defaultdict(set), {}
    big = 1 << 62
    for i, text, site in rows:
        for line in (text or "").split("\n"):
            h = line.strip(ws)
            if len(h.split()) >= min_words:
                sites[h].add(site)
                first[h] = min(first.get(h, big), big if i is None else i)
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None, 0))
            continue
        kept = [x for x in text.split("\n") if not (
            len(sites.get(x.strip(ws), ())) >= min_sites and (big if i is None else i) > first[x.strip(ws)])]
        out.append((i, "\n".join(kept), text.count("\n") + 1 - len(kept)))
    return sorted(out, key=repr)


def run(docs, **options):
    got = L.remove_boilerplate(docs, **options).select("doc_id", "text", "n_lines_removed").collect()
    return sorted(map(tuple, got), key=repr)


def test_equals_brute_force(documents, prose):
    shared = [" ".join(prose(9, 900 + k).split()) for k in range(30)]
    rows = []
    for i in range(240):
        lines = prose(48, i).split("\n")
        for k, line in enumerate(shared):
            if (i * 7 + k * 3) % 11 < 3:
                lines.insert(i % 4, f"  {line}\t" if i % 2 else line)
        rows.append((i, "\n".join([*lines, "a b", ""]), "en", f"site{(i * 13) % (1 + i % 9)}"))
    docs = documents(rows)
    want = brute([(r[0], r[1], r[3]) for r in rows])
    assert run(docs) == want
    assert any(n for *_, n in want)


def test_near_threshold_counts_are_exact_with_many_sites(documents):
    # 99 and 100 sites lie within the sketch's error of one another.
    rows = [(i, "the line of ninety nine\nunique words number %d" % i, "en", f"s{i}") for i in range(99)]
    rows += [(1000 + i, "the line of one hundred\nother words number %d" % i, "en", f"s{i}") for i in range(100)]
    got = run(documents(rows), min_sites=100)
    assert got == brute([(r[0], r[1], r[3]) for r in rows], min_sites=100)
    assert sum(n for *_, n in got) == 99


def test_messy_extra_columns_and_empty(messy, clashing, documents):
    rows = [(r.doc_id, r.text, r.source) for r in messy.collect()]
    docs = clashing(messy)
    got = L.remove_boilerplate(docs, min_sites=2)
    assert got.columns == [*docs.columns, "n_lines_removed"]
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines_removed").collect()), key=repr) == brute(rows, min_sites=2)
    assert L.remove_boilerplate(messy.limit(0)).count() == 0


def test_long_documents_use_masks_beyond_the_first_block(documents, prose):
    line = "a line that every site has"
    long = "\n".join(f"own line number {k}" if k % 70 else line for k in range(400))
    rows = [(1, line, "en", "a"), (2, line, "en", "b"), (3, long, "en", "c")]
    got = run(documents(rows))
    assert got == brute([(r[0], r[1], r[3]) for r in rows])
    assert got[2][2] == 6


def test_sketches_merge_by_aggregation(messy):
    lines = L.hashed_lines(messy, "source")
    halves = [L.line_sites(lines.where(F.col("at") % 2 == k)) for k in (0, 1)]
    merged = halves[0].unionByName(halves[1]).groupBy("h").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
    whole = L.line_sites(lines).select("h", F.hll_sketch_estimate("sketch").alias("n"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
