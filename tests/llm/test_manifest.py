from __future__ import annotations

import hashlib
import zlib

from pathlib import Path

import pytest

from logharvest.llm import manifest as M
from logharvest.session import shared_folder

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    if v is None:
        return "-"
    v = v if isinstance(v, str) else str(v)
    return f"{len(v.encode())}:{v}"


def leaf(r, plus=0):
    n = None if r[3] is None else r[3] + plus
    return H(enc(r[0]), enc(r[1]), enc(r[2]), enc(n), enc(r[4]))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        cur = out[-1]
        out.append([H(*cur[i : i + 2]) for i in range(0, len(cur), 2)])
    return out


def steps(lv, i):
    path = []
    for level in lv[:-1]:
        path.append((level[i ^ 1] if i ^ 1 < len(level) else None, i % 2))
        i //= 2
    return path


def fold(h, path):
    for s, side in path:
        h = H(h) if s is None else (H(h, s) if side == 0 else H(s, h))
    return h


def plain(rows):
    """The manifest built in plain Python, as the contract says."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: levels([leaf(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for g in langs}
    top = levels([subs[g][-1][0] for g in langs])
    root, out = top[-1][0], []
    for gi, g in enumerate(langs):
        for i, r in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            path = steps(subs[g], i) + steps(top, gi)
            t = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = fold(leaf(r, 1 if t else 0), path)
            proof = H(*[s for s, _ in path if s is not None])
            out.append((r[0], leaf(r), subs[g][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def run(spark, rows):
    got = M.audit(spark.createDataFrame(rows, DOCS)).collect()
    return sorted((tuple(r) for r in got), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def test_equals_plain_build_with_odd_runs_and_many_groups(spark):
    rows = [(i, f"s{i % 3}", ["en", "fr", "de", None, "é"][i % 5], i * 3, "word " * (i % 4)) for i in range(1, 140)]
    assert run(spark, rows) == plain(rows)


def test_nulls_repeats_empty_and_long_texts(spark):
    rows = [
        (None, None, None, None, None),
        (5, "a", "en", None, ""),
        (5, "a", "en", None, ""),
        (5, "b", "en", 3, "x" * 200_000),
        (7, "a", "en", 1, "é"),
        (14, None, "zz", 2, "\n\n"),
    ]
    assert run(spark, rows) == plain(rows)


def test_single_leaf_is_its_own_root(spark):
    rows = [(1, "a", "en", 1, "x")]
    (r,) = run(spark, rows)
    assert r[1] == r[2] == r[3]
    assert r[4] == H()


def test_tampered_rows_fail_and_others_verify(spark):
    rows = [(i, "s", "en", 10, "t") for i in range(60)]
    got = run(spark, rows)
    for r in got:
        assert r[6] == (zlib.crc32(str(r[0]).encode()) % 7 != 0)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a", "en", 1, "x", 9, 8)], DOCS + ", g long, h long")
    assert M.audit(df).count() == 1


@pytest.mark.parametrize("bits", [2, 3])
def test_blocks_of_any_size_make_the_same_tree(spark, monkeypatch, bits):
    monkeypatch.setattr(M, "BLOCK_BITS", bits)
    sizes = {"en": 41, "fr": 1, None: 16, "": 17, "-": 9, "é": 2}
    rows = [(i, "s", lang, i, f"text {i}") for lang, n in sizes.items() for i in range(n)]
    assert run(spark, rows) == plain(rows)


def test_work_files_hold_a_fixed_number_of_bytes_a_leaf(spark):
    """Paths of leaves, some dozen digests each, are not stored."""
    rows = [(i, "s", "en", 10, f"text {i}") for i in range(4000)]
    base = Path(shared_folder(spark).removeprefix("file:"))
    there = set(base.glob("manifest-*"))
    assert run(spark, rows) == plain(rows)
    written = sum(f.stat().st_size for d in set(base.glob("manifest-*")) - there for f in d.glob("part-*"))
    assert written < 500 * len(rows)
