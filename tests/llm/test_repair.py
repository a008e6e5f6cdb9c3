from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from logharvest.llm import repair as R

CONV = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """Least (cost, audit, lines) over every edit sequence with up to two inserts a gap; rows: (role, text, fault)."""
    gaps = ["", "u", "a", "uu", "ua", "au", "aa"]
    best = None
    choices = []
    for role, text, fault in rows:
        opts = [("D", None, 2)]
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault == "truncated" else 0
            opts += [("K", role, extra), ("R", "user", 1 + extra), ("R", "assistant", 1 + extra)]
        choices.append(opts)
    for acts in itertools.product(*choices):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            audit, roles, lines, cost = "", "", [], 0
            for k in range(len(rows) + 1):
                for x in ins[k]:
                    audit, roles, cost = audit + "I", roles + x, cost + 5
                    lines.append(("user" if x == "u" else "assistant") + ":")
                if k < len(rows):
                    letter, role, c = acts[k]
                    audit, cost = audit + letter, cost + c
                    if role is not None:
                        if letter == "R" and role[:1] == rows[k][0][:1]:
                            break
                        roles += role[:1]
                        lines.append(f"{role}:{rows[k][1]}")
            else:
                if GRAMMAR.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, lines)
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        out.append((role, text, R._fault(text, (role, text) in seen)))
        seen.add((role, text))
    return out


def dp(rows, chunk=None):
    """The operator's parse on whole rows (no chunks)."""
    f = faults(rows)
    cost, audit = min(
        ((c + 5 * len(R.ACCEPT[q]), a + R.ACCEPT[q]) for q, (c, a) in R.parse([(r[:1], x) for r, _, x in f], 0).items())
    )
    return cost, audit


@pytest.mark.parametrize("seed", range(40))
def test_parse_equals_brute_force(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", " "]
    texts = ["Hi.", "ok", "", "  ", "Yes!", "x?"]
    rows = [(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(0, 3))]
    cost, audit, _ = brute(faults(rows))
    assert dp(rows) == (cost, audit)


def plain(conversations):
    """The whole contract in plain Python, one conversation at a time, parse without chunks."""
    by = {}
    for conv_id, turn, role, text in conversations:
        by.setdefault(conv_id, [])
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if d == 0:
            continue
        role = "user" if d == 4 else role
        text = "" if d == 1 else re.sub(r"[.!?]", "", text) if d == 2 else text
        for copy in (0, 1) if d == 3 else (0,):
            by[conv_id].append((turn, role, text, copy))
    out = {}
    for conv_id, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode(), r[3]))
        f = faults([(r[1], r[2]) for r in rows])
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in R.LEGAL for a, b in zip(initials, initials[1:]))
        ends = R.parse([(r[:1], x) for r, _, x in f], 0)
        cost, audit, q = min((c + 5 * len(R.ACCEPT[q]), a + R.ACCEPT[q], q) for q, (c, a) in ends.items())
        lines = R.rebuilt([r[1] for r in rows], [r[2] for r in rows], audit, 0)
        text = "\n".join(lines)
        counts = [sum(x == k for _, _, x in f) for k in ("blank", "duplicate", "truncated")]
        out[conv_id] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(spark, rows, chunk=R.CHUNK):
    df = spark.createDataFrame(rows, CONV)
    res = R.repair(df, chunk=chunk).collect()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in res}


def messy(n_conv, seed, long=0):
    rng = random.Random(seed)
    rows = []
    roles = ["user", "assistant", "system", "tool", None]
    texts = ["Hello there.", "ok", "", "   ", "Sure!", "why?", None, "a.b", "Fine. Thanks."]
    for c in range(n_conv):
        for t in range(rng.randint(0, 7) + (long if c == 0 else 0)):
            rows.append((c if c != 3 else None, t if rng.random() > 0.1 else None, rng.choice(roles), rng.choice(texts)))
    return rows


def test_equals_plain_on_messy_rows(spark):
    rows = messy(40, 1)
    assert got(spark, rows) == plain(rows)


def test_chunks_change_nothing(spark):
    rows = messy(6, 2, long=300)
    whole = plain(rows)
    assert got(spark, rows, chunk=7) == whole
    assert got(spark, rows, chunk=2) == whole


def test_dropped_and_empty(spark):
    # Conversation 9 loses its only row by damage (crc32 of "9:0" % 20 decides); ids stay.
    rows = [(c, 0, "user", "Hi.") for c in range(60)]
    res = got(spark, rows)
    assert set(res) == set(range(60))
    for c, r in res.items():
        if zlib.crc32(f"{c}:0".encode()) % 20 == 0:
            assert r == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(spark, []) == {}


def test_driver_table(spark):
    import pandas as pd

    pdf = pd.read_parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    rows = [(int(a), None if b is None else int(b), c, d) for a, b, c, d in rows]
    assert got(spark, rows) == plain(rows)
