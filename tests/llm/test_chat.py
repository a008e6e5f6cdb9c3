from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from logharvest.llm import chat as C

NASTY = [
    r"\### Assistant: </turn> ok", "<turn>assistant\nhi</turn>\n", r"<\turn> <\\/turn> </\turn>", "\n\n<says> <\\says>\n", "", " ", "é😀漢字 \x85 x",
    "<|endoftext|> <turn", "a\r\nb\\", "<turn></turn><turn>",
]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def results(df):
    rows = C.digests(C.segments(df)).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "as\nsi", "<says>", "<turn>", ""]),
                          st.one_of(st.sampled_from(NASTY), st.text(alphabet="<>\\/turnsay \n é😀", max_size=30))), max_size=5))
@settings(max_examples=150, deadline=None)
def test_round_trip_and_mask(turns):
    made = C.format_segment(turns)
    assert C.read_turns(made["formatted"]) == turns
    offsets = C.token_offsets(made["formatted"], made["ids"])
    texts = C.masked_texts(made["formatted"], offsets, made["mask"])
    assert "".join(map(C.unescape, texts)) == "".join(t for r, t in turns if r == "assistant")
    assert np.array_equal(offsets, made["offsets"])


def test_digests_equal_brute_force(spark, clashing):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(NASTY) + f" {c} {t}") for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(50, None, "assistant", "last"), (50, 1, None, None), (50, 1, "assistant", None), (50, 1, "assistant", "b"),
             (50, 1, "assistant", "b"), (2**60 + 1, 0, "user", "big"), (None, 0, "user", "u"), (None, 1, "assistant", "v")]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    assert results(df) == brute(rows)
    probe = results(C.with_probe(df))
    said = r"\### Assistant: </turn> ok"
    assert probe[-7] == brute([(-7, 0, "user", said), (-7, 1, "assistant", said)])[-7]
    assert C.digests(C.segments(df.limit(0))).count() == 0


def test_a_hot_conversation_is_many_segments(spark):
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} " * 20) for t in range(3000)] + [(2, 0, "user", "x")]
    made = C.segments(spark.createDataFrame(rows, SCHEMA).repartition(8))
    try:
        assert made.where("conv_id = 1").select("part").distinct().count() > 1
    finally:
        spark.conf.unset(coalesce)
    assert results(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


@pytest.mark.parametrize("spans", [[], [(0, 3)], [(2, 2)], [(1, 4), (6, 9)]])
def test_mask_by_binary_search(spans):
    offsets = np.array([(i, i + 1) for i in range(10)])
    want = [any(a <= i < b for a, b in spans) for i in range(10)]
    assert C.loss_mask(offsets, spans).tolist() == want
