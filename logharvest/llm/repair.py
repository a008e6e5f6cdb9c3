"""Repair of conversation structure: a generalised LR parse over the role grammar.

Rows of a conversation, by position, should spell the role initials
``(s?(ua)+)?`` (system, then user and assistant taking turns, ending with the
assistant). Edits: keep a row (0), rerole it to user or assistant (1), delete it
(2; the only edit for blank and duplicate rows), insert an empty-text user or
assistant row anywhere (5); a truncated row that is not deleted adds 5. The
cheapest edits win; among equal costs the ASCII-least audit (one letter per
edit: D, I, K, R, in order).

The grammar is regular, so the parse's stack tops are the states of its
automaton: a graph-structured stack whose tops, at each row, are merged by the
least (cost, audit). Inserts are taken in the gap before each row, or after the
last. Every candidate audit at a row then ends with that row's letter and
covers the same rows, so no candidate is a proper prefix of another: the least
audit of a merge stays least whatever follows, and the merge is exact.

At scale no conversation is one task: rows get dense positions by a range
partitioning (``manifest.positions``), and a conversation is cut into chunks of
``CHUNK`` rows. Each chunk is parsed from all four states at once and keeps,
per (start, end) state, the cost and the rank of its audit among the chunk's
audits. A conversation's chunks then fold in order with four tops that hold a
cost and the rank of their audit among the tops, so the fold keeps a few
numbers per chunk. The chosen chunks are parsed again to write their audits and
repaired rows. What stays whole per conversation is only the output: its audit
and the SHA-256 of its repaired text, which is sequential.

Faults (of the rows after damage, in position order; each row's first fault):
blank (no character other than space and 0x09-0x0D), duplicate (role and text
seen earlier in the conversation), truncated (last such character not ``.!?``).
``illegal`` counts adjacent pairs of role initials other than ``su``, ``ua``,
``au``. ``gaps``: ``max - min + 1 - distinct`` of the turns that are not null.

Nulls: a null role or text is one space; a null turn sorts first; a null
conversation id is a conversation of its own. Ties of turn sort by role, text,
then copy. Repeated rows are rows like any other (the second a duplicate). An
empty table gives no rows; a conversation with no rows left gives zeros, an
empty audit and the SHA-256 of the empty text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from logharvest.llm.manifest import positions
from logharvest.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1024

# Fixed values of the contract: edit costs, damage codes, fault characters.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
DAMAGE = 20  # crc32(conv_id:turn) % 20: 0 drop, 1 empty text, 2 no .!?, 3 repeated, 4 role user
LEGAL = ("su", "ua", "au")

# The automaton of (s?(ua)+)?: 0 start, 1 after s, 2 after u, 3 after a.
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}  # the one of user, assistant that each state takes
ROLE = {"u": "user", "a": "assistant"}
ACCEPT = {0: "", 1: "II", 2: "I", 3: ""}  # inserts that end the parse after a state
SPACE = " \t\n\x0b\x0c\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage: ``cnull, cid, turn, role, text, copy`` (nulls as one space)."""
    c = conversations.select(
        F.col("conv_id").isNull().alias("cnull"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("cid"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.concat(
            F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
        ).alias("key"),
    )
    d = F.crc32("key") % DAMAGE
    return c.where(d != 0).select(
        "cnull",
        "cid",
        "turn",
        F.when(d == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(d == 1, F.lit("")).when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _fault(text: str, duplicate: bool) -> str:
    body = text.rstrip(SPACE)
    if not body.strip(SPACE):
        return "blank"
    if duplicate:
        return "duplicate"
    return "" if body[-1] in ".!?" else "truncated"


def _better(tops: dict, state: int, cost: int, audit: str, extra=None) -> bool:
    old = tops.get(state)
    if old is None or (cost, audit) < old[:2]:
        tops[state] = (cost, audit, extra)
        return True
    return False


def _closure(tops: dict) -> dict:
    """Inserts in one gap, to a fixed point (each costs more than nothing)."""
    changed = True
    while changed:
        changed = False
        for q, (cost, audit, _) in list(tops.items()):
            changed |= _better(tops, STEP[q][NEXT[q]], cost + INSERT, audit + "I")
    return tops


def parse(rows: list[tuple[str, str]], start: int) -> dict[int, tuple[int, str]]:
    """End state -> (least cost, least audit) of ``rows`` ((initial, fault)) from ``start``."""
    tops = {start: (0, "", None)}
    for initial, fault in rows:
        tops, here = {}, _closure(tops)
        for q, (cost, audit, _) in here.items():
            _better(tops, q, cost + DELETE, audit + "D")
            if fault in ("blank", "duplicate"):
                continue
            extra = TRUNCATED if fault == "truncated" else 0
            if initial in STEP[q]:
                _better(tops, STEP[q][initial], cost + KEEP + extra, audit + "K")
            if NEXT[q] != initial:
                _better(tops, STEP[q][NEXT[q]], cost + REROLE + extra, audit + "R")
    return {q: (cost, audit) for q, (cost, audit, _) in tops.items()}


def rebuilt(roles: list[str], texts: list[str], audit: str, start: int) -> list[str]:
    """Repaired ``role:text`` lines that ``audit`` makes of the rows from state ``start``."""
    out, q, i = [], start, 0
    for letter in audit:
        if letter == "I":
            out.append(ROLE[NEXT[q]] + ":")
            q = STEP[q][NEXT[q]]
            continue
        role, text = roles[i], texts[i]
        i += 1
        if letter == "K":
            out.append(f"{role}:{text}")
            q = STEP[q][role[:1]]
        elif letter == "R":
            out.append(f"{ROLE[NEXT[q]]}:{text}")
            q = STEP[q][NEXT[q]]
    return out


def _chunk_rows(pdf: pd.DataFrame) -> list[tuple[str, str]]:
    pdf = pdf.sort_values("pos")
    return [(r[:1], _fault(t, bool(d))) for r, t, d in zip(pdf["role"], pdf["text"], pdf["dup"], strict=True)]


_SUMMARY = (
    "cnull boolean, cid long, chunk long, costs array<long>, ranks array<long>, "
    "blank long, duplicate long, truncated long, illegal long, first string, last string"
)


def _summarise(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per chunk: 16 costs and audit ranks (start x end state, null: unreachable) and fault counts."""
    pdf = pdf.sort_values("pos")
    rows = _chunk_rows(pdf)
    found = {(p, q): v for p in STEP for q, v in parse(rows, p).items()}
    order = {a: k for k, a in enumerate(sorted({a for _, a in found.values()}))}
    costs = [found[(p, q)][0] if (p, q) in found else None for p in STEP for q in STEP]
    ranks = [order[found[(p, q)][1]] if (p, q) in found else None for p in STEP for q in STEP]
    initials = [r[:1] for r in pdf["role"]]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    faults = [f for _, f in rows]
    return pd.DataFrame(
        [[pdf["cnull"].iloc[0], pdf["cid"].iloc[0], pdf["chunk"].iloc[0], costs, ranks,
          faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, initials[0], initials[-1]]],
        columns=["cnull", "cid", "chunk", "costs", "ranks", "blank", "duplicate", "truncated", "illegal", "first", "last"],
    )


_CHOSEN = "cnull boolean, cid long, chunk long, start int, finish int, cost long, tail string"


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per conversation: the chunks' (start, end) states of the least repair, its cost and closing inserts.

    Tops: state -> (cost, rank of its audit among the tops). Audits of two tops
    differ at the first chunk where their parses differ, so (rank of the top
    before, rank in the chunk) orders the new ones.
    """
    pdf = pdf.sort_values("chunk")
    tops, back = {0: (0, 0)}, []
    for costs, ranks in zip(pdf["costs"], pdf["ranks"], strict=True):
        best = {}
        for r, (cost, order) in tops.items():
            for q in STEP:
                c = costs[4 * r + q]
                if c is not None and not pd.isna(c):
                    key = (cost + int(c), order, int(ranks[4 * r + q]))
                    if q not in best or key < best[q][0]:
                        best[q] = (key, r)
        orders = {q: k for k, q in enumerate(sorted(best, key=lambda q: best[q][0][1:]))}
        tops = {q: (key[0], orders[q]) for q, (key, _) in best.items()}
        back.append({q: r for q, (_, r) in best.items()})
    # After the last row: inserts to an accepting state; audits differ before them.
    last = min(tops, key=lambda q: (tops[q][0] + INSERT * len(ACCEPT[q]), tops[q][1]))
    cost, tail = tops[last][0] + INSERT * len(ACCEPT[last]), ACCEPT[last]
    chosen, q = [], last
    for k in reversed(range(len(back))):
        chosen.append((k, back[k][q], q))
        q = back[k][q]
    cnull, cid = pdf["cnull"].iloc[0], pdf["cid"].iloc[0]
    return pd.DataFrame(
        [(cnull, cid, pdf["chunk"].iloc[k], p, e, cost, tail) for k, p, e in reversed(chosen)],
        columns=["cnull", "cid", "chunk", "start", "finish", "cost", "tail"],
    )


def _write(pdf: pd.DataFrame) -> pd.DataFrame:
    """A chunk's audit and repaired lines for its chosen start and end states."""
    pdf = pdf.sort_values("pos")
    start, finish = int(pdf["start"].iloc[0]), int(pdf["finish"].iloc[0])
    audit = parse(_chunk_rows(pdf), start)[finish][1]
    lines = rebuilt(list(pdf["role"]), list(pdf["text"]), audit, start)
    return pd.DataFrame(
        [(pdf["cnull"].iloc[0], pdf["cid"].iloc[0], pdf["chunk"].iloc[0], audit, lines)],
        columns=["cnull", "cid", "chunk", "audit", "lines"],
    )


def repair(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per original conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired``."""
    rows = damaged(conversations).withColumn("g", F.struct("cnull", "cid"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("copy").asc()]
    placed = positions(rows, order)
    # Duplicates: a later row of a (conversation, role, text); the first is one row per key.
    firsts = placed.groupBy("cnull", "cid", "role", "text").agg(F.min("pos").alias("first_pos"))
    keyed = placed.join(firsts, ["cnull", "cid", "role", "text"]).select(
        "cnull", "cid", "turn", "role", "text", "pos", (F.col("pos") > F.col("first_pos")).alias("dup"),
        F.floor(F.col("pos") / chunk).cast("long").alias("chunk"),
    )
    keyed = stored(keyed, "repair-rows")
    summaries = stored(keyed.groupBy("cnull", "cid", "chunk").applyInPandas(_summarise, _SUMMARY), "repair-chunks")
    chosen = stored(summaries.groupBy("cnull", "cid").applyInPandas(_fold, _CHOSEN), "repair-chosen")
    pieces = (
        keyed.join(chosen.drop("cost", "tail"), ["cnull", "cid", "chunk"])
        .groupBy("cnull", "cid", "chunk")
        .applyInPandas(_write, "cnull boolean, cid long, chunk long, audit string, lines array<string>")
    )
    # Pairs of initials across chunk borders.
    nxt = summaries.select("cnull", "cid", (F.col("chunk") - 1).alias("chunk"), F.col("first").alias("next_first"))
    borders = summaries.join(nxt, ["cnull", "cid", "chunk"]).groupBy("cnull", "cid").agg(
        F.sum((~F.concat("last", "next_first").isin(*LEGAL)).cast("long")).alias("border_illegal")
    )
    counts = summaries.groupBy("cnull", "cid").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    gaps = keyed.groupBy("cnull", "cid").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    )
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "audit", "lines")))
    written = pieces.groupBy("cnull", "cid").agg(ordered.alias("pieces")).join(
        chosen.groupBy("cnull", "cid").agg(F.first("cost").alias("cost"), F.first("tail").alias("tail")), ["cnull", "cid"]
    )
    repaired = F.array_join(
        F.concat(F.flatten(F.transform("pieces", lambda p: p["lines"])), _tail_lines(F.col("tail"))), "\n"
    )
    result = written.select(
        "cnull", "cid", "cost",
        F.concat(F.array_join(F.transform("pieces", lambda p: p["audit"]), ""), F.col("tail")).alias("audit"),
        repaired.alias("repaired"),
    )
    every = conversations.select(
        F.col("conv_id").isNull().alias("cnull"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("cid"), "conv_id"
    ).distinct()
    out = every
    for part in (gaps, counts, borders, result):
        out = out.join(part, ["cnull", "cid"], "left")
    zero = F.lit(0).cast("long")
    text = F.coalesce("repaired", F.lit(""))
    return out.select(
        "conv_id",
        F.coalesce("gaps", zero).alias("gaps"),
        *[F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.coalesce("illegal", zero) + F.coalesce("border_illegal", zero)).alias("illegal"),
        F.coalesce("cost", zero).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(text, 256).alias("repaired_sha256"),
        text.alias("repaired"),
    )


def _tail_lines(tail):
    """Lines of the closing inserts: ``II`` after a system row is user then assistant, ``I`` an assistant."""
    return F.when(tail == "II", F.array(F.lit("user:"), F.lit("assistant:"))).when(
        tail == "I", F.array(F.lit("assistant:"))
    ).otherwise(F.array().cast("array<string>"))

