"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document's size is its number of words (``[^\\x20\\x09-\\x0D]+``; null text: 0).
Sources, ordered by code point with null last, weigh ``weights`` in turn and
share ``share`` times the size of all documents; no target exceeds ``cap``
times its source's size, the excess going to the others by weight until none
is above (water filling).

A document may belong to several sources (an array column); documents with the
same set of sources, a membership pattern, are one node. The flow runs from a
pattern to each of its sources and from a source to the sink, up to its target.
A pattern offers its size ``cap`` times, each pass dearer than the one before
(pass k costs ``2k - 1`` a word), so fresh words go first and repeats are spread
over patterns. Successive shortest paths give the least-cost greatest flow.
The table of patterns is the only thing the driver holds; its size is checked.

Then per pattern, its flow ``F`` of size ``S`` takes every document
``F // S`` times and, of the rest ``F % S``, documents in seeded order while the
words taken before them are fewer, the last only if that comes nearer: a source
gets its target to within half its largest document. The seeded order is that of two 63-bit hashes (of the id, and of id
and text); the cut in it is found by histograms of 9 bits at a time, over the
documents still in question, without sorting or collecting any pattern.

Nulls: a null text has size 0; a null source is a source of its own (last),
a null array of sources none (such a document is never taken); a
null id takes part (its hash is that of ``null``). Equal rows fall on the same
place of the order and are taken alike. Empty texts are taken 0 words. An empty
table gives no rows. Extra columns are ignored. Reruns give the same result.
"""

from __future__ import annotations

from collections import deque
from itertools import cycle

from pyspark.sql import Column, DataFrame, functions as F

from logharvest.llm.common import SPACES, row_key, whole
from logharvest.session import stored

# Fixed values of the mixing contract.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 42
MAX_PATTERNS = 2_000
BITS = 9
HASH_BITS = 63


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict:
    """Target per source: a weighted share of ``share`` times all sizes, none above ``cap`` times its own."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, cycle(weights), strict=False))
    budget = share * sum(sizes.values())
    fixed, free = {}, set(names)
    while True:
        left = budget - sum(fixed.values())
        total = sum(weight[s] for s in free)
        over = {s for s in free if total and left * weight[s] / total > cap * sizes[s]}
        if not over:
            return fixed | {s: (left * weight[s] / total if total else 0.0) for s in free}
        for s in over:
            fixed[s] = cap * sizes[s]
        free -= over


def min_cost_flow(arcs: list[tuple[int, int, int, int]], source: int, sink: int, n: int) -> list[int]:
    """Flow per arc (``(from, to, capacity, cost)``) of the greatest flow of least cost.

    Successive shortest paths (Bellman-Ford with a queue) over the residual graph; arcs
    have costs of 0 and more, so no negative cycle arises.
    """
    graph = [[] for _ in range(n)]
    cap, cost, to = [], [], []
    for a, b, c, w in arcs:
        for x, y, cc, ww in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(cc)
            cost.append(ww)
    while True:
        dist, via, queued = [None] * n, [None] * n, [False] * n
        dist[source], waiting = 0, deque([source])
        while waiting:
            x = waiting.popleft()
            queued[x] = False
            for e in graph[x]:
                if cap[e] > 0 and (dist[to[e]] is None or dist[x] + cost[e] < dist[to[e]]):
                    dist[to[e]], via[to[e]] = dist[x] + cost[e], e
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        waiting.append(to[e])
        if dist[sink] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        push, x = None, sink
        while x != source:
            e = via[x]
            push = cap[e] if push is None else min(push, cap[e])
            x = to[e ^ 1]
        x = sink
        while x != source:
            e = via[x]
            cap[e] -= push
            cap[e ^ 1] += push
            x = to[e ^ 1]


def _memberships(docs: DataFrame, source: str) -> Column:
    kind = docs.schema[source].dataType.simpleString()
    col = F.col(source)
    if kind.startswith("array"):
        return F.array_sort(F.array_distinct(F.coalesce(col, F.array().cast(kind))))
    return F.array(col.cast("string"))


def plan(patterns: list[tuple[list, int]], sizes: dict, goal: dict, cap: float = CAP) -> dict[int, int]:
    """Flow into each pattern (by index) of ``patterns`` (members, size)."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    at = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    sink, arcs, into = 1 + len(patterns) + len(names), [], {}
    passes = int(cap)
    for i, (members, size) in enumerate(patterns):
        into[i] = []
        for k in range(passes):
            into[i].append(len(arcs))
            arcs.append((0, 1 + i, size, 2 * k + 1))
        part = round((cap - passes) * size)
        if part:
            into[i].append(len(arcs))
            arcs.append((0, 1 + i, part, 2 * passes + 1))
        for s in members:
            arcs.append((1 + i, at[s], passes * size + part, 0))
    for s in names:
        arcs.append((at[s], sink, round(goal[s]), 0))
    flow = min_cost_flow(arcs, 0, sink, sink + 1)
    return {i: sum(flow[a] for a in into[i]) for i in into}


def _order(docs: DataFrame) -> list[Column]:
    key = row_key()
    mask = F.lit(0x7FFFFFFFFFFFFFFF)
    u = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(SEED)).bitwiseAND(mask)
    kh = F.xxhash64(key["a"], key["b"], F.lit(SEED)).bitwiseAND(mask)
    return [u.alias("u"), kh.alias("kh")]


def _prefix(level: int) -> tuple[Column, Column]:
    """The first ``BITS * level`` bits of (u, kh), as two numbers."""
    lu, lk = min(BITS * level, HASH_BITS), max(BITS * level - HASH_BITS, 0)
    pu = F.shiftright("u", HASH_BITS - lu) if lu else F.lit(0).cast("long")
    pk = F.shiftright("kh", HASH_BITS - lk) if lk else F.lit(0).cast("long")
    return pu, pk


def cuts(d: DataFrame, need: dict[str, int]) -> dict[str, tuple[int, int, int] | None]:
    """Per pattern key: the last place taken, as (level, prefix of u, prefix of kh); None: take none.

    ``d``: ``(pkey, u, kh, size)``. Documents are taken in order of (u, kh)
    while the words before them are fewer than ``need``, the last one only if
    that lands nearer ``need``. Rounds look at 9 more
    bits of the bin that holds the last document taken, until that bin holds
    one document or all 126 bits are read (equal rows, taken alike).
    """
    spark = d.sparkSession
    state = {p: (0, 0, 0) for p, n in need.items() if n > 0}  # before, pu, pk at the current level
    done = {p: None for p, n in need.items() if n <= 0}
    level = 0
    while state:
        active = spark.createDataFrame([(p, pu, pk) for p, (_, pu, pk) in state.items()], "pkey string, apu long, apk long")
        pu, pk = _prefix(level)
        nu, nk = _prefix(level + 1)
        bin_ = (nk if level + 1 > HASH_BITS // BITS else nu).bitwiseAND(F.lit((1 << BITS) - 1))
        rows = (
            d.join(F.broadcast(active), "pkey")
            .where((pu == F.col("apu")) & (pk == F.col("apk")))
            .groupBy("pkey", bin_.alias("bin"))
            .agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        bins: dict[str, list] = {}
        for r in rows:
            bins.setdefault(r.pkey, []).append((r.bin, r.s, r.n))
        level += 1
        last = level == 2 * HASH_BITS // BITS
        for p, (before, apu, apk) in list(state.items()):
            cum = before
            for b, s, n in sorted(bins.get(p, [])):
                if cum < need[p] <= cum + s:
                    upper = level > HASH_BITS // BITS
                    npu, npk = (apu, (apk << BITS) | b) if upper else ((apu << BITS) | b, 0)
                    if n == 1 or last:
                        # The last one (or equal rows) only if that lands nearer the need.
                        nearer = need[p] - cum >= cum + s - need[p]
                        done[p] = (level, npu, npk) if nearer else (level, npu - (not upper), npk - upper)
                        del state[p]
                    else:
                        state[p] = (cum, npu, npk)
                    break
                cum += s
            else:
                done[p] = (0, 1, 0)  # fewer words than needed: all
                del state[p]
    return done


def mix(docs: DataFrame, source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, dict]:
    """Per row ``(doc_id, members, size, taken)``, and per source ``(size, target)``."""
    size = F.regexp_count(whole("text"), F.lit(SPACES.replace("[", "[^") + "+")).cast("long")
    d = docs.select(F.col("doc_id"), _memberships(docs, source).alias("members"), size.alias("size"), *_order(docs))
    d = stored(d.withColumn("pkey", F.to_json("members")), "mix-docs")
    patterns = d.groupBy("pkey").agg(F.first("members").alias("members"), F.sum("size").alias("size"))
    if patterns.count() > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found = [(r.pkey, list(r.members), int(r.size)) for r in patterns.collect()]
    sizes: dict = {}
    for _, members, s in found:
        for m in members:
            sizes[m] = sizes.get(m, 0) + s
    goal = targets(sizes, weights, share, cap)
    flow = plan([(m, s) for _, m, s in found], sizes, goal, cap)
    whole_passes = {k: (flow[i] // s if s else 0) for i, (k, _, s) in enumerate(found)}
    need = {k: flow[i] - whole_passes[k] * s for i, (k, _, s) in enumerate(found)}
    cut = cuts(d, need)
    rows = [
        (k, whole_passes[k], *(cut[k] if cut.get(k) else (0, -1, 0)), cut.get(k) is not None)
        for k, _, _ in found
    ]
    table = d.sparkSession.createDataFrame(rows, "pkey string, passes long, level int, cpu long, cpk long, some boolean")
    # The first BITS * level bits of (u, kh), per row's own pattern.
    pu = F.expr(f"shiftright(u, {HASH_BITS} - least(level * {BITS}, {HASH_BITS}))")
    pk = F.expr(f"shiftright(kh, {HASH_BITS} - greatest(level * {BITS} - {HASH_BITS}, 0))")
    pk = F.when(F.col("level") * BITS > HASH_BITS, pk).otherwise(F.lit(0))
    inside = F.col("some") & ((pu < F.col("cpu")) | ((pu == F.col("cpu")) & (pk <= F.col("cpk"))))
    taken = F.col("size") * (F.col("passes") + inside.cast("long"))
    out = d.join(F.broadcast(table), "pkey").select("doc_id", "members", "size", taken.alias("taken"))
    return out, {s: (sizes[s], goal[s]) for s in sizes}


def mixed(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for documents of one source each."""
    out, per = mix(docs)
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(s, int(a), float(t)) for s, (a, t) in per.items()], "src string, source_size long, target double"
    )
    return out.join(F.broadcast(table), F.get("members", 0).eqNullSafe(F.col("src"))).select(
        "doc_id", "size", "source_size", "target", "taken"
    )
