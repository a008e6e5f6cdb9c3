"""Near duplicates by the similarity of their word shingles, for the pipeline.

Two documents link if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more; one document of each component over the links stays.

Documents of equal sets are one node, so copies cost nothing. Nodes meet in
buckets: each of ``BANDS`` bands holds ``ROWS`` least values of the set under
fixed permutations, and two sets of similarity s agree in a band with
probability s ** ROWS. A pair at 0.8 misses all bands 7 times in 100,000, a pair
at 0.9 never in practice. In a bucket, tables of the fingerprints' Hamming
distances to references (``simhash_pivots``) discard pairs more than ``radius``
bits apart. What is left is verified by the exact similarity of the sets (of
64-bit hashes of shingles).

There are two rounds. The first takes, per bucket, a forest over pairs at most
``near`` bits apart; large buckets are dealt into parts, which differ from band
to band. Its verified links join most of what belongs together. The second takes
every pair within the radius whose nodes are not joined yet, so that no link is
lost because the forest held another one that failed.

Nulls: a null text has no words; texts without words are copies of each other,
texts of fewer words than a shingle are one shingle. Null ids come last. Equal
rows give one row. Empty tables give empty results.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from logharvest.llm.common import row_key
from logharvest.llm.components import connected_components
from logharvest.llm.simhash_pivots import references
from logharvest.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
SIMILARITY = 0.8
# Sets of similarity 0.8 differ in 9.7 of 64 bits on average; beyond 20 lie 3 in 10,000.
RADIUS = 20
NEAR = 10
BANDS = 24
ROWS = 5
CHUNK = 2048
_SEED = 42
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    import xxhash

    # bytes.split() cuts at space and 0x09-0x0D, nothing else.
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(shingle, len(words)) - 1
    pairs = zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)
    return np.unique(np.array([digest(joined[a:b], _SEED) for a, b in pairs], dtype=np.uint64))


def fingerprint(grams: np.ndarray) -> int:
    """SimHash of a set of hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(grams), 1 << 14):
        bits = np.unpackbits(grams[at : at + (1 << 14)].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(grams), bitorder="little").view("<u8")[0])


def bands(grams: np.ndarray) -> list[int]:
    """One bucket per band, its number being part of the hash."""
    import xxhash

    if not len(grams):
        return []
    odd = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 1 << 10):
        some = grams[at : at + (1 << 10)]
        least = np.minimum(least, (some[None, :] * odd[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(b.tobytes(), n) for n, b in enumerate(least.reshape(BANDS, ROWS))]


def described(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, key, node, fp, buckets)`` per row; ``node`` is a hash of the set of shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            sets = [shingles(t, shingle) for t in batch.pop("text")]
            yield batch.assign(
                node=np.array([xxhash.xxh64_intdigest(s.tobytes(), _SEED) for s in sets], np.uint64).view(np.int64),
                fp=np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64),
                buckets=[np.array(bands(s), np.uint64).view(np.int64) for s in sets],
            )

    kind = docs.schema["doc_id"].dataType
    # Ids pass pandas as text: beside a null it would make floats of them.
    rows = docs.select(F.col("doc_id").cast("string"), "text", row_key().alias("key"))
    made = rows.select("doc_id", "key.a", "key.b", "text").mapInPandas(
        run, "doc_id string, a bigint, b bigint, node bigint, fp bigint, buckets array<bigint>")
    return made.select(F.col("doc_id").cast(kind), F.struct("a", "b").alias("key"), "node", "fp", "buckets")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(node, grams)`` of the rows named in ``wanted (node, key)``, a row per node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "node": batch["node"], "grams": [shingles(t, shingle).view(np.int64) for t in batch["text"]]})

    rows = docs.select("text", row_key().alias("key")).join(wanted, "key").select("node", "text")
    return rows.mapInPandas(run, "node bigint, grams array<bigint>").dropDuplicates(["node"])


def _near(fa, fb, ca, cb, radius: int, same: bool, forest: bool) -> Iterator[tuple[int, np.ndarray]]:
    """``(i, j)``: partners of row i of one side in the other, of another component and within the radius.

    With ``forest`` (one side only), a pair found joins its components.
    """
    refs = references()
    order_a, order_b = (np.argsort(np.bitwise_count(x ^ refs[0]), kind="stable") for x in (fa, fb))
    a, b, ca, cb = fa[order_a], fb[order_b], ca[order_a].copy(), cb[order_b].copy()
    if forest:
        ca = cb
    table_a, table_b = (np.bitwise_count(x[:, None] ^ refs).astype(np.int8) for x in (a, b))
    low = np.searchsorted(table_b[:, 0], table_a[:, 0] - radius, "left")
    high = np.searchsorted(table_b[:, 0], table_a[:, 0] + radius, "right")
    for i in range(len(a)):
        first = max(low[i], i + 1) if same else low[i]
        at = first + np.flatnonzero(cb[first : high[i]] != ca[i])
        for k in range(1, len(refs), 6):  # a few references at a time: most pairs go at once
            if not len(at):
                break
            part = table_b[at, k : k + 6] - table_a[i, k : k + 6]
            at = at[np.abs(part).max(axis=1, initial=0) <= radius]
        at = at[np.bitwise_count(b[at] ^ a[i]) <= radius]
        if not len(at):
            continue
        if forest:
            joined, one = np.unique(cb[at], return_index=True)
            at = at[one]
            cb[np.isin(cb, joined)] = ca[i]
        yield int(order_a[i]), order_b[at]


def _candidates(work: DataFrame, radius: int, forest: bool) -> DataFrame:
    """Pairs ``(a, b)`` of nodes from ``work (bucket, i, j, side, node, fp, component)``, group by group."""
    names = ["bucket", "i", "j"]

    def group(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        node, fp, comp, side = (part[c].to_numpy() for c in ("node", "fp", "component", "side"))
        fp = fp.view(np.uint64)
        same = part["i"].iloc[0] == part["j"].iloc[0]
        one, two = (np.ones(len(node), bool),) * 2 if same else (side == 0, side == 1)
        left, right = node[one], node[two]
        found, n = [], 0
        for i, js in _near(fp[one], fp[two], comp[one], comp[two], radius, same, forest):
            found.append((np.full(len(js), left[i]), right[js]))
            n += len(js)
            if n > 100_000:
                yield _ordered(found)
                found, n = [], 0
        if found:
            yield _ordered(found)

    def _ordered(found) -> pd.DataFrame:
        x, y = (np.concatenate(part) for part in zip(*found, strict=True))
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Works through whole groups in a sorted partition, one at a time."""
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            ids = rest[names].to_numpy()
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist()]
            for start, end in zip(cuts, cuts[1:], strict=False):
                yield from group(rest.iloc[start:end])
            rest = rest.iloc[cuts[-1]:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from group(rest)

    return (
        work.select(*names, "side", "node", "fp", "component").repartition(*names)
        .sortWithinPartitions(*names, "node").mapInPandas(run, "a bigint, b bigint").distinct()
    )


def _verified(pairs: DataFrame, docs: DataFrame, named: DataFrame, shingle: int, similarity: float) -> DataFrame:
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stored(_sets(docs, named.join(ends, "node"), shingle), "shingle-sets")
    a, b = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"grams_{c}")) for c in "ab")
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    union = F.size("grams_a") + F.size("grams_b") - common
    return pairs.join(a, "a").join(b, "b").where(common >= similarity * union).select("a", "b")


def components(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, chunk: int = CHUNK,
) -> DataFrame:
    """``(doc_id, key, component)`` per row."""
    rows = stored(described(docs, shingle), "shingle-sketches")
    nodes = stored(
        rows.groupBy("node").agg(F.any_value("fp").alias("fp"), F.any_value("buckets").alias("buckets"),
                                 F.min("key").alias("key")),
        "shingle-nodes",
    )
    named = nodes.select("node", "key")
    placed = nodes.select("node", "fp", F.explode("buckets").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(placed.join(sizes, "bucket"), "shingle-buckets")

    def part(n: str):
        return F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col(n) / chunk)).cast("int")

    own = part("n")
    first = members.select(
        "bucket", "node", "fp", F.col("node").alias("component"), own.alias("i"), own.alias("j"), F.lit(0).alias("side"))
    tried = stored(_candidates(first, min(NEAR, radius), True), "near-pairs")
    links = stored(_verified(tried, docs, named, shingle, similarity), "near-links")
    parts = stored(connected_components(links), "near-components")

    joined = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = stored(joined, "joined-buckets")
    mixed = joined.groupBy("bucket").agg(
        F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    # Each pair of parts of a bucket is a group of its own: all pairs are compared.
    open_ = joined.join(mixed, "bucket").withColumn("own", own).withColumn(
        "p", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / chunk).cast("int") - 1)))
    second = open_.select(
        "bucket", "node", "fp", "component", F.least("own", "p").alias("i"), F.greatest("own", "p").alias("j"),
        (F.col("own") > F.col("p")).cast("int").alias("side"))
    more = stored(_candidates(second, radius, False).join(tried, ["a", "b"], "left_anti"), "other-pairs")
    links = links.unionByName(_verified(more, docs, named, shingle, similarity))
    parts = stored(connected_components(links), "shingle-components").withColumnRenamed("node", "n")
    return rows.join(parts, F.col("node") == F.col("n"), "left").select(
        "doc_id", "key", F.coalesce("component", "node").alias("component"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each component: that with the smallest id; ids that are null come last."""
    first = F.min_by("key", F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "key"))
    chosen = components(docs, **options).groupBy("component").agg(first.alias("__key")).select("__key")
    rows = docs.withColumn("__key", row_key()).join(chosen, "__key", "left_semi")
    return rows.dropDuplicates(["__key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
