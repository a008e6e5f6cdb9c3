"""Near duplicates by SimHash, with tables of distances to reference fingerprints.

Every document gets a 64-bit fingerprint of its word shingles. Fingerprints
link at ``radius`` or fewer differing bits; documents form components over the
links.

Distinct fingerprints are compared, not documents, so copies cost nothing. Bits
are cut into ``radius + 2`` blocks; two fingerprints within the radius agree in
two blocks at least, so they meet in a bucket of some pair of blocks. (Distances
to references alone cannot bring pairs together: random fingerprints all lie
about 32 bits from any reference.) In a bucket, the table of Hamming distances
to many references, worked out once per fingerprint, does most of the work: a
pair whose distances to any reference differ by more than the radius is
discarded by the triangle inequality; survivors are verified bit by bit. Of the
verified links, a bucket keeps those that join parts not yet joined in it, which
leaves the components as they are and at most one link per member.

A bucket of more than ``chunk`` fingerprints is dealt over many tasks: its
members are cut into chunks by their distance to the first reference, and each
pair of chunks whose ranges lie within the radius is a task's work of its own,
at most chunk x chunk comparisons of 8-byte words. No comparison is left out.

Nulls: a null text has no words, fingerprint zero. Null ids take part like the
rest, but never name a component unless it has no other id. Equal rows give
equal rows. Empty tables give empty results.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from logharvest.llm.common import row_key
from logharvest.llm.components import connected_components
from logharvest.session import stored

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 4
RADIUS = 4
REFERENCES = 24
CHUNK = 2048
_SEED = 42
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if set in over half the hashes of the shingles, repeats included."""
    import xxhash

    # bytes.split() cuts at space and 0x09-0x0D, nothing else.
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(shingle, len(words)) - 1
    pairs = zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], _SEED) for a, b in pairs], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # unpacked bits of long texts take 64 bytes a word
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, key, fp)`` per row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.pop("text")], dtype=np.uint64)
            yield batch.assign(fp=found.view(np.int64))

    kind = docs.schema["doc_id"].dataType
    # Ids pass pandas as text: beside a null it would make floats of them.
    rows = docs.select(F.col("doc_id").cast("string"), "text", row_key().alias("key"))
    made = rows.select("doc_id", "key.a", "key.b", "text").mapInPandas(
        run, "doc_id string, a bigint, b bigint, fp bigint")
    return made.select(F.col("doc_id").cast(kind), F.struct("a", "b").alias("key"), "fp")


def _blocks(n: int) -> list[tuple[int, int]]:
    """``n`` runs of bits that cover 64, as (shift, width)."""
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def references(n: int = REFERENCES) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random words."""
    return np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, n, dtype=np.uint64)


def _links_between(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest over all pairs of ``a`` x ``b`` within the radius."""
    refs = references()
    # Sorted by the distance to the first reference, a row's partners are one run.
    a, b = (x[np.argsort(np.bitwise_count(x ^ refs[0]), kind="stable")] for x in (a, b))
    table_a, table_b = (np.bitwise_count(x[:, None] ^ refs).astype(np.int8) for x in (a, b))
    low = np.searchsorted(table_b[:, 0], table_a[:, 0] - radius, "left")
    high = np.searchsorted(table_b[:, 0], table_a[:, 0] + radius, "right")
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for i in range(len(a)):
        first = max(low[i], i + 1) if same else low[i]
        if first >= high[i]:
            continue
        at = np.arange(first, high[i])
        for k in range(1, len(refs), 6):  # a few references at a time: most pairs go at once
            part = table_b[at, k : k + 6] - table_a[i, k : k + 6]
            at = at[np.abs(part).max(axis=1, initial=0) <= radius]
            if not len(at):
                break
        if len(at):
            at = at[np.bitwise_count(b[at] ^ a[i]) <= radius]
        for j in at.tolist():
            x, y = int(a[i]), int(b[j])
            if (p := root(x)) != (q := root(y)):
                parent[p] = q
                yield x, y


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links ``(a, b)`` between rows of ``distinct (fp)``: components over them are those over all links."""
    pairs = list(combinations(_blocks(radius + 2), 2))
    keys = F.array(*[
        F.struct(
            F.lit(n).alias("pair"),
            *[F.expr(f"shiftrightunsigned(fp, {s}) & {2**w - 1}L").alias(k) for k, (s, w) in zip("uv", two, strict=True)],
        )
        for n, two in enumerate(pairs)
    ])
    # The reference's distance orders a bucket's members for cutting into chunks.
    first = int(references()[:1].view(np.int64)[0])
    far = F.bit_count(F.col("fp").bitwiseXOR(F.lit(first)))
    placed = distinct.select("fp", far.cast("int").alias("far"), F.explode(keys).alias("key")).select(
        "fp", "far", "key.pair", "key.u", "key.v"
    )
    bucket = ["pair", "u", "v"]
    sizes = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(placed.join(sizes, bucket), "fingerprint-buckets")

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Works through whole (bucket, i, j) groups in a sorted partition, one at a time."""
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            ids = rest[names].to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            if not len(cuts):
                continue
            yield _all_links(rest["fp"].to_numpy()[: cuts[-1]], rest["side"].to_numpy()[: cuts[-1]], cuts)
            rest = rest.iloc[cuts[-1]:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield _all_links(rest["fp"].to_numpy(), rest["side"].to_numpy(), np.array([len(rest)]))

    def _all_links(fp: np.ndarray, side: np.ndarray, cuts: np.ndarray) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        words, start = fp.view(np.uint64), 0
        for end in cuts.tolist():
            own, s = words[start:end], side[start:end]
            if len(own) == 2 and s[0] == s[1]:
                if int(own[0] ^ own[1]).bit_count() <= radius:
                    found.append((int(own[0]), int(own[1])))
            elif (s == s[0]).all():
                found += _links_between(own, own, radius, True)
            else:
                found += _links_between(own[s == 0], own[s == 1], radius, False)
            start = end
        two = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": two[:, 0], "b": two[:, 1]})

    names = [*bucket, "i", "j"]
    small = members.where(F.col("n") <= chunk).select(
        *bucket, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp"
    )
    work = small.unionByName(_chunk_pairs(members.where(F.col("n") > chunk), bucket, radius, chunk))
    return (
        work.repartition(*names).sortWithinPartitions(*names)
        .mapInPandas(forest, "a bigint, b bigint").distinct()
    )


def _chunk_pairs(large: DataFrame, bucket: list[str], radius: int, chunk: int) -> DataFrame:
    """Members of large buckets once per pair of chunks they belong to.

    A chunk holds members at one distance from the first reference, dealt by hash
    into parts of about ``chunk``; chunks whose distances differ by more than the
    radius cannot hold partners and are not paired.
    """
    shells = large.groupBy(*bucket, "far").agg(F.count(F.lit(1)).alias("m"))
    shells = shells.withColumn("parts", F.ceil(F.col("m") / chunk).cast("int"))
    near = shells.alias("x").join(
        shells.select(*bucket, F.col("far").alias("far2"), F.col("parts").alias("parts2")), bucket
    ).where(F.abs(F.col("far") - F.col("far2")) <= radius)
    # Chunk number: shell and part in one.
    whole_id = lambda far, part: far * F.lit(1 << 24) + part
    part = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("parts").cast("long")).cast("int")
    partner = near.select(*bucket, "far", "parts", "far2", "parts2").groupBy(*bucket, "far", "parts").agg(
        F.collect_list(F.struct("far2", "parts2")).alias("near")  # 2 * radius + 1 shells at most
    )
    rows = large.join(partner, [*bucket, "far"]).select(
        *bucket, "fp", whole_id(F.col("far"), part).cast("int").alias("own"), F.explode("near").alias("s")
    ).select(*bucket, "fp", "own", F.explode(F.sequence(F.lit(0), F.col("s.parts2") - 1)).alias("p"), "s.far2")
    rows = rows.withColumn("other", whole_id(F.col("far2"), F.col("p")).cast("int"))
    return rows.select(
        *bucket, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "fp",
    )


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, chunk: int = CHUNK
) -> DataFrame:
    """``(doc_id, fingerprint, component_id, key, component)`` per document.

    ``component_id`` is the smallest id in the component, null if it has none;
    ``component`` tells components apart even then; ``key`` is ``common.row_key``.
    """
    known = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = known.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    distinct = stored(distinct, "distinct-fingerprints")
    links = stored(link_fingerprints(distinct.select("fp"), radius, chunk), "fingerprint-links")
    parts = stored(connected_components(links), "fingerprint-components")
    grouped = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_doc", F.coalesce("component", "fp").alias("component")
    )
    names = grouped.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = grouped.join(names, "component").select("fp", "component_id", "component")
    # Ids of one fingerprint are one row on the right, however many documents share it.
    return known.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "key", "component"
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each component: that with the smallest id; ids that are null come last."""
    groups = near_duplicates(docs, **options)
    first = F.min_by("key", F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "key"))
    chosen = groups.groupBy("component").agg(first.alias("__key")).select("__key")
    rows = docs.withColumn("__key", row_key()).join(chosen, "__key", "left_semi")
    return rows.dropDuplicates(["__key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
