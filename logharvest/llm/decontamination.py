"""Benchmark passages in documents, by fingerprints of item-sized windows.

Each benchmark item of n words is looked for in windows of n words of every
document (in a document of fewer words, in the document itself). A window's
SimHash is compared with those of the items of its size: the 64 bits are cut
into ``radius + 1`` blocks, of which two fingerprints within the radius share
one at least, so an equality join on the blocks finds all of them. Pairs within
the radius are verified by the exact similarity of their word shingles, weighted
by how often each occurs: sum of the lesser weights over sum of the greater.

Which windows are fingerprinted: similarity s needs s/(1+s) of the shingles of
window and item together to be common. A window that has them keeps them when it
moves right to the first one. So it is enough to take windows that begin at a
shingle which occurs in an item of that size and hold enough such shingles;
no other window can be verified. Shingle hashes of whole documents are therefore
joined with those of the benchmark, and only the hits leave their row. Equal
windows are fingerprinted and compared once, however many documents have them.

Everything is DataFrame expressions; a hash's bits are counted in lanes of a
long. The benchmark is never assumed small: whether its shingles are broadcast is
the planner's choice by their stored size. That size says nothing of rows that are
made of stored arrays (a window's shingles and blocks, an item's). So rows of
windows, whose number grows with the documents, are never broadcast from an estimate,
and rows of items only if those that there are take ``BROADCAST`` bytes or less.

Words are runs of characters other than space and 0x09-0x0D, letters in lower
case. Items of fewer than ``shingle`` words have no shingle and are never found.
Nulls: a null text is empty; null ids are reported as null; repeated rows are one
finding. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logharvest.llm.common import ngrams, row_key, whole, words
from logharvest.operators.layout import computed_once
from logharvest.session import stored

SHINGLE = 5
SIMILARITY = 0.8
# Shingle sets of similarity 0.8 differ in 9.7 of 64 bits on average, with a
# standard deviation of 2.9: beyond 20 bits lie 3 in 10,000 of those at the very limit.
RADIUS = 20
# What an exploded benchmark may take in a broadcast; beyond that it is shuffled.
BROADCAST = 16 << 20


def _words(text: Column) -> Column:
    return words(F.lower(text))


def _with_grams(rows: DataFrame, source: str, shingle: int) -> DataFrame:
    """Adds ``grams``, shingle hashes in order, from an array of words."""
    rows = computed_once(rows, "__hashes", F.transform(source, lambda w: F.xxhash64(w)))
    return computed_once(rows, "grams", ngrams("__hashes", shingle)).drop("__hashes")


def benchmark_items(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(item, words, size, grams)`` of items that have a shingle; ``item`` is id and a hash of the text."""
    item = F.struct("item_id", F.xxhash64(whole("text")).alias("h")).alias("item")
    rows = computed_once(benchmark.select(item, "text"), "words", _words(whole("text"))).drop("text")
    rows = rows.dropDuplicates(["item"])
    rows = rows.withColumn("size", F.size("words")).where(F.col("size") >= shingle)
    return _with_grams(rows, "words", shingle)


def simhash(grams: Column | str) -> Column:
    """64 bits, each 1 if set in over half the hashes, repeats included."""
    lane = (1 << 32) | 1

    def spread(h: Column, k: int) -> Column:
        return F.shiftrightunsigned(h, k).bitwiseAND(F.lit(lane))

    n = F.size(grams)
    sums = F.aggregate(
        grams, F.array_repeat(F.lit(0).cast("bigint"), 32),
        lambda acc, h: F.array(*[F.get(acc, F.lit(k)) + spread(h, k) for k in range(32)]),
    )

    def bits(sums: Column) -> Column:
        low = F.transform(sums, lambda s, k: (2 * s.bitwiseAND(F.lit((1 << 32) - 1)) > n).cast("bigint"))
        high = F.transform(sums, lambda s, k: (2 * F.shiftrightunsigned(s, 32) > n).cast("bigint"))
        both = F.concat(low, high)
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"),
            lambda acc, k: acc.bitwiseOR(F.call_function("shiftleft", F.get(both, k), k)),
        )

    # One element, so that the sums are made once.
    return F.get(F.transform(F.array(sums), bits), F.lit(0))


def _blocks(fp: str, radius: int) -> Column:
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*[
        F.struct(
            F.lit(i).alias("block"),
            F.shiftrightunsigned(F.col(fp), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"),
        )
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ])


def _bounded(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` to be joined by a broadcast if their ``size`` in bytes allows it, else by sorting both sides."""
    return F.broadcast(rows) if size <= BROADCAST else rows.hint("merge")


def _item_bytes(items: DataFrame, shingle: int, radius: int) -> tuple[int, int]:
    """About what the items' blocks and the items' shingles take in a hash table, keys and rows."""
    # A shingle's text is there twice, and each word is in ``shingle`` of them.
    texts = F.octet_length(F.array_join("words", " ")).cast("long") * (2 * shingle)
    shingles = (F.col("size").cast("long") - (shingle - 1)) * 320
    n, size = items.agg(F.count(F.lit(1)), F.sum(shingles + texts)).first()
    return 200 * (radius + 1) * n, size or 0


def _windows(docs: DataFrame, items: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``(key, windows)``: starts and sizes of windows that may be verified, per document."""
    shingles = stored(
        items.select("size", F.explode("grams").alias("gram")).distinct(), "benchmark-shingles"
    )
    rows = docs.select(row_key().alias("key"), whole("text").alias("__text"))
    rows = computed_once(rows, "__words", _words(F.col("__text"))).drop("__text")
    rows = _with_grams(rows.withColumn("n_words", F.size("__words")), "__words", shingle).drop("__words")
    hits = rows.select("key", "n_words", F.posexplode("grams").alias("at", "gram")).join(shingles, "gram")
    # A document's own hits, at most one per word and item size.
    per_doc = hits.groupBy("key", "n_words", "size").agg(F.sort_array(F.collect_set("at")).alias("at"))
    size, at = F.col("size"), F.col("at")
    width = F.least(size, F.col("n_words"))
    common = similarity / (1 + similarity)
    # A little below, lest rounding cost a window; similarity is exact later.
    needed = F.ceil((size + width - 2 * (shingle - 1)) * common - 1e-6).cast("int")
    per_doc = per_doc.withColumns({"width": width, "needed": F.greatest(needed, F.lit(1))})
    starts = F.filter(
        at, lambda s, i: F.get(at, i + F.col("needed") - 1) <= s + F.col("width") - shingle
    )
    starts = F.array_distinct(
        F.transform(starts, lambda s: F.least(s, F.col("n_words") - F.col("width")))
    )
    found = per_doc.select("key", "size", "width", F.explode(starts).alias("start"))
    return found.groupBy("key").agg(F.collect_list(F.struct("size", "width", "start")).alias("windows"))


def find_passages(
    docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """``(key, doc_id, item_id, similarity, start, n_words)``: the best window per document and item.

    ``key`` identifies the document's row (``common.row_key``); ``start`` counts words from 0.
    """
    items = stored(benchmark_items(benchmark, shingle), "benchmark-items")
    windows = _windows(docs, items, shingle, similarity)
    rows = docs.select("doc_id", "text", row_key().alias("key")).join(windows, "key")
    rows = computed_once(rows, "__words", _words(whole("text"))).drop("text")
    rows = rows.select("key", "doc_id", "__words", F.explode("windows").alias("w")).select(
        "key", "doc_id", "w.size", "w.start", F.col("w.width").alias("n_words"),
        F.slice("__words", F.col("w.start") + 1, F.col("w.width")).alias("words"),
    )
    content = F.array_join("words", " ")
    rows = stored(
        rows.withColumn("window", F.struct(
            "size", F.xxhash64(content).alias("a"), F.xxhash64(F.lit(1), content).alias("b"))),
        "windows",
    )
    distinct = rows.groupBy("window").agg(F.any_value("words").alias("words"))
    distinct = _with_grams(distinct, "words", shingle)
    distinct = stored(
        distinct.select("window", "words", F.col("window.size").alias("size"), simhash("grams").alias("fp")),
        "window-fingerprints",
    )
    block_bytes, shingle_bytes = _item_bytes(items, shingle, radius)
    indexed = items.select("item", "size", simhash("grams").alias("item_fp"))
    indexed = _bounded(indexed.withColumn("k", F.explode(_blocks("item_fp", radius))), block_bytes)
    pairs = (
        distinct.select("window", "size", "fp", F.explode(_blocks("fp", radius)).alias("k"))
        .join(indexed, ["size", "k"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        .select("window", "item").distinct()
    )

    def weights(frame: DataFrame, name: str, weight: str) -> DataFrame:
        runs = F.transform(
            F.sequence(F.lit(0), F.size("words") - shingle),
            lambda i: F.array_join(F.slice("words", i + 1, shingle), " "),
        )
        exploded = frame.select(name, (F.size("words") - shingle + 1).alias(f"{weight}_all"), F.explode(runs).alias("s"))
        return exploded.groupBy(name, f"{weight}_all", "s").agg(F.count(F.lit(1)).alias(weight))

    common = (
        pairs.join(weights(distinct.where(F.size("words") >= shingle), "window", "w").hint("merge"), "window")
        .join(_bounded(weights(items, "item", "i"), shingle_bytes), ["item", "s"])
        .groupBy("window", "item", "w_all", "i_all").agg(F.sum(F.least("w", "i")).alias("common"))
    )
    union = F.col("w_all") + F.col("i_all") - F.col("common")
    verified = common.select("window", "item.item_id", (F.col("common") / union).alias("similarity")).where(
        F.col("similarity") >= similarity
    )
    best = F.max_by(F.struct("start", "n_words"), F.struct("similarity", -F.col("start")))
    return (
        rows.drop("words").hint("merge").join(verified, "window").groupBy("key", "doc_id", "item_id")
        .agg(F.max("similarity").alias("similarity"), best.alias("at"))
        .select("key", "doc_id", "item_id", "similarity", "at.start", "at.n_words")
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    found = find_passages(docs, benchmark, **options).select(F.col("key").alias("__key")).distinct()
    keyed = docs.withColumn("__key", row_key())
    return keyed.join(found, "__key", "left_anti").drop("__key")
