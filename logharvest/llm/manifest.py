"""A Merkle manifest of a table of documents, built level by level with lag and lead windows.

Every row is a leaf: ``H`` of its fields, each ``-`` if null, else its UTF-8
byte count, ``:`` and its value (integers in decimal), concatenated. ``H`` is the
lower-case hex SHA-256 of its inputs concatenated, digests taken as hex text.

Per group (``lang``), leaves ascend by ``doc_id`` (nulls first; equal ids by leaf
digest). While a group has more than one node, nodes ``2i`` and ``2i + 1`` of a
level become ``H`` of both, a last odd node ``H`` of itself alone. The one node
left is the group's subroot (a lone leaf is its own subroot). Subroots, ordered
by group (null first, UTF-8 bytewise), make the root the same way.

How: a node's place in its level is a dense position, so its sibling sits at a
fixed offset. Positions come from a range partitioning: counts per partition
and group give each partition's first position, and a row number inside the
partition the rest, so no group is ever one task. ``BLOCK_BITS`` levels are then
one stage of windows per (group, block of ``2 ** BLOCK_BITS`` positions). Every
row of a block carries the digest of its node at the level reached; the sibling
of level ``k`` is ``lead`` or ``lag`` by ``2 ** k`` rows, or the block's last row
where the last run is shorter; from both comes the digest of the next level. The
blocks' tops are the rows of the next tier, ``2 ** BLOCK_BITS`` times fewer.

Proofs: a node's path is its own steps (sibling digest or null, and its side)
followed by its block top's path; paths are joined top-down on the block, one
tier at a time, subroots' paths first. The windows of a tier are run once for
the tops and once more for the paths: so paths of leaves, ``n log n`` digests,
are neither stored nor shuffled, only folded in the task that made them.
Verifying folds a leaf along its path with ``aggregate``; everything stays in
Spark's own functions.

Edge cases: nulls as above (a null group is a group of its own, ordered
first); empty and very long texts are hashed whole; repeated rows are leaves of
their own (equal leaves, adjacent); an empty table gives no rows; extra columns
are ignored, names need not be free. Scale: what is stored and shuffled is a
fixed number of bytes per leaf; time is ``n log n``, a proof per leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logharvest.session import stored

BLOCK_BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, ``:``, value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(row: dict[str, Column]) -> Column:
    return H(*[encoded(row[name]) for name in FIELDS])


def positions(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """``nodes`` (with ``g``, the group) and ``gk`` (the group's key, not null), ``pos`` (rank
    from 0 inside the group by ``order``) and ``n`` (the group's count of nodes).

    Range partitions ordered by (g, order); a partition's first position in a
    group is the count of that group's rows in earlier partitions.
    """
    keys = [F.col("g").asc_nulls_first(), *order]
    ranged = nodes.withColumn("gk", encoded(F.col("g"))).repartitionByRange(*keys)
    parted = stored(ranged.withColumn("part", F.spark_partition_id()), "manifest-ranged")
    counts = parted.groupBy("part", "gk").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("gk")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        F.col("part").alias("p2"), F.col("gk").alias("g2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.sum("n").over(group).alias("n"),
    )
    inside = Window.partitionBy("part", "gk").orderBy(*order)
    ranked = parted.withColumn("rank", F.row_number().over(inside) - 1)
    on = (F.col("part") == F.col("p2")) & (F.col("gk") == F.col("g2"))
    return ranked.join(firsts, on).select(*nodes.columns, "gk", (F.col("first") + F.col("rank")).alias("pos"), "n")


def _climbed(level: DataFrame) -> DataFrame:
    """``level`` with each node's ``block``, its ``path`` inside the block, and the block's ``top``.

    ``level``: ``(gk, pos, h, n, …)`` with ``n`` the group's count of nodes. A
    step is the sibling digest (null in a run of one) and the side (0: left
    child). A group down to one node stays as it is.
    """
    place, rows = F.col("pos"), level.withColumns({"block": F.shiftright("pos", BLOCK_BITS), "top": F.col("h")})
    block = Window.partitionBy("gk", "block").orderBy("pos")
    whole = block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = []
    for k in range(BLOCK_BITS):
        node, width = F.shiftright(place, k), F.shiftright(F.col("n") + (1 << k) - 1, k)
        right, top = node % 2 == 1, F.col("top")
        sib = F.when(right, F.lag(top, 1 << k).over(block)).when(
            node + 1 < width, F.coalesce(F.lead(top, 1 << k).over(block), F.last(top).over(whole)))
        rows = rows.withColumn(f"sib_{k}", sib)
        sib = F.col(f"sib_{k}")
        parent = F.when(sib.isNull(), H(top)).when(right, H(sib, top)).otherwise(H(top, sib))
        rows = rows.withColumn("top", F.when(width > 1, parent).otherwise(top))
        steps.append(F.when(width > 1, F.struct(sib.alias("sib"), right.cast("int").alias("side"))))
    return rows.select(*level.columns, "block", "top", F.array_compact(F.array(*steps)).alias("path"))


def tree(nodes: DataFrame, order: list[Column]) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of the tree, nodes placed first, then the tops of their blocks, and so
    on; and per group ``(g, h)``, its top. ``paths`` takes the tiers.

    ``nodes`` has ``g`` (the group) and ``h`` (the digest); ``order`` sorts
    nodes inside a group.
    """
    tiers = [stored(positions(nodes, order), "manifest-placed")]
    most = tiers[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = F.col("pos") % (1 << BLOCK_BITS) == 0
        tops = _climbed(tiers[-1].select("g", "gk", "pos", "h", "n")).where(first).select(
            "g", "gk", F.col("block").alias("pos"), F.col("top").alias("h"),
            F.shiftright(F.col("n") + (1 << BLOCK_BITS) - 1, BLOCK_BITS).alias("n"))
        tiers.append(stored(tops, f"manifest-tier-{len(tiers)}"))
        most = (most + (1 << BLOCK_BITS) - 1) >> BLOCK_BITS
    return tiers, tiers[-1].select("g", "h")


def no_steps() -> Column:
    return F.array().cast("array<struct<sib:string,side:int>>")


def paths(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The placed nodes with ``path``: from the node up to its group's top, then the group's path.

    ``above``: per group its value ``g``, its ``path`` and more columns, which its
    nodes get. Top-down: a tier's nodes go on with the path of their block's top.
    """
    def key(value: Column, place: Column) -> list[Column]:
        return [value.alias("g2"), place.alias("p2"), F.col("path").alias("up")]

    more = [c for c in above.columns if c not in ("g", "path")]
    # A group's top is the one node, at position 0, of the last tier.
    up = above.select(*key(encoded(F.col("g")), F.lit(0).cast("bigint")), *more)
    same_group = F.col("gk") == F.col("g2")
    tops = tiers[-1].join(up, same_group & (F.col("pos") == F.col("p2"))).withColumnRenamed("up", "path")
    for k in reversed(range(len(tiers) - 1)):
        tops = stored(tops.select("gk", "pos", "path", *more), f"manifest-paths-{k + 1}")
        up = tops.select(*key(F.col("gk"), F.col("pos")), *more)
        climbed = _climbed(tiers[k]).join(up, same_group & (F.col("block") == F.col("p2")))
        tops = climbed.withColumn("path", F.concat("path", "up"))
    return tops.select(*tiers[0].columns, "path", *more)


def fold(start: Column, path: Column) -> Column:
    """The top reached from ``start`` along ``path``."""
    return F.aggregate(
        path,
        start,
        lambda acc, s: F.when(s["sib"].isNull(), H(acc)).when(s["side"] == 0, H(acc, s["sib"])).otherwise(H(s["sib"], acc)),
    )


def manifest(docs: DataFrame, group: str = "lang", extra: dict[str, Column] | None = None) -> DataFrame:
    """Per row: ``doc_id, leaf, subroot, root, proof`` (the sibling digests, leaf to root), ``path``.

    ``path`` holds the steps to fold a leaf to the root (``fold``). ``extra``
    columns of a row are worked out before the tree and come out beside it; no
    other field of a document (texts least of all) goes through the tree.
    """
    extra = extra or {}
    leaves = docs.select(
        F.col(group).alias("g"),
        leaf_digest({name: F.col(name) for name in FIELDS}).alias("h"),
        F.col("doc_id").alias("f_doc_id"),
        *[value.alias(f"x_{name}") for name, value in extra.items()],
    )
    tiers, subroots = tree(leaves, [F.col("f_doc_id").asc_nulls_first(), F.col("h").asc()])
    # Subroots are one group, ordered by their group's value.
    tops = subroots.select(F.col("g").alias("lang_g"), F.lit(0).alias("g"), "h")
    upper, root = tree(tops, [F.col("lang_g").asc_nulls_first()])
    above = paths(upper, root.select("g", no_steps().alias("path"), F.col("h").alias("root"))).select(
        F.col("lang_g").alias("g"), "path", F.col("h").alias("subroot"), "root"
    )
    return paths(tiers, above).select(
        F.col("f_doc_id").alias("doc_id"),
        F.col("h").alias("leaf"),
        "subroot",
        "root",
        F.array_join(F.transform("path", lambda s: F.coalesce(s["sib"], F.lit(""))), "").alias("proof"),
        "path",
        *[F.col(f"x_{name}").alias(name) for name in extra],
    )


def tampered(docs: DataFrame) -> Column:
    """Rows where 7 divides the unsigned CRC-32 of the decimal id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))


def audit(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Tampering adds 1 to ``n_chars`` (a null stays null) where ``tampered`` holds;
    ``folded_root`` folds the leaf of the row so changed along the original
    siblings, and ``verified`` says whether it gives the root.
    """
    changed = {name: F.col(name) for name in FIELDS} | {"n_chars": F.col("n_chars") + 1}
    start = F.when(tampered(docs), leaf_digest(changed)).otherwise(leaf_digest({name: F.col(name) for name in FIELDS}))
    m = manifest(docs, extra={"start": start})
    folded = fold(F.col("start"), F.col("path"))
    return m.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )
