"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logharvest.session import remove, work_folder


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for all nodes of ``links (a, b)``; the component is its smallest node.

    Alternates two steps until nothing changes: every node's larger neighbours
    are tied to its smallest neighbour (large star), then every node's smaller
    neighbours and itself are (small star). Each step is one aggregate with
    map-side combine and one join, which adaptive execution splits where a node
    has very many links; no list of neighbours is ever collected. The number of
    rounds grows with the logarithm of the longest chain. Each round's links are
    written to the shared folder, which keeps the lineage short and lets
    lost tasks start from there; only the last one stays.

    Rows with a null end are not links; repeated links and loops do no harm.
    """
    spark = links.sparkSession

    def written(df: DataFrame):
        path = work_folder(spark, "links")
        df.write.parquet(path)
        return path, spark.read.parquet(path)

    clean = links.where("a IS NOT NULL AND b IS NOT NULL")
    path, edges = written(
        clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    for _ in range(max_rounds):
        real = edges.where("a > b")
        # Large star: the larger neighbours of a node go to its smallest neighbour, or itself.
        both = real.unionByName(real.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            real.select(F.col("b").alias("a"), F.col("a").alias("far")).join(smallest, "a")
            .select(F.col("far").alias("a"), F.col("m").alias("b"))
        ).where("a <> b").distinct()
        large_path, large = written(large)
        # Small star: a node and its smaller neighbours go to the smallest of them.
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(smallest, "a").select(F.col("b").alias("x"), F.col("m").alias("b"))
            .unionByName(smallest.select(F.col("a").alias("x"), F.col("m").alias("b")))
            .select(F.greatest("x", "b").alias("a"), F.least("x", "b").alias("b")).where("a <> b").distinct()
        )
        new_path, new = written(small)
        # A fingerprint of the set of links: equal sets, equal figures.
        state = new.agg(
            F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("xxhash64(b, a) >> 20"))
        ).first()
        for old in (path, large_path):
            remove(spark, old)
        path, edges = new_path, new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
