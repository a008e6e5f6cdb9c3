"""Annotator agreement, on document labels and on orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import table
from logharvest.operators import agreement as A


def label_raters(spark, sf_dir):
    """One rater calls a document good, the other calls it not toxic."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    a = docs.select("doc_id", "lang").join(labels.select("doc_id", "quality"), "doc_id").select(
        F.col("doc_id").alias("Snippet_ID"), F.col("lang").alias("Smell"), F.col("quality").alias("agreement"))
    b = labels.select(
        F.col("doc_id").alias("snippet_id"), (1 - F.col("toxic")).alias("Agreement"))
    return A.annotations(a), A.annotations(b)


_LABELS_SQL = """
WITH a AS (SELECT doc_id AS id, lang AS smell, CAST(quality AS VARCHAR) AS rating FROM labels JOIN documents USING (doc_id)),
b AS (SELECT doc_id AS id, CAST(1 - toxic AS VARCHAR) AS rating FROM labels)
"""


def order_raters(spark, sf_dir):
    """Orders rated twice under the customer as id, so ids repeat on both sides;
    ids, ratings and categories are missing now and then."""
    orders = table(spark, sf_dir, "orders")
    key = F.when(F.col("o_custkey") % 40 != 0, F.col("o_custkey"))
    a = orders.select(
        key.alias("snippet_id"),
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")).alias("smell"),
        F.when(F.col("o_orderkey") % 11 != 0, F.substring("o_orderpriority", 1, 1)).alias("rating"))
    b = orders.select(
        key.alias("snippet_id"), F.lit(None).cast("string").alias("smell"),
        F.when(F.col("o_orderkey") % 13 != 0, (F.col("o_orderkey") % 5 + 1).cast("string")).alias("rating"))
    return a, b


_ORDERS_SQL = """
WITH a AS (
  SELECT CASE WHEN o_custkey % 40 <> 0 THEN o_custkey END AS id,
         CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS smell,
         CASE WHEN o_orderkey % 11 <> 0 THEN substr(o_orderpriority, 1, 1) END AS rating FROM orders
), b AS (
  SELECT CASE WHEN o_custkey % 40 <> 0 THEN o_custkey END AS id,
         CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 5 + 1 AS VARCHAR) END AS rating FROM orders
)
"""

# SQL pairs row by row; equal ids are joined through counts to keep it short.
_PAIRS_SQL = """,
ca AS (SELECT id, smell, rating, count(*) AS n FROM a GROUP BY ALL),
cb AS (SELECT id, rating, count(*) AS n FROM b GROUP BY ALL),
pairs AS (SELECT ca.id AS snippet_id, smell, ca.rating AS rating_a, cb.rating AS rating_b, ca.n * cb.n AS n_pairs
          FROM ca JOIN cb ON ca.id IS NOT DISTINCT FROM cb.id)
"""
_KAPPA_SQL = _PAIRS_SQL + """,
rated AS (SELECT coalesce(smell, '<EMPTY>') AS smell, rating_a, rating_b, n_pairs AS n FROM pairs
          WHERE rating_a IS NOT NULL AND rating_b IS NOT NULL),
g AS (SELECT 0 AS part, 'ALL' AS smell, rating_a, rating_b, n FROM rated
      UNION ALL SELECT 1, smell, rating_a, rating_b, n FROM rated),
totals AS (SELECT part, smell, sum(n) AS n, coalesce(sum(n) FILTER (rating_a = rating_b), 0) AS agree FROM g GROUP BY 1, 2),
ma AS (SELECT part, smell, rating_a AS label, sum(n) AS n FROM g GROUP BY 1, 2, 3),
mb AS (SELECT part, smell, rating_b AS label, sum(n) AS n FROM g GROUP BY 1, 2, 3),
chance AS (SELECT ma.part, ma.smell, sum(ma.n * mb.n) AS s FROM ma JOIN mb USING (part, smell, label) GROUP BY 1, 2),
kappa AS (
  SELECT part, smell, n AS n_samples,
         CASE WHEN n >= 2 AND n * n - coalesce(s, 0) <> 0
              THEN CAST(n * agree - coalesce(s, 0) AS DOUBLE) / CAST(n * n - coalesce(s, 0) AS DOUBLE) END AS kappa
  FROM totals LEFT JOIN chance USING (part, smell))
"""
_BY_SELECT = "SELECT smell, CAST(n_samples AS BIGINT) AS n_samples, kappa FROM kappa"
_ALL_SELECT = "SELECT CAST(n_samples AS BIGINT) AS n_samples, kappa FROM kappa WHERE part = 0"
_META_SELECT = """
SELECT (SELECT count(*) FROM a) AS rows_file_a, (SELECT count(*) FROM b) AS rows_file_b,
       CAST(coalesce(sum(n_pairs), 0) AS BIGINT) AS rows_merged_after_join,
       CAST(coalesce(sum(n_pairs) FILTER (rating_a IS NOT NULL AND rating_b IS NOT NULL), 0) AS BIGINT) AS rows_with_both_agreement
FROM pairs"""


def on(raters, step):
    return lambda spark, sf_dir: step(*raters(spark, sf_dir))


def _kappa_by(a, b):
    return A.cohen_kappa_by(A.pair_annotations(a, b))


def _merged(a, b):
    """Full rows of both sides; the name both share gets suffixes."""
    return A.merge_annotations(a, b.drop("smell"), "snippet_id", "snippet_id", null_ids=True)


QUERIES = {
    "paired_labels": (on(label_raters, A.pair_annotations), _LABELS_SQL + _PAIRS_SQL + "SELECT * FROM pairs"),
    "paired_orders": (on(order_raters, A.pair_annotations), _ORDERS_SQL + _PAIRS_SQL + "SELECT * FROM pairs"),
    "label_kappa": (on(label_raters, lambda a, b: A.cohen_kappa(A.pair_annotations(a, b))), _LABELS_SQL + _KAPPA_SQL + _ALL_SELECT),
    "label_kappa_by_smell": (on(label_raters, _kappa_by), _LABELS_SQL + _KAPPA_SQL + _BY_SELECT),
    "order_kappa_by_smell": (on(order_raters, _kappa_by), _ORDERS_SQL + _KAPPA_SQL + _BY_SELECT),
    "label_agreement_metadata": (
        on(label_raters, lambda a, b: A.agreement_metadata(a, b, A.pair_annotations(a, b))),
        _LABELS_SQL + _PAIRS_SQL + _META_SELECT),
    "order_agreement_metadata": (
        on(order_raters, lambda a, b: A.agreement_metadata(a, b, A.pair_annotations(a, b))),
        _ORDERS_SQL + _PAIRS_SQL + _META_SELECT),
    "label_disagreements": (
        on(label_raters, lambda a, b: A.disagreements(A.pair_annotations(a, b))),
        _LABELS_SQL + _PAIRS_SQL + "SELECT * FROM pairs WHERE rating_a <> rating_b"),
    "merged_annotations": (
        on(order_raters, _merged), _ORDERS_SQL + _PAIRS_SQL + "SELECT * FROM pairs"),
    "repeated_ids": (
        on(order_raters, lambda a, b: A.duplicate_ids(a)),
        _ORDERS_SQL + "SELECT id AS snippet_id, count(*) AS n FROM a GROUP BY 1 HAVING count(*) > 1"),
}
