"""Repository catalogue, from parts, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import table
from logharvest.operators import catalogue as R


def _catalogue(spark, sf_dir):
    """Parts as repositories: the type gives the language, the price the stars,
    which are text and for some sizes no number. Headers need cleaning."""
    stars = F.when(F.col("p_size") % 7 == 0, "unknown").otherwise(F.col("p_retailprice").cast("int").cast("string"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string")).alias(" full_name"),
        F.when(F.col("p_size") % 5 != 0, F.replace("p_type", F.lit("ECONOMY"), F.lit("Jupyter PYTHON"))).alias("language "),
        stars.alias("stars"),
        F.col("p_name").alias("description"),
    )


_CATALOGUE_SQL = """
WITH c AS (
  SELECT p_brand || '/' || p_partkey AS repository_full_name,
         CASE WHEN p_size % 5 <> 0 THEN replace(p_type, 'ECONOMY', 'Jupyter PYTHON') END AS language,
         CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(trunc(p_retailprice) AS DOUBLE) END AS stars,
         p_name AS description
  FROM part)
"""
_POPULAR = "contains(lower(language), 'python') AND stars > 905"


def filtered_repos(spark, sf_dir):
    return R.filter_repos(_catalogue(spark, sf_dir), 905)


def filter_report(spark, sf_dir):
    return R.filter_report(_catalogue(spark, sf_dir), 905)


def _responses(spark, sf_dir):
    """Every customer was looked up once per order of theirs."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.concat(F.lit("owner"), F.col("o_custkey").cast("string"), F.lit("/repo")).alias(R.KEY),
        F.when(F.col("o_custkey") % 4 == 0, 404).otherwise(200).alias("status_code"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 5 == 0).alias("archived"),
    )


def _repos(spark, sf_dir):
    """Customers as repositories; some have no name."""
    name = F.concat(F.lit("owner"), F.col("c_custkey").cast("string"), F.lit("/repo"))
    return table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 50 != 0, name).alias(R.KEY),
        F.col("c_acctbal").alias("sloc"), F.col("c_mktsegment").alias("language"))


_STATUS_SQL = """
WITH status AS (
  SELECT 'owner' || o_custkey || '/repo' AS repository_full_name,
         CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 3 <> 0 THEN o_custkey % 5 = 0 ELSE false END AS archived,
         o_custkey % 4 <> 0 AS accessible
  FROM orders
), once AS (SELECT repository_full_name, any_value(archived) AS archived, any_value(accessible) AS accessible, count(*) AS n
            FROM status GROUP BY 1),
repos AS (
  SELECT CASE WHEN c_custkey % 50 <> 0 THEN 'owner' || c_custkey || '/repo' END AS repository_full_name,
         c_acctbal AS sloc, c_mktsegment AS language
  FROM customer
), joined AS (
  SELECT r.*, archived, accessible, coalesce(n, 1) AS n_lookups
  FROM repos r LEFT JOIN once s ON r.repository_full_name IS NOT DISTINCT FROM s.repository_full_name
)
"""


def classified_status(spark, sf_dir):
    return R.classify_status(_responses(spark, sf_dir))


def attached_status(spark, sf_dir):
    return R.attach_status(_repos(spark, sf_dir), R.classify_status(_responses(spark, sf_dir)), count_lookups=True)


def _with_status(spark, sf_dir):
    return R.attach_status(_repos(spark, sf_dir), R.classify_status(_responses(spark, sf_dir)))


def active_repos(spark, sf_dir):
    return R.active_repos(_with_status(spark, sf_dir))


def clone_manifest(spark, sf_dir):
    return R.clone_manifest(_with_status(spark, sf_dir), "/clones/", "https://example.org")


_MANIFEST_SQL = _STATUS_SQL + """
SELECT DISTINCT repository_full_name, split_part(repository_full_name, '/', 1) AS owner,
       split_part(repository_full_name, '/', 2) AS repo, '/clones/' || repository_full_name AS destination,
       'https://example.org/' || repository_full_name || '.git' AS url
FROM joined WHERE accessible AND NOT archived AND repository_full_name IS NOT NULL"""


def malformed_names(spark, sf_dir):
    """Page addresses are no ``owner/repo`` unless they have exactly one slash."""
    pages = table(spark, sf_dir, "pages").select(
        F.regexp_replace("url", "^https?://", "").alias(R.KEY))
    return R.malformed_names(pages)


def merged_tables(spark, sf_dir):
    """Customers, suppliers and nations under partly shared headers, and one of
    them twice."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("repository_full_name"), F.col("c_acctbal").alias("stars"))
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("repository_full_name"), F.col("s_nationkey").alias("forks"))
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("description"), F.col("n_nationkey").cast("bigint").alias("stars"))
    return R.merge_status_tables([customers, suppliers, nations, customers])


_MERGED_SQL = """
SELECT c_name AS repository_full_name, c_acctbal AS stars, NULL::INTEGER AS forks, NULL::VARCHAR AS description FROM customer
UNION SELECT s_name, NULL, s_nationkey, NULL FROM supplier
UNION SELECT NULL, CAST(n_nationkey AS DOUBLE), NULL, n_name FROM nation"""


def distinct_names(spark, sf_dir):
    return R.distinct_names(_repos(spark, sf_dir))


def first_orders(spark, sf_dir):
    """First order of each customer, by date then key."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    first = R.distinct_by_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", "o_orderkey", "o_totalprice")


def clean_headers(spark, sf_dir):
    cleaned = R.standardize_key(R.normalize_columns(_catalogue(spark, sf_dir)))
    return R.to_numeric_coerce(R.require_columns(cleaned, R.KEY), "stars")


QUERIES = {
    "clean_headers": (clean_headers, _CATALOGUE_SQL + "SELECT * FROM c"),
    "filtered_repos": (filtered_repos, _CATALOGUE_SQL + f"SELECT * FROM c WHERE {_POPULAR}"),
    "filter_report": (
        filter_report,
        _CATALOGUE_SQL + f"SELECT count(*) AS raw_rows, count(*) FILTER ({_POPULAR}) AS filtered_rows FROM c"),
    "classified_status": (classified_status, _STATUS_SQL + "SELECT * FROM status"),
    "attached_status": (attached_status, _STATUS_SQL + "SELECT * FROM joined"),
    "active_repos": (
        active_repos,
        _STATUS_SQL + "SELECT * EXCLUDE n_lookups FROM joined WHERE accessible AND NOT archived"),
    "clone_manifest": (clone_manifest, _MANIFEST_SQL),
    "malformed_names": (
        malformed_names,
        r"""SELECT DISTINCT regexp_replace(url, '^https?://', '') AS repository_full_name FROM pages
            WHERE len(string_split(regexp_replace(url, '^https?://', ''), '/')) <> 2"""),
    "merged_tables": (merged_tables, _MERGED_SQL),
    "distinct_names": (
        distinct_names,
        _STATUS_SQL + "SELECT DISTINCT repository_full_name FROM repos WHERE repository_full_name IS NOT NULL"),
    "first_orders": (
        first_orders,
        """SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
                  arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice
           FROM orders GROUP BY o_custkey"""),
}
