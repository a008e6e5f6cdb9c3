"""Catalogue -> selected repositories -> status -> what to clone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from logharvest.operators import catalogue as R
from logharvest.sources import sinks
from logharvest.sources.tables import read_catalogue_parquet, read_many_csv


def select_repositories(spark: SparkSession, catalogue: str, raw: str, filtered: str, min_stars: float) -> DataFrame:
    """Store the catalogue as it is and its popular Python part; returns both counts."""
    repos = R.standardize_key(R.normalize_columns(read_catalogue_parquet(spark, catalogue)))
    sinks.write_csv(repos, raw)
    sinks.write_csv(R.filter_repos(repos, min_stars), filtered)
    return R.filter_report(repos, min_stars)


def collect_status(repos: DataFrame, responses: DataFrame, target: str) -> None:
    """Add the stored status answers to a repository table."""
    R.require_columns(repos, R.KEY)
    sinks.write_csv(R.attach_status(repos, R.classify_status(responses)), target)


def merge_archived(spark: SparkSession, paths: Sequence[str], target: str) -> None:
    """Unite tables with status. Paths are explicit, so an earlier result in the
    same folder is never read back by accident."""
    sinks.write_csv(read_many_csv(spark, paths).dropDuplicates(), target)


def manifest(repos: DataFrame, root: str) -> DataFrame:
    return R.clone_manifest(repos, root)
