"""Two annotation tables -> kappa, metadata and disagreements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logharvest.operators import agreement as A
from logharvest.session import stored
from logharvest.sources import sinks
from logharvest.sources.tables import read_annotations


def compute_kappa(
    a: DataFrame, b: DataFrame, min_samples: int = 2, files: tuple[str | None, str | None] = (None, None),
    null_ids: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kappa by smell, metadata, disagreeing rows with all their columns).

    Rows without an id count in kappa; they are listed as disagreeing, in all
    their combinations, only with ``null_ids``.
    """
    side = "a" if A.find_column_ci(a.columns, ("smell", "smell_category", "category")) else "b"
    numeric = A.both_numeric(a, b)
    left, right = A.annotations(a, numeric=numeric), A.annotations(b, numeric=numeric)
    # Stored: two checks and two results read it.
    pairs = stored(A.pair_annotations(left, right, smell_from=side), "pairs")
    A.require_rows(pairs, "no matching snippet_id rows")
    A.require_rows(A.both_present(pairs), "no rows with both ratings")

    id_a, id_b = (A.require_column_ci(df, "snippet_id") for df in (a, b))
    rating_a, rating_b = (A.require_column_ci(df, "Agreement") for df in (a, b))
    # Rows without a rating cannot disagree.
    merged = A.merge_annotations(a.dropna(subset=[rating_a]), b.dropna(subset=[rating_b]), id_a, id_b, null_ids)
    clash = rating_a == rating_b
    name_a = f"{rating_a}_a" if clash else rating_a
    name_b = f"{rating_b}_b" if clash else rating_b
    return (
        A.cohen_kappa_by(pairs, min_samples),
        A.agreement_metadata(left, right, pairs, *files),
        A.disagreements(merged, name_a, name_b, numeric),
    )


def write_kappa_study(spark: SparkSession, file_a: str, file_b: str, target: str, min_samples: int = 2) -> None:
    a, b = read_annotations(spark, file_a, file_b)
    sinks.write_kappa(*compute_kappa(a, b, min_samples, (file_a, file_b)), target)
