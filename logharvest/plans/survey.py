"""Survey export -> one table per question type."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logharvest import dictionaries as D
from logharvest.operators import survey as S


def clean_survey(raw: DataFrame) -> DataFrame:
    """Short headers, Likert answers on their scales."""
    return S.normalize_likert(S.simplify_headers(raw))


def likert_tables(clean: DataFrame) -> dict[str, DataFrame]:
    """Percentages per metric, for each metric the survey asked about."""
    return {
        metric: S.likert_percent(clean, metric)
        for metric in D.LIKERT_SCALES
        if S.metric_columns(clean.columns, metric)
    }
