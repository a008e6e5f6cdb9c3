"""Tabulation of survey answers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logharvest import dictionaries as D
from logharvest.functions.text import percent_label, strip


# -- single and multiple choice ----------------------------------------------

def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(value, count)`` of the non-null answers, most frequent first."""
    counts = df.select(F.col(column).alias("value")).dropna().groupBy("value")
    return counts.agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value")


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Counts with their percentage of all non-null answers, and a label."""
    answered = df.select(F.count(F.col(column)).alias("n")).scalar()
    return _with_percent(value_counts(df, column), answered)


def multi_select_counts(df: DataFrame, column: str, sep: str = ";") -> DataFrame:
    """Counts of the options in ``;``-joined answers. Percentages are of the
    respondents who answered, so they can total more than 100."""
    answered = df.select(F.count(F.col(column)).alias("n")).scalar()
    options = df.select(F.explode(F.split(column, re.escape(sep))).alias("option"))
    return _with_percent(value_counts(options.select(strip("option").alias("option")), "option"), answered)


def _with_percent(counts: DataFrame, total: Column) -> DataFrame:
    percent = F.col("count").cast("double") / total * F.lit(100)
    shares = counts.withColumn("percent", percent)
    return shares.withColumn("label", percent_label("count", "percent"))


# -- headers -----------------------------------------------------------------

def simplify_header(
    header: str,
    smells: Sequence[str] = tuple(D.SMELLS),
    questions: Sequence[tuple[str, str]] = tuple(D.QUESTION_TYPES),
) -> str:
    """``Severity Heavy Logging`` for a long question about a smell; other headers stay."""
    text = " ".join(header.split()).lower()
    smell = next((s for s in smells if s.lower() in text), None)
    kind = next((label for pattern, label in questions if re.search(pattern, text)), None)
    return f"{kind} {smell}" if smell and kind else header


def simplify_headers(df: DataFrame, **dictionaries) -> DataFrame:
    """Rename by :func:`simplify_header`; a name that comes up again is numbered."""
    names, seen = [], {}
    for header in df.columns:
        name = simplify_header(header, **dictionaries)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return df.toDF(*names)


def metric_columns(columns: Sequence[str], metric: str, contains: bool = False,
                   without: Sequence[str] = ()) -> list[str]:
    """Columns that start with (or contain) ``metric`` and contain none of ``without``."""
    def fits(c: str) -> bool:
        return metric in c if contains else c.startswith(metric)

    return [c for c in columns if fits(c) and not any(w in c for w in without)]


# -- Likert scales -----------------------------------------------------------

def normalize_likert(
    df: DataFrame,
    normal_forms: Mapping[str, str] = D.LIKERT_NORMAL_FORMS,
    metrics: Sequence[str] = tuple(D.LIKERT_SCALES),
) -> DataFrame:
    """Replace raw answers by scale labels in the Likert columns only."""
    columns = [c for c in df.columns if c.startswith(tuple(metrics))]
    return df.replace(dict(normal_forms), subset=columns) if columns else df


def likert_long(df: DataFrame, metric: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``(topic, answer)`` of one metric; unanswered questions have a null answer."""
    columns = metric_columns(df.columns, metric) if columns is None else list(columns)
    # Back-quoted: a question may contain dots.
    quoted = [F.col(f"`{c}`") for c in columns]
    long = df.select(*quoted).unpivot([], quoted, "question", "answer")
    topic = F.replace(F.col("question"), F.lit(f"{metric} "), F.lit(""))
    return long.select(topic.alias("topic"), "answer")


def likert_options(df: DataFrame, metric: str, scale: Sequence[str] | None = None) -> DataFrame:
    """Options of the scale that were chosen at least once, in scale order."""
    scale = list(scale or D.LIKERT_SCALES[metric])
    rank = F.array_position(F.array(*[F.lit(o) for o in scale]), F.col("option"))
    chosen = likert_long(df, metric).select(F.col("answer").alias("option")).distinct()
    return chosen.select("option", rank.alias("rank")).filter(F.col("rank") > 0).orderBy("rank")


def likert_matrix(df: DataFrame, metric: str, options: Sequence[str] | None = None) -> DataFrame:
    """Counts, topics by options. Answers outside the options are not counted."""
    options = list(options or D.LIKERT_SCALES[metric])
    return likert_long(df, metric).groupBy("topic").agg(
        *[F.count_if(F.col("answer") == o).alias(o) for o in options]
    )


def likert_percent(df: DataFrame, metric: str, options: Sequence[str] | None = None) -> DataFrame:
    """The matrix with each row as percentages of its total; empty rows are zero."""
    options = list(options or D.LIKERT_SCALES[metric])
    total = sum((F.col(f"`{o}`") for o in options[1:]), F.col(f"`{options[0]}`"))
    total = F.greatest(total, F.lit(1))
    return likert_matrix(df, metric, options).select(
        "topic", *[(F.col(f"`{o}`").cast("double") / total * F.lit(100)).alias(o) for o in options]
    )


def likert_percent_of_answered(
    df: DataFrame, metric: str, options: Sequence[str],
    without: Sequence[str] = ("Severity", "Frequency"),
) -> DataFrame:
    """Older variant: columns containing ``metric``, percentages of all non-null
    answers, listed or not. The topic is what precedes the metric in the name."""
    columns = [F.col(f"`{c}`") for c in metric_columns(df.columns, metric, True, without)]
    long = df.select(*columns).unpivot([], columns, "question", "answer")
    topic = strip(F.substring_index("question", metric, 1))
    answered = F.count("answer")
    shares = [
        F.when(answered > 0, F.count_if(F.col("answer") == o).cast("double") / answered * F.lit(100))
        .otherwise(F.lit(0.0)).alias(o)
        for o in options
    ]
    return long.groupBy("question", topic.alias("topic")).agg(*shares).drop("question")


def unlisted_answers(df: DataFrame, metric: str, options: Sequence[str] | None = None) -> DataFrame:
    """Answers that fall off the scale and so are missing from the matrix."""
    options = list(options or D.LIKERT_SCALES[metric])
    return (
        likert_long(df, metric)
        .filter(F.col("answer").isNotNull() & ~F.col("answer").isin(options))
        .groupBy("topic", "answer")
        .agg(F.count(F.lit(1)).alias("count"))
    )
