"""Agreement of two annotators.

Everything is computed from counts: both sides are reduced to (id, category,
rating, n) before they meet, and a pair of rows is represented by the product
of its counts. Ids that repeat on both sides, or are null on both, therefore
weigh as many pairs as a row-by-row join would give without producing them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logharvest.functions.text import empty_bucket

OVERALL = "ALL"


def find_column_ci(columns: Sequence[str], candidates: str | Sequence[str]) -> str | None:
    """Column named like a candidate whatever the case, else one containing it."""
    candidates = [candidates] if isinstance(candidates, str) else list(candidates)
    lowered = {c.lower(): c for c in columns}
    exact = (lowered.get(c.lower()) for c in candidates)
    partial = (real for low, real in lowered.items() if any(c.lower() in low for c in candidates))
    return next((c for c in exact if c), None) or next(partial, None)


def require_column_ci(df: DataFrame, candidates: str | Sequence[str]) -> str:
    name = find_column_ci(df.columns, candidates)
    if name is None:
        raise ValueError(f"no column like {candidates!r} among {df.columns}")
    return name


def annotations(
    df: DataFrame,
    snippet_id: str = "snippet_id",
    rating: str = "Agreement",
    smell: Sequence[str] = ("smell", "smell_category", "category"),
    numeric: bool = False,
) -> DataFrame:
    """Annotation table with columns found by name -> ``(snippet_id, smell, rating)``.

    Ratings are compared as text; with ``numeric`` as numbers, so that 1 and 1.0 agree.
    """
    value = F.col(require_column_ci(df, rating))
    category = find_column_ci(df.columns, smell)
    return df.select(
        F.col(require_column_ci(df, snippet_id)).alias("snippet_id"),
        (F.col(category) if category else F.lit(None)).cast("string").alias("smell"),
        (value.cast("double") if numeric else value).cast("string").alias("rating"),
    )


def both_numeric(a: DataFrame, b: DataFrame, rating: str = "Agreement") -> bool:
    """Whether the ratings of both sides are numbers by type."""
    return all(isinstance(df.schema[require_column_ci(df, rating)].dataType, T.NumericType) for df in (a, b))


def pair_annotations(a: DataFrame, b: DataFrame, smell_from: str = "a") -> DataFrame:
    """``(snippet_id, smell, rating_a, rating_b, n_pairs)`` of matching ids."""
    def counted(df: DataFrame, side: str, with_smell: bool) -> DataFrame:
        keys = ["snippet_id", "rating"] + (["smell"] if with_smell else [])
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{side}"))
        return counts.withColumnsRenamed(
            {"snippet_id": f"id_{side}", "rating": f"rating_{side}"}
        )

    left, right = counted(a, "a", smell_from == "a"), counted(b, "b", smell_from == "b")
    return left.join(right, F.col("id_a").eqNullSafe(F.col("id_b"))).select(
        F.col("id_a").alias("snippet_id"), "smell", "rating_a", "rating_b",
        (F.col("n_a") * F.col("n_b")).alias("n_pairs"),
    )


def merge_annotations(a: DataFrame, b: DataFrame, on_a: str, on_b: str, null_ids: bool = False) -> DataFrame:
    """All columns of matching rows; names on both sides get ``_a`` and ``_b``.

    Equal rows of a side are folded first; ``n_pairs`` says how many row pairs
    a result row stands for (1 wherever ids are unique). Rows without an id are
    left out; with ``null_ids`` they match each other, every one on one side
    every one on the other (as many rows as the product of their numbers).
    """
    if not null_ids:
        a, b = a.dropna(subset=[on_a]), b.dropna(subset=[on_b])
    shared = (set(a.columns) & set(b.columns)) - ({on_a} if on_a == on_b else set())

    def folded(df: DataFrame, side: str, on: str) -> tuple[DataFrame, list[str]]:
        counts = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(f"__n_{side}"))
        names = [f"{c}_{side}" if c in shared else c for c in df.columns]
        inner = [f"__{side}_{i}" for i in range(len(names))]
        return counts.toDF(*inner, f"__n_{side}"), names

    left, names_a = folded(a, "a", on_a)
    right, names_b = folded(b, "b", on_b)
    key_a, key_b = f"__a_{a.columns.index(on_a)}", f"__b_{b.columns.index(on_b)}"
    out = [F.col(f"__a_{i}").alias(n) for i, n in enumerate(names_a)]
    out += [
        F.col(f"__b_{i}").alias(n) for i, n in enumerate(names_b)
        if not (on_a == on_b and n == on_b)
    ]
    joined = left.join(right, F.col(key_a).eqNullSafe(F.col(key_b)))
    return joined.select(*out, (F.col("__n_a") * F.col("__n_b")).alias("n_pairs"))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def both_present(pairs: DataFrame, a: str = "rating_a", b: str = "rating_b") -> DataFrame:
    return pairs.dropna(subset=[a, b])


def disagreements(
    pairs: DataFrame, a: str = "rating_a", b: str = "rating_b", numeric: bool | None = None
) -> DataFrame:
    """Pairs whose ratings differ: as numbers, as text, or (None) as the columns' types have it."""
    kind = {None: None, True: "double", False: "string"}[numeric]
    left, right = (F.col(c) if kind is None else F.col(c).cast(kind) for c in (a, b))
    return both_present(pairs, a, b).filter(left != right)


def _kappa(groups: Sequence[str], contingency: DataFrame, min_samples: int) -> DataFrame:
    """Kappa per group from ``(groups…, rating_a, rating_b, n)``.

    With n pairs, g agreements and S = Σ n_a(c)·n_b(c) over labels c, kappa is
    (n·g − S) / (n² − S). The sums are kept as decimals, so the only rounding
    is the final division. A single label gives 0/0, that is null.
    """
    def side(label: str, for_a: Column, for_b: Column, agree: Column) -> Column:
        return F.struct(F.col(label).alias("label"), for_a.alias("n_a"), for_b.alias("n_b"),
                        agree.alias("agree"))

    n, zero = F.col("n"), F.lit(0).cast("bigint")
    same = F.when(F.col("rating_a") == F.col("rating_b"), n).otherwise(zero)
    marginals = (
        contingency.select(
            *groups,
            F.explode(F.array(side("rating_a", n, zero, same), side("rating_b", zero, n, zero))).alias("m"),
        )
        .groupBy(*groups, "m.label")
        .agg(*[F.sum(f"m.{c}").alias(c) for c in ("n_a", "n_b", "agree")])
    )

    def wide(c: Column) -> Column:
        return c.cast("decimal(18,0)")

    sums = marginals.groupBy(*groups).agg(
        F.sum("n_a").alias("n_samples"),
        F.sum("agree").alias("agree"),
        F.sum(wide(F.col("n_a")) * wide(F.col("n_b"))).alias("by_chance"),
    )
    pairs = wide(F.col("n_samples"))
    above = pairs * wide(F.col("agree")) - F.col("by_chance")
    possible = pairs * pairs - F.col("by_chance")
    kappa = F.try_divide(above.cast("double"), possible.cast("double"))
    return sums.select(
        *groups, "n_samples", F.when(F.col("n_samples") >= min_samples, kappa).alias("kappa")
    )


def _contingency(pairs: DataFrame) -> DataFrame:
    return (
        both_present(pairs)
        .groupBy(empty_bucket("smell").alias("smell"), "rating_a", "rating_b")
        .agg(F.sum("n_pairs").alias("n"))
    )


def cohen_kappa(pairs: DataFrame, min_samples: int = 2) -> DataFrame:
    """Overall kappa: one row ``(n_samples, kappa)``."""
    counts = both_present(pairs).groupBy("rating_a", "rating_b").agg(F.sum("n_pairs").alias("n"))
    one_group = counts.withColumn("smell", F.lit(OVERALL))
    return _kappa(["smell"], one_group, min_samples).drop("smell")


def cohen_kappa_by(pairs: DataFrame, min_samples: int = 2) -> DataFrame:
    """Kappa per category, the overall row (``ALL``) first.

    The overall figures are built from the category counts, so the annotations
    are aggregated once.
    """
    overall = F.struct(F.lit(0).alias("part"), F.lit(OVERALL).alias("smell"))
    category = F.struct(F.lit(1).alias("part"), F.col("smell").alias("smell"))
    counts = _contingency(pairs).select(
        F.explode(F.array(overall, category)).alias("g"), "rating_a", "rating_b", "n"
    ).select("g.*", "rating_a", "rating_b", "n")
    return _kappa(["part", "smell"], counts, min_samples).orderBy("part", "smell").drop("part")


def agreement_metadata(
    a: DataFrame, b: DataFrame, pairs: DataFrame, file_a: str | None = None, file_b: str | None = None
) -> DataFrame:
    """Rows of either side, row pairs, and pairs with both ratings; the files' names where given."""
    names = [F.lit(v).alias(k) for k, v in (("file_a", file_a), ("file_b", file_b)) if v is not None]
    def rows(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    rated = F.col("rating_a").isNotNull() & F.col("rating_b").isNotNull()
    return pairs.agg(
        F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("rows_merged_after_join"),
        F.coalesce(F.sum(F.when(rated, F.col("n_pairs"))), F.lit(0)).alias("rows_with_both_agreement"),
    ).select(
        *names, rows(a).alias("rows_file_a"), rows(b).alias("rows_file_b"),
        "rows_merged_after_join", "rows_with_both_agreement",
    )


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Ids annotated more than once; they weigh more than once in kappa."""
    return df.groupBy("snippet_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
