"""Repository catalogue: cleaning, selection, status, clone manifest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logharvest.functions.text import to_number
from logharvest.operators.layout import with_row_index

KEY = "repository_full_name"


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def standardize_key(df: DataFrame, source: str = "full_name", target: str = KEY) -> DataFrame:
    """Rename the name column unless the target is there already."""
    if source in df.columns and target not in df.columns:
        return df.withColumnRenamed(source, target)
    return df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return df


def to_numeric_coerce(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: to_number(n) for n in names})


def _is_python(language: str, stars: str, min_stars: float) -> Column:
    language = F.lower(F.col(language).cast("string"))
    # "Not a number" is above every threshold for Spark; a catalogue means "unknown".
    known = ~F.isnan(stars)
    return F.contains(language, F.lit("python")) & known & (F.col(stars) > min_stars)


def filter_repos(
    df: DataFrame, min_stars: float, language: str = "language", stars: str = "stars"
) -> DataFrame:
    """Repositories whose language mentions Python, with more than ``min_stars`` stars."""
    cleaned = standardize_key(normalize_columns(df))
    return to_numeric_coerce(cleaned, stars).filter(_is_python(language, stars, min_stars))


def filter_report(
    df: DataFrame, min_stars: float, language: str = "language", stars: str = "stars"
) -> DataFrame:
    """Rows before and after :func:`filter_repos`, in one pass."""
    cleaned = to_numeric_coerce(standardize_key(normalize_columns(df)), stars)
    return cleaned.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(_is_python(language, stars, min_stars)).alias("filtered_rows"),
    )


def classify_status(responses: DataFrame) -> DataFrame:
    """Stored answers of the hosting service -> ``(name, archived, accessible)``."""
    found = F.coalesce(F.col("status_code") == 200, F.lit(False))
    return responses.select(
        KEY,
        F.when(found, F.coalesce("archived", F.lit(False))).alias("archived"),
        found.alias("accessible"),
    )


def attach_status(
    repos: DataFrame, status: DataFrame, key: str = KEY, count_lookups: bool = False
) -> DataFrame:
    """Left join of the status on the name; null names match null names.

    The status is reduced to one row per name first (an accessible observation
    wins), so repeated names do not multiply. ``count_lookups`` adds
    ``n_lookups``, the number of rows a plain join would have made of each row,
    as a number instead of as copies.
    """
    # Both flags in one number, null < false < true each: a hash aggregate keeps
    # numbers, but would have to sort the table for structs.
    def code(flag: str, weight: int) -> Column:
        return F.when(F.col(flag), 2 * weight).when(~F.col(flag), weight).otherwise(0)

    def flag(digit: Column) -> Column:
        return F.when(digit == 2, True).when(digit == 1, False)

    best = F.max(code("accessible", 3) + code("archived", 1)).alias("__best")
    once = status.groupBy(F.col(key).alias("__key")).agg(best, F.count(F.lit(1)).alias("__n"))
    joined = repos.join(once, F.col(key).eqNullSafe(F.col("__key")), "left")
    columns = [
        *repos.columns,
        flag(F.col("__best") % 3).alias("archived"),
        flag(F.floor(F.col("__best") / 3)).alias("accessible"),
    ]
    if count_lookups:
        columns.append(F.coalesce("__n", F.lit(1)).alias("n_lookups"))
    return joined.select(*columns)


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing in a table are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_status_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of differently headed tables, whole-row duplicates removed."""
    return union_all(tables).dropDuplicates()


def active_repos(df: DataFrame) -> DataFrame:
    """Accessible and not archived; a column that is absent is not tested."""
    if "accessible" in df.columns:
        df = df.filter(F.col("accessible"))
    if "archived" in df.columns:
        df = df.filter(~F.col("archived"))
    return df


def distinct_names(df: DataFrame, key: str = KEY) -> DataFrame:
    return require_columns(df, key).select(key).dropna().distinct()


def distinct_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key; with ``order`` the first row in it, else any."""
    if order is None:
        return df.dropDuplicates(list(keys))
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(first).select(*keys, "__row.*").select(*df.columns)


def clone_manifest(df: DataFrame, root: str, base_url: str = "https://github.com") -> DataFrame:
    """What to clone where: distinct names ``owner/repo`` of active repositories."""
    parts = F.split(KEY, "/")
    names = distinct_names(active_repos(df)).filter(F.size(parts) == 2)
    return names.select(
        KEY,
        parts[0].alias("owner"),
        parts[1].alias("repo"),
        F.concat_ws("/", F.lit(root.rstrip("/")), F.col(KEY)).alias("destination"),
        F.concat(F.lit(base_url.rstrip("/") + "/"), F.col(KEY), F.lit(".git")).alias("url"),
    )


def malformed_names(df: DataFrame) -> DataFrame:
    """Names of active repositories that are not ``owner/repo``."""
    return distinct_names(active_repos(df)).filter(F.size(F.split(KEY, "/")) != 2)


def next_batch(df: DataFrame, key: str, size: int, after: str | None = None) -> DataFrame:
    """The ``size`` rows that follow ``after`` in key order.

    The position is a key, not a row number: the filter reaches the scan and
    each task keeps ``size`` rows, however far the work has come.
    """
    if after is not None:
        df = df.filter(F.col(key) > F.lit(after))
    return df.orderBy(key).limit(size)


# Items a quantile sketch keeps: its rank error is about 1.65 / SKETCH_K of the rows.
SKETCH_K = 8192


def batch_slice(df: DataFrame, order: Sequence[str], start: int, size: int) -> DataFrame:
    """Rows ``start`` to ``start + size - 1`` in the given order (nulls first), for
    work that counts its position in rows. :func:`next_batch` does without ranks.

    With a numeric first column, a KLL sketch of it (one aggregation) gives
    values around the wanted ranks with a margin of twice its error; exact counts
    below and up to them confirm the bracket (else it widens to the end), and
    only the rows inside it, a share of about ``4 / SKETCH_K`` besides the slice,
    are sorted. Ties are exact: the bracket is by value. Other first columns:
    the whole table is sorted in ranges (``with_row_index``).
    """
    first = F.col(order[0])
    kind = df.schema[order[0]].dataType.simpleString()
    if size <= 0:
        return df.limit(0)
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not kind.startswith("decimal"):
        inside = F.col("__index").between(start, start + size - 1)
        return with_row_index(df, order, "__index").filter(inside).drop("__index")
    value = first.cast("double")
    found = df.agg(
        F.count(F.lit(1)).alias("n"), F.count(first).alias("valued"),
        F.kll_sketch_agg_double(value, F.lit(SKETCH_K)).alias("sketch"),
    ).first()
    nulls, valued = found.n - found.valued, found.valued
    lo_rank, hi_rank = start - nulls, start + size - 1 - nulls  # among the rows with a value
    if start >= found.n:
        return df.limit(0)
    if hi_rank < 0 or valued == 0:
        return df.where(first.isNull()).orderBy(*order).offset(start).limit(size)
    margin = 2 * (1.65 / SKETCH_K) * valued + 1
    bounds = df.sparkSession.createDataFrame([(found.sketch,)], "s binary").select(
        F.kll_sketch_get_quantile_double("s", F.lit(min(1.0, max(0.0, (lo_rank - margin) / valued)))).alias("lo"),
        F.kll_sketch_get_quantile_double("s", F.lit(min(1.0, max(0.0, (hi_rank + margin) / valued)))).alias("hi"),
    ).first()
    lo = None if lo_rank - margin <= 0 else bounds.lo
    hi = None if hi_rank + margin >= valued else bounds.hi
    counts = df.agg(
        F.count(F.when(value < lo, 1)).alias("below") if lo is not None else F.lit(0).alias("below"),
        F.count(F.when(value <= hi, 1)).alias("upto") if hi is not None else F.lit(valued).alias("upto"),
    ).first()
    if counts.below > max(lo_rank, 0):
        lo, counts = None, counts.asDict() | {"below": 0}
    else:
        counts = counts.asDict()
    if counts["upto"] < hi_rank + 1:
        hi = None
    keep = F.lit(True) if lo is None else value >= lo
    if hi is not None:
        keep = keep & (value <= hi)
    if lo_rank < 0:
        keep = keep | first.isNull()
        skip = start
    else:
        keep = keep & first.isNotNull()
        skip = lo_rank - counts["below"]
    return df.where(keep).orderBy(*order).offset(skip).limit(size)
