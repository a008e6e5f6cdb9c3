"""Reproducible sampling.

Rows are ordered by a keyed hash of their id instead of a random number: the
same seed gives the same rows whatever the partitioning, a retried task
included, and any SQL engine can check the choice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from logharvest import dictionaries as D
from logharvest.functions.text import id_columns
from logharvest.session import stored

Plan = Sequence[tuple[str, "str | None", int]]


def sample_key(id_col: Column | str, seed: int) -> Column:
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}|"), id_col.cast("string")))


def top_per_group(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    quota: Column | int,
    bound: int | None = None,
    spread: int = 32,
) -> DataFrame:
    """First ``quota`` rows of each group with their ``rank``, in two rounds.

    Round one ranks within (group, salt), so a group that holds a third of the
    table is ranked by ``spread`` tasks; a row outside the quota there is
    outside it in the group, so only ``spread × quota`` rows per group meet in
    round two. A literal ``bound`` on the quota lets Spark also cut every map
    output to it before the shuffle.
    """
    quota = F.lit(quota) if isinstance(quota, int) else quota

    def cut(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        kept = ranked.filter(F.col("rank") <= quota)
        return kept if bound is None else kept.filter(F.col("rank") <= F.lit(bound))

    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(spread)))
    return cut(cut(salted, [*groups, "__salt"]).drop("__salt", "rank"), groups)


def merge_strata(df: DataFrame, level: str = "log_level") -> DataFrame:
    """Lower-case levels; ``warn`` is ``warning``."""
    lowered = F.lower(level)
    return df.withColumn(level, F.when(lowered == "warn", "warning").otherwise(lowered))


def _strata(plan: Plan) -> list[tuple[str, str | None, int]]:
    """The plan in drawing order: warnings come first."""
    first = [p for p in plan if p[0] == "logging" and p[1] == "warning"]
    return first + [p for p in plan if p not in first]


def _stratum(strata: Plan, library: Column, level: Column) -> Column:
    """Number of the first stratum a row belongs to, null outside the plan.

    Looked up in a literal map, so level and library are evaluated once instead
    of once per stratum. A stratum without a level takes its whole library.
    """
    def lookup(keys: list[tuple[str, int]], key: Column) -> Column:
        if not keys:
            return F.lit(None).cast("int")
        literal = F.create_map(*[F.lit(x) for pair in keys for x in pair])
        return F.try_element_at(literal, key)

    numbered = list(enumerate(strata))
    exact = [(f"{lib}|{lvl.lower()}", i) for i, (lib, lvl, _) in numbered if lvl is not None]
    whole = [(lib, i) for i, (lib, lvl, _) in numbered if lvl is None]
    return F.least(lookup(exact, F.concat(library, F.lit("|"), level)), lookup(whole, library))


def _quota(strata: Plan, stratum: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for _, _, n in strata]), stratum)


def stratified_sample(
    ids: DataFrame, plan: Plan = tuple(D.SAMPLE_PLAN), seed: int = 42, id_col: str | None = None
) -> DataFrame:
    """Up to the planned number of ids per (library, level); groups not larger
    than their quota are kept whole, strata outside the plan are left out.

    An id found in several strata belongs to the first one, so the sample never
    holds an id twice.
    """
    id_col = id_col or id_columns(ids)[0]
    columns, strata = ids.columns, _strata(plan)
    df = merge_strata(ids)
    stratum = _stratum(strata, F.col("library"), F.col("log_level"))
    once = (
        df.withColumn("__stratum", stratum)
        .filter(F.col("__stratum").isNotNull())
        .groupBy(id_col)
        .agg(F.min(F.struct("__stratum", *[c for c in columns if c != id_col])).alias("__row"))
        .select(id_col, "__row.*")
    )
    order = [sample_key(id_col, seed), F.col(id_col)]
    bound = max(n for _, _, n in plan)
    quota = _quota(strata, F.col("__stratum"))
    return top_per_group(once, ["__stratum"], order, quota, bound).select(*columns)


def quota_violations(sample: DataFrame, plan: Plan = tuple(D.SAMPLE_PLAN)) -> DataFrame:
    """Strata above their quota; empty for every sample drawn with the plan."""
    strata = _strata(plan)
    limit = _quota(strata, _stratum(strata, F.col("library"), F.col("log_level")))
    return (
        merge_strata(sample)
        .groupBy("library", "log_level")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > F.coalesce(limit, F.lit(0)))
    )


def add_default_column(df: DataFrame, name: str = "selected", value: str = "no") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def _common_id(a: DataFrame, b: DataFrame) -> str:
    return next(c for c in id_columns(a) if c in b.columns)


def flag_selected(df: DataFrame, chosen: DataFrame, id_col: str | None = None) -> DataFrame:
    """``selected = 'yes'`` where the id was chosen; other rows keep their flag."""
    id_col = id_col or _common_id(df, chosen)
    marks = chosen.select(F.col(id_col).alias("__id")).distinct().withColumn("__hit", F.lit(True))
    flagged = df.join(marks, F.col(id_col) == F.col("__id"), "left")
    selected = F.when(F.col("__hit"), "yes").otherwise(F.col("selected"))
    return flagged.withColumn("selected", selected).select(*df.columns)


def balanced_sample(
    df: DataFrame, size: int = D.LABEL_SAMPLE_SIZE, seed: int = 42, id_col: str | None = None,
    group: str = "library",
) -> DataFrame:
    """Ids spread evenly over libraries, then filled at random up to ``size``.

    Each library gives up to ``max(1, size // #libraries)`` ids, so the result
    may exceed ``size`` when libraries outnumber it. Only ids not yet selected
    take part.

    Both steps take ids in key order, so every id they can take is among the
    first ``size`` of its library; all else is settled on those few.
    """
    id_col = id_col or id_columns(df)[0]
    ids = list(dict.fromkeys([id_col, *id_columns(df)]))
    open_rows = (
        add_default_column(df).filter(F.col("selected") == "no")
        .select(group, *ids, sample_key(id_col, seed).alias("__key"))
    )
    order = [F.col("__key"), F.col(id_col)]
    # At most ``size`` rows per group, read by three branches.
    nearest = stored(top_per_group(open_rows, [group], order, size, bound=size), "nearest")

    def count(condition: Column) -> Column:
        return nearest.agg(F.count_if(condition).alias("n")).scalar()

    # Integer division; a library has exactly one row of rank 1.
    quota = F.greatest(F.lit(1), F.floor(F.lit(size) / count(F.col("rank") == 1)))
    # Ids without a library count as one when sharing, but are only used to fill.
    even = F.col(group).isNotNull() & (F.col("rank") <= quota)
    missing = F.lit(size) - count(even)
    # Top-k of what is left, then ranked: at most ``size`` rows reach the window.
    spare = nearest.filter(~even).orderBy(*order).limit(size)
    filled = spare.withColumn("rank", F.row_number().over(Window.orderBy(*order))).filter(
        F.col("rank") <= missing
    )
    return nearest.filter(even).select(*ids).unionByName(filled.select(*ids))


def exclude_used(df: DataFrame, used: DataFrame, on: str | None = None) -> DataFrame:
    """Rows whose id is not in ``used``."""
    on = on or _common_id(df, used)
    return df.join(used.select(on).distinct(), on, "left_anti")


def last_wins(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """One value per key: the one that comes last in ``order``."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def functions_for_ids(
    calls: DataFrame, ids: DataFrame, order: Sequence[str] = ("file_path", "position")
) -> DataFrame:
    """Function text of the chosen calls; the last one stored wins."""
    key = _common_id(calls, ids)
    wanted = calls.filter(F.col("function") != "").join(ids.select(key), key, "left_semi")
    shown = [F.any_value(c).alias(c) for c in id_columns(calls) if c != key]
    return wanted.groupBy(key).agg(*shown, F.max_by("function", F.struct(*order)).alias("function"))
