"""Which framework a repository uses, from the text of its files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from logharvest import dictionaries as D
from logharvest.functions.matching import first_term, first_terms, term_automaton
from logharvest.operators.catalogue import KEY
from logharvest.operators.layout import computed_once

MATCH_COLUMNS = [
    "matched_framework", "matched_term", "matched_file_name", "matched_file_path", "priority",
]


def with_repository(files: DataFrame, relative: str = "file_path") -> DataFrame:
    """Add ``owner/repo``, the first two folders of the relative path."""
    return files.withColumn(KEY, F.substring_index(relative, "/", 2))


def match_terms(
    files: DataFrame,
    terms: Sequence[tuple[str, str]] = tuple(D.FRAMEWORK_TERMS),
    mode: str = "file",
) -> DataFrame:
    """``(repository_full_name, path, priority, framework, term)``: the first term
    found in each file. Narrow: terms are compiled into the projection, so file
    texts are read once and never leave their task."""
    found = _hits(files, terms, mode).filter(F.col("hit").isNotNull())
    return found.select(KEY, "path", "hit.*")


def match_term_table(files: DataFrame, terms: DataFrame, mode: str = "file") -> DataFrame:
    """``match_terms`` with the dictionary as a table ``(priority, framework, term)`` of any size.

    The table is size-checked and built into one Aho–Corasick automaton,
    broadcast once; each text is lower-cased by Spark and read in one pass, and
    only the terms found are tried as patterns. Equal to the chain of patterns
    for the same terms (Python patterns in ASCII mode, which are Java's here).
    Null texts and priorities find nothing; equal priorities go by term.
    """
    import pickle

    rows = [(int(r[0]), r[1], r[2]) for r in terms.select("priority", "framework", "term").dropna().collect()]
    shipped = files.sparkSession.sparkContext.broadcast(term_automaton(rows, mode))
    lowered = files.select(KEY, "path", F.lower("content").alias("lowered"))
    key_type = lowered.schema[KEY].dataType.simpleString()
    path_type = lowered.schema["path"].dataType.simpleString()

    def scan(batches):
        import pandas as pd

        automaton, how = pickle.loads(shipped.value)
        patterns: dict = {}
        for batch in batches:
            hits = first_terms(batch["lowered"].tolist(), automaton, how, patterns)
            kept = [i for i, h in enumerate(hits) if h is not None]
            if not kept:
                continue
            yield pd.DataFrame({
                KEY: batch[KEY].iloc[kept].tolist(),
                "path": batch["path"].iloc[kept].tolist(),
                "priority": [hits[i][0] for i in kept],
                "framework": [hits[i][1] for i in kept],
                "term": [hits[i][2] for i in kept],
            })

    schema = f"{KEY} {key_type}, path {path_type}, priority bigint, framework string, term string"
    return lowered.mapInPandas(scan, schema)


def _hits(files: DataFrame, terms: Sequence[tuple[str, str]], mode: str) -> DataFrame:
    # Lower-cased once per file, not once per term, and searched once, not for
    # the test and for the result.
    lowered = computed_once(files.select(KEY, "path", "content"), "lowered", F.lower("content"))
    searched = computed_once(lowered, "hit", first_term("lowered", terms, mode))
    return searched.select(KEY, "path", "hit")


def first_match(
    files: DataFrame,
    terms: Sequence[tuple[str, str]] = tuple(D.FRAMEWORK_TERMS),
    mode: str = "file",
    keep_unmatched: bool = False,
) -> DataFrame:
    """One row per repository: its hit of the highest priority, by path on ties.

    Only (name, priority, path) is shuffled, after a map-side minimum, so a
    repository with a third of all files costs its reducer one row per task.
    """
    found = _hits(files, terms, mode)
    if not keep_unmatched:
        found = found.filter(F.col("hit").isNotNull())
    best = F.min(F.when(F.col("hit").isNotNull(), F.struct("hit.priority", "path", "hit"))).alias("best")
    return found.groupBy(KEY).agg(best).select(
        KEY,
        F.col("best.hit.framework").alias("matched_framework"),
        F.col("best.hit.term").alias("matched_term"),
        F.substring_index("best.path", "/", -1).alias("matched_file_name"),
        F.col("best.path").alias("matched_file_path"),
        F.col("best.priority").alias("priority"),
    )


def best_matches(results: DataFrame) -> DataFrame:
    """Merge partial results: per repository the best match over all of them."""
    rank = F.struct("priority", "matched_file_path")
    best = F.min_by(F.struct(*MATCH_COLUMNS), F.when(F.col("priority").isNotNull(), rank))
    return results.groupBy(KEY).agg(best.alias("best")).select(KEY, "best.*")


def as_search_results(matches: DataFrame, base_url: str = "https://github.com") -> DataFrame:
    """Matches in the columns of a hosting service's search answer: the path
    inside the repository and a link to it. A scan of stored files has no score."""
    path, name = F.col("matched_file_path"), F.col(KEY)
    inside = F.when(
        F.startswith(path, F.concat(name, F.lit("/"))), F.substr(path, F.length(name) + 2)
    ).otherwise(path)
    link = F.concat_ws("/", F.lit(base_url.rstrip("/")), F.col(KEY), F.lit("blob/HEAD"), inside)
    return matches.select(
        KEY, "matched_framework", "matched_term", "matched_file_name",
        inside.alias("matched_file_path"), link.alias("matched_html_url"),
        F.lit(None).cast("double").alias("score"),
    )


def scan_progress(repositories: DataFrame, results: DataFrame) -> DataFrame:
    """Repositories in total, processed and matched, and whether all are done.

    Derived from the stored results, so a batch that ran twice counts once.
    """
    total = repositories.select(KEY).dropna().distinct().withColumn("__wanted", F.lit(True))
    done = results.groupBy(KEY).agg(F.max(F.col("priority").isNotNull()).alias("__matched"))
    counts = total.join(done, KEY, "left").agg(
        F.count(F.lit(1)).alias("repositories"),
        F.count("__matched").alias("processed_repositories"),
        F.count_if("__matched").alias("matched_repositories"),
    )
    return counts.withColumn(
        "completed", F.col("processed_repositories") == F.col("repositories")
    )
