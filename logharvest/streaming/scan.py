"""Resumable framework scan: files arrive, each repository keeps its best match.

Progress lives in the streaming checkpoint, results in one folder per
micro-batch. A repository may arrive in pieces, so a batch stores its best match
so far and the reader takes the best over all batches; that makes the outcome
independent of how the files were cut into batches, and makes re-running a
batch after a failure harmless, because it overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logharvest import dictionaries as D
from logharvest.operators.catalogue import KEY
from logharvest.operators.frameworks import MATCH_COLUMNS, best_matches, first_match
from logharvest.schemas import FRAMEWORK_MATCHES
from logharvest.sources.tables import read_parquet_if_any


def scan_frameworks(
    files: DataFrame,
    output: str,
    checkpoint: str,
    terms: Sequence[tuple[str, str]] = tuple(D.FRAMEWORK_TERMS),
    mode: str = "file",
) -> StreamingQuery:
    """Scan a stream of ``(repository_full_name, path, content)`` and stop when
    everything available has been read. Start it again to continue.

    The batch size is set where the stream is opened (``maxFilesPerTrigger``).
    Both folders must be on storage every executor reaches.
    """
    target = output.rstrip("/")

    def store(batch: DataFrame, batch_id: int) -> None:
        results = first_match(batch, terms, mode, keep_unmatched=True)
        results.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        files.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def scan_results(spark: SparkSession, output: str) -> DataFrame:
    """Every repository seen, with its best match; nulls where there is none."""
    schema = FRAMEWORK_MATCHES + ", batch_id BIGINT"
    stored = read_parquet_if_any(spark, output, schema)
    return best_matches(spark.createDataFrame([], schema) if stored is None else stored)


def framework_matches(spark: SparkSession, output: str) -> DataFrame:
    """Matched repositories only."""
    return scan_results(spark, output).filter(F.col("priority").isNotNull())


# Keys a repository's files are dealt over, so that a repository with a third of
# all files is worked on by that many tasks; the reader merges their bests.
SCAN_SALTS = 16


def scan_frameworks_with_state(
    files: DataFrame,
    output: str,
    checkpoint: str,
    terms: Sequence[tuple[str, str]] = tuple(D.FRAMEWORK_TERMS),
    mode: str = "file",
) -> StreamingQuery:
    """The scan of :func:`scan_frameworks` with each repository's best match so
    far as keyed state (``applyInPandasWithState``), so that files which cannot
    beat it are not searched.

    State per (repository, salt of the path): the best (priority, path) found so
    far and counts of files searched and skipped. A file is searched only if it
    could still win: while the best has priority 0, files of a greater path are
    skipped, and within a batch files are searched in path order. The result is
    that of searching every file. Each micro-batch writes the state rows it
    changed to its own folder, which a re-run overwrites; progress and state live
    in the checkpoint, so a stopped scan started again continues where it was
    and gives the same table. Read it with :func:`scan_state_results`. Null
    texts find nothing; a repository of unmatched files has a row of nulls.
    """
    import pickle

    from pyspark.sql.streaming.state import GroupStateTimeout

    from logharvest.functions.matching import term_automaton

    rows = [(i, framework, term) for i, (framework, term) in enumerate(terms)]
    automaton = term_automaton(rows, mode)
    best_possible = min((r[0] for r in rows), default=0)
    target = output.rstrip("/")
    key_type = files.schema[KEY].dataType.simpleString()
    salted = files.select(
        KEY, "path", F.lower("content").alias("lowered"),
        F.pmod(F.xxhash64("path"), F.lit(SCAN_SALTS)).cast("int").alias("salt"),
    )
    state_schema = "priority bigint, path string, framework string, term string, searched bigint, skipped bigint"
    out_schema = (f"{KEY} {key_type}, salt int, matched_framework string, matched_term string, "
                  "matched_file_name string, matched_file_path string, priority bigint, "
                  "files_searched bigint, files_skipped bigint")

    def update(key, batches, state):
        import pandas as pd

        from logharvest.functions.matching import first_terms

        found, how = pickle.loads(automaton)
        patterns: dict = {}
        best = state.get if state.exists else (None, None, None, None, 0, 0)
        priority, path, framework, term, searched, skipped = best
        rank = lambda p: (0, "") if p is None else (1, p)  # a null path comes first, as in Spark
        for batch in batches:
            for p, text in sorted(zip(batch["path"], batch["lowered"]), key=lambda r: rank(r[0])):
                if priority is not None and priority <= best_possible and rank(p) >= rank(path):
                    skipped += 1
                    continue
                searched += 1
                hit = first_terms([text], found, how, patterns)[0]
                if hit is not None and (priority is None or (hit[0], rank(p)) < (priority, rank(path))):
                    priority, framework, term, path = hit[0], hit[1], hit[2], p
        state.update((priority, path, framework, term, searched, skipped))
        yield pd.DataFrame({
            KEY: [key[0]], "salt": [key[1]], "matched_framework": [framework], "matched_term": [term],
            "matched_file_name": [None if path is None else path.rsplit("/", 1)[-1]],
            "matched_file_path": [path], "priority": [priority],
            "files_searched": [searched], "files_skipped": [skipped],
        })

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    changed = salted.groupBy(KEY, "salt").applyInPandasWithState(
        update, out_schema, state_schema, "update", GroupStateTimeout.NoTimeout)
    return (
        changed.writeStream.foreachBatch(store).outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def scan_state_results(spark: SparkSession, output: str) -> DataFrame:
    """Per repository its best match, from the last state row of each salt;
    with ``files_searched`` and ``files_skipped`` over its salts."""
    stored = read_parquet_if_any(spark, output)
    if stored is None:
        return best_matches(spark.createDataFrame([], FRAMEWORK_MATCHES)).withColumns(
            {"files_searched": F.lit(0).cast("bigint"), "files_skipped": F.lit(0).cast("bigint")})
    columns = [c for c in stored.columns if c not in (KEY, "salt", "batch_id")]
    last = stored.groupBy(KEY, "salt").agg(F.max_by(F.struct(*columns), "batch_id").alias("r")).select(KEY, "r.*")
    best = F.min_by(F.struct(*MATCH_COLUMNS), F.when(F.col("priority").isNotNull(),
                                                     F.struct("priority", "matched_file_path")))
    return last.groupBy(KEY).agg(
        best.alias("best"), F.sum("files_searched").alias("files_searched"),
        F.sum("files_skipped").alias("files_skipped"),
    ).select(KEY, "best.*", "files_searched", "files_skipped")
