"""Framework search. Documents and pages are the files, words are the terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import CORPUS_SQL, source_files, table, texts
from logharvest.operators import catalogue as R
from logharvest.operators import frameworks as M
from logharvest.session import stored, work_folder
from logharvest.sources import sinks
from logharvest.streaming import scan

# Rare words of the generated prose first, so that most priorities win somewhere.
TERMS = [
    ("alpha", "license"), ("beta", "password"), ("beta", "email"), ("gamma", "sich"),
    ("delta", "que"), ("epsilon", "where"), ("epsilon", "which"), ("zeta", "the"),
]
PATTERN = r"(?i)(^|[^A-Za-z0-9_]){}($|[^A-Za-z0-9_])"


def files(spark, sf_dir):
    """Documents: one repository per source and language."""
    return texts(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", "lang").alias(R.KEY),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"),
                 F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.col("text").alias("content"),
    )


_FILES_SQL = """
WITH f AS (SELECT source || '/' || lang AS repository_full_name,
                  source || '/' || lang || '/' || doc_id || '.py' AS path, text FROM documents)
"""


def _first_hit(text: str) -> str:
    arms = " ".join(
        f"WHEN regexp_matches({text}, '{PATTERN.format(term)}') THEN {i}" for i, (_, term) in enumerate(TERMS))
    return f"CASE {arms} END"


_HITS_SQL = _FILES_SQL + f""", h AS (
  SELECT repository_full_name, path, {_first_hit('text')} AS priority FROM f
), t AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{f}', '{t}')" for i, (f, t) in enumerate(TERMS))}) AS v(p, framework, term))
"""

_BEST_SQL = _HITS_SQL + """, best AS (
  SELECT * FROM (SELECT h.*, t.framework, t.term,
                        row_number() OVER (PARTITION BY repository_full_name ORDER BY priority, path) AS rn
                 FROM h JOIN t ON priority = p) WHERE rn = 1
)
"""
_MATCH_SELECT = """
SELECT repository_full_name, framework AS matched_framework, term AS matched_term,
       list_extract(string_split(path, '/'), -1) AS matched_file_name, path AS matched_file_path,
       CAST(priority AS BIGINT) AS priority
FROM best"""


def _shown(df):
    return df.withColumn("priority", F.col("priority").cast("bigint"))


def term_matches(spark, sf_dir):
    return _shown(M.match_terms(files(spark, sf_dir), TERMS))


def term_table_matches(spark, sf_dir):
    """``term_matches`` with the terms given as a table."""
    terms = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TERMS)], "priority long, framework string, term string")
    return _shown(M.match_term_table(files(spark, sf_dir), terms))


def page_matches(spark, sf_dir):
    """Terms in whole pages, the host being the repository."""
    pages = texts(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias(R.KEY),
        F.col("url").alias("path"), F.col("html").alias("content"))
    return _shown(M.first_match(pages, TERMS))


_PAGES_SQL = f"""
WITH h AS (
  SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS repository_full_name, url AS path,
         {_first_hit('html')} AS priority FROM pages
), t AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{f}', '{t}')" for i, (f, t) in enumerate(TERMS))}) AS v(p, framework, term)),
best AS (
  SELECT * FROM (SELECT h.*, t.framework, t.term,
                        row_number() OVER (PARTITION BY repository_full_name ORDER BY priority, path) AS rn
                 FROM h JOIN t ON priority = p) WHERE rn = 1
)
"""


def first_matches(spark, sf_dir):
    return _shown(M.first_match(files(spark, sf_dir), TERMS))


def _streamed(spark, sf_dir):
    """The stream reads the document table and writes below the shared folder."""
    schema = table(spark, sf_dir, "documents").schema
    folder = work_folder(spark, "scan")
    # A pattern, because a stream takes folders and patterns but not a single file.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(
        f"{sf_dir}/documents.parquet*")
    arriving = stream.select(
        F.concat_ws("/", "source", "lang").alias(R.KEY),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"),
                 F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.col("text").alias("content"),
    )
    query = scan.scan_frameworks(arriving, f"{folder}/results", f"{folder}/checkpoint", TERMS)
    query.awaitTermination()
    return f"{folder}/results"


def streamed_matches(spark, sf_dir):
    return _shown(scan.framework_matches(spark, _streamed(spark, sf_dir)))


def stateful_matches(spark, sf_dir):
    """The stream with each repository's best match as keyed state."""
    schema = table(spark, sf_dir, "documents").schema
    folder = work_folder(spark, "stateful-scan")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(
        f"{sf_dir}/documents.parquet*")
    arriving = stream.select(
        F.concat_ws("/", "source", "lang").alias(R.KEY),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"),
                 F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.col("text").alias("content"),
    )
    scan.scan_frameworks_with_state(arriving, f"{folder}/results", f"{folder}/checkpoint", TERMS).awaitTermination()
    found = scan.scan_state_results(spark, f"{folder}/results")
    return _shown(found.filter(F.col("priority").isNotNull()).select(R.KEY, *M.MATCH_COLUMNS))


def scan_progress(spark, sf_dir):
    """All repositories are known, those of one language have been scanned."""
    every = files(spark, sf_dir)
    scanned = every.filter(F.col(R.KEY).endswith("/fr"))
    return M.scan_progress(every, M.first_match(scanned, TERMS, keep_unmatched=True))


_PROGRESS_SQL = _BEST_SQL + """
SELECT (SELECT count(DISTINCT repository_full_name) FROM f) AS repositories,
       (SELECT count(DISTINCT repository_full_name) FROM f WHERE repository_full_name LIKE '%/fr') AS processed_repositories,
       (SELECT count(*) FROM best WHERE repository_full_name LIKE '%/fr') AS matched_repositories,
       (SELECT count(DISTINCT repository_full_name) = count(DISTINCT repository_full_name)
               FILTER (repository_full_name LIKE '%/fr') FROM f) AS completed"""


def appended_matches(spark, sf_dir):
    """Matches appended language by language, then all again; keys stay unique."""
    found = stored(M.first_match(files(spark, sf_dir), TERMS), "found")
    path = work_folder(spark, "matches")
    for batch_id, part in enumerate([found.filter(F.col(R.KEY).endswith("/en")), found, found]):
        sinks.append_unique(part, path, R.KEY, batch_id)
    return _shown(spark.read.parquet(path).drop("batch_id", "key_bucket"))


def next_batch(spark, sf_dir):
    """The 500 customers that follow a given one."""
    return R.next_batch(table(spark, sf_dir, "customer"), "c_name", 500, after="Customer#000000040").select("c_name")


def batch_slice(spark, sf_dir):
    """250 customers from the hundred-and-first on, by balance and key."""
    customers = table(spark, sf_dir, "customer").select("c_acctbal", "c_custkey")
    return R.batch_slice(customers, ["c_acctbal", "c_custkey"], 100, 250)


def imported_frameworks(spark, sf_dir):
    """The default terms, searched as imports in the derived source files."""
    sources = M.with_repository(source_files(spark, sf_dir), "path")
    return _shown(M.first_match(sources, mode="import"))


_IMPORTED_SQL = CORPUS_SQL + """
SELECT source || '/' || lang AS repository_full_name, any_value(t.framework) AS matched_framework,
       any_value(t.framework) AS matched_term, list_extract(string_split(min(path), '/'), -1) AS matched_file_name,
       min(path) AS matched_file_path, CAST(any_value(t.priority) AS BIGINT) AS priority
FROM content JOIN (VALUES ('general', 'logging', 11), ('hybrid', 'wandb', 2), ('ml', 'mlflow', 5),
                          ('alias', 'logging', 11)) AS t(k, framework, priority) ON kind = k
GROUP BY 1"""


QUERIES = {
    "imported_frameworks": (imported_frameworks, _IMPORTED_SQL),
    "search_results": (
        lambda spark, sf_dir: M.as_search_results(M.first_match(files(spark, sf_dir), TERMS), "https://example.org/"),
        _BEST_SQL + """
SELECT repository_full_name, framework AS matched_framework, term AS matched_term,
       list_extract(string_split(path, '/'), -1) AS matched_file_name,
       list_extract(string_split(path, '/'), -1) AS matched_file_path,
       'https://example.org/' || repository_full_name || '/blob/HEAD/' || list_extract(string_split(path, '/'), -1)
         AS matched_html_url,
       NULL::DOUBLE AS score
FROM best"""),
    "term_matches": (
        term_matches,
        _HITS_SQL + "SELECT repository_full_name, path, CAST(priority AS BIGINT) AS priority, framework, term FROM h JOIN t ON priority = p"),
    "term_table_matches": (
        term_table_matches,
        _HITS_SQL + "SELECT repository_full_name, path, CAST(priority AS BIGINT) AS priority, framework, term FROM h JOIN t ON priority = p"),
    "first_matches": (first_matches, _BEST_SQL + _MATCH_SELECT),
    "page_matches": (page_matches, _PAGES_SQL + _MATCH_SELECT),
    "streamed_matches": (streamed_matches, _BEST_SQL + _MATCH_SELECT),
    "stateful_matches": (stateful_matches, _BEST_SQL + _MATCH_SELECT),
    "scan_progress": (scan_progress, _PROGRESS_SQL),
    "appended_matches": (appended_matches, _BEST_SQL + _MATCH_SELECT),
    "next_batch": (
        next_batch,
        "SELECT c_name FROM customer WHERE c_name > 'Customer#000000040' ORDER BY c_name LIMIT 500"),
    "batch_slice": (
        batch_slice,
        "SELECT c_acctbal, c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 250 OFFSET 100"),
}
