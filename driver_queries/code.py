"""Extraction, filtering and counting of calls, on sources derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driver_queries.base import CORPUS_SQL, source_files, table, texts
from logharvest.functions import text as X
from logharvest.functions.calls import is_config_call_of, reassign_library
from logharvest.operators import calls as C
from logharvest.operators import extraction as E
from logharvest.operators.notebooks import flatten_notebooks
from logharvest.session import stored


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.parse_files(source_files(spark, sf_dir))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.extract_calls(parsed(spark, sf_dir))


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.filter_calls(calls(spark, sf_dir))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted calls without what is cut from their files' lines."""
    return C.filter_calls(E.extract_calls(parsed(spark, sf_dir), texts=False))


def over(step, source):
    """A query that applies ``step`` to what ``source`` builds."""
    return lambda spark, sf_dir: step(source(spark, sf_dir))


def _big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# -- extraction --------------------------------------------------------------

CALL_COLUMNS = [
    "call_key", "file_key", "snippet_id", "file_id", "path", "project_name", "library", "library_type", "call_library",
    "snippet", "class", "function_name", "lines_before", "lines_after",
]


def extracted_calls(spark, sf_dir):
    return calls(spark, sf_dir).select(
        *CALL_COLUMNS, F.md5("function").alias("function_md5"), *_big("line_number", "position")
    )


EXTRACTED_SQL = CORPUS_SQL + f"""
SELECT {', '.join(CALL_COLUMNS)}, md5(function) AS function_md5,
       CAST(line_number AS BIGINT) AS line_number, CAST(position AS BIGINT) AS position
FROM calls"""


def call_dataset(spark, sf_dir):
    """Nested records, shown by scalars that depend on every part of them."""
    snippets = F.col("snippets")
    text = F.array_join(
        F.transform(snippets, lambda s: F.concat_ws("|", s["snippet_id"], s["snippet"], s["context"]["function"])),
        "\n",
    )
    return E.build_call_dataset(parsed(spark, sf_dir)).select(
        "id", "project_name", "file_path", "library", "library_type",
        F.md5("python_file_content").alias("content_md5"),
        F.size("snippets").cast("bigint").alias("n_snippets"),
        F.md5(text).alias("snippets_md5"),
        *_big("n_functions", "n_classes"),
    )


CALL_DATASET_SQL = CORPUS_SQL + """
SELECT file_id AS id, project_name, c.path AS file_path, any_value(library) AS library,
       any_value(library_type) AS library_type, any_value(md5(content)) AS content_md5,
       count(*) AS n_snippets,
       md5(string_agg(concat_ws('|', snippet_id, snippet, c.function), chr(10) ORDER BY position)) AS snippets_md5,
       CAST(1 AS BIGINT) AS n_functions, CAST(1 AS BIGINT) AS n_classes
FROM calls c JOIN content t USING (doc_id)
GROUP BY file_id, project_name, c.path"""


def filtered_files(spark, sf_dir):
    kept = C.filter_file_calls(E.build_call_dataset(parsed(spark, sf_dir)))
    ids = F.array_join(F.transform("snippets", lambda s: s["snippet_id"]), ";")
    return kept.select(
        "library", "library_type", F.size("snippets").cast("bigint").alias("n_snippets"),
        F.md5(ids).alias("ids_md5"),
    )


FILTERED_FILES_SQL = CORPUS_SQL + """
SELECT any_value(library) AS library, any_value(library_type) AS library_type, count(*) AS n_snippets,
       md5(string_agg(snippet_id, ';' ORDER BY position)) AS ids_md5
FROM wanted GROUP BY doc_id"""


def exploded_dataset(spark, sf_dir):
    data = E.build_call_dataset(parsed(spark, sf_dir), bodies=False)
    return E.explode_calls(C.filter_file_calls(data)).select(
        "library", "library_type", "snippet_id", "snippet", "class", "function_name",
        "lines_before", "lines_after", F.md5("function").alias("function_md5"), *_big("line_number"),
    )


EXPLODED_SQL = CORPUS_SQL + """
SELECT library, library_type, snippet_id, snippet, class, function_name, lines_before, lines_after,
       md5(function) AS function_md5, CAST(line_number AS BIGINT) AS line_number
FROM wanted"""


def files_with_calls(spark, sf_dir):
    return E.files_with_calls(parsed(spark, sf_dir)).select(
        "path", "project_name", F.md5("content").alias("content_md5"))


FILES_WITH_CALLS_SQL = CORPUS_SQL + """
SELECT path, split_part(path, '/', 1) AS project_name, md5(content) AS content_md5
FROM content WHERE doc_id IN (SELECT doc_id FROM calls)"""


def definition_counts(spark, sf_dir):
    every = E.parse_files(source_files(spark, sf_dir), keep_all=True)
    return E.count_definitions(every).select("path", *_big("n_functions", "n_classes"))


DEFINITION_SQL = CORPUS_SQL + """
SELECT path, CAST(CASE WHEN broken THEN 0 ELSE 1 END AS BIGINT) AS n_functions,
       CAST(CASE WHEN broken THEN 0 ELSE 1 END AS BIGINT) AS n_classes
FROM content"""


def unparsable_files(spark, sf_dir):
    every = E.parse_files(source_files(spark, sf_dir), keep_all=True)
    return E.unparsable_files(every)


UNPARSABLE_SQL = CORPUS_SQL + """
SELECT path, split_part(path, '/', 1) AS project_name, 'SyntaxError' AS reason FROM content WHERE broken"""



def refused_files(spark, sf_dir):
    """Every file is parsed or refused: a third carries a byte order mark, an eighth is no UTF-8."""
    files = source_files(spark, sf_dir)
    number = F.regexp_extract("path", r"doc_([0-9]+)\.py$", 1).cast("bigint")
    data = F.when(number % 8 == 0, F.concat(F.col("content").cast("binary"), F.unhex(F.lit("FF0A")))).when(
        number % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.col("content").cast("binary"))
    ).otherwise(F.col("content").cast("binary"))
    every = E.parse_files(files.withColumn("content", data.cast("string")), keep_all=True)
    return every.select(F.coalesce("facts.status", F.lit("none")).alias("status")).groupBy("status").agg(
        F.count(F.lit(1)).alias("count"))


REFUSED_SQL = CORPUS_SQL + """
SELECT CASE WHEN doc_id % 8 = 0 THEN 'no text' WHEN broken THEN 'SyntaxError' ELSE 'parsed' END AS status, count(*) AS count
FROM content GROUP BY 1"""

IMPORTED_SQL = CORPUS_SQL + """
SELECT path, name, library FROM content, (VALUES
  ('general', 'logging', 'logging'), ('hybrid', 'logging', 'logging'), ('hybrid', 'wb', 'wandb'),
  ('ml', 'lm', 'mlflow'), ('alias', 'log', 'logging'), ('alias', 'tf', 'tensorflow')) AS v(k, name, library)
WHERE kind = k AND NOT broken"""


# -- counts ------------------------------------------------------------------

METRICS_SQL = CORPUS_SQL + """
SELECT count(DISTINCT doc_id) AS number_of_python_files,
       count(DISTINCT doc_id) FILTER (library_type = 'general-purpose') AS number_of_general_purpose,
       count(DISTINCT doc_id) FILTER (library_type = 'ML-specific') AS number_of_ml_specific,
       count(DISTINCT doc_id) FILTER (library_type = 'hybrid') AS number_of_hybrid,
       count(DISTINCT doc_id) AS number_of_functions,
       count(DISTINCT doc_id) AS number_of_classes,
       count(*) AS number_of_logging_statements
FROM calls"""

_LEVEL_SQL = "nullif(regexp_extract(snippet, '^logging\\.(info|debug|warning|warn|error|critical|fatal|exception|log)\\s*\\(', 1), '')"

LEVELS_SQL = CORPUS_SQL + f"""
SELECT {_LEVEL_SQL} AS log_level, count(*) AS count FROM wanted
WHERE library = 'logging' AND {_LEVEL_SQL} IS NOT NULL GROUP BY 1"""


def summary_sql(library: str) -> str:
    return CORPUS_SQL + f""", s AS (SELECT *, {library} AS lib FROM wanted)
SELECT 'library' AS section, lib AS key, count(*) AS count FROM s GROUP BY 2
UNION ALL SELECT 'total', 'number_of_logging_statements', count(*) FROM s HAVING count(*) > 0
UNION ALL SELECT 'total', 'number_of_functions', count(DISTINCT function) FROM s HAVING count(*) > 0
UNION ALL SELECT 'log_level', {_LEVEL_SQL}, count(*) FROM s
WHERE lib = 'logging' AND {_LEVEL_SQL} IS NOT NULL GROUP BY 2"""


def reassigned_counts(spark, sf_dir):
    """``intended`` reassignment, with the dictionary naming the alias in use."""
    moved = reassign_library("library", "library_type", "snippet", "intended", ["wb", "mlflow"])
    rows = E.extract_calls(parsed(spark, sf_dir), texts=False).select(moved.alias("library"))
    return C.library_counts(rows)


REASSIGNED_SQL = CORPUS_SQL + """
SELECT CASE WHEN library = 'logging' AND library_type = 'hybrid' AND regexp_matches(snippet, '\\bwb\\.')
            THEN 'wb' ELSE library END AS library, count(*) AS count
FROM calls GROUP BY 1"""


def config_calls_by_library(spark, sf_dir):
    flagged = E.extract_calls(parsed(spark, sf_dir), texts=False).select(
        "call_library", is_config_call_of("snippet", "call_library").alias("is_config"))
    return flagged.groupBy("call_library", "is_config").agg(F.count(F.lit(1)).alias("count"))


CONFIG_SQL = CORPUS_SQL + """
SELECT call_library,
       (call_library = 'logging' AND (starts_with(snippet, 'logging.basicConfig') OR starts_with(snippet, 'log.getLogger')))
       AS is_config, count(*) AS count
FROM calls GROUP BY 1, 2"""

_UNIQUE_SQL = CORPUS_SQL + f""", u AS (
  SELECT library, CASE WHEN library = 'logging' THEN coalesce({_LEVEL_SQL}, 'unknown') END AS log_level,
         call_key, snippet_id, trim(function) AS body
  FROM wanted)
"""


SHARDS = 4


def unique_functions(spark, sf_dir):
    """Each group's ids in four lists."""
    lists = C.unique_functions(stored(wanted(spark, sf_dir), "calls"), SHARDS)
    together = F.array_sort(F.flatten(F.collect_list("snippet_ids")))
    return lists.groupBy("library", "log_level", "unique_function_count").agg(together.alias("ids")).select(
        "library", "log_level", "unique_function_count",
        F.md5(F.array_join("ids", ";")).alias("ids_md5"), F.size("ids").cast("bigint").alias("n_ids"),
    )


# A hash decides the list an id goes to, which is Spark's own; the lists of a
# group are compared by what they hold together.
UNIQUE_LISTS_SQL = _UNIQUE_SQL + """, ids AS (SELECT DISTINCT library, log_level, call_key, snippet_id FROM u)
SELECT u.library, u.log_level, count(DISTINCT body) AS unique_function_count,
       (SELECT md5(string_agg(snippet_id, ';' ORDER BY snippet_id)) FROM ids i
        WHERE i.library IS NOT DISTINCT FROM u.library AND i.log_level IS NOT DISTINCT FROM u.log_level) AS ids_md5,
       count(DISTINCT call_key) AS n_ids
FROM u GROUP BY u.library, u.log_level"""


# -- text preparation --------------------------------------------------------

def stripped_comments(spark, sf_dir):
    files = source_files(spark, sf_dir)
    return files.select("path", F.md5(X.strip_leading_comments("content")).alias("content_md5"))


STRIPPED_SQL = CORPUS_SQL + """
SELECT path, md5(substr(content, strpos(content, chr(10)) + 1)) AS content_md5 FROM content"""


def stripped_document_comments(spark, sf_dir):
    """Documents with a comment and a blank line before each of their lines:
    whatever stands in front of the first line that starts like an import goes."""
    lines = F.transform(F.split("text", "\n"), lambda l: F.concat(F.lit("  # note\n\n"), l))
    return texts(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(X.strip_leading_comments(F.concat(F.array_join(lines, "\n"), F.lit("\n")))).alias("content_md5"),
    )


STRIPPED_DOCUMENTS_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS ix FROM documents
), marked AS (
  SELECT doc_id, ix, line, trim(line) AS t,
         coalesce(min(CASE WHEN starts_with(trim(line), 'import') OR starts_with(trim(line), 'from') THEN ix END)
                  OVER (PARTITION BY doc_id), 1000000000) AS first_import
  FROM l
)
SELECT doc_id, md5(string_agg(
         CASE WHEN ix > first_import THEN '  # note' || chr(10) || chr(10) || line || chr(10)
              WHEN ix < first_import AND (t = '' OR starts_with(t, '#')) THEN ''
              ELSE line || chr(10) END, '' ORDER BY ix)) AS content_md5
FROM marked GROUP BY doc_id"""


def source_segments(spark, sf_dir):
    """From the second to the last but one character of each text, by byte offsets."""
    lines = F.split("text", "\n")
    count = F.size(lines)
    last = F.element_at(lines, -1)
    last_col = F.octet_length(last) - F.octet_length(F.substring(last, -1, 1))
    first_col = F.octet_length(F.substring(F.get(lines, F.lit(0)), 1, 1))
    segment = X.source_segment(lines, F.lit(1), count, first_col, last_col)
    return texts(spark, sf_dir, "documents").select("doc_id", F.md5(segment).alias("segment_md5"))


SEGMENT_SQL = """
SELECT doc_id, md5(substr(text, 2, length(text) - 2)) AS segment_md5 FROM documents"""


def neighbour_lines(spark, sf_dir):
    """Line before and after each line of each document."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", X.source_lines("text").alias("lines"))
    rows = docs.select("doc_id", "lines", F.posexplode("lines").alias("ix", "line"))
    number = F.col("ix") + 1
    return rows.select(
        "doc_id", number.cast("bigint").alias("line_number"),
        X.line_before(F.col("lines"), number).alias("lines_before"),
        X.line_after(F.col("lines"), number, number).alias("lines_after"),
    )


NEIGHBOUR_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line,
         generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) AS ix FROM documents
)
SELECT doc_id, CAST(ix AS BIGINT) AS line_number,
       regexp_replace(nullif(lag(line) OVER w, ''), '^\s+|\s+$', '', 'g') AS lines_before,
       regexp_replace(nullif(lead(line) OVER w, ''), '^\s+|\s+$', '', 'g') AS lines_after
FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ix)"""


def collapsed_text(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.md5(X.collapse_whitespace("text")).alias("collapsed_md5"),
        F.md5(X.strip(F.concat(F.lit("\t \n"), "text", F.lit(" \r\n")))).alias("stripped_md5"),
    )


COLLAPSED_SQL = r"""
SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed_md5,
       md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS stripped_md5
FROM documents"""


def page_paths(spark, sf_dir):
    """Path expressions on page addresses."""
    pages = table(spark, sf_dir, "pages")
    url = F.regexp_replace("url", r"^https?://", "/pages/")
    relative = X.relative_path(url, "/pages")
    return pages.select(
        "page_id", relative.alias("file_path"), X.project(url, relative).alias("project_name"),
        X.root_name(relative).alias("root_name"), X.file_id(url).alias("file_id"),
        X.snippet_id(url, F.lit(1), "html", short=False).alias("snippet_id"),
    )


PAGE_PATHS_SQL = r"""
WITH p AS (SELECT page_id, html, regexp_replace(url, '^https?://', '/pages/') AS path FROM pages)
SELECT page_id, substr(path, 8) AS file_path,
       CASE WHEN contains(substr(path, 8), '/') THEN split_part(substr(path, 8), '/', 1)
            ELSE list_extract(string_split(path, '/'), -2) END AS project_name,
       split_part(split_part(substr(path, 8), '(', 1), '.', 1) AS root_name,
       'file_' || substr(md5(path), 1, 8) AS file_id,
       'snip_' || md5(path || '_1_' || html) AS snippet_id
FROM p"""


def flattened_notebooks(spark, sf_dir):
    """Each document as a notebook: a text cell, a magic, and its lines as code."""
    lines = F.split("text", "\n")
    cell = lambda kind, source: F.struct(F.lit(kind).alias("cell_type"), source.alias("source"))
    with_ends = F.transform(lines, lambda l: F.concat(l, F.lit("\n")))
    document = F.struct(
        F.array(
            cell("markdown", F.array(F.lit("Title\n"), F.lit("second"))),
            cell("code", F.array(F.lit("%matplotlib inline\n"), F.lit("x = 1"))),
            cell("code", with_ends),
        ).alias("cells"),
        F.lit(4).alias("nbformat"),
    )
    books = texts(spark, sf_dir, "documents").select(
        F.concat(F.lit("nb/"), F.col("doc_id").cast("string"), F.lit(".ipynb")).alias("path"),
        F.to_json(document).alias("content"),
    )
    return flatten_notebooks(books).select("path", F.md5("content").alias("content_md5"))


NOTEBOOK_SQL = r"""
SELECT 'nb/' || doc_id || '.py' AS path,
       md5('# Title' || chr(10) || '# second' || chr(10) || chr(10)
           || '# %matplotlib inline' || chr(10) || 'x = 1' || chr(10) || chr(10)
           || array_to_string(list_transform(string_split(text, chr(10)), lambda l:
                CASE WHEN regexp_matches(l, '^[ \t]*[%!?]')
                     THEN regexp_replace(l, '^([ \t]*)(.*)$', '\1# \2') ELSE l END || chr(10)), '')
           || chr(10)) AS content_md5
FROM documents"""


def enclosing_scopes(spark, sf_dir):
    """Order lines as calls; each order as a file with nested scopes."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"))
    scopes = orders.select("path", F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"),
                 F.lit(first).alias("first"), F.lit(last).alias("last"))
        for kind, name, first, last in
        [("function", "outer", 1, 5), ("function", "inner", 3, 4), ("class", "Thing", 2, 3)]
    ])))
    found = E.enclosing_scope(line, scopes)
    return found.select("path", F.col("line").cast("bigint").alias("line"), "part", "function_name", "class")


SCOPES_SQL = """
SELECT l_orderkey AS path, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part,
       CASE WHEN o_orderkey IS NULL THEN NULL WHEN l_linenumber BETWEEN 3 AND 4 THEN 'inner'
            WHEN l_linenumber BETWEEN 1 AND 5 THEN 'outer' END AS function_name,
       CASE WHEN o_orderkey IS NOT NULL AND l_linenumber BETWEEN 2 AND 3 THEN 'Thing' END AS class
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"""


def records_with_calls(spark, sf_dir):
    """Nested records of all files, those without a call dropped."""
    kept = F.filter("snippets", lambda s: F.contains(s["snippet"], F.lit("error")))
    data = E.build_call_dataset(parsed(spark, sf_dir)).withColumn("snippets", kept)
    return E.only_with_calls(data).select("id", F.size("snippets").cast("bigint").alias("n_snippets"))


RECORDS_SQL = CORPUS_SQL + """
SELECT file_id AS id, count(*) AS n_snippets FROM calls WHERE contains(snippet, 'error') GROUP BY file_id"""

QUERIES = {
    "refused_files": (refused_files, REFUSED_SQL),
    "records_with_calls": (records_with_calls, RECORDS_SQL),
    "extracted_calls": (extracted_calls, EXTRACTED_SQL),
    "call_dataset": (call_dataset, CALL_DATASET_SQL),
    "exploded_dataset": (exploded_dataset, EXPLODED_SQL),
    "files_with_calls": (files_with_calls, FILES_WITH_CALLS_SQL),
    "definition_counts": (definition_counts, DEFINITION_SQL),
    "unparsable_files": (unparsable_files, UNPARSABLE_SQL),
    "imported_names": (over(E.imported_names, parsed), IMPORTED_SQL),
    "filtered_calls": (
        lambda s, d: wanted(s, d).select("snippet_id", "snippet", "library", F.md5("function").alias("function_md5")),
        CORPUS_SQL + "SELECT snippet_id, snippet, library, md5(function) AS function_md5 FROM wanted",
    ),
    "filtered_files": (filtered_files, FILTERED_FILES_SQL),
    "calls_in_functions": (
        lambda s, d: C.in_function_only(calls(s, d)).select("snippet_id", "function_name"),
        CORPUS_SQL + "SELECT snippet_id, function_name FROM calls WHERE function_name IS NOT NULL",
    ),
    "dataset_metrics": (over(lambda p: C.dataset_metrics(E.build_call_dataset(p)), parsed), METRICS_SQL),
    "dataset_metrics_reparsed": (
        over(lambda p: C.dataset_metrics(C.with_definitions(
            E.build_call_dataset(p).drop("n_functions", "n_classes"))), parsed), METRICS_SQL),
    "library_counts": (
        over(C.library_counts, counted),
        CORPUS_SQL + "SELECT library, count(*) AS count FROM wanted GROUP BY library"),
    "total_calls": (
        over(C.total_calls, counted),
        CORPUS_SQL + "SELECT count(*) AS number_of_logging_statements FROM wanted"),
    "distinct_functions": (
        over(C.distinct_functions, wanted),
        CORPUS_SQL + "SELECT count(DISTINCT function) AS number_of_functions FROM wanted"),
    "level_counts": (over(C.level_counts, counted), LEVELS_SQL),
    "call_summary": (over(C.summarize_calls, wanted), summary_sql("library")),
    "reassigned_library_counts": (reassigned_counts, REASSIGNED_SQL),
    "config_calls_by_library": (config_calls_by_library, CONFIG_SQL),
    "unique_function_counts": (
        over(C.unique_function_counts, wanted),
        _UNIQUE_SQL + "SELECT library, log_level, count(DISTINCT body) AS unique_function_count FROM u GROUP BY 1, 2"),
    "unique_function_ids": (
        over(C.unique_function_ids, wanted),
        _UNIQUE_SQL + "SELECT DISTINCT library, log_level, call_key, snippet_id FROM u"),
    "unique_function_lists": (unique_functions, UNIQUE_LISTS_SQL),
    "stripped_comments": (stripped_comments, STRIPPED_SQL),
    "stripped_document_comments": (stripped_document_comments, STRIPPED_DOCUMENTS_SQL),
    "source_segments": (source_segments, SEGMENT_SQL),
    "neighbour_lines": (neighbour_lines, NEIGHBOUR_SQL),
    "collapsed_text": (collapsed_text, COLLAPSED_SQL),
    "page_paths": (page_paths, PAGE_PATHS_SQL),
    "flattened_notebooks": (flattened_notebooks, NOTEBOOK_SQL),
    "enclosing_scopes": (enclosing_scopes, SCOPES_SQL),
}
