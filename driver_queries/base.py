"""Reading driver tables, and Python sources derived from whole documents.

A document becomes a source file: a header with imports chosen by language, a
class and a method, and in the method one statement per line of its text, the
text being the statement's argument. Which function a line calls follows from
the line's length, so SQL can tell every call, its position and its text
without parsing anything. Texts of a certain length get an unbalanced bracket
at the end, which makes their files unparsable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logharvest.operators.layout import computed_once, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with long texts, spread if it comes in fewer pieces than there are cores."""
    return spread(table(spark, sf_dir, name))


# callee by (kind of file, length of the line modulo 8)
CALLEES = {
    "general": ["logging.info", "logging.debug", "logging.warning", "logging.error",
                "logging.critical", "logging.exception", "logging.warn", "print"],
    "hybrid": ["logging.info", "logging.debug", "logging.warning", "logging.error",
               "logging.critical", "logging.exception", "wb.save", "wb.log"],
    "ml": ["lm", "lm", "lm", "lm", "print", "print", "print", "print"],
    "alias": ["log.info", "log.info", "log.info", "log.info",
              "tf.summary.scalar", "tf.print", "log.getLogger", "print"],
    "bare": ["print"] * 8,
}
HEADERS = {
    "general": ["import os", "import sys", "import logging", "logging.basicConfig()"],
    "hybrid": ["import os", "import logging", "import wandb as wb", "logging.basicConfig()"],
    "ml": ["import os", "import sys", "from mlflow import log_metric as lm", "READY = True"],
    "alias": ["import sys", "import logging as log", "import tensorflow as tf", "log.basicConfig()"],
    "bare": ["import os", "import sys", "import json", "READY = True"],
}
# What the extractor should attribute a call to; other callees are no library calls.
LIBRARY_OF = {
    "logging": "logging", "log": "logging", "wb": "wandb", "lm": "mlflow", "tf": "tensorflow",
}
FIRST_STATEMENT = 8


def _kind() -> Column:
    by_language = {"en": "general", "de": "hybrid", "fr": "ml", "es": "alias"}
    kind = F.when(F.col("source") == "src7", "bare")
    for language, name in by_language.items():
        kind = kind.when(F.col("lang") == language, name)
    return kind.otherwise("bare")


def _choose(kind: Column, values: dict[str, str]) -> Column:
    chosen = None
    for name, value in values.items():
        chosen = F.when(kind == name, value) if chosen is None else chosen.when(kind == name, value)
    return chosen


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)`` of the derived Python files."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    docs = docs.withColumn("kind", _kind())
    kind = F.col("kind")
    callees = None
    for name, values in CALLEES.items():
        literal = F.array(*[F.lit(v) for v in values])
        callees = F.when(kind == name, literal) if callees is None else callees.when(kind == name, literal)
    clean = F.regexp_replace("text", r"[\x00-\x09\x0b-\x1f\x7f]", " ")

    def statement(line: Column) -> Column:
        escaped = F.replace(F.replace(line, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        callee = F.get(F.col("callees"), F.length(line) % 8)
        return F.concat(F.lit("        "), callee, F.lit('("'), escaped, F.lit('", step)'))

    docs = docs.withColumn("callees", callees)
    header = _choose(kind, {k: "\n".join(v) for k, v in HEADERS.items()})
    content = F.concat_ws(
        "\n",
        F.concat(F.lit('# logging.info("decoy") of document '), F.col("doc_id").cast("string")),
        header,
        F.concat(F.lit("class Doc"), F.col("doc_id").cast("string"), F.lit(":")),
        F.lit("    def handle(self, step):"),
        F.array_join(F.transform(F.split(clean, "\n"), statement), "\n"),
        F.lit("        return step"),
        F.when(F.length("text") % 50 == 49, F.lit("broken = (")),
    )
    path = F.concat(
        F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"),
        F.col("doc_id").cast("string"), F.lit(".py"),
    )
    return computed_once(docs.withColumn("path", path), "content", content).select("path", "content")


# -- the same in SQL -----------------------------------------------------------

def _case(subject: str, values: dict[str, str], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {subject} = '{k}' THEN {v}" for k, v in values.items())
    return f"CASE {arms} ELSE {default} END"


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_KIND = (
    "CASE WHEN source = 'src7' THEN 'bare' WHEN lang = 'en' THEN 'general' "
    "WHEN lang = 'de' THEN 'hybrid' WHEN lang = 'fr' THEN 'ml' WHEN lang = 'es' THEN 'alias' "
    "ELSE 'bare' END"
)
_ROOT = "split_part(split_part(callee, '(', 1), '.', 1)"
_HEADER_TEXT = _case(
    "kind", {k: "concat_ws(chr(10), " + ", ".join(f"'{x}'" for x in v) + ")" for k, v in HEADERS.items()}
)

# doc: one row per file; stmt: one row per statement; calls: one row per library
# call of a parsable file, as the extractor should report it.
CORPUS_SQL = f"""
WITH doc AS (
  SELECT doc_id, lang, source, {_KIND} AS kind,
         source || '/' || lang || '/doc_' || doc_id || '.py' AS path,
         length(text) % 50 = 49 AS broken,
         string_split(regexp_replace(text, '[\\x00-\\x09\\x0b-\\x1f\\x7f]', ' ', 'g'), chr(10)) AS lines
  FROM documents
), raw_stmt AS (
  SELECT doc_id, kind, path, broken, unnest(lines) AS line,
         generate_subscripts(lines, 1) AS ix, len(lines) AS n_lines
  FROM doc
), stmt AS (
  SELECT doc_id, kind, path, broken, ix, n_lines, callee,
         callee || '("' || replace(replace(line, '\\', '\\\\'), '"', '\\"') || '", step)' AS stmt
  FROM (SELECT *, ({_case("kind", {k: _sql_list(v) for k, v in CALLEES.items()})})[length(line) % 8 + 1] AS callee
        FROM raw_stmt)
), body AS (
  SELECT doc_id, '    def handle(self, step):' || chr(10)
         || string_agg('        ' || stmt, chr(10) ORDER BY ix) || chr(10) || '        return step' AS function
  FROM stmt GROUP BY doc_id
), content AS (
  SELECT doc_id, path, kind, broken, source, lang, len(lines) AS n_lines,
         '# logging.info("decoy") of document ' || doc_id || chr(10) || {_HEADER_TEXT} || chr(10)
         || 'class Doc' || doc_id || ':' || chr(10) || function
         || CASE WHEN broken THEN chr(10) || 'broken = (' ELSE '' END AS content,
         function
  FROM doc JOIN body USING (doc_id)
), found AS (
  SELECT doc_id, path, kind, 5 AS line_number, callee, callee || '()' AS snippet, false AS inside,
         'class Doc' || doc_id || ':' AS lines_after,
         {_case("kind", {k: "'" + v[2] + "'" for k, v in HEADERS.items()})} AS lines_before
  FROM (SELECT *, CASE WHEN kind IN ('general', 'hybrid') THEN 'logging.basicConfig'
                       WHEN kind = 'alias' THEN 'log.basicConfig' END AS callee
        FROM doc WHERE NOT broken)
  WHERE callee IS NOT NULL
  UNION ALL
  SELECT doc_id, path, kind, ix + {FIRST_STATEMENT - 1}, callee, stmt, true, lines_after, lines_before
  FROM (SELECT *, lead(stmt, 1, 'return step') OVER w AS lines_after,
               lag(stmt, 1, 'def handle(self, step):') OVER w AS lines_before
        FROM stmt WHERE NOT broken WINDOW w AS (PARTITION BY doc_id ORDER BY ix))
  WHERE (callee = 'lm' OR regexp_matches(callee, '^(logging|log|wb|tf)\\.[a-z]+$|^log\\.getLogger$'))
), calls AS (
  SELECT f.doc_id, f.path, split_part(f.path, '/', 1) AS project_name, f.line_number, f.snippet, f.callee,
         {_case(_ROOT, {k: f"'{v}'" for k, v in LIBRARY_OF.items()})} AS call_library,
         first_value(CASE WHEN f.kind = 'ml' THEN 'mlflow' ELSE 'logging' END) OVER (PARTITION BY f.doc_id) AS library,
         CASE WHEN f.kind = 'ml' THEN 'ML-specific'
              WHEN bool_or(starts_with(f.callee, 'wb.') OR starts_with(f.callee, 'tf.')) OVER (PARTITION BY f.doc_id)
              THEN 'hybrid' ELSE 'general-purpose' END AS library_type,
         CASE WHEN inside THEN 'Doc' || f.doc_id END AS class,
         CASE WHEN inside THEN 'handle' END AS function_name,
         CASE WHEN inside THEN b.function END AS function,
         f.lines_before, f.lines_after,
         'file_' || substr(md5(f.path), 1, 8) AS file_id,
         'snip_' || substr(md5(f.path || '_' || f.line_number || '_' || f.snippet), 1, 8) AS snippet_id,
         md5(f.path || '_' || f.line_number || '_' || f.snippet) AS call_key, md5(f.path) AS file_key,
         row_number() OVER (PARTITION BY f.doc_id ORDER BY f.line_number) - 1 AS position
  FROM found f JOIN body b USING (doc_id)
), wanted AS (
  SELECT * FROM calls
  WHERE function_name IS NOT NULL
    AND (starts_with(snippet, 'tf.summary')
         OR NOT (starts_with(snippet, 'tf.') OR starts_with(snippet, 'log.getLogger')))
)
"""
