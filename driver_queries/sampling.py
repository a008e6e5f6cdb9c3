"""Sampling. Strata come from documents (language, source) and from their calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import table
from driver_queries.code import _UNIQUE_SQL, wanted
from logharvest.operators import calls as C
from logharvest.operators import sampling as W
from logharvest.session import stored

SEED = 42
# The prefix a sampling key is hashed with.
_KEY = f"md5('{SEED}|' || {{}})"

DOCUMENT_PLAN = [("en", "src1", 7), ("en", "src2", 40), ("de", None, 30), ("es", "warning", 20), ("fr", None, 100000)]


def document_ids(spark, sf_dir):
    """Documents as snippets; two sources stand for differently spelled levels."""
    level = F.when(F.col("source") == "src4", "Warn").when(F.col("source") == "src5", "WARNING").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("library"), level.alias("log_level"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("snippet_id"))


_IDS_SQL = """
WITH ids AS (
  SELECT lang AS library, CASE WHEN source IN ('src4', 'src5') THEN 'warning' ELSE source END AS log_level,
         CASE source WHEN 'src4' THEN 'Warn' WHEN 'src5' THEN 'WARNING' ELSE source END AS raw_level,
         'd' || doc_id AS snippet_id
  FROM documents)
"""


def merged_strata(spark, sf_dir):
    merged = W.merge_strata(document_ids(spark, sf_dir))
    return merged.groupBy("library", "log_level").agg(F.count(F.lit(1)).alias("count"))


def stratified_documents(spark, sf_dir):
    return W.stratified_sample(document_ids(spark, sf_dir), DOCUMENT_PLAN, SEED)


_STRATIFIED_SQL = _IDS_SQL + f""", s AS (
  SELECT *, CASE WHEN library = 'en' AND log_level = 'src1' THEN 7 WHEN library = 'en' AND log_level = 'src2' THEN 40
                 WHEN library = 'de' THEN 30 WHEN library = 'es' AND log_level = 'warning' THEN 20
                 WHEN library = 'fr' THEN 100000 END AS quota,
         CASE WHEN library IN ('de', 'fr') THEN library ELSE library || '/' || log_level END AS stratum
  FROM ids
)
SELECT library, log_level, snippet_id FROM (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_KEY.format('snippet_id')}, snippet_id) AS rn
  FROM s WHERE quota IS NOT NULL) WHERE rn <= quota"""


def sampled_calls(spark, sf_dir):
    """The default plan on the calls found in the sources."""
    return W.stratified_sample(C.unique_function_ids(wanted(spark, sf_dir)), seed=SEED)


_PLAN_CASE = " ".join(
    f"WHEN library = 'logging' AND log_level = '{level}' THEN {n}"
    for level, n in [("warning", 293), ("info", 477), ("exception", 92), ("debug", 227), ("error", 232), ("critical", 18)])
# A call found in two strata goes to the first in plan order.
_SAMPLED_SQL = _UNIQUE_SQL + f""", ids AS (
  SELECT DISTINCT library, CASE WHEN log_level = 'warn' THEN 'warning' ELSE log_level END AS log_level, call_key, snippet_id FROM u
), s AS (
  SELECT *, CASE {_PLAN_CASE} WHEN library = 'mlflow' THEN 215 WHEN library = 'wandb' THEN 237 END AS quota,
         row_number() OVER (PARTITION BY call_key ORDER BY
           CASE WHEN log_level = 'warning' THEN 0 WHEN library = 'wandb' THEN 1 WHEN library = 'mlflow' THEN 2
                WHEN log_level = 'info' THEN 3 WHEN log_level = 'exception' THEN 4 WHEN log_level = 'debug' THEN 5
                WHEN log_level = 'error' THEN 6 ELSE 7 END) AS choice
  FROM ids WHERE CASE {_PLAN_CASE} WHEN library IN ('mlflow', 'wandb') THEN 1 END IS NOT NULL
)
SELECT library, log_level, call_key, snippet_id FROM (
  SELECT *, row_number() OVER (PARTITION BY library, log_level ORDER BY {_KEY.format('call_key')}, call_key) AS rn
  FROM s WHERE choice = 1) WHERE rn <= quota"""


def quota_violations(spark, sf_dir):
    """The unsampled ids measured against the plan: strata that need sampling."""
    return W.quota_violations(document_ids(spark, sf_dir), DOCUMENT_PLAN[:4]).select("library", "log_level", "n")


_VIOLATIONS_SQL = _IDS_SQL + """
SELECT library, log_level, count(*) AS n FROM ids GROUP BY 1, 2
HAVING count(*) > CASE WHEN library = 'en' AND log_level = 'src1' THEN 7 WHEN library = 'en' AND log_level = 'src2' THEN 40
                       WHEN library = 'de' THEN 30 WHEN library = 'es' AND log_level = 'warning' THEN 20 ELSE 0 END"""

SIZE = 150


def balanced_documents(spark, sf_dir):
    return W.balanced_sample(document_ids(spark, sf_dir), SIZE, SEED)


_BALANCED_SQL = _IDS_SQL + f""", k AS (SELECT library, snippet_id, {_KEY.format('snippet_id')} AS key FROM ids),
even AS (
  SELECT snippet_id FROM (SELECT *, row_number() OVER (PARTITION BY library ORDER BY key, snippet_id) AS rn FROM k)
  WHERE rn <= greatest(1, {SIZE} // (SELECT count(DISTINCT library) FROM k))
), fill AS (
  SELECT snippet_id, row_number() OVER (ORDER BY key, snippet_id) AS rn FROM k
  WHERE snippet_id NOT IN (SELECT snippet_id FROM even)
), chosen AS (
  SELECT snippet_id FROM even
  UNION ALL SELECT snippet_id FROM fill WHERE rn <= {SIZE} - (SELECT count(*) FROM even)
)
"""


def flagged_documents(spark, sf_dir):
    ids = W.add_default_column(document_ids(spark, sf_dir))
    return W.flag_selected(ids, W.balanced_sample(ids, SIZE, SEED))


def unused_documents(spark, sf_dir):
    """Documents that carry no label."""
    labelled = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("snippet_id"))
    return W.exclude_used(document_ids(spark, sf_dir), labelled).select("snippet_id")


def chosen_functions(spark, sf_dir):
    """Function text of a balanced choice of calls."""
    calls = stored(wanted(spark, sf_dir), "calls")
    chosen = W.balanced_sample(C.unique_function_ids(calls), 60, SEED)
    found = W.functions_for_ids(calls, chosen)
    return found.select("call_key", "snippet_id", F.md5("function").alias("function_md5"))


_CHOSEN_SQL = _UNIQUE_SQL + f""", ids AS (SELECT DISTINCT library, log_level, call_key FROM u),
k AS (SELECT library, call_key, {_KEY.format('call_key')} AS key FROM ids),
even AS (
  SELECT call_key FROM (SELECT *, row_number() OVER (PARTITION BY library ORDER BY key, call_key) AS rn FROM k)
  WHERE rn <= greatest(1, 60 // (SELECT count(DISTINCT library) FROM k))
), fill AS (
  SELECT call_key, row_number() OVER (ORDER BY key, call_key) AS rn FROM k
  WHERE call_key NOT IN (SELECT call_key FROM even)
), chosen AS (
  SELECT call_key FROM even
  UNION ALL SELECT call_key FROM fill WHERE rn <= 60 - (SELECT count(*) FROM even)
)
SELECT call_key, any_value(snippet_id) AS snippet_id, md5(arg_max(function, (path, position))) AS function_md5
FROM wanted WHERE call_key IN (SELECT call_key FROM chosen) GROUP BY call_key"""


def last_turns(spark, sf_dir):
    """Last text per conversation."""
    return W.last_wins(table(spark, sf_dir, "conversations"), "conv_id", "text", ["turn"])


QUERIES = {
    "merged_strata": (
        merged_strata, _IDS_SQL + "SELECT library, log_level, count(*) AS count FROM ids GROUP BY 1, 2"),
    "stratified_documents": (stratified_documents, _STRATIFIED_SQL),
    "sampled_calls": (sampled_calls, _SAMPLED_SQL),
    "quota_violations": (quota_violations, _VIOLATIONS_SQL),
    "balanced_documents": (balanced_documents, _BALANCED_SQL + "SELECT snippet_id FROM chosen"),
    "flagged_documents": (
        flagged_documents,
        _BALANCED_SQL + """SELECT library, raw_level AS log_level, snippet_id,
               CASE WHEN snippet_id IN (SELECT snippet_id FROM chosen) THEN 'yes' ELSE 'no' END AS selected
        FROM ids"""),
    "unused_documents": (
        unused_documents,
        "SELECT 'd' || doc_id AS snippet_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "chosen_functions": (chosen_functions, _CHOSEN_SQL),
    "last_turns": (
        last_turns, "SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id"),
}
