"""Survey tables: orders are respondents, parts give the multiple choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.base import table
from logharvest.operators import survey as S

# Answers by the digit in front of the order priority, as they stand in a form.
AGREEMENT = ["Strongly disagree", "Disagree", "Not sure", "Agree", "Strongly agree"]
FREQUENCY = ["Never", "Rarely (a few times per year)", "Not sure / I can’t assess", "Often (monthly)", "Always"]
SEVERITY = ["Not severe", "Minor", "Moderate", "Severe", "Critical"]

HEADERS = {
    "agree_heavy": "To what extent do you agree that\n'Heavy Logging' is a problem?",
    "agree_print": "Do you agree that print logging is a problem?",
    "freq_heavy": "How frequently do you meet Heavy Logging?",
    "severity_metric": "How severe is  metric overwrite (critical)?",
    "words": "In your own words: what is Heavy Logging?",
    "role": "What is your role?",
}


def _pick(answers, shift=0):
    step = (F.substring("o_orderpriority", 1, 1).cast("int") + F.lit(shift)) % len(answers)
    return F.get(F.array(*[F.lit(a) for a in answers]), step)


def raw_survey(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(key % 6 != 0, _pick(AGREEMENT)).alias(HEADERS["agree_heavy"]),
        _pick(AGREEMENT, 2).alias(HEADERS["agree_print"]),
        F.when(key % 10 != 0, _pick(FREQUENCY)).alias(HEADERS["freq_heavy"]),
        _pick(SEVERITY).alias(HEADERS["severity_metric"]),
        F.col("o_orderstatus").alias(HEADERS["words"]),
        F.when(key % 4 != 0, F.col("o_orderstatus")).alias(HEADERS["role"]),
    )


def clean_survey(spark, sf_dir):
    return S.normalize_likert(S.simplify_headers(raw_survey(spark, sf_dir)))


def _pick_sql(answers, shift=0):
    listed = ", ".join("'" + a.replace("'", "''") + "'" for a in answers)
    return f"[{listed}][(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) + {shift}) % {len(answers)} + 1]"


_NORMAL_AGREEMENT = ["Strongly disagree", "Disagree", "Neutral", "Agree", "Strongly agree"]
_NORMAL_FREQUENCY = ["Never", "Rarely", "Neutral", "Often", "Always"]
_NORMAL_SEVERITY = ["Not severe", "Slightly severe", "Moderately severe", "Very severe", "Extremely severe"]

_CLEAN_SQL = f"""
WITH s AS (
  SELECT CASE WHEN o_orderkey % 6 <> 0 THEN {_pick_sql(_NORMAL_AGREEMENT)} END AS "Agreement Heavy Logging",
         {_pick_sql(_NORMAL_AGREEMENT, 2)} AS "Agreement Print Logging",
         CASE WHEN o_orderkey % 10 <> 0 THEN {_pick_sql(_NORMAL_FREQUENCY)} END AS "Frequency Heavy Logging",
         {_pick_sql(_NORMAL_SEVERITY)} AS "Severity Metric Overwrite",
         o_orderstatus AS "Justification Heavy Logging",
         CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS "What is your role?"
  FROM orders
), l AS (
  SELECT 'Agreement' AS metric, 'Heavy Logging' AS topic, "Agreement Heavy Logging" AS answer FROM s
  UNION ALL SELECT 'Agreement', 'Print Logging', "Agreement Print Logging" FROM s
  UNION ALL SELECT 'Frequency', 'Heavy Logging', "Frequency Heavy Logging" FROM s
  UNION ALL SELECT 'Severity', 'Metric Overwrite', "Severity Metric Overwrite" FROM s
)
"""
_FREQUENCY_SCALE = ["Never", "Rarely", "Sometimes", "Often", "Very often", "Always"]
_AGREEMENT_SCALE = _NORMAL_AGREEMENT


def _counts(options):
    return ", ".join(f"count(*) FILTER (answer = '{o}') AS \"{o}\"" for o in options)


def _percents(options, total):
    return ", ".join(f"CAST(\"{o}\" AS DOUBLE) / {total} * 100 AS \"{o}\"" for o in options)


def _matrix_sql(metric, options):
    return f"SELECT topic, {_counts(options)} FROM l WHERE metric = '{metric}' GROUP BY topic"


def _percent_sql(metric, options):
    total = "greatest(" + " + ".join(f'"{o}"' for o in options) + ", 1)"
    return f"SELECT topic, {_percents(options, total)} FROM ({_matrix_sql(metric, options)})"


def of_survey(step):
    return lambda spark, sf_dir: step(clean_survey(spark, sf_dir))


def shares_of_answered(spark, sf_dir):
    """The older variant on columns named ``<topic> <metric>``."""
    old = clean_survey(spark, sf_dir).select(
        F.col("`Agreement Heavy Logging`").alias("Heavy Agreement"),
        F.col("`Agreement Print Logging`").alias("Print Agreement"),
        F.col("`Severity Metric Overwrite`").alias("Severity Agreement"))
    return S.likert_percent_of_answered(old, "Agreement", ["Agree", "Neutral", "Disagree"])


_ANSWERED_SQL = _CLEAN_SQL + """
SELECT split_part(topic, ' ', 1) AS topic,
       CAST(count(*) FILTER (answer = 'Agree') AS DOUBLE) / count(answer) * 100 AS "Agree",
       CAST(count(*) FILTER (answer = 'Neutral') AS DOUBLE) / count(answer) * 100 AS "Neutral",
       CAST(count(*) FILTER (answer = 'Disagree') AS DOUBLE) / count(answer) * 100 AS "Disagree"
FROM l WHERE metric = 'Agreement' GROUP BY topic"""


def part_choices(spark, sf_dir):
    """Words of a part's name and its type as choices, with stray spaces and an
    empty last choice; some parts did not answer."""
    answer = F.concat(F.replace("p_name", F.lit(" "), F.lit(" ; ")), F.lit(";"), F.col("p_type"), F.lit(";"))
    parts = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 8 != 0, answer).alias("used libraries"))
    return S.multi_select_counts(parts, "used libraries")


def _label_sql(count, percent):
    return f"{count} || ' (' || printf('%.1f', {percent}) || '%)'"


_CHOICES_SQL = f"""
WITH a AS (SELECT CASE WHEN p_partkey % 8 <> 0 THEN replace(p_name, ' ', ' ; ') || ';' || p_type || ';' END AS answer FROM part),
o AS (SELECT trim(unnest(string_split(answer, ';'))) AS value FROM a WHERE answer IS NOT NULL),
c AS (SELECT value, count(*) AS count FROM o GROUP BY 1),
p AS (SELECT *, CAST(count AS DOUBLE) / (SELECT count(answer) FROM a) * 100 AS percent FROM c)
SELECT *, {_label_sql('count', 'percent')} AS label FROM p"""

_SHARES_SQL = _CLEAN_SQL + f""", c AS (
  SELECT "What is your role?" AS value, count(*) AS count FROM s WHERE "What is your role?" IS NOT NULL GROUP BY 1),
p AS (SELECT *, CAST(count AS DOUBLE) / (SELECT sum(count) FROM c) * 100 AS percent FROM c)
SELECT *, {_label_sql('count', 'percent')} AS label FROM p"""


QUERIES = {
    "clean_survey": (clean_survey, _CLEAN_SQL + "SELECT * FROM s"),
    "segment_counts": (
        lambda s, d: S.value_counts(table(s, d, "customer"), "c_mktsegment"),
        "SELECT c_mktsegment AS value, count(*) AS count FROM customer GROUP BY 1"),
    "role_shares": (of_survey(lambda df: S.value_shares(df, "What is your role?")), _SHARES_SQL),
    "part_choices": (part_choices, _CHOICES_SQL),
    "frequency_options": (
        of_survey(lambda df: S.likert_options(df, "Frequency").withColumn("rank", F.col("rank").cast("bigint"))),
        _CLEAN_SQL + f"""SELECT DISTINCT answer AS option, CAST(list_position(['Never', 'Rarely', 'Sometimes', 'Often', 'Very often', 'Always'], answer) AS BIGINT) AS rank
        FROM l WHERE metric = 'Frequency' AND list_position(['Never', 'Rarely', 'Sometimes', 'Often', 'Very often', 'Always'], answer) > 0"""),
    "agreement_matrix": (
        of_survey(lambda df: S.likert_matrix(df, "Agreement")), _CLEAN_SQL + _matrix_sql("Agreement", _AGREEMENT_SCALE)),
    "frequency_matrix": (
        of_survey(lambda df: S.likert_matrix(df, "Frequency")), _CLEAN_SQL + _matrix_sql("Frequency", _FREQUENCY_SCALE)),
    "agreement_percent": (
        of_survey(lambda df: S.likert_percent(df, "Agreement")), _CLEAN_SQL + _percent_sql("Agreement", _AGREEMENT_SCALE)),
    "frequency_percent": (
        of_survey(lambda df: S.likert_percent(df, "Frequency")), _CLEAN_SQL + _percent_sql("Frequency", _FREQUENCY_SCALE)),
    "agreement_percent_of_answered": (shares_of_answered, _ANSWERED_SQL),
    "unlisted_answers": (
        of_survey(lambda df: S.unlisted_answers(df, "Frequency")),
        _CLEAN_SQL + """SELECT topic, answer, count(*) AS count FROM l
        WHERE metric = 'Frequency' AND answer NOT IN ('Never', 'Rarely', 'Sometimes', 'Often', 'Very often', 'Always')
        GROUP BY 1, 2"""),
}
