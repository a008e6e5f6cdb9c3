"""Quality rules whose cutoffs carry a bound on wrong rejections.

Each rule rejects documents whose value lies above a cutoff. Labelled good
documents are the holdout: a cutoff is admissible in a stratum if an exact
binomial test rejects, at a corrected level, that it turns away more than the
allowed share of good documents there. The lowest admissible cutoff of a rule
is used; a rule without one rejects nothing in that stratum. Strata too small
for a bound of their own have one together.

Everything is DataFrame expressions. A text is worked on inside its row: the
words that recur in windows are found by sorting the row's own window hashes,
so no word leaves its row and nothing but one row of figures per document is
stored. Statistics per stratum are combined on the map side.

Nulls: a null text is empty (fails the base rule); a null stratum is a stratum
of its own; null ids stay as they are, get no label, and repeated rows are
judged each like any other. Labels with a null id or quality are not used; an id
labelled twice counts twice. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from logharvest.llm.common import ngrams, whole, words
from logharvest.operators.layout import computed_once
from logharvest.session import stored

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
SYMBOLS = r"[#*$%&|<>]"

# Candidate cutoffs per rule, fixed before any label is seen.
SHARES = (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5)
CUTOFFS = {
    "symbols": SHARES,
    "upper_case": (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "duplicate_lines": SHARES,
    "repeated_words": SHARES,
    "word_length": (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0),
}


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Figures per document, beside the columns ``keep`` of ``docs``.

    ``n_words``; ``word_chars``, code points in words; ``n_symbols``;
    ``n_upper``, A-Z; ``n_lines``, lines with a word; ``n_dup_lines``, those
    equal to an earlier one; ``n_repeat_words``, words in 8-word windows found
    at least twice in the text, the first included.
    """
    text = whole("text")
    rows = docs.select(
        *keep, text.alias("__text"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long").alias("n_upper"),
    )
    rows = computed_once(rows, "__lines", F.filter(
        F.split("__text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    ))
    rows = rows.select(
        *keep, "__text", "n_symbols", "n_upper",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    rows = computed_once(rows, "__words", words(F.col("__text"))).drop("__text")
    rows = rows.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
    })
    rows = computed_once(rows, "__hashes", F.transform("__words", lambda w: F.xxhash64(w))).drop("__words")
    rows = computed_once(rows, "__grams", ngrams("__hashes", WINDOW)).drop("__hashes")
    return _repeated(rows).drop("__grams")


def _repeated(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` from the window hashes of each row."""
    grams = F.col("__grams")
    recurs = F.size(F.array_distinct(grams)) < F.size(grams)
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = computed_once(rows, "__placed", F.when(recurs, placed))
    at = F.col("__placed")

    def twin(i: Column) -> Column:
        g = F.get(at, i)["g"]
        before = F.coalesce(F.get(at, i - 1)["g"] == g, F.lit(False))
        return before | F.coalesce(F.get(at, i + 1)["g"] == g, F.lit(False))

    twins = F.filter(F.sequence(F.lit(0), F.size(at) - 1), twin)
    starts = F.sort_array(F.transform(twins, lambda i: F.get(at, i)["i"]))
    rows = computed_once(rows, "__starts", F.when(at.isNotNull(), starts)).drop("__placed")
    # Each window adds its words up to the start of the next one.
    covered = F.aggregate(
        "__starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, s: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n"), s.alias("last")
        ),
        lambda acc: acc["n"],
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__starts")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )


def rule_values() -> dict[str, Column]:
    """Value of each rule, higher is worse; 0 where there is nothing to divide by."""
    def share(part: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.col(part) / F.col(of)).otherwise(0.0)

    return {
        "symbols": share("n_symbols", "word_chars"),
        "upper_case": share("n_upper", "word_chars"),
        "duplicate_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
    }


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) for X ~ Binomial(n, p), summed exactly term by term in logs."""
    odds = math.log(p) - math.log1p(-p)
    first = n * math.log1p(-p)
    return F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("term"), first.alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] + F.log((n - i + 1) / i) + odds).alias("term"),
            _log_add(acc["total"], acc["term"] + F.log((n - i + 1) / i) + odds).alias("total"),
        ),
        lambda acc: acc["total"],
    )


def _log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def admissible_cutoffs(
    holdout: DataFrame, stratum: str, max_false_rejection: float = 0.01, error: float = 0.05,
    cutoffs: dict[str, tuple[float, ...]] = CUTOFFS,
) -> DataFrame:
    """``(stratum, rule, cutoff, n_good, n_rejected, pooled)``, the lowest admissible cutoff per rule.

    ``holdout`` has the figures of labelled good documents that pass the base
    rule. The rules share ``max_false_rejection`` evenly, so together they stay
    below it. A rule's cutoffs are tested from the laxest downwards until one
    fails, which needs no correction among them. ``error`` is divided by the
    number of these sequences, strata x rules; what one that passed to its end
    had goes to the others (Holm). With probability 1 - ``error`` all bounds hold.

    Strata with too few documents for any test are pooled: their bound is on all
    of them together, as they are mixed among the labelled documents.
    """
    allowed = max_false_rejection / len(cutoffs)
    values = rule_values()
    per_rule = F.array(*[
        F.struct(F.lit(rule).alias("rule"), values[rule].cast("double").alias("value"),
                 F.array(*[F.lit(float(c)) for c in grid]).alias("grid"))
        for rule, grid in cutoffs.items()
    ])
    tested = (
        holdout.select(F.col(stratum).alias("stratum"), F.explode(per_rule).alias("r"))
        .select("stratum", "r.rule", "r.value", F.explode("r.grid").alias("cutoff"))
        .groupBy("stratum", "rule", "cutoff")
        .agg(F.count(F.lit(1)).alias("n_good"),
             F.sum((F.col("value") > F.col("cutoff")).cast("long")).alias("n_rejected"))
    )
    # One row per stratum, rule and cutoff: figures, not documents.
    tested = stored(tested, "quality-tests")
    strata = tested.select("stratum", "n_good").distinct()
    needed = math.log(error / (max(1, strata.count()) * len(cutoffs))) / math.log1p(-allowed)
    small = F.col("n_good") < needed
    pooled = tested.groupBy(
        small.alias("pooled"), F.when(~small, F.col("stratum")).alias("own"), "rule", "cutoff"
    ).agg(F.sum("n_good").alias("n_good"), F.sum("n_rejected").alias("n_rejected"))
    # Beyond the allowed share no test can pass, and its sum need not be made.
    worth = F.col("n_rejected") <= allowed * F.col("n_good")
    p = F.when(worth, log_binomial_cdf(F.col("n_rejected"), F.col("n_good"), allowed)).otherwise(0.0)
    pooled = stored(pooled.withColumn("log_p", p), "quality-bounds")
    hardest = pooled.groupBy("pooled", "own", "rule").agg(F.max("log_p").alias("log_p"))
    level = step_down_level([r.log_p for r in hardest.select("log_p").collect()], error)
    # Fewer documents lie above a laxer cutoff, so all cutoffs above one that passes pass.
    passed = pooled.where(F.col("log_p") <= level).groupBy("pooled", "own", "rule").agg(
        F.min("cutoff").alias("cutoff"),
        F.min_by("n_good", "cutoff").alias("n_good"), F.min_by("n_rejected", "cutoff").alias("n_rejected"),
    )
    members = strata.select("stratum", small.alias("is_small"), F.when(~small, F.col("stratum")).alias("whose"))
    same = (F.col("pooled") == F.col("is_small")) & F.col("own").eqNullSafe(F.col("whose"))
    return members.join(passed, same).select("stratum", "rule", "cutoff", "n_good", "n_rejected", "pooled")


def step_down_level(hardest: list[float], error: float) -> float:
    """Log of the level of the sequences that do not end, from the largest log p of each sequence."""
    left = len(hardest)
    for log_p in sorted(hardest):
        if left == 1 or log_p > math.log(error / left):
            break
        left -= 1
    return math.log(error / max(1, left))


def apply_rules(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_false_rejection: float = 0.01,
    error: float = 0.05,
) -> DataFrame:
    """Figures and verdict per document: ``base_failed``, ``kept``, and ``broken``, the rules it broke."""
    figures = stored(
        features(docs.select("doc_id", F.col(stratum).alias("stratum"), "text"), ["doc_id", "stratum"]),
        "quality-figures",
    ).withColumn("base_failed", base_failed())
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id")
    holdout = figures.where("NOT base_failed").join(good, "doc_id")
    cutoffs = admissible_cutoffs(holdout, "stratum", max_false_rejection, error)
    # One row per stratum; stored, so that its size is known to the planner.
    chosen = stored(
        cutoffs.groupBy("stratum").agg(
            F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")
        ).select(F.col("stratum").alias("__stratum"), "cutoffs"),
        "quality-cutoffs",
    )
    broken = F.filter(
        F.array(*[
            F.when(value > F.coalesce(F.try_element_at("cutoffs", F.lit(rule)), F.lit(float("inf"))), F.lit(rule))
            for rule, value in rule_values().items()
        ]),
        lambda rule: rule.isNotNull(),
    )
    judged = figures.join(chosen, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    return judged.withColumn("broken", broken).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken",
    )
