from __future__ import annotations

import collections
import math
import re

from pyspark.sql import functions as F

from logharvest.llm import quality_rules as Q


def figures(text):
    text = text or ""
    w = re.findall(r"[^ \t-\r]+", text)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    counts, covered = collections.Counter(grams), set()
    for k, g in enumerate(grams):
        if counts[g] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_figures_equal_brute_force(messy, documents, prose, clashing):
    lines = prose(60, 1).split("\n")
    more = documents([(50, "\n".join(lines + lines[:3] + ["# & * x"])), (51, "a b c d e f g h a b c d e f g h"),
                      (52, "a b c d e f g a b c d e f g h"), (53, "z " * 8), (54, "z " * 9)])
    docs = clashing(messy.unionByName(more))
    got = Q.features(docs, ["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == figures(r.text), r.doc_id


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10, 0.1), (3, 50, 0.02), (7, 4000, 0.002), (100, 20000, 0.004), (10, 10, 0.3)]
    for k, n, p in cases:
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                            + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        row = spark.range(1).select(Q.log_binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first()
        assert math.isclose(math.exp(row.x), want, rel_tol=1e-9), (k, n, p)


def test_cutoff_bounds_false_rejections_and_needs_evidence(spark, documents, prose):
    good = [(i, prose(40, i), "en" if i % 10 else "xx", "s") for i in range(3000)]
    bad = [(10_000 + i, prose(40, i).replace(" ", "# "), "en", "s") for i in range(50)]
    docs = documents(good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in Q.apply_rules(docs, labels, max_false_rejection=0.02).collect()}
    assert all(out[i].kept for i, *_ in good)
    assert not any(out[10_000 + i].kept for i in range(50))
    assert all("symbols" in out[10_000 + i].broken for i in range(50))
    # 300 labelled documents of a stratum bound no rate as low: its rules reject nothing.
    rare = documents([(20_000, prose(40, 1).replace(" ", "# "), "xx", "s")])
    again = Q.apply_rules(docs.unionByName(rare), labels, max_false_rejection=0.02)
    assert again.where("doc_id = 20000").first().kept


def test_messy_and_empty(spark, messy, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    out = Q.apply_rules(clashing(messy), labels).collect()
    assert len(out) == messy.count()
    assert all(r.base_failed and not r.kept for r in out if r.doc_id in (3, 4, 5, 7))
    assert Q.apply_rules(messy.limit(0), labels.limit(0)).count() == 0


def test_production_parameters_reject_junk_in_pooled_strata(spark, documents, prose):
    sizes = {"en": 1800, "de": 600, "fr": 500, "es": 400}
    langs = [lang for lang, n in sizes.items() for _ in range(n)]
    good = [(i, prose(40, i), lang, "s") for i, lang in enumerate(langs)]
    junk = [(10_000 + i, prose(40, i).replace(" ", "# "), lang, "s") for i, lang in enumerate(sizes)]
    shout = [(20_000 + i, prose(40, i).upper(), lang, "s") for i, lang in enumerate(sizes)]
    # No good document of this language is labelled: nothing bounds its rules.
    other = [(30_000, prose(40, 1).replace(" ", "# "), "zz", "s")]
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in Q.apply_rules(documents(good + junk + shout + other), labels).collect()}
    assert all(out[i].kept for i, *_ in good) and out[30_000].kept
    assert all("symbols" in out[i].broken for i, *_ in junk)
    assert all("upper_case" in out[i].broken for i, *_ in shout)


def test_level_steps_down():
    assert math.isclose(Q.step_down_level([0.0, 0.0], 0.05), math.log(0.025))
    assert math.isclose(Q.step_down_level([-50.0, 0.0, -50.0], 0.05), math.log(0.05))
    assert math.isclose(Q.step_down_level([math.log(0.03), math.log(0.03)], 0.05), math.log(0.025))
    assert math.isclose(Q.step_down_level([], 0.05), math.log(0.05))
