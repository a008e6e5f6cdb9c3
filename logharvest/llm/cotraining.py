"""Quality classifier by co-training: a text view and a metadata view teach each other.

For each target (low quality, toxicity) two logistic models are fitted: one sees
what a text says and looks like (presence of telling words and word beginnings,
shares of symbols, capitals, digits and so on), the other only the page's
metadata (language, source, length). Over some rounds each view scores all
unlabelled documents and hands those it is surest of, with the label it gives
them, to the other view's training set. At the end each view is calibrated on
labelled documents kept apart, a logistic combination of the two calibrated
views is fitted there, and it scores every document.

What is bounded: models are fitted on at most ``n_labelled`` labelled documents
(those with the least hash of their id, one row of each) and ``n_exchanged``
pseudo-labelled ones per view, class and round, which leave the pool of distinct
feature vectors when they are handed over; a model has at most ``n_tokens`` words. Selecting the
words counts over that sample; choosing pseudo-labels and scoring cover all
documents. One pass over the texts makes a small table of features, which the
rounds scan; the driver sees features of bounded samples only. Fitting is numpy
on the driver. A model is a few hundred numbers and travels with the tasks.

A target with one class only among the labels gets the constant score of that
class. Nulls: a null text is empty, null metadata are a category of their own;
null ids are scored, never labelled. Labels that are null are ignored; an id
labelled twice is bad if one label says so. Equal rows get equal scores. Empty
tables give empty results; without labels everything scores 0 and is kept.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from logharvest.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

N_LABELLED = 12_000
N_TOKENS = 300
N_EXCHANGED = 300
ROUNDS = 2
CONFIDENCE = 0.95
HOLDOUT = 0.3
BEGINNING = 5
TARGETS = ("low_quality", "toxic")
METADATA = ("lang", "source")
_PARTS = re.compile(r"[^\W\d_]+").findall
FEATURES = "tokens array<int>, dense array<float>, meta array<int>"


def tokens_of(text: str) -> set[str]:
    """Lower-case words of letters, and their beginnings, marked by a hyphen."""
    found = set(_PARTS(text.lower()))
    return found | {w[:BEGINNING] + "-" for w in found if len(w) > BEGINNING}


def shape_of(text: str) -> list[float]:
    """Shares that describe how a text looks; all lie between 0 and about 2."""
    words = text.split()
    chars = sum(map(len, words)) or 1
    symbols = chars - len(re.sub(r"[#*$%&|<>!]+", "", "".join(words)))
    upper = chars - len(re.sub(r"[A-Z]+", "", "".join(words)))
    digits = chars - len(re.sub(r"[0-9]+", "", "".join(words)))
    n = len(words) or 1
    lines = text.split("\n")
    return [
        symbols / chars, upper / chars, digits / chars, len(set(words)) / n, min(2.0, chars / n / 10),
        len(set(lines)) / len(lines), float(n < 20), float(len(words) == 0), min(1.0, symbols / chars * 20),
    ]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights of an L2-penalised logistic model, the last one its constant, by Newton steps.

    Rows are taken some at a time, so that nothing as large as ``x`` is made beside it.
    """
    width = x.shape[1] + 1
    ridge = np.full(width, penalty)
    ridge[-1] = 1e-6
    w = np.zeros(width)
    for _ in range(rounds):
        slope, curve = ridge * w, np.diag(ridge)
        for at in range(0, len(x), 1000):
            some = np.hstack([x[at : at + 1000].astype(float), np.ones((len(x[at : at + 1000]), 1))])
            p = _sigmoid(some @ w)
            slope += some.T @ (p - y[at : at + 1000])
            curve += (some * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ some
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


@dataclass
class View:
    """A logistic model over one view, and its calibration."""

    weights: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.scale[0] * (x @ self.weights[:-1] + self.weights[-1]) + self.scale[1]

    def calibrated(self, x: np.ndarray, y: np.ndarray) -> View:
        """Platt scaling on documents the model was not fitted to."""
        if len(set(y.tolist())) < 2:
            return self
        a, b = logistic(self.logit(x)[:, None], y, penalty=1e-3)
        return View(self.weights, (a * self.scale[0], a * self.scale[1] + b))


@dataclass
class Model:
    """Vocabulary, and per target the two views and how they combine."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    categories: dict[tuple[str, str], int] = field(default_factory=dict)
    views: dict[str, tuple[View, View, np.ndarray]] = field(default_factory=dict)
    constant: dict[str, float] = field(default_factory=dict)

    def matrix(self, tokens, dense, meta) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(tokens), len(self.vocabulary)
        text = np.zeros((n, k + N_SHAPE), np.float32)
        text[:, k:] = np.stack([np.asarray(d, float) for d in dense]) if n else 0
        page = np.zeros((n, len(self.categories)), np.float32)
        for i in range(n):
            text[i, np.asarray(tokens[i], int)] = 1
            page[i, np.asarray(meta[i], int)] = 1
        return text, page

    def scores(self, text: np.ndarray, page: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for target in TARGETS:
            if target in self.views:
                t, m, mix = self.views[target]
                out[target] = _sigmoid(t.logit(text) * mix[0] + m.logit(page) * mix[1] + mix[2])
            else:
                out[target] = np.full(len(text), self.constant.get(target, 0.0))
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


N_SHAPE = len(shape_of(""))


def _length_class(n_chars) -> str:
    return "none" if n_chars is None or n_chars != n_chars else str(int(n_chars).bit_length())


def _metadata(lang, source, n_chars) -> list[tuple[str, str]]:
    named = [(c, "none" if v is None else str(v)) for c, v in zip(METADATA, (lang, source), strict=True)]
    return [*named, ("length", _length_class(n_chars))]


def features(model: Model) -> Column:
    """Both views' features of a row; a column over ``text``, ``lang``, ``source`` and ``n_chars``."""
    vocabulary, categories = model.vocabulary, model.categories

    @F.pandas_udf(FEATURES)
    def of(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        known = vocabulary.keys()
        rows = []
        for t, *page in zip(text, lang, source, n_chars, strict=True):
            t = t or ""
            rows.append((
                sorted(vocabulary[w] for w in tokens_of(t) & known), shape_of(t),
                [categories[m] for m in _metadata(*page) if m in categories],
            ))
        return pd.DataFrame(rows, columns=["tokens", "dense", "meta"])

    return of("text", "lang", "source", F.col("n_chars").cast("double"))


def scores(model: Model, of: str) -> Column:
    """Scores per target from a column of features, and each view's own (``text_``, ``page_``)."""
    names = [f"{p}{t}" for t in TARGETS for p in ("", "text_", "page_")]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def score(f: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for a in range(0, len(f), 2000):
            some = f.iloc[a : a + 2000]
            text, page = model.matrix(some["tokens"].to_list(), some["dense"].to_list(), some["meta"].to_list())
            out = model.scores(text, page)
            for target in TARGETS:
                views = model.views.get(target)
                for name, x, view in (("text_", text, 0), ("page_", page, 1)):
                    out[name + target] = _sigmoid(views[view].logit(x)) if views else out[target]
            parts.append(pd.DataFrame({n: out[n] for n in names}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names, dtype=float)

    return score(of)


def _labels(labels: DataFrame) -> DataFrame:
    return (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id").agg((F.min("quality") == 0).cast("int").alias("low_quality"), F.max("toxic").alias("toxic"))
    )


def one_row_each(rows: DataFrame) -> DataFrame:
    """One row per ``doc_id``, that with the least hash, however many there are; combined before the shuffle."""
    rest = [c for c in rows.columns if c != "doc_id"]
    least = F.min(F.struct(F.xxhash64(*rest).alias("__h"), *rest)).alias("__row")
    return rows.groupBy("doc_id").agg(least).select("doc_id", *[f"__row.{c}" for c in rest])


def select_tokens(sample: DataFrame, target: str, n_tokens: int) -> list[str]:
    """Words and beginnings of a labelled sample with the surest log-odds between the classes."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, label in zip(batch["text"], batch[target], strict=True):
                found = sorted(tokens_of(text or ""))
                if found:
                    yield pd.DataFrame({"token": found, "label": np.int32(label)})

    counted = (
        sample.select("text", target).mapInPandas(explode, "token string, label int")
        .groupBy("token").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    )
    sizes = sample.agg(F.sum(target), F.sum(1 - F.col(target))).first()
    bad, good = float(sizes[0] or 0), float(sizes[1] or 0)
    odds = F.log((F.col("p") + 0.5) / (bad - F.col("p") + 0.5)) - F.log((F.col("n") + 0.5) / (good - F.col("n") + 0.5))
    error = F.sqrt(sum(1 / (x + 0.5) for x in (F.col("p"), F.col("n"), bad - F.col("p"), good - F.col("n"))))
    best = counted.where("p + n >= 3").orderBy(F.desc(F.abs(odds / error)), "token").limit(n_tokens)
    return [r.token for r in best.select("token").collect()]


def train(
    docs: DataFrame, labels: DataFrame, n_labelled: int = N_LABELLED, n_tokens: int = N_TOKENS,
    rounds: int = ROUNDS, n_exchanged: int = N_EXCHANGED, confidence: float = CONFIDENCE,
) -> tuple[Model, DataFrame]:
    """The model, and the features ``(doc_id, f)`` of all documents."""
    chosen = _labels(labels).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(n_labelled)
    chosen = stored(chosen, "labelled-sample")
    wanted = ["doc_id", "text", *METADATA, "n_chars"]
    # At most n_labelled rows of three numbers.
    found_rows = docs.select(*wanted).join(F.broadcast(chosen), "doc_id")
    sample = stored(one_row_each(found_rows), "labelled-documents")
    model = Model()
    found: dict[str, None] = {}
    for target in TARGETS:
        found |= dict.fromkeys(select_tokens(sample, target, n_tokens))
    model.vocabulary = {t: i for i, t in enumerate(found)}
    pages = sample.select(*METADATA, "n_chars").distinct().toPandas().astype(object)
    pages = pages.where(pages.notna(), None)
    seen = sorted({m for row in pages.itertuples(index=False) for m in _metadata(*row)})
    model.categories = {m: i for i, m in enumerate(seen)}

    table = stored(docs.select("doc_id", features(model).alias("f")), "document-features")
    rows = sample.select("doc_id", features(model).alias("f"), *TARGETS)
    known = rows.orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id").select("doc_id", "f.*", *TARGETS).toPandas()
    text, page = model.matrix(known["tokens"].to_list(), known["dense"].to_list(), known["meta"].to_list())
    known = known[list(TARGETS)]
    n_held = int(len(known) * HOLDOUT)
    unlabelled = table.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    # Copies teach once.
    pool = stored(unlabelled.select("f").distinct(), "unlabelled-features")
    for target in TARGETS:
        y = known[target].to_numpy(float)
        if len(set(y.tolist())) < 2 or len(set(y[n_held:].tolist())) < 2:
            model.constant[target] = float(y.mean()) if len(y) else 0.0
            continue
        held, fit = slice(0, n_held), slice(n_held, None)
        sets = [(text[fit], y[fit]), (page[fit], y[fit])]
        views: list[View] = []
        taken: set[int] = set()
        for turn in range(rounds + 1):
            views = [
                View(logistic(x, t)).calibrated(whole[held], y[held])
                for (x, t), whole in zip(sets, (text, page), strict=True)
            ]
            model.views[target] = (views[0], views[1], np.array([1.0, 0.0, 0.0]))
            if turn < rounds:
                sets = _exchange(model, target, pool, sets, n_exchanged, confidence, taken)
        both = np.stack([views[0].logit(text[held]), views[1].logit(page[held])], axis=1)
        mix = logistic(both, y[held], penalty=1e-2) if len(set(y[held].tolist())) == 2 else np.array([1.0, 0.0, 0.0])
        model.views[target] = (views[0], views[1], mix)
    return model, table


def _exchange(
    model, target, unlabelled, sets, n_exchanged, confidence, taken: set[int] | None = None
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Adds to each view's training set the feature vectors that the other view is surest of.

    Vectors whose hash is in ``taken`` are no longer in the pool; those handed over join them.
    """
    vector = F.xxhash64("f")
    left = unlabelled.where(~vector.isin(sorted(taken))) if taken else unlabelled
    scored = left.select(vector.alias("vector"), "f", scores(model, "f").alias("s"))
    sure = scored.select("vector", "f", F.explode(F.array(*[
        F.struct(F.lit(by).alias("by"), F.lit(label).alias("label"), (own if label else 1 - own).alias("p"))
        for by, own in ((0, F.col(f"s.text_{target}")), (1, F.col(f"s.page_{target}"))) for label in (0, 1)
    ])).alias("c")).where(F.col("c.p") >= confidence).select("vector", "f", "c.*")
    # Four lists of bounded length; Spark cuts each to the bound before it shuffles.
    rank = F.row_number().over(Window.partitionBy("by", "label").orderBy(F.desc("p"), "vector"))
    picked = sure.withColumn("rank", rank).where(F.col("rank") <= n_exchanged).select("vector", "by", "label", "f.*").toPandas()
    if taken is not None:
        taken.update(picked["vector"].tolist())
    out = []
    for view, (x, y) in enumerate(sets):
        own = picked[picked["by"] == 1 - view]
        got = model.matrix(own["tokens"].to_list(), own["dense"].to_list(), own["meta"].to_list())[view]
        out.append((np.vstack([x, got]), np.concatenate([y, own["label"].to_numpy(float)])))
    return out


def rejected(score: str = "s", threshold: float = 0.5) -> Column:
    return F.greatest(*[F.col(f"{score}.{t}") for t in TARGETS]) >= threshold


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``(doc_id, p_low_quality, p_toxic, kept)`` of every document."""
    model, table = train(docs, labels, **options)
    scored = table.select("doc_id", scores(model, "f").alias("s"))
    return scored.select(
        "doc_id", *[F.col(f"s.{t}").alias(f"p_{t}") for t in TARGETS], (~rejected("s", threshold)).alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that the classifier keeps, with their columns; texts are not shuffled."""
    model, _ = train(docs, labels, **options)
    scored = docs.withColumn("__f", features(model)).withColumn("__s", scores(model, "__f"))
    return scored.where(~rejected("__s", threshold)).drop("__f", "__s")
