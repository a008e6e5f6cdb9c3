"""Secrets: known forms by pattern, and strings too random to be words.

Three known forms are matched by pattern. Beyond them, every run of characters
that could be an encoded key is put to a battery of randomness tests, chosen by
the encoding inferred from its characters:

- uniformity: the chi-squared statistic of its characters against the even use
  of the alphabet;
- runs: how often the character class (upper case, lower case, digit, other)
  changes from one character to the next;
- serial correlation: how far neighbouring characters' places in the alphabet
  depend on one another.

A test asks how often a string of that length, made of the characters and
character pairs that words in the corpus are made of, would look as random; the
moments of each statistic under that law are worked out from counts over all
texts. The three answers, which are not independent, are combined by the Cauchy
rule (the mean of the tangents of the p-values). Short strings are never sure,
long ones are tested many times over: per class of length, the step-up rule of
Benjamini and Hochberg over all candidates of the corpus finds the level at which
at most ``rate`` of the strings called secrets are words. Its counts are kept by
p-values rounded up to a tenth of a power of two, which errs on the safe side and
bounds them, so neither ranking nor counting gathers candidates anywhere.

One pass over the texts counts characters, one finds patterns and candidates; what
is stored is spans, not texts. Nulls: a null text is empty; null ids stay;
repeated rows are judged each and count each. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from logharvest.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}

# Alphabets in the order of their codes; the first that holds all characters is inferred.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
LENGTHS = (16, 24, 32, 48, 64, 128)
RATE = 0.05
_STEPS = 10  # p-values are rounded up to the tenth part of a power of two


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` by start, then kind as listed."""
    found = [
        *[(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]],
        *[(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]],
        *[(m.start(), m.end(), 2) for m in _HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]],
    ]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def character_counts(docs: DataFrame) -> np.ndarray:
    """How often each pair of ASCII characters follows one another within words, 128 x 128, over all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(128 * 128, np.int64)
        for batch in batches:
            for text in batch["text"]:
                data = np.frombuffer((text or "").encode("ascii", "replace"), np.uint8)
                for at in range(0, max(0, len(data) - 1), 1 << 22):
                    part = data[at : at + (1 << 22) + 1].astype(np.int32)
                    total += np.bincount(part[:-1] * 128 + part[1:], minlength=128 * 128)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pair": at, "n": total[at]})

    counted = docs.select("text").mapInPandas(count, "pair bigint, n bigint")
    rows = counted.groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 16,384 rows at most
    pairs = np.zeros((128, 128))
    for r in rows:
        pairs.flat[r.pair] = r.n
    return pairs


def encoding_of(string: str) -> str:
    held = set(string.rstrip("="))
    return next((name for name, alphabet in ENCODINGS.items() if held <= set(alphabet)), "mixed")


class Battery:
    """The tests against the law of the corpus's words; ``pairs`` as from ``character_counts``."""

    def __init__(self, pairs: np.ndarray):
        self.laws = {}
        for name, alphabet in ENCODINGS.items():
            codes = np.frombuffer(alphabet.encode(), np.uint8)
            # One of each pair is added, so that nothing is impossible.
            two = pairs[np.ix_(codes, codes)] + 1.0 / len(codes)
            two /= two.sum()
            one = (two.sum(0) + two.sum(1)) / 2
            kind = np.array([0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isdigit() else 3 for c in alphabet])
            place = np.arange(len(alphabet), dtype=float)
            changes = float(two[kind[:, None] != kind[None, :]].sum())
            centred = place - one @ place
            spread = float(one @ centred**2) or 1.0
            self.laws[name] = (one, changes, float((two * np.outer(centred, centred)).sum()) / spread, kind, centred, spread)
        self.places = {name: {c: i for i, c in enumerate(a)} for name, a in ENCODINGS.items()}

    def p_value(self, string: str) -> tuple[str, float]:
        """The inferred encoding, and how likely a word would look as random."""
        name = encoding_of(string)
        one, changes, serial, kind, centred, spread = self.laws[name]
        x = np.array([self.places[name][c] for c in string if c in self.places[name]])
        n, k = len(x), len(one)
        if n < 8:
            return name, 1.0
        counts = np.bincount(x, minlength=k)
        # Uniformity: mean and variance of sum(count^2) under the law, then its lower tail.
        s2, s3 = float((one**2).sum()), float((one**3).sum())
        mean = n + n * (n - 1) * s2
        variance = 2 * n * (n - 1) * s2 + 4 * n * (n - 1) * (n - 2) * s3 - 2 * n * (n - 1) * (2 * n - 3) * s2**2
        uniform = _normal((float((counts**2).sum()) - mean) / math.sqrt(max(variance, 1e-9)))
        # Runs: changes of class are as many or more.
        seen = int((kind[x[1:]] != kind[x[:-1]]).sum())
        runs = _normal((changes * (n - 1) - seen + 0.5) / math.sqrt((n - 1) * changes * (1 - changes) + 1e-9))
        # Serial correlation: as far from the words' own as independence would put it, or farther.
        got = float((centred[x[1:]] * centred[x[:-1]]).sum()) / spread / (n - 1)
        away = (got - serial) * (1 if serial < 0 else -1)
        serial_p = _normal(-away * math.sqrt(n - 1))
        tangents = [math.tan((0.5 - min(max(p, 1e-15), 1 - 1e-15)) * math.pi) for p in (uniform, runs, serial_p)]
        combined = 0.5 - math.atan(sum(tangents) / 3) / math.pi
        return name, min(1.0, max(combined, 1e-15))


def _normal(z: float) -> float:
    """P(Z <= z)."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _step(p: float) -> int:
    """p-values by size: the least step is the least p; step s stands for 2 ** (s / 10)."""
    return math.ceil(math.log2(p) * _STEPS)


def _length_class(n: int) -> int:
    return sum(n >= low for low in LENGTHS)


SPAN = "struct<start:int,end:int,kind:string>"
CANDIDATE = "struct<start:int,end:int,encoding:string,length:int,step:int>"


def scan(docs: DataFrame, battery: Battery) -> DataFrame:
    """``(doc_id, base, candidates)`` per row; candidates lie outside base spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base, candidates = [], []
            for text in batch.pop("text"):
                text = text or ""
                own = base_spans(text)
                tried, at, reached = [], 0, 0
                for m in _CANDIDATE.finditer(text):
                    while at < len(own) and own[at][0] < m.end():
                        reached, at = max(reached, own[at][1]), at + 1
                    if reached > m.start():
                        continue
                    name, p = battery.p_value(m[0])
                    tried.append((m.start(), m.end(), name, _length_class(m.end() - m.start()), _step(p)))
                base.append([dict(zip(("start", "end", "kind"), s, strict=True)) for s in own])
                candidates.append([dict(zip(("start", "end", "encoding", "length", "step"), c, strict=True)) for c in tried])
            yield batch.assign(base=base, candidates=candidates)

    # Ids pass pandas as text: beside a null it would make floats of them.
    made = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        run, f"doc_id string, base array<{SPAN}>, candidates array<{CANDIDATE}>"
    )
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def levels(scanned: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Per class of length the largest step of p-values that is still called a secret."""
    counted = (
        scanned.select(F.explode("candidates").alias("c")).groupBy("c.length", "c.step").agg(F.count(F.lit(1)).alias("n"))
    )
    # Some hundred steps per class of length at most.
    upward = Window.partitionBy("length").orderBy("step")
    ranked = counted.select(
        "length", "step", F.sum("n").over(upward).alias("rank"), F.sum("n").over(Window.partitionBy("length")).alias("m")
    )
    p = F.pow(F.lit(2.0), F.col("step") / _STEPS)
    called = ranked.where(p <= F.col("rank") * rate / F.col("m")).groupBy("length").agg(F.max("step").alias("step"))
    return {r.length: r.step for r in called.collect()}


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``(doc_id, base, found)``: spans of known forms, and of strings called random with their encoding."""
    scanned = stored(scan(docs, Battery(character_counts(docs))), "secret-candidates")
    level = levels(scanned, rate)
    steps = F.create_map(*[F.lit(x) for pair in level.items() for x in pair]) if level else F.create_map().cast("map<int,int>")
    found = F.filter("candidates", lambda c: c["step"] <= F.coalesce(F.try_element_at(steps, c["length"]), F.lit(-(10**6))))
    return scanned.select(
        "doc_id", "base",
        F.transform(found, lambda c: F.struct(c["start"], c["end"], F.concat(F.lit("random_"), c["encoding"]).alias("kind"))).alias("found"),
    )


def digests(found: DataFrame) -> DataFrame:
    """Counts and the spans as text, base spans by start, then those of the battery by start."""

    def text(spans):
        return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))

    def of(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    order = lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"], s["kind"])
    every = F.sort_array(F.transform(F.concat("base", "found"), order))
    return found.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(text("base"), ","), 256).alias("base_sha256"),
        F.array_join(text(every), ",").alias("spans"), F.size("found").cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``(doc_id, text)`` with each found span replaced by its kind in angle brackets; needs distinct ids."""
    found = find_secrets(docs, rate).select(F.col("doc_id").alias("__id"), F.concat("base", "found").alias("spans"))

    @F.pandas_udf("string")
    def blank(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans, strict=True):
            if t is None or own is None:
                out.append(t)
                continue
            parts, at = [], 0
            for s in sorted(own, key=lambda s: (s["start"], -s["end"])):
                if s["end"] > at:
                    parts += [t[at : max(at, s["start"])], f"<{s['kind']}>"]
                    at = s["end"]
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return joined.select("doc_id", blank("text", "spans").alias("text"))
