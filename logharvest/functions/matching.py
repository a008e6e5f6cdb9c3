"""Dictionary matching as conditional chains: one pass, first hit wins."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from logharvest import dictionaries as D
from logharvest.functions.calls import java_quote
from logharvest.functions.text import col

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def term_pattern(term: str, mode: str = "file") -> str:
    """Pattern for an import term, to be searched in lower-cased text.

    ``file`` finds the term anywhere in the text, ``import`` only as the module
    of an import statement. Words of a term may be any whitespace apart.
    """
    body = r"\s+".join(java_quote(w) for w in term.lower().split())
    if mode == "file":
        return f"(?<![a-z0-9_]){body}(?![a-z0-9_])"
    if mode == "import":
        return rf"(?m)(?:^|[;:])[ \t]*(?:import[ \t]+(?:[^#\n]*,[ \t]*)?|from[ \t]+){body}(?![a-z0-9_])"
    raise ValueError(f"mode must be 'file' or 'import', not {mode!r}")


def first_term(
    lowered: Column | str,
    terms: Sequence[tuple[str, str]] = D.FRAMEWORK_TERMS,
    mode: str = "file",
) -> Column:
    """``struct(priority, framework, term)`` of the first term found, or null.

    Takes lower-cased text. The chain stops at the first hit, and a pattern is
    only tried where a plain substring search has found the term's first word.
    """
    lowered = col(lowered)
    hit = None
    for priority, (framework, term) in enumerate(terms):
        value = F.struct(
            F.lit(priority).alias("priority"),
            F.lit(framework).alias("framework"),
            F.lit(term).alias("term"),
        )
        word = term.lower().split()[0]
        found = F.contains(lowered, F.lit(word)) & lowered.rlike(term_pattern(term, mode))
        hit = F.when(found, value) if hit is None else hit.when(found, value)
    return hit


def smell_label(text: Column | str, smells: Sequence[str] = tuple(D.SMELLS)) -> Column:
    """First smell whose name occurs in the text, whatever the case."""
    lowered = F.lower(col(text))
    return F.coalesce(
        *[F.when(F.contains(lowered, F.lit(s.lower())), F.lit(s)) for s in smells]
    )


# A dictionary table is built into one automaton on the driver: at most this many
# terms and bytes of terms, checked before anything is shipped.
MAX_TERMS = 2_000_000
MAX_TERM_BYTES = 256 << 20
_SPACE_RUN = r"[ \t\n\x0b\x0c\r]+"


def term_automaton(terms: Sequence[tuple[int, str, str]], mode: str = "file") -> bytes:
    """A pickled Aho–Corasick automaton of ``(priority, framework, term)`` rows.

    Keys are the terms lower-cased with their words one space apart; the value
    of a key is the list of its rows, best priority first.
    """
    import pickle

    import ahocorasick

    if len(terms) > MAX_TERMS or sum(len(t.encode()) for _, _, t in terms) > MAX_TERM_BYTES:
        raise ValueError(f"a dictionary of terms holds at most {MAX_TERMS} terms and {MAX_TERM_BYTES} bytes")
    term_pattern("x", mode)  # the mode is known
    rows: dict[str, list] = {}
    for priority, framework, term in sorted(terms, key=lambda r: r[0]):
        key = " ".join(term.lower().split())
        if key:
            rows.setdefault(key, []).append((priority, framework, term))
    automaton = ahocorasick.Automaton()
    for key, found in rows.items():
        automaton.add_word(key, found)
    automaton.make_automaton()
    return pickle.dumps((automaton, mode))


def first_terms(lowered: Sequence[str | None], automaton, mode: str, patterns: dict) -> list[tuple | None]:
    """Per lower-cased text the first row ``(priority, framework, term)`` whose pattern matches, or None.

    One pass of the automaton over the text with its runs of space one space
    finds every term that could match (a superset); their patterns are then
    tried by priority, so the result is that of the chain of patterns.
    """
    import re

    out = []
    for text in lowered:
        if text is None:
            out.append(None)
            continue
        flat = re.sub(_SPACE_RUN, " ", text)
        candidates = sorted({row for _, rows in automaton.iter(flat) for row in rows})
        hit = None
        for priority, framework, term in candidates:
            pattern = patterns.get(term)
            if pattern is None:
                pattern = patterns[term] = re.compile(term_pattern(term, mode), re.ASCII)
            if pattern.search(text):
                hit = (priority, framework, term)
                break
        out.append(hit)
    return out
