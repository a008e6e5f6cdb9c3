"""Personal data and the terms that give it away.

Four kinds of personal data are found by pattern: e-mail and IP addresses, card
and phone numbers. Beyond them, a term can reveal whose data it stands next to.
How strongly is estimated from the corpus: a term t discloses an entity e (one
address or number) by their pointwise mutual information

    PMI(t, e) = log2( N * n(t, e) / (n(t) * n(e)) )

with N documents, n(t) and n(e) documents that have t and e, and n(t, e)
documents in which t stands within ``REACH`` characters of e. It is held against
all there is to know about e, IC(e) = log2(N / n(e)): a term with
PMI >= ``alpha`` * IC next to e is hidden there. If the class of the term, its
first letters, discloses less than that, the term is generalised to its class;
otherwise it is removed. At least ``support`` documents must show the pair; one
alone estimates nothing.

Everything is DataFrame expressions. Matches and their places come from a
text's own pieces: what lies between matches (``split``) and the matches
themselves (``regexp_extract_all``) give the places by running sums, in code
points. Patterns take runs of characters whole, so that long runs cost linear
time and no recursion. Corpus counts are combined on the map side; only small
rows about entities and the terms around them are shuffled.

Nulls: a null text is empty. Null ids stay, repeated rows are judged each, and
count each in the statistics. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logharvest.llm.common import row_key, whole
from logharvest.operators.layout import computed_once
from logharvest.session import stored

KINDS = ("email", "ip", "card", "phone")
# The lookbehind keeps runs from being tried at each of their characters; \G
# lets a run go on after a match that ended within it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Cheap signs without which a pattern cannot match.
SIGNS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"\p{L}{3,}+"
REACH = 60
CLASS_LETTERS = 3
ALPHA = 0.8
SUPPORT = 2
_BLOCK = 256


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + _doubled(F.substring(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1),
    )
    return total % 10 == 0


def _doubled(digit: Column, twice: Column) -> Column:
    return F.when(twice, F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)).otherwise(digit)


def _holds(kind: str, match: Column) -> Column:
    """Whether a match of the pattern is one of the kind."""
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        return F.forall(F.split(match, r"\."), lambda p: part(p) & (F.right(p, F.lit(3)).cast("int") <= 255))
    digits = F.regexp_replace(match, "[^0-9]+", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _running(lengths: Column) -> Column:
    """Sums of all elements before each one; in blocks, so that long arrays do not cost their square."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(_BLOCK)), lambda at: F.slice(lengths, at + 1, _BLOCK)
    )

    def within(block: Column, start: Column) -> Column:
        return F.aggregate(
            block, F.struct(start.alias("sum"), F.array().cast("array<int>").alias("out")),
            lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")),
        )

    return F.aggregate(
        blocks, F.struct(F.lit(0).alias("sum"), F.array().cast("array<array<int>>").alias("out")),
        lambda acc, block: F.struct(
            within(block, acc["sum"])["sum"].alias("sum"),
            F.concat(acc["out"], F.array(within(block, acc["sum"])["out"])).alias("out"),
        ),
        lambda acc: F.flatten(acc["out"]),
    )


def _matches(rows: DataFrame, kind: str, text: str) -> DataFrame:
    """Adds a column named ``kind``: ``array<struct<start, end, value, left, right>>`` of valid matches."""
    pattern, sign = F.lit(PATTERNS[kind]), SIGNS[kind]
    possible = F.contains(text, F.lit(sign)) if sign else F.lit(True)
    # Texts without a match have one gap and no further work.
    found = F.when(possible, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = computed_once(rows, "__found", found)
    some = F.size("__found") > 0
    rows = computed_once(rows, "__gaps", F.when(some, F.split(text, PATTERNS[kind], -1)))
    lengths = F.transform("__found", lambda m, i: F.length(F.get("__gaps", i)) + F.length(m))
    rows = computed_once(rows, "__before", F.when(some, _running(lengths)))

    def described(m: Column, i: Column) -> Column:
        start = F.get("__before", i) + F.length(F.get("__gaps", i))
        left, right = F.get("__gaps", i), F.get("__gaps", i + 1)
        # One more character than reach tells whether the outermost word is whole.
        return F.struct(
            start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"),
            F.right(F.concat(F.lit(" "), left), F.lit(REACH + 1)).alias("left"),
            F.left(F.concat(right, F.lit(" ")), F.lit(REACH + 1)).alias("right"),
        )

    valid = F.filter(F.transform("__found", described), lambda m: _holds(kind, m["value"]))
    return rows.withColumn(kind, F.when(some, valid).otherwise(
        F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    )).drop("__found", "__gaps", "__before")


def base_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, email, ip, card, phone)``: valid matches with what stands around them."""
    rows = docs.select("doc_id", row_key().alias("key"), whole("text").alias("__text"))
    for kind in KINDS:
        rows = _matches(rows, kind, "__text")
    return rows.drop("__text")


def _entity(kind: Column, value: Column) -> Column:
    """The same address or number, however written."""
    return F.when(kind.isin("card", "phone"), F.regexp_replace(value, "[^0-9]+", "")).otherwise(F.lower(value))


def _tagged(kind: str, value) -> Column:
    """Elements of a kind's array as ``(kind, value)``."""
    return F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), value(m)))


def _marked(kind: str) -> Column:
    return F.transform(kind, lambda m: F.struct(m["start"], m["end"], F.lit(f"<{kind}>").alias("by")))


def _terms_around(spans: DataFrame) -> DataFrame:
    """``(key, kind, entity, term, start, end)`` of terms near valid matches, outside all of them."""
    every = F.concat(*[_tagged(k, lambda m: m.alias("m")) for k in KINDS])
    rows = spans.select("key", F.explode(every).alias("s"), *[F.transform(k, lambda m: F.struct(m["start"], m["end"])).alias(k) for k in KINDS])
    taken = F.concat(*KINDS)
    sides = F.array(
        F.struct((F.col("s.m.start") - F.length("s.m.left")).alias("at"), F.col("s.m.left").alias("text"), F.lit(True).alias("left")),
        F.struct(F.col("s.m.end").alias("at"), F.col("s.m.right").alias("text"), F.lit(False).alias("left")),
    )
    rows = rows.select(
        "key", F.col("s.kind").alias("kind"), _entity(F.col("s.kind"), F.col("s.m.value")).alias("entity"),
        taken.alias("taken"), F.explode(sides).alias("side"),
    )
    # On the left a word needs something before it, on the right something behind it.
    patterns = rf"(?<=\P{{L}}){TERM}", rf"{TERM}(?=\P{{L}})"
    found = F.when(F.col("side.left"), F.regexp_extract_all("side.text", F.lit(patterns[0]), F.lit(0))).otherwise(
        F.regexp_extract_all("side.text", F.lit(patterns[1]), F.lit(0)))
    gaps = F.when(F.col("side.left"), F.split("side.text", patterns[0], -1)).otherwise(F.split("side.text", patterns[1], -1))
    rows = computed_once(computed_once(rows, "found", found), "gaps", gaps).where(F.size("found") > 0)
    lengths = F.transform("found", lambda m, i: F.length(F.get("gaps", i)) + F.length(m))
    rows = computed_once(rows, "before", _running(lengths))
    placed = F.transform("found", lambda m, i: F.struct(
        (F.col("side.at") + F.get("before", i) + F.length(F.get("gaps", i))).alias("start"), m.alias("term")))
    rows = rows.select("key", "kind", "entity", "taken", F.explode(placed).alias("t"))
    start, end = F.col("t.start"), F.col("t.start") + F.length("t.term")
    free = ~F.exists("taken", lambda s: (s["start"] < end) & (s["end"] > start))
    return rows.where(free).select(
        "key", "kind", "entity", F.lower("t.term").alias("term"), start.alias("start"), end.alias("end")
    ).distinct()


def disclosing_terms(
    docs: DataFrame, around: DataFrame, spans: DataFrame, alpha: float = ALPHA, support: int = SUPPORT
) -> DataFrame:
    """``(kind, entity, term, share, action)``: pairs at or over the threshold; ``share`` is PMI / IC."""
    text = F.lower(whole("text"))
    terms = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))).alias("term"))
    n_term = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    entities = spans.select("key", F.explode(F.concat(*[
        _tagged(k, lambda m: m["value"].alias("value")) for k in KINDS
    ])).alias("s")).select("key", F.col("s.kind").alias("kind"), _entity(F.col("s.kind"), F.col("s.value")).alias("entity"))
    n_entity = entities.distinct().groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n_e"))
    n_pair = around.select("key", "kind", "entity", "term").distinct().groupBy("kind", "entity", "term").agg(
        F.count(F.lit(1)).alias("n_te")
    )
    total = float(max(1, docs.count()))
    prefix = F.substring("term", 1, CLASS_LETTERS)
    counted = stored(
        n_pair.join(n_entity, ["kind", "entity"]).join(n_term, "term").withColumn("class", prefix), "term-counts"
    )
    # The class of a term: how often any of its terms is there, and there with the entity.
    classes = stored(n_term.groupBy(prefix.alias("class")).agg(F.sum("n_t").alias("n_c")), "term-classes")
    together = counted.groupBy("kind", "entity", "class").agg(F.sum("n_te").alias("n_ce"))
    known = F.log2(F.lit(total) / F.col("n_e"))

    def share(n_both: str, n_own: str) -> Column:
        pmi = F.log2(F.lit(total) * F.col(n_both) / (F.col(n_own) * F.col("n_e")))
        return F.when(known > 0, pmi / known).otherwise(0.0)

    over = counted.where(F.col("n_te") >= support).withColumn("share", share("n_te", "n_t")).where(F.col("share") >= alpha)
    over = over.join(together, ["kind", "entity", "class"]).join(classes, "class")
    action = F.when(share("n_ce", "n_c") < alpha, "generalise").otherwise("remove")
    return over.select("kind", "entity", "term", "share", action.alias("action"))


def find_personal_data(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """``(doc_id, key, email, ip, card, phone, terms)``; all but the first two are arrays of spans.

    A base span is ``(start, end, value)``; a term is ``(start, end, action, kind)`` with the kind it gives away.
    """
    spans = stored(base_spans(docs), "personal-data")
    around = stored(_terms_around(spans.dropDuplicates(["key"])), "terms-around")
    over = disclosing_terms(docs, around, spans, alpha, support)
    terms = (
        around.join(over, ["kind", "entity", "term"])
        .groupBy("key", "start", "end").agg(F.max("action").alias("action"), F.min("kind").alias("kind"))
        .groupBy(F.col("key").alias("__key"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "action", "kind"))).alias("terms"))
    )
    plain = [F.transform(k, lambda m: F.struct(m["start"], m["end"], m["value"])).alias(k) for k in KINDS]
    empty = F.array().cast("array<struct<start:int,end:int,action:string,kind:string>>")
    return spans.join(terms, F.col("key") == F.col("__key"), "left").select(
        "doc_id", "key", *plain, F.coalesce("terms", empty).alias("terms")
    )


def _listed(kind: str, column: str) -> Column:
    return F.transform(column, lambda m: F.concat_ws(":", F.lit(kind), m["start"], m["end"]))


def digests(found: DataFrame) -> DataFrame:
    """Counts and the spans as text, base spans first, then terms."""
    base = F.array_join(F.concat(*[_listed(k, k) for k in KINDS]), ",")
    every = F.array_join(F.concat(*[_listed(k, k) for k in KINDS], _listed("term", "terms")), ",")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), F.size("terms").cast("long").alias("n_terms"),
    )


def sanitise(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """``docs`` with personal data replaced by its kind, disclosing terms by their class or a blank mark."""
    found = find_personal_data(docs, alpha, support)
    every = F.concat(
        *[_marked(k) for k in KINDS],
        F.transform("terms", lambda m: F.struct(m["start"], m["end"], m["action"].alias("by"))),
    )
    marks = found.select(F.col("key").alias("__key"), F.sort_array(every).alias("__marks")).where(
        F.size("__marks") > 0).dropDuplicates(["__key"])
    rows = docs.withColumn("__key", row_key()).join(marks, "__key", "left")
    text = F.col("text")

    def replaced(acc: Column, m: Column) -> Column:
        # Overlapping finds are one blank: the later one goes on from where the former ended.
        start = F.greatest(m["start"], acc["at"])
        gap = F.substring(text, acc["at"] + 1, start - acc["at"])
        term = F.substring(text, m["start"] + 1, F.lit(CLASS_LETTERS))
        by = F.when(m["by"] == "generalise", F.concat(term, F.lit("*"))).when(m["by"] == "remove", "<term>").otherwise(m["by"])
        ends = m["end"] > acc["at"]
        return F.struct(
            F.when(ends, m["end"]).otherwise(acc["at"]).alias("at"),
            F.when(ends, F.concat(acc["out"], F.array(gap, by))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("__marks", start, replaced, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(F.col("__marks").isNull(), text).otherwise(done)
    return rows.select(*[clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
