from __future__ import annotations

import hashlib
import math
import re

from logharvest.llm import disclosure as D

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    found = [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]
    return hashlib.sha256(",".join(found).encode()).hexdigest(), found


TEXTS = [
    "x a@b.c_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.4 0000000255.0.0.0 256.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112",
    "+1 (234) 567-8901 +12 +1234567 ++49 30 123456789 +1(((((((((9", "é😀 a@b.co ..a@b..c\nA.B%c+d@x-y.z.w é@b.c" * 3,
    "6011000990139424 5105105105105100 0000000000000000 49927398716", "@ a@ @b a@b a@b. .@a.b", " 12.1.1.1 mail me@x.org " * 400,
    "1-2 3-4" * 100, "a" * 20_000 + "@", "a@" + "b." * 5000, "1." * 9000, "1.2.3.4" * 300,
]


def test_base_spans_equal_brute_force(documents, messy, clashing):
    docs = clashing(messy.unionByName(documents(list(enumerate(TEXTS, 100)))))
    texts = docs.select("doc_id", "text").collect()
    got = D.digests(D.find_personal_data(docs)).collect()
    want = sorted((str(r.doc_id), *brute(r.text)) for r in texts)
    have = sorted((str(r.doc_id), r.base_sha256, [s for s in r.spans.split(",") if s and not s.startswith("term")]) for r in got)
    assert have == want
    for r in got:
        kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_terms] == [kinds.count(k) for k in (*D.KINDS, "term")]


def test_terms_follow_the_information_they_give(documents, prose):
    rows = [(i, prose(30, i)) for i in range(300)]
    # "zanzibar" only ever stands beside the address; "common" stands everywhere.
    rows += [(1000 + i, f"common zanzibar writes from jo@ex.org today common {prose(20, i)}") for i in range(4)]
    rows += [(2000 + i, f"common words {prose(20, 50 + i)}") for i in range(100)]
    rows += [(3000, "once onlyhere bo@ex.org")]
    docs = documents(rows)
    found = {r.doc_id: r for r in D.find_personal_data(docs).collect()}
    texts = dict(rows)
    hidden = {texts[i][t.start : t.end] for i, r in found.items() for t in r.terms}
    assert "zanzibar" in hidden and "common" not in hidden and "onlyhere" not in hidden
    assert not any(r.terms for i, r in found.items() if i < 1000 or i >= 2000)
    # PMI and IC by hand: 405 documents, the pair, the term and the entity in 4.
    spans = D.base_spans(docs)
    around = D._terms_around(spans)
    pairs = {r.term: r for r in D.disclosing_terms(docs, around, spans, alpha=0.01).collect() if r.entity == "jo@ex.org"}
    n = len(rows)
    assert math.isclose(pairs["zanzibar"].share, 1.0)
    assert math.isclose(pairs["common"].share, math.log2(n * 4 / (104 * 4)) / math.log2(n / 4))


def test_sanitised_text(documents, prose, clashing):
    rows = [(i, prose(30, i)) for i in range(200)]
    rows += [(1000 + i, f"é zanzibar writes jo@ex.org, {prose(12, i)} 4111 1111 1111 1111") for i in range(4)] + [(5, None)]
    docs = clashing(documents(rows))
    out = D.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.where("doc_id >= 1000").collect():
        assert "jo@ex.org" not in r.text and "zanzibar" not in r.text and "<email>" in r.text and "<card>" in r.text
        assert r.text.startswith("é ") and ("zan*" in r.text or "<term>" in r.text)
    untouched = {r.doc_id: r.text for r in out.where("doc_id < 1000").collect()}
    assert all(untouched[i] == t for i, t in rows if i < 200 and i != 5)


def test_empty(documents, messy):
    assert D.digests(D.find_personal_data(messy.limit(0))).count() == 0
    assert D.sanitise(documents([(1, None)])).first().text is None
