from __future__ import annotations

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from logharvest.llm import packing as P


@pytest.fixture(scope="module")
def whole_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_word_encoder_equals_the_tokenizer(whole_tokenizer, messy):
    texts = [r.text or "" for r in messy.collect()] + [
        "a  b\n\n c\t\td 's it's  \n x", " lead", "trail  ", " x  y　z\x1cq\x85r", "<|endoftext|> a<|endoftext|>",
        "don't'll 12ab!!?? é漢😀 \r\n\r\n  end", "   ", "\n", "'s\n's",
    ]
    for remembered in (400_000, 3):
        encoder = P.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), remembered)
        for t in texts:
            assert np.frombuffer(encoder.encode(t), "<u4").tolist() == whole_tokenizer.encode(t, add_special_tokens=False).ids


def check(rows, docs, tokenizer, sequence=2048):
    """Every token of every document once, in order, and no sequence over-full or with gaps."""
    want = collections.Counter()
    for r in docs:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        first, start = len(ids) % sequence or sequence, 0
        cuts = [len(ids)] if len(ids) <= sequence else [first] + [sequence] * ((len(ids) - first) // sequence)
        for k, n in enumerate(cuts):
            want[r.doc_id, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            start += n
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    placed = collections.defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= sequence
    return placed


def test_packs_whole_documents(messy, clashing, documents, prose, whole_tokenizer):
    docs = messy.unionByName(documents([(100 + i, prose(20 + 37 * i % 900, i)) for i in range(200)]))
    rows = P.packed(clashing(docs)).collect()
    placed = check(rows, docs.collect(), whole_tokenizer)
    total = sum(r.length for r in rows)
    assert len(placed) <= total / 2048 * 1.03 + 8
    assert P.packed(docs.limit(0)).count() == 0


def test_sequences_hold_the_ids(documents, prose):
    placed = P.packed(documents([(i, prose(300 + i, i)) for i in range(20)]), with_ids=True)
    rows = placed.collect()
    ids = {r.sequence_id: r.ids for r in P.sequences(placed).collect()}
    for r in rows:
        assert ids[r.sequence_id][r.offset : r.offset + r.length] == r.ids


@pytest.mark.parametrize("select", ["dot", "norm"])
def test_every_capacity_holds(select):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 400, 3000)
    bins, offsets = P.best_fit(lengths, 2048, max_documents=9, max_attention=400_000, select=select)
    for b in range(bins.max() + 1):
        own = lengths[bins == b]
        assert len(own) <= 9 and own.sum() <= 2048 and (own.astype(float) ** 2).sum() <= 400_000
        at = np.argsort(offsets[bins == b])
        assert (np.cumsum(own[at]) - own[at] == offsets[bins == b][at]).all()
    need = max(lengths.sum() / 2048, len(lengths) / 9, (lengths.astype(float) ** 2).sum() / 400_000)
    assert bins.max() + 1 <= need * 1.3 + 1
    with pytest.raises(ValueError):
        P.best_fit(np.array([700]), 2048, max_attention=400_000)


def test_no_pieces():
    assert [len(x) for x in P.best_fit(np.array([], np.int64))] == [0, 0]
