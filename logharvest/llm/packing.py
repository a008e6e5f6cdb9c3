"""Vector best-fit packing of documents into training sequences.

A document becomes its token ids and an end id. Documents longer than a
sequence are cut into full pieces; the first piece takes what is left over. A
full piece is a sequence of its own. All other pieces are packed by best fit: a
piece, longest first, goes to the open sequence that fits it best as a vector of
tokens, documents and attention cost (the sum of squared lengths) under all
three capacities.

Tokenizing has no shuffle. Pieces, a few numbers each, are dealt by hash; a task
packs its own share, so tasks neither wait for one another nor see each other's
sequences. What sharing the work costs is at most one poorly filled sequence per
task and per ``together`` pieces: a few in ten thousand.

Nulls: a null text is empty and packs as the end id alone. Null and repeated ids
are packed row by row like any other. Empty tables give empty results.
"""

from __future__ import annotations

import contextlib
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEQUENCE = 2048
MAX_DOCUMENTS = 512
MAX_ATTENTION = SEQUENCE**2
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
# Bound of the worker's memory of encoded words.
REMEMBERED = 600_000
# Pieces that a task packs at a time: bounds its memory and the open sequences it looks through.
TOGETHER = 8192
# White space as byte-level BPE's own splitting pattern has it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Some letters, and signs that end a run of letters: a word is cut from the signs
# after it, so that it is the same word with and without them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_SIGNS = "!\"#$%&()*+,./:;<=>?@\\[\\]^`{|}~\\-"


class WordEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit words.

    Byte-level BPE never merges across the places where its splitting pattern
    cuts, and it always cuts before the space that precedes a word, around other
    white space, and where letters meet signs. So a text is cut there first, and each distinct word is
    encoded once by the tokenizer and remembered: words recur, and encoding one
    costs far more than looking it up. Strings of added tokens are taken out
    before, as the tokenizer does.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = re.compile(
            f" ?[{_LETTERS}]++(?=[{_SIGNS}{_SPACE}]|$)| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
        ).findall
        added = {token.content for token in self.tokenizer.get_added_tokens_decoder().values()}
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word; one call for all, as each is split off before it is encoded."""
        encoded = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        data = np.array(encoded.ids, "<u4").tobytes()
        ends = 4 * np.searchsorted(np.array(encoded.word_ids), np.arange(len(words)), "right")
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, text: str) -> bytes:
        if self.added:
            parts = self.added.split(text)
            words = [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.cut(part))]
        else:
            words = self.cut(text)
        found = list(map(self.known.get, words))
        missing, at = [], -1
        with contextlib.suppress(ValueError):
            while True:
                missing.append(at := found.index(None, at + 1))
        if missing:
            new = list({words[i] for i in missing})
            made = dict(zip(new, self._ids(new), strict=True))
            if len(self.known) + len(made) <= self.remembered:
                self.known.update(made)
            for i in missing:
                found[i] = made[words[i]]
        return b"".join(found)


def _encoder(path: str) -> WordEncoder:
    """One per worker process and tokenizer file.

    Functions travel by value, so this module's globals are new in every task; what is
    to last as long as the process is kept in a module of its own.
    """
    import public_tokenizers

    kept = sys.modules.setdefault("logharvest_worker", types.ModuleType("logharvest_worker")).__dict__
    if ("words", path) not in kept:
        kept["words", path] = WordEncoder(public_tokenizers.path(path) if "/" not in path else path)
    return kept["words", path]


def cut_lengths(n: int, longest: int) -> list[int]:
    """Lengths of a document's pieces: what is left over first, then full ones."""
    if n <= longest:
        return [n]
    return [n % longest] * bool(n % longest) + [longest] * (n // longest)


def pieces(
    docs: DataFrame, tokenizer: str = TOKENIZER, sequence: int = SEQUENCE, with_ids: bool = False
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` per piece of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoder.encode(text or "") + END_ID.to_bytes(4, "little")
                start = 0
                for at, length in enumerate(cut_lengths(len(ids) // 4, sequence)):
                    part = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, at, start, length, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
                    start += length
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    # Ids pass pandas as text: beside a null it would make floats of them.
    made = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, schema)
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def best_fit(
    lengths: np.ndarray, sequence: int = SEQUENCE, max_documents: int = MAX_DOCUMENTS,
    max_attention: int = MAX_ATTENTION, select: str = "dot", weights: tuple[float, float, float] = (1.0, 0.25, 0.25),
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece.

    ``select`` names how the bin is chosen among those where the piece fits
    under every capacity: ``dot``, the least weighted dot product of the piece
    with the bin's residual capacities (each as a share of the whole), or
    ``norm``, the least weighted norm of the residual that would remain. Ties go
    to the oldest bin.
    """
    size, n_open, made = 1024, 0, 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    # Residual tokens, documents and attention cost of the open bins, in the order they were opened.
    tokens, count, cost, ids = np.empty(size), np.empty(size), np.empty(size), np.empty(size, np.int64)
    w_tokens, w_count, w_cost = weights
    shortest = int(lengths.min(initial=sequence))
    for at in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[at])
        t, d, c = tokens[:n_open], count[:n_open], cost[:n_open]
        fits = np.flatnonzero((t >= n) & (d >= 1) & (c >= n * n))
        if len(fits):
            t, d, c = t[fits] / sequence, d[fits] / max_documents, c[fits] / max_attention
            own = n / sequence, 1 / max_documents, n * n / max_attention
            if select == "dot":
                score = t * (w_tokens * own[0]) + d * (w_count * own[1]) + c * (w_cost * own[2])
            else:
                score = w_tokens * (t - own[0]) ** 2 + w_count * (d - own[1]) ** 2 + w_cost * (c - own[2]) ** 2
            k = int(fits[score.argmin()])
        else:
            if n * n > max_attention:
                raise ValueError(f"a piece of {n} tokens alone exceeds the attention capacity")
            if n_open == size:
                size *= 2
                tokens, count, cost, ids = (np.resize(x, size) for x in (tokens, count, cost, ids))
            k, ids[n_open] = n_open, made
            tokens[k], count[k], cost[k] = sequence, max_documents, max_attention
            n_open, made = n_open + 1, made + 1
        bins[at], offsets[at] = ids[k], sequence - tokens[k]
        tokens[k] -= n
        count[k] -= 1
        cost[k] -= n * n
        if tokens[k] < shortest or count[k] < 1 or cost[k] < shortest * shortest:  # nothing more fits
            for x in (tokens, count, cost, ids):
                x[k : n_open - 1] = x[k + 1 : n_open]
            n_open -= 1
    return bins, offsets


def pack(cut: DataFrame, sequence: int = SEQUENCE, together: int = TOGETHER, **rule) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; ``together`` pieces are packed at a time."""
    columns = cut.columns

    def placed(rows: pd.DataFrame, first: int) -> tuple[pd.DataFrame, int]:
        rows = rows.astype({c: object for c in rows.columns if rows[c].dtype.kind not in "iuf"})
        bins, offsets = best_fit(rows["length"].to_numpy(np.int64), sequence, **rule)
        return rows.assign(sequence_id=first + bins, offset=offsets), first + int(bins.max()) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, kept = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            kept.append(batch)
            if sum(map(len, kept)) >= together:
                rows, first = placed(pd.concat(kept, ignore_index=True), first)
                kept = []
                yield rows
        if kept and sum(map(len, kept)):
            yield placed(pd.concat(kept, ignore_index=True), first)[0]

    dealt = cut.repartition(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1 << 20)))
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    made = dealt.mapInPandas(run, StructType([*dealt.schema]).add("sequence_id", "long").add("offset", "long"))
    return made.withColumn("doc_id", F.col("doc_id").cast(cut.schema["doc_id"].dataType)).select(
        *columns, "sequence_id", "offset"
    )


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, sequence: int = SEQUENCE, with_ids: bool = False, **rule) -> DataFrame:
    """Documents as pieces placed in sequences."""
    return pack(pieces(docs, tokenizer, sequence, with_ids), sequence, **rule)


def sequences(placed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the token ids of each sequence, from pieces packed ``with_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # one sequence, bounded by its capacity
    return placed.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids")
    )
