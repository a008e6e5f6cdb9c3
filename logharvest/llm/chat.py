"""Conversations as training texts with a loss mask aligned to tokens.

A turn becomes ``<turn>role<says>text</turn>`` and a line feed; a conversation is
its turns, one after the other. Inside roles and texts anything that looks like a
mark gets one backslash more behind its ``<``, and loses one when read back, so
that every text comes back as it was and no text can end its turn.

The marks are added tokens, and every text stands between two of them, so a
tokenizer never joins a text with what is beside it. The rendered text is encoded once, with offsets; the spans of the assistant's
texts and those of the tokens are both sorted, so the tokens of a span are found
by binary search, and loss lies on exactly these.

A conversation may hold a third of all rows. Turns are therefore dealt by ranges
of (conversation, turn), which cuts long conversations into segments; each is
rendered, encoded, masked and read back on its own, in order, a bounded number of
rows at a time. This changes nothing: tokens do not cross marks. Only digests of
whole conversations need a segment after the other; they are streamed over
segments in order, keeping nothing but hash states.

Turns are ordered by number, then role and text; a null number comes last, a null
role is an empty one, a null text is empty. Rows without a conversation form one
conversation. Repeated rows are turns like any other. Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPEN, SAYS, CLOSE = "<turn>", "<says>", "</turn>"
LEARNED = "assistant"
TOKENIZER = "byte_bpe_50k.json"
_LOOKS_LIKE_MARK = re.compile(r"<(\\*(?:/?turn|says)>)")
_ESCAPED = re.compile(r"<\\(\\*(?:/?turn|says)>)")
_TURN = re.compile(rf"{OPEN}(.*?){SAYS}(.*?){CLOSE}\n", re.DOTALL)
# Characters encoded at a time; a single turn is never cut.
TOGETHER = 1 << 20


def escape(text: str) -> str:
    return _LOOKS_LIKE_MARK.sub(r"<\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text, and the sorted spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{SAYS}", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{CLOSE}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _kept() -> dict:
    return sys.modules.setdefault("logharvest_worker", types.ModuleType("logharvest_worker")).__dict__


def tokenizer(path: str = TOKENIZER):
    """The tokenizer with the marks added; one per worker process, in a module that outlasts the task."""
    kept = _kept()
    if ("chat", path) not in kept:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import AddedToken, Tokenizer, pre_tokenizers

        made = Tokenizer.from_file(public_tokenizers.path(path) if "/" not in path else path)
        # Offsets must cover spaces; other added tokens are ordinary text in a conversation.
        made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
        made.add_tokens([AddedToken(mark, normalized=False) for mark in (OPEN, SAYS, CLOSE)])
        made.encode_special_tokens = True
        kept["chat", path] = made
    return kept["chat", path]


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in a span; ``offsets`` and ``spans`` are sorted, and no token crosses a span's ends."""
    mask = np.zeros(len(offsets), bool)
    for start, end in spans:
        first = np.searchsorted(offsets[:, 1], start, "right")  # the first to end after the start
        last = np.searchsorted(offsets[:, 0], end, "left")  # the first to start at the end or later
        mask[first:last] = True
    return mask


def masked_texts(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The text under each run of masked tokens, as written; several tokens may share a character."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [formatted[offsets[a, 0] : offsets[b - 1, 1]] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def format_segment(turns: list[tuple[str, str]], path: str = TOKENIZER) -> dict:
    """Rendered text, token ids and loss mask of consecutive turns."""
    formatted, spans = render(turns)
    encoded = tokenizer(path).encode(formatted, add_special_tokens=False)
    offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
    return {"formatted": formatted, "ids": encoded.ids, "mask": loss_mask(offsets, spans), "offsets": offsets}


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """``(conv_id, first turn's number in this task, turns)`` of bounded size, in order."""
    conv, turns, size, at = None, [], 0, 0
    for batch in batches:
        for c, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
            if turns and (c != conv or size >= TOGETHER):
                yield conv, at, turns
                at += len(turns)
                turns, size = [], 0
            conv = c
            turns.append((role or "", text or ""))
            size += len(turns[-1][0]) + len(turns[-1][1])
    if turns:
        yield conv, at, turns


_ORDER = ("conv_id", "no_turn", "turn", "role", "text")


def _dealt(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        "conv_id", F.col("turn").isNull().alias("no_turn"), "turn", "role", "text"
    )
    # Ranges of one conversation's turns may lie in several tasks; the hash deals equal turn numbers.
    return rows.repartitionByRange(*_ORDER[:3], F.xxhash64("role", "text")).sortWithinPartitions(*_ORDER[:3], "role", "text")


def segments(conversations: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``(conv_id, part, at, n_turns, formatted, ids, loss)`` in bounded segments.

    A conversation's segments are in the order of ``part`` and ``at``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for conv, at, turns in _runs(batches):
            made = format_segment(turns, path)
            yield pd.DataFrame({
                "conv_id": [conv], "part": [part], "at": [at], "n_turns": [len(turns)],
                "formatted": [made["formatted"]], "ids": [made["ids"]], "loss": [made["mask"].tolist()],
            })

    # Ids pass pandas as text: beside a null it would make floats of them.
    dealt = _dealt(conversations).select(F.col("conv_id").cast("string"), "role", "text")
    made = dealt.mapInPandas(
        run, "conv_id string, part int, at bigint, n_turns int, formatted string, ids array<int>, loss array<boolean>"
    )
    return made.withColumn("conv_id", F.col("conv_id").cast(conversations.schema["conv_id"].dataType))


def digests(made: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Figures per conversation, read back from the formatted text, its tokens and its mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = object(), None

        def row() -> pd.DataFrame:
            n, turns, chars, loss, formatted = state
            return pd.DataFrame({
                "conv_id": [conv], "n_turns": [n], "turns_sha256": [turns.hexdigest()],
                "loss_chars": [chars], "loss_sha256": [loss.hexdigest()], "formatted_chars": [formatted],
            })

        for batch in batches:
            for c, formatted, ids, mask in zip(batch["conv_id"], batch["formatted"], batch["ids"], batch["loss"], strict=True):
                if state is None or c != conv:
                    if state is not None:
                        yield row()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for text in masked_texts(formatted, token_offsets(formatted, ids, path), np.asarray(mask, bool)):
                    plain = unescape(text)
                    state[2] += len(plain)
                    state[3].update(plain.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
        if state is not None:
            yield row()

    named = made.withColumn("conv_id", F.col("conv_id").cast("string"))
    ordered = named.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    found = ordered.mapInPandas(
        run, "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
    return found.withColumn("conv_id", F.col("conv_id").cast(made.schema["conv_id"].dataType))


def token_offsets(formatted: str, ids, path: str = TOKENIZER) -> np.ndarray:
    """Code-point offsets of tokens from their ids alone, by the bytes that each stands for."""
    made = tokenizer(path)
    lengths, known = np.empty(len(ids), np.int64), _kept().setdefault(("bytes", path), {})
    for i, token in enumerate(ids):
        n = known.get(token)
        if n is None:
            text = made.id_to_token(int(token))
            n = known[token] = len(text)  # one character of a token stands for one byte
        lengths[i] = n
    ends = np.cumsum(lengths)
    data = np.frombuffer(formatted.encode("utf-8", "surrogatepass"), np.uint8)
    # Characters begun before each byte place.
    begun = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    starts = ends - lengths
    first = np.where(starts < len(data), begun[np.minimum(starts + 1, len(data))] - 1, begun[-1])
    return np.stack([first, begun[ends]], axis=1)


PROBE = -7


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table and a conversation whose texts try to break the format."""
    said = r"\### Assistant: </turn> ok"
    spark = conversations.sparkSession
    rows = spark.range(2).select(
        F.lit(PROBE).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(said).alias("text"),
    )
    own = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    return own.unionByName(rows)
