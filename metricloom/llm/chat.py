"""Chat formatting at the level of tokens, with loss masks."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metricloom.llm.batches import lists, text_slices, texts_of

# The template's control strings.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED_ROLE = "assistant"

_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    """``text`` with a backslash more in every ``<|``, ``<\\|``, and so on: no control string is left."""
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


class ChatVocabulary:
    """A byte-level vocabulary of ranks and three reserved ids above it."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in file if line.strip())}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.start, self.separator, self.end = range(max(ranks.values()) + 1, max(ranks.values()) + 4)

    def turn(self, role: str, text: str) -> tuple[list[int], np.ndarray, str]:
        """Ids, loss mask and text of one turn.

        Role and content are escaped and encoded each by itself, so no token
        spans a control string; the mask is the running sum of +1 where the
        learned content starts and -1 where it ends.
        """
        role, text = escape(role), escape(text)
        head, body = self.encoding.encode_ordinary(role), self.encoding.encode_ordinary(text)
        ids = [self.start, *head, self.separator, *body, self.end]
        edge = np.zeros(len(ids), np.int8)
        if role == LEARNED_ROLE:
            edge[len(head) + 2 if body else -1] += 1
            edge[-1] -= 1
        return ids, np.cumsum(edge, dtype=np.int8), f"{START}{role}{SEPARATOR}{text}{END}"

    def read_turn(self, ids: list[int], mask: list[int]) -> tuple[str, str, str]:
        """Role, content and learned text of one turn's ids."""
        middle = ids.index(self.separator)
        decode = self.encoding.decode
        learned = [i for i, m in zip(ids, mask, strict=True) if m]
        return unescape(decode(ids[1:middle])), unescape(decode(ids[middle + 1 : -1])), unescape(decode(learned))


@functools.lru_cache(maxsize=2)
def chat_vocabulary(path: str, pattern: str) -> ChatVocabulary:
    return ChatVocabulary(path, pattern)


def format_chat(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(conv_id, turn, position, ids, mask, formatted)`` for every row of ``turns(conv_id, turn, role, text)``.

    ``position`` is the number of the conversation's tokens before the turn;
    rows come in order of conversation, turn, role and text within a partition,
    and a conversation lies in one partition. A conversation is one training
    sequence, so its rows are streamed in order, never gathered; nothing but a
    running count is held. Null role and text read as empty, null turns come
    first, repeated rows are kept; other columns are not looked at.
    """
    ordered = (
        turns.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat = chat_vocabulary(path, pattern)
        current, position = (), 0
        for batch in text_slices(batches):
            places, ids, counts, masks, texts = [], [], [], [], []
            for conv, role, text in zip(
                batch.column("conv_id").to_pylist(), texts_of(batch, "role"), texts_of(batch), strict=True
            ):
                if (conv,) != current:
                    current, position = (conv,), 0
                own, mask, formatted = chat.turn(role, text)
                places.append(position)
                position += len(own)
                ids += own
                counts.append(len(own))
                masks.append(mask)
                texts.append(formatted)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    batch.column("turn"),
                    pa.array(places, pa.int64()),
                    lists(ids, counts, pa.int32()),
                    lists(np.concatenate(masks), counts, pa.int8()),
                    pa.array(texts, pa.string()),
                ],
                names=["conv_id", "turn", "position", "ids", "mask", "formatted"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    return ordered.mapInArrow(
        run,
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, position long, ids array<int>,"
        " mask array<tinyint>, formatted string",
    )


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row of digests per conversation of ``format_chat``'s rows, read from ids and mask alone.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``;
    the rows must come as ``format_chat`` leaves them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat = chat_vocabulary(path, pattern)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        open_: dict | None = None
        for batch in batches:
            done = []
            for row in batch.select(["conv_id", "ids", "mask", "formatted"]).to_pylist():
                if open_ is None or open_["conv_id"] != row["conv_id"]:
                    done += [open_] if open_ else []
                    open_ = dict(zip(names, (row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0), strict=True))
                role, text, learned = chat.read_turn(row["ids"], row["mask"])
                open_["n_turns"] += 1
                open_["turns_sha256"].update(f"{role}\n{text}\n".encode())
                open_["loss_chars"] += len(learned)
                open_["loss_sha256"].update(learned.encode())
                open_["formatted_chars"] += len(row["formatted"])
            yield _digests(done, batch.schema.field("conv_id").type, names)
        if open_:
            yield _digests([open_], batch.schema.field("conv_id").type, names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(
        run,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def _digests(rows: list[dict], key: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = [
        pa.array([r[n].hexdigest() if n.endswith("sha256") else r[n] for r in rows], kind)
        for n, kind in zip(names, kinds, strict=True)
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)
