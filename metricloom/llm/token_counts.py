"""Token counts by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.batches import text_slices, texts_of

#: Pre-tokens a task remembers; the memory is emptied when full.
REMEMBER = 400_000

_SPACE = "▁"
#: First code points of two, three and four bytes.
_UTF8_STEPS = np.array([0x80, 0x800, 0x10000])


class PieceCounter:
    """Token counts under a piece vocabulary with byte fallback and identity normalization.

    A text gets one leading space mark, spaces become marks, and the neighbouring
    symbols whose union is the best-scored piece merge first, leftmost on ties.
    Pieces hold marks only at their start (or nothing else), so no merge crosses
    the end of a word: runs of marks with the following word are counted alone
    and remembered. A character that no piece holds counts its bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, scores = [], []
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                pieces.append(model.id_to_piece(i))
                scores.append(model.get_score(i))
        self.ids = {p: i for i, p in enumerate(pieces)}
        rank = np.unique(-np.array(scores), return_inverse=True)[1]
        self.unknown = len(pieces)
        self.letters = np.full(0x110000, self.unknown, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.letters[ord(piece)] = i
        width = self.width = len(pieces) + 1
        found: dict[int, tuple[int, int]] = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    found[left * width + right] = (int(rank[i]), i)
        self.keys = np.array(sorted(found), np.int64)
        self.rank = np.array([found[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([found[k][1] for k in self.keys.tolist()], np.int64)
        long = [p for p in pieces if len(p) > 1]
        if any(_SPACE in p.lstrip(_SPACE) for p in long):
            raise ValueError("the vocabulary has pieces that span words")
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in long))
        stop = re.escape(alone)
        self.pattern = re.compile(f"{_SPACE}*[^{_SPACE}{stop}]+|{_SPACE}+" + (f"|[{stop}]" if alone else ""))
        self.memory: dict[str, int] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in ``keys``, or -1."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def count_words(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token: every sequence applies its lowest-ranked pair in each round.

        All occurrences that do not overlap are applied at once, from the left up to
        the first that makes a pair of lower rank: that one comes first then.
        """
        n = len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = self.letters[points].astype(np.int64)
        strange = symbols == self.unknown
        extra = np.zeros(n, np.int64)
        if strange.any():
            bytes_more = np.searchsorted(_UTF8_STEPS, points[strange], "right")
            np.add.at(extra, np.repeat(np.arange(n), lengths)[strange], bytes_more)
        totals = lengths.copy()
        own = np.repeat(np.arange(n), lengths)
        # pair[i] joins symbol i and the next of the same sequence; the last has none.
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(lengths)[lengths > 0] - 1] = True
        pair = np.full(len(symbols), -1, np.int64)
        if len(symbols) > 1:
            pair[:-1] = self._pairs(symbols[:-1], symbols[1:])
        pair[last] = -1
        none = np.iinfo(np.int64).max
        rank = np.where(pair >= 0, self.rank[pair], none >> 32)
        starts = np.cumsum(lengths[lengths > 0]) - lengths[lengths > 0]
        while len(symbols):
            sizes = np.diff(np.r_[starts, len(symbols)])
            least = np.minimum.reduceat(rank, starts)
            live = least < none >> 32
            # Sequences without a pair are finished and leave.
            if not live.all():
                stay = np.repeat(live, sizes)
                symbols, own, last, pair, rank = (x[stay] for x in (symbols, own, last, pair, rank))
                if not len(symbols):
                    break
                sizes, least = sizes[live], least[live]
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            # Of occurrences that overlap in a row, every other one.
            order = np.arange(len(at))
            head = np.r_[True, np.diff(at) != 1]
            at = at[(order - np.maximum.accumulate(np.where(head, order, 0))) % 2 == 0]
            made = self.merged[pair[at]]
            if len(at) > len(least):
                keep = self._in_turn(symbols, own, last, at, made, rank[at])
                at, made = at[keep], made[keep]
            symbols[at] = made
            last[at] = last[at + 1]
            totals -= np.bincount(own[at], minlength=n)
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            symbols, own, last, pair, rank = (x[keep] for x in (symbols, own, last, pair, rank))
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            # Only the merged symbols' own pairs and the ones before them have changed.
            i = np.r_[at, at[at > 0] - 1]
            right = np.minimum(i + 1, len(symbols) - 1)
            pair[i] = np.where(last[i], -1, self._pairs(symbols[i], symbols[right]))
            rank[i] = np.where(pair[i] >= 0, self.rank[pair[i]], none >> 32)
        return totals + extra

    def _in_turn(self, symbols, own, last, at, made, rank) -> np.ndarray:
        """Which merges at ``at`` come before any pair of lower rank that an earlier one of its sequence makes."""
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbols) - 1)
        left = symbols[before]
        beside = np.flatnonzero(np.diff(at) == 2) + 1
        left[beside] = made[beside - 1]
        pairs = np.where((at > 0) & (own[before] == own[at]), self._pairs(left, made), -1)
        lower = (pairs >= 0) & (self.rank[pairs] <= rank)
        pairs = np.where(last[at + 1], -1, self._pairs(made, symbols[after]))
        lower |= (pairs >= 0) & (self.rank[pairs] <= rank)
        earlier = np.cumsum(lower) - lower
        first = np.flatnonzero(np.r_[True, own[at][1:] != own[at][:-1]])
        return earlier == np.repeat(earlier[first], np.diff(np.r_[first, len(at)]))

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.pattern.findall(_SPACE + t.replace(" ", _SPACE)) if t else [] for t in texts]
        flat = list(itertools.chain.from_iterable(cut))
        if len(self.memory) > REMEMBER:
            self.memory.clear()
        find = self.memory.get
        counts = np.array([find(w, -1) for w in flat], np.int64)
        new = np.flatnonzero(counts < 0).tolist()
        if new:
            words = list(dict.fromkeys([flat[i] for i in new]))
            self.memory.update(zip(words, self.count_words(words).tolist(), strict=True))
            counts[new] = [self.memory[flat[i]] for i in new]
        ends = np.cumsum([0, *map(len, cut)])
        return np.diff(np.r_[0, np.cumsum(counts)][ends]).tolist()


@functools.lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_bytes, n_tokens)`` for every row of ``docs``; null reads as empty and has none.

    ``path`` names the vocabulary file on each worker. One narrow pass: texts are
    taken in slices, and the pre-tokens a task has not met are merged together.
    Repeated rows each give a row; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for batch in text_slices(batches):
            texts = texts_of(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counter.count(texts), pa.int64()),
                ],
                names=["key", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed("key", key)
