"""Removal of word runs that an earlier document holds already, by suffix automata of reference shards.

Every window of ``WINDOW`` words has an anchor: its run of ``GRAM`` words of least
hash (the leftmost). Neighbouring windows with one anchor form a segment, and
equal windows have equal anchors, so the segments of one anchor are all that a
window has to be held against. They are the reference shard of that anchor. An
automaton of all earlier documents has no size bound and cannot be broadcast;
shards are dealt out by anchor instead, after equal segments have been
aggregated: only anchors with different segments need an automaton.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.batches import text_slices
from metricloom.llm.words import Words, blocks, grams, mix, window_hashes
from metricloom.sources.scratch import written

WINDOW = 13
GRAM = 5
#: Segments a task remembers to settle repeats by itself.
REMEMBER = 1 << 20
#: Reference segments of one automaton; a larger shard is streamed through several.
SHARD = 20_000
#: Bytes of a word's hash in a segment. Words are compared within one anchor only.
WORD_BYTES = 6

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class SuffixAutomaton:
    """All runs of the sequences added, as states with their longest length, suffix link and steps."""

    def __init__(self):
        self.steps: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, steps: dict[int, int], link: int) -> int:
        self.steps.append(steps)
        self.length.append(length)
        self.link.append(link)
        return len(self.steps) - 1

    def _split(self, last: int, word: int, to: int) -> int:
        """A copy of ``to`` for runs no longer than ``last``'s with ``word``."""
        copy = self._state(self.length[last] + 1, dict(self.steps[to]), self.link[to])
        self.link[to] = copy
        while last >= 0 and self.steps[last].get(word) == to:
            self.steps[last][word] = copy
            last = self.link[last]
        return copy

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            to = self.steps[last].get(word)
            if to is not None:
                last = to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
                continue
            new = self._state(self.length[last] + 1, {}, 0)
            at = last
            while at >= 0 and word not in self.steps[at]:
                self.steps[at][word] = new
                at = self.link[at]
            if at >= 0:
                to = self.steps[at][word]
                self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
            last = new

    def matching(self, words: list[int]) -> list[int]:
        """Matching statistics: the longest run ending at each word that some sequence added holds."""
        out, at, length = [], 0, 0
        for word in words:
            while at and word not in self.steps[at]:
                at = self.link[at]
                length = self.length[at]
            to = self.steps[at].get(word)
            if to is None:
                length = 0
            else:
                at, length = to, length + 1
            out.append(length)
        return out


class Segments:
    """Segments of a block of texts: row, first window, number of windows, anchor, hash."""

    def __init__(self, words: Words):
        hashes, at = grams(words, GRAM)
        doc = words.doc[at]
        width = WINDOW - GRAM + 1
        n = len(hashes) - width + 1
        empty = np.zeros(0, np.int64)
        self.doc = self.start = self.count = empty
        self.anchor = self.hash = np.zeros(0, np.uint64)
        if n <= 0:
            return
        least = hashes[:n].copy()
        place = np.arange(n)
        for j in range(1, width):
            better = hashes[j : n + j] < least
            np.copyto(least, hashes[j : n + j], where=better)
            np.copyto(place, np.arange(j, n + j), where=better)
        whole = np.flatnonzero(doc[:n] == doc[width - 1 :])
        if not len(whole):
            return
        place = place[whole]
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[whole][1:] != doc[whole][:-1])])
        self.doc = doc[whole[first]]
        self.start = at[whole[first]]
        self.count = np.diff(np.r_[first, len(whole)])
        self.anchor = hashes[place[first]]
        # The words of the segment and the anchor's place in it.
        size = self.count + WINDOW - 1
        whole_hash = np.zeros(len(first), np.uint64)
        for length in np.unique(size).tolist():
            own = size == length
            whole_hash[own] = window_hashes(words.hash, length)[self.start[own]]
        shift = (at[place[first]] - self.start).astype(np.uint64)
        with np.errstate(over="ignore"):
            self.hash = mix(whole_hash + (shift * np.uint64(64) + size.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct segments of each row. ``repeat``: a smaller key of this task is known to hold it."""
    known: dict[int, object] = {}
    for batch in text_slices(batches):
        for words in blocks(batch.column("text")):
            own = Segments(words)
            keys = batch.column("key").slice(words.rows.start, len(words.first) - 1).to_pylist()
            at, anchors, hashes, repeats = [], [], [], []
            seen: set[tuple[int, int]] = set()
            for doc, anchor, value in zip(own.doc.tolist(), own.anchor.tolist(), own.hash.tolist(), strict=True):
                if (doc, value) in seen or keys[doc] is None:
                    continue
                seen.add((doc, value))
                before = known.get(value)
                repeat = before is not None and before < keys[doc]
                if not repeat:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[value] = keys[doc]
                at.append(doc)
                anchors.append(anchor)
                hashes.append(value)
                repeats.append(repeat)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array([words.rows.start + i for i in at], pa.int64())),
                    pa.array(np.array(anchors, np.uint64).view(np.int64)),
                    pa.array(np.array(hashes, np.uint64).view(np.int64)),
                    pa.array(repeats, pa.bool_()),
                ],
                names=["key", "anchor", "segment", "repeat"],
            )


def _with_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.compute.greater(pa.compute.list_value_length(batch.column("open")).fill_null(0), 0))


def _open_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the segments that must be matched: those of the row's list ``open``."""
    for batch in text_slices(_with_open(batches)):
        for words in blocks(batch.column("text")):
            own = Segments(words)
            lists = batch.column("open").slice(words.rows.start, len(words.first) - 1).to_pylist()
            wanted = [set(x or ()) for x in lists]
            signed = own.hash.view(np.int64).tolist()
            raw = words.hash.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
            rows = []
            for i, (doc, value) in enumerate(zip(own.doc.tolist(), signed, strict=True)):
                if value in wanted[doc]:
                    wanted[doc].discard(value)
                    rows.append(i)
            ends = own.start + own.count + WINDOW - 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(words.rows.start + own.doc[rows])),
                    pa.array(own.anchor.view(np.int64)[rows]),
                    pa.array(own.hash.view(np.int64)[rows]),
                    pa.array([raw[own.start[i] : ends[i]].tobytes() for i in rows], pa.binary()),
                ],
                names=["key", "anchor", "segment", "words"],
            )


def _covered(group: list[tuple[object, int, bytes]]) -> Iterator[tuple[object, int, list[int]]]:
    """``(key, segment, windows)`` of one anchor's segments, by key: windows that a smaller key's segment holds."""
    sequences = [np.frombuffer(w, np.uint8).reshape(-1, WORD_BYTES) for _, _, w in group]
    padded = [np.pad(s, ((0, 0), (0, 8 - WORD_BYTES))).reshape(-1).view(np.uint64).tolist() for s in sequences]
    hit: list[set[int]] = [set() for _ in group]
    for base in range(0, len(group), SHARD):
        automaton, waiting = SuffixAutomaton(), []
        for i in range(base, len(group)):
            if waiting and group[waiting[0]][0] != group[i][0]:
                for j in waiting:
                    automaton.add(padded[j])
                waiting = []
            found = automaton.matching(padded[i])
            hit[i].update(end - WINDOW + 1 for end, n in enumerate(found) if n >= WINDOW)
            if i < base + SHARD:
                waiting.append(i)
    for (key, segment, _), windows in zip(group, hit, strict=True):
        if windows:
            yield key, segment, sorted(windows)


def _match_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by anchor and key, one shard at a time."""
    group: list[tuple[object, int, bytes]] = []
    current = None
    kind = None
    for batch in batches:
        kind = batch.schema.field("key").type
        done = []
        for anchor, key, segment, words in zip(
            *(batch.column(c).to_pylist() for c in ("anchor", "key", "segment", "words")), strict=True
        ):
            if anchor != current and group:
                done += _covered(group)
                group = []
            current = anchor
            group.append((key, segment, words))
        yield _hits(done, kind)
    if group:
        yield _hits(list(_covered(group)), kind)


def _hits(rows: list[tuple[object, int, list[int]]], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], kind),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.list_(pa.int32())),
        ],
        names=["key", "segment", "windows"],
    )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        counts, removed, kept = [], [], []
        for words in blocks(batch.column("text")):
            n_rows = len(words.first) - 1
            gone, hits = (batch.column(c).slice(words.rows.start, n_rows).to_pylist() for c in ("gone", "hits"))
            gone = [set(x or ()) for x in gone]
            hits = [{h["segment"]: h["windows"] for h in x or ()} for x in hits]
            edge = np.zeros(len(words.hash) + 1, np.int64)
            if any(gone) or any(hits):
                own = Segments(words)
                for doc, start, count, value in zip(
                    own.doc.tolist(), own.start.tolist(), own.count.tolist(), own.hash.view(np.int64).tolist(), strict=True
                ):
                    if value in gone[doc]:
                        edge[start] += 1
                        edge[start + count + WINDOW - 1] -= 1
                    for i in hits[doc].get(value, ()):
                        edge[start + i] += 1
                        edge[start + i + WINDOW] -= 1
            stays = np.cumsum(edge)[:-1] == 0
            for i in range(n_rows):
                found = _WORD.findall(words.data[words.offsets[i] : words.offsets[i + 1]].tobytes())
                mask = stays[words.first[i] : words.first[i + 1]].tolist()
                left = list(compress(found, mask))
                counts.append(len(found))
                removed.append(len(found) - len(left))
                kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=["key", "n_words", "n_removed", "kept"],
        )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, n_removed, kept)`` for every row of ``docs``.

    A word goes if a window of ``WINDOW`` words over it also stands in a row of
    smaller key, judged on the texts as given; ``kept`` are the other words,
    joined by one space. Null texts read as empty. Rows of equal key are not
    earlier than each other, and null keys neither remove nor lose anything.
    Other columns are not looked at.

    Texts are shuffled once (by key, read by two steps). A segment that repeats
    within a task is settled there, so hot passages reach the shuffle once a
    task; the rest is settled by the least key of each segment, and the automata
    see one row per different segment.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(_segment_rows, f"key {kind}, anchor long, segment long, repeat boolean")
    same, shard = Window.partitionBy("anchor", "segment"), Window.partitionBy("anchor")
    placed = (
        found.where("NOT repeat")
        .select("anchor", "segment", "key")
        .repartition("anchor")
        .withColumn("owner", F.min("key").over(same))
        .withColumn("one", F.min("segment").over(shard) == F.max("segment").over(shard))
        .withColumn("gone", F.col("key") > F.col("owner"))
        .where("gone OR NOT one")
    )
    settled = (
        placed.select("key", "segment", "gone")
        .unionByName(found.where("repeat").select("key", "segment", F.lit(True).alias("gone")))
        .groupBy("key")
        .agg(
            F.collect_set(F.when(F.col("gone"), F.col("segment"))).alias("gone"),
            F.collect_set(F.when(~F.col("gone"), F.col("segment"))).alias("open"),
        )
    )
    settled = written(settled.withColumnRenamed("key", "own"))
    held = rows.join(settled, F.col("key") == F.col("own"), "left").drop("own")
    # Rows without open segments are left out by the function: a filter here would make the
    # two joins read different exchanges of the texts.
    hits = (
        held.select("key", "text", "open")
        .mapInArrow(_open_segments, f"key {kind}, anchor long, segment long, words binary")
        .dropDuplicates(["key", "segment"])
        .repartition("anchor")
        .sortWithinPartitions("anchor", "key")
        .mapInArrow(_match_shards, f"key {kind}, segment long, windows array<int>")
        .groupBy(F.col("key").alias("own"))
        .agg(F.collect_list(F.struct("segment", "windows")).alias("hits"))
    )
    return (
        held.join(hits, F.col("key") == F.col("own"), "left")
        .select("key", "text", "gone", "hits")
        .mapInArrow(_kept, f"key {kind}, n_words long, n_removed long, kept string")
        .withColumnRenamed("key", key)
    )
