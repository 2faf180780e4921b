"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.batches import text_slices
from metricloom.llm.words import blocks, grams, window_hashes
from metricloom.sources.scratch import written

#: Words of the shortest tile, and of a seed.
LEAST_TILE = 5
#: Bits, as a power of two, of the map of the tests' seeds by which texts drop theirs before the join.
#: With very many tests more seeds pass it; none is lost.
MAP_BITS = 26
_CHUNK = 32768
#: Share of a test's words that tiles must cover.
COVERAGE = 0.5
_FIRST_LENGTH = 20


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of each text's words, split at white space and ASCII marks."""
    for words in blocks(texts, lower=True, marks=True):
        for i in range(len(words.first) - 1):
            yield words.hash[words.first[i] : words.first[i + 1]]


def seeds(
    texts: pa.Array, k: int = LEAST_TILE, wanted: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct hashes of each text's runs of ``k`` words, and how often each occurs.

    With ``wanted``, a map of bits, only those whose bit is set.
    """
    for words in blocks(texts, lower=True, marks=True):
        hashes, at = grams(words, k)
        doc = words.doc[at]
        if wanted is not None:
            place = hashes >> np.uint64(64 - MAP_BITS)
            held = (wanted[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            hashes, doc = hashes[held], doc[held]
        ends = np.searchsorted(doc, np.arange(len(words.first)))
        for i in range(len(words.first) - 1):
            yield np.unique(hashes[ends[i] : ends[i + 1]], return_counts=True)


def tile(test: np.ndarray, text: np.ndarray, least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """Tiles ``(place in test, place in text, words)`` of two sequences of word hashes.

    Running Karp-Rabin: matches of unmarked runs of the search length are found
    by hash and extended as far as they go; the longest are marked first and
    none overlaps another. What a longer tile leaves of a match takes its turn by
    its own length. A match longer than twice the search length restarts the
    search there; otherwise it goes on with half the length, down to ``least``,
    after which no unmarked match of that length is left.
    """
    marked = np.zeros(len(test), bool), np.zeros(len(text), bool)
    out: list[tuple[int, int, int]] = []
    length = min(_FIRST_LENGTH, len(test), len(text))
    while length >= least:
        found, longest = _matches(test, text, marked, length)
        if longest > 2 * length:
            length = longest
            continue
        heap = [(-size, i, j) for size, i, j in found]
        heapq.heapify(heap)
        while heap:
            size, i, j = heapq.heappop(heap)
            size = -size
            taken = marked[0][i : i + size] | marked[1][j : j + size]
            if taken.any():
                edges = np.flatnonzero(np.diff(np.r_[True, taken, True]))
                for at, to in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    if to - at >= length:
                        heapq.heappush(heap, (at - to, i + at, j + at))
                continue
            marked[0][i : i + size] = True
            marked[1][j : j + size] = True
            out.append((i, j, size))
        if length == least:
            break
        length = max(least, length // 2)
    return sorted(out)


def _matches(test, text, marked, length) -> tuple[list[tuple[int, int, int]], int]:
    def free(marks: np.ndarray) -> np.ndarray:
        ends = np.r_[0, np.cumsum(marks)]
        return ends[length:] == ends[:-length]

    mine, theirs = window_hashes(test, length), window_hashes(text, length)
    if not len(mine) or not len(theirs):
        return [], 0
    open_mine, open_theirs = free(marked[0]), free(marked[1])
    places: dict[int, list[int]] = {}
    for i in np.flatnonzero(open_mine).tolist():
        places.setdefault(int(mine[i]), []).append(i)
    hits = np.flatnonzero(open_theirs & np.isin(theirs, mine[open_mine]))
    found, longest = [], 0
    before = (-1, -1, 0)
    for j in hits.tolist():
        for i in places[int(theirs[j])]:
            # Inside the match found last there is nothing longer.
            if i - j == before[1] - before[2] and j < before[0]:
                continue
            most = min(len(test) - i, len(text) - j)
            same = (test[i : i + most] == text[j : j + most]) & ~marked[0][i : i + most] & ~marked[1][j : j + most]
            size = most if same.all() else int(np.argmin(same))
            if size >= length:
                found.append((size, i, j))
                longest = max(longest, size)
                before = (j + size, i, j)
    return found, longest


def _seed_rows(wanted=None):
    """Rows ``(key, seed, n, runs)``, the last all runs of the text; ``wanted`` is a broadcast map of bits or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else np.frombuffer(wanted.value, np.uint8)
        for batch in text_slices(batches):
            own = list(seeds(batch.column("text"), wanted=bits))
            rows = np.repeat(np.arange(len(own)), [len(x) for x, _ in own])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(rows)),
                    pa.array(np.concatenate([x for x, _ in own]).view(np.int64) if own else np.zeros(0, np.int64)),
                    pa.array(np.concatenate([n for _, n in own]) if own else np.zeros(0, np.int64)),
                    pa.array(np.repeat([n.sum() for _, n in own], [len(n) for _, n in own]).astype(np.int64)),
                ],
                names=["key", "seed", "n", "runs"],
            )

    return run


def _bit_map(found: DataFrame) -> bytes:
    """A bit for the leading ``MAP_BITS`` bits of each seed of ``found``, gathered in chunks of set size."""
    place = F.shiftrightunsigned("seed", 64 - MAP_BITS)
    chunks = (
        found.select(F.floor(place / _CHUNK).alias("chunk"), (place % _CHUNK).alias("bit"))
        .groupBy("chunk")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    out = bytearray((1 << MAP_BITS) // 8)
    size = _CHUNK // 8
    for r in chunks:
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = r["bits"]
    return bytes(out)


def find_leaks(
    docs: DataFrame,
    tests: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    test_key: str = "item_id",
    test_text: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """``(key, test_key, coverage, tiles array<struct<test_at, text_at, words>>)`` of texts that hold a test.

    A row for each row of ``docs`` and test of which tiles of ``LEAST_TILE``
    words or more cover ``coverage`` of the test's words, in whatever order the
    pieces stand. Pairs are found by an equi-join of all runs of ``LEAST_TILE``
    words (small test sets are broadcast by their measured size, larger ones
    shuffled with those runs of the texts whose bit the tests set), so no pair
    with a tile is missed. A tile of w words holds w - LEAST_TILE + 1 runs, so
    pairs whose common runs cannot cover enough are left out. Words are compared in lower case and without marks. Null texts and tests, and tests of
    fewer than ``LEAST_TILE`` words, match nothing; repeated rows each give
    theirs; other columns are not looked at.
    """
    rows = docs.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text"))
    items = tests.select(F.col(test_key).alias("key"), F.lower(F.col(test_text)).alias("text"))
    kinds = [x.schema["key"].dataType.simpleString() for x in (rows, items)]
    kept = "seed long, n long, runs long"
    theirs = written(items.mapInArrow(_seed_rows(), f"key {kinds[1]}, {kept}"))
    wanted = docs.sparkSession.sparkContext.broadcast(_bit_map(theirs))
    mine = rows.mapInArrow(_seed_rows(wanted), f"key {kinds[0]}, {kept}").select("key", "seed")
    pairs = (
        mine.join(theirs.withColumnRenamed("key", "test"), "seed")
        .groupBy("key", "test")
        .agg(F.sum("n").alias("n"), F.min("runs").alias("runs"))
        .where(f"{LEAST_TILE} * n + 1e-6D >= {float(coverage)!r}D * (runs + {LEAST_TILE - 1})")
        .select("key", "test")
    )
    named = items.select(F.col("key").alias("test"), F.col("text").alias("test_text"))
    both = (
        pairs.withColumnRenamed("key", "want")
        .join(rows, F.expr("want <=> key"))
        .drop("want")
        .join(named.withColumnRenamed("test", "own"), F.expr("own <=> test"))
        .drop("own")
    )
    item = pa.struct([("test_at", pa.int32()), ("text_at", pa.int32()), ("words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            at, shares, tiles = [], [], []
            sides = zip(word_hashes(batch.column("test_text")), word_hashes(batch.column("text")), strict=True)
            for i, (test, own) in enumerate(sides):
                if len(test) < LEAST_TILE:
                    continue
                found = tile(test, own)
                share = sum(t[2] for t in found) / len(test)
                if share >= coverage:
                    at.append(i)
                    shares.append(share)
                    tiles.append([dict(zip(("test_at", "text_at", "words"), t, strict=True)) for t in found])
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(index),
                    batch.column("test").take(index),
                    pa.array(shares, pa.float64()),
                    pa.array(tiles, pa.list_(item)),
                ],
                names=["key", "test", "coverage", "tiles"],
            )

    found = both.select("key", "text", "test", "test_text").mapInArrow(
        run,
        f"key {kinds[0]}, test {kinds[1]}, coverage double,"
        " tiles array<struct<test_at:int,text_at:int,words:int>>",
    )
    return found.withColumnsRenamed({"key": key, "test": test_key})
