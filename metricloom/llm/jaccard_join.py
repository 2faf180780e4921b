"""Exact n-gram Jaccard join of documents by PartEnum signatures.

Two sets of sizes a and b with Jaccard similarity t or more differ in at most
(a + b)(1 - t)/(1 + t) elements. Sizes are cut into bands; for the largest
difference k of a band the feature domain is cut into ``n1`` partitions of three
blocks each, n1 = floor(k / 2) + g. At least g partitions then hold at most one
difference, so two of their three blocks are equal: the signatures are all pairs
of blocks of each partition. A set takes part in its own band and in those of
larger sets it may still be similar to.

Pairs of blocks with few elements are what unrelated sets share. A set leaves
out its pairs of up to t elements, t being the largest size for which fewer than
g of its partitions have such a pair. That loses no similar set: of two such
sets take the one with the larger t. Equal pairs have equal sizes, so those left
out by either lie in fewer than g partitions, and an equal pair remains that
both keep.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.batches import text_slices
from metricloom.llm.components import components
from metricloom.llm.words import blocks, grams, mix
from metricloom.sources.scratch import dropped, written

#: Sizes in one band differ by this factor at most.
BAND = 1.4
#: Partitions beyond those that differences can spoil: one, and one more for so many differences.
SPARE = 6
#: 64-bit words of the parity sketch by which far pairs are told apart without their texts.
SKETCH = 8
#: Cells of the largest sketch that a set of more elements than 64 * SKETCH has besides.
WIDE = 1 << 15
#: Bytes of a signature on its way to equal ones: six of its own and six of its class.
PACKED = 12
#: Signatures that a task packs at once, and the most that meet in a bucket on average.
MEET = 1 << 18
#: Bytes of texts or sketches that a task is handed at once.
BATCH = 4 << 20
#: Bytes of signatures that are on their way at once for each element; its word takes about seven in the text.
ON_WAY = 9
#: Digests of sets a task remembers so that copies are signed once.
REMEMBER = 1 << 18

_PARTS = [f"p{i}" for i in range(SKETCH)]
_PAIRS = ((0, 1), (0, 2), (1, 2))
_SALT = np.uint64(0xD1B54A32D192ED03)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles, A-Z as a-z.

    A text of fewer words is one shingle; null and texts without words give none.
    """
    for words in blocks(texts, lower=True):
        hashes, at = grams(words, k)
        first = np.searchsorted(at, words.first)
        for i, n in enumerate(words.count()):
            if n >= k:
                yield np.unique(hashes[first[i] : first[i + 1]])
            elif n:
                own = words.hash[words.first[i] : words.first[i + 1]]
                with np.errstate(over="ignore"):
                    yield mix(np.array([sum(int(h) * (2 * j + 3) for j, h in enumerate(own, n)) % 2**64], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def bands(threshold: int, size: int) -> list[tuple[int, int]]:
    """``(band, largest size of the band)`` in which a set of ``size`` takes part."""
    out, band, upper, most = [], 0, 1, size * 100 // threshold
    while True:
        if upper >= size:
            out.append((band, upper))
        if upper >= most:
            return out
        band, upper = band + 1, max(upper + 1, int(upper * BAND))


def _partitions(threshold: int, upper: int) -> tuple[int, int]:
    """Partitions of a band, none where sets cannot differ, and how many of them no differences spoil."""
    k = 2 * upper * (100 - threshold) // (100 + threshold)
    spare = 1 + -(-k // SPARE)
    return (k // 2 + spare if k else 0), spare


def most_signatures(threshold: int, size: int) -> int:
    """As many signatures as a set of ``size`` has at most."""
    return sum(max(1, len(_PAIRS) * _partitions(threshold, upper)[0]) for _, upper in bands(threshold, size))


def signatures(elements: np.ndarray, threshold: int) -> np.ndarray:
    """PartEnum signatures of one set of 64-bit hashes; ``threshold`` in hundredths."""
    out = []
    for band, upper in bands(threshold, len(elements)):
        n1, spare = _partitions(threshold, upper)
        with np.errstate(over="ignore"):
            if n1 == 0:
                out.append(mix(np.array([elements.sum() + np.uint64(band)], np.uint64)))
                continue
            scrambled = mix(elements ^ _SALT)
            block = (scrambled % np.uint64(3 * n1)).astype(np.int64)
            low = np.bincount(block, (elements & np.uint64(0xFFFFFFFF)).astype(float), 3 * n1)
            high = np.bincount(block, (elements >> np.uint64(32)).astype(float), 3 * n1)
            sums = low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))
            sums = mix(sums).reshape(n1, 3)
            held = np.bincount(block, minlength=3 * n1).reshape(n1, 3)
            held = np.stack([held[:, x] + held[:, y] for x, y in _PAIRS])
            few = np.partition(held.min(axis=0), spare - 1)[spare - 1] - 1
            place = mix(np.arange(n1, dtype=np.uint64) + np.uint64(band << 32))
            for j, (x, y) in enumerate(_PAIRS):
                all_ = mix(sums[:, x] + np.uint64(3) * sums[:, y] + place + np.uint64(j))
                out.append(all_[held[j] > few])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _sets(k: int):
    """Rows as ``(key, n, set)``: size and digest of the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sets = [], []
            for elements in shingle_sets(batch.column("text"), k):
                n.append(len(elements))
                sets.append(_digest(elements) if len(elements) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n, pa.int64()), pa.array(sets, pa.binary())], names=["key", "n", "set"]
            )

    return run


def _class(digest: bytes) -> int:
    """The 48-bit form of a digest. Only candidates are found by it, so a chance equality costs a test."""
    return int.from_bytes(digest[:6], "big")


def _packed(signs: np.ndarray, classes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """``(bucket, packed)``: the low 48 bits of signatures and their classes, by the signatures' high bits."""
    bucket = ((signs >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    bucket, signs, classes = bucket[order], signs[order], classes[order]
    words = np.empty((len(signs), PACKED // 4), np.uint32)
    words[:, 0] = signs & np.uint64(0xFFFFFFFF)
    words[:, 1] = classes & np.uint64(0xFFFFFFFF)
    words[:, 2] = ((signs >> np.uint64(32)) & np.uint64(0xFFFF)) | ((classes >> np.uint64(32)) << np.uint64(16))
    own, first = np.unique(bucket, return_index=True)
    ends = np.append(first, len(signs)).astype(np.int32) * np.int32(PACKED)
    blobs = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(words)])
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), blobs], names=["bucket", "packed"])


def _signs(k: int, threshold: int, buckets: int, turn: int, turns: int):
    """Texts as ``_packed`` signatures, in each of ``turns`` others; copies that a task meets again are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        signs, classes, held = [], [], 0
        for batch in text_slices(batches):
            for elements in shingle_sets(batch.column("text"), k):
                digest = _digest(elements)
                if not len(elements) or digest in seen:
                    continue
                if len(seen) >= REMEMBER:
                    seen.clear()
                seen.add(digest)
                own = signatures(elements, threshold).view(np.uint64)
                own = own[own % np.uint64(turns) == turn] if turns > 1 else own
                signs.append(own)
                classes.append(np.full(len(own), _class(digest), np.uint64))
                held += len(own)
                if held >= MEET:
                    yield _packed(np.concatenate(signs), np.concatenate(classes), buckets)
                    signs, classes, held = [], [], 0
        if held:
            yield _packed(np.concatenate(signs), np.concatenate(classes), buckets)

    return run


def _meetings(table: pa.Table) -> pa.Table:
    """Distinct ``(sign, c)`` of one bucket where a signature has more than one class."""
    words = np.frombuffer(b"".join(table.column("packed").to_pylist()), np.uint32).reshape(-1, PACKED // 4)
    words = words.astype(np.uint64)
    signs = words[:, 0] | ((words[:, 2] & np.uint64(0xFFFF)) << np.uint64(32))
    classes = words[:, 1] | ((words[:, 2] >> np.uint64(16)) << np.uint64(32))
    del words

    def repeated() -> np.ndarray:
        same = signs[1:] == signs[:-1]
        return np.append(same, False) | np.append(False, same)

    order = np.argsort(signs)
    signs, classes = signs[order], classes[order]
    more = repeated()
    signs, classes = signs[more], classes[more]
    order = np.lexsort((classes, signs))
    signs, classes = signs[order], classes[order]
    new = np.append(True, (signs[1:] != signs[:-1]) | (classes[1:] != classes[:-1]))[: len(signs)]
    signs, classes = signs[new], classes[new]
    more = repeated()[: len(signs)]
    high = np.uint64(table.column("bucket")[0].as_py() & 0xFFFF) << np.uint64(48)
    return pa.table({"sign": (signs[more] | high).view(np.int64), "c": classes[more].view(np.int64)})


def _overlap(k: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            both = zip(
                shingle_sets(batch.column("text_a"), k), shingle_sets(batch.column("text_b"), k), strict=True
            )
            for a, b in both:
                shared = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - shared
                if 100 * shared >= threshold * union and union:
                    out.append((_digest(a), _digest(b)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in out], pa.binary()) for j in (0, 1)], names=["a", "b"]
            )

    return run


def sketch(elements: np.ndarray, cells: int = 64 * SKETCH) -> np.ndarray:
    """Parities of the element counts of so many cells, a power of two.

    Each element in which two sets differ turns one parity over, so sets never
    differ in fewer elements than their sketches in bits. Unrelated sets differ in
    about half the cells at most, so that says little of sets that may differ in
    more elements than that. The halves of a sketch make that of half as many cells.
    """
    at = (mix(elements + _SALT) % np.uint64(cells)).astype(np.int64)
    odd = (np.bincount(at, minlength=cells) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def wide_sketch(elements: np.ndarray) -> bytes:
    """A sketch of as many cells as elements or more, up to ``WIDE``; none if ``SKETCH`` words are enough for that."""
    cells = min(WIDE, 1 << max(0, len(elements) - 1).bit_length())
    return sketch(elements, cells).tobytes() if cells > 64 * SKETCH else b""


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ, as far as the smaller one tells; 0 if there is none."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(x) and len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) if len(x) else 0


def _close(threshold: int):
    """Pairs whose wide sketches let them be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*(batch.column(x).to_pylist() for x in ("n_a", "n_b", "wide_a", "wide_b")), strict=True)
            near = [differing(a, b) * (100 + threshold) <= (m + n) * (100 - threshold) for m, n, a, b in sides]
            yield batch.select(["c_a", "n_a", "c_b", "n_b"]).filter(pa.array(near, pa.bool_()))

    return run


def _texts(k: int):
    """Texts as ``(set, c, n, text, wide, p0, ...)``; empty sets and copies that a task meets again are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in text_slices(batches):
            at, sets, n, wide, parts = [], [], [], [], []
            for i, elements in enumerate(shingle_sets(batch.column("text"), k)):
                digest = _digest(elements)
                if not len(elements) or digest in seen:
                    continue
                if len(seen) >= REMEMBER:
                    seen.clear()
                seen.add(digest)
                at.append(i)
                sets.append(digest)
                n.append(len(elements))
                wide.append(wide_sketch(elements))
                parts.append(sketch(elements))
            parts = np.array(parts, np.int64).reshape(len(sets), SKETCH)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sets, pa.binary()),
                    pa.array([_class(x) for x in sets], pa.int64()),
                    pa.array(n, pa.int64()),
                    batch.column("text").take(pa.array(at, pa.int64())),
                    pa.array(wide, pa.binary()),
                    *(pa.array(parts[:, i]) for i in range(SKETCH)),
                ],
                names=["set", "c", "n", "text", "wide", *_PARTS],
            )

    return run


def _short(column: str):
    """``_class`` of a column."""
    return F.conv(F.hex(F.substring(column, 1, 6)), 16, 10).cast("long")


def _met(texts: DataFrame, k: int, threshold: int, sizes: list[tuple[int, int]]) -> list[DataFrame]:
    """Tables of distinct ``(sign, c)`` where texts of different classes have a signature in common.

    ``sizes`` are numbers of sets of about the same size, and of their elements.
    Signatures are many times the words of a text. They go to equal ones packed,
    and in turns by their value, so that no more than ``ON_WAY`` bytes for each
    element are on their way at once; a turn computes the sets again.
    """
    spark = texts.sparkSession
    elements = sum(n for _, n in sizes)
    most = sum(sets * most_signatures(threshold, -(-n // sets)) for sets, n in sizes)
    turns = max(1, math.ceil(PACKED * most / max(1, ON_WAY * elements)))
    turns = min(turns, max(1, math.ceil(most / MEET)))
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(most / turns / MEET))
    return [
        written(
            texts.mapInArrow(_signs(k, threshold, buckets, turn, turns), "bucket long, packed binary")
            .groupBy("bucket")
            .applyInArrow(_meetings, "sign long, c long"),
            BATCH,
        )
        for turn in range(turns)
    ]


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, threshold: int = 90
) -> DataFrame:
    """``(key, n_shingles, component_id)`` for every row of ``docs``.

    Rows whose sets of word shingles have a Jaccard similarity of ``threshold``
    hundredths or more are linked; ``component_id`` is the least key reachable,
    a row's own key where it has no words (or where all keys reached are null).
    Rows with equal sets form one class, and copies are never paired. In each
    signature's group all classes are tested against the one that shares most
    signatures with others; members that still lie in different components after
    that are tested in pairs, as far as their sketches let them be similar. So
    every link between components is found, but a similar group never makes all
    pairs. Repeated rows each give a row; other columns are not looked at.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()
    base = written(rows.mapInArrow(_sets(shingle), f"key {key_type}, n long, set binary"), BATCH)
    sizes = base.where("n > 0").groupBy(F.floor(F.log2("n"))).agg(F.count("*").alias("sets"), F.sum("n").alias("n"))
    sizes = [(r["sets"], r["n"]) for r in sizes.collect()]
    elements = sum(n for _, n in sizes)
    met = _met(rows.select("text"), shingle, threshold, sizes)
    members = reduce(DataFrame.unionByName, met)
    shared = members.groupBy("c").agg(F.count("*").alias("shared"))
    classes = written(
        base.where("set IS NOT NULL")
        .groupBy("set")
        .agg(F.min("key").alias("least"))
        .withColumn("c", _short("set"))
        .join(shared, "c")
    )
    wanted = rows.join(
        classes.select(F.col("least").alias("want")).distinct(), F.expr("key <=> want"), "left_semi"
    )
    parts = ", ".join(f"{p} long" for p in _PARTS)
    texts = written(
        wanted.select("text").mapInArrow(
            _texts(shingle), f"set binary, c long, n long, text string, wide binary, {parts}"
        ),
        BATCH,
    )
    # Rows of one key are in one task but for small or uneven tables, so texts need not be dealt again as a rule.
    rows_, sets = texts.agg(F.count("*"), F.count_distinct("set")).first()
    if rows_ > sets:
        repeated, texts = texts, written(texts.dropDuplicates(["set"]))
        dropped(repeated)
    sketches = texts.select("c", "n", *_PARTS)
    apart = " + ".join(f"bit_count({p}_a ^ {p}_b)" for p in _PARTS)
    near = (
        f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)"
        f" AND ({apart}) * {100 + threshold} <= (n_a + n_b) * {100 - threshold}"
    )
    pair = ["c_a", "n_a", "c_b", "n_b"]

    def side(table: DataFrame, which: str) -> DataFrame:
        return table.select(*(F.col(x).alias(f"{x}_{which}") for x in table.columns))

    def with_both(pairs: DataFrame, column: str) -> DataFrame:
        own = texts.select("c", column)
        return pairs.join(side(own, "a"), "c_a").join(side(own, "b"), "c_b")

    def dealt(pairs: DataFrame, weight: float) -> list[DataFrame]:
        """Pairs in parts that bring half of all texts at most, if each element of their ``c_a`` brings ``weight`` words."""
        parts = math.ceil(2 * weight * (pairs.agg(F.sum("n_a")).first()[0] or 0) / max(1, elements))
        if parts <= 1:
            return [pairs]
        return [pairs.where(F.pmod(F.xxhash64("c_a", "c_b"), F.lit(parts)) == i) for i in range(parts)]

    def tested(pairs: DataFrame) -> list[DataFrame]:
        pairs = written(pairs.select(pair).distinct())
        long = F.least("n_a", "n_b") > 64 * SKETCH
        close = [
            written(
                with_both(part, "wide")
                .select(*pair, "wide_a", "wide_b")
                .mapInArrow(_close(threshold), ", ".join(f"{x} long" for x in pair)),
                BATCH,
            )
            for part in dealt(pairs.where(long), 1 / 16)
        ]
        links = [
            written(
                with_both(part, "text")
                .select("text_a", "text_b")
                .mapInArrow(_overlap(shingle, threshold), "a binary, b binary"),
                BATCH,
            )
            for part in dealt(reduce(DataFrame.unionByName, close, pairs.where(~long)), 1)
        ]
        dropped(pairs, *close)
        return links

    hubs = (
        members.join(shared, "c")
        .groupBy("sign")
        .agg(F.max(F.struct("shared", "c")).alias("top"))
        .select("sign", F.col("top.c").alias("hub"))
    )
    members = written(members.join(hubs, "sign"))
    dropped(*met)
    stars = (
        members.where("c <> hub")
        .select(F.col("hub").alias("c_a"), F.col("c").alias("c_b"))
        .distinct()
        .join(side(sketches, "a"), "c_a")
        .join(side(sketches, "b"), ["c_b"])
        .where(near)
    )
    found = tested(stars)
    links = reduce(DataFrame.unionByName, found)
    labels = written(components(links))
    placed = members.join(
        classes.join(labels, classes["set"] == labels["node"], "left").select(
            "c", F.coalesce("component", "set").alias("component")
        ),
        "c",
    )
    open_signs = (
        placed.groupBy("sign")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"))
        .where("x < y")
        .select("sign")
    )
    rest = written(
        placed.where("c <> hub")
        .join(open_signs, "sign", "left_semi")
        .select("sign", "c", "component")
        .join(sketches, "c")
    )
    dropped(members, classes)
    pairs = side(rest, "a").join(
        side(rest, "b"), F.expr(f"sign_a = sign_b AND c_a < c_b AND component_a <> component_b AND {near}")
    )
    more = tested(pairs)
    dropped(rest, texts)
    links = reduce(DataFrame.unionByName, more, links)
    if any(x.take(1) for x in more):
        dropped(labels)
        labels = written(components(links))
    dropped(*found, *more)
    # The least key of each class, then of each component, then back to the rows by class:
    # a component's rows are never brought together.
    firsts = base.where("set IS NOT NULL").groupBy("set").agg(F.min("key").alias("first"))
    known = labels.withColumnRenamed("node", "set").join(firsts, "set")
    least = known.groupBy("component").agg(F.min("first").alias("least"))
    known = known.join(least, "component").select("set", "least")
    named = firsts.join(known, "set", "left").select("set", F.coalesce("least", "first").alias("least"))
    return (
        base.select("key", "n", "set")
        .join(named, "set", "left")
        .select(
            F.col("key").alias(key),
            F.col("n").alias("n_shingles"),
            F.coalesce("least", "key").alias("component_id"),
        )
    )
