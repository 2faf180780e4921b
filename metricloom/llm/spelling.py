"""Spelling variants of frequent words, found by blocked Gram matrices of letter counts.

Two words one edit apart differ by at most two in squared distance of their
letter counts, and by at most one in length. Words are cut into blocks by length
and by how many of their letters fall into a few fixed letter groups, which one
edit changes by one at most. Squared distances of two neighbouring blocks come
from one NumPy matrix product; pairs at most two apart are then verified as
edits. Every pair of words one edit apart meets in exactly one block pair.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.sources.scratch import written

#: Shortest word, least number of occurrences, and how many times its variant's count a form has.
LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_RATIO = 10
#: Words of a block, about; a fuller cell of the grid is dealt over several blocks by hash.
BLOCK = 2048
#: One run in about this many loses a letter before it is counted.
DELETE_ONE_IN = 31

#: Letters that runs are made of.
LETTERS = r"A-Za-zÀ-ÿ"
#: Letter groups by which cells are cut, chosen to hold about a quarter of running text each.
GROUPS = {"a": "eaivwxyz", "b": "otnjkpq", "c": "rslh"}

_FIRST = 0xC0
_COLUMNS = 26 + 64


def planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)``: occurrences of each run of letters, one in ``DELETE_ONE_IN`` of them shortened.

    A run is lower-cased in A-Z only. Where crc32 of ``<key>:<run>`` is a multiple
    of ``DELETE_ONE_IN``, its code point at that checksum modulo its length is
    deleted. Runs too short to give a word of ``LEAST_LENGTH`` are not counted.
    Null texts have no runs; a null key is written as nothing.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{LEAST_LENGTH},}})"), F.lit(1))
    lowered = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    own = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(runs).alias("run"))
    own = own.select("k", lowered.alias("run")).withColumn("h", F.crc32(F.concat_ws(":", "k", "run")))
    at = F.col("h") % F.length("run")
    cut = F.expr("concat(substring(run, 1, at), substring(run, at + 2))")
    word = F.when(F.col("h") % DELETE_ONE_IN == 0, cut).otherwise(F.col("run"))
    words = own.withColumn("at", at.cast("int")).select(word.alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """One row of letter counts per row of code points (0 pads)."""
    rows, at = np.nonzero(codes)
    found = codes[rows, at].astype(np.int64)
    column = np.where(found >= _FIRST, found - _FIRST + 26, found - 97)
    counts = np.bincount(rows * _COLUMNS + column, minlength=len(codes) * _COLUMNS)
    return counts.reshape(len(codes), _COLUMNS).astype(np.float32)


def _codes(words: list[str]) -> np.ndarray:
    width = max(map(len, words))
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)


def _differing(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many places word ``i`` of ``a`` and word ``j`` of ``b`` differ, counted up to two.

    A row of ``a`` and ``b`` is a place; ``LETTERS`` are code points of one byte.
    """
    out = np.zeros(len(i), np.uint8)
    for left, right in zip(a.astype(np.uint8), b.astype(np.uint8), strict=True):
        np.minimum(out + (left[i] != right[j]), 2, out=out, casting="unsafe")
    return out


def near_pairs(left: list[str], right: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs one edit apart; words of ``right`` have the length of ``left``'s or one more.

    With ``same`` both are one block, and each pair is given once.
    """
    a, b = _codes(left), _codes(right)
    ca, cb = letter_counts(a), letter_counts(b)
    used = ca.any(axis=0) | cb.any(axis=0)
    ca, cb = ca[:, used], cb[:, used]
    # The squared norms ride along as two more columns, so one product gives the distances.
    x = np.column_stack([-2 * ca, (ca * ca).sum(1), np.ones(len(ca), np.float32)])
    y = np.column_stack([cb, np.ones(len(cb), np.float32), (cb * cb).sum(1)])
    i, j = np.divmod(np.flatnonzero(x @ y.T <= 2).astype(np.int32), np.int32(len(cb)))
    if same:
        i, j = i[i < j], j[i < j]
    if a.shape[1] == b.shape[1]:
        ok = _differing(a.T, b.T, i, j) == 1
    else:
        # One letter more: what agrees from the front and from the back covers the shorter word.
        front = np.logical_and.accumulate(a[i] == b[j, :-1], axis=1).sum(1)
        back = np.logical_and.accumulate((a[i] == b[j, 1:])[:, ::-1], axis=1).sum(1)
        ok = front + back >= a.shape[1]
    return i[ok], j[ok]


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["word", "n", "other", "other_n"]
    for batch in batches:
        columns = [batch.column(c) for c in ("words_a", "counts_a", "words_b", "counts_b", "same")]
        for row in range(batch.num_rows):
            wa, na, wb, nb, same = (c[row].as_py() for c in columns)
            i, j = near_pairs(wa, wb, same)
            wa, wb = np.array(wa, object)[i], np.array(wb, object)[j]
            na, nb = np.array(na, np.int64)[i], np.array(nb, np.int64)[j]
            for cells in ((wa, na, wb, nb), (wb, nb, wa, na)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string() if c.dtype == object else pa.int64()) for c in cells], names=names
                )


_CELL = ["size", *GROUPS]


def _moves() -> list[tuple[int, ...]]:
    """A cell, and the steps to those of its neighbours in which an edit may put a word of it.

    A replaced letter goes from one group (or none) to another: of both ways one
    step, so each two cells meet once. An inserted one makes the word longer and
    falls into one group or none.
    """
    steps = [tuple(int(i == at) for i in range(len(GROUPS))) for at in range(len(GROUPS))]
    none = (0,) * len(GROUPS)
    swaps = [tuple(x - y for x, y in zip(p, q, strict=True)) for at, p in enumerate(steps) for q in (*steps[at + 1 :], none)]
    return [(0, *none), *((0, *swap) for swap in swaps), *((1, *step) for step in (none, *steps))]


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)``: both directions of every pair of ``words(word, n)`` one edit apart.

    ``word`` is distinct and made of the letters that ``planted_runs`` counts. A
    cell of the grid is dealt over ``ceil(rows / BLOCK)`` blocks by hash, so no
    block grows with the vocabulary; blocks meet blocks of neighbouring cells only.
    """

    def held(group: str):
        return F.length("word") - F.length(F.translate("word", group, ""))

    cell = _CELL
    placed = words.select(
        "word", "n", F.length("word").alias("size"), *(held(letters).alias(c) for c, letters in GROUPS.items())
    )
    cells = written(
        placed.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    )
    blocks = written(
        placed.join(cells, cell)
        .withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
        .groupBy(*cell, "part")
        .agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("counts"))
    )
    moves = F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(cell, m, strict=True))) for m in _moves()))
    beside = (
        blocks.select(*cell, "part", F.explode(moves).alias("move"))
        .select(
            *(F.col(c).alias(f"{c}_a") for c in (*cell, "part")),
            *((F.col(c) + F.col(f"move.{c}")).alias(c) for c in cell),
            F.expr(" AND ".join(f"move.{c} = 0" for c in cell)).alias("own"),
        )
        .join(cells, cell)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .where("NOT own OR part >= part_a")
    )
    left = blocks.select(
        *(F.col(c).alias(f"{c}_a") for c in (*cell, "part")),
        F.col("words").alias("words_a"),
        F.col("counts").alias("counts_a"),
    )
    right = blocks.select(*cell, "part", F.col("words").alias("words_b"), F.col("counts").alias("counts_b"))
    return (
        beside.join(left, [f"{c}_a" for c in (*cell, "part")])
        .join(right, [*cell, "part"])
        .select("words_a", "counts_a", "words_b", "counts_b", F.expr("own AND part = part_a").alias("same"))
        # Blocks are few and heavy: the pairs are dealt evenly over all tasks.
        .repartition(F.xxhash64(F.get("words_a", F.lit(0)), F.get("words_b", F.lit(0))))
        .mapInArrow(_match, "word string, n long, other string, other_n long")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every ``(word, form)``: where following forms from word to word ends.

    Each round every word takes the root of its root, so a chain of k forms
    takes log2(k) rounds. A form must lead away from its word for good (here its
    count is ``FORM_RATIO`` times as large), so there are no circles.
    """
    found = forms.select("word", F.col("form").alias("root"))
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(
            found.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            )
        )
        found = step.select("word", "root")
        if not step.where("moved").take(1):
            return found


def group_spellings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of the texts of ``docs``.

    Words are ``planted_runs`` of ``LEAST_LENGTH`` code points or more that occur
    ``LEAST_COUNT`` times or more. ``form`` is the word one edit away that occurs
    most often (of several the first in code-point order) if it occurs at least
    ``FORM_RATIO`` times as often as the word, else null, as ``form_n`` is.
    ``root`` follows forms to the end. Repeated rows count each; an empty table
    gives no rows; other columns are not looked at.
    """
    words = written(planted_runs(docs, key, text).where(F.col("n") >= LEAST_COUNT))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = written(
        near_words(words)
        .groupBy("word")
        .agg(F.first("n").alias("own"), F.count("*").alias("n_near"), best.alias("best"))
        .select("word", "own", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))
    )
    formed = F.col("form_n") >= FORM_RATIO * F.col("own")
    forms = near.where(formed).select("word", "form", "form_n")
    return (
        words.join(near.select("word", "n_near"), "word", "left")
        .join(forms, "word", "left")
        .join(roots(forms), "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            "form_n",
        )
    )
