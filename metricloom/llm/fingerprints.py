"""Document fingerprints: one-permutation MinHash with optimal densification, in built-in functions only.

Each word shingle is hashed once. The hash's high bits choose one of ``BINS``
bins and each bin keeps its least hash. An empty bin takes over the value of a
filled one, the first in an order of its own that all texts share, so two texts'
bins still agree with the probability of their Jaccard similarity. ``BITS`` low
bits of each value are kept; chance agreement of these is taken out again when
two fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 128
BITS = 8
SHINGLE = 5
#: Tries of an empty bin before all bins are looked at.
TRIES = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _bin(hash_: Column) -> Column:
    return F.shiftrightunsigned(hash_, 64 - (BINS - 1).bit_length())


def _try(b: Column, t: int) -> Column:
    """The bin that empty bin ``b`` looks into at its ``t``-th try: the same for all texts."""
    return F.xxhash64(b, F.lit(t)).bitwiseAND(BINS - 1).cast("int")


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """Sorted hashes of the ``k``-word shingles of lower-cased text; all words as one if fewer."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def shingles(hashes: Column) -> Column:
        n = F.size(hashes)
        runs = F.transform(
            F.sequence(F.lit(1), n - (k - 1)),
            lambda i: F.xxhash64(*(F.element_at(hashes, (i + j).cast("int")) for j in range(k))),
        )
        return (
            F.when(n >= k, F.sort_array(runs))
            .when(n > 0, F.array(F.xxhash64(F.array_join(hashes.cast("array<string>"), " "))))
            .otherwise(F.array().cast("array<long>"))
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def bins(text: Column, k: int = SHINGLE) -> Column:
    """The kept bits of each bin's value as array<smallint>; an empty array for a text without words."""

    def values(hashes: Column) -> Column:
        # Sorted by hash, a bin's hashes lie together and the least comes first.
        least = F.filter(hashes, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(hashes, i - 1))))
        return let(least, dense)

    def dense(least: Column) -> Column:
        by_bin = F.map_from_arrays(F.transform(least, _bin), least)
        every = F.sequence(F.lit(0), F.lit(BINS - 1))
        return let(by_bin, lambda m: let(F.transform(every, lambda b: F.element_at(m, b.cast("long"))), filled))

    def filled(slots: Column) -> Column:
        return F.transform(
            slots,
            lambda v, b: F.coalesce(v, *(F.get(slots, _try(b, t)) for t in range(TRIES)), last_resort(b, slots))
            .bitwiseAND((1 << BITS) - 1)
            .cast("smallint"),
        )

    def last_resort(b: Column, slots: Column) -> Column:
        # When all tries have failed: the filled bin of least hash. The bin rides in the low bits.
        places = F.transform(
            slots,
            lambda v, f: F.when(v.isNotNull(), F.xxhash64(b, f).bitwiseAND(~(BINS - 1)).bitwiseOR(f.cast("long"))),
        )
        return F.get(slots, F.array_min(places).bitwiseAND(BINS - 1).cast("int"))

    return let(
        shingle_hashes(text, k),
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<smallint>")).otherwise(values(h)),
    )


def packed(values: Column) -> Column:
    """The bins as text, ``BITS`` bits each in hexadecimal."""
    digits = -(-BITS // 4)
    return F.array_join(F.transform(values, lambda v: F.lower(F.lpad(F.hex(v.cast("long")), digits, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts' bins, 0 to 1.

    Of the bins that differ, 2^-BITS agree by chance, so that share is taken off.
    Two texts without words are alike, one without words is like no other.
    """
    chance = 2.0**-BITS
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda s: s)) / F.lit(float(BINS))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))
    )


def fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as packed hexadecimal text; null reads as empty."""
    return docs.withColumn(into, packed(bins(F.coalesce(F.col(text), F.lit("")))))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint beside that of its text with the last half replaced by the next row's start.

    ``(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)``; next is by ascending key, then text (null keys first), and the
    first row follows the last. Null texts read as empty.

    The order is total, but no row is ranked over all of them: keys are cut at
    quantiles into as many ranges as four times the shuffle partitions, each
    range orders its own rows, and the last row of a range takes the first of
    the next range with rows. So texts are shuffled once, and the only table
    without a partition key has one row per range. A key that repeats keeps its
    rows in one range, which orders them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(
        F.percentile_approx("key", [i / parts for i in range(1, parts)], 50 * parts).alias("cuts")
    ).first()["cuts"]
    cuts = sorted(set(cuts or []))
    # Binary search in the literal cuts: the number of cuts up to the key.
    place = F.when(F.col("key").isNull(), -1).otherwise(_rank(F.col("key"), cuts))
    rows = rows.withColumn("range", place)
    firsts = (
        rows.join(
            F.broadcast(rows.groupBy("range").agg(F.min("key").alias("least"))),
            (rows["key"].eqNullSafe(F.col("least"))),
            "left_semi",
        )
        .groupBy("range")
        .agg(F.min("text").alias("first"))
    )
    around = Window.orderBy("range")
    firsts = (
        firsts.withColumn("after", F.lead("first").over(around))
        .withColumn("top", F.first("first").over(around))
        .select("range", F.coalesce("after", "top").alias("after"))
    )
    within = Window.partitionBy("range").orderBy("key", "text")
    n = F.length("text")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")),
        F.substring(F.col("next_text"), F.lit(1), F.floor(n / 2).cast("int")),
    )
    # Both leads are over the same rows in the same order: one exchange, one sort.
    signed = (
        rows.withColumn("own", bins(F.col("text")))
        .withColumn("follow", F.lead(F.struct("text", "own")).over(within))
        .join(firsts.withColumn("own_after", bins(F.col("after"))), "range")
        .withColumn("next_text", F.coalesce("follow.text", "after"))
        .withColumn("beyond", F.coalesce("follow.own", "own_after"))
        .withColumn("edited", edited)
        .withColumn("changed", bins(F.col("edited")))
    )
    return signed.select(
        F.col("key").alias(key),
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("own")).alias("fingerprint"),
        packed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("beyond")).alias("near_next"),
    )


def _rank(value: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are not over ``value``."""
    return F.size(F.filter(F.lit(cuts), lambda c: c <= value)) if cuts else F.lit(0)
