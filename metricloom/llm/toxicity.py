"""Toxicity by the nearest labelled examples in exact TF-IDF cosine, with a block-max inverted index."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.batches import lists, text_slices, texts_of

#: Labelled rows of each label that the index holds, about: a row is taken by a hash of its key.
PER_LABEL = 3000
#: Terms that the index knows: those that tell the labels apart best.
TERMS = 4000
#: Rows that must hold a term before it can be one of them, and the least chi-squared
#: statistic of term and label (one chance in a thousand that they are independent).
LEAST_ROWS = 3
LEAST_CHI = 10.83
NEIGHBOURS = 15
BLOCK = 256
#: Letters at the start of a word that form a term of their own, so forms of a word not seen still count.
STEM = 4

_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> Counter:
    """Counts of the lower-cased words of a text and of the starts of longer ones."""
    words = Counter(_WORD.findall(text.lower()))
    out = Counter(words)
    for word, n in words.items():
        if len(word) > STEM:
            out[word[:STEM] + "*"] += n
    return out


@dataclass
class ExampleIndex:
    """Examples as unit TF-IDF vectors; per term its postings and the greatest weight in each block."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    pointers: np.ndarray
    post: np.ndarray
    value: np.ndarray
    most: np.ndarray
    blank: float
    steps: tuple[np.ndarray, np.ndarray]

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of a text and their weights, of unit length together."""
        known = self.vocabulary
        found: dict[int, int] = {}
        for word, n in Counter(_WORD.findall(text.lower())).items():
            if (i := known.get(word)) is not None:
                found[i] = found.get(i, 0) + n
            if len(word) > STEM and (i := known.get(word[:STEM] + "*")) is not None:
                found[i] = found.get(i, 0) + n
        terms = np.array(sorted(found), np.int64)
        return terms, _unit(np.array([found[i] for i in terms.tolist()], float), self.idf[terms])

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, but: int = -1):
        """The ``k`` examples of greatest cosine over zero and their cosines, exactly.

        Blocks are taken by falling bound, the sum of each term's greatest weight
        in the block, until the next bound is under the k-th cosine found. Ties go
        to the lower example; ``but`` is left out.
        """
        bounds = weights @ self.most[terms]
        order = np.argsort(-bounds, kind="stable")
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 2
        pointers = self.pointers[terms]
        while at < len(order) and bounds[order[at]] > 0:
            if len(scores) >= k and bounds[order[at]] < scores[k - 1] - 1e-9:
                break
            block = order[at : at + step]
            at, step = at + step, step * 2
            low = pointers[:, block]
            size = pointers[:, block + 1] - low
            flat = size.ravel()
            ends = np.cumsum(flat)
            if not ends[-1]:
                continue
            where = np.repeat(low.ravel() - (ends - flat), flat) + np.arange(ends[-1])
            own = np.repeat(weights, size.sum(axis=1)) * self.value[where]
            sums = np.round(np.bincount(self.post[where], own, len(self.ids)), 12)
            if but >= 0:
                sums[but] = 0.0
            docs = np.flatnonzero(sums)
            found, scores = np.r_[found, docs], np.r_[scores, sums[docs]]
            best = np.lexsort((found, -scores))[:k]
            found, scores = found[best], scores[best]
        return found, scores

    def vote(self, found: np.ndarray, scores: np.ndarray) -> float:
        """Share of toxic examples, each counted by its label's sampling rate and its closeness."""
        if not len(found):
            return self.blank
        near = self.weight[found] * scores / np.maximum(1.02 - scores, 0.02)
        return float((near * self.toxic[found]).sum() / near.sum())

    def calibrated(self, vote: float) -> float:
        return float(np.clip(np.interp(vote, *self.steps), 0.0, 1.0))


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = (1 + np.log(counts)) * idf
    return weights / np.sqrt((weights * weights).sum()) if len(weights) else weights


def fit_index(
    labelled: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    per_label: int = PER_LABEL,
) -> ExampleIndex:
    """An index over about ``per_label`` rows of each label of ``labelled(key, label)`` found in ``docs``.

    A key that is labelled twice counts as toxic if any label says so; null keys
    and labels are left out. The sampled keys are at most about
    ``2 * per_label`` and thereby small enough to broadcast; term counts and the
    choice of terms are aggregated by Spark, and only the index, bounded by the
    sample and ``TERMS``, comes to the driver.
    """
    keys = (
        labelled.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    sizes = {r["label"]: r["n"] for r in keys.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 30)) / (1 << 30)
    rate = F.create_map(*(F.lit(x) for lab, n in sizes.items() for x in (lab, float(per_label) / n))) if sizes else None
    sample = keys.where(share < rate[F.col("label")]) if sizes else keys
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            for one, lab, value in zip(
                batch.column("key").to_pylist(), batch.column("label").to_pylist(), texts_of(batch), strict=True
            ):
                found = terms_of(value) or {"": 0}
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array([one] * len(found), batch.schema.field("key").type),
                        "label": pa.array([lab] * len(found), pa.int32()),
                        "term": pa.array(list(found), pa.string()),
                        "n": pa.array(list(found.values()), pa.int32()),
                    }
                )

    kind = rows.schema["key"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"key {kind}, label int, term string, n int").groupBy("key", "label", "term").agg(
        F.max("n").alias("n")
    ).persist()
    try:
        totals = dict(counted.groupBy("label").agg(F.count_distinct("key")).collect())
        n1, n0 = float(totals.get(1, 0)), float(totals.get(0, 0))
        held = counted.where("term <> ''").groupBy("term").agg(
            F.count_if(F.col("label") == 1).cast("double").alias("a"), F.count_if(F.col("label") == 0).cast("double").alias("b")
        )
        # Pearson's statistic of term and label.
        chi = F.expr(
            f"{n0 + n1} * pow(a * ({n0} - b) - b * ({n1} - a), 2)"
            f" / greatest(1, (a + b) * ({n0 + n1} - a - b) * {n0 * n1})"
        )
        chosen = (
            held.where(f"a + b >= {LEAST_ROWS}")
            .withColumn("chi", chi)
            .where(f"chi >= {LEAST_CHI}")
            .orderBy(F.desc("chi"), "term")
            .limit(TERMS)
            .select("term", (F.col("a") + F.col("b")).alias("rows"))
        ).toPandas()
        entries = (
            counted.join(F.broadcast(counted.sparkSession.createDataFrame(chosen[["term"]], "term string")), "term")
            .select("key", "label", "term", "n")
            .toPandas()
        )
    finally:
        counted.unpersist()
    return _build(chosen, entries, totals, sizes)


def _build(chosen, entries, totals: dict, sizes: dict) -> ExampleIndex:
    terms = sorted(chosen["term"])
    vocabulary = {t: i for i, t in enumerate(terms)}
    rows_of = dict(zip(chosen["term"], chosen["rows"], strict=True))
    total = max(1.0, float(sum(totals.values())))
    idf = np.array([math.log(1 + total / rows_of[t]) for t in terms])
    per_row = {lab: sizes.get(lab, 0) / max(1, n) for lab, n in totals.items()}
    entries = entries.assign(t=entries["term"].map(vocabulary)).sort_values(["key", "t"])
    vectors = []
    for (one, lab), own in entries.groupby(["key", "label"], sort=True):
        at = own["t"].to_numpy(np.int64)
        vectors.append((one, int(lab), at, _unit(own["n"].to_numpy(float), idf[at])))
    # Examples with the same strongest term lie in one block, which keeps bounds tight.
    vectors.sort(key=lambda v: (int(v[2][np.argmax(v[3])]), v[1], v[0]))
    n, v = len(vectors), len(terms)
    blocks = max(1, -(-n // BLOCK))
    post = np.concatenate([np.full(len(x[2]), i) for i, x in enumerate(vectors)]) if n else np.zeros(0, np.int64)
    term = np.concatenate([x[2] for x in vectors]) if n else np.zeros(0, np.int64)
    value = np.concatenate([x[3] for x in vectors]) if n else np.zeros(0)
    order = np.lexsort((post, term))
    post, term, value = post[order].astype(np.int64), term[order], value[order]
    cell = term * (blocks + 1) + post // BLOCK
    pointers = np.searchsorted(cell, np.arange(v)[:, None] * (blocks + 1) + np.arange(blocks + 1)[None, :])
    most = np.zeros((v, blocks))
    np.maximum.at(most, (term, post // BLOCK), value)
    seen = {lab: sum(1 for x in vectors if x[1] == lab) for lab in (0, 1)}
    bare = {lab: (totals.get(lab, 0) - seen[lab]) * per_row.get(lab, 0.0) for lab in (0, 1)}
    blank = bare[1] / (bare[0] + bare[1]) if bare[0] + bare[1] else 0.0
    index = ExampleIndex(
        vocabulary, idf, np.array([x[0] for x in vectors]), np.array([x[1] for x in vectors], float),
        np.array([per_row[x[1]] for x in vectors]), pointers, post, value, most, blank,
        (np.array([0.0, 1.0]), np.array([0.0, 1.0])),
    )
    votes = np.array([index.vote(*index.nearest(x[2], x[3], but=i)) for i, x in enumerate(vectors)])
    if n:
        index.steps = _rising(votes, index.toxic, index.weight)
    return index


def _rising(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of the label to the vote that each example gets from the others."""
    pools: list[list[float]] = []
    for i in np.argsort(votes, kind="stable"):
        pools.append([votes[i] * weight[i], toxic[i] * weight[i], weight[i]])
        while len(pools) > 1 and (
            pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]
        ):
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    x = np.array([p[0] / p[2] for p in pools])
    y = np.array([p[1] / p[2] for p in pools])
    return np.r_[0.0, x, 1.0], np.r_[min(y[0], 0.02), y, max(y[-1], 0.98)]


def score_toxicity(docs: DataFrame, index: ExampleIndex, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score, evidence array, closeness array)`` for every row of ``docs``, by ``text`` alone.

    ``evidence`` are the nearest examples' keys and ``closeness`` their cosines.
    A text without any known term (null and empty ones too) gets the share of
    toxic rows among examples without one. Repeated rows each give a row.
    """
    return with_toxicity(docs.select(F.col(key).alias(key), F.col(text).alias(text)), index, text).drop(text)


def with_toxicity(docs: DataFrame, index: ExampleIndex, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``evidence`` and ``closeness``; see ``score_toxicity``."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    integral = index.ids.dtype.kind in "iu" or not len(index.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_slices(batches, text):
            scores, counts, near, close = [], [], [], []
            for value in texts_of(batch, text):
                found, cosines = own.nearest(*own.vector(value))
                scores.append(own.calibrated(own.vote(found, cosines)) if len(found) else own.blank)
                counts.append(len(found))
                near.append(own.ids[found])
                close.append(cosines)
            flat = np.concatenate(near) if near else np.zeros(0, np.int64)
            kind = pa.int64() if integral else pa.string()
            flat = flat.astype(np.int64) if integral else [str(x) for x in flat]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(scores, pa.float64()),
                    lists(flat, counts, kind),
                    lists(np.concatenate(close), counts, pa.float64()),
                ],
                names=[*batch.schema.names, "score", "evidence", "closeness"],
            )

    held = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    item = "long" if integral else "string"
    return docs.mapInArrow(
        run, ", ".join([*held, "score double", f"evidence array<{item}>", "closeness array<double>"])
    )
