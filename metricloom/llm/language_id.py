"""Language of a text by prediction by partial matching over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.batches import text_slices, texts_of

#: Bytes of text, about, that the models of all languages learn from together.
SAMPLE_BYTES = 6_000_000
#: Code points of the pieces of texts by which they are sampled.
PIECE = 4096
#: Bytes of the longest context.
ORDER = 3
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_PAD = b"\n" * ORDER
_SLOTS = 1 << 20
_SPREAD = np.uint32(2654435761)


def windows(data: np.ndarray) -> np.ndarray:
    """Each byte with the ``ORDER`` bytes before it as one number, from byte ``ORDER`` on."""
    data = data.astype(np.uint32)
    out = data[ORDER:].copy()
    for back in range(1, ORDER + 1):
        out |= data[ORDER - back : len(data) - back] << np.uint32(8 * back)
    return out


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts laid end to end with padding, and where each text's windows start and end."""
    data = np.frombuffer(b"".join([x for t in texts for x in (_PAD, t)]), np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    return windows(data), starts, starts + sizes


@dataclass
class ContextTree:
    """Frozen statistics of one language: per order the code lengths of symbols and of escapes.

    Escape probabilities are those of method C: a context seen n times with d
    different symbols leaves d / (n + d) to symbols it has not seen.
    """

    symbols: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def fit(window: np.ndarray, count: np.ndarray) -> ContextTree:
        symbols, escapes = [], []
        for order in range(ORDER + 1):
            keys, at = np.unique(window & _low(order + 1), return_inverse=True)
            seen = np.bincount(at, count)
            contexts, own = np.unique(keys >> np.uint32(8), return_inverse=True)
            total = np.bincount(own, seen)
            kinds = np.bincount(own)
            symbols.append((keys, np.log2((total + kinds)[own] / seen)))
            escapes.append((contexts, np.log2((total + kinds) / kinds)))
        return ContextTree(symbols, escapes)

    def lengths(self, window: np.ndarray) -> np.ndarray:
        """Bits of each window's last byte after the others, from the longest context down."""
        bits = np.zeros(len(window))
        open_ = np.ones(len(window), bool)
        for order in range(ORDER, -1, -1):
            known, cost = _find(self.symbols[order], window & _low(order + 1))
            bits[open_ & known] += cost[open_ & known]
            open_ &= ~known
            known, cost = _find(self.escapes[order], (window >> np.uint32(8)) & _low(order))
            bits[open_ & known] += cost[open_ & known]
        return bits + 8 * open_


def _low(n: int) -> np.uint32:
    return np.uint32((1 << (8 * n)) - 1)


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return table[0][at] == keys, table[1][at]


class LanguageModels:
    """Context trees of all languages, with the code lengths of all windows met in training laid out flat."""

    def __init__(self, names: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.names = names
        self.trees = [ContextTree.fit(w, n) for w, n in counts]
        self.known = np.unique(np.concatenate([w for w, _ in counts])) if counts else np.zeros(0, np.uint32)
        self.bits = self._lengths(self.known)
        self.slot = np.full(_SLOTS, 0, np.int32)
        self.slot[self._place(self.known)] = np.arange(len(self.known))

    @staticmethod
    def _place(window: np.ndarray) -> np.ndarray:
        return (window * _SPREAD) >> np.uint32(32 - 20)

    def _lengths(self, window: np.ndarray) -> np.ndarray:
        out = np.zeros((len(window), len(self.names)), np.float32)
        for i, tree in enumerate(self.trees):
            out[:, i] = tree.lengths(window)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        window, starts, ends = windows_of(texts)
        at = self.slot[self._place(window)]
        strange = self.known[at] != window
        bits = self.bits[at]
        if strange.any():
            odd, back = np.unique(window[strange], return_inverse=True)
            bits[strange] = self._lengths(odd)[back]
        sums = np.zeros((len(bits) + 1, bits.shape[1]))
        np.cumsum(bits, axis=0, dtype=np.float64, out=sums[1:])
        # Windows that end in padding belong to no text.
        return sums[ends] - sums[starts]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lettered = [t is not None and _LETTER.search(t) is not None for t in texts]
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        which = [i for i, ok in enumerate(lettered) if ok]
        if not which or not self.names:
            return names, scores
        data = [texts[i].encode() for i in which]
        bits = self.code_lengths(data)
        best = bits.argmin(axis=1)
        spread = np.sqrt(np.maximum(1, [len(d) for d in data]))[:, None]
        share = np.exp2(-np.minimum(60, (bits - bits.min(axis=1, keepdims=True)) / spread))
        for i, b, s in zip(which, best.tolist(), (1 / share.sum(axis=1)).tolist(), strict=True):
            names[i], scores[i] = self.names[b], s
        return names, scores


def fit_languages(
    docs: DataFrame, text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES
) -> LanguageModels:
    """Models of the languages of ``docs``; rows without text or language are left out.

    Each language learns from about ``sample_bytes`` / (number of languages)
    bytes: pieces of ``PIECE`` code points at most, taken by their hash, and at
    least the one of least hash. Copies of a piece share its hash, count as one
    in the rate and are learned once, so a common piece takes no more of the sample
    than a rare one. How rows lie in partitions does not matter. Windows are counted and summed by Spark; what comes to the driver
    is bounded by ``sample_bytes`` and a piece per language.
    """
    rows = docs.where(F.col(lang).isNotNull() & (F.col(text) != "")).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )
    pieces = F.when(F.length("text") <= PIECE, F.array("text")).otherwise(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    )
    rows = rows.select("lang", F.explode(pieces).alias("text"))
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)
    sizes = (
        rows.groupBy("lang", F.xxhash64("text"))
        .agg(F.max(F.octet_length("text")).alias("n"), F.min(share).alias("share"))
        .groupBy("lang")
        .agg(F.sum("n").alias("n"), F.min("share").alias("least"))
        .collect()
    )
    if not sizes:
        return LanguageModels([], [])
    each = sample_bytes / len(sizes)
    rate = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], max(each / r["n"], r["least"]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            own: dict[str, list[bytes]] = {}
            for name, value in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                own.setdefault(name, []).append(value.encode())
            for name, texts in own.items():
                window, _, ends = windows_of(texts)
                padding = (ends[:-1, None] + np.arange(ORDER)).ravel()
                found, n = np.unique(np.delete(window, padding), return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([name] * len(found), pa.string()),
                        "w": pa.array(found.astype(np.int64)),
                        "n": pa.array(n.astype(np.int64)),
                    }
                )

    counted = (
        rows.where(share <= rate[F.col("lang")])
        .distinct()
        .mapInArrow(run, "lang string, w long, n long")
        .groupBy("lang", "w")
        .agg(F.sum("n").alias("n"))
        .toPandas()
        .sort_values(["lang", "w"])
    )
    names, tables = [], []
    for name, own in counted.groupby("lang", sort=True):
        names.append(name)
        tables.append((own["w"].to_numpy(np.uint32), own["n"].to_numpy(float)))
    return LanguageModels(names, tables)


def predict_language(docs: DataFrame, models: LanguageModels, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score)`` for every row of ``docs``, by ``text`` alone.

    The language of the shortest code; ``score`` falls as other languages come
    near. Null texts and texts without a letter are ``und`` with score 0, as is
    everything when nothing was learned; ties go to the first name. Repeated
    rows each give a row; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["key", "lang_pred", "score"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
