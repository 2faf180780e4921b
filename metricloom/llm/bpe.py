"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.batches import lists, text_slices, texts_of

#: Pre-tokens a task remembers; the memory is emptied when full.
REMEMBER = 400_000
#: Pre-tokens of up to so many symbols are merged many at a time, one tree a row.
WIDEST = 64


def _category(name: str, below: int) -> str:
    """Code points under ``below`` of a general category, as ranges for a character class of ``re``."""
    points = "".join(map(chr, range(below)))
    spans = [m.span() for m in regex.finditer(f"\\p{{{name}}}+", points)]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in spans)


# Unicode's White_Space characters.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    own = set(plain)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


_HIGH = re.compile("[\ud800-\U0010ffff]")


class PairTree:
    """Least pair of a sequence by (rank, place), kept under point updates."""

    def __init__(self, leaves: list[int], empty: int):
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.tree = [empty] * self.size + leaves + [empty] * (self.size - len(leaves))
        tree = self.tree
        for i in range(self.size - 1, 0, -1):
            x, y = tree[2 * i], tree[2 * i + 1]
            tree[i] = x if x <= y else y

    def root(self) -> int:
        return self.tree[1]

    def set(self, leaf: int, value: int) -> None:
        tree = self.tree
        i = leaf + self.size
        tree[i] = value
        while i > 1:
            i >>= 1
            x, y = tree[2 * i], tree[2 * i + 1]
            low = x if x <= y else y
            if tree[i] == low:
                break
            tree[i] = low


def merge(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the leftmost pair of lowest rank until no pair of ``pairs`` (to rank, merged id) is left."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    empty = (len(pairs) + 1) * n

    def leaf(i: int, j: int) -> int:
        found = pairs.get((symbols[i], symbols[j])) if j < n else None
        return found[0] * n + i if found else empty

    tree = PairTree([leaf(i, i + 1) for i in range(n - 1)], empty)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    while (low := tree.root()) < empty:
        i = low % n
        j = after[i]
        symbols[i] = pairs[symbols[i], symbols[j]][1]
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if j < n - 1:
            tree.set(j, empty)
        tree.set(i, leaf(i, after[i]))
        if before[i] >= 0:
            tree.set(before[i], leaf(before[i], i))
    return [s for s, here in zip(symbols, alive, strict=True) if here]


class PairTable:
    """The mergeable pairs as sorted arrays, and trees over many short sequences at once."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], width: int):
        self.width = width
        ordered = sorted((left * width + right, rank, new) for (left, right), (rank, new) in pairs.items())
        self.keys, self.rank, self.new = (np.array(x, np.int64) for x in zip(*ordered, strict=True))
        self.none = len(ordered) + 1

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.rank[at], self.none), self.new[at]

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``merge`` for each row of ``symbols`` (a power of two wide): symbols, and which are left."""
        n, width = symbols.shape
        sym = np.concatenate([symbols, np.zeros((n, 1), np.int64)], axis=1)
        place = np.arange(width + 1)
        alive = place < lengths[:, None]
        after = np.where(place + 1 < lengths[:, None], place + 1, width)
        before = np.tile(place - 1, (n, 1))
        empty = self.none * width
        tree = np.full((n, 2 * width), empty, np.int64)
        rank, _ = self.find(sym[:, : width - 1], sym[:, 1:width])
        valid = (place[1:width] < lengths[:, None]) & (rank < self.none)
        tree[:, width : 2 * width - 1] = np.where(valid, rank * width + place[: width - 1], empty)
        half = width // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2

        def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            at = leaf + width
            tree[row, at] = value
            for _ in range(width.bit_length() - 1):
                at = at >> 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])

        def value(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            rank, _ = self.find(sym[row, i], sym[row, j])
            return np.where((j < width) & (rank < self.none), rank * width + i, empty)

        row = np.arange(n)
        while len(row := row[tree[row, 1] < empty]):
            i = tree[row, 1] % width
            j = after[row, i]
            sym[row, i] = self.find(sym[row, i], sym[row, j])[1]
            alive[row, j] = False
            after[row, i] = after[row, j]
            before[row, after[row, j]] = i
            put(row, j, np.full(len(row), empty))
            put(row, i, value(row, i, after[row, i]))
            left = before[row, i]
            has = left >= 0
            put(row[has], left[has], value(row[has], left[has], i[has]))
        return sym[:, :width], alive[:, :width]


class WordBpe:
    """A vocabulary file of lower-case BPE with word ends, white space dropped.

    Texts are cut at the file's added tokens, brought to NFC, lower-cased letter
    by letter, and matched against the file's pattern; each match is encoded as
    bytes with the word end on the last one. Decoding joins the tokens as the
    file says: it has no decoder, so by one space.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.pairs = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.pairs[self.vocab[left], self.vocab[right]] = (rank, self.vocab[left + right])
        self.end = model["end_of_word_suffix"]
        letters = byte_alphabet()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # ``re`` is much faster than ``regex`` with classes of the characters a text can hold.
        pattern = split["pattern"]["Regex"].replace("\\s", _WHITE)
        self.any = regex.compile(pattern)
        self.ascii, self.basic = (
            re.compile(
                pattern.replace("[\\p{L}]", f"[{letters}]")
                .replace("[\\p{N}]", f"[{digits}]")
                .replace("\\p{L}", letters)
                .replace("\\p{N}", digits)
            )
            for letters, digits in ([_category(x, below) for x in "LN"] for below in (0x80, 0xD800))
        )
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in self.special) + ")")
        self.inner_ids, self.last_ids = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self.table = PairTable(self.pairs, len(self.tokens))
        self._forget()

    def learn(self, words: list[str]) -> None:
        """Encode pre-tokens into the pool: those of like width together, long ones alone."""
        sizes: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode()
            sizes.setdefault(1 << max(1, (len(data) - 1).bit_length()), []).append((word, data))
        for width, group in sizes.items():
            if width > WIDEST:
                ids = [merge([self.inner[b] for b in d[:-1]] + [self.last[d[-1]]], self.pairs) for _, d in group]
                self._keep([w for w, _ in group], np.array(list(map(len, ids))), np.concatenate(ids))
                continue
            lengths = np.array([len(data) for _, data in group])
            raw = np.frombuffer(b"".join([data.ljust(width, b"\0") for _, data in group]), np.uint8)
            symbols = self.inner_ids[raw].reshape(-1, width)
            ends = np.arange(len(group)), lengths - 1
            symbols[ends] = self.last_ids[raw.reshape(-1, width)[ends]]
            symbols, alive = self.table.merge(symbols, lengths)
            self._keep([w for w, _ in group], alive.sum(axis=1), symbols[alive])

    def _keep(self, words: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        at = len(self.counts)
        self.index.update(zip(words, range(at, at + len(words)), strict=True))
        self.starts = np.r_[self.starts, len(self.pool) + np.cumsum(counts) - counts]
        self.counts = np.r_[self.counts, counts]
        self.pool = np.r_[self.pool, ids.astype(np.int32)]

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts = self.counts = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)
        ids = list(self.special.values())
        self._keep(list(self.special), np.ones(len(ids), np.int64), np.array(ids))

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        # Letter by letter: the form of sigma at a word's end is not used.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return (self.any if _HIGH.search(text) else self.basic).findall(text)

    def _cut(self, text: str) -> list[str]:
        """Pre-tokens of a text, with special tokens as they stand (no pre-token equals one)."""
        if "<|" not in text:
            return self._words(text)
        out: list[str] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(part)
            else:
                out += self._words(part)
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` one after the other, and how many each text has."""
        cut = [self._cut(text) for text in texts]
        flat = list(itertools.chain.from_iterable(cut))
        if len(self.index) > REMEMBER:
            self._forget()
        find = self.index.get
        at = np.array([find(w, -1) for w in flat], np.int64)
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self.learn(list(dict.fromkeys([flat[i] for i in new])))
            at[new] = [self.index[flat[i]] for i in new]
        counts = self.counts[at]
        ends = np.r_[0, np.cumsum(counts)]
        ids = self.pool[np.repeat(self.starts[at] - ends[:-1], counts) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.cumsum([0, *map(len, cut)])])

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, special tokens included; an id that the file does not have is an error."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>, decoded)`` for every row of ``docs``; null reads as empty.

    ``path`` names the vocabulary file on each worker. The work is one narrow
    pass; a task keeps the encodings of recent pre-tokens. Repeated rows each
    give a row; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in text_slices(batches):
            ids, counts = bpe.encode_batch(texts_of(batch))
            flat, ends = ids.tolist(), np.r_[0, np.cumsum(counts)].tolist()
            decoded = [bpe.decode(flat[i:j]) for i, j in itertools.pairwise(ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), lists(ids, counts, pa.int32()), pa.array(decoded, pa.string())],
                names=["key", "ids", "decoded"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def decode_ids(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, decoded)`` for every row's ``ids``; a null list reads as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            decoded = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(decoded, pa.string())], names=["key", "decoded"]
            )

    own = rows.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = own.schema["key"].dataType.simpleString()
    return own.mapInArrow(run, f"key {kind}, decoded string").withColumnRenamed("key", key)
