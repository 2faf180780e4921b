"""Secrets in texts, and weak candidates whose complementary parts lie close together."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.batches import text_slices, texts_of
from metricloom.sources.scratch import written

#: Code points to each side of an identifier in which its other parts are looked for.
SCOPE = 160

#: Kinds in the order in which spans that start together are listed.
STRONG = ("assign", "access", "hex")
WEAK = ("account", "key", "endpoint")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
_HEX = re.compile("[0-9a-f]{16,}")
#: An identifier that is no secret by itself.
_ACCOUNT = re.compile(
    r"""(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
#: A long mixed string that may be a key; alone it is as likely a checksum or a name.
_KEY = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{4,}", re.ASCII)
_ADDRESS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?(?![0-9.])")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Z]")

Part = tuple[str, int, int]


def strong_parts(text: str) -> list[Part]:
    """The spans that count alone."""
    out: list[Part] = []
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        # A match too short still uses its text up, so the length is no part of the pattern.
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def weak_parts(text: str, strong: list[Part]) -> list[Part]:
    """Parts that count only with others: those that no strong span overlaps."""
    found: list[Part] = []
    if ":" in text or "=" in text:
        found += [("account", *m.span()) for m in _ACCOUNT.finditer(text)]
    taken = _covered(strong + found)
    for m in _KEY.finditer(text):
        if _DIGIT.search(m[0]) and _LETTER.search(m[0]) and not _overlaps(m.span(), taken):
            found.append(("key", *m.span()))
    if "://" in text:
        found += [("endpoint", *m.span()) for m in _URL.finditer(text)]
    found += [("endpoint", *m.span()) for m in _ADDRESS.finditer(text)]
    covered = _covered(strong)
    return [p for p in found if not _overlaps(p[1:], covered)]


def _covered(parts: list[Part]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the parts cover together, as rising stretches apart from each other."""
    starts: list[int] = []
    ends: list[int] = []
    for _, start, stop in sorted(parts, key=lambda p: p[1]):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], stop)
        else:
            starts.append(start)
            ends.append(stop)
    return starts, ends


def _overlaps(span: tuple[int, int], covered: tuple[list[int], list[int]]) -> bool:
    starts, ends = covered
    at = bisect_left(starts, span[1]) - 1
    return at >= 0 and ends[at] > span[0]


def find_parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, row, parts array<struct<kind, start, stop>>)`` for every row of ``docs``.

    Offsets are code points, ends exclusive; null reads as empty. ``row`` tells
    repeated keys apart.
    """
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            parts = []
            for value in texts_of(batch):
                strong = strong_parts(value)
                parts.append(strong + weak_parts(value, strong))
            rows = [[{"kind": k, "start": s, "stop": e} for k, s, e in own] for own in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(rows, pa.list_(item))], names=["key", "parts"]
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"key {kind}, parts array<struct<kind:string,start:long,stop:long>>")
    return written(found.withColumn("row", F.monotonically_increasing_id()))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``(key, spans array<struct<start, kind, stop>>)`` for every row of ``docs``, by start then kind.

    Strong spans always count. A weak part (an account name, an unlabelled key,
    an endpoint) counts where its complement lies within ``scope`` code points in
    the same text: an identifier with a secret, an endpoint with both. Parts are
    joined by interval, from the end of one to the start of the other: parts, and
    identifiers and secrets with their scope, are cut into cells of its width and
    meet there, so the work follows the number and length of parts even in a text
    that is full of them. Null reads as empty; rows without parts
    have an empty list; repeated rows each give a row.
    """

    def cells(start, stop):
        return F.explode(F.sequence(F.floor(start / scope), F.floor(stop / scope)))

    base = find_parts(docs, key, text)
    parts = base.select("row", F.explode("parts").alias("p")).select("row", "p.*").distinct()
    roles = parts.withColumn(
        "role",
        F.when(F.col("kind").isin("access", "account"), "identifier")
        .when(F.col("kind") == "endpoint", "endpoint")
        .otherwise("secret"),
    ).withColumn("weak", F.col("kind").isin(*WEAK))
    # Only texts with a weak part and an identifier have anything to link.
    open_rows = (
        roles.groupBy("row")
        .agg(F.bool_or("weak").alias("weak"), F.count_if(F.col("role") == "identifier").alias("n"))
        .where("weak AND n > 0")
        .select("row")
    )
    roles = written(roles.join(open_rows, "row", "left_semi"))
    reach = roles.select(
        F.col("row").alias("near_row"),
        F.col("start").alias("near"),
        F.col("stop").alias("near_stop"),
        "role",
        cells(F.col("start") - scope, F.col("stop") + scope).alias("near_cell"),
    )

    def linked(which: DataFrame, role: str) -> DataFrame:
        own = which.select("row", "kind", "start", "stop", cells(F.col("start"), F.col("stop")).alias("cell"))
        on = (F.col("row") == F.col("near_row")) & (F.col("cell") == F.col("near_cell"))
        within = (F.col("near") <= F.col("stop") + scope) & (F.col("start") - scope <= F.col("near_stop"))
        # A part that spans several cells may meet others in each.
        return own.join(reach.where(F.col("role") == role).drop("role"), on & within, "left_semi").drop("cell").distinct()

    weak = roles.where("weak")
    kept = (
        linked(weak.where("kind = 'account'"), "secret")
        .unionByName(linked(weak.where("kind = 'key'"), "identifier"))
        .unionByName(linked(linked(weak.where("kind = 'endpoint'"), "identifier"), "secret"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "start", "stop")).alias("extra"))
    )
    order = {k: i for i, k in enumerate((*STRONG, *WEAK))}
    rank = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    spans = F.concat(
        F.filter("parts", lambda p: p["kind"].isin(*STRONG)),
        F.coalesce("extra", F.array().cast("array<struct<kind:string,start:long,stop:long>>")),
    )
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda p: F.struct(
                p["start"].alias("start"), rank[p["kind"]].alias("rank"), p["kind"].alias("kind"), p["stop"].alias("stop")
            ),
        )
    )
    return base.join(kept, "row", "left").select(F.col("key").alias(key), ordered.alias("spans"))


def redact_secrets(
    docs: DataFrame, text: str = "text", scope: int = SCOPE, mark: str = "[SECRET]"
) -> DataFrame:
    """``docs`` with every span of ``scan_secrets`` in ``text`` replaced by ``mark``.

    Overlapping spans give one mark; null stays null; all rows and columns are
    kept. Spans depend on the text alone, so they are joined by its digest.
    """
    names = docs.columns
    tagged = docs.withColumn("__digest", F.sha2(F.col(text), 256))
    found = (
        scan_secrets(tagged.select(F.col("__digest").alias("key"), F.col(text).alias("text")), "key", "text", scope)
        .where("size(spans) > 0 AND key IS NOT NULL")
        .dropDuplicates(["key"])
        .select(F.col("key").alias("__digest"), F.col("spans").alias("__spans"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            out = []
            for value, spans in zip(
                batch.column(text).to_pylist(), batch.column("__spans").to_pylist(), strict=True
            ):
                if spans:
                    parts, at = [], 0
                    for start, stop in _merged([(s["start"], s["stop"]) for s in spans]):
                        parts += [value[at:start], mark]
                        at = stop
                    value = "".join([*parts, value[at:]])
                out.append(value)
            columns = {n: batch.column(n) for n in names}
            columns[text] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return tagged.join(found, "__digest", "left").drop("__digest").mapInArrow(run, docs.schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out
