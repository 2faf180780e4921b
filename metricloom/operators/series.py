"""Time-series operators: selection, latest value, retained history, text output."""

from __future__ import annotations

import math
import re
import time
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import (
    fmt_f64,
    format_labels,
    metric_map_json,
    parse_labels,
    sanitize_metric,
)
from ..functions.binding import quote
from ..functions.numbers import fmt_f64_sql, json_seconds_sql
from ..functions.text import sanitize_metric_sql
from ..schema import METRIC_TYPES
from ..sources.scratch import written
from .filters import above, mentions, time_range
from .samples import SERIES, raw_samples

_TYPE_LIST = "array(" + ", ".join(quote(t) for t in METRIC_TYPES) + ")"


# --- selection ---------------------------------------------------------------


def _sanitized(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_:]", "_", name)


def _is_named(column: str, *names: str) -> Column:
    """The sanitised ``column`` equals one of the sanitised ``names``.

    Turned round into a pattern for the raw text, since matching is cheaper
    than replacing: a ``_`` stands for any character sanitising turns into one.
    """
    patterns = (_sanitized(n).replace("_", "[^A-Za-z0-9:]") for n in names)
    return F.col(column).rlike(rf"\A(?:{'|'.join(patterns)})\z")


def _has_label(key: str, value: str) -> Column:
    return F.expr(f"exists(labels, l -> l.k = {quote(key)} AND l.v = {quote(value)})")


def match_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Keep rows whose label list holds every given pair."""
    for key, value in labels.items():
        df = df.where(_has_label(key, value))
    return df


def _with_labels(
    per_attrs: DataFrame, always: str, labels: dict[str, str] | None
) -> DataFrame:
    """Parse the labels of aggregated texts and keep those that match."""
    labelled = per_attrs.select("*", parse_labels("attrs").alias("labels"))
    for key, value in (labels or {}).items():
        labelled = labelled.where(above(F.expr(always), _has_label(key, value)))
    return labelled


def select_series(
    samples: DataFrame, name: str | None = None, labels: dict[str, str] | None = None
) -> DataFrame:
    """Series by name (both sides sanitised; None or '' is any) and label pairs."""
    if name:
        samples = samples.where(_is_named("series_name", name))
    return match_labels(samples, labels or {})


def _narrow_points(
    points: DataFrame, name: str | None, labels: dict[str, str] | None = None
) -> DataFrame:
    """Drop points that cannot yield a wanted series, before unnesting or parsing.

    The text before the first ``_`` of a sanitised name is unchanged by
    sanitising, so it is a prefix of the stored name: that prefix test reaches
    the Parquet statistics, the name pattern does not.
    """
    for value in (labels or {}).values():
        prefilter = mentions("dp_attrs", [value])
        points = points if prefilter is None else points.where(prefilter)
    if not name:
        return points
    wanted = _sanitized(name)
    bases = [wanted] + [wanted.removesuffix(s) for s in ("_sum", "_count") if wanted.endswith(s)]
    stem = re.split("_", wanted)[0]
    if stem:
        points = points.where(F.col("metric_name").startswith(stem))
    return points.where(_is_named("metric_name", *bases))


# --- latest value per series -------------------------------------------------


def _type_code() -> Column:
    return F.expr(f"CAST(array_position({_TYPE_LIST}, metric_type) AS INT)")


def _latest_aggregates(first_id: str, last_id: str) -> list[Column]:
    """Latest by arrival, type of the first arrival.

    Every buffer is a primitive, which keeps the plan a hash aggregation with a
    map-side step; a struct or string buffer would make it sort.
    """
    return [
        F.max_by("timestamp", last_id).alias("timestamp"),
        F.max_by("value", last_id).alias("value"),
        F.min_by("type_code", first_id).alias("type_code"),
        F.min(first_id).alias("first_id"),
        F.max(last_id).alias("last_id"),
    ]


def latest_by_attrs(points: DataFrame) -> DataFrame:
    """Latest sample per (series name, attribute text), before labels are parsed."""
    raw = raw_samples(points).withColumn("type_code", _type_code())
    return raw.groupBy("series_name", "attrs").agg(*_latest_aggregates("id", "id"))


def fold_by_attrs(changes: DataFrame) -> DataFrame:
    """Rows of ``latest_by_attrs`` of many batches as one row per (series name, attribute text), sorted by them."""
    folded = changes.groupBy("series_name", "attrs").agg(*_latest_aggregates("first_id", "last_id"))
    return folded.select(changes.columns).sortWithinPartitions("series_name", "attrs")


def merge_latest(partial: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Combine rows of ``latest_by_attrs`` (of one or many batches) into one per series."""
    labelled = _with_labels(partial, "last_id >= first_id", labels)
    return _named_type(labelled.groupBy(*SERIES).agg(*_latest_aggregates("first_id", "last_id")))


def _named_type(df: DataFrame) -> DataFrame:
    return df.select(
        *SERIES,
        "timestamp",
        "value",
        F.expr(f"get({_TYPE_LIST}, type_code - 1)").alias("metric_type"),
        "first_id",
        "last_id",
    )


def latest_per_series(
    points: DataFrame, name: str | None = None, labels: dict[str, str] | None = None
) -> DataFrame:
    """The last *arrived* sample of every series, with the type that arrived first.

    ``name`` and ``labels`` select series.

    Batch input aggregates by attribute text and then by labels: the first
    shuffle carries one row per task and text, the second one per text, and JSON
    is parsed once per distinct text. A stream allows one stateful aggregation,
    so there labels are parsed first and state is kept per series.
    """
    points = _narrow_points(points, name, labels)
    if not points.isStreaming:
        return select_series(merge_latest(latest_by_attrs(points), labels), name)
    raw = raw_samples(points).withColumn("type_code", _type_code())
    labelled = raw.select("*", parse_labels("attrs").alias("labels"))
    grouped = select_series(labelled, name, labels).groupBy(*SERIES)
    return _named_type(grouped.agg(*_latest_aggregates("id", "id")))


# --- retained history --------------------------------------------------------


def _spread_over_series(
    per_attrs: DataFrame, column: str, how, labels: dict[str, str] | None = None
) -> DataFrame:
    """Reduce a per-text value to its series and give it back to each text.

    ``per_attrs`` is one row per (name, text), so both sides are small; an
    aggregate and a join are used rather than a window so that many texts with
    equal labels never meet in one task's buffer.
    """
    labelled = _with_labels(per_attrs, "rows > 0", labels).drop("rows")
    per_series = labelled.groupBy(*SERIES).agg(how(column).alias(column))
    return labelled.drop(column).join(per_series, SERIES)


_TEXT = ["series_name", "attrs"]


def _nanos(seconds: float, after: bool = False) -> int:
    """Nanoseconds at or before ``seconds`` (``after``: at or after it), by the rounding of a double.

    A sample's seconds are a rounded quotient, so the exact test stays beside
    this one, which is a whole number and reaches the Parquet statistics.
    """
    if not math.isfinite(seconds):
        return (1 << 63) - 1 if seconds > 0 else -(1 << 63)
    slack = int(abs(seconds) * 1e9 * 2.0**-50) + 1
    bound = math.ceil(seconds * 1e9) + slack if after else math.floor(seconds * 1e9) - slack
    return max(-(1 << 63), min((1 << 63) - 1, bound))


def _cutoff_of(
    retention: float | timedelta | None,
    as_of: float | None,
    cutoff: float | None,
    arrival: str | None,
) -> tuple[float | None, float | None]:
    """(retention, cutoff) in seconds; no cutoff means one per series, by ``arrival``."""
    if isinstance(retention, timedelta):
        retention = retention.total_seconds()
    if retention is None and (arrival or cutoff is None):
        raise ValueError("give retention or cutoff")
    if arrival:
        return float(retention), None
    if cutoff is None:
        cutoff = (time.time() if as_of is None else as_of) - retention
    return retention, float(cutoff)


def _first_fresh(
    points: DataFrame, cutoff: float, labels: dict[str, str] | None
) -> DataFrame:
    """(series_name, labels, first_kept) of the series with a sample at or after ``cutoff``.

    Only fresh rows are read: what a series keeps starts at one of them.
    """
    fresh = raw_samples(time_range(points, _nanos(cutoff))).where(F.col("timestamp") >= cutoff)
    per_attrs = fresh.groupBy(*_TEXT).agg(
        F.min("id").alias("first_kept"), F.count("*").alias("rows")
    )
    labelled = _with_labels(per_attrs, "rows > 0", labels)
    return labelled.groupBy(*SERIES).agg(F.min("first_kept").alias("first_kept"))


def _first_kept_by_arrival(
    raw: DataFrame, retention: float, arrival: str, labels: dict[str, str] | None
) -> DataFrame:
    """(series_name, attrs, labels, first_kept) of the texts whose series keep samples."""
    last_seen = raw.groupBy(*_TEXT).agg(F.max(arrival).alias("seen"), F.count("*").alias("rows"))
    cutoffs = _spread_over_series(last_seen, "seen", F.max, labels).select(
        *_TEXT, (F.col("seen") - F.lit(retention)).alias("cutoff")
    )
    is_fresh = F.col("timestamp") >= F.col("cutoff")
    # A text without a fresh sample of its own may belong to a series that has
    # one, so every text stays in, with NULL.
    per_attrs = (
        raw.join(written(cutoffs), _TEXT)
        .groupBy(*_TEXT)
        .agg(F.min(F.when(is_fresh, F.col("id"))).alias("first_kept"), F.count("*").alias("rows"))
    )
    spread = _spread_over_series(per_attrs, "first_kept", F.min, labels)
    return spread.where("first_kept IS NOT NULL")


def series_history(
    points: DataFrame,
    retention: float | timedelta | None = None,
    as_of: float | None = None,
    cutoff: float | None = None,
    arrival: str | None = None,
    name: str | None = None,
    labels: dict[str, str] | None = None,
) -> DataFrame:
    """Samples a store with bounded retention would still hold.

    Eviction removes the leading run, in arrival order, of samples older than
    the cutoff: everything from the first sample at or after the cutoff is kept,
    late old samples included. The cutoff is ``cutoff`` seconds, or ``as_of``
    (default: now) minus ``retention``, or, with an ``arrival`` column of epoch
    seconds, each series' own last arrival minus ``retention``. ``name`` and
    ``labels`` select series.

    The first kept id of each series comes from a hash aggregation over fresh
    rows alone (map-side combine, so one hot series is no hot task) and is
    written as a small scratch table. Its least id bounds the scan of the second
    pass, whose distinct texts are joined to their series and then to the rows.
    No per-series sort and no collected lists. With ``arrival`` the cutoffs
    differ by series, so both passes read all rows.
    """
    return _history(points, retention, as_of, cutoff, arrival, name, labels)


def _history(
    points, retention, as_of, cutoff, arrival, name, labels, *described: Column, window=None
):
    """``series_history`` with further columns computed once per text.

    ``window`` (start, end in seconds) says which of the kept samples are needed.
    """
    retention, cutoff = _cutoff_of(retention, as_of, cutoff, arrival)
    narrow = _narrow_points(points, name, labels)
    wanted = narrow
    if window:
        wanted = time_range(narrow, _nanos(window[0]), _nanos(window[1], after=True))
    if arrival:
        kept = _first_kept_by_arrival(
            raw_samples(narrow, keep=[arrival]), retention, arrival, labels
        )
    else:
        starts = written(select_series(_first_fresh(narrow, cutoff, labels), name))
        wanted = wanted.where(F.col("id") >= starts.agg(F.min("first_kept")).scalar())
        texts = raw_samples(wanted).groupBy(*_TEXT).agg(F.count("*").alias("rows"))
        kept = _with_labels(texts, "rows > 0", labels).drop("rows").join(starts, SERIES)
    kept = written(select_series(kept, name).select("*", *described))
    extra = [c for c in kept.columns if c not in ("series_name", "attrs", "labels", "first_kept")]
    raw = raw_samples(wanted)
    if window:
        raw = raw.where(F.col("timestamp").between(*window))
    return (
        raw.join(kept, _TEXT)
        .where("id >= first_kept")
        .select("id", *SERIES, "timestamp", "value", "metric_type", *extra)
    )


# --- names and labels --------------------------------------------------------


def metric_names(points: DataFrame) -> DataFrame:
    """Known series names, sanitised, unique, sorted."""
    # Counted rather than distinct: a distinct below a distinct is optimized away.
    names = raw_samples(points).groupBy("series_name").agg(F.count("*").alias("rows"))
    return (
        names.where("rows > 0")
        .select(sanitize_metric("series_name").alias("name"))
        .distinct()
        .orderBy("name")
    )


def label_names(points: DataFrame) -> DataFrame:
    """Known label names and ``__name__``, unique, sorted."""
    # A histogram with neither part gives no sample; every other point gives one.
    sampled = points.where(
        "NOT (metric_type <=> 'histogram' AND hist_sum IS NULL AND hist_count IS NULL)"
    )
    texts = sampled.selectExpr("coalesce(dp_attrs, '') AS attrs").distinct()
    keys = texts.select(F.explode(parse_labels("attrs")).alias("l")).select(
        F.col("l.k").alias("label")
    )
    always = points.sparkSession.sql("SELECT '__name__' AS label")
    return keys.union(always).distinct().orderBy("label")


# --- results -----------------------------------------------------------------


def exposition(
    points: DataFrame,
    retention: float | timedelta | None = None,
    as_of: float | None = None,
    cutoff: float | None = None,
    arrival: str | None = None,
) -> DataFrame:
    """Text exposition as ordered rows ``line``: a TYPE line per name, then its series.

    Names that sanitise alike stay separate groups. Within a name, series are
    ordered by labels, and the TYPE line follows the series that arrived first.
    The latest samples feed both kinds of line, so they are written once. With
    ``retention`` or ``cutoff`` (see ``series_history``) a series that holds no
    sample any more has no line; its name's TYPE line stays.
    """
    latest = written(latest_per_series(points))
    headers = (
        latest.groupBy("series_name")
        .agg(F.min_by(F.col("metric_type") == "sum", "first_id").alias("is_sum"))
        .select(
            "series_name",
            F.lit(0).alias("part"),
            F.lit(None).cast("array<struct<k:string,v:string>>").alias("labels"),
            F.concat(
                F.lit("# TYPE "), sanitize_metric("series_name"), F.lit(" "),
                F.when(F.col("is_sum"), "counter").otherwise("gauge"),
            ).alias("line"),
        )
    )
    shown = _only_retained(latest, points, retention, as_of, cutoff, arrival)
    lines = shown.select(
        "series_name",
        F.lit(1).alias("part"),
        "labels",
        F.concat(
            sanitize_metric("series_name"), format_labels("labels"), F.lit(" "), fmt_f64("value")
        ).alias("line"),
    )
    return headers.union(lines).orderBy("series_name", "part", "labels").select("line")


def _described() -> list[Column]:
    """Columns of a result that depend on the series alone."""
    return [
        sanitize_metric("series_name").alias("name"),
        metric_map_json(sanitize_metric_sql("series_name"), "labels").alias("metric"),
    ]


def _result(df: DataFrame, *leading: str) -> DataFrame:
    pair = f"concat('[', {json_seconds_sql('timestamp')}, ',\"', {fmt_f64_sql('value')}, '\"]')"
    return df.select(
        *leading, "name", *SERIES, "timestamp", "value", "metric", F.expr(pair).alias("point")
    )


def _only_retained(latest, points, retention, as_of, cutoff, arrival, name=None, labels=None):
    """Rows of ``latest`` whose series still hold a sample; all without retention or cutoff.

    What a series keeps ends in its latest sample, so the value is the same.
    """
    if retention is None and cutoff is None:
        return latest
    retention, cutoff = _cutoff_of(retention, as_of, cutoff, arrival)
    narrow = _narrow_points(points, name, labels)
    if arrival:
        raw = raw_samples(narrow, keep=[arrival])
        alive = _first_kept_by_arrival(raw, retention, arrival, labels)
    else:
        alive = _first_fresh(narrow, cutoff, labels)
    return latest.join(alive.select(*SERIES).distinct(), SERIES, "left_semi")


def instant(
    points: DataFrame,
    name: str | None = None,
    labels: dict[str, str] | None = None,
    retention: float | timedelta | None = None,
    as_of: float | None = None,
    cutoff: float | None = None,
    arrival: str | None = None,
) -> DataFrame:
    """Latest sample of each selected series.

    Besides the plain columns, ``metric`` is the JSON label map and ``point``
    the JSON pair ``[seconds,"value"]``. With ``retention`` or ``cutoff`` (see
    ``series_history``) a series that holds no sample any more has no row.
    """
    latest = latest_per_series(points, name, labels)
    latest = _only_retained(latest, points, retention, as_of, cutoff, arrival, name, labels)
    return _result(latest.select("*", *_described()))


def range_(
    points: DataFrame,
    name: str | None = None,
    labels: dict[str, str] | None = None,
    start: float = 0.0,
    end: float | None = None,
    step: float = 15.0,
    retention: float | timedelta | None = None,
    as_of: float | None = None,
    cutoff: float | None = None,
    arrival: str | None = None,
) -> DataFrame:
    """Samples of each selected series between ``start`` and ``end`` inclusive.

    With ``retention`` or ``cutoff`` (see ``series_history``) the retained
    history is searched; without, only the latest sample is known and it is
    given whatever the range. ``step`` is accepted and ignored: samples are
    returned as stored. Rows are long, one per sample with its arrival ``id``,
    so no series is ever gathered into one row.
    """
    if retention is None and cutoff is None:
        return instant(points, name, labels)
    window = (float(start), time.time() if end is None else float(end))
    kept = _history(
        points, retention, as_of, cutoff, arrival, name, labels, *_described(), window=window
    )
    return _result(kept, "id")


def envelope(result: DataFrame, result_type: str) -> DataFrame:
    """One JSON result element per row of ``instant`` (vector) or ``range_`` (matrix).

    A matrix element holds one sample; ``matrix`` gives elements of many.
    """
    if result_type not in ("vector", "matrix"):
        raise ValueError("result_type is vector or matrix")
    field, value = ("value", "point") if result_type == "vector" else (
        "values", "concat('[', point, ']')"
    )
    element = f"concat('{{\"metric\":', metric, ',\"{field}\":', {value}, '}}')"
    return result.select(
        F.lit("success").alias("status"),
        F.lit(result_type).alias("resultType"),
        F.expr(element).alias("result"),
    )


#: Ids of a block in which the samples of a series are counted, and blocks of a stretch.
_BLOCK_BITS, _STRETCH_BITS = 16, 12


def matrix(result: DataFrame, samples: int = 1000) -> DataFrame:
    """JSON matrix elements of ``range_`` with history: each series in chunks of ``samples`` samples.

    ``chunk`` numbers the elements of a series from 0; all but its last hold
    exactly ``samples`` samples, in order of arrival. Samples are numbered from
    counts per block of ids, so no task sees more of a series than one block of
    samples, one stretch of block counts or one chunk, however hot it is.
    """
    if samples < 1:
        raise ValueError("samples must be at least 1")
    block = F.shiftright("id", _BLOCK_BITS)
    stretch = F.shiftright("id", _BLOCK_BITS + _STRETCH_BITS)
    rows = result.select("id", *SERIES, "metric", "point", block.alias("block"))

    def before(counts: DataFrame, within: list[str], order: str, name: str) -> DataFrame:
        earlier = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn(name, F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    counts = written(
        result.groupBy(*SERIES, block.alias("block"), stretch.alias("stretch")).agg(F.count("*").alias("n"))
    )
    long = counts.groupBy(*SERIES, "stretch").agg(F.sum("n").alias("n"))
    long = before(long, SERIES, "stretch", "far").drop("n")
    starts = (
        before(counts, [*SERIES, "stretch"], "block", "near")
        .join(long, [*SERIES, "stretch"])
        .select(*SERIES, "block", (F.col("far") + F.col("near")).alias("start"))
    )
    inside = F.row_number().over(Window.partitionBy(*SERIES, "block").orderBy("id"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("id", "point"))), lambda s: s["point"])
    element = F.concat(
        F.lit('{"metric":'), F.first("metric"), F.lit(',"values":['), F.concat_ws(",", values), F.lit("]}")
    )
    return (
        rows.withColumn("inside", inside)
        .join(starts, [*SERIES, "block"])
        .withColumn("chunk", F.floor((F.col("start") + F.col("inside") - 1) / samples))
        .groupBy(*SERIES, "chunk")
        .agg(element.alias("result"))
        .select(F.lit("success").alias("status"), F.lit("matrix").alias("resultType"), "chunk", "result")
    )
