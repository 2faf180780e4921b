"""Name sanitising, label text and JSON string text."""

from __future__ import annotations

from .binding import last_per_key

# The two-character escapes of a JSON string, by character code.
_SHORT_ESCAPES = {8: r"\b", 9: r"\t", 10: r"\n", 12: r"\f", 13: r"\r"}


def sanitize_metric_sql(c: str) -> str:
    """Replace every character a metric name may not hold with ``_``."""
    return f"regexp_replace({c}, '[^A-Za-z0-9_:]', '_')"


def sanitize_label_sql(c: str) -> str:
    """Replace every character a label name may not hold with ``_``."""
    return f"regexp_replace({c}, '[^A-Za-z0-9_]', '_')"


def escape_label_sql(c: str) -> str:
    r"""Escape ``\``, ``"`` and newline, in that order."""
    return rf"replace(replace(replace({c}, r'\', r'\\'), '\"', r'\"'), '\n', r'\n')"


def format_labels_sql(labels: str) -> str:
    """``array<struct<k,v>>`` to ``{k="v",...}``; no labels, no braces."""
    pair = f"concat(fx.k, '=\"', {escape_label_sql('fx.v')}, '\"')"
    return (
        f"CASE WHEN size({labels}) = 0 THEN ''"
        f" ELSE concat('{{', array_join(transform({labels}, fx -> {pair}), ','), '}}') END"
    )


def json_str_sql(c: str) -> str:
    """A JSON string literal, quotes included; NULL stays NULL."""
    quoted = rf"replace(replace({c}, r'\', r'\\'), '\"', r'\"')"
    short = " ".join(f"WHEN {code} THEN r'{esc}'" for code, esc in _SHORT_ESCAPES.items())
    escape = rf"CASE jc {short} ELSE concat(r'\u00', lower(lpad(hex(jc), 2, '0'))) END"
    controls = (
        f"reduce(sequence(0, 31), {quoted}, (ja, jc) -> replace(ja, char(jc), {escape}))"
    )
    return (
        f"concat('\"', CASE WHEN NOT {c} RLIKE r'[\"\\\\\\x00-\\x1f]' THEN {c}"
        f" WHEN {c} RLIKE r'[\\x00-\\x1f]' THEN {controls} ELSE {quoted} END, '\"')"
    )


def metric_map_json_sql(name: str, labels: str) -> str:
    """``{"__name__":...,"label":...}``, keys in order; the last of equal keys wins."""
    entries = (
        f"array_sort(concat(array(named_struct('k', '__name__', 'i', -1, 'v', {name})),"
        f" transform({labels}, (mx, mi) -> named_struct('k', mx.k, 'i', mi, 'v', mx.v))))"
    )
    field = f"concat({json_str_sql('mf.k')}, ':', {json_str_sql('mf.v')})"
    return (
        f"concat('{{', array_join(transform({last_per_key(entries, 'k')},"
        f" mf -> {field}), ','), '}}')"
    )
