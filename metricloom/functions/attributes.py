"""Reading attribute JSON text back: single keys, lenient integers, label lists."""

from __future__ import annotations

from .binding import last_per_key, let, quote
from .numbers import json_f64_sql
from .text import sanitize_label_sql

LABELS_TYPE = "array<struct<k:string,v:string>>"
_U64 = "DECIMAL(20,0)"

# JSON text whose members print differently through a plain string map: floats,
# integers of 19 digits and more, nested arrays and objects.
_NEEDS_EXACT = r":\s*(-?[0-9]+[.eE]|-?[0-9]{19}|-0|[\[{])"

# A JSON token: a string, a number or a run of anything else.
_TOKEN = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'


def attr_sql(text: str, key: str) -> str:
    """The member ``key`` of a JSON object text, as text (dots in keys are literal)."""
    path = f"$['{key}']"
    return f"get_json_object({text}, {quote(path)})"


def lenient_int_sql(text: str) -> str:
    """Text to BIGINT: leading integer prefix, 0 when there is none, NULL for NULL."""
    prefix = rf"regexp_extract({text}, r'^\s*([+-]?[0-9]+)', 1)"
    return (
        f"CASE WHEN {text} IS NOT NULL THEN coalesce(try_cast({text} AS BIGINT),"
        f" try_cast({prefix} AS BIGINT), 0L) END"
    )


def _tag_numbers(text: str) -> str:
    """JSON text with every number that needs care turned into a marked string.

    Floats, and integers beyond 64 bits, become ``"\u0001n<canonical text>"`` so
    that they pass through VARIANT untouched; a string that itself starts with
    the mark gets ``\u0001s`` in front. The text is split into tokens, so depth
    does not matter.
    """
    beyond_u64 = (
        "(length(tk) >= 19 AND tk RLIKE r'^-?[0-9]+$' AND try_cast(tk AS BIGINT) IS NULL"
        f" AND NOT coalesce(try_cast(tk AS {_U64}) BETWEEN 0 AND"
        f" CAST('18446744073709551615' AS {_U64}), false))"
    )
    number = let("tn", "CAST(tk AS DOUBLE)", json_f64_sql("tn"))
    return rf"""
        array_join(transform(regexp_extract_all({text}, r'{_TOKEN}', 0), tk -> CASE
          WHEN startswith(tk, '"') THEN CASE WHEN startswith(tk, r'"\u0001')
            THEN concat(r'"\u0001s', substring(tk, 2)) ELSE tk END
          WHEN tk = '-0' OR tk RLIKE r'^-?[0-9]+[.eE]' OR {beyond_u64}
            THEN concat(r'"\u0001n', {number}, '"')
          ELSE tk END), '')
    """


def _untagged_text(v: str) -> str:
    """JSON text of a tagged VARIANT: sorted keys, no blanks, marks removed."""
    numbers = rf"""regexp_replace(to_json({v}), r'"\\u0001n([^"]*)"', r'$1')"""
    strings = rf"""regexp_replace({numbers}, r'"\\u0001s', '"')"""
    # Control characters print with lower-case hex digits.
    hex_pairs = ", ".join(f"'{code:02X}'" for code in range(32) if f"{code:02X}" != f"{code:02x}")
    lowered = (
        rf"reduce(array({hex_pairs}), {strings}, (ht, hx) -> regexp_replace(ht,"
        rf" concat(r'(?<!\\)((?:\\\\)*)\\u00', hx), concat(r'$1\\u00', lower(hx))))"
    )
    return (
        rf"CASE WHEN contains(to_json({v}), r'\u00') THEN {lowered} ELSE to_json({v}) END"
    )


def _entries(text: str, value_type: str, render: str) -> str:
    return (
        f"transform(map_entries(from_json({text}, 'map<string,{value_type}>')),"
        f" (pe, pi) -> named_struct('k', {sanitize_label_sql('pe.key')},"
        f" 'raw', pe.key, 'i', pi, 'v', {render}))"
    )


def parse_labels_sql(text: str) -> str:
    """Attribute text to a label list sorted by sanitised key.

    Text that is not a JSON object gives an empty list. String values are used
    as they are, other values as their JSON text.
    """
    plain = _entries(text, "string", "coalesce(pe.value, 'null')")
    text_value = "try_variant_get(pe.value, '$', 'string')"
    exact = _entries(
        _tag_numbers(text),
        "variant",
        "CASE WHEN pe.value IS NULL OR is_variant_null(pe.value) THEN 'null'"
        " WHEN schema_of_variant(pe.value) <> 'STRING'"
        f" THEN {_untagged_text('pe.value')}"
        f" WHEN startswith({text_value}, '\x01') THEN substring({text_value}, 3)"
        f" ELSE {text_value} END",
    )
    entries = f"CASE WHEN {text} RLIKE r'{_NEEDS_EXACT}' THEN {exact} ELSE {plain} END"
    unique = last_per_key(f"array_sort({entries})", "raw")
    return (
        f"coalesce(CAST(transform({unique}, pl -> named_struct('k', pl.k, 'v', pl.v))"
        f" AS {LABELS_TYPE}), CAST(array() AS {LABELS_TYPE}))"
    )
