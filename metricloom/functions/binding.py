"""Helpers for composing SQL expression text."""

from __future__ import annotations


def quote(text: str) -> str:
    """A SQL string literal for any text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(var: str, value: str, body: str) -> str:
    """``body`` with ``var`` standing for ``value``, which is evaluated once per row."""
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def last_per_key(entries: str, key: str) -> str:
    """Drop every entry whose successor has the same ``key``.

    ``entries`` must be sorted so that equal keys are adjacent and the entry to
    keep comes last.
    """
    keep = (
        f"filter(lk, (lx, li) -> li = size(lk) - 1 OR get(lk, li + 1).{key} <> lx.{key})"
    )
    return let("lk", entries, keep)
