"""Attribute lists of an export request to JSON text."""

from __future__ import annotations

import json
import re

from .binding import last_per_key, let
from .numbers import json_f64_sql
from .text import json_str_sql

# A JSON string, a mark of structure (commas and colons say nothing more), or another scalar.
_TOKEN = r'"(?:[^"\\]|\\.)*"|[{}\[\]]|[^\s{}\[\]:,"]+'

# Scalar members of a value in the order in which they count, should there be several.
_SCALARS = ("stringValue", "intValue", "boolValue", "doubleValue", "bytesValue")
_ENTRY = "struct<k:string,i:int,v:string>"
_FRAME = f"struct<role:string,name:string,rank:int,out:string,key:string,items:array<{_ENTRY}>>"
_STATE = f"array<{_FRAME}>"


def _object_text(entries: str) -> str:
    """``array<struct<k,i,v>>`` (v is JSON text) to an object, keys sorted, last wins."""
    field = f"concat({json_str_sql('of.k')}, ':', of.v)"
    return (
        f"concat('{{', array_join(transform({last_per_key(f'array_sort({entries})', 'k')},"
        f" of -> {field}), ','), '}}')"
    )


def _scalar_text(member: str, text: str) -> str:
    """JSON text of a scalar member whose value is ``text``."""
    return {
        "stringValue": json_str_sql(text),
        "intValue": f"coalesce(CAST(try_cast({text} AS BIGINT) AS STRING), 'null')",
        "boolValue": f"coalesce(CAST(try_cast({text} AS BOOLEAN) AS STRING), 'null')",
        "doubleValue": let("sd", f"try_cast({text} AS DOUBLE)", json_f64_sql("sd")),
        "bytesValue": f"concat('\"', lower(hex(unbase64({text}))), '\"')",
    }[member]


def _frame(role: str, **fields: str) -> str:
    """A frame as SQL; members not given are those of ``f``, or empty in a new one (``f`` is then no name)."""
    empty = {
        "name": "CAST(NULL AS STRING)",
        "rank": "99",
        "out": "CAST(NULL AS STRING)",
        "key": "''",
        "items": f"CAST(array() AS array<{_ENTRY}>)",
    }
    held = {"role": role, **{k: fields.get(k, v) for k, v in empty.items()}}
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in held.items()) + ")"


def _changed(f: str, **fields: str) -> str:
    """Frame ``f`` with some members replaced."""
    held = {k: fields.get(k, f"{f}.{k}") for k in ("name", "rank", "out", "key", "items")}
    return _frame(f"{f}.role", **held)


def _opened(f: str, token: str) -> str:
    """The role of what ``token`` opens inside frame ``f``."""
    return (
        f"CASE WHEN {f}.role = 'value' AND {f}.name = 'arrayValue' AND {token} = '{{' THEN 'array'"
        f" WHEN {f}.role = 'value' AND {f}.name = 'kvlistValue' AND {token} = '{{' THEN 'kvlist'"
        f" WHEN {f}.role IN ('array', 'kvlist') AND {f}.name = 'values' AND {token} = '['"
        f" THEN concat({f}.role, ' items')"
        f" WHEN {f}.role = 'array items' AND {token} = '{{' THEN 'value'"
        f" WHEN {f}.role = 'kvlist items' AND {token} = '{{' THEN 'entry'"
        f" WHEN {f}.role = 'entry' AND {f}.name = 'value' AND {token} = '{{' THEN 'value'"
        f" ELSE 'other' END"
    )


def _closed(f: str) -> str:
    """JSON text of a frame that ends."""
    return (
        f"CASE {f}.role WHEN 'array items' THEN concat('[', array_join(transform({f}.items, fi -> fi.v), ','), ']')"
        f" WHEN 'kvlist items' THEN {_object_text(f'{f}.items')}"
        f" WHEN 'array' THEN coalesce({f}.out, '[]') WHEN 'kvlist' THEN coalesce({f}.out, '{{}}')"
        f" WHEN 'other' THEN CAST(NULL AS STRING) ELSE coalesce({f}.out, 'null') END"
    )


def _added(f: str, key: str, text: str) -> str:
    entry = f"named_struct('k', {key}, 'i', size({f}.items), 'v', coalesce({text}, 'null'))"
    return _changed(f, items=f"concat({f}.items, array({entry}))", name="CAST(NULL AS STRING)")


def _given(f: str, child: str, text: str) -> str:
    """Frame ``f`` after ``child``, which ends with ``text``, was put into it."""
    nested = f"CASE {f}.name WHEN 'arrayValue' THEN {len(_SCALARS)} ELSE {len(_SCALARS) + 1} END"
    name = "CAST(NULL AS STRING)"
    return (
        f"CASE WHEN {f}.role IN ('array items', 'kvlist items') THEN {_added(f, f'{child}.key', text)}"
        f" WHEN {child}.role = 'other' THEN {_changed(f, name=name)}"
        f" WHEN {f}.role = 'value' AND {nested} < {f}.rank THEN {_changed(f, name=name, rank=nested, out=text)}"
        f" WHEN {f}.role = 'value' THEN {_changed(f, name=name)}"
        f" ELSE {_changed(f, name=name, out=text)} END"
    )


def _taken(f: str, token: str) -> str:
    """Frame ``f`` after a scalar token: a member's name, or a value."""
    text = (
        f"CASE WHEN startswith({token}, '\"') THEN element_at(from_json(concat('[', {token}, ']'), 'array<string>'), 1)"
        f" ELSE {token} END"
    )
    scalar = " ".join(
        f"WHEN {f}.name = '{m}' AND {i} < {f}.rank THEN {_changed(f, name='CAST(NULL AS STRING)', rank=str(i), out=_scalar_text(m, 'tx'))}"
        for i, m in enumerate(_SCALARS)
    )
    nothing = _changed(f, name="CAST(NULL AS STRING)")
    return let(
        "tx",
        text,
        f"CASE WHEN {f}.role IN ('array items', 'kvlist items') THEN {_added(f, chr(39) * 2, 'CAST(NULL AS STRING)')}"
        f" WHEN {f}.role = 'other' THEN {f}"
        f" WHEN {f}.name IS NULL THEN {_changed(f, name='tx')}"
        f" WHEN {token} = 'null' THEN {nothing}"
        f" WHEN {f}.role = 'value' THEN CASE {scalar} ELSE {nothing} END"
        f" WHEN {f}.role = 'entry' AND {f}.name = 'key' THEN {_changed(f, name='CAST(NULL AS STRING)', key='tx')}"
        f" ELSE {nothing} END",
    )


def _nested_text(value: str) -> str:
    """Array or key-value list, however deep: a fold over the JSON tokens with a stack of open objects and lists.

    A closed object or list is put into the one around it as JSON text, so the
    expression has one form for all levels. ``value`` members that hold something
    else than the encoding allows read as unset.
    """
    kind = f"CASE WHEN {value}.arrayValue IS NOT NULL THEN 'arrayValue' ELSE 'kvlistValue' END"
    text = f"to_json(coalesce({value}.arrayValue, {value}.kvlistValue))"
    tokens = f"regexp_extract_all({text}, r'{_TOKEN}', 0)"
    root = _frame("'value'", name=kind)
    closing = let(
        "fc",
        _closed("element_at(st, -1)"),
        f"concat(slice(st, 1, size(st) - 2), array({_given('element_at(st, -2)', 'element_at(st, -1)', 'fc')}))",
    )
    step = (
        f"CASE WHEN tk IN ('{{', '[') THEN concat(st, array({_frame(_opened('element_at(st, -1)', 'tk'))}))"
        f" WHEN tk IN ('}}', ']') THEN {closing}"
        f" ELSE concat(slice(st, 1, size(st) - 1), array({let('ft', 'element_at(st, -1)', _taken('ft', 'tk'))})) END"
    )
    empty = f"CASE WHEN {value}.arrayValue IS NOT NULL THEN '[]' ELSE '{{}}' END"
    return (
        f"aggregate({tokens}, CAST(array({root}) AS {_STATE}), (st, tk) -> {step},"
        f" st -> coalesce(st[0].out, {empty}))"
    )


def _keyed(entries: str, parts: str | None = None) -> str:
    nested = None if parts is None else f"element_at({parts}, ki + 1)"
    return (
        f"transform({entries}, (ke, ki) -> named_struct("
        f"'k', coalesce(ke.key, ''), 'i', ki, 'v', {any_value_to_json_sql('ke.value', nested)}))"
    )


def any_value_to_json_sql(value: str, parts: str | None = None) -> str:
    """One attribute value as JSON text; arrays and key-value lists may nest to any depth.

    ``parts`` is what ``nested_parts`` gave for the value's nested member; without
    it, the nesting is folded in SQL.
    """
    scalars = " ".join(
        f"WHEN {value}.{m} IS NOT NULL THEN {_scalar_text(m, f'{value}.{m}')}" for m in _SCALARS
    )
    nested = _nested_text(value) if parts is None else _assembled(parts)
    return (
        f"CASE {scalars} WHEN {value}.arrayValue IS NOT NULL OR {value}.kvlistValue IS NOT NULL"
        f" THEN {nested} ELSE 'null' END"
    )


def attrs_to_json_sql(attributes: str, nested_parts_fn: str | None = None) -> str:
    """An attribute list as JSON object text; NULL when the list is empty.

    With ``nested_parts_fn``, the name of a function that applies ``nested_parts``
    to each item of ``NESTED_INPUT``, nested values are folded by it.
    """
    if nested_parts_fn is None:
        return f"CASE WHEN size({attributes}) > 0 THEN {_object_text(_keyed(attributes))} END"
    parts = f"{nested_parts_fn}({nested_input_sql(attributes)})"
    keyed = let("np", parts, _object_text(_keyed(attributes, "np")))
    return f"CASE WHEN size({attributes}) > 0 THEN {keyed} END"


# --- nested values, folded by a Python helper ------------------------------------

NESTED_INPUT = "array<struct<kind:string,text:string>>"
NESTED_PARTS = "array<struct<pieces:array<string>,kinds:array<string>,texts:array<string>>>"


def nested_input_sql(attributes: str) -> str:
    """Per attribute, the nested member's kind and JSON text, when no scalar member is set."""
    scalar = " OR ".join(f"ke.value.{m} IS NOT NULL" for m in _SCALARS)
    return (
        f"transform({attributes}, ke -> CASE WHEN NOT ({scalar}) AND (ke.value.arrayValue IS NOT NULL"
        f" OR ke.value.kvlistValue IS NOT NULL) THEN named_struct('kind', CASE WHEN ke.value.arrayValue"
        f" IS NOT NULL THEN 'arrayValue' ELSE 'kvlistValue' END, 'text',"
        f" to_json(coalesce(ke.value.arrayValue, ke.value.kvlistValue))) END)"
    )


def _assembled(parts: str) -> str:
    """The JSON text of ``nested_parts``: pieces with the scalars and keys between them, formatted in SQL."""
    leaf = " ".join(
        f"WHEN '{m}' THEN {_scalar_text(m, 'get(pp.texts, pj)')}" for m in _SCALARS
    )
    formatted = f"CASE get(pp.kinds, pj) WHEN 'key' THEN {json_str_sql('get(pp.texts, pj)')} {leaf} END"
    return let("pp", parts, f"array_join(transform(pp.pieces, (pc, pj) -> concat(pc, coalesce({formatted}, ''))), '')")


_PY_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]|[^ \t\n\x0b\f\r{}\[\]:,"]+')
_RANK = {m: i for i, m in enumerate(_SCALARS)}


class _Frame:
    __slots__ = ("role", "name", "rank", "out", "key", "items")

    def __init__(self, role: str, name=None):
        self.role, self.name, self.rank, self.out, self.key, self.items = role, name, 99, None, [""], []


def _py_opened(f: _Frame, tk: str) -> str:
    if f.role == "value" and f.name == "arrayValue" and tk == "{":
        return "array"
    if f.role == "value" and f.name == "kvlistValue" and tk == "{":
        return "kvlist"
    if f.role in ("array", "kvlist") and f.name == "values" and tk == "[":
        return f"{f.role} items"
    if f.role == "array items" and tk == "{":
        return "value"
    if f.role == "kvlist items" and tk == "{":
        return "entry"
    if f.role == "entry" and f.name == "value" and tk == "{":
        return "value"
    return "other"


def _py_closed(f: _Frame):
    if f.role == "array items":
        out = ["["]
        for n, (_, _, v) in enumerate(f.items):
            out += ([","] if n else []) + v
        return out + ["]"]
    if f.role == "kvlist items":
        # Sorted by key, then position; the last of a key wins.
        ordered = sorted(f.items, key=lambda e: (e[0][0], e[1]))
        kept = [e for n, e in enumerate(ordered) if n == len(ordered) - 1 or ordered[n + 1][0][0] != e[0][0]]
        out = ["{"]
        for n, (k, _, v) in enumerate(kept):
            out += ([","] if n else []) + [("key", k[0]), ":"] + v
        return out + ["}"]
    if f.role == "array":
        return f.out if f.out is not None else ["[]"]
    if f.role == "kvlist":
        return f.out if f.out is not None else ["{}"]
    if f.role == "other":
        return None
    return f.out if f.out is not None else ["null"]


def _py_given(f: _Frame, child: _Frame, text) -> None:
    if f.role in ("array items", "kvlist items"):
        f.items.append((child.key, len(f.items), text if text is not None else ["null"]))
    elif child.role != "other" and f.role == "value":
        nested = len(_SCALARS) if f.name == "arrayValue" else len(_SCALARS) + 1
        if nested < f.rank:
            f.rank, f.out = nested, text
    elif child.role != "other":
        f.out = text
    f.name = None


def _py_taken(f: _Frame, tk: str) -> None:
    if tk.startswith('"'):
        try:
            tx = json.loads(tk)
        except ValueError:
            tx = None
    else:
        tx = tk
    if f.role in ("array items", "kvlist items"):
        f.items.append(([""], len(f.items), ["null"]))
        f.name = None
    elif f.role == "other":
        pass
    elif f.name is None:
        f.name = tx
    elif tk == "null":
        f.name = None
    elif f.role == "value":
        i = _RANK.get(f.name)
        if i is not None and i < f.rank:
            f.rank, f.out = i, [(f.name, tx)]
        f.name = None
    elif f.role == "entry" and f.name == "key":
        f.key, f.name = [tx], None
    else:
        f.name = None


def nested_parts(kind: str | None, text: str | None) -> dict | None:
    """The fold of ``_nested_text`` in Python, over the same tokens.

    Gives the JSON text as ``pieces`` with a scalar or key between each two:
    its member (or ``key``) in ``kinds`` and its text in ``texts``, formatted
    afterwards in SQL exactly as the scalars of the outermost value are.
    """
    if kind is None or text is None:
        return None
    stack = [_Frame("value", kind)]
    for tk in _PY_TOKEN.findall(text):
        if tk in ("{", "["):
            stack.append(_Frame(_py_opened(stack[-1], tk)))
        elif tk in ("}", "]"):
            child = stack.pop()
            _py_given(stack[-1], child, _py_closed(child))
        else:
            _py_taken(stack[-1], tk)
    done = stack[0].out if stack[0].out is not None else ["[]" if kind == "arrayValue" else "{}"]
    pieces, kinds, texts = [""], [], []
    for part in done:
        if isinstance(part, str):
            pieces[-1] += part
        else:
            kinds.append(part[0])
            texts.append(part[1])
            pieces.append("")
    return {"pieces": pieces, "kinds": kinds, "texts": texts}
