"""Number text and integer width conversions."""

from __future__ import annotations

from .binding import let

_TWO_64 = "CAST('18446744073709551616' AS DECIMAL(20,0))"
_TWO_63 = "CAST('9223372036854775808' AS DECIMAL(20,0))"


def _is_short_plain(text: str) -> str:
    # Below 17 characters a text without exponent is already the shortest form.
    return f"(length({text}) < 17 AND NOT contains({text}, 'E'))"


def _shortest_text(x: str) -> str:
    """Decimal text with the fewest digits that still reads back as ``x``.

    The JVM's text can carry a superfluous digit or two; fewer digits are tried
    first and kept when they denote the same double. Up to 15 digits it cannot,
    except below the normal range.
    """
    text = f"CAST({x} AS STRING)"
    attempts = (
        f"transform(array('%.0e', '%.14e', '%.15e', '%.16e'), sf -> format_string(sf, {x}))"
    )
    same = f"get(filter({attempts}, st -> CAST(st AS DOUBLE) = {x}), 0)"
    return (
        f"CASE WHEN length(substring_index({text}, 'E', 1)) <= 16 AND abs({x}) > 2.3e-308D"
        f" THEN {text} ELSE coalesce(upper({same}), {text}) END"
    )


def _decompose(x: str) -> str:
    """struct(sign, digits, point) with ``|x| = 0.digits * 10^point``."""
    parts = let(
        "dt",
        _shortest_text(x),
        "named_struct("
        "'neg', startswith(dt, '-'),"
        "'whole', substring_index(replace(substring_index(dt, 'E', 1), '-', ''), '.', 1),"
        "'frac', CASE WHEN contains(dt, '.') THEN"
        " substring_index(substring_index(dt, 'E', 1), '.', -1) ELSE '' END,"
        "'exp', CASE WHEN contains(dt, 'E') THEN"
        " CAST(substring_index(dt, 'E', -1) AS INT) ELSE 0 END)",
    )
    return let(
        "dp",
        parts,
        "named_struct("
        "'sign', CASE WHEN dp.neg THEN '-' ELSE '' END,"
        "'digits', trim(BOTH '0' FROM concat(dp.whole, dp.frac)),"
        "'point', length(ltrim('0', concat(dp.whole, dp.frac)))"
        " - length(dp.frac) + dp.exp)",
    )


def _positional(n: str, integral_suffix: str) -> str:
    return (
        f"concat({n}.sign, CASE"
        f" WHEN {n}.point <= 0 THEN concat('0.', repeat('0', -{n}.point), {n}.digits)"
        f" WHEN {n}.point >= length({n}.digits) THEN concat({n}.digits,"
        f" repeat('0', {n}.point - length({n}.digits)), '{integral_suffix}')"
        f" ELSE concat(substring({n}.digits, 1, {n}.point), '.',"
        f" substring({n}.digits, {n}.point + 1)) END)"
    )


def _scientific(n: str) -> str:
    return (
        f"concat({n}.sign, substring({n}.digits, 1, 1),"
        f" CASE WHEN length({n}.digits) > 1"
        f" THEN concat('.', substring({n}.digits, 2)) ELSE '' END,"
        f" 'e', CAST({n}.point - 1 AS STRING))"
    )


def fmt_f64_sql(x: str) -> str:
    """Shortest plain decimal: ``50``, ``72.5``, never an exponent; NaN, inf, -inf."""
    text = f"CAST({x} AS STRING)"
    return (
        f"CASE WHEN {x} IS NULL THEN NULL"
        f" WHEN isnan({x}) THEN 'NaN'"
        f" WHEN {x} = double('Infinity') THEN 'inf'"
        f" WHEN {x} = double('-Infinity') THEN '-inf'"
        f" WHEN {_is_short_plain(text)} THEN CASE WHEN endswith({text}, '.0')"
        f" THEN substring({text}, 1, length({text}) - 2) ELSE {text} END"
        f" ELSE {let('fn', _decompose(x), _positional('fn', ''))} END"
    )


def json_f64_sql(x: str) -> str:
    """A double as a JSON number: ``1.0``, ``1e16``, ``1.5e-7``; non-finite is null.

    Positional between 1e-5 and 1e16, scientific outside, shortest digits.
    """
    text = f"CAST({x} AS STRING)"
    shaped = (
        f"CASE WHEN jn.point > -5 AND jn.point <= 16 THEN {_positional('jn', '.0')}"
        f" ELSE {_scientific('jn')} END"
    )
    return (
        f"CASE WHEN {x} IS NULL OR isnan({x}) OR abs({x}) = double('Infinity') THEN 'null'"
        f" WHEN {_is_short_plain(text)} THEN {text}"
        f" ELSE {let('jn', _decompose(x), shaped)} END"
    )


def json_seconds_sql(x: str) -> str:
    """``json_f64`` for epoch seconds, which all have ten digits before the point.

    Six decimals make 16 digits; they are the text when they read back as ``x``,
    else the JVM's 17 digits are. Decimal casts are far cheaper than the general
    search, and every row of a range result needs one.
    """
    micros = f"CAST({x} AS DECIMAL(38,6))"
    trimmed = f"rtrim('0', CAST({micros} AS STRING))"
    text = f"CAST({x} AS STRING)"
    return (
        f"CASE WHEN {x} >= 1e9D AND {x} < 1e10D THEN CASE WHEN CAST({micros} AS DOUBLE) = {x}"
        f" THEN concat({trimmed}, CASE WHEN endswith({trimmed}, '.') THEN '0' ELSE '' END)"
        f" ELSE concat(substring({text}, 1, 1), substring({text}, 3, 9), '.',"
        f" substring(substring_index({text}, 'E', 1), 12)) END"
        f" ELSE {json_f64_sql(x)} END"
    )


def as_i64_sql(text: str) -> str:
    """Decimal text of an unsigned 64-bit integer, reinterpreted as signed."""
    wide = f"try_cast({text} AS DECIMAL(20,0))"
    return (
        f"coalesce(try_cast({text} AS BIGINT), try_cast(CASE WHEN {wide} >= {_TWO_63}"
        f" THEN {wide} - {_TWO_64} ELSE {wide} END AS BIGINT))"
    )


def as_i32_sql(number: str) -> str:
    """An unsigned 32-bit integer held in a BIGINT, reinterpreted as signed."""
    return (
        f"CAST(CASE WHEN {number} >= 2147483648 THEN {number} - 4294967296"
        f" ELSE {number} END AS INT)"
    )


def unsigned_text_sql(text: str) -> str:
    """Decimal text of an unsigned integer, kept unsigned."""
    return f"CAST(try_cast({text} AS DECIMAL(20,0)) AS STRING)"
