"""Helpers that write DuckDB SQL."""

from __future__ import annotations

from ..functions import chars


def quoted(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def sub(expr: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(by)}, 'g')"


def trim(expr: str) -> str:
    return sub(expr, chars.TRIM)


def collapse(expr: str) -> str:
    return sub(expr, f"[{chars.REGEX_WS}]+", " ")


def fold(expr: str) -> str:
    from ..functions.text import FOLD_FROM, FOLD_TO

    return trim(collapse(f"translate(lower(translate({expr}, 'İI', 'ii')), {quoted(FOLD_FROM)}, {quoted(FOLD_TO)})"))


def layout(expr: str) -> str:
    lines = f"list_transform(string_split({sub(expr, chr(92) + 'r' + chr(92) + 'n?', chr(10))}, chr(10)), lambda x: {sub('x', chars.TRIM_RIGHT)})"
    return trim(sub(f"array_to_string({lines}, chr(10))", "\\n{3,}", "\n\n"))
