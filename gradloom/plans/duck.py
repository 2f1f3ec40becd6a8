"""Oracle SQL for rewrites: the rule sets of :mod:`gradloom.functions` as another engine's expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from gradloom.functions.rewrite import STRIP, Sub


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rewrite(x: str, subs: Sequence[Sub]) -> str:
    for s in subs:
        pattern = ("(?m)" if s.multiline else "") + s.pattern
        x = f"regexp_replace({x}, {q(pattern)}, {q(re.sub(r'[$]([0-9])', lambda m: chr(92) + m[1], s.to))}, 'g')"
    return x


def strip(x: str) -> str:
    return rewrite(x, (STRIP,))


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def lines(x: str, change: str = "l", keep: str | None = None) -> str:
    """Line-wise work: ``change`` and ``keep`` are expressions over ``l``."""
    out = f"list_transform(string_split({x}, chr(10)), lambda l: {change})"
    if keep:
        out = f"list_filter({out}, lambda l: {keep})"
    return f"coalesce(array_to_string({out}, chr(10)), '')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: length(w) > 0)"


def case(pairs: Sequence[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"
