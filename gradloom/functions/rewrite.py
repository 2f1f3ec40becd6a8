"""Ordered regular-expression rewrites as column expressions.

A rule set is data, so that one list gives the Spark expression here and, in
:mod:`gradloom.plans.duck`, the SQL of another engine. Patterns stay within what Java and
RE2 read alike, except where a rule says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sub:
    """Replace every match of ``pattern``; ``$1`` stands for a group. ``multiline`` lets ``^`` and ``$`` match at lines."""

    pattern: str
    to: str = ""
    multiline: bool = False

    @property
    def java(self) -> str:
        return ("(?md)" if self.multiline else "") + self.pattern


STRIP = Sub(r"\A\s+|\s+\z")
BLANK_LINES = Sub(r"\n{3,}", "\n\n")


def rewrite(text: Column, subs: Sequence[Sub]) -> Column:
    for s in subs:
        text = F.regexp_replace(text, s.java, s.to)
    return text


def strip(text: Column) -> Column:
    """What ``STRIP`` does, without a pattern."""
    return F.trim(text, F.lit(" \t\n\x0b\f\r"))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def map_lines(text: Column, change: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    """The text with every line changed; lines for which ``keep`` is false go."""
    out = F.transform(lines(text), change)
    return F.array_join(F.filter(out, keep) if keep else out, "\n")


def first_group(text: Column, *patterns: tuple[str, int]) -> Column:
    """The group of the first pattern that matches, null if none does."""
    return F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, p, g)) for p, g in patterns])
