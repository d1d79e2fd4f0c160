"""Lenient text-to-type tests.

Spark's ``try_cast`` is wider than the contract in places (``1d`` is a double,
``2024`` is a date) and narrower in others (``1.5`` is no bigint), so each test
gates the cast with the accepted spelling.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright import types as t

# The accepted spellings of numbers, dates and timestamps.
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|nan|inf|infinity)\s*$"
WHOLE = r"^\s*[+-]?\d+\s*$"
DAY = r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}\s*$"
DAY_THEN_ANYTHING = r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}"
YES, NO = ("t", "true", "y", "yes", "1"), ("f", "false", "n", "no", "0")
MOMENT = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?.*)?\s*$"


def _gated(value: Column, pattern: str, cast: Column) -> Column:
    return F.when(value.rlike(pattern), cast)


def _dated(value: Column, pattern: str, cast: Column) -> Column:
    """A pattern check only where the fifth character allows a date at all."""
    fifth = F.substring(F.trim(value), 5, 1).isin("-", "/")
    return F.when(fifth & value.rlike(pattern), cast)


def _dashed(value: Column) -> Column:
    return F.translate(F.trim(value), "/", "-")


def _plain_whole(value: Column) -> Column:
    """Digits with an optional sign.  A failing cast is slow, so the pattern goes first."""
    return _gated(value, WHOLE, F.trim(value).try_cast("bigint"))


def _truth(value: Column, yes: tuple[str, ...], no: tuple[str, ...]) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word.isin(*yes), True).when(word.isin(*no), False)


def to_number(value: Column) -> Column:
    # whole numbers are the common case and need no pattern
    real = _gated(value, NUMBER, F.trim(value).try_cast("double"))
    return F.coalesce(_plain_whole(value).cast("double"), real)


def to_whole(value: Column) -> Column:
    """Rounds like the contract does: ``1.5`` is 2, ``1e3`` is 1000."""
    return F.coalesce(_plain_whole(value), F.round(to_number(value)).try_cast("bigint"))


def to_day(value: Column) -> Column:
    return _dated(value, DAY_THEN_ANYTHING, _dashed(value).try_cast("date"))


def to_moment(value: Column) -> Column:
    return _dated(value, DAY_THEN_ANYTHING, _dashed(value).try_cast("timestamp_ntz"))


def lenient(value: Column, kind: str) -> Column:
    """``value`` read as ``kind``, or null when it does not fit."""
    if kind == t.INTEGER:
        return to_whole(value)
    if kind == t.DECIMAL:
        return to_number(value)
    if kind == t.BOOLEAN:
        return _truth(value, YES, NO)
    if kind == t.DATE:
        return to_day(value)
    if kind == t.DATETIME:
        return to_moment(value)
    return value


def strict(value: Column, kind: str) -> Column:
    """The cast a freshly read text column gets; tighter than ``lenient``."""
    if kind == t.INTEGER:
        return _plain_whole(value)
    if kind == t.DECIMAL:
        return to_number(value)
    if kind == t.BOOLEAN:
        return _truth(value, ("true",), ("false",))
    if kind == t.DATE:
        return _dated(value, DAY, _dashed(value).try_cast("date"))
    if kind == t.DATETIME:
        return _dated(value, MOMENT, F.trim(value).try_cast("timestamp_ntz"))
    return value
