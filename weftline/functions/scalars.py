"""Scalar expressions: keys, ratios, ladders, dates, tokens. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def business_key(*columns: str | Column) -> Column:
    """MD5 over the values joined by a bar; a null counts as the empty string, so keys keep their fields apart."""
    return F.md5(F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def percent(a: Column, b: Column) -> Column:
    return F.try_divide(a * 100, b)


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b where b > 0, else 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def negated(condition: Column) -> Column:
    """NOT that keeps rows on which the condition is unknown."""
    return ~F.coalesce(condition, F.lit(False))


def lookup(labels: Mapping, key: Column, default: str | None = None) -> Column:
    """The label of a key in a literal map."""
    found = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def ladder(value: Column, steps: Sequence[tuple[float, str]], otherwise: str | None = None, strict: bool = False) -> Column:
    """The label of the first step that the value reaches from above: steps fall, ``>=`` (or ``>``)."""
    tests = [((value > at) if strict else (value >= at), F.lit(label)) for at, label in steps]
    out = reduce(lambda w, t: w.when(*t), tests[1:], F.when(*tests[0]))
    return out if otherwise is None else out.otherwise(F.lit(otherwise))


def cut(value: Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Right-closed bins between edges; null outside; ``include_lowest`` closes the first edge too."""
    tests = []
    for i, label in enumerate(labels):
        low = value >= edges[i] if include_lowest and i == 0 else value > edges[i]
        tests.append((low & (value <= edges[i + 1]), F.lit(label)))
    return reduce(lambda w, t: w.when(*t), tests[1:], F.when(*tests[0]))


def clamp(value: Column, low: Column, high: Column) -> Column:
    """Within low and high; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, high), low))


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def is_night(hour: Column, first: int = 23, last: int = 5) -> Column:
    return (hour >= first) | (hour <= last)


#: Names of days from Monday.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def day_name(at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAY_NAMES)), F.weekday(at) + 1)


def word_shape(token: Column) -> Column:
    """Upper-case letters as X, lower-case ones as x."""
    return F.regexp_replace(F.regexp_replace(token, r"\p{Lu}", "X"), r"\p{Ll}", "x")


def numeric_text(token: Column) -> Column:
    """Digits with at most one dot, at least one digit."""
    return token.rlike(r"^\d*\.?\d*$") & token.rlike(r"\d")


def list_count(items: Column) -> Column:
    """Items of a comma list; 0 for null."""
    return F.when(items.isNull(), 0).otherwise(F.size(F.split(items, ",")))


def padded(values: Column, length: Column, pad: str) -> Column:
    """An array cut or padded to a length."""
    return F.slice(F.concat(values, F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), lambda _: F.lit(pad))), F.lit(1), length)


def gain(before: Column, after: Column, higher: bool = True) -> Column:
    """Percent by which ``after`` is better than ``before``, more being better or (not ``higher``) less; null where either is 0 or unknown."""
    a, b = (before, after) if higher else (after, before)
    return F.when((before != 0) & (after != 0), (b / a - 1) * 100)
