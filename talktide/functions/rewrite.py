"""Building blocks for text functions: Column -> Column, JVM-side.

Spark's regexp_replace can't change a group's case or decide by a lookup. `rewrite` can: the text is cut at the
matches, each match goes through a Column function, and the pieces are joined again. Patterns are Java regular
expressions; UNICODE in front makes \\w, \\s and \\b cover all of Unicode.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNICODE, IGNORE_CASE = "(?U)", "(?iU)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value's expression in the plan once, however often `use` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(f: Callable[..., Column]) -> Callable[..., Column]:
    """For functions of a text that mention it several times: composed, their plans would grow exponentially."""

    @functools.wraps(f)
    def bound(text: Column, *args, **more) -> Column:
        return let(text, lambda t: f(t, *args, **more))

    return bound


@once
def rewrite(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Each match of the pattern, which must not be empty, replaced by what `change` makes of it."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pieces = F.zip_with(between, found, lambda b, m: F.concat(b, F.when(m.isNull(), "").otherwise(change(m))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def replace_all(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def group(match: Column, pattern: str, number: int) -> Column:
    """A group of a match, found again inside it."""
    return F.regexp_extract(match, pattern, number)


def words(text: Column) -> Column:
    """Words between white space of any kind, without empty ones."""
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")


def any_of(values: list[str]) -> str:
    return "|".join(v.replace(".", r"\.") for v in values)


@once
def contains_any(text: Column, values: list[str]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | text.contains(v)
    return out


@once
def starts_with_any(text: Column, values: list[str]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | text.startswith(v)
    return out


def by_language(lang: Column, cases: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for code, value in cases.items():
        out = F.when(lang == code, value) if out is None else out.when(lang == code, value)
    return otherwise if out is None else out.otherwise(otherwise)


@once
def first_letter(text: Column, change: Callable[[Column], Column]) -> Column:
    """The first letter changed, whatever stands before it."""
    pattern = r"(?s)^([^\p{L}]*)(\p{L})(.*)$"
    return F.when(text.rlike(pattern), F.concat(F.regexp_extract(text, pattern, 1), change(F.regexp_extract(text, pattern, 2)), F.regexp_extract(text, pattern, 3))).otherwise(text)


def lower_first(text: Column) -> Column:
    return first_letter(text, F.lower)


def upper_first(text: Column) -> Column:
    return first_letter(text, F.upper)
