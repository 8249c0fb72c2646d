"""Text expressions.  Null in, null out, unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def inline(value: Column, function: str) -> Column:
    """``function(value)`` with the value computed once; the function is a lambda in SQL."""
    return F.get(F.call_function("transform", F.array(value), F.expr(function)), F.lit(0))


def sql_let(value: str, name: str, body: str) -> str:
    """The same in SQL text: the body with a name for the value."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def sql_first(items: str, name: str, body: str) -> str:
    """The first body that is not null, of items in order; nothing is computed for the items behind it."""
    return f"aggregate({items}, CAST(NULL AS STRING), (found, {name}) -> coalesce(found, {body}))"


def strip(text: Column) -> Column:
    """Without white space at both ends (SQL's trim takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def filled(text: Column) -> Column:
    """Null where the text is empty."""
    return F.nullif(text, F.lit(""))


def find(text: Column, pattern: str) -> Column:
    """The first match, null if there is none."""
    return F.regexp_substr(text, F.lit(pattern))


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def has_any(text: Column, words: Iterable[str]) -> Column:
    """Whether one of the words occurs anywhere in the text."""
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def after(text: Column, separator: str) -> Column:
    """What follows the first separator, stripped."""
    return strip(F.substring(text, F.instr(text, separator) + len(separator), F.length(text)))


def first_of(items: Column, body: Callable[[Column], Column], kind: str = "string") -> Column:
    """The first ``body(item)`` that is not null; nothing is computed for the items behind it."""
    return F.aggregate(items, F.lit(None).cast(kind), lambda found, x: F.coalesce(found, body(x).cast(kind)))


def first(candidates: Column, test: Callable[[Column], Column], kind: str = "string") -> Column:
    """The first of an array that passes, null if none does; the test stops there."""
    return first_of(candidates, lambda x: F.when(test(x), x), kind)


def windows(text: Column, size: int, count: Column) -> Column:
    """The parts of ``size`` characters that start at the first ``count`` characters; none if count is not positive."""
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


DATE = r"[0-9]{2}[/-][0-9]{2}[/-][0-9]{4}"
LONG_NUMBER = r"\b[0-9]{9,18}\b"


def find_date(text: Column) -> Column:
    """The first thing like 31/12/2020 or 31-12-2020; it need not be in a calendar."""
    return find(text, DATE)


def normal(text: Column) -> Column:
    """Stripped and in upper case; null counts as empty."""
    return F.upper(strip(F.coalesce(text, F.lit(""))))


#: Characters that recognition confuses with digits (fixed values).
CONFUSED = ("OILSBZG", "0115826")


def ocr_normal(text: Column) -> Column:
    """Stripped, in upper case, with letters that look like digits as those digits; null counts as empty."""
    return F.translate(normal(text), *CONFUSED)


def ocr_match(truth: Column, predicted: Column) -> Column:
    return ocr_normal(truth) == ocr_normal(predicted)


def relaxed_match(truth: Column, predicted: Column, least: float = 0.7) -> Column:
    """Whether that share of the truth's distinct words is predicted; more words do no harm."""
    known = F.array_distinct(words(normal(truth)))
    both = F.size(F.array_intersect(known, words(normal(predicted))))
    return F.when(F.size(known) > 0, both / F.size(known) >= F.lit(least)).otherwise(F.lit(False))
