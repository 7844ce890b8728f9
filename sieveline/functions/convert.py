"""Conversion of text to types: a value that does not convert is null, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words, and the spellings of true and false.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
TRUE = ("Y", "YES", "1", "TRUE", "T", "X")
FALSE = ("N", "NO", "0", "FALSE", "F")
TIME_SHAPES = (("HH:mm", r"^\d{2}:\d{2}$"), ("HH:mm:ss", r"^\d{2}:\d{2}:\d{2}$"), ("h:mma", r"(?i)^\d{1,2}:\d{2} ?[AP]M$"), ("HHmm", r"^\d{4}$"), ("HH.mm", r"^\d{2}\.\d{2}$"))


def failed(raw: Column, value: Column) -> Column:
    """True where there was a text and it did not convert."""
    return raw.isNotNull() & value.isNull()


def to_id(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{8}$"), c.try_cast("bigint"))


def id_problem(c: Column, second: Column | None = None) -> Column:
    """What is wrong with a record's ID or, where that is right, with a second ID that it may lack."""
    found = F.when(c.isNull(), "missing").when(~c.rlike("^[0-9]{8}$"), "not 8 digits")
    return found if second is None else found.when(~second.rlike("^[0-9]{8}$"), "second ID not 8 digits")


def to_integer(c: Column) -> Column:
    """Whole number; 'pts' and words up to ten are read, fractions are not."""
    t = F.trim(F.regexp_replace(F.lower(c), r"\s*pts$", ""))
    words = F.create_map(*[F.lit(x) for k, w in enumerate(NUMBER_WORDS) for x in (w, str(k))])
    t = F.coalesce(F.try_element_at(words, t), t)
    return F.when(t.rlike(r"^-?\d+(\.0*)?$"), F.regexp_replace(t, r"\.0*$", "").try_cast("bigint"))


def to_quantity(c: Column) -> Column:
    t = F.regexp_replace(c, ",", "")
    return F.when(t.rlike(r"^\d+(\.0*)?$"), F.regexp_replace(t, r"\.0*$", "").try_cast("bigint"))


def to_price(c: Column) -> Column:
    t = F.regexp_replace(c, r"[$,\s]|USD", "")
    return F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("decimal(12,2)"))


def to_money(c: Column) -> Column:
    """Exact cents, half up; parentheses mean negative, a lone dash zero."""
    t = F.regexp_replace(c, r"[$,\s]|USD", "")
    minus = t.rlike(r"^\(.*\)$")
    bare = F.when(minus, F.regexp_replace(t, r"^\(|\)$", "")).otherwise(t)
    value = F.when(bare.rlike(r"^-?\d*\.?\d+$|^\d+\.$"), bare.try_cast("decimal(12,2)"))
    return F.when(t == "-", F.lit(0).cast("decimal(12,2)")).otherwise(F.when(minus, -value).otherwise(value)).cast("decimal(12,2)")


def to_time(c: Column) -> Column:
    """'HH:mm:ss' of five shapes."""
    out = F.lit(None).cast("string")
    for fmt, shape in reversed(TIME_SHAPES):
        t = F.regexp_replace(F.upper(c), " ", "") if fmt.endswith("a") else c
        out = F.when(c.rlike(shape), F.date_format(F.try_to_timestamp(t, F.lit(fmt)), "HH:mm:ss")).otherwise(out)
    return out


def single_format(c: Column, pattern: str) -> Column:
    """Time stamp of one format; null where the text has another."""
    return F.try_to_timestamp(c, F.lit(pattern))


def line_total(quantity: Column, price: Column) -> Column:
    """Exact amount of a whole quantity at a price in cents."""
    return (quantity.cast("decimal(18,0)") * price.cast("decimal(12,2)")).cast("decimal(30,2)")


def to_boolean(c: Column, true=TRUE, false=FALSE) -> Column:
    return F.when(F.upper(c).isin(*true), True).when(F.upper(c).isin(*false), False)


def rank_of(c: Column, order) -> Column:
    """Position of a code in its order, from 1; null outside the list."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), c), F.lit(0))


def outside(c: Column, allowed) -> Column:
    """True for a code that is there and not in the list."""
    return F.coalesce(~c.isin(*allowed), F.lit(False))
