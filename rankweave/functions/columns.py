"""Column expressions that SQL dialects spell differently, or where a built-in has a trap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone; independent of the session's zone."""
    seconds = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return (seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")).cast("long")


def tail(values: Column, k: int) -> Column:
    """The last k elements; all of a shorter array (``slice`` from the end is empty there)."""
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - k + 1), F.lit(k))


def split_words(text: Column) -> Column:
    """White-space tokens; none for blank text (``split`` gives one empty token)."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def clean(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscores as blanks, single blanks. Keeps letters of any
    script: Java's ``\\w`` alone would drop them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: within a lambda, a captured expression runs again per element."""
    return F.transform(F.array(value), body)[0]


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    scaled = lambda v, n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))
    return let(a, lambda v: let(norm(v), lambda n: scaled(v, n)))


def half(x: Column) -> Column:
    """A number as 16-bit floating point keeps it (11 significant bits, half to even, steps of 2**-24 near zero), as a double."""
    x = x.cast("double")
    e = F.floor(F.log2(F.abs(x)))
    e = e - (F.abs(x) < F.pow(F.lit(2.0), e)).cast("int") + (F.abs(x) >= F.pow(F.lit(2.0), e + 1)).cast("int")
    step = F.pow(F.lit(2.0), F.greatest(e, F.lit(-14)) - 10)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / step) * step)
