"""Time: fields, arithmetic, parsing."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("year", "month", "day", "hour", "minute", "second", "millisecond")
UNITS = ("year", "month", "day", "hour", "minute", "second", "millisecond")
DAY_MS = 86_400_000

# The shapes of text that are read as a time, tried in this order.
PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "yyyyMMdd",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMMM yyyy",
    "yyyy-MM-dd h:mm[:ss] a",
    "yyyyMMdd HH:mm[:ss[.SSS]]",
    "yyyyMMdd h:mm[:ss] a",
    "d-MMM-yyyy[ HH:mm[:ss[.SSS]]]",
    "d-MMM-yyyy h:mm[:ss] a",
)
MONTH_FIRST = ("M/d/yyyy[ HH:mm[:ss[.SSS]]]", "M/d/yyyy h:mm[:ss] a", "M-d-yyyy")
DAY_FIRST = ("d/M/yyyy[ HH:mm[:ss[.SSS]]]", "d/M/yyyy h:mm[:ss] a", "d-M-yyyy", "d.M.yyyy")
#: A zone after a time: its name, or hours and minutes from UTC.
ZONE = r"\s+(GMT|UTC|Z|[+-]\d\d:?\d\d|[A-Z][A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)$"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Digits from which on are milliseconds.
MILLIS_FROM = 100_000_000_000


def millis(c: Column) -> Column:
    """Milliseconds since 1970."""
    return F.unix_millis(c.cast("timestamp"))


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c)


def field(c: Column, name: str) -> Column:
    if name == "millisecond":
        return F.pmod(millis(c), F.lit(1000)).cast("int")
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}[name](c)


def plus(c: Column, n: int | Column, unit: str) -> Column:
    """Later by n units; months and years keep the day where the month has it."""
    n = F.lit(n) if isinstance(n, int) else n
    if unit == "millisecond":
        return from_millis(millis(c) + n)
    return F.timestamp_add(unit.upper(), n, c.cast("timestamp"))


def minus(c: Column, n: int | Column, unit: str) -> Column:
    return plus(c, -n, unit)


def days_between(a: Column, b: Column) -> Column:
    """Whole days between two times, whichever is earlier."""
    return F.floor(F.abs(millis(a) - millis(b)) / DAY_MS).cast("long")


def midnight(c: Column) -> Column:
    return F.date_trunc("day", c)


def is_expired(c: Column, seconds: int, now: Column | None = None) -> Column:
    return millis(c) + seconds * 1000 < millis(F.current_timestamp() if now is None else now)


def month_of(c: Column) -> Column:
    """1 to 12 of an English month name or its first three letters; null for others."""
    out = F.lit(None).cast("int")
    for i, m in enumerate(MONTHS):
        out = F.when(F.lower(F.trim(c)).isin(m, m[:3]), F.lit(i + 1)).otherwise(out)
    return out


def of(year, month=1, day=1, hour=0, minute=0, second=0) -> Column:
    return F.make_timestamp(*[x if isinstance(x, Column) else F.lit(x) for x in (year, month, day, hour, minute, second)])


def shape(pattern: str) -> str:
    """A regular expression that every text of the pattern matches: runs of digits, names, and the marks between them.

    It rules out most others for a small part of what trying the pattern on them costs.
    """

    def part(found: re.Match) -> str:
        token = found.group()
        if token[0] == "'":
            return re.escape(token[1:-1])
        if token[0] == "X":
            return r"(Z|[+-][\d:]+)"
        if token == "a" or token.startswith("MMM"):
            return r"\D+"
        return r"[+-]?\d+" if token[0].isalpha() else {"[": "(", "]": ")?"}.get(token, re.escape(token))

    whole = re.sub(r"yyyyMMdd|'[^']*'|([A-Za-z])\1*|[^A-Za-z']", part, pattern)
    return f"(?is)^{whole}$"


def parse(c: Column, day_first: bool = False) -> Column:
    """A time out of text: epoch seconds or milliseconds, ISO and other usual shapes; null if none fits.

    A zone name or offset after a space holds for the time before it; without one it is the session's.
    """
    return _let(c, lambda t: _parsed(t, day_first))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is worked out once a row however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _parsed(c: Column, day_first: bool) -> Column:
    # weekday names say nothing more; a T between digits parts date and time
    named = F.regexp_replace(F.trim(c), r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    order = (*DAY_FIRST, *MONTH_FIRST) if day_first else (*MONTH_FIRST, *DAY_FIRST)

    def read(s: Column) -> Column:
        digits = s.rlike(r"^-?\d{9,}$") | s.rlike(r"^-?\d{1,7}$")
        n = F.when(digits, s).cast("bigint")
        epoch = _let(n, lambda n: F.when(F.abs(n) >= MILLIS_FROM, F.timestamp_millis(n)).otherwise(F.timestamp_millis(n * 1000)))
        zone = F.regexp_replace(F.regexp_extract(s, ZONE, 1), r"^([+-]\d\d):?(\d\d)$", "$1:$2")
        return F.when(digits, epoch).otherwise(_let(F.struct(zone.alias("zone"), F.regexp_replace(s, ZONE, "").alias("rest")), lambda x: timed(x["zone"], x["rest"])))

    def timed(zone: Column, rest: Column) -> Column:
        texts = F.struct(rest.alias("rest"), F.regexp_replace(rest, r"(\d)T(?=\d)", "$1 ").alias("spaced"))
        shaped = _let(texts, lambda x: F.coalesce(*[tried(x["rest"] if "'T'" in p else x["spaced"], p) for p in (*PATTERNS, *order)]))
        zoned = lambda at: F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), zone).try_cast("timestamp")
        return _let(shaped, lambda at: F.when(zone == "", at).otherwise(zoned(at)))

    def tried(text: Column, p: str) -> Column:
        return F.when(text.rlike(shape(p)), F.try_to_timestamp(text, F.lit(p)))

    return _let(named, read)
