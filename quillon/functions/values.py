"""Column types as lenses on text: recognisers, null spellings, formats.

Data stays text; a type only says how a text is read. Every recogniser comes twice, as a Column expression for the
cluster and as a Python function for literals, and both are stricter than Spark's casts: a guard decides what is
accepted, a cast only converts.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels in the order in which inference tries them.
TYPES = ("bool", "i64", "f64", "date", "datetime", "enum", "str")
#: Exact spellings of null.
NULLS = ("", "NULL", "null", "NA", "N/A", "\\N")
TRUE, FALSE = ("true", "yes", "1"), ("false", "no", "0")
DAY_US = 86_400_000_000

INT = r"[+-]?[0-9]+"
FLOAT = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
DATETIME = rf"({DATE})[T ]([01][0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9])(?:\.([0-9]{{1,9}}))?)?(?:(Z)|([+-])([01][0-9]|2[0-3]):?([0-5][0-9]))?"


def whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def is_string(label: str) -> bool:
    return label in ("str", "enum")


# Columns ---------------------------------------------------------------------------------------------------------


def as_bool(t: Column) -> Column:
    low = F.lower(t)
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def as_i64(t: Column) -> Column:
    return F.when(t.rlike(whole(INT)), F.regexp_replace(t, r"\A\+", "").try_cast("bigint"))


def as_f64(t: Column) -> Column:
    return F.when(t.rlike(whole(FLOAT)), t.try_cast("double"))


def as_date(t: Column) -> Column:
    return F.when(t.rlike(whole(DATE)), t.try_cast("date"))


def as_datetime(t: Column) -> Column:
    part = lambda i: F.regexp_extract(t, whole(DATETIME), i)
    number = lambda i: F.coalesce(part(i).try_cast("bigint"), F.lit(0).cast("bigint"))
    micros = F.coalesce(F.rpad(part(5), 6, "0").try_cast("bigint"), F.lit(0).cast("bigint"))
    offset = F.when(part(7) == "-", -1).otherwise(1) * (number(8) * 60 + number(9)) * 60
    seconds = F.unix_date(part(1).try_cast("date")).cast("bigint") * 86400 + number(2) * 3600 + number(3) * 60 + number(4) - offset
    return F.when(t.rlike(whole(DATETIME)), F.timestamp_micros(seconds * 1_000_000 + micros))


RECOGNISERS = {"bool": as_bool, "i64": as_i64, "f64": as_f64, "date": as_date, "datetime": as_datetime}
#: The Spark type that a recogniser gives.
SPARK = {"bool": "boolean", "i64": "bigint", "f64": "double", "date": "date", "datetime": "timestamp", "enum": "string", "str": "string"}


def recognise(t: Column, label: str) -> Column:
    """The typed value of a text, null if it isn't of the type."""
    return t if is_string(label) else RECOGNISERS[label](t)


def type_of_spark(name: str) -> str:
    """The label of a Spark type: how a typed table's column is read."""
    if name in ("tinyint", "smallint", "int", "bigint"):
        return "i64"
    return {"float": "f64", "double": "f64", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime", "boolean": "bool"}.get(name, "str")


def format_datetime(v: Column) -> Column:
    """UTC, fraction without trailing zeros, ``Z``."""
    text = F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""), F.lit("Z"))


def format_date(v: Column) -> Column:
    return F.date_format(v, "yyyy-MM-dd")


# Python, for literals --------------------------------------------------------------------------------------------


def parse_bool(s: str) -> bool | None:
    s = s.lower() if s.isascii() else ""
    return True if s in TRUE else False if s in FALSE else None


def parse_i64(s: str) -> int | None:
    if not re.fullmatch(INT, s):
        return None
    n = int(s)
    return n if -(2**63) <= n < 2**63 else None


def parse_f64(s: str) -> float | None:
    return float(s) + 0.0 if re.fullmatch(FLOAT, s) else None


def is_leap_year(y: int) -> bool:
    return y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)


def days_in_month(y: int, m: int) -> int:
    return 29 if m == 2 and is_leap_year(y) else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01; Gregorian, any year (year 0 is shifted by one 400-year cycle)."""
    return date(y + 400 if y < 1 else y, m, d).toordinal() - (146_097 if y < 1 else 0) - 719_163


def civil_from_days(n: int) -> tuple[int, int, int]:
    ordinal = n + 719_163
    if ordinal < 1:
        x = date.fromordinal(ordinal + 146_097)
        return x.year - 400, x.month, x.day
    x = date.fromordinal(ordinal)
    return x.year, x.month, x.day


def parse_date(s: str) -> int | None:
    """Days since 1970-01-01."""
    if not re.fullmatch(DATE, s):
        return None
    y, m, d = map(int, s.split("-"))
    return days_from_civil(y, m, d) if 1 <= m <= 12 and 1 <= d <= days_in_month(y, m) else None


def parse_datetime(s: str) -> int | None:
    """Microseconds since 1970-01-01T00:00Z."""
    found = re.fullmatch(DATETIME, s)
    if not found or (days := parse_date(found[1])) is None:
        return None
    offset = (int(found[8] or 0) * 60 + int(found[9] or 0)) * (-1 if found[7] == "-" else 1)
    seconds = int(found[2]) * 3600 + int(found[3]) * 60 + int(found[4] or 0) - offset * 60
    return days * DAY_US + seconds * 1_000_000 + int((found[5] or "").ljust(6, "0")[:6])


def spell_date(days: int) -> str:
    y, m, d = civil_from_days(days)
    return f"{y:04}-{m:02}-{d:02}"


def spell_datetime(us: int) -> str:
    days, rest = divmod(us, DAY_US)
    seconds, micros = divmod(rest, 1_000_000)
    fraction = f".{micros:06}".rstrip("0") if micros else ""
    return f"{spell_date(days)}T{seconds // 3600:02}:{seconds // 60 % 60:02}:{seconds % 60:02}{fraction}Z"
