"""Timestamp columns, UTC, with milliseconds. Session time zone is UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def instant(t: Column) -> Column:
    """A timestamp of either kind as an instant."""
    return t.cast("timestamp")


def add_milliseconds(t: Column, n) -> Column:
    return F.timestamp_micros(F.unix_micros(instant(t)) + _col(n).cast("long") * 1000)


def duration_milliseconds(a: Column, b: Column) -> Column:
    """a - b in whole milliseconds, towards zero, by integers."""
    d = F.unix_micros(instant(a)) - F.unix_micros(instant(b))
    return F.call_function("div", d, F.lit(1000).cast("long"))


def year(t: Column) -> Column:
    return F.year(t).cast("long")


def month(t: Column) -> Column:
    return F.month(t).cast("long")


def day_of_month(t: Column) -> Column:
    return F.dayofmonth(t).cast("long")


def hour(t: Column) -> Column:
    return F.hour(t).cast("long")


def minute(t: Column) -> Column:
    return F.minute(t).cast("long")


def second(t: Column) -> Column:
    return F.second(t).cast("long")


def millisecond(t: Column) -> Column:
    return F.pmod(F.call_function("div", F.unix_micros(instant(t)) - F.pmod(F.unix_micros(instant(t)), F.lit(1000)), F.lit(1000).cast("long")), F.lit(1000)).cast("long")


def day_of_week(t: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return (F.weekday(t) + 1).cast("long")


def to_epoch_milliseconds(t: Column) -> Column:
    """Milliseconds since 1970, towards zero."""
    return F.call_function("div", F.unix_micros(instant(t)), F.lit(1000).cast("long"))


def from_epoch_milliseconds(n: Column) -> Column:
    return F.timestamp_millis(n.cast("long"))


def from_components(y, mo, d, h, mi, s, ms) -> Column:
    whole = F.make_timestamp(*(_col(x).cast("int") for x in (y, mo, d, h, mi)), _col(s).cast("int"))
    return add_milliseconds(whole, ms)


#: Format tokens and the pattern letters that mean the same. Fixed values.
TOKENS = {
    "YYYY": "yyyy",
    "YY": "yy",
    "MMMM": "MMMM",
    "MMM": "MMM",
    "MM": "MM",
    "M": "M",
    "DD": "dd",
    "D": "d",
    "dddd": "EEEE",
    "ddd": "EEE",
    "dd": "EEE",
    "HH": "HH",
    "H": "H",
    "hh": "hh",
    "h": "h",
    "mm": "mm",
    "m": "m",
    "ss": "ss",
    "s": "s",
    "SSS": "SSS",
    "A": "a",
    "a": "a",
}
_TOKEN = re.compile("|".join(sorted(TOKENS, key=len, reverse=True)) + r"|\\(.)|(.)", re.S)


def _parts(tokens: str) -> list[tuple[str, bool]]:
    """Tokens and, marked, other characters, which stand for themselves; a backslash makes the next character one of them."""
    return [(m[1] or m[2], True) if (m[1] or m[2]) else (m[0], False) for m in _TOKEN.finditer(tokens)]


def spark_pattern(tokens: str) -> str:
    """A format of tokens as a Spark pattern, for parsing."""
    out, plain = [], ""
    for text, literal in [*_parts(tokens), ("", False)]:
        if literal:
            plain += text.replace("'", "''")
            continue
        if plain:
            out.append(f"'{plain}'" if any(c.isalpha() for c in plain) else plain)
            plain = ""
        out.append(TOKENS.get(text, ""))
    return "".join(out)


def print_format(t: Column, tokens: str) -> Column:
    """A timestamp by format tokens; dd is a weekday's first two letters, a is am or pm."""
    parts = []
    for text, literal in _parts(tokens):
        if literal:
            parts.append(F.lit(text))
            continue
        shown = F.date_format(t, TOKENS[text])
        parts.append(F.substring(shown, 1, 2) if text == "dd" else F.lower(shown) if text == "a" else shown)
    return F.concat(*parts) if parts else F.lit("")


def parse_format(s: Column, tokens: str) -> Column:
    """The instant that a text says in UTC; a text that doesn't fit is an error."""
    return F.to_timestamp(s, spark_pattern(tokens))


def time_zone_offset(t: Column, zone: str) -> Column:
    """Minutes that a zone's clocks are ahead of UTC at an instant."""
    local = F.from_utc_timestamp(instant(t), zone)
    return F.call_function("div", F.unix_micros(local) - F.unix_micros(instant(t)), F.lit(60_000_000).cast("long"))


def now_milliseconds() -> Column:
    return F.unix_millis(F.current_timestamp())
