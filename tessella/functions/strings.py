"""String columns: code points, 0-based positions, literal needles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def concat(a: Column, b) -> Column:
    return F.concat(a, _col(b))


def repeat(s: Column, n) -> Column:
    return F.repeat(s, _col(n).cast("int"))


def length(s: Column) -> Column:
    return F.length(s).cast("long")


def substring(s: Column, start, end) -> Column:
    """Code points start..end-1, bounds clamped; empty if start is not before end."""
    n = F.length(s)
    clamp = lambda i: F.least(F.greatest(i, F.lit(0)), n)
    lo, hi = clamp(_col(start)), clamp(_col(end))
    return F.substring(s, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))


def index_of(s: Column, needle) -> Column:
    """Where needle first stands, or -1."""
    return (F.locate(needle, s) - 1 if isinstance(needle, str) else F.position(needle, s) - 1).cast("long")


def split(s: Column, delimiter: str) -> Column:
    """Parts between literal delimiters; an empty delimiter gives the code points."""
    if delimiter == "":
        return F.when(s == "", F.array(F.lit(""))).otherwise(F.filter(F.split(s, ""), lambda c: c != ""))
    return F.split(s, r"\Q" + delimiter.replace(r"\E", r"\E\\E\Q") + r"\E", -1)


def trim_start(s: Column) -> Column:
    """Without leading white space, all of Unicode's."""
    return F.regexp_replace(s, r"(?U)^[\s\x1c-\x1f]+", "")


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)[\s\x1c-\x1f]+$(?![\r\n])", "")


def trim(s: Column) -> Column:
    return trim_end(trim_start(s))


def lower_case(s: Column) -> Column:
    return F.lower(s)


def upper_case(s: Column) -> Column:
    return F.upper(s)


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def starts_with(s: Column, p) -> Column:
    return F.startswith(s, _col(p))


def ends_with(s: Column, p) -> Column:
    return F.endswith(s, _col(p))


def contains(s: Column, p) -> Column:
    return F.contains(s, _col(p))


def _pattern(pattern: str, flags: str) -> str:
    unknown = set(flags) - set("gims")
    if unknown:
        raise ValueError(f"unknown regex flags: {sorted(unknown)}")
    on = "".join(f for f in "ims" if f in flags)
    return f"(?{on}){pattern}" if on else pattern


def regex_contains(s: Column, pattern: str, flags: str = "") -> Column:
    return s.rlike(_pattern(pattern, flags))


def regex_index_of(s: Column, pattern: str, flags: str = "") -> Column:
    """Where the first match begins, or -1."""
    return (F.regexp_instr(s, F.lit(_pattern(pattern, flags))) - 1).cast("long")


_REPLACEMENT = re.compile(r"\$(?:(\$)|(&)|(\d{1,2})|<([A-Za-z][A-Za-z0-9]*)>)|([\\$])")


def java_replacement(replacement: str) -> str:
    """A replacement of JavaScript's syntax ($1, $&, $<name>, $$) in Java's."""

    def one(m: re.Match) -> str:
        if m[1]:
            return r"\$"
        if m[2]:
            return "$0"
        if m[3]:
            return f"${m[3]}"
        if m[4]:
            return f"${{{m[4]}}}"
        return "\\" + m[5]

    if "$`" in replacement or "$'" in replacement:
        raise ValueError("text before or after the match cannot be named in a replacement here")
    return _REPLACEMENT.sub(one, replacement)


def regex_replace(s: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """All matches replaced; the replacement is in JavaScript's syntax."""
    return F.regexp_replace(s, _pattern(pattern, flags), java_replacement(replacement))


def print_error(message: Column, frames: Column) -> Column:
    """The message, and the numbered frames of an array of struct(file, line, column)."""
    lines = F.transform(frames, lambda f, i: F.concat(F.lit("\n  "), (i + 1).cast("string"), F.lit(". "), f["file"], F.lit(" "), f["line"].cast("string"), F.lit(":"), f["column"].cast("string")))
    return F.concat(F.lit("Error: "), message, F.array_join(lines, ""))
