"""Binary columns, hashes and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def size(b: Column) -> Column:
    return F.octet_length(b).cast("long")


def get_uint8(b: Column, i) -> Column:
    """Byte i as 0..255; an index outside is an error."""
    i = _col(i).cast("int")
    byte = F.conv(F.hex(F.substring(b, i + 1, F.lit(1))), 16, 10).cast("long")
    return F.when((i >= 0) & (i < F.octet_length(b)), byte).otherwise(F.raise_error(F.lit("blob index out of range")).cast("long"))


def encode_utf8(s: Column) -> Column:
    return F.encode(s, "UTF-8")


def decode_utf8(b: Column) -> Column:
    """Text of UTF-8 bytes; other bytes are an error."""
    return F.validate_utf8(b.cast("string"))


def encode_utf16(s: Column) -> Column:
    """UTF-16, low byte first, with its mark."""
    return F.concat(F.unhex(F.lit("FFFE")), F.encode(s, "UTF-16LE"))


def decode_utf16(b: Column) -> Column:
    """Text of UTF-16 bytes by their mark; without one, low byte first."""
    mark = F.hex(F.substring(b, 1, 2))
    body = F.substring(b, F.lit(3), F.octet_length(b))
    return F.when(mark == "FFFE", F.decode(body, "UTF-16LE")).when(mark == "FEFF", F.decode(body, "UTF-16BE")).otherwise(F.decode(b, "UTF-16LE"))


def sha256_text(s: Column) -> Column:
    return F.sha2(s, 256)


def sha256_bytes(b: Column) -> Column:
    return F.unhex(F.sha2(b, 256))


def uuid() -> Column:
    return F.expr("uuid()")


def random_bytes(n: int) -> Column:
    """n random bytes, hex by hex from random UUIDs' free digits."""
    digits = [F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 12) for _ in range(-(-n // 6))]
    return F.substring(F.unhex(F.concat(*digits)), 1, n) if n else F.unhex(F.lit(""))


def path_join(*parts) -> Column:
    """Parts joined by / and made plain: no empty parts, no ".", no ".." that has something before it."""
    joined = F.array_join(F.filter(F.array(*map(_col, parts)), lambda p: p != ""), "/")
    rooted = F.startswith(joined, F.lit("/"))
    steps = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((p == "..") & rooted, acc).otherwise(F.array_append(acc, p))
    plain = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/")
    return F.when(rooted, F.concat(F.lit("/"), plain)).when(plain == "", F.lit(".")).otherwise(plain)


def path_resolve(path, base: str) -> Column:
    """An absolute path, from ``base`` where it isn't one."""
    p = _col(path)
    return F.when(F.startswith(p, F.lit("/")), path_join(p)).otherwise(path_join(F.lit(base), p))


def path_dirname(p: Column) -> Column:
    """What stands before the last /; "." if there is none."""
    p = F.regexp_replace(p, "(?<=.)/+$", "")
    return F.when(~F.contains(p, F.lit("/")), F.lit(".")).otherwise(F.regexp_replace(F.regexp_replace(p, "/[^/]*$", ""), "^$", "/"))


def path_basename(p: Column) -> Column:
    return F.substring_index(F.regexp_replace(p, "(?<=.)/+$", ""), "/", -1)


def path_extname(p: Column) -> Column:
    """The last dot of the last part and what follows; empty if it begins the part."""
    return F.regexp_extract(path_basename(p), r"^.+?(\.[^.]*)$", 1)
