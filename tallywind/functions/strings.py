"""String functions: lengths, slices and padding count bytes, case is ASCII; NULL propagates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = " \t\n\x0b\x0c\r"


def length(s: Column) -> Column:
    """Number of bytes."""
    return F.octet_length(s).cast("long")


def lower(s: Column) -> Column:
    return F.translate(s, _UP, _LOW)


def upper(s: Column) -> Column:
    return F.translate(s, _LOW, _UP)


def swapcase(s: Column) -> Column:
    return F.translate(s, _LOW + _UP, _UP + _LOW)


def capitalize(s: Column) -> Column:
    return F.concat(upper(F.substring(s, 1, 1)), lower(F.substring(s, 2, 2**31 - 1)))


def title(s: Column) -> Column:
    """A letter in upper case after anything that is no ASCII letter, else in lower case."""
    # runs of letters, each behind its own prefix of other characters
    parts = F.regexp_extract_all(s, F.lit(r"([^A-Za-z]*)([A-Za-z]*)"), 0)
    head = lambda p: F.regexp_extract(p, r"^[^A-Za-z]*", 0)
    tail = lambda p: F.regexp_extract(p, r"[A-Za-z]*\z", 0)
    return F.array_join(F.transform(parts, lambda p: F.concat(head(p), capitalize(tail(p)))), "")


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(_SPACE))


def contains(s: Column, part: str) -> Column:
    return F.contains(s, F.lit(part))


def startswith(s: Column, part: str) -> Column:
    return F.startswith(s, F.lit(part))


def endswith(s: Column, part: str) -> Column:
    return F.endswith(s, F.lit(part))


def replace(s: Column, old: str, new: str) -> Column:
    """All literal occurrences; an empty `old` changes nothing."""
    return F.replace(s, F.lit(old), F.lit(new)) if old else s


def find(s: Column, part: str) -> Column:
    """Byte position of the first occurrence, from 1; 0 if there is none."""
    at = F.locate(part, s)
    return F.when(at == 0, F.lit(0).cast("long")).otherwise(F.octet_length(F.substring(s, F.lit(1), at - 1)).cast("long") + 1) if part else F.when(s.isNotNull(), F.lit(1).cast("long"))


def slice_bytes(s: Column, start: int, stop: int | None = None) -> Column:
    """Bytes start..stop, from 1 and inclusive; negative positions count from the end."""
    n = F.octet_length(s)
    lo = F.lit(max(start, 1)) if start >= 0 else F.greatest(n + start + 1, F.lit(1))
    hi = n if stop is None else F.least(F.lit(stop), n) if stop >= 0 else n + stop + 1
    return F.when(hi >= lo, F.substring(s.cast("binary"), lo, hi - lo + 1).cast("string")).otherwise(F.when(s.isNotNull(), F.lit("")))


def pad(s: Column, width: int, side: str = "left", fill: str = " ") -> Column:
    """Filled up to `width` bytes, never cut; with `both` the smaller half goes left."""
    if len(fill.encode()) != 1:
        raise ValueError("the fill is one byte")
    if side not in ("left", "right", "both"):
        raise ValueError(f"side: {side!r}")
    gap = F.greatest(F.lit(width) - F.octet_length(s), F.lit(0))
    left = {"left": gap, "right": F.lit(0), "both": F.floor(gap / 2).cast("int")}[side]
    return F.concat(F.repeat(F.lit(fill), left), s, F.repeat(F.lit(fill), (gap - left).cast("int")))


def zfill(s: Column, width: int) -> Column:
    """Zeros on the left; a sign stays where it is, behind them."""
    return pad(s, width, "left", "0")


def rep(s: Column, n: int, sep: str = "") -> Column:
    return F.repeat(s, n) if not sep else F.when(s.isNotNull(), F.array_join(F.array_repeat(s, n), sep))


def count(s: Column, part: str) -> Column:
    """Occurrences that do not overlap."""
    if not part:
        raise ValueError("an empty text occurs everywhere")
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("long")


def split(s: Column, sep: str, max_splits: int = 0) -> Column:
    """Array of the parts between literal separators, at most max_splits cuts (0: all)."""
    if not sep:
        raise ValueError("empty separator")
    return F.split(s, "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E", max_splits + 1 if max_splits > 0 else -1)


def isdigit(s: Column) -> Column:
    return s.rlike(r"^[0-9]+\z")


def isalpha(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z]+\z")


def isalnum(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z0-9]+\z")


def isspace(s: Column) -> Column:
    return s.rlike(r"^[ \t\n\x0b\f\r]+\z")


def islower(s: Column) -> Column:
    return s.rlike("[a-z]") & ~s.rlike("[A-Z]")


def isupper(s: Column) -> Column:
    return s.rlike("[A-Z]") & ~s.rlike("[a-z]")


def removeprefix(s: Column, part: str) -> Column:
    return F.when(F.startswith(s, F.lit(part)), F.substring(s, len(part) + 1, 2**31 - 1)).otherwise(s) if part else s


def removesuffix(s: Column, part: str) -> Column:
    return F.when(F.endswith(s, F.lit(part)), F.substring(s, F.lit(1), F.length(s) - len(part))).otherwise(s) if part else s


def join_rows(s: Column, order: Column, sep: str = "") -> Column:
    """Aggregate: all present texts in row order, as one text."""
    rows = F.array_sort(F.collect_list(F.when(s.isNotNull(), F.struct(order.alias("o"), s.alias("s")))))
    return F.array_join(F.transform(rows, lambda r: r.s), sep)
