"""Calendar functions on UTC timestamps of millisecond precision, and the text grammar of moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]*)?"
_OFFSET = r"(?:Z|[+-](?:[01][0-9]|2[0-3]):?[0-5][0-9])?"


def moment_pattern(group: int = 1) -> str:
    """The grammar of moments as a Java regular expression; its two groups hold the separators and count from `group`."""
    year_first = rf"[0-9]{{4}}([-/])[0-9]{{2}}\{group}[0-9]{{2}}"
    year_last = rf"[0-9]{{1,2}}([-/])[0-9]{{1,2}}\{group + 1}[0-9]{{4}}"
    return rf"(?:{year_first}|{year_last})(?:[T ]{_CLOCK}{_OFFSET})?"


DAY_MS = 86_400_000


def parse_moment_ms(text: Column, dayfirst: bool = True) -> Column:
    """Epoch milliseconds (UTC) of a moment written as text; NULL where it is none.

    A date is `YYYY-MM-DD` or, with one or two digits each, `D-M-YYYY` (day
    first, or month first); `/` serves as well as `-`, but not both in one
    date. A time `HH:MM:SS` may follow after `T` or a blank, with a fraction
    (cut after milliseconds) and `Z` or an offset `+HH:MM`, `+HHMM`. Without an
    offset the moment is UTC. Null, empty, blank-padded texts and impossible
    dates give NULL.
    """
    # Spark's own parser reads the common spellings; it takes offsets up to 17:59 and needs one where the session's zone shall not count
    near = r"[+-](?:0[0-9]|1[0-7]):?[0-5][0-9]"
    iso_day = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    other_day = r"^(?:([0-9]{4})/([0-9]{2})/([0-9]{2})|([0-9]{1,2})([-/])([0-9]{1,2})\5([0-9]{4}))"
    turned = "$1$7-$2$6-$3$4" if dayfirst else "$1$7-$2$4-$3$6"
    iso_text = F.regexp_replace(text, other_day, turned)
    read = lambda t: F.unix_millis(t.try_cast("timestamp"))
    as_utc = lambda t: read(F.concat(t, F.lit("Z")))
    return (
        F.when(text.rlike(rf"{iso_day}[T ]{_CLOCK}(?:Z|{near})\z"), read(text))
        .when(text.rlike(rf"{iso_day}[T ]{_CLOCK}\z"), as_utc(text))
        .when(text.rlike(rf"{other_day}[T ]{_CLOCK}\z"), as_utc(iso_text))
        .when(text.rlike(rf"{other_day}[T ]{_CLOCK}(?:Z|{near})\z"), read(iso_text))
        .when(text.rlike(rf"^{moment_pattern()}\z"), _far_or_bare_ms(iso_text))
    )


def _far_or_bare_ms(iso_text: Column) -> Column:
    """Epoch milliseconds of a date alone, or of a moment with an offset of 18 hours and more, its date year first with dashes."""
    zone = r"([+-])([0-9]{2}):?([0-9]{2})\z"
    minutes = F.regexp_extract(iso_text, zone, 2).try_cast("int") * 60 + F.regexp_extract(iso_text, zone, 3).try_cast("int")
    offset = F.when(F.regexp_extract(iso_text, zone, 1) == "-", -minutes).otherwise(minutes)
    local = F.concat(F.regexp_replace(iso_text, zone, ""), F.lit("Z"))
    bare = F.concat(iso_text, F.lit("T00:00:00Z"))
    return F.when(iso_text.contains(":"), F.unix_millis(local.try_cast("timestamp")) - offset.cast("long") * 60_000).otherwise(F.unix_millis(bare.try_cast("timestamp")))


# parts of a moment, as 64-bit numbers


def year(t: Column) -> Column:
    return F.year(t).cast("long")


def month(t: Column) -> Column:
    return F.month(t).cast("long")


def day(t: Column) -> Column:
    return F.dayofmonth(t).cast("long")


def hour(t: Column) -> Column:
    return F.hour(t).cast("long")


def minute(t: Column) -> Column:
    return F.minute(t).cast("long")


def second(t: Column) -> Column:
    return F.second(t).cast("long")


def ms(t: Column) -> Column:
    return F.pmod(F.unix_millis(t), F.lit(1000)).cast("long")


def weekday(t: Column) -> Column:
    """0 is Monday."""
    return F.weekday(t).cast("long")


def yearday(t: Column) -> Column:
    return F.dayofyear(t).cast("long")


def quarter(t: Column) -> Column:
    return F.quarter(t).cast("long")


def week(t: Column, january_as_53: bool = False) -> Column:
    """ISO week; with january_as_53 every January day of the old ISO year is in week 53, even where that year has 52."""
    w = F.weekofyear(t).cast("long")
    return F.when((F.month(t) == 1) & (w >= 52), F.lit(53).cast("long")).otherwise(w) if january_as_53 else w


def iso(t: Column) -> Column:
    """`YYYY-MM-DDTHH:MM:SS.mmmZ`."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


_UNITS = {"s": "SECOND", "m": "MINUTE", "h": "HOUR", "D": "DAY", "W": "WEEK", "M": "MONTH", "Q": "QUARTER", "Y": "YEAR"}
_MONTHS = {"M": 1, "Q": 3, "Y": 12}
_MS = {"s": 1000, "m": 60_000, "h": 3_600_000, "D": DAY_MS, "W": 7 * DAY_MS}


def truncate(t: Column, unit: str) -> Column:
    """Start of the period (s m h D W M Q Y; weeks start on Monday); any other unit gives NULL."""
    return F.date_trunc(_UNITS[unit], t) if unit in _UNITS else F.lit(None).cast("timestamp")


def _next(start: Column, unit: str) -> Column:
    if unit in _MS:
        return F.timestamp_millis(F.unix_millis(start) + _MS[unit])
    return F.add_months(start.cast("date"), _MONTHS[unit]).cast("timestamp")


def ceil(t: Column, unit: str) -> Column:
    """Start of the next period, unless t is one."""
    if unit not in _UNITS:
        raise ValueError(f"unit: {unit!r}")
    start = truncate(t, unit)
    return F.when(start == t, t).otherwise(_next(start, unit))


def round_to(t: Column, unit: str) -> Column:
    """Nearest start of a period; halfway goes to the next."""
    if unit not in _UNITS:
        raise ValueError(f"unit: {unit!r}")
    start = truncate(t, unit)
    after = _next(start, unit)
    return F.when(F.unix_millis(t) - F.unix_millis(start) < F.unix_millis(after) - F.unix_millis(t), start).otherwise(after)


def normalize(t: Column) -> Column:
    return truncate(t, "D")


def add_ms(t: Column, n: int | Column) -> Column:
    return F.timestamp_millis(F.unix_millis(t) + n)


def add_seconds(t: Column, n: int) -> Column:
    return add_ms(t, n * 1000)


def add_minutes(t: Column, n: int) -> Column:
    return add_ms(t, n * 60_000)


def add_hours(t: Column, n: int) -> Column:
    return add_ms(t, n * 3_600_000)


def add_days(t: Column, n: int) -> Column:
    return add_ms(t, n * DAY_MS)


def is_month_start(t: Column) -> Column:
    return F.dayofmonth(t) == 1


def is_month_end(t: Column) -> Column:
    return F.dayofmonth(t) == F.dayofmonth(F.last_day(t))


def is_quarter_start(t: Column) -> Column:
    return is_month_start(t) & (F.month(t) % 3 == 1)


def is_quarter_end(t: Column) -> Column:
    return is_month_end(t) & (F.month(t) % 3 == 0)


def is_year_start(t: Column) -> Column:
    return F.dayofyear(t) == 1


def is_year_end(t: Column) -> Column:
    return (F.month(t) == 12) & (F.dayofmonth(t) == 31)


def is_leap_year(t: Column) -> Column:
    y = F.year(t)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def days_in_month(t: Column) -> Column:
    return F.dayofmonth(F.last_day(t)).cast("long")


def month_name(t: Column) -> Column:
    return F.date_format(t, "MMMM")


def day_name(t: Column) -> Column:
    return F.date_format(t, "EEEE")


# C format codes and Spark's patterns for them
_CODES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "I": "hh", "p": "a", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE"}


def strftime(t: Column, pattern: str) -> Column:
    """Formatted by C codes (%Y %y %m %d %H %M %S %j %I %p %B %b %A %a %%); unknown codes stay as they are."""
    parts, i, plain = [], 0, ""
    while i < len(pattern):
        code = pattern[i + 1] if pattern[i] == "%" and i + 1 < len(pattern) else ""
        if code in _CODES:
            if plain:
                parts.append(F.lit(plain))
                plain = ""
            parts.append(F.date_format(t, _CODES[code]))
            i += 2
        elif code == "%":
            plain, i = plain + "%", i + 2
        else:
            plain, i = plain + pattern[i], i + 1
    if plain:
        parts.append(F.lit(plain))
    return F.when(t.isNotNull(), F.concat(*parts) if parts else F.lit(""))


def from_parts(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, millis: Column) -> Column:
    """A moment from its parts; NULL where they are none."""
    date = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(mo.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")
    good = h.between(0, 23) & mi.between(0, 59) & s.between(0, 59) & millis.between(0, 999)
    return F.when(good & date.isNotNull(), F.timestamp_millis(F.unix_date(date).cast("long") * DAY_MS + h * 3_600_000 + mi * 60_000 + s * 1000 + millis))
