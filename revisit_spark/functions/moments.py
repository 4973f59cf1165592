"""Dates and times as they are written, as columns: ISO 8601, day and month in either order, month names, and given formats."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO dates: calendar and week dates with and without signs; a digit after a week date's sign is an hour if two stand there.
_DATE = r"\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d(?!\d))?|\d{4}W\d{2}\d?"
_TIME = r"\d{2}(?:(?::\d{2}){0,2}|(?:\d{2}){0,2})(?:[.,]\d+)?"
#: A date, any sign but a digit, a time, and what it is ahead of UTC.
ISO = rf"^({_DATE})(?:[^\d]({_TIME})(?: ?([+-])({_TIME}))?)?$"
#: Those that Spark's own cast reads.
_PLAIN = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?$"
_SLASHED = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})$"
_NAMED = ((r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"), (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"), (r"^[A-Za-z]{4,9} \d{1,2} \d{4}$", "MMMM d yyyy"))
_AHEAD = r"\s*(Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)$"
#: Directives of formats that begin with a percent sign, as letters of Spark's formats.
_DIRECTIVES = {"d": "d", "m": "M", "Y": "yyyy", "y": "yy", "H": "H", "I": "h", "M": "m", "S": "s", "f": "SSSSSS", "b": "MMM", "B": "MMMM", "p": "a", "j": "D"}
_NUMBERS = set("dmHIMSj")


@cache
def spark_format(format: str) -> tuple[str, bool]:
    """A format as Spark writes it, and whether an offset follows at its end.

    One with percent signs is translated (``%d/%m/%Y``), others are Spark's own already. Numbers may have one digit
    or two, but two where the next number follows at once.
    """
    if "%" not in format:
        return format, False
    ahead = format.endswith("%z")
    body = format.removesuffix("%z").rstrip() if ahead else format
    parts = re.findall(r"%(.)|([^%]+)", body, re.S)
    if "".join(f"%{d}" if d else t for d, t in parts) != body:
        raise ValueError(f"a lone percent sign: {format}")
    out = []
    for i, (d, text) in enumerate(parts):
        if d and d != "%" and d not in _DIRECTIVES:
            raise ValueError(f"no such directive: %{d}")
        number = lambda k: 0 <= k < len(parts) and parts[k][0] in _NUMBERS | {"Y", "y", "f"}  # noqa: B023, E731
        if d in _NUMBERS and (number(i - 1) or number(i + 1)):
            out.append(_DIRECTIVES[d] * (3 if d == "j" else 2))
        elif d and d != "%":
            out.append(_DIRECTIVES[d])
        else:
            out.append(re.sub(r"[A-Za-z'\[\]{}#]+", lambda m: "'" + m[0].replace("'", "''") + "'", text or "%"))
    return "".join(out), ahead


def _day(date: Column) -> Column:
    """The day of an ISO date; null where there is no such day or week."""
    bare = F.replace(date, F.lit("-"), F.lit(""))
    year = F.substring(bare, 1, 4)
    dated = F.when(year != "0000", F.concat_ws("-", year, F.substring(bare, 5, 2), F.substring(bare, 7, 2))).try_cast("date")
    week, nth = F.substring(bare, 6, 2).try_cast("int"), F.coalesce(F.nullif(F.substring(bare, 8, 1), F.lit("")), F.lit("1")).try_cast("int")
    fourth = F.when(year != "0000", F.concat(year, F.lit("-01-04"))).try_cast("date")  # is always in the first week
    monday = F.date_add(fourth, 7 * (week - 1) - F.weekday(fourth))
    there = week.between(1, 53) & nth.between(1, 7) & (F.year(F.date_add(monday, 3)).cast("string") == year.cast("int").cast("string"))
    return F.when(F.contains(bare, F.lit("W")), F.when(there, F.date_add(monday, nth - 1))).otherwise(dated)


def _clock(time: Column) -> Column:
    """Hours to seconds of an ISO time as hh:mm:ss.ffffff; further decimals are cut."""
    main, rest = F.replace(F.regexp_extract(time, "^[0-9:]*", 0), F.lit(":"), F.lit("")), F.regexp_extract(time, r"[.,](\d+)$", 1)
    main = F.rpad(main, 6, "0")
    return F.concat(F.substring(main, 1, 2), F.lit(":"), F.substring(main, 3, 2), F.lit(":"), F.substring(main, 5, 2), F.lit("."), F.rpad(F.substring(rest, 1, 6), 6, "0"))


def _seconds(clock: Column) -> Column:
    part = lambda at: F.substring(clock, at, 2).try_cast("int")
    return F.when(clock.try_cast("timestamp_ntz").isNotNull() | ((part(1) < 24) & (part(4) < 60) & (part(7) < 60)), part(1) * 3600 + part(4) * 60 + part(7))


def _struct(naive: Column, ahead: Column | None = None) -> Column:
    return F.struct(naive.cast("timestamp_ntz").alias("naive"), (F.lit(None).cast("int") if ahead is None else ahead).alias("ahead"))


def _iso(value: Column) -> Column:
    group = lambda k: F.regexp_extract(value, ISO, k)
    time, other = group(2), group(4)
    naive = F.concat(_day(group(1)).cast("string"), F.lit(" "), _clock(F.when(time != "", time).otherwise("00"))).try_cast("timestamp_ntz")
    seconds = _seconds(_clock(other))
    ahead = F.when(other != "", F.when(group(3) == "-", -seconds).otherwise(seconds))
    return F.when((other == "") | seconds.isNotNull(), _struct(naive, ahead))


def written(value: Column, order: Column, explicit: str | None = None) -> Column:
    """struct(naive, ahead) of a stripped value: the time as written, and seconds that it is ahead of UTC if it says so.

    With an ``explicit`` format nothing else is tried. Otherwise ISO 8601 (calendar and week dates, with or without
    signs, times down to hours, decimals after a point or a comma, offsets), then day and month in ``order``,
    then month names. Null, or ``naive`` is null, where the value is none of these.
    """
    if explicit:
        pattern, offset = spark_format(explicit)
        body = F.regexp_replace(value, _AHEAD, "") if offset else value
        naive = F.try_to_timestamp(body, F.lit(pattern)).cast("timestamp_ntz")
        if "%y" in explicit:  # 69 to 99 are of the century before
            naive = F.when(F.year(naive) >= 2069, F.timestamp_add("YEAR", F.lit(-100), naive)).otherwise(naive)
        if not offset:
            return _struct(naive)
        sign, digits = F.regexp_extract(value, _AHEAD, 1), F.rpad(F.regexp_replace(F.regexp_extract(value, _AHEAD, 1), "[^0-9]", ""), 6, "0")
        seconds = F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60 + F.substring(digits, 5, 2).try_cast("int")
        return F.when(sign != "", _struct(naive, F.when(sign.startswith("-"), -seconds).otherwise(seconds)))
    zoned = F.replace(value, F.lit("Z"), F.lit("+00:00"))
    first, second, year = (F.regexp_extract(value, _SLASHED, k) for k in (1, 3, 4))
    day, month = F.when(order == "dmy", first).otherwise(second), F.when(order == "dmy", second).otherwise(first)
    slashed = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("timestamp_ntz")
    named = F.coalesce(*(F.try_to_timestamp(F.when(value.rlike(p), F.initcap(value)), F.lit(form)).cast("timestamp_ntz") for p, form in _NAMED))
    plain = F.when(~value.startswith("0000"), value).try_cast("timestamp_ntz")
    return F.when(value.rlike(_PLAIN), _struct(plain)).when(value.rlike(_SLASHED), _struct(slashed)).when(zoned.rlike(ISO), _iso(zoned)).otherwise(_struct(named))
