"""Cell normalization as columns. Each function returns struct(value, issues); issues carry code, severity and message."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import moments

ISSUE = "struct<code:string,severity:string,message:string,field:string,raw_value:string>"
ISSUES = f"array<{ISSUE}>"
MARKER = "… [truncated]"
MAX_BYTES = 32 * 1024
#: Words for truth, falsehood and absent amounts.
TRUE_WORDS = ("y", "yes", "true", "t", "1", "x", "warranty")
FALSE_WORDS = ("n", "no", "false", "f", "0", "")
NO_AMOUNT = ("", "-", "n/a", "na", "null")
#: All characters that are white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Every issue code (fixed values) with what it tells people.
MESSAGES = {
    "MISSING_REQUIRED_FIELD": "A required value is missing.",
    "INVALID_DATE": "This is no date or time in a known form.",
    "AMBIGUOUS_DATE_FORMAT": "Day and month can't be told apart; state the date format.",
    "DATE_OUT_OF_RANGE": "The date is before 1990 or more than a year ahead.",
    "UNRESOLVABLE_CUSTOMER": "There is no id, phone or name to know the customer by.",
    "INVALID_NUMBER": "This is no number in a known form, or it is too large.",
    "NUMBER_ROUNDED": "The amount was rounded to two decimals.",
    "NEGATIVE_AMOUNT": "The amount is below zero.",
    "TOO_MANY_COLUMNS": "The row has more fields than there are columns.",
    "TOO_FEW_COLUMNS": "The row has fewer fields than there are columns.",
    "FIELD_TOO_LONG": "The text is too long and is cut when it is imported.",
    "UNKNOWN_ENUM_VALUE": "The value is none of those known; the default is used.",
    "DUPLICATE_ROW_IN_FILE": "An earlier row of the file is the same.",
    "POSSIBLE_DUPLICATE": "A job with the same customer, date and text is there already.",
    "ENCODING_UNCERTAIN": "The file's encoding is a guess.",
    "ENCODING_REPLACEMENT": "Bytes that could not be read were replaced.",
    "DELIMITER_UNCERTAIN": "The file's delimiter is a guess.",
    "EQUIPMENT_NOT_RESOLVED": "Nothing tells the equipment; the job is linked to none.",
    "ROW_SKIPPED_BY_FILTER": "A filter of the mapping skips this row.",
}


_OTHER_DIGITS = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.decimal(c, None) is not None]
_DIGITS = "".join(_OTHER_DIGITS), "".join(str(unicodedata.decimal(c)) for c in _OTHER_DIGITS)


def stripped(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(x, F.lit(WHITE))


def bound(x: Column, f) -> Column:
    """f(x) with x worked out once: expressions that use a value many times stay small."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


class Steps:
    """A parser as a first column and functions that each make the next one of it.

    ``column`` is all of it as one expression; ``parsed`` gives each step of many parsers a projection of its
    own, which Spark plans and compiles much faster.
    """

    def __init__(self, first: Column, *later: Callable[[Column], Column]):
        self.first, self.later = first, later

    def column(self) -> Column:
        out = self.first
        for f in self.later:
            out = bound(out, f)
        return out


def parsed(rows: DataFrame, fields: dict[str, Steps]) -> DataFrame:
    """``rows`` with a column (struct of value and issues) for each of the fields, which must be free names."""
    keep = rows.columns
    out = rows.select(*keep, *(s.first.alias(t) for t, s in fields.items()))
    for k in range(max((len(s.later) for s in fields.values()), default=0)):
        out = out.select(*keep, *((s.later[k](F.col(t)) if k < len(s.later) else F.col(t)).alias(t) for t, s in fields.items()))
    return out


def no_issues() -> Column:
    return F.array().cast(ISSUES)


def issue(code: str, severity: str, field: str | Column | None = None, raw: Column | None = None) -> Column:
    """A struct of ISSUE."""
    raw = F.lit(None).cast("string") if raw is None else raw
    field = field if isinstance(field, Column) else F.lit(field).cast("string")
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(MESSAGES[code]).alias("message"), field.alias("field"), raw.alias("raw_value")).cast(ISSUE)


def issues_of(*found: tuple[Column, Column]) -> Column:
    """The issues whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(when, what) for when, what in found))) if found else no_issues()


def result(value: Column, *issues: tuple[Column, Column]) -> Column:
    """struct(value, issues): each issue with the condition under which it holds."""
    return F.struct(value.alias("value"), issues_of(*issues).alias("issues"))


@F.pandas_udf(T.StringType())
def _composed(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in values:
        yield x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(T.StringType())
def _folded(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in values:
        yield x.map(lambda s: None if s is None else s.casefold())


def _non_ascii(x: Column) -> Column:
    return F.octet_length(x) != F.length(x)


def casefold(x: Column) -> Column:
    """Python's case folding; the helper only sees text that isn't ASCII."""
    return F.when(_non_ascii(x), _folded(F.when(_non_ascii(x), x))).otherwise(F.lower(x))


def _on_lists(f: Callable[[str], str]):
    """A helper for f of each text of lists; a batch of empty lists alone stays as it is. Made here, as workers can't import this module."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def every(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in values:
            none = not len(x.flatten())
            yield x if none else pa.array([None if a is None else [None if s is None else f(s) for s in a] for a in x.to_pylist()], pa.list_(pa.string()))

    return every


_all_composed = _on_lists(lambda s: unicodedata.normalize("NFC", s))
_all_folded = _on_lists(lambda s: s.casefold())


def _only(odd: Column, every: Column) -> Column:
    """What a helper gets: the row's texts where they are odd, else none. An empty list and not null, since a batch of
    lists is measured row by row, each time from the last one that isn't null."""
    return F.when(odd, every).otherwise(F.array().cast("array<string>"))


def casefold_all(values: list[Column]) -> Column:
    """An array of the values' case foldings; rows of ASCII alone don't go to the helper, others go once."""
    every, odd = F.array(*values), _non_ascii(F.concat_ws("", *values))
    return F.when(odd, _all_folded(_only(odd, every))).otherwise(F.array(*(F.lower(v) for v in values)))


def _bare(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[\p{C}&&[^\n\t]]", "")


def _collapsed(composed: Column) -> Column:
    return F.nullif(stripped(F.regexp_replace(composed, r"(?U)[\s&&[^\n\t]]+", " ")), F.lit(""))


def clean_text(raw: Column) -> Column:
    """Without control and format characters (newline and tab stay), composed, blanks collapsed; empty is null."""
    # Not bound: Python helpers can't stand in a lambda, and this one is used twice only.
    return _collapsed(F.when(_non_ascii(raw), _composed(F.when(_non_ascii(raw), _bare(raw)))).otherwise(_bare(raw)))


def clean_texts(rows: DataFrame, raws: dict[str, Column]) -> DataFrame:
    """``rows`` with the cleaned text of each of the raw columns under its (free) name; the helper is called once a row."""
    if not raws:
        return rows
    keep = rows.columns
    bare, odd = F.array(*map(_bare, raws.values())), _non_ascii(F.concat_ws("", *raws.values()))
    rows = rows.select(*keep, F.when(odd, _all_composed(_only(odd, bare))).otherwise(bare).alias("_composed"))
    return rows.select(*keep, *(_collapsed(F.get("_composed", F.lit(i))).alias(t) for i, t in enumerate(raws)))


def truncated(x: Column, most: int) -> Column:
    """At most ``most`` bytes, cut between characters, with a marker at the end."""
    room = most - len(MARKER.encode())
    if room <= 0:
        return F.lit(MARKER.encode()[:most].decode(errors="ignore"))
    head = F.substring(x.cast("binary"), 1, room)
    # A cut character leaves bytes that are no UTF-8: drop 0 to 3 bytes until the rest is valid.
    tries = [F.try_validate_utf8(F.substring(x.cast("binary"), 1, room - k).cast("string")) for k in range(4)]
    return F.concat(F.coalesce(*tries, head.cast("string")), F.lit(MARKER))


def bounded_text(value: Column, raw: Column, most: int = MAX_BYTES, field: str | None = None) -> Column:
    """struct(value, issues) of a cleaned text: cut where it is too long."""
    long = F.octet_length(value) > most
    return result(F.when(long, truncated(value, most)).otherwise(value), (long, issue("FIELD_TOO_LONG", "warning", field, raw)))


def text(raw: Column, most: int = MAX_BYTES, field: str | None = None) -> Column:
    return bound(clean_text(raw), lambda value: bounded_text(value, raw, most, field))


def name_of(folded: Column) -> Column:
    """A name to compare by from cleaned, folded text: without punctuation and legal suffixes; empty is null."""
    plain = F.regexp_replace(folded, r"[^\p{L}\p{M}\p{N}\p{Pc}\s]", " ")
    plain = F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))
    return F.nullif(F.regexp_replace(plain, r"(?i)(\s+(?:llc|incorporated|inc|limited|ltd|corp(?:oration)?)\.?)+$", ""), F.lit(""))


def name(raw: Column) -> Column:
    return name_of(casefold(clean_text(raw)))


def boolean_steps(raw: Column, more_true: tuple[str, ...] = (), field: str | None = None) -> Steps:
    words = (*TRUE_WORDS, *(w.strip().lower() for w in more_true))
    known = lambda value: result(value.isin(*words), (~value.isin(*words, *FALSE_WORDS), issue("UNKNOWN_ENUM_VALUE", "warning", field, raw)))
    return Steps(F.lower(stripped(F.coalesce(raw, F.lit("")))), known)


def boolean(raw: Column, more_true: tuple[str, ...] = (), field: str | None = None) -> Column:
    return boolean_steps(raw, more_true, field).column()


def digits(x: Column) -> Column:
    """A text with every script's decimal digits as 0 to 9."""
    return F.when(_non_ascii(x), F.translate(x, *_DIGITS)).otherwise(x)


def money_steps(raw: Column, decimal: str | None = None, thousands: str | None = None, field: str | None = None) -> Steps:
    """An amount of two decimals. Separators are inferred where they aren't given: of both the last is
    the decimal one; of one kind it is decimal only if it stands once, before exactly two characters."""
    absent = raw.isNull() | F.lower(stripped(raw)).isin(*NO_AMOUNT)
    kept = F.regexp_replace(F.regexp_replace(digits(raw), r"[^\p{Nd},.'() +\-]", ""), "[ ']", "")
    unwrapped = lambda k: F.struct((k.startswith("(") & k.endswith(")")).alias("wrapped"), F.regexp_replace(k, r"^\((.*)\)$", "$1").alias("body"))

    def separated(parts: Column) -> Column:
        body = parts["body"]
        comma, dot = F.instr(F.reverse(body), ","), F.instr(F.reverse(body), ".")
        return F.struct(parts["wrapped"].alias("wrapped"), body.alias("body"), comma.alias("comma"), dot.alias("dot"), (F.greatest(comma, dot) == 3).alias("two"), (F.regexp_count(body, F.lit("[,.]")) == 1).alias("once"))

    def cleaned(p: Column) -> Column:
        later = F.when(p["comma"] < p["dot"], ",").otherwise(".")
        earlier = F.when(p["comma"] < p["dot"], ".").otherwise(",")
        both = (p["comma"] > 0) & (p["dot"] > 0)
        sep = F.when(p["comma"] > 0, ",").when(p["dot"] > 0, ".")
        guess_point = F.when(both, later).when(p["once"] & p["two"], sep)
        guess_group = F.when(both, earlier).when(~(p["once"] & p["two"]), sep)
        point = F.lit(decimal) if decimal else guess_point
        group = F.lit(thousands) if thousands else F.when(~guess_group.eqNullSafe(point), guess_group)
        plain = F.replace(p["body"], F.coalesce(group, F.lit("\u0000")), F.lit(""))
        plain = F.replace(plain, F.coalesce(point, F.lit(".")), F.lit("."))
        signed = F.concat(F.when(p["wrapped"], "-").otherwise(""), plain)
        return signed

    def read(x: Column) -> Column:
        return F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), x).try_cast("decimal(38,10)")

    def judged(x: Column) -> Column:
        exact, rounded = x["exact"], x["rounded"]
        fits = ~x["absent"] & F.coalesce(F.abs(rounded) <= F.lit("999999999999.99").cast("decimal(14,2)"), F.lit(False))
        return result(
            F.when(fits, rounded).cast("decimal(14,2)"),
            (~x["absent"] & ~fits, issue("INVALID_NUMBER", "error", field, raw)),
            (fits & (rounded != exact), issue("NUMBER_ROUNDED", "warning", field, raw)),
            (fits & (rounded < 0), issue("NEGATIVE_AMOUNT", "warning", field, raw)),
        )

    known = lambda e: F.struct(absent.alias("absent"), e.alias("exact"), F.round(e, 2).alias("rounded"))
    return Steps(kept, unwrapped, separated, cleaned, read, known, judged)


def money(raw: Column, decimal: str | None = None, thousands: str | None = None, field: str | None = None) -> Column:
    return money_steps(raw, decimal, thousands, field).column()


_SLASHED = r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}(\s|$)"


def _read(value: Column, order: Column, explicit: str | None) -> Column:
    unclear = F.lit(False) if explicit else value.rlike(_SLASHED) & (order == "ambiguous")
    return F.struct((value == "").alias("blank"), unclear.alias("unclear"), F.when((value != "") & ~unclear, moments.written(value, order, explicit)).alias("at"))


def date_steps(raw: Column, today: str, order: Column | str = "ambiguous", explicit: str | None = None, field: str | None = None) -> Steps:
    """A calendar day as written. ``today`` is a parameter so that runs repeat; it bounds the future by 366 days."""
    order = F.lit(order) if isinstance(order, str) else order

    def judged(x: Column) -> Column:
        day = x["at"]["naive"].cast("date")
        inside = day.between(F.lit("1990-01-01").cast("date"), F.date_add(F.lit(today).cast("date"), 366))
        return result(
            F.when(inside, day),
            (x["blank"], issue("MISSING_REQUIRED_FIELD", "error", field, raw)),
            (~x["blank"] & x["unclear"], issue("AMBIGUOUS_DATE_FORMAT", "error", field, raw)),
            (~x["blank"] & ~x["unclear"] & day.isNull(), issue("INVALID_DATE", "error", field, raw)),
            (~inside, issue("DATE_OUT_OF_RANGE", "error", field, raw)),
        )

    return Steps(stripped(F.coalesce(raw, F.lit(""))), lambda v: _read(v, order, explicit), judged)


def date(raw: Column, today: str, order: Column | str = "ambiguous", explicit: str | None = None, field: str | None = None) -> Column:
    return date_steps(raw, today, order, explicit, field).column()


def _there(naive: Column, zone: Column, later: bool) -> Column:
    """The moment of a clock's time in a zone. An hour that comes twice is the first one or, with ``later``, the second;
    one that is left out is told as before the clocks moved."""
    first = F.to_utc_timestamp(naive, zone)
    if not later:
        return first
    day = F.expr("INTERVAL 24 HOURS")
    second = F.to_utc_timestamp(naive + day, zone) - day  # by the offset that holds after the clocks moved
    return F.when(F.from_utc_timestamp(second, zone) == naive, F.greatest(first, second)).otherwise(first)


def moment_steps(raw: Column, zone: Column | str, order: Column | str = "ambiguous", explicit: str | None = None, field: str | None = None, later: bool = False) -> Steps:
    """A moment in UTC; without an offset it is read in the tenant's zone, of an hour that comes twice the first one unless ``later``. Blank is null."""
    order = F.lit(order) if isinstance(order, str) else order
    zone = F.lit(zone) if isinstance(zone, str) else zone

    def judged(x: Column) -> Column:
        naive, ahead = x["at"]["naive"].cast("timestamp"), x["at"]["ahead"]
        there = F.when(ahead.isNotNull(), F.timestamp_add("SECOND", -ahead, naive)).otherwise(_there(naive, zone, later))
        return result(there, (~x["blank"] & x["unclear"], issue("AMBIGUOUS_DATE_FORMAT", "error", field, raw)), (~x["blank"] & ~x["unclear"] & naive.isNull(), issue("INVALID_DATE", "error", field, raw)))

    return Steps(stripped(F.coalesce(raw, F.lit(""))), lambda v: _read(v, order, explicit), judged)


def moment(raw: Column, zone: Column | str, order: Column | str = "ambiguous", explicit: str | None = None, field: str | None = None, later: bool = False) -> Column:
    return moment_steps(raw, zone, order, explicit, field, later).column()


def integer_steps(raw: Column, field: str | None = None) -> Steps:
    """A whole number; 90.0 and 9e1 are some. Blank is null."""
    number = lambda v: F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?$"), v).try_cast("decimal(38,10)")
    whole = lambda x: F.when(x == F.floor(x), x).try_cast("long")
    read = lambda v: F.struct((v == "").alias("blank"), bound(number(F.replace(digits(v), F.lit("_"), F.lit(""))), whole).alias("n"))
    judged = lambda x: result(x["n"], (~x["blank"] & x["n"].isNull(), issue("INVALID_NUMBER", "error", field, raw)))
    return Steps(stripped(F.coalesce(raw, F.lit(""))), read, judged)


def integer(raw: Column, field: str | None = None) -> Column:
    return integer_steps(raw, field).column()


def phone(raw: Column) -> Column:
    """International form (+ and digits) or null; the raw text is kept by the caller."""
    digits = F.regexp_replace(raw, r"[ ().\-]", "")
    fine = digits.rlike(r"^\+[1-9]\d{6,14}$") & (~digits.startswith("+1") | digits.rlike(r"^\+1[2-9]\d{2}[2-9]\d{6}$"))
    return F.when(fine, digits)


def category_key(raw: Column) -> Column:
    return F.replace(F.coalesce(name(raw), raw), F.lit(" "), F.lit("-"))


def label(*parts: Column) -> Column:
    """The first part that isn't blank."""
    return F.coalesce(*(F.when(stripped(p) != "", p) for p in parts))


def header(raw: Column) -> Column:
    """A header to compare by: folded, runs of other than letters and digits as one space."""
    return F.trim(F.regexp_replace(casefold(raw), r"[^a-z0-9]+", " "))


def csv_safe(x: Column) -> Column:
    """A cell that no spreadsheet takes for a formula; null is empty."""
    x = F.coalesce(x, F.lit(""))
    return F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)


def search_words(*parts: Column) -> Column:
    """All words to search by, lower-cased, in their order."""
    return F.array_remove(F.split(F.lower(F.concat_ws(" ", *parts)), r"[^\p{L}\p{N}]+"), "")


def search_tokens(*parts: Column) -> Column:
    return F.array_distinct(search_words(*parts))


def no_charge(revenue: Column) -> Column:
    return F.coalesce(revenue == 0, F.lit(False))


def date_order(first_part_over_12: Column, second_part_over_12: Column) -> Column:
    """Aggregates: one kind of evidence alone decides."""
    one, two = F.bool_or(first_part_over_12), F.bool_or(second_part_over_12)
    return F.when(one & ~F.coalesce(two, F.lit(False)), "dmy").when(two & ~F.coalesce(one, F.lit(False)), "mdy").otherwise("ambiguous")
