"""Natural keys: struct(digest, strategy, low_confidence), null where nothing identifies the thing.

With ``ready`` the texts that keys compare (all but ids, phones and serials) are cleaned and folded already.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import casefold, clean_text, name, name_of, stripped


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def _key(*ways: tuple[Column, Column, str, bool]) -> Column:
    """The first way whose condition holds: (condition, digest, strategy, low confidence)."""
    out = None
    for when, hashed, strategy, low in ways:
        made = F.struct(hashed.alias("digest"), F.lit(strategy).alias("strategy"), F.lit(low).alias("low_confidence"))
        out = F.when(when, made) if out is None else out.when(when, made)
    return out


def _has(x: Column) -> Column:
    return F.coalesce(x != "", F.lit(False))


def _name(x: Column, ready: bool) -> Column:
    return name_of(x) if ready else name(x)


def _line(x: Column, ready: bool) -> Column:
    return x if ready else casefold(clean_text(x))


def _code(x: Column, ready: bool) -> Column:
    return x if ready else casefold(stripped(x))


def customer(org: Column, source: Column, external_id: Column, phone: Column, raw_name: Column, postal: Column, ready: bool = False) -> Column:
    plain = _name(raw_name, ready)
    return _key(
        (_has(external_id), digest(org, source, external_id), "external_id", False),
        (_has(phone), digest(org, phone), "phone", False),
        (plain.isNotNull() & _has(postal), digest(org, plain, _code(postal, ready)), "name_postal", False),
        (plain.isNotNull(), digest(org, plain), "name_only", True),
    )


def location(org: Column, source: Column, external_id: Column, customer_digest: Column, address: Column, postal: Column, ready: bool = False) -> Column:
    line = _line(address, ready)
    return _key(
        (_has(external_id), digest(org, source, external_id), "external_id", False),
        (customer_digest.isNotNull() & line.isNotNull() & _has(postal), digest(org, customer_digest, line, _code(postal, ready)), "address", False),
    )


def equipment(org: Column, source: Column, external_id: Column, serial: Column, location_digest: Column, maker: Column, model: Column, kind: Column, ready: bool = False) -> Column:
    parts = [_line(x, ready) for x in (maker, model, kind)]
    whole = location_digest.isNotNull()
    for p in parts:
        whole = whole & p.isNotNull()
    return _key(
        (_has(external_id), digest(org, source, external_id), "external_id", False),
        (_has(serial), digest(org, F.upper(stripped(serial))), "serial_number", False),
        (whole, digest(org, location_digest, *parts), "equipment_attributes", False),
    )


def technician(org: Column, source: Column, external_id: Column, code: Column, raw_name: Column, ready: bool = False) -> Column:
    plain = _name(raw_name, ready)
    return _key(
        (_has(external_id), digest(org, source, external_id), "external_id", False),
        (_has(code), digest(org, _code(code, ready)), "employee_code", False),
        (plain.isNotNull(), digest(org, plain), "normalized_name", True),
    )


def job(org: Column, source: Column, external_id: Column, customer_digest: Column, service_date: Column, summary: Column, description: Column, invoice: Column, ready: bool = False) -> Column:
    told = F.coalesce(_line(F.coalesce(F.when(summary != "", summary), description), ready), F.lit(""))
    natural = digest(org, customer_digest, service_date, F.substring(told, 1, 200), _code(F.coalesce(invoice, F.lit("")), ready))
    return _key((_has(external_id), digest(org, source, external_id), "external_id", False), (customer_digest.isNotNull(), natural, "job_natural_key", False))
