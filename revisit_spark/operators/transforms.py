"""How a mapped cell becomes a value: one transform for each field, by name, compiled to columns.

A mapping may give a field a transform (a date's format, a zone, separators, words for true); it counts where its name is
among those of the field's type, else the type's default holds. ``register`` adds others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import Column

from ..functions import moments
from ..functions import normalize as n


@dataclass(frozen=True)
class When:
    """A date or a time: its format (``%d/%m/%Y``, or Spark's ``dd/MM/yyyy``), the zone it is told in, and whether
    an hour that comes twice there is the ``earlier`` or the ``later`` one."""

    format: str | None = None
    timezone: str | None = None
    repeated: str = "earlier"

    def __post_init__(self):
        if self.format:
            moments.spark_format(self.format)
        if self.repeated not in ("earlier", "later"):
            raise ValueError("a repeated hour is the earlier or the later one")


@dataclass(frozen=True)
class Amount:
    decimal_separator: str | None = None
    thousands_separator: str | None = None

    def __post_init__(self):
        if self.decimal_separator not in (None, ".", ",") or self.thousands_separator not in (None, ".", ",", " "):
            raise ValueError("separators are . and , and, for thousands, a space")
        if self.decimal_separator and self.decimal_separator == self.thousands_separator:
            raise ValueError("separators must differ")


@dataclass(frozen=True)
class Flag:
    true_values: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Values:
    """Other words for a text; what is none of them stays."""

    map: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Given:
    """What holds for the whole batch: the latest day, the date order (per row, if voted per batch), the tenant's zone."""

    today: str
    order: Column | str = "ambiguous"
    zone: Column | str = "UTC"


#: A transform's name in a mapping document: the field types that it is for, and its settings.
NAMES: dict[str, tuple[tuple[str, ...], type]] = {"date": (("date", "datetime"), When), "datetime": (("date", "datetime"), When), "money": (("money",), Amount), "boolean": (("boolean",), Flag), "value_map": (("text",), Values)}
Make = Callable[[Column, Any, Given, str], n.Steps]
#: For each field type but text, the column of a raw cell: (raw, settings or None, given, target) -> steps.
MAKE: dict[str, Make] = {
    "date": lambda raw, how, given, t: n.date_steps(raw, given.today, given.order, how and how.format, t),
    "datetime": lambda raw, how, given, t: n.moment_steps(raw, (how and how.timezone) or given.zone, given.order, how and how.format, t, bool(how) and how.repeated == "later"),
    "money": lambda raw, how, given, t: n.money_steps(raw, how and how.decimal_separator, how and how.thousands_separator, t),
    "boolean": lambda raw, how, given, t: n.boolean_steps(raw, tuple((how and how.true_values) or ()), t),
    "integer": lambda raw, how, given, t: n.integer_steps(raw, t),
}
#: Transforms of one's own, by their settings' class.
OWN: dict[type, Make] = {}


def register(name: str, types: tuple[str, ...], settings: type, make: Make) -> None:
    """A transform of one's own for fields of these types (all but text); ``settings`` are made of a document's keys."""
    if name in NAMES:
        raise ValueError(f"there is a transform of that name: {name}")
    NAMES[name], OWN[settings] = (types, settings), make


def steps(kind: str, raw: Column, how: Any, given: Given, target: str) -> n.Steps:
    """The steps from a raw cell to struct(value, issues); settings of another type's transform don't count."""
    fits = how is not None and any(isinstance(how, settings) and kind in types for types, settings in NAMES.values())
    return OWN.get(type(how) if fits else None, MAKE[kind])(raw, how if fits else None, given, target)


def from_document(found: dict[str, Any]) -> Any:
    """Settings of a document's transform: its ``type`` and its keys. Unknown ones are errors."""
    rest = dict(found)
    name = rest.pop("type", None)
    if name not in NAMES:
        raise ValueError(f"no such transform: {name}")
    settings = NAMES[name][1]
    if odd := set(rest) - {f.name for f in fields(settings)}:
        raise ValueError(f"transform {name} has no {sorted(odd)}")
    return settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in rest.items()})
