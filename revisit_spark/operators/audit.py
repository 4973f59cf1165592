"""Audit events: filters and safe payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may be kept of a change, by resource type.
ALLOWED = {
    "organization": ("name", "slug", "timezone", "currency_code", "status"),
    "membership": ("role", "revoked_at"),
    "organization_membership": ("role", "revoked_at"),
    "organization_invitation": ("role", "revoked_at"),
    "invitation": ("role", "revoked_at"),
    "rework_review": ("decision", "category_id", "root_cause_id", "supersedes_review_id"),
}
MOST = 200


def sanitized(resource_type: Column, changes: Column) -> Column:
    """Allowed keys of a map of texts, cut to MOST characters; nothing left is null."""
    allowed = F.create_map(*(x for k, keys in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, keys)))))
    kept = F.map_filter(changes, lambda k, v: F.coalesce(F.array_contains(F.try_element_at(allowed, resource_type), k), F.lit(False)))
    cut = F.transform_values(kept, lambda k, v: F.substring(v, 1, MOST))
    return F.when(F.size(cut) > 0, cut)


def filtered(events: DataFrame, *, action=None, actor=None, resource_type=None, resource_id=None, occurred_from: str | None = None, occurred_to: str | None = None) -> DataFrame:
    """Equal values, and a time from (included) to (excluded)."""
    for column, value in (("action", action), ("actor", actor), ("resource_type", resource_type), ("resource_id", resource_id)):
        if value is not None:
            events = events.where(F.col(column) == value)
    if occurred_from is not None:
        events = events.where(F.col("occurred_at") >= F.lit(occurred_from).cast("timestamp"))
    if occurred_to is not None:
        events = events.where(F.col("occurred_at") < F.lit(occurred_to).cast("timestamp"))
    return events
