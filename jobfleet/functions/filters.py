"""Predicates, classification and text clean-up as native column expressions.

Predicates are never null. They spell the null test out as a conjunct where
they can, so that the conjuncts still reach the parquet scan.
"""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobfleet.schemas import BUNDLE, DIRECT, UNKNOWN_CREATOR, UNNAMED

# Markers of a retryable error.
TRANSIENT_MARKERS = ("RATE", "TOO MANY", "429", "INTERNAL", "UNAVAILABLE")
TRANSIENT_CODE_PREFIX = "5"


def parse_tag(tag: str | None) -> tuple[str, str | None] | None:
    """``key=value`` or a bare ``key``; nothing given means no filter."""
    if not tag:
        return None
    key, separator, value = tag.partition("=")
    return key, (value if separator else None)


def or_false(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def or_blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def or_default(value: Column, default: str) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def owner_in(owners: Sequence[str] | None) -> Column:
    """Creator on the list; a missing creator counts as the empty string."""
    if not owners:
        return F.lit(True)
    creator = F.col("creator_user_name")
    listed = creator.isin(list(owners))
    return (creator.isNull() | listed) if "" in owners else (creator.isNotNull() & listed)


def tag_matches(tag: str | None) -> Column:
    """Tag presence or equality on ``settings.tags``; an empty key filters nothing."""
    parsed = parse_tag(tag)
    if parsed is None or parsed[0] == "":
        return F.lit(True)
    key, value = parsed
    tags = F.col("settings.tags")
    if value is None:
        return or_false(F.map_contains_key(tags, key))
    return or_false(F.try_element_at(tags, F.lit(key)) == value)


def name_contains(fragment: str | None) -> Column:
    if not fragment:
        return F.lit(True)
    name = F.col("settings.name")
    return name.isNotNull() & name.contains(fragment)


def is_bundle() -> Column:
    kind = F.col("settings.deployment.kind")
    return kind.isNotNull() & F.upper(kind).contains(BUNDLE)


def deployment_kind() -> Column:
    return F.when(is_bundle(), BUNDLE).otherwise(DIRECT)


def display_name() -> Column:
    return or_default(F.col("settings.name"), UNNAMED)


def creator_label() -> Column:
    return or_default(F.col("creator_user_name"), UNKNOWN_CREATOR)


def url_status(url: Column) -> Column:
    """``valid`` for https, ``insecure`` for http, ``invalid`` for all else."""
    cleaned = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    return (
        F.when(cleaned.rlike(r"(?i)^https://[^/?#]+"), "valid")
        .when(cleaned.rlike(r"(?i)^http://[^/?#]+"), "insecure")
        .otherwise("invalid")
    )


def is_transient(message: Column, error_code: Column) -> Column:
    text = F.upper(or_blank(message))
    found = or_blank(error_code).startswith(TRANSIENT_CODE_PREFIX)
    for marker in TRANSIENT_MARKERS:
        found = found | text.contains(marker)
    return found


def host_list(raw: Column) -> Column:
    """Array of hosts from a comma-separated text: trimmed, no blanks, no final slashes."""
    trimmed = F.transform(F.split(or_blank(raw), ","), lambda part: F.regexp_replace(part, r"^\s+|\s+$", ""))
    kept = F.filter(trimmed, lambda part: part != "")
    return F.transform(kept, lambda part: F.regexp_replace(part, "/+$", ""))
