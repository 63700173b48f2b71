"""Column functions: dates as text states them, numbers, coarsening, pseudonyms, canonical codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_date(text: Column) -> Column:
    """The calendar date that a timestamp text states, without moving time zones; null when it states none."""
    return F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd")


def number(text: Column) -> Column:
    """A number as text; null for others, and for forms that only Spark takes for numbers."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed.try_cast("double"))


def age_band(age: Column, width: int = 5, top: int = 90) -> Column:
    """'35-39', and '90+' from the top on; null for ages below 0."""
    low = F.floor(age / width) * width
    return F.when(age >= top, F.lit(f"{top}+")).when(age >= 0, F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string")))


def calendar(day: Column, grain: str) -> Column:
    """A date as year or month; finer grains are refused."""
    if grain not in ("year", "month"):
        raise ValueError(f"dates are not given by {grain}")
    return F.date_format(day, "yyyy" if grain == "year" else "yyyy-MM")


def pseudonym(identifier: Column, key: bytes, length: int = 16) -> Column:
    """The start of the HMAC-SHA256 of the identifier, in hexadecimal. The plan holds pads derived from the key."""
    if len(key) < 32:
        raise ValueError("a project key has 32 bytes or more")
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(identifier, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(outer, digest), 256), 1, length)


def canonical_code(system: Column, code: Column) -> Column:
    """<system>/<code>, without slashes at the end of the system."""
    return F.concat(F.regexp_replace(system, "/+$", ""), F.lit("/"), code)


#: The forms of a concept's canonical code.
GUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
CONCEPT_FORMS = (f"^urn:[a-z0-9]+:concept/({GUID})$", f"^https?://[^/\\s]+/api/v1/concepts/({GUID})$")


def concept_guid(code: Column) -> Column:
    """The guid of a concept's canonical code, in lower case; null for any other code."""
    return F.coalesce(*(F.nullif(F.lower(F.regexp_extract(code, form, 1)), F.lit("")) for form in CONCEPT_FORMS))


def strength(r: Column) -> Column:
    """weak, moderate or strong."""
    return F.when(F.abs(r) < 0.3, "weak").when(F.abs(r) < 0.7, "moderate").when(r.isNotNull(), "strong")


def direction(r: Column) -> Column:
    """Whether two values go the same or the opposite way."""
    return F.when(r > 0, "same").when(r < 0, "opposite").when(r == 0, "none")


def code_class(code: Column) -> Column:
    """plan_concept for the canonical code of a concept, external_code for any other code."""
    return F.when(concept_guid(code).isNotNull(), "plan_concept").when(F.length(F.trim(code)) > 0, "external_code")


def born_for_age(birth: Column, today: str, youngest: int, oldest: int) -> Column:
    """Whether somebody born then is youngest to oldest years old today."""
    now = F.lit(today).cast("date")
    return (birth <= F.add_months(now, -12 * youngest)) & (birth > F.add_months(now, -12 * (oldest + 1)))
