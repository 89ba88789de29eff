"""Concept ids, document handles, versions and dates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import let

SEGMENT = r"[A-Za-z0-9_][A-Za-z0-9_.-]*"
CONCEPT_ID = rf"^{SEGMENT}(/{SEGMENT})*$"
HANDLE = r"^([A-Za-z][A-Za-z0-9]*)-([1-9][0-9]*)$"
#: The newest version that is understood.
KNOWN_VERSION = (0, 2)


def is_concept_id(x: Column) -> Column:
    return x.rlike(CONCEPT_ID) & ~x.contains("\n")


def to_path(concept_id: Column) -> Column:
    return F.concat(concept_id, F.lit(".md"))


def from_path(path: Column) -> Column:
    """The id of a file; NULL if its name can't be one. Only the last extension goes."""
    return valid(F.regexp_replace(path, r"\.[^./]*$", ""))


def valid(x: Column) -> Column:
    """``x`` if it can be an id; else NULL."""
    return let(x, lambda bare: F.when(is_concept_id(bare), bare))


def link_target(concept_id: Column) -> Column:
    return F.concat(F.lit("/"), concept_id, F.lit(".md"))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))


def directory(path: Column) -> Column:
    """The directory of a file, '' at the root."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_reserved(path: Column) -> Column:
    return base_name(path).isin("index.md", "log.md")


def handle(x: Column) -> Column:
    """struct<prefix, number> of PREFIX-N, the number as its digits, however many; NULL if it isn't one."""
    return F.aggregate(F.expr("cast(array() as array<int>)"), x, lambda acc, _: acc, handle_of)  # the text is worked out once, as values.let does it


def handle_of(t: Column) -> Column:
    """``handle`` of a column that is worked out already."""
    return F.when(t.rlike(HANDLE) & ~t.endswith("\n"), F.struct(*[F.regexp_extract(t, HANDLE, i).alias(name) for i, name in ((1, "prefix"), (2, "number"))]))


def by_number(number: Column) -> list[Column]:
    """Order of digits without leading zeros by what they count."""
    return [F.length(number), number]


def successor(number: Column) -> Column:
    """The digits of one more: the last that is no nine is raised, the nines after it turn to zeros."""
    nines = F.length(F.regexp_extract(number, "9*$", 0))
    at = F.length(number) - nines
    raised = F.concat(F.substring(number, F.lit(1), at - 1), (F.substring(number, at, F.lit(1)).cast("int") + 1).cast("string"))
    return F.concat(F.when(at > 0, raised).otherwise("1"), F.repeat(F.lit("0"), nines))


def is_date(x: Column) -> Column:
    """YYYY-MM-DD that the calendar has."""
    return F.coalesce(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(x, "yyyy-MM-dd").isNotNull(), F.lit(False))


def parse_version(raw: str | None) -> tuple[int, int] | None:
    """(major, minor) of exactly two runs of digits."""
    m = re.fullmatch(r"([0-9]+)\.([0-9]+)", raw or "")
    return (int(m[1]), int(m[2])) if m else None


def version(x: Column) -> Column:
    """struct<major, minor>, ordered as versions are; NULL if it isn't one."""
    p = r"^([0-9]{1,9})\.([0-9]{1,9})$"
    return F.when(x.rlike(p), F.struct(F.regexp_extract(x, p, 1).cast("int").alias("major"), F.regexp_extract(x, p, 2).cast("int").alias("minor")))


class Gate:
    """What a bundle's declared version implies: the version to read it as, and what wasn't understood."""

    def __init__(self, declared: str | None):
        self.declared, parsed = declared, parse_version(declared)
        self.unparseable = declared is not None and parsed is None
        self.not_understood = parsed is not None and parsed[0] != KNOWN_VERSION[0]
        self.effective = min(parsed, KNOWN_VERSION) if parsed and not self.not_understood else None

    def at_least(self, major: int, minor: int) -> bool:
        return self.effective is not None and self.effective >= (major, minor)
