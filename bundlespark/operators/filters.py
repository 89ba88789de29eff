"""Selecting concepts: KEY=VALUE, KEY present, KEY absent, over keys one or two deep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values


class FilterError(ValueError):
    """A selector or filter that cannot be read, or that cannot match."""


@dataclass(frozen=True)
class Filter:
    """question: equals, present or absent; value only with equals."""

    question: str
    path: tuple[str, ...]
    value: str | None = None


def parse_selector(raw: str) -> tuple[str, ...]:
    """KEY or PARENT.MEMBER; empty components and more than two levels are errors."""
    path = tuple(raw.split("."))
    if not all(path):
        raise FilterError(f"empty component in selector {raw!r}")
    if len(path) > 2:
        raise FilterError(f"selector {raw!r} is nested deeper than PARENT.MEMBER")
    return path


def parse_equals(raw: str) -> Filter:
    """KEY=VALUE, cut at the first '='; the value is taken as it stands."""
    key, sign, value = raw.partition("=")
    if not sign:
        raise FilterError(f"no '=' in {raw!r}")
    return Filter("equals", parse_selector(key), value)


def present(raw: str) -> Filter:
    return Filter("present", parse_selector(raw))


def absent(raw: str) -> Filter:
    return Filter("absent", parse_selector(raw))


def of_type(name: str) -> Filter:
    return Filter("equals", ("type",), name)


def render(f: Filter) -> str:
    key = ".".join(f.path)
    return f"{key}={f.value}" if f.question == "equals" else f"{'has' if f.question == 'present' else 'missing'} {key}"


def predicate(filters: list[Filter], fm: Column | str = "fm") -> Column:
    """Filters on the same question and selector are alternatives; different groups must all hold. None: true."""
    fm = F.col(fm) if isinstance(fm, str) else fm
    groups: dict[tuple, list[str]] = {}
    for f in filters:
        groups.setdefault((f.question, f.path), []).append(f.value)
    out = F.lit(True)
    for (question, path), wanted in groups.items():
        found = values.field_values(fm, path)
        if question == "equals":
            out = out & _any_of(found, wanted)
        else:
            out = out & ((F.size(found) > 0) if question == "present" else (F.size(found) == 0))
    return out


def _any_of(found: Column, wanted: list[str]) -> Column:
    return F.exists(found, lambda x: F.coalesce(values.scalar_text(x).isin(wanted), F.lit(False)))


def where(concepts: DataFrame, filters: list[Filter]) -> DataFrame:
    """The concepts that satisfy ``filters``; their order is kept."""
    return concepts.where(predicate(filters))


def show(path: tuple[str, ...], fm: Column | str = "fm") -> Column:
    """A shown column: scalar texts joined by ', ', or '-' if there is none. A path too deep is looked up whole at top level."""
    fm = F.col(fm) if isinstance(fm, str) else fm
    found = values.field_values(fm, path if len(path) <= 2 else (".".join(path),))
    shown = F.filter(F.transform(found, values.scalar_text), lambda x: x.isNotNull())
    return F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise("-")


def listing(concepts: DataFrame, filters: list[Filter] = (), shown: list[str] = ()) -> DataFrame:
    """concept_id, type, a column for each shown key, title; by id."""
    cols = [show(tuple(k.split("."))).alias(k) for k in shown]
    return where(concepts, list(filters)).select("concept_id", "type", *cols, "title").orderBy("concept_id")
