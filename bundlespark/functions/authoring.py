"""Writing frontmatter: columns that set, remove and build its keys. NULL members are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant(value: Column) -> Column:
    """Any column as VARIANT; NULL members of structs are left out, a NULL column stays NULL."""
    boxed = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.try_variant_get(F.parse_json(boxed), "$['v']", "variant"))


def remove_key(fm: Column, key: str) -> Column:
    return F.parse_json(F.to_json(F.map_filter(fm.cast("map<string,variant>"), lambda k, _: k != key)))


def set_key(fm: Column, key: str, value: Column) -> Column:
    """``fm`` with ``key`` set, in place of an earlier value; NULL removes it."""
    rest = F.map_filter(fm.cast("map<string,variant>"), lambda k, _: k != key)
    return F.parse_json(F.to_json(F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), variant(value))))))


def common(type_: Column, title: Column, description: Column, resource: Column | None = None, tags: Column | None = None) -> Column:
    """The keys that most documents have, as a struct for concepts.from_rows."""
    none = F.lit(None).cast("string")
    return F.struct(type_.alias("type"), title.alias("title"), description.alias("description"), (none if resource is None else resource).alias("resource"),
                    (F.lit(None).cast("array<string>") if tags is None else F.when(F.size(tags) > 0, tags)).alias("tags"))


def event(by: Column, at: Column | None = None) -> Column:
    """The value of generated, or an entry of verified (which is always written as a list)."""
    return F.struct(by.alias("by"), (F.lit(None).cast("string") if at is None else at).alias("at"))


def window(start: Column, end: Column) -> Column:
    return F.struct(start.alias("from"), end.alias("to"))


def source(resource: Column, **more: Column) -> Column:
    """An entry of sources; ``more``: id, title, author, usage_count, last_modified, usage_window."""
    return F.struct(resource.alias("resource"), *[v.alias(k) for k, v in sorted(more.items())])
