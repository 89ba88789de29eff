"""Concepts: identity, frontmatter, body, and typed views of the frontmatter.

A concept is a row (concept_id, source_path, fm VARIANT, body). Everything else is a
projection over it, so nothing derived can drift.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import actors, ids, values

#: The keys that frontmatter always may have, in the order they are written.
CORE_KEYS = ["type", "title", "description", "resource", "tags", "timestamp", "generated", "verified", "status", "stale_after",
             "sources", "usage_window", "runtime", "parameters", "computation", "executor", "attester"]

#: Texts that JSON writes as they are.
_VERBATIM = re.compile(r"[A-Za-z0-9 ._:-]+")


def from_rows(rows: DataFrame, concept_id: Column, frontmatter: Column, body: Column | None = None) -> DataFrame:
    """Concepts from table rows; ``frontmatter`` is a struct or map, its null fields are left out."""
    fm = F.parse_json(F.to_json(frontmatter))
    return rows.select(concept_id.alias("concept_id"), ids.to_path(concept_id).alias("source_path"), fm.alias("fm"), (F.lit("") if body is None else body).alias("body"))


def _window(v: Column) -> Column:
    return values.let(v, lambda w: F.when(values.kind(w) == "object", F.struct(values.text(values.get(w, "from")).alias("from"), values.text(values.get(w, "to")).alias("to"))))


def verified(fm: Column) -> Column:
    """array<struct<by, at>>; a bare mapping is one entry, entries without a textual 'by' don't count."""
    none = F.expr("cast(array() as array<variant>)")
    every = values.let(values.read(values.get(fm, "verified")), lambda r: F.when(r["k"] == "array", r["xs"]).when(r["k"] == "object", F.array(r["v"])).otherwise(none))
    some = F.transform(every, lambda x: F.struct(actors.parse(values.text(values.get(x, "by"))).alias("by"), values.text(values.get(x, "at")).alias("at")))
    return F.filter(some, lambda x: x["by"].isNotNull())


def sources(fm: Column) -> Column:
    """array of structs; only a list counts, entries without a textual 'resource' don't."""
    every = F.coalesce(values.items(values.get(fm, "sources")), F.expr("cast(array() as array<variant>)"))

    def entry(x):
        t = lambda k: values.text(values.get(x, k)).alias(k)
        return F.struct(t("id"), t("resource"), t("title"), actors.parse(values.text(values.get(x, "author"))).alias("author"),
                        values.integer(values.get(x, "usage_count")).alias("usage_count"), t("last_modified"), _window(values.get(x, "usage_window")).alias("usage_window"))

    return F.filter(F.transform(every, entry), lambda x: x["resource"].isNotNull())


def parameters(fm: Column) -> Column:
    every = F.coalesce(values.items(values.get(fm, "parameters")), F.expr("cast(array() as array<variant>)"))
    entry = lambda x: F.struct(values.text(values.get(x, "name")).alias("name"), values.text(values.get(x, "type")).alias("type"), values.boolean(values.get(x, "required")).alias("required"))
    return F.filter(F.transform(every, entry), lambda x: x["name"].isNotNull())


def project(concepts: DataFrame) -> DataFrame:
    """``concepts`` with a column for each core key, read strictly; absent and malformed alike are NULL or empty."""
    fm = F.col("fm")
    t = lambda *k: values.text(values.get(fm, *k))
    generated, executor, attester = (values.get(fm, k) for k in ("generated", "executor", "attester"))
    status = t("status")
    return concepts.withColumns({
        "segments": F.split("concept_id", "/"),
        "type": F.coalesce(t("type"), F.lit("")),
        "title": t("title"), "description": t("description"), "resource": t("resource"), "tags": values.texts(values.get(fm, "tags")),
        "generated": values.let(t("generated", "by"), lambda by: F.when(by.isNotNull(), F.struct(actors.parse(by).alias("by"), values.text(values.get(generated, "at")).alias("at")))),
        "verified": verified(fm),
        "status": F.coalesce(status, F.lit("stable")),
        "stale_after": t("stale_after"),
        "sources": sources(fm),
        "usage_window": _window(values.get(fm, "usage_window")),
        "runtime": t("runtime"), "parameters": parameters(fm), "computation": t("computation"),
        "executor": F.when(values.kind(executor) == "object", F.struct(values.text(values.get(executor, "resource")).alias("resource"), values.texts(values.get(executor, "receipt")).alias("receipt"))),
        "attester": F.when(values.kind(attester) == "object", F.struct(values.text(values.get(attester, "resource")).alias("resource"))),
    })


def find(concepts: DataFrame, concept_id: str) -> DataFrame:
    return concepts.where(F.col("concept_id") == concept_id).limit(1)


def find_by_handle(concepts: DataFrame, raw: str, key: str | None = None) -> DataFrame:
    """Concepts with a top-level text value, of ``key`` or of any, that equals ``raw`` but for white space around it."""
    fm, wanted = F.col("fm"), raw.strip()
    if key is not None:
        return concepts.where(F.coalesce(values.strip(values.text(values.get(fm, key))) == wanted, F.lit(False)))
    every = F.map_values(fm.cast("map<string,variant>"))
    holds = F.exists(every, lambda x: F.coalesce(values.strip(values.text(x)) == wanted, F.lit(False)))
    if _VERBATIM.fullmatch(wanted):
        holds = F.coalesce(F.to_json(fm).contains(wanted), F.lit(False)) & holds  # most concepts are told by their text, unopened
    return concepts.where(holds)


def resolve(concepts: DataFrame, raw: str) -> DataFrame:
    """The concept whose id, or else whose handle, is ``raw``; LookupError for none or several."""
    by_id = find(concepts, raw)
    if not by_id.isEmpty():
        return by_id
    found = find_by_handle(concepts, raw)
    names = sorted(r[0] for r in found.select("concept_id").limit(11).collect())
    if len(names) != 1:
        raise LookupError(f"no concept is {raw!r}" if not names else f"{raw!r} is ambiguous: {', '.join(names)}")
    return find_by_handle(concepts.where(F.col("concept_id") == names[0]), raw)  # by the id first, so frontmatter is opened once only


def frontmatter_json(concepts: DataFrame) -> DataFrame:
    """(concept_id, json): the raw frontmatter objects, by id."""
    return concepts.select("concept_id", F.to_json("fm").alias("json")).orderBy("concept_id")
