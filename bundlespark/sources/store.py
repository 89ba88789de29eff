"""A corpus stored as Parquet with sidecar columns, so that filters reach the scan.

Beside the VARIANT frontmatter stand, for each chosen selector, three plain columns:

* ``kind``: missing, empty (a list without elements), null, string, number, boolean,
  object, or many (a list, or a selector that goes through one);
* ``text``: what a filter compares, where the value is one scalar;
* ``texts``: the same of every scalar where there are many.

They say all that a filter can ask of their selector. The part about single scalars and
kinds is pushed to Parquet, whose row groups are sorted by type and id; the exact rest
reads ``texts``. Only selectors that weren't chosen are looked up in the VARIANT. Rows
come back the same as from the VARIANT alone, for nulls, lists and numbers too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import filters
from ..operators.concepts import project

#: Selectors that get columns of their own unless others are chosen.
SELECTORS = ("type", "title", "description", "resource", "status", "tags", "stale_after", "generated.by", "generated.at")
#: Bytes of a row group, about: smaller ones skip more and cost more to list.
ROW_GROUP = 16 << 20


def _name(what: str, selector: str) -> str:
    return f"{what}:{selector}"


def _columns(selector: str) -> list[Column]:
    path = filters.parse_selector(selector)
    top = values.read(values.get(F.col("fm"), path[0]))

    def sidecar(found: Column, single: Column, kind: Column) -> Column:
        one = F.when(single, found[0])
        texts = F.filter(F.transform(found, values.scalar_text), lambda x: x.isNotNull())
        what = F.when(F.size(found) == 0, F.when(kind == "array", "empty").otherwise("missing")).when(single, values.kind(one)).otherwise("many")
        return F.struct(what.alias("kind"), F.when(single, values.scalar_text(one)).alias("text"), F.when((F.size(found) > 0) & ~single, texts).alias("texts"))

    def whole(r: Column) -> Column:
        found = values.field_values(F.col("fm"), path)
        inner = values.get(r["v"], path[1]) if len(path) == 2 else r["v"]
        return values.let(values.kind(inner), lambda k: values.let(found, lambda xs: sidecar(xs, (r["k"] != "array") & (k != "array") & (F.size(xs) == 1), F.when(r["k"] == "array", "array").otherwise(k))))

    made = values.let(top, whole)
    return [made[part].alias(_name(part, selector)) for part in ("kind", "text", "texts")]


def save(concepts: DataFrame, path: str, selectors: tuple[str, ...] = SELECTORS, mode: str = "errorifexists") -> None:
    """Writes ``concepts`` (concept_id, source_path, fm, body) with their sidecars, dealt out and sorted by type and id."""
    made = concepts.select("concept_id", "source_path", "body", "fm", *[c for s in selectors for c in _columns(s)])
    order = [F.col(f"`{_name('text', 'type')}`")] if "type" in selectors else []
    order.append(F.col("concept_id"))
    made.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", ROW_GROUP).mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows: concept_id, source_path, body, fm and the sidecars. ``project`` gives the typed views."""
    return spark.read.parquet(path)


def selectors_of(stored: DataFrame) -> set[str]:
    return {c.split(":", 1)[1] for c in stored.columns if c.startswith("kind:")}


def where(stored: DataFrame, wanted: list[filters.Filter]) -> DataFrame:
    """The stored concepts that satisfy ``wanted``, as ``operators.filters.where`` would choose them."""
    have = selectors_of(stored)
    groups: dict[tuple, list[filters.Filter]] = {}
    for f in wanted:
        groups.setdefault((f.question, f.path), []).append(f)
    out = stored
    for (question, path), some in groups.items():
        selector = ".".join(path)
        if selector not in have:
            out = out.where(filters.predicate(some))
            continue
        kind, text, texts = (F.col(f"`{_name(part, selector)}`") for part in ("kind", "text", "texts"))
        if question == "equals":
            # Two conjuncts: what Parquet can judge, then the exact rest, worded so that the optimizer doesn't draw them together.
            overlap = F.coalesce(F.arrays_overlap(texts, F.array(*[F.lit(f.value) for f in some])), F.lit(False))
            out = out.where(text.isin([f.value for f in some]) | (kind == "many")).where(F.when(kind == "many", overlap).otherwise(F.lit(True)))
        else:
            none = kind.isin("missing", "empty")
            out = out.where(none if question == "absent" else ~none)
    return out


def show(stored: DataFrame, key: str) -> Column:
    """``operators.filters.show`` from the sidecars where there are any."""
    if key not in selectors_of(stored):
        return filters.show(tuple(key.split(".")))
    text, texts = F.col(f"`{_name('text', key)}`"), F.col(f"`{_name('texts', key)}`")
    return F.coalesce(text, F.when(F.size(texts) > 0, F.array_join(texts, ", ")), F.lit("-"))


def listing(stored: DataFrame, wanted: list[filters.Filter] = (), shown: list[str] = ()) -> DataFrame:
    """concept_id, type, a column for each shown key, title; by id. Reads no VARIANT if all keys have sidecars."""
    def plain(key: str) -> Column:
        if key not in selectors_of(stored):
            return values.text(values.get(F.col("fm"), key))
        return F.when(F.col(f"`{_name('kind', key)}`") == "string", F.col(f"`{_name('text', key)}`"))

    cols = [show(stored, k).alias(k) for k in shown]
    return where(stored, list(wanted)).select("concept_id", F.coalesce(plain("type"), F.lit("")).alias("type"), *cols, plain("title").alias("title")).orderBy("concept_id")


def projected(stored: DataFrame) -> DataFrame:
    """The typed views of stored concepts, for the other operators."""
    return project(stored.select("concept_id", "source_path", "fm", "body"))
