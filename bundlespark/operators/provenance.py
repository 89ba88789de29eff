"""Sources of concepts and the signals they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import actors
from ..functions.values import let


def effective_window(own: Column, document: Column) -> Column:
    """An entry's own usage window, else the document's."""
    return F.coalesce(own, document)


def signals(source: Column, window: Column) -> Column:
    """The signals present, as one phrase; '' if there are none."""
    def framed(w):
        start, end = w["from"], w["to"]
        return (F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit(" in "), start, F.lit(".."), end))
                .when(start.isNotNull(), F.concat(F.lit(" since "), start)).when(end.isNotNull(), F.concat(F.lit(" until "), end)).otherwise(""))

    return F.concat_ws(", ", F.concat(F.lit("author "), actors.render(source["author"])),
                       F.concat(F.lit("used "), source["usage_count"].cast("string"), F.lit(" times"), let(window, framed)), F.concat(F.lit("modified "), source["last_modified"]))


def report(projected: DataFrame, ordered: bool = True) -> DataFrame:
    """(concept_id, pos, label, resource, signals) of every source, in the order declared, never ranked."""
    # Lines are made before the list is opened: opened first, each field that is read would read the whole list anew.
    line = lambda s, w: F.struct(F.coalesce(s["id"], F.lit("(no id)")).alias("label"), s["resource"].alias("resource"), signals(s, effective_window(s["usage_window"], w)).alias("signals"))
    lines = let(F.struct("sources", "usage_window"), lambda p: F.transform(p["sources"], lambda s: line(s, p["usage_window"])))
    out = projected.select("concept_id", F.posexplode(lines).alias("pos", "x")).select("concept_id", "pos", "x.label", "x.resource", "x.signals")
    return out.orderBy("concept_id", "pos") if ordered else out


def duplicate_ids(ids: Column) -> Column:
    """Ids that a list holds more than once, in the order first seen."""
    return F.filter(F.array_distinct(ids), lambda x: F.size(F.filter(ids, lambda y: y == x)) > 1)


def uncited(labels: Column, ids: Column) -> Column:
    """struct<unknown_labels, uncited_ids> of a document whose body cites at least once; both empty otherwise."""
    none = F.expr("cast(array() as array<string>)")
    return F.struct(F.array_except(labels, ids).alias("unknown_labels"), F.when(F.size(labels) > 0, F.array_except(ids, labels)).otherwise(none).alias("uncited_ids"))
