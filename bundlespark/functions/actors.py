"""Actors: human:ID, process:ID, PRODUCER/VERSION, or anything else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import let

ACTOR = "struct<kind:string,id:string,version:string,raw:string>"


def parse(x: Column) -> Column:
    """A struct of ACTOR; NULL for NULL. Ids are non-empty; only the first slash splits a producer."""
    def whole(x):
        cut = F.instr(x, "/")
        kind = (F.when(x.rlike("(?s)^human:.+"), "human").when(x.rlike("(?s)^process:.+"), "process")
                .when((cut > 1) & (cut < F.length(x)), "producer").otherwise("unclassified"))
        return F.when(x.isNotNull(), let(kind, lambda k: parts(x, k, cut)))

    def parts(x, kind, cut):
        name = (F.when(kind == "human", F.substring(x, 7, 1 << 30)).when(kind == "process", F.substring(x, 9, 1 << 30))
                .when(kind == "producer", F.substring(x, F.lit(1), cut - 1)))
        version = F.when(kind == "producer", F.substring(x, cut + 1, F.length(x)))
        return F.struct(kind.alias("kind"), name.alias("id"), version.alias("version"), x.alias("raw"))

    return let(x, whole)


def render(actor: Column) -> Column:
    """The text that ``parse`` took apart."""
    k = actor["kind"]
    return (F.when(k.isin("human", "process"), F.concat(k, F.lit(":"), actor["id"]))
            .when(k == "producer", F.concat(actor["id"], F.lit("/"), actor["version"])).otherwise(actor["raw"]))


def is_human(x: Column) -> Column:
    return x.rlike("(?s)^human:.+")
