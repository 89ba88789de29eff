"""Document handles, PREFIX-N: listing, the next free one, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids, values


def in_bundle(concepts: DataFrame, key: str) -> DataFrame:
    """(prefix, number, concept_id) of every valid handle under ``key``; numbers are digits, of any length, in the order of what they count."""
    found = concepts.select("concept_id", ids.handle(values.text(values.get(F.col("fm"), key))).alias("h")).where("h is not null")
    return found.select("h.prefix", "h.number", "concept_id").orderBy("prefix", *ids.by_number(F.col("number")), "concept_id")


def next_number(concepts: DataFrame, key: str, prefix: str) -> DataFrame:
    """(prefix, number): one above the largest in use; gaps are never filled, an unused prefix starts at 1."""
    used = in_bundle(concepts, key).where(F.col("prefix") == prefix)
    largest = F.max(F.struct(*ids.by_number(F.col("number"))))["number"]
    return used.agg(largest.alias("largest")).select(F.lit(prefix).alias("prefix"), F.coalesce(ids.successor(F.col("largest")), F.lit("1")).alias("number"))


def duplicates(concepts: DataFrame, key: str) -> DataFrame:
    """(handle, first_id, concept_id): each further owner of a text under ``key``, with the first by id."""
    owners = concepts.select(values.text(values.get(F.col("fm"), key)).alias("handle"), "concept_id").where(~values.is_blank(F.col("handle")))
    first = owners.groupBy("handle").agg(F.min("concept_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = owners.join(first, "handle")
    rank = F.row_number().over(Window.partitionBy("handle", "concept_id").orderBy("concept_id"))
    return again.withColumn("r", rank).where("concept_id <> first_id or r > 1").select("handle", "first_id", "concept_id").orderBy("handle", "concept_id")


def observed_prefixes(concepts: DataFrame) -> DataFrame:
    """(prefix) of any top-level text value that is a handle, distinct and sorted."""
    every = concepts.select(F.explode(F.map_values(F.col("fm").cast("map<string,variant>"))).alias("v"))
    return every.select(ids.handle(values.text(F.col("v")))["prefix"].alias("prefix")).where("prefix is not null").distinct().orderBy("prefix")


def fields(concepts: DataFrame) -> DataFrame:
    """(concept_id, key, handle) of top-level text values that are handles, by key."""
    each = concepts.select("concept_id", F.explode(F.col("fm").cast("map<string,variant>")).alias("key", "v"))
    t = values.strip(values.text(F.col("v")))
    return each.select("concept_id", "key", t.alias("handle")).where(ids.handle(F.col("handle")).isNotNull()).orderBy("concept_id", "key")


def unique_values(concepts: DataFrame, key: str, member: str, ordered: bool = True) -> DataFrame:
    """(concept_id, value, indexes): scalars that a list's records hold more than once under ``member``.

    Each concept is judged by itself, where its row is: nothing is shuffled but for the
    order of the report, and concepts that share an id are kept apart.
    """
    xs = F.coalesce(values.items(values.get(F.col("fm"), key)), F.expr("cast(array() as array<variant>)"))

    def keyed(x, i):
        def of(r):
            scalar = r["k"].isin("string", "number", "boolean") & ~F.coalesce(values.is_blank(r["t"]), F.lit(False))
            return F.when(scalar, F.struct(values.key_of(r).alias("k"), i.alias("i"), F.coalesce(r["t"], F.to_json(r["v"])).alias("s")))

        return values.let(values.read(values.get(x, member)), of)

    runs = values.repeated(F.filter(F.transform(xs, keyed), lambda y: y.isNotNull()))
    each = concepts.select("concept_id", F.explode(F.transform(runs, lambda run: F.struct(run[0]["s"].alias("value"), run["i"].alias("indexes")))).alias("run"))
    out = each.select("concept_id", "run.value", "run.indexes")
    return out.orderBy("concept_id", F.col("indexes")[0]) if ordered else out  # a sort by ranges works all of it out twice
