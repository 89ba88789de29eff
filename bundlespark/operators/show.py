"""One concept in detail, its one computation, and the order of a menu of concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import actors, paths
from ..sources import markdown
from . import computations, concepts, provenance, trust


def detail(projected: DataFrame, raw: str, today: str) -> DataFrame:
    """(pos, label, value) of the concept that ``raw`` names, absent parts left out; LookupError for none or several."""
    one = concepts.resolve(projected, raw)
    at = computations.locations(F.col("computation"), F.col("computation_blocks")) if "computation_blocks" in projected.columns else computations.locations(F.col("computation"), F.expr("cast(array() as array<string>)"))
    by = lambda x: F.concat_ws(" at ", actors.render(x["by"]), x["at"])
    lines = [("id", F.col("concept_id")), ("type", F.col("type")), ("title", F.col("title")), ("description", F.col("description")), ("resource", F.col("resource")), ("tags", F.array_join("tags", ", ")),
             ("generated", by(F.col("generated"))), ("verified", F.array_join(F.transform("verified", by), "; ")), ("trust", trust.tier(F.col("verified"))), ("status", F.col("status")),
             ("staleness", trust.staleness_text(F.col("stale_after"), today)), ("runtime", F.col("runtime")), ("parameters", F.array_join(F.transform("parameters", computations.parameter_text), ", ")),
             ("executor", F.col("executor.resource")), ("attester", F.col("attester.resource")), ("computations", F.when(F.size(at) > 0, F.size(at).cast("string")))]
    rows = F.array(*[F.struct(F.lit(k).alias("label"), v.cast("string").alias("value")) for k, v in lines])
    sources = F.transform("sources", lambda s: F.struct(F.lit("source").alias("label"), F.concat_ws(" ", F.coalesce(s["id"], F.lit("(no id)")), s["resource"], provenance.signals(s, provenance.effective_window(s["usage_window"], F.col("usage_window")))).alias("value")))
    return one.select(F.posexplode(F.concat(rows, sources)).alias("pos", "x")).select("pos", "x.label", "x.value").where("value is not null and value <> ''")


def computation(projected: DataFrame, raw: str, inventory: DataFrame) -> tuple[str, str]:
    """('inline', text) or ('file', path) of the concept's one computation; LookupError says why there is none to show.

    Concepts without computation_blocks are better: then the one body that is found is read, and no other.
    """
    one = concepts.resolve(projected, raw)
    one = one if "computation_blocks" in one.columns else markdown.with_facts(one)
    at = computations.locations(F.col("computation"), F.col("computation_blocks"))
    row = one.select("concept_id", at.alias("at"), paths.classify(F.col("source_path"), F.col("computation")).alias("where")).first()
    if len(row["at"]) != 1:
        raise LookupError(f"{row['concept_id']} has {len(row['at']) or 'no'} computation{'s' * (len(row['at']) > 1)}")
    only = row["at"][0]
    if only["kind"] == "inline":
        return "inline", only["text"]
    kind, path = row["where"]["kind"], row["where"]["path"]
    if kind != "bundle":
        raise LookupError({"external": f"the computation is at {only['text']}, which is not fetched", "escape": "the computation's path leaves the bundle"}.get(kind, "the computation's path is malformed"))
    if inventory.where(F.col("path") == path).isEmpty():
        raise LookupError(f"there is no file {path}")
    return "file", path


def menu_order(by: str = "modified") -> list[Column]:
    """Last modified first, unknown times last, then by id; or by id alone."""
    return [*([F.desc_nulls_last("modified")] if by == "modified" else []), F.col("concept_id")]


def menu(projected: DataFrame, by: str = "modified") -> DataFrame:
    """Concepts for choosing one, in ``menu_order``."""
    return projected.orderBy(*menu_order(by)).select("concept_id", "type", "title")
