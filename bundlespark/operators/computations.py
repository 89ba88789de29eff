"""Attested computations: what is recorded, never executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE = "Attested Computation"


def locations(computation: Column, blocks: Column) -> Column:
    """array<struct<kind, text>>: the file first, then the blocks of the body."""
    none = F.expr("cast(array() as array<struct<kind:string,text:string>>)")
    file = F.when(computation.isNotNull(), F.array(F.struct(F.lit("file").alias("kind"), computation.alias("text")))).otherwise(none)
    return F.concat(file, F.transform(blocks, lambda b: F.struct(F.lit("inline").alias("kind"), b.alias("text"))))


def parameter_text(p: Column) -> Column:
    notes = F.concat_ws(", ", p["type"], F.when(p["required"], F.lit("required")))
    return F.concat(p["name"], F.when(notes != "", F.concat(F.lit(" ("), notes, F.lit(")"))).otherwise(""))


def report(projected: DataFrame) -> DataFrame:
    """(concept_id, runtime, parameters, location, contract) of computations; needs computation_blocks."""
    at = locations(F.col("computation"), F.col("computation_blocks"))
    where = (F.when(F.size(at) == 0, "(no computation)").when(F.size(at) > 1, F.concat(F.lit("("), F.size(at).cast("string"), F.lit(" computations)")))
             .when(at[0]["kind"] == "file", at[0]["text"]).otherwise("inline"))
    halves = (F.when(F.col("executor").isNotNull() & F.col("attester").isNotNull(), "executor + attester")
              .when(F.col("executor").isNotNull(), "executor").when(F.col("attester").isNotNull(), "attester").otherwise("(neither)"))
    given = F.array_join(F.transform("parameters", parameter_text), ", ")
    return projected.where(F.col("type") == TYPE).select(
        "concept_id", F.coalesce("runtime", F.lit("(no runtime)")).alias("runtime"),
        F.when(F.size("parameters") == 0, "(no parameters)").otherwise(given).alias("parameters"), where.alias("location"), halves.alias("contract")).orderBy("concept_id")


def contract_problem(computation: Column, blocks: Column) -> Column:
    """The one problem of a computation's text, or NULL: none, both, or many blocks."""
    n = F.size(blocks)
    return (F.when(computation.isNotNull() & (n > 0), "AttestedComputationHasBothComputations").when(n > 1, "AttestedComputationHasManyBlocks")
            .when(computation.isNull() & (n == 0), "AttestedComputationHasNoComputation"))
