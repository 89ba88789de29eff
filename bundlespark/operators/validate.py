"""Diagnostics of a bundle as rows, without a profile.

Rows are (phase, concept_id, pos, code, detail): documents, dangling links, dangling
paths, duplicate ids, then the bundle's version, in that order. Permissive checks only
what conformance needs; strict adds what authors are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, paths, values
from ..functions.ids import Gate
from . import computations, graph, lookup

_NONE = "cast(array() as array<struct<code:string,detail:string>>)"


def _problem(code: str, detail: Column | str = "") -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def _if(condition: Column, code: str, detail: Column | str = "") -> Column:
    return F.when(condition, F.array(_problem(code, detail))).otherwise(F.expr(_NONE))


def _text_wanted(fm: Column, key: str, missing: str) -> Column:
    v = values.get(fm, key)
    bad = F.coalesce(values.is_blank(values.text(v)), F.lit(True))
    return F.when(v.isNull(), F.array(_problem(missing, key))).otherwise(_if(bad, "FieldMustBeNonEmptyText", key))


def _source_problems(fm: Column, labels: Column) -> Column:
    v = values.get(fm, "sources")
    entries = F.coalesce(values.items(v), F.expr("cast(array() as array<variant>)"))
    solid = lambda t: F.when(~values.is_blank(t), t)
    at = F.filter(F.transform(entries, lambda x, i: F.when((values.kind(x) == "object") & solid(values.text(values.get(x, "resource"))).isNull(), i)), lambda i: i.isNotNull())
    missing = F.transform(at, lambda i: _problem("SourceMissingResource", i.cast("string")))
    own = F.filter(F.transform(entries, lambda x: solid(values.text(values.get(x, "id")))), lambda x: x.isNotNull())
    again = F.transform(values.repeated(F.transform(own, lambda x, i: F.struct(x.alias("k"), i.alias("i")))), lambda run: run[0]["k"])
    stripped = F.array_distinct(F.transform(own, values.strip))
    unknown = F.transform(F.array_except(labels, stripped), lambda x: _problem("FootnoteLabelNotInSources", x))
    uncited = F.when(F.size(labels) > 0, F.transform(F.array_except(stripped, labels), lambda x: _problem("SourceIdNotCited", x))).otherwise(F.expr(_NONE))
    checked = F.concat(missing, F.transform(again, lambda x: _problem("DuplicateSourceId", x)), unknown, uncited)
    return F.when(v.isNull(), F.expr(_NONE)).otherwise(checked)


def document_problems(strict: bool, gate: Gate) -> Column:
    """array<struct<code, detail>> of a concept with Markdown facts, in report order."""
    fm = F.col("fm")
    tags = values.get(fm, "tags")
    all_text = F.forall(F.coalesce(values.items(tags), F.expr("cast(array() as array<variant>)")), lambda x: values.kind(x) == "string")
    parts = [_text_wanted(fm, "type", "MissingRequiredField"), _if(tags.isNotNull() & ~((values.kind(tags) == "array") & all_text), "FieldMustBeListOfText", "tags")]
    if strict:
        generated, stamp = values.get(fm, "generated"), values.get(fm, "timestamp")
        legacy = F.coalesce(~values.is_blank(values.text(stamp)), F.lit(False))
        attested = F.coalesce(values.text(values.get(fm, "type")) == computations.TYPE, F.lit(False))
        runtime = F.coalesce(values.is_blank(values.text(values.get(fm, "runtime"))), F.lit(True))
        problem = computations.contract_problem(values.text(values.get(fm, "computation")), F.col("computation_blocks"))
        many = F.when(problem == "AttestedComputationHasManyBlocks", F.size("computation_blocks").cast("string")).otherwise("")
        parts += [
            _text_wanted(fm, "title", "MissingRecommendedField"), _text_wanted(fm, "description", "MissingRecommendedField"),
            F.when(generated.isNull(), _if(~legacy, "MissingGeneratedField")).otherwise(_if(values.text(values.get(fm, "generated", "by")).isNull(), "GeneratedMustHaveActor")),
            _source_problems(fm, F.col("footnotes")),
            _if(attested & runtime, "AttestedComputationMissingRuntime"),
            F.when(attested & problem.isNotNull(), F.array(F.struct(problem.alias("code"), many.alias("detail")))).otherwise(F.expr(_NONE)),
        ]
        if gate.at_least(0, 2):
            parts.append(_if(stamp.isNotNull() & generated.isNull(), "LegacyFieldInDeclaredV2", "timestamp"))
    return F.concat(*parts)


def documents(concepts: DataFrame, strict: bool = False, version: str | None = None) -> DataFrame:
    each = concepts.select("concept_id", F.posexplode(document_problems(strict, Gate(version))).alias("pos", "x"))
    return each.select(F.lit(1).alias("phase"), "concept_id", "pos", "x.code", "x.detail")


def path_fields(concepts: DataFrame) -> DataFrame:
    """(concept_id, source_path, pos, field, raw) of the four path-valued keys, where they are text."""
    rows = F.array(*[F.struct(F.lit(name).alias("field"), raw.alias("raw")) for name, raw in (("resource", F.col("resource")), ("computation", F.col("computation")), ("executor.resource", F.col("executor.resource")), ("attester.resource", F.col("attester.resource")))])
    return concepts.select("concept_id", "source_path", F.posexplode(rows).alias("pos", "x")).select("concept_id", "source_path", "pos", "x.field", "x.raw").where("raw is not null")


def dangling_paths(concepts: DataFrame, inventory: DataFrame) -> DataFrame:
    """(concept_id, pos, field, target, alternative): path values that name no file of the bundle.

    alternative is the file that the same text would name from the root, if there is one.
    """
    known = inventory.select(F.array_join(ids.segments(F.col("path")), "/").alias("path")).distinct()
    each = path_fields(concepts).withColumn("at", paths.classify(F.col("source_path"), F.col("raw"))).where("at.kind = 'bundle'").withColumn("target", F.col("at.path"))
    gone = each.join(known.withColumnRenamed("path", "target"), "target", "left_anti")
    root = paths.collapse(F.regexp_replace(paths.without_suffix(values.strip(F.col("raw"))), "^/+", ""))
    other = gone.withColumn("alt", F.when(root != F.col("target"), root))
    found = lookup.meet(other, F.col("alt"), known.withColumnRenamed("path", "alternative"), "alternative", "concept_id", "field")
    return found.select("concept_id", "pos", "field", "target", "alternative")


def validate(concepts: DataFrame, inventory: DataFrame | None = None, strict: bool = False, version: str | None = None, ordered: bool = True) -> DataFrame:
    """All diagnostics, ordered (if asked) by phase, concept and position; needs projected concepts with Markdown facts."""
    gate = Gate(version)
    # Problems and link targets come from one pass over the bodies.
    row = lambda phase, pos, code, detail: F.struct(F.lit(phase).alias("phase"), pos.alias("pos"), code.alias("code"), detail.alias("detail"))
    found = F.transform(document_problems(strict, gate), lambda x, i: row(1, i, x["code"], x["detail"]))
    links = F.transform("links", lambda u, i: row(2, i, F.lit("DanglingReference"), paths.link_target(F.col("source_path"), u)))
    each = concepts.select("concept_id", F.explode(F.concat(found, F.filter(links, lambda x: x["detail"].isNotNull()))).alias("x")).select("x.phase", "concept_id", "x.pos", "x.code", "x.detail")
    known = concepts.select(F.col("concept_id").alias("known")).distinct()
    target = F.when(F.col("phase") == 2, F.col("detail"))
    out = lookup.meet(each, target, known, "known", "concept_id", "pos").where("phase = 1 or known is null").drop("known")
    if strict:
        have = concepts.select(F.col("source_path").alias("path")) if inventory is None else inventory
        gone = dangling_paths(concepts, have)
        out = out.unionByName(gone.select(F.lit(3).alias("phase"), "concept_id", "pos", F.lit("DanglingFrontmatterPath").alias("code"), F.concat(F.col("field"), F.lit(" -> "), F.col("target"), F.coalesce(F.concat(F.lit(" (did you mean /"), "alternative", F.lit(")")), F.lit(""))).alias("detail")))
    out = out.unionByName(graph.duplicate_ids(concepts).select(F.lit(4).alias("phase"), "concept_id", F.lit(0).alias("pos"), F.lit("DuplicateConceptId").alias("code"), F.lit("").alias("detail")))
    code = "BundleVersionUnparseable" if gate.unparseable else "BundleVersionNotUnderstood" if gate.not_understood else None
    if strict and code:
        out = out.unionByName(concepts.sparkSession.createDataFrame([(5, "", 0, code, version)], "phase int, concept_id string, pos int, code string, detail string"))
    return out.orderBy("phase", "concept_id", "pos") if ordered else out


def failed(diagnostics: DataFrame, log_problems: DataFrame | None = None, deviations: DataFrame | None = None, *, profile_enforce: bool = False, log_enforce: bool = False) -> bool:
    """Whether validation fails: any diagnostic, any structural log problem; deviations and log order only if enforced."""
    if not diagnostics.isEmpty():
        return True
    if log_problems is not None and not log_problems.where(F.lit(True) if log_enforce else F.col("structural")).isEmpty():
        return True
    return profile_enforce and deviations is not None and not deviations.isEmpty()
