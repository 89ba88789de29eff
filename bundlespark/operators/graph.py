"""The link graph: nodes, known edges, dangling references, duplicate ids.

``links`` is an array column of raw URLs in document order, see sources.markdown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def links_of(concepts: DataFrame) -> DataFrame:
    """(source, link_pos, raw_url, target) of every link that names a concept, known or not."""
    source = F.col("source_path")
    named = F.transform("links", lambda url: F.struct(url.alias("raw_url"), paths.link_target(source, url).alias("target")))
    # Outer, and opened only then: else the optimizer asks for rows without links or targets first and works each target out twice.
    each = concepts.select(F.col("concept_id").alias("source"), F.posexplode_outer(named).alias("link_pos", "link"))
    return each.select("source", "link_pos", "link.raw_url", "link.target").where("target is not null")


def nodes(concepts: DataFrame) -> DataFrame:
    """(id, label, type, description, resource, tags) of projected concepts; the label is the title or else the id."""
    return concepts.select(F.col("concept_id").alias("id"), F.coalesce("title", "concept_id").alias("label"), "type", "description", "resource", "tags").orderBy("id")


def by_segments(*names: str) -> list[Column]:
    """Order by path segments, which differs from that by text where a segment holds '-' or '.'."""
    return [F.split(n, "/") for n in names]


def edges(concepts: DataFrame, ordered: bool = True) -> DataFrame:
    """(source, target) of links between concepts, each once; self links included."""
    known = concepts.select(F.col("concept_id").alias("target"))
    source = F.col("source_path")
    named = F.array_distinct(F.transform("links", lambda url: paths.link_target(source, url)))  # outer as in links_of
    each = concepts.select(F.col("concept_id").alias("source"), F.explode_outer(named).alias("target")).where("target is not null")
    found = each.join(known, "target", "left_semi").select("source", "target").distinct()
    return found.orderBy(*by_segments("source", "target")) if ordered else found


def dangling(concepts: DataFrame, ordered: bool = True) -> DataFrame:
    """(source, link_pos, target) of links to no concept, every occurrence."""
    known = concepts.select(F.col("concept_id").alias("target"))
    found = links_of(concepts).join(known, "target", "left_anti").select("source", "link_pos", "target")
    return found.orderBy("source", "link_pos") if ordered else found


def duplicate_ids(concepts: DataFrame) -> DataFrame:
    """(concept_id, copies) of ids that more than one concept has."""
    return concepts.groupBy("concept_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").orderBy(*by_segments("concept_id"))


def degrees(concepts: DataFrame) -> DataFrame:
    """(concept_id, out_degree, in_degree) over known edges."""
    e = edges(concepts, ordered=False)
    out = e.groupBy(F.col("source").alias("concept_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = e.groupBy(F.col("target").alias("concept_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    every = concepts.select("concept_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(out, "concept_id", "left").join(into, "concept_id", "left").select("concept_id", zero("out_degree"), zero("in_degree"))


def document(concepts: DataFrame) -> str:
    """The graph as one JSON object of nodes and edges, in report order: for a bundle whose graph fits a document."""
    parts: dict[str, list[str]] = {"nodes": [], "edges": []}
    for r in as_json(concepts).toLocalIterator():
        parts[r["part"]].append(r["json"])
    return "{" + ",".join(f'"{k}":[{",".join(v)}]' for k, v in parts.items()) + "}"


def as_json(concepts: DataFrame) -> DataFrame:
    """(part, pos, json): nodes, then edges, each object on a row of its own, in report order."""
    n = nodes(concepts).select(F.lit("nodes").alias("part"), F.split("id", "/").alias("k"), F.to_json(F.struct("id", "label", "type", "description", "resource", "tags"), {"ignoreNullFields": "false"}).alias("json"))
    e = edges(concepts).select(F.lit("edges").alias("part"), F.split(F.concat_ws("/", "source", "target"), "/").alias("k"), F.to_json(F.struct("source", "target")).alias("json"))
    return n.unionByName(e).orderBy(F.desc("part"), "k").select("part", "json")
