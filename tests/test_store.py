"""The stored corpus: the same rows as from VARIANT alone, and filters that reach the scan."""

import json
import random

import pytest
from pyspark.sql import functions as F

from bundlespark.operators import filters
from bundlespark.operators.concepts import project
from bundlespark.sources import store

KEYS = ("type", "title", "n", "tags", "p.q")


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    r = random.Random(5)
    scalar = [None, "a", "b", "1", 1, 1.0, 1.5, True, False, "true", "", " a ", "null", 10**30]
    value = lambda: r.choice([*scalar, [], {}, [r.choice(scalar)], [r.choice(scalar), r.choice(scalar), ["a"], {"q": "a"}], {"q": r.choice(scalar)}, {"q": [r.choice(scalar), "b"]}, [{"q": r.choice(scalar)}, 3, {"q": ["a"]}], [{"z": 1}], [[]]])
    rows = [{k: value() for k in ("type", "title", "n", "tags", "p", "other") if r.random() < 0.8} for _ in range(400)]
    c = spark.createDataFrame([(f"c/{i}", f"c/{i}.md", json.dumps(x), "") for i, x in enumerate(rows)], "concept_id string, source_path string, j string, body string")
    c = project(c.withColumn("fm", F.parse_json("j")).drop("j"))
    at = f"file://{tmp_path_factory.mktemp('store')}/s"
    store.save(c, at, KEYS)
    return c, store.load(spark, at)


def ids(df):
    return sorted(r[0] for r in df.select("concept_id").collect())


@pytest.mark.parametrize("key", [*KEYS, "other", "p", "type.q", "p.z"])
def test_every_filter_as_from_the_variant(both, key):
    c, stored = both
    asked = [[filters.parse_equals(f"{key}={v}")] for v in ("a", "1", "true", "", "null", "1.5", "1" + "0" * 30)] + [[filters.present(key)], [filters.absent(key)], [filters.parse_equals(f"{key}=a"), filters.parse_equals(f"{key}=b"), filters.present("title")]]
    every = lambda df, choose: [ids(choose(df, f)) for f in asked]
    assert every(stored, store.where) == every(c, filters.where)


def test_listings_and_views(both):
    c, stored = both
    shown = ["tags", "p.q", "n", "other"]
    wanted = [filters.present("tags")]
    assert store.listing(stored, wanted, shown).collect() == filters.listing(c, wanted, shown).collect()
    assert sorted(map(str, store.projected(stored).select("concept_id", "type", "title", "tags", "status").collect())) == sorted(map(str, c.select("concept_id", "type", "title", "tags", "status").collect()))


def test_filters_reach_the_scan_and_bodies_are_not_read(both):
    _, stored = both
    plan = store.where(stored, [filters.parse_equals("type=a"), filters.present("n")]).select("concept_id")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PushedFilters"):]
    assert "Or(EqualTo(`text:type`,a),EqualTo(`kind:type`,many))" in scan
    assert "kind:n" in scan and "fm" not in scan[scan.index("ReadSchema"):] and "body" not in scan[scan.index("ReadSchema"):]


def test_row_groups_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROW_GROUP", 64 << 10)
    kinds = F.concat(F.lit("T"), (F.col("id") % 50).cast("string"))
    c = spark.range(40_000).select(F.concat(F.lit("c/"), F.col("id").cast("string")).alias("concept_id"), F.lit("x.md").alias("source_path"), F.parse_json(F.concat(F.lit('{"type":"'), kinds, F.lit('"}'))).alias("fm"), F.sha2(F.col("id").cast("string"), 512).alias("body"))
    store.save(c.coalesce(1), f"file://{tmp_path}/s", ("type",))
    found = store.where(store.load(spark, f"file://{tmp_path}/s"), [filters.parse_equals("type=T7")]).select("concept_id", "body")
    assert len(found.collect()) == 800
    plan = found._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    while plan.children().size():
        plan = plan.children().head()
    assert 800 <= plan.metrics().apply("numOutputRows").value() < 10_000
