"""Every registered query of the library against its SQL, on the smallest tables; plans without Python where none is needed."""

import glob
import os

import duckdb
import pytest

from bundlespark.plans import catalogue, more_queries  # noqa: F401


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, sf, db, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    ran = db.execute(catalogue.SQL[name])
    have = [x[0] for x in ran.description]
    assert sorted(have) == cols
    want = sorted(tuple(str(r[have.index(c)]) for c in cols) for r in ran.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["filter_tag_any", "trust_report", "profile_required", "duplicate_handles"])
def test_plans_stay_in_the_jvm(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))


@pytest.mark.parametrize("name,scans,python,reads", [("profile_nested", 2, 0, 80), ("profile_reference", 10, 0, 90), ("sources_report", 1, 0, 40), ("validate_strict", 15, 3, 160), ("graph_edges", 6, 3, 0), ("dangling_links", 6, 3, 0)])
def test_plans_read_little_more_than_once(spark, sf, name, scans, python, reads):
    spark.conf.set("spark.sql.debug.maxToStringFields", "2000")
    run = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution()
    plan, made = run.optimizedPlan().toString(), run.executedPlan().toString()
    assert made.count("FileScan") <= scans and plan.count("ArrowEvalPython") <= python and plan.count("try_variant_get") <= reads


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).columns == ["concept_id"]
