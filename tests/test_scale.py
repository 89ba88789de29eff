"""What keeps queries in proportion to their input and on all cores: tasks that have rows, work done once and only where it is wanted."""

import pytest
from pyspark.sql import functions as F

from bundlespark.plans import catalogue, more_queries  # noqa: F401
from bundlespark.sources import carriers


def dealt(df):
    """Rows of each task."""
    return [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]


def notes_are_dealt_out(spark, sf, name):
    """A few parts to a file are one row group, yet every core reads some of the Markdown."""
    df = catalogue.QUERIES[name](spark, sf)
    assert df._jdf.queryExecution().toRdd().getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert len(dealt(df)) >= spark.sparkContext.defaultParallelism


def test_links_are_dealt_out(spark, sf):
    notes_are_dealt_out(spark, sf, "markdown_links")


def test_tasks_without_row_groups_do_not_count_as_cores(spark, tmp_path):
    at = f"{tmp_path}/wide"
    spark.range(50_000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 512), 2).alias("x")).coalesce(1).write.parquet(at)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = spark.read.parquet(at)
        assert df._jdf.queryExecution().toRdd().getNumPartitions() >= spark.sparkContext.defaultParallelism > len(dealt(df))
        assert len(dealt(carriers.spread(df))) >= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def only_reads(spark, sf, name, reader, monkeypatch):
    from bundlespark.plans import more_queries as m

    for other in {"with_facts", "with_links", "with_footnotes"} - {reader}:
        monkeypatch.setattr(m.markdown, other, lambda df, other=other: pytest.fail(f"{name} uses {other}"))
    catalogue.QUERIES[name](spark, sf)


def test_footnotes_only(spark, sf, monkeypatch):
    only_reads(spark, sf, "footnote_labels", "with_footnotes", monkeypatch)
    notes_are_dealt_out(spark, sf, "footnote_labels")


def test_nested_links_only(spark, sf, monkeypatch):
    only_reads(spark, sf, "markdown_nested_links", "with_links", monkeypatch)
    notes_are_dealt_out(spark, sf, "markdown_nested_links")


def test_computation_reads_one_body(spark, sf):
    """The id is looked for below whatever reads Markdown."""
    from bundlespark.operators import concepts, show

    have = spark.createDataFrame([("sql/q.sql",)], "path string")
    bare = carriers.parts(spark, sf, facts=False).withColumn("computation", F.lit(None).cast("string"))
    assert show.computation(bare, "computations/7", have) == show.computation(carriers.parts(spark, sf).withColumn("computation", F.lit(None).cast("string")), "computations/7", have)
    assert "Python" not in concepts.resolve(bare, "computations/7")._jdf.queryExecution().executedPlan().toString()


def test_handles_are_looked_for_in_the_text_first(spark):
    from bundlespark.operators import concepts

    rows = [("a", '{"x": "  IR-1 "}'), ("b", '{"x": ["IR-1"]}'), ("c", '{"IR-1": "y"}'), ("d", '{"x": "IR-12", "y": 1}'), ("e", '{"x": "a\\"b"}'), ("f", None)]
    c = spark.createDataFrame(rows, "concept_id string, j string").select("concept_id", F.parse_json("j").alias("fm"))
    found = lambda raw: sorted(r[0] for r in concepts.find_by_handle(c, raw).select("concept_id").collect())
    assert [found(x) for x in ("IR-1", "IR-12", 'a"b', "none", "1")] == [["a"], ["d"], ["e"], [], []]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan(concepts.find_by_handle(c, "IR-1")) and "Contains(" not in plan(concepts.find_by_handle(c, 'a"b'))
    told = plan(concepts.resolve(c, "IR-1"))
    assert 0 < told.index("= a)") < told.index("Contains(")


def test_plain_links_take_one_step(monkeypatch):
    """Links without anything special in them never wait for their bracket, and mean the same to the links around them."""
    from bundlespark.sources import inlines, markdown

    want = ["/customers/1.md", "../customers/1.md"]
    assert markdown.links("[a [b](c.md)](d.md) ![x [l](in.md)](i.png) [a](b(c).md) [^x](y.md)") == ["c.md", "in.md", "b(c).md", "y.md"]
    monkeypatch.setattr(inlines, "_Bracket", lambda *_: pytest.fail("a plain link waited"))
    assert markdown.links("For [a](/customers/1.md) and again [b](../customers/1.md).\n") == want


def planned(spark, sf, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", "2000")
    return catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_references_and_duplicates_read_concepts_twice(spark, sf):
    """Once for what they ask and once for what they own; the third time stands for repeated ids and takes the shuffle of the second."""
    assert planned(spark, sf, "profile_reference").count("Relation [") <= 6
    run = catalogue.QUERIES["profile_reference"](spark, sf)
    run.collect()
    assert "ReusedExchange" in run._jdf.queryExecution().executedPlan().toString()


def test_duplicate_handles_of_one_id(spark):
    """Two concepts of one id are duplicates of each other; the first by id is left out once only."""
    from bundlespark.plans import check, profile

    c = profile.compile_profile(profile.load('{"name": "p", "okfVersion": "0.2", "idField": "id", "allowUnknownTypes": true, "types": [{"type": "D", "idPrefix": "BK"}]}'))
    rows = [("b", "BK-1"), ("a", "BK-1"), ("a", "BK-1"), ("a", "BK-1"), ("c", " "), ("d", "x y"), ("e", "x y"), ("f", None), ("g", "BK-2")]
    some = spark.createDataFrame(rows, "concept_id string, h string").select("concept_id", F.concat("concept_id", F.lit(".md")).alias("source_path"), F.lit("N").alias("type"), F.parse_json(F.to_json(F.struct(F.col("h").alias("id")))).alias("fm"))
    found = check.check(some, c).where("phase = 3").select("concept_id", "code", "path", "detail", "ord").collect()
    assert sorted(map(tuple, found)) == [(x, "DuplicateDocumentId", "id", d, 0) for x, d in (("a", "BK-1 also on a"), ("a", "BK-1 also on a"), ("b", "BK-1 also on a"), ("e", "x y also on d"))]


@pytest.mark.parametrize("name,members", [("profile_unique_by", "flag"), ("profile_nested", "flag,qty")])
def test_records_are_opened_at_once(spark, sf, name, members):
    """What rules ask of a list's records comes from one cast, and nothing that is named often is the first of a transformed array."""
    plan = planned(spark, sf, name)
    fields = ",".join(f"StructField({m},VariantType,true)" for m in members.split(","))
    assert f"ArrayType(StructType({fields}),true)" in plan and "transform(array(" not in plan and "map<" not in plan


def test_records_of_odd_keys(spark):
    """Keys that differ in case only, keys with marks, elements that are no records, null elements, null members."""
    import json

    from bundlespark.plans import check, profile

    def found(names, value, **more):
        rules = [{"field": "l", "elementFields": {"required": [{"field": n, "cardinality": "scalar"} for n in names]}, **more}]
        c = profile.compile_profile(profile.load(json.dumps({"name": "p", "okfVersion": "0.2", "allowUnknownTypes": True, "frontmatter": {"optional": rules}})))
        some = spark.createDataFrame([("a", json.dumps({"l": value}))], "concept_id string, j string").select("concept_id", F.lit("a.md").alias("source_path"), F.lit("N").alias("type"), F.parse_json("j").alias("fm"))
        return [(r.code, r.path, r.detail) for r in check.check(some, c).collect()]

    missing = "MissingNestedProfileField"
    assert found(["x"], [{"x": 1}, 5, None, {"x": None}, {"X": 1}, [1]]) == [
        ("NestedElementNotRecord", "l[1]", "5"), ("NestedElementNotRecord", "l[2]", "null"), ("CardinalityMismatch", "l[3].x", "scalar: null"), (missing, "l[4].x", ""), ("NestedElementNotRecord", "l[5]", "[1]")]
    assert found(["x", "X"], [{"x": 1}, 5, {"X": 1}]) == [(missing, "l[0].X", ""), ("NestedElementNotRecord", "l[1]", "5"), (missing, "l[2].x", "")]
    assert found(["a.b`c"], [{"a.b`c": 1}, {"a": {"b`c": 1}}]) == [(missing, "l[1].a.b`c", "")]
    assert found(["x"], [{"x": "é"}, {"x": 1.0}, {"x": 1}, {}, {"x": "é"}], uniqueBy="x") == [(missing, "l[3].x", ""), ("DuplicateNestedFieldValue", "l.x", '"é" at [0, 4]'), ("DuplicateNestedFieldValue", "l.x", "1 at [1, 2]")]


def test_link_targets_are_worked_out_once(spark, sf):
    """Neither for rows without links nor for links to no concept are targets worked out before they are."""
    from bundlespark.functions import ids

    assert planned(spark, sf, "graph_edges_dedup").count(ids.CONCEPT_ID) == 1
    assert planned(spark, sf, "dangling_links").count(ids.CONCEPT_ID) == 1


def test_edges_and_links_of_all_kinds_of_lists(spark):
    """A target linked twice is one edge; rows without links, without a list, and links that name nothing give none."""
    from bundlespark.operators import graph

    rows = [("x/a", ["/x/b.md", "b.md#q", "http://x/b.md", "../../up.md", "x.txt"]), ("x/a", ["./b.md", "no.md"]), ("x/b", []), ("x/c", None), ("x/d", ["d.md", None])]
    c = spark.createDataFrame(rows, "concept_id string, links array<string>").withColumn("source_path", F.concat("concept_id", F.lit(".md")))
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(graph.edges(c, ordered=False)) == [("x/a", "x/b"), ("x/d", "x/d")]
    assert got(graph.links_of(c)) == [("x/a", 0, "./b.md", "x/b"), ("x/a", 0, "/x/b.md", "x/b"), ("x/a", 1, "b.md#q", "x/b"), ("x/a", 1, "no.md", "x/no"), ("x/d", 0, "d.md", "x/d")]
    assert got(graph.dangling(c, ordered=False)) == [("x/a", 1, "x/no")]


def test_plain_bodies_need_no_blocks(monkeypatch):
    """Text with plain links only is read at once, and with the same links as block by block."""
    import random

    from bundlespark.sources import markdown

    bits = ["[a](b.md)", "[c d](/e.md#f)", "[g\nh](i.md)", "[^j](k.md)", "[l]: m.md", "[l]", "word", " ", "\n", "\n\n", "    ", "# ", "- ", "1. ", "a>b", "```\n", "`", "<b>", "<http://n.o>", "![p](q.png)", "*", "\\", "&amp;", "===\n", "]", "\r\n", "[r](s`t*u)", "é", "|", "~~~\n"]
    deal = random.Random(3)
    for _ in range(5_000):
        body = "".join(deal.choices(bits, k=deal.randint(1, 8)))
        assert markdown.links(body) == markdown._links(markdown.blocks(body)), body
    monkeypatch.setattr(markdown, "blocks", lambda _: pytest.fail("a plain body was cut in blocks"))
    assert markdown.links("For [a](/customers/1.md) and again [b](../customers/1.md).\n") == ["/customers/1.md", "../customers/1.md"]
    assert markdown.links("- none\n") == []


def test_paths_as_their_definitions_say(spark):
    """Byte functions against the expressions that they stand for, and folding against segments gone through one by one."""
    import itertools

    from bundlespark.functions import ids, paths, values

    texts = ["".join(x) for n in range(6) for x in itertools.product(["a", "/", "..", "."], repeat=n)] + ["".join(x) for n in range(4) for x in itertools.product(["b?", "#", "\n", "é/", " "], repeat=n)]
    texts += [chr(c) + "x" + chr(c) for c in [*range(1, 0x100), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF]] + ["  \n y z 　\r\n"]
    df, x = spark.createDataFrame([(t,) for t in texts], "x string"), F.col("x")
    kept = df.select("x", paths.collapse(x).alias("p")).collect()
    differ = df.where((ids.directory(x) != F.regexp_replace(x, r"/?[^/]*$", "")) | (paths.without_suffix(x) != F.regexp_extract(x, "^[^#?]*", 0)) | (values.strip(x) != F.regexp_replace(x, r"(?U)^\s+|\s+$", "")) | ~paths._fold(x).eqNullSafe(paths.collapse(x)))
    assert differ.collect() == []

    def folded(path):
        at = []
        for s in path.split("/"):
            if s == ".." and not at:
                return None
            at = at[:-1] if s == ".." else at if s in ("", ".") else [*at, s]
        return "/".join(at)

    assert [r["x"] for r in kept if r["p"] != folded(r["x"])] == []
