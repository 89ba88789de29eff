"""The bundle data source: slices, pruned columns and paths, and writes that happen whole or not at all."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringStartsWith
from pyspark.sql.types import StructType

from bundlespark.operators import index
from bundlespark.operators.concepts import project
from bundlespark.sources import bundle, bundle_source
from bundlespark.sources.bundle_source import STAGING, BundleReader, BundleWriter, Files, PruningReader


def put(root, files):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text, encoding="utf-8")


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(root) for f in fs}


@pytest.fixture
def wide(tmp_path):
    put(tmp_path, {f"d{i % 7}/e{i % 3}/_c{i}.md": f"---\ntype: T\nn: {i}\n---\n\n[x](/y{i}.md)\n" for i in range(200)} | {"a.md": "", "index.md": "x", "d0/log.md": "# L\n", "d0/.hidden/h.txt": "h", f"{STAGING}/x/y.md": "no"})
    return tmp_path


def test_every_file_is_in_one_partition(spark, wide, monkeypatch):
    monkeypatch.setattr(bundle_source, "FILES_A_TASK", 9)
    for listed in (1, 3, 200):
        for what, fits in (("files", lambda p: True), ("concepts", lambda p: p.endswith(".md") and p.rsplit("/")[-1] not in ("index.md", "log.md")), ("logs", lambda p: p.endswith("log.md"))):
            reader = BundleReader({"path": str(wide), "what": what, "listed": str(listed)}, StructType.fromDDL("path string"))
            parts = reader.partitions()
            got = [p for part in parts for b in reader.read(part) for p in b.column("path").to_pylist()]
            assert sorted(got) == sorted(p for p in tree(wide) if fits(p) and not p.startswith(STAGING)) and len(parts) > 1
    assert max(sum(b.num_rows for b in reader.read(p)) for p in [Files(("",), False, s, 4) for s in range(4)]) < 200


def test_planner_lists_a_bounded_number_of_directories(wide, monkeypatch):
    seen, scan = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda at: (seen.append(at), scan(at))[1])
    BundleReader({"path": str(wide), "listed": "5"}, StructType.fromDDL("path string")).partitions()
    assert len(seen) == 5


def test_what_is_not_asked_for_is_not_done(wide, monkeypatch):
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(bundle_source.markdown, "facts", never)
    reader = BundleReader({"path": str(wide)}, StructType.fromDDL("source_path string, json string"))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["source_path"]: r["json"] for r in rows}["d1/e1/_c1.md"] == '{"type":"T","n":1}'
    monkeypatch.setattr("builtins.open", never)
    assert sum(b.num_rows for p in reader.partitions() for b in BundleReader({"path": str(wide)}, StructType.fromDDL("source_path string")).read(p)) == 201


def test_paths_are_pruned(wide):
    reader = PruningReader({"path": str(wide)}, StructType.fromDDL("source_path string"))
    assert list(reader.pushFilters([StringStartsWith(("source_path",), "d1/e1"), EqualTo(("other",), 3)]))
    assert {p.at for p in reader.partitions()} == {("", "d1/e1")}


def test_through_spark(spark, wide):
    c = bundle.scan(spark, str(wide), columns="source_path string, links array<string>")
    assert c.where(F.col("source_path").startswith("d1/")).count() == 29
    assert bundle.read(spark, str(wide), facts=False).where("concept_id = 'd1/e1/_c1'").first()["type"] == "T"
    assert "links" not in bundle.read(spark, str(wide), facts=False).columns
    plan = bundle.read(spark, str(wide))._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "LocalTableScan" not in plan and "InMemory" not in plan
    assert bundle.directories(spark, str(wide)).count() == 7 + 21 + 1


def test_failfast_names_the_smallest_path(spark, tmp_path):
    put(tmp_path, {"m/x.md": "---\n[", "b/y.md": "---\nno end", "b/a.md": "", "z/-q.md": ""})
    with pytest.raises(bundle.BundleError, match="^b/y.md: "):
        bundle.read(spark, str(tmp_path))
    with pytest.raises(bundle.BundleError, match="^z/-q.md: "):
        os.remove(tmp_path / "m/x.md")
        os.remove(tmp_path / "b/y.md")
        bundle.read(spark, str(tmp_path))


def test_titles_of_logs(spark, tmp_path):
    put(tmp_path, {"a/log.md": "# Own\n", "a/x.md": "", "b/c/y.md": "", "d/z.txt": ""})
    assert dict(map(tuple, bundle.log_titles(spark, str(tmp_path)).collect())) == {"a/log.md": "Own", "b/c/log.md": "b/c Update Log", "log.md": "Bundle Update Log"}


def batch(**files):
    return pa.RecordBatch.from_pydict({"source_path": list(files), "text": list(files.values())})


def test_only_attempts_that_count_are_seen(tmp_path):
    put(tmp_path, {"a": "old", "foreign/f": "f"})
    writer = BundleWriter(str(tmp_path))
    lost = writer.write(iter([batch(a="half")]))
    kept = writer.write(iter([batch(a="new"), batch(b=None)]))
    assert tree(tmp_path)["a"] == "old" and lost.folder != kept.folder
    writer.commit([kept, None])
    assert tree(tmp_path) == {"a": "new", "b": "", "foreign/f": "f"} and not os.path.exists(tmp_path / STAGING)


def test_a_failed_write_leaves_the_bundle_whole(spark, tmp_path):
    put(tmp_path, {"k0/x.md": "old", "foreign.txt": "f"})
    before = tree(tmp_path)
    text = F.when(F.col("id") == 900, F.raise_error(F.lit("killed"))).otherwise(F.concat(F.lit("new "), F.col("id").cast("string")))
    files = spark.range(0, 1000, 1, 4).select(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"), F.lit("/x"), F.when(F.col("id") == 0, "").otherwise(F.col("id").cast("string")), F.lit(".md")).alias("source_path"), text.alias("text"))
    with pytest.raises(Exception, match="killed"):
        bundle.write_texts(files, str(tmp_path))
    assert tree(tmp_path) == before
    bundle.write_texts(files.where("source_path <> 'k0/x900.md'"), str(tmp_path))
    after = tree(tmp_path)
    assert len(after) == 1000 and after["foreign.txt"] == "f" and after["k0/x.md"] == "new 0"


def test_a_commit_that_was_cut_off_is_finished(tmp_path, monkeypatch):
    writer = BundleWriter(str(tmp_path))
    done = [writer.write(iter([batch(**{"d/a": "1", "b": "2"})])), writer.write(iter([batch(c="3")]))]
    replace, moved = os.replace, []

    def dies(a, b):
        if os.path.basename(b) != "committed" and len(moved) == 1:
            raise OSError("cut off")
        moved.append(b) if os.path.basename(b) != "committed" else None
        replace(a, b)

    monkeypatch.setattr(bundle_source, "MOVERS", 1)
    monkeypatch.setattr(os, "replace", dies)
    with pytest.raises(OSError, match="cut off"):
        writer.commit(done)
    monkeypatch.setattr(os, "replace", replace)
    unrecorded = tmp_path / STAGING / "other" / "f"
    unrecorded.mkdir(parents=True)
    bundle_source.recover(str(tmp_path))
    assert {k: v for k, v in tree(tmp_path).items()} == {"d/a": "1", "b": "2", "c": "3"} and unrecorded.exists()
    assert json.dumps(sorted(os.listdir(tmp_path / STAGING))) == '["other"]'


@pytest.mark.parametrize("path", ["../x", "/etc/x", "a/../../x", "."])
def test_no_path_leaves_the_bundle(tmp_path, path):
    writer = BundleWriter(str(tmp_path))
    with pytest.raises((ValueError, IsADirectoryError)):
        writer.write(iter([batch(**{path: "x"})]))


def test_overwriting_is_refused(spark, tmp_path):
    bundle._register(spark)
    with pytest.raises(Exception, match="mode append"):
        spark.createDataFrame([("a", "b")], "source_path string, text string").write.format("bundle").mode("overwrite").save(str(tmp_path))


def test_index_of_a_directory_that_many_tasks_write(spark, tmp_path):
    n = 20_000
    fm = F.parse_json(F.format_string('{"type":"T%d","title":"t%d"}', F.col("id") % 2, F.col("id")))
    at = F.when(F.col("id") % 50 == 0, F.concat(F.lit("few/d"), F.col("id") % 7)).otherwise("big")
    c = spark.range(n).select(F.concat_ws("/", at, F.col("id").cast("string")).alias("concept_id"), fm.alias("fm"), F.lit("").alias("body"))
    c = project(c.withColumn("source_path", F.concat("concept_id", F.lit(".md"))))
    want = {os.path.join(r.dir, "index.md"): r.text for r in index.render(c, version="0.2").collect()}
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bundle.write_index_lines(index.lines(c, version="0.2"), str(tmp_path / "b"))
        dealt = index.lines(c).repartitionByRange(*index.ORDER).where("dir = 'big'").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert tree(tmp_path / "b") == want and dealt > 1 and not os.path.exists(tmp_path / "b" / STAGING)


def test_pieces_hold_one_line_at_a_time(tmp_path):
    names = ["dir", "rank", "type", "step", "name", "text"]
    batch = lambda *rows: pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    given = [batch(("a", 3, "T", 0, "", "# T\n\n"), ("a", 3, "T", 1, "x", "- é\n")), batch(("a", 3, "T", 1, "y", "- y\n"), ("b", 3, "T", 0, "", "# T\n\n"))]
    made = [r for b in bundle_source.pieces_of(given, str(tmp_path)) for r in b.to_pylist()]
    assert [(r["dir"], open(r["piece"], encoding="utf-8").read()) for r in made] == [("a", "# T\n\n- é\n- y\n"), ("b", "# T\n\n")]
