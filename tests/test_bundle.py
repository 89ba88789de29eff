"""Small bundles on disk, with exact expected rows."""

import pytest
from pyspark.sql import functions as F

from bundlespark.functions.ids import Gate
from bundlespark.operators import computations, concepts, filters, graph, handles, index, logs, provenance, trust, validate
from bundlespark.sources import bundle

#: A harbour: boats with hull numbers, quays, a table of tides.
FILES = {
    "index.md": '---\nokf_version: "0.2"\n---\n',
    "log.md": "# Harbour\n\n## 2031-03-04\n\n* **Survey**: sounded\n\n## 2031-03-09\n\n* dredged\n",
    "boats/log.md": "# Boats\n\n## 2031-05-20\n\n* hauled out\n",
    "quays/log.md": "# Nothing yet\n",
    "boats/heron.md": "---\ntype: Boat\ntitle: Heron\nhull: HB-14\nstatus: moored\ntags: [wood, sail, day]\ngenerated: {by: process:census, at: 2031-05-02T08:00:00Z}\nrepairs:\n- {part: mast, result: kept}\n- {part: keel, result: replaced}\n"
                      "sources:\n- {title: hearsay}\n- {id: deed, resource: /deeds/14.txt, usage_count: 8, author: human:iva}\nusage_window: {to: 2031-06-30}\n---\n\nLies at [the quay](../quays/north.md), beside [Tern](/boats/tern.md#mooring); the [quay](/quays/north.md) again. Sister of [a wreck](wreck.md).[^chart]\n",
    "boats/skua.md": "---\ntype: Boat\ntitle: Skua\nhull: HB-15\nstatus: scrapped\nsold: 2030-01-01\ngenerated: {by: process:census}\nrepairs: {part: hull, result: kept}\nverified:\n- {at: '2032-01-01'}\n- {by: process:scan, at: '2031-02-03'}\n---\n",
    "boats/tern.md": "---\ntype: Boat\ntitle: Tern\nhull: HB-15\nstatus: at sea\ntags: sail\nverified: {by: human:iva, at: '2031-01-01'}\nstale_after: 2031-04-01\ngenerated: {by: human:iva, at: 2031-06-01}\n---\n\nout\n",
    "quays/north.md": "---\r\ntype: Quay\r\ntitle: North\r\ngenerated: {by: human:iva, at: 2031-03-30}\r\ndepth: 7\r\n---\r\n\r\nstone\r\n",
    "_plans/tide.md": "---\ntype: Attested Computation\nruntime: duck\nparameters:\n- {name: port, type: string, required: true}\nexecutor: {resource: tools/tide.py}\n---\n\n# Computation\n\n```sql\nselect 2\n```\n",
    "tools/tide.py": "pass\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("bundle")
    for p, text in FILES.items():
        (top / p).parent.mkdir(parents=True, exist_ok=True)
        (top / p).write_bytes(text.encode())
    return str(top)


@pytest.fixture(scope="module")
def c(spark, root):
    return bundle.read(spark, root).cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("equals,has,missing,want", [
    ([], [], [], ["_plans/tide", "boats/heron", "boats/skua", "boats/tern", "quays/north"]),
    (["status=at sea"], [], [], ["boats/tern"]), (["tags=sail"], [], [], ["boats/heron", "boats/tern"]), (["repairs.result=kept"], [], [], ["boats/heron", "boats/skua"]), (["repairs.part=keel"], [], [], ["boats/heron"]),
    (["generated.by=process:census"], [], [], ["boats/heron", "boats/skua"]), ([], [], ["generated"], ["_plans/tide"]), ([], ["sold"], [], ["boats/skua"]), (["hull=HB-99"], [], [], []),
    (["hull=HB-14", "hull=HB-15"], [], [], ["boats/heron", "boats/skua", "boats/tern"]), (["type=Boat", "tags=wood"], [], [], ["boats/heron"]), ([], ["sold"], ["sold"], []), (["depth=7"], [], [], ["quays/north"]), (["status=stable"], [], [], [])])
def test_filters(c, equals, has, missing, want):
    some = [*map(filters.parse_equals, equals), *map(filters.present, has), *map(filters.absent, missing)]
    assert [r[0] for r in rows(filters.listing(c, some))] == want


def test_listing(c):
    assert rows(filters.listing(c, [filters.of_type("Boat")], ["repairs.part", "tags", "sold"])) == [
        ("boats/heron", "Boat", "mast, keel", "wood, sail, day", "-", "Heron"), ("boats/skua", "Boat", "hull", "-", "2030-01-01", "Skua"), ("boats/tern", "Boat", "-", "sail", "-", "Tern")]


def test_graph(c):
    assert rows(graph.edges(c)) == [("boats/heron", "boats/tern"), ("boats/heron", "quays/north")]
    assert rows(graph.dangling(c)) == [("boats/heron", 3, "boats/wreck")]
    assert [r[0] for r in rows(graph.nodes(c))] == sorted(r[0] for r in rows(c.select("concept_id")))
    import json

    whole = json.loads(graph.document(c))
    assert [e["target"] for e in whole["edges"]] == ["boats/tern", "quays/north"] and len(whole["nodes"]) == 5


def test_edges_sort_by_segments(spark):
    some = spark.createDataFrame([("a-b/x", "a-b/x.md", ["/t.md"]), ("a/x", "a/x.md", ["/t.md"]), ("t", "t.md", [])], "concept_id string, source_path string, links array<string>")
    assert [r[0] for r in rows(graph.edges(some))] == ["a/x", "a-b/x"]


def test_trust(c):
    assert rows(trust.report(c, "2031-04-01")) == [
        ("_plans/tide", "unverified", "stable", "ok"), ("boats/heron", "unverified", "moored", "ok"), ("boats/skua", "machine-confirmed", "scrapped", "ok"),
        ("boats/tern", "human-reviewed", "at sea", "stale since 2031-04-01"), ("quays/north", "unverified", "stable", "ok")]
    assert rows(c.where("concept_id = 'boats/skua'").select(trust.latest(c.verified))) == [("2031-02-03",)]


def test_sources_and_computations(c):
    assert rows(provenance.report(c)) == [("boats/heron", 0, "deed", "/deeds/14.txt", "author human:iva, used 8 times until 2031-06-30")]
    assert rows(computations.report(c)) == [("_plans/tide", "duck", "port (string, required)", "inline", "executor")]


def test_logs(spark, root, c):
    found = bundle.read_logs(spark, root)
    assert [tuple(r)[2:3] + tuple(r)[0:2] for r in logs.check(found).collect()] == [("LogDaysOutOfOrder", "log.md", 0)]
    assert dict(rows(logs.nearest(c, found))) == {"_plans/tide": "log.md", "boats/heron": "boats/log.md", "boats/skua": "boats/log.md", "boats/tern": "boats/log.md", "quays/north": "quays/log.md"}
    assert rows(logs.stale(c, found)) == [("boats/tern", "2031-06-01", "boats/log.md", "2031-05-20"), ("quays/north", "2031-03-30", "quays/log.md", None)]
    assert {r[0] for r in rows(logs.stale(c, found.limit(0)))} == {"quays/north", "boats/heron", "boats/tern"}
    more = logs.append(logs.append(found, "boats/log.md", "2031-06-02", "launched"), "quays/log.md", "2031-01-01", "built", None)
    assert {r[0]: r[1] for r in rows(logs.serialize(more))} == {
        "boats/log.md": "# \n\n## 2031-06-02\n* **Update**: launched\n\n## 2031-05-20\n* hauled out\n", "quays/log.md": "# \n\n## 2031-01-01\n* built\n",
        "log.md": "# \n\n## 2031-03-04\n* **Survey**: sounded\n\n## 2031-03-09\n* dredged\n"}
    assert {r[0]: r[1] for r in rows(logs.serialize(found))}["quays/log.md"] == "# \n" and logs.days(found).count() == 3
    changed = spark.createDataFrame([("boats/tern.md",), ("quays/north.md",), ("quays/log.md",)], "path string")
    assert rows(logs.drift(c, found, changed)) == [("boats/tern", "boats/log.md")]


def test_handles(c):
    assert [(r[0], int(r[1]), r[2]) for r in rows(handles.in_bundle(c, "hull"))] == [("HB", 14, "boats/heron"), ("HB", 15, "boats/skua"), ("HB", 15, "boats/tern")]
    assert [int(r[1]) for r in rows(handles.next_number(c, "hull", "HB"))] == [16] and [int(r[1]) for r in rows(handles.next_number(c, "hull", "Q"))] == [1]
    assert rows(handles.duplicates(c, "hull")) == [("HB-15", "boats/skua", "boats/tern")]
    assert rows(handles.observed_prefixes(c)) == [("HB",)]


def test_resolve(c):
    assert concepts.resolve(c, "boats/heron").first().title == "Heron" and concepts.resolve(c, " HB-14").first().title == "Heron"
    for bad in ("HB-15", "HB-1"):
        with pytest.raises(LookupError):
            concepts.resolve(c, bad)


def test_validate(spark, root, c):
    permissive = rows(validate.validate(c, bundle.inventory(spark, root)).select("concept_id", "code", "detail"))
    assert permissive == [("boats/tern", "FieldMustBeListOfText", "tags"), ("boats/heron", "DanglingReference", "boats/wreck")]
    strict = rows(validate.validate(c, bundle.inventory(spark, root), strict=True, version="0.2").select("concept_id", "code", "detail"))
    of = lambda i: [(code, detail) for k, code, detail in strict if k == i]
    assert of("boats/heron") == [("MissingRecommendedField", "description"), ("SourceMissingResource", "0"), ("FootnoteLabelNotInSources", "chart"), ("SourceIdNotCited", "deed"), ("DanglingReference", "boats/wreck")]
    assert of("_plans/tide") == [("MissingRecommendedField", "title"), ("MissingRecommendedField", "description"), ("MissingGeneratedField", ""), ("DanglingFrontmatterPath", "executor.resource -> _plans/tools/tide.py (did you mean /tools/tide.py)")]
    assert validate.failed(validate.validate(c)) and not validate.failed(validate.validate(c.where("concept_id = 'quays/north'")))


def test_one_pass_over_the_bodies(c):
    plan = validate.validate(c, strict=True, version="0.2", ordered=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(") <= 2 and not any(w in plan for w in ("Cartesian", "Cross"))


def test_versions(spark, root, c):
    assert bundle.declared_version(root) == "0.2" and Gate("0.2").at_least(0, 2)
    assert [r.code for r in validate.validate(c.limit(0), strict=True, version="7.1").collect()] == ["BundleVersionNotUnderstood"]
    assert [r.code for r in validate.validate(c.limit(0), strict=True, version="x").collect()] == ["BundleVersionUnparseable"]


def test_index(spark, root, c):
    empty = spark.createDataFrame([("boats",), ("sheds",), ("sheds/old",)], "dir string")
    made = dict(rows(index.render(c, bundle.inventory(spark, root), "0.2", empty)))
    assert made["quays"] == "# Quay\n\n- [North](north.md)\n\n" and made["tools"] == "# Files\n\n- [tide.py](tide.py)\n\n"
    assert made[""] == '---\nokf_version: "0.2"\n---\n\n# Subdirectories\n\n' + "".join(f"- [{d}/]({d}/index.md)\n" for d in ("_plans", "boats", "quays", "sheds", "tools")) + "\n"
    assert made["sheds"] == "# Subdirectories\n\n- [old/](old/index.md)\n\n" and made["sheds/old"] == "\n"
    texts = {}
    for r in index.lines(c, bundle.inventory(spark, root), "0.2", empty).orderBy(*index.ORDER).collect():
        texts[r.dir] = texts.get(r.dir, "") + r.text
    assert texts == made


def test_round_trip(spark, c, tmp_path):
    bundle.write(c, str(tmp_path))
    again = bundle.read(spark, str(tmp_path))
    pick = lambda df: sorted(rows(df.selectExpr("concept_id", "to_json(fm)")))
    assert pick(again) == pick(c)
    first = {p.relative_to(tmp_path): p.read_bytes() for p in tmp_path.rglob("*.md")}
    bundle.write(again, str(tmp_path))
    assert first == {p.relative_to(tmp_path): p.read_bytes() for p in tmp_path.rglob("*.md")}


def test_errors(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntype: T\n---\n")
    (tmp_path / "b.md").write_text("---\ntype: T\n")
    (tmp_path / "-bad.md").write_text("x")
    with pytest.raises(bundle.BundleError, match="-bad.md"):
        bundle.read(spark, str(tmp_path))
    kept = {r.source_path: r.error for r in bundle.read(spark, str(tmp_path), "PERMISSIVE").collect()}
    assert kept["a.md"] is None and kept["b.md"] and kept["-bad.md"]


def test_empty_bundle(spark, tmp_path):
    c = bundle.read(spark, str(tmp_path))
    assert c.count() == 0 and graph.edges(c).count() == 0 and validate.validate(c, strict=True).count() == 0 and bundle.read_logs(spark, str(tmp_path)).count() == 0


def test_discovery(tmp_path):
    for p, text in {"a/index.md": "", "a/deep/index.md": "", "b/c/x.md": "---\ntype: T\n---\n", "d/readme.md": "hi", ".hidden/index.md": "", "node_modules/index.md": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    assert bundle.discover(str(tmp_path)) == [str(tmp_path / "a"), str(tmp_path / "b/c")]
    assert bundle.available(f"{tmp_path}/b:{tmp_path}:") == [str(tmp_path / "a"), str(tmp_path / "b/c")]


def test_show(spark, root, c):
    from bundlespark.operators import show

    got = {r.label: r.value for r in show.detail(c, "HB-14", "2031-10-01").collect()}
    assert got["id"] == "boats/heron" and got["trust"] == "unverified" and got["generated"] == "process:census at 2031-05-02T08:00:00Z" and got["source"].startswith("deed /deeds/14.txt author human:iva")
    have = bundle.inventory(spark, root)
    assert show.computation(c, "_plans/tide", have) == ("inline", "select 2\n")
    with pytest.raises(LookupError, match="no computation"):
        show.computation(c, "HB-14", have)
    assert [r.concept_id for r in show.menu(c, "id").collect()][0] == "_plans/tide" and show.menu(c).count() == 5


def test_commands(spark, root, capsys, tmp_path):
    import json
    import shutil
    import subprocess

    from bundlespark.__main__ import main

    said = lambda *a: (main(list(a)), capsys.readouterr().out)
    assert said("concepts", root, "--where", "status=moored", "--show", "tags") == (0, "boats/heron\tBoat\twood, sail, day\tHeron\n")
    assert said("validate", root)[0] == 1 and said("show", root, "HB-1")[0] == 1 and said("show", root, "--sort", "id")[1].startswith("_plans/tide")
    assert said("id", root, "HB", "--key", "hull")[1].strip().endswith("16") and said("bundles", root, "--prefixes") == (0, f"{root}\tHB\n")
    own = str(tmp_path / "harbour")
    shutil.copytree(root, own)
    git = lambda *a: subprocess.run(["git", "-C", own, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-q", "-m", "x")
    assert said("log", own, "--add", "painted", "--concept", "quays/north", "--date", "2031-04-02", "--kind", "Care") == (0, "wrote quays/log.md for 2031-04-02\n")
    with open(f"{own}/quays/log.md", encoding="utf-8") as f:
        assert f.read() == "# Nothing yet\n\n## 2031-04-02\n* **Care**: painted\n"
    for name in ("boats/tern.md", "quays/north.md"):
        with open(f"{own}/{name}", "a", encoding="utf-8") as f:
            f.write("more\n")
    assert said("log", own, "--since", "HEAD") == (0, "boats/tern\tboats/log.md\n") and said("log", own, "--since", "nothing-such")[0] == 0
    shutil.rmtree(f"{own}/boats")
    assert "OK: 2 concepts, version 0.2" in said("validate", own)[1].splitlines()
    (tmp_path / "p.json").write_text(json.dumps({"name": "tides", "description": "of\n the harbour", "frontmatter": {"required": [{"field": "port"}]}, "types": [{"type": "Quay", "idPrefix": "Q"}]}))
    registry = ["--registry", str(tmp_path / "p.json")]
    code, text = said("profile", "list", "--wide", *registry)
    assert code == 0 and text.splitlines()[1].split()[1:] == ["(root)", "tides", "0.2", "1", "-"] and text.splitlines()[2] == "  of the harbour"
    code, text = said("profile", "show", "tides", *registry)
    assert code == 0 and "  - `port` (required)" in text.splitlines() and "type: Quay" in text.splitlines() and said("profile", "show", "none", *registry)[0] == 1
    assert said("profile", "sources", *registry) == (0, registry[1] + "\n")


def test_markdown_in_linear_time():
    import time

    from bundlespark.sources import markdown

    began = time.time()
    for text in ("[" * 100_000, "[a](/b.md) " * 10_000, "`" * 100_000, "> " * 50_000, "[a](" * 25_000, "[[a]" * 25_000):
        markdown.facts(text + " schema computation [^x]")
    assert time.time() - began < 20


def test_markdown_blocks_and_entities():
    from bundlespark.sources import markdown

    assert markdown.links("<table>\n[a](a.md)\n</table>\n\n[b](b.md?x=1&amp;y) <!-- [c](c.md) -->\n\n<!--\n[d](d.md)\n\n[e](e.md)\n-->\n\n[f](f&#46;md)\n") == ["b.md?x=1&y", "f.md"]


# -- nearest logs, lists held by one concept ------------------------------------------------


def lookup(paths, logs_at):
    def one(p):
        at = p.split("/")[:-1]
        return next((d + "/log.md" if d else "log.md" for n in range(len(at), -1, -1) if (d := "/".join(at[:n])) in logs_at), None)

    return {p[:-3]: one(p) for p in paths}


@pytest.mark.parametrize("most", [200_000, 0])
@pytest.mark.parametrize("root", [True, False])
def test_nearest_logs(spark, monkeypatch, most, root):
    """By a trie, and by joins over directories where it is too large."""
    import random

    monkeypatch.setattr(logs, "TRIE_LOGS", most)
    monkeypatch.setattr(logs, "SALTS", 3)
    r = random.Random(3)
    paths = ["/".join([r.choice("abc") + r.choice(["", "x"]) for _ in range(r.randint(0, 7))] + [f"c{i}.md"]) for i in range(300)]
    at = {"/".join(p.split("/")[:r.randint(1, 4)]) for p in r.sample(paths, 25)} - {p for p in paths} - {""} | ({""} if root else set())
    at = {d for d in at if not d.endswith(".md")}
    c = spark.createDataFrame([(p[:-3], p) for p in paths], "concept_id string, source_path string")
    held = spark.createDataFrame([(d + "/log.md" if d else "log.md",) for d in sorted(at)], "log_path string")
    assert dict(map(tuple, logs.nearest(c, held).collect())) == lookup(paths, at)
    assert dict(map(tuple, logs.nearest(c, held.limit(0)).collect())) == dict.fromkeys(p[:-3] for p in paths)


def test_one_root_log_is_no_hot_key(spark):
    c = spark.range(1000).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("concept_id")).withColumn("source_path", F.concat("concept_id", F.lit(".md")))
    plan = logs.nearest(c, spark.createDataFrame([("log.md",)], "log_path string"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("Exchange hashpartitioning(concept_id") == 1


def test_concepts_that_share_an_id_keep_their_lists(spark):
    rows = [("a/b", '{"xs":[{"n":"x"}]}'), ("a/b", '{"xs":[{"n":"x"}]}'), ("c", '{"xs":[{"n":"y"},{"n":1},{"n":"y"},3,{"n":1.0},{"n":" "},{"n":" "}]}'), ("d", "{}")]
    c = spark.createDataFrame(rows, "concept_id string, j string").select("concept_id", F.parse_json("j").alias("fm"))
    found = handles.unique_values(c, "xs", "n")
    assert [tuple(r) for r in found.collect()] == [("c", "y", [0, 2]), ("c", "1", [1, 4])]
    many = spark.range(1).select(F.lit("z").alias("concept_id"), F.parse_json(F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(49_999)), lambda n: F.struct((n % 25_000).alias("n"))).alias("xs")))).alias("fm"))
    assert handles.unique_values(many, "xs", "n").count() == 25_000
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
