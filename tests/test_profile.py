import json

import pytest
from pyspark.sql import functions as F

from bundlespark.operators import filters, lookup
from bundlespark.operators.concepts import project
from bundlespark.plans import check, docgen, profile, registry


def compiled(rules=None, types=(), **more):
    return profile.compile_profile(profile.load(json.dumps({"name": "p", "frontmatter": rules or {}, "types": list(types), "allowUnknownTypes": True, **more})))


def bundle(spark, docs):
    df = spark.createDataFrame([(k, k + ".md", json.dumps(fm), "") for k, fm in docs.items()], "concept_id string, source_path string, j string, body string")
    return project(df.withColumn("fm", F.parse_json("j")).drop("j")).withColumn("schema_columns", F.expr("cast(null as array<string>)"))


def deviations(spark, docs, c, **how):
    return [(r.concept_id, r.code, r.path) for r in check.check(bundle(spark, docs), c, **how).collect()]


VALUES = {"text": "x", "blank": "  ", "number": 3, "bool": True, "null": None, "list": ["a"], "empty": [], "object": {"m": 1}, "hollow": {}}
TABLE = {  # value -> any, scalar, list, object
    "missing": "AAAA", "text": "PPWW", "blank": "AAWW", "number": "APWW", "bool": "APWW", "null": "AWWW", "list": "PWPW", "empty": "AWAW", "object": "AWWP", "hollow": "AWWA"}


@pytest.mark.parametrize("at,rule", list(enumerate([{}, {"cardinality": "scalar"}, {"cardinality": "list"}, {"objectFields": {}}])))
def test_presence_table(spark, at, rule):
    docs = {k: {"type": "T", "f": v} for k, v in VALUES.items()} | {"missing": {"type": "T"}}
    found = {i: code for i, code, _ in deviations(spark, docs, compiled({"required": [{"field": "f", **rule}]}))}
    want = {"A": "MissingProfileField", "P": None, "W": "CardinalityMismatch"}
    assert {k: found.get(k) for k in docs} == {k: want[TABLE[k][at]] for k in docs}


def test_object_fields_and_element_fields_together(spark):
    sub = {"required": [{"field": "by"}]}
    c = compiled({"required": [{"field": "v", "elementFields": sub, "objectFields": sub}]})
    docs = {"a": {"v": {"by": "x"}}, "b": {"v": [{"by": "x"}, {}, 7]}, "c": {"v": {"at": "y"}}}
    assert deviations(spark, docs, c) == [("b", "MissingNestedProfileField", "v[1].by"), ("b", "NestedElementNotRecord", "v[2]"), ("c", "MissingNestedProfileField", "v.by")]


@pytest.mark.parametrize("form,good,bad", [
    ("rfc3339-utc", ["2026-01-01T00:00:00Z", "2026-01-01T00:00:00.25Z"], ["2026-01-01", "2026-13-01T00:00:00Z", 5]), ("date", ["2026-02-28"], ["2026-02-30", "2026-2-3"]),
    ("uri", ["https://e.org/x%20y"], ["https://e.org/%ZZ", "x y", "/a"]), ({"uriWithScheme": "S3"}, ["s3://b"], ["https://b"]), ({"documentHandle": "HB"}, ["HB-2"], ["AB-2", "HB-02"]),
    ("actor", ["human:a", "a/1"], ["a"]), ("human-actor", ["human:a"], ["process:a"]), ("integer", [3, -3, 12345678901234567890], [0.5, "3", True]), ("non-negative-integer", [0], [-1]), ("boolean", [True, False], ["true", 1])])
def test_formats(spark, form, good, bad):
    docs = {f"g{i}": {"f": v} for i, v in enumerate(good)} | {f"b{i}": {"f": v} for i, v in enumerate(bad)}
    assert {i for i, code, _ in deviations(spark, docs, compiled({"optional": [{"field": "f", "format": form}]})) if code == "ValueFormatMismatch"} == {f"b{i}" for i in range(len(bad))}


def test_vocabulary_over_lists(spark):
    c = compiled({"optional": [{"field": "f", "allowedValues": ["a", "b"]}]})
    assert [i for i, _, _ in deviations(spark, {"x": {"f": ["a", "b"]}, "y": {"f": ["a", "c"]}, "z": {"f": 1}, "e": {"f": []}}, c)] == ["y", "z"]


def test_references(spark):
    ref = {"localPrefix": "BK", "externalUriSchemes": ["https"], "externalUriPattern": "https://ok\\..*"}
    c = compiled({"optional": [{"field": "refs", "reference": ref}]}, [{"type": "D", "idPrefix": "BK"}], idField="id")
    docs = {"a": {"type": "D", "id": "BK-1", "refs": ["BK-2", "BK-1", "BK-9", "CR-1", "https://ok.org", "https://no.org", "ftp://x", "plain", 5]}, "b": {"type": "D", "id": "BK-2"}, "c": {"type": "E", "id": "BK-9"}, "d": {"type": "D", "id": "BK-2"}}
    assert deviations(spark, docs, c) == [
        ("a", "SelfDocumentReference", "refs[1]"), ("a", "DanglingHandleReference", "refs[2]"), ("a", "ReferenceHandlePrefixMismatch", "refs[3]"), ("a", "ExternalReferencePatternMismatch", "refs[5]"),
        ("a", "ExternalReferenceSchemeNotAllowed", "refs[6]"), ("a", "MalformedDocumentReference", "refs[7]"), ("a", "MalformedDocumentReference", "refs[8]"), ("d", "DuplicateDocumentId", "id")]


def test_paths(spark):
    c = compiled({"optional": [{"field": "p", "path": {"externalUriSchemes": ["https"]}}]})
    docs = {"d/a": {"p": ["b.md", "/gone.md", "a.md", "../../x", "", "https://e.org", "s3://e", "x.py", 1]}, "d/b": {}}
    bare = [("d/a", "DanglingPathReference", "p[1]"), ("d/a", "SelfDocumentReference", "p[2]"), ("d/a", "PathEscapesBundle", "p[3]"), ("d/a", "MalformedPathReference", "p[4]"), ("d/a", "ExternalReferenceSchemeNotAllowed", "p[6]"), ("d/a", "MalformedPathReference", "p[8]")]
    assert deviations(spark, docs, c) == bare
    have = spark.createDataFrame([("d/a.md",), ("d/b.md",)], "path string")
    assert ("d/a", "DanglingPathReference", "p[7]") in deviations(spark, docs, c, inventory=have)


def test_lookups_share_one_join_and_deal_what_looks_up_nothing(spark):
    """Of 20,000 rows nine tenths look up nothing and one in twenty the same: no task gets twice the median."""
    key = F.when(F.col("id") % 20 == 0, "hot").when(F.col("id") % 20 == 1, F.col("id").cast("string"))
    probes, known = spark.range(20_000).select("id", key.alias("key")), spark.range(100).select(F.col("id").cast("string").alias("known")).unionByName(spark.sql("select 'hot' as known"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(k, v)
    try:
        met = lookup.meet(probes, F.col("key"), known, "known", "id")
        sizes = sorted(r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect())
        assert met.count() == 20_000 and met.where("known is not null").count() == 1_000 + 5 and sizes[-1] < 2 * sizes[len(sizes) // 2]
        c = compiled({"optional": [{"field": "r", "reference": {"localPrefix": "BK"}}, {"field": "p", "path": {}}]}, [{"type": "D", "idPrefix": "BK"}], idField="id")
        docs = {"a": {"type": "D", "id": "BK-1", "r": "BK-2", "p": "b.md"}, "b": {"type": "D", "r": "BK-1", "p": "gone.md"}}
        plan = check._met(bundle(spark, docs), c, check._none(), None)
        assert plan._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1
        assert sorted((r.concept_id, r.code) for r in plan.collect()) == [("a", "DanglingHandleReference"), ("b", "DanglingPathReference")]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_page_names(spark):
    assert docgen.slugs(["a b", "A-B", "a b 2", "!!", "type 4"]) == ["a-b", "a-b-2", "a-b-2-3", "type-4", "type-4-5"]


def test_uniqueness(spark):
    c = compiled({"optional": [{"field": "slots", "uniqueBy": "id", "elementFields": {"required": [{"field": "id", "cardinality": "scalar"}]}}]})
    docs = {"a": {"slots": [{"id": "n"}, {"id": "s"}, {"id": 1}, {"id": "n"}, {"id": "1"}, {"id": "s"}, {"id": "s"}]}}
    assert [r.detail for r in check.check(bundle(spark, docs), c).collect()] == ['"n" at [0, 3]', '"s" at [1, 5, 6]']


def test_type_checks(spark):
    t = {"type": "D", "pathPattern": "d/*/**", "resourceScheme": "pg", "idPrefix": "BK", "requireSchemaSection": True, "schemaColumns": ["Column"]}
    c = compiled({}, [t], idField="id", allowUnknownTypes=False, allowUnknownFields=False)
    docs = {"d/x": {"type": "D", "resource": "s3://x", "id": "BK-01", "odd": 1}, "d/x/y": {"type": "D", "id": ""}, "e": {"type": "E"}}
    assert deviations(spark, docs, c) == [
        ("d/x", "FieldNotInProfile", "odd"), ("d/x", "PathPatternMismatch", ""), ("d/x", "ResourceSchemeMismatch", "resource"), ("d/x", "MissingSchemaSection", ""), ("d/x", "MalformedDocumentId", "id"),
        ("d/x/y", "MissingResource", "resource"), ("d/x/y", "MissingSchemaSection", ""), ("d/x/y", "MissingDocumentId", "id"), ("e", "TypeNotInProfile", "type")]


def test_merging(spark):
    c = compiled({"required": [{"field": "s", "allowedValues": ["a", "b", "c"], "format": "uri"}]}, [{"type": "D", "frontmatter": {"optional": [{"field": "s", "allowedValues": ["c", "b"], "format": {"uriWithScheme": "s3"}}]}}])
    rule = c.by_type["D"][0]
    assert rule.allowed == ("b", "c") and rule.format == ("uriWithScheme", "s3") and rule.presence == ((True, None),)


@pytest.mark.parametrize("code,rules,more", [
    ("DuplicateFieldRule", {"required": [{"field": "a"}, {"field": "a"}]}, {}), ("ConflictingFieldRequirement", {"required": [{"field": "a"}], "optional": [{"field": "a"}]}, {}),
    ("DuplicateTypeRule", {}, {"types": [{"type": "T"}, {"type": "T"}]}), ("ElementFieldsRequireList", {"required": [{"field": "a", "cardinality": "scalar", "elementFields": {}}]}, {}),
    ("ObjectFieldsRequireObjectShape", {"required": [{"field": "a", "cardinality": "list", "objectFields": {}}]}, {}), ("InvalidFormatParameter", {"required": [{"field": "a", "format": {"documentHandle": "1x"}}]}, {}),
    ("EmptyConditionValues", {"required": [{"field": "a", "when": {"field": "b", "hasValue": []}}, {"field": "b", "cardinality": "scalar", "allowedValues": ["x"]}]}, {}),
    ("ConditionFieldNotDeclared", {"required": [{"field": "a", "when": {"field": "b", "hasValue": ["x"]}}]}, {}), ("SelfConditionalField", {"required": [{"field": "a", "when": {"field": "a", "hasValue": ["x"]}}]}, {}),
    ("ConditionFieldOpenVocabulary", {"required": [{"field": "a", "when": {"field": "b", "hasValue": ["x"]}}, {"field": "b", "cardinality": "scalar"}]}, {}),
    ("ConditionFieldNotScalar", {"required": [{"field": "a", "when": {"field": "b", "hasValue": ["x"]}}, {"field": "b", "cardinality": "list", "allowedValues": ["x"]}]}, {}),
    ("ConditionFieldHasUnreachableValues", {"required": [{"field": "a", "when": {"field": "b", "hasValue": ["y"]}}, {"field": "b", "cardinality": "scalar", "allowedValues": ["x"]}]}, {}),
    ("OptionalFieldWithCondition", {"optional": [{"field": "a", "when": {"field": "b", "hasValue": ["x"]}}, {"field": "b", "cardinality": "scalar", "allowedValues": ["x"]}]}, {}),
    ("InvalidReferencePrefix", {"optional": [{"field": "a", "reference": {"localPrefix": "1"}}]}, {"idField": "id"}), ("ReferencePrefixNotDeclared", {"optional": [{"field": "a", "reference": {"localPrefix": "A"}}]}, {"idField": "id"}),
    ("ReferenceRequiresIdField", {"optional": [{"field": "a", "reference": {"localPrefix": "A"}}]}, {"types": [{"type": "T", "idPrefix": "A"}]}),
    ("ReferenceWithFormat", {"optional": [{"field": "a", "format": "uri", "reference": {"localPrefix": "A"}}]}, {}), ("PathReferenceWithHandleReference", {"optional": [{"field": "a", "path": {}, "reference": {"localPrefix": "A"}}]}, {}),
    ("InvalidExternalReferenceScheme", {"optional": [{"field": "a", "path": {"externalUriSchemes": ["HTTPS"]}}]}, {}), ("InvalidExternalUriPattern", {"optional": [{"field": "a", "reference": {"localPrefix": "A", "externalUriPattern": "(?=x)"}}]}, {}),
    ("UniqueByRequiresElementFields", {"optional": [{"field": "a", "uniqueBy": "id"}]}, {}), ("UniqueByFieldNotDeclared", {"optional": [{"field": "a", "uniqueBy": "id", "elementFields": {}}]}, {}),
    ("UniqueByFieldNotUnconditionallyRequired", {"optional": [{"field": "a", "uniqueBy": "id", "elementFields": {"optional": [{"field": "id", "cardinality": "scalar"}]}}]}, {}),
    ("UniqueByFieldNotScalar", {"optional": [{"field": "a", "uniqueBy": "id", "elementFields": {"required": [{"field": "id"}]}}]}, {}),
    ("InvalidProfileVersion", {}, {"okfVersion": "x"}), ("ProfileVersionNotUnderstood", {}, {"okfVersion": "3.0"}), ("InvalidRequiredBundleVersion", {}, {"requireBundleVersion": "new"}),
    ("FieldSupersededInVersion", {"required": [{"field": "timestamp"}]}, {"okfVersion": "0.2"}), ("FormatRequiresVersion", {"optional": [{"field": "a", "format": "actor"}]}, {"okfVersion": "0.1"}),
    ("UnsatisfiableVocabulary", {"optional": [{"field": "a", "allowedValues": ["x"]}]}, {"types": [{"type": "T", "frontmatter": {"optional": [{"field": "a", "allowedValues": ["y"]}]}}]}),
    ("ConflictingCardinality", {"optional": [{"field": "a", "cardinality": "list"}]}, {"types": [{"type": "T", "frontmatter": {"optional": [{"field": "a", "cardinality": "scalar"}]}}]}),
    ("ConflictingFieldFormat", {"optional": [{"field": "a", "format": "date"}]}, {"types": [{"type": "T", "frontmatter": {"optional": [{"field": "a", "format": "uri"}]}}]}),
    ("ConflictingReferencePrefix", {"optional": [{"field": "a", "reference": {"localPrefix": "A"}}]}, {"types": [{"type": "T", "frontmatter": {"optional": [{"field": "a", "reference": {"localPrefix": "B"}}]}}]}),
    ("ConflictingExternalUriPatterns", {"optional": [{"field": "a", "reference": {"localPrefix": "A", "externalUriPattern": "x"}}]}, {"types": [{"type": "T", "frontmatter": {"optional": [{"field": "a", "reference": {"localPrefix": "A", "externalUriPattern": "y"}}]}}]}),
    ("ConflictingUniqueBy", {"optional": [{"field": "a", "uniqueBy": "x", "elementFields": {}}]}, {"types": [{"type": "T", "frontmatter": {"optional": [{"field": "a", "uniqueBy": "y", "elementFields": {}}]}}]})])
def test_definition_errors(code, rules, more):
    with pytest.raises(profile.ProfileError) as e:
        compiled(rules, **{"types": (), **more})
    assert code in {x[0] for x in e.value.errors}


def test_json_round_trip():
    p = profile.load(json.dumps({"name": "n", "frontmatter": {"required": [{"field": "a", "format": {"uriWithScheme": "s3"}, "elementFields": {"optional": [{"field": "b"}]}}]}, "types": [{"type": "T", "idPrefix": "X"}]}))
    assert profile.load(profile.dump(p)) == p and profile.dump(profile.load(profile.dump(p))) == profile.dump(p)


def test_check_filters():
    cargo = {"field": "cargo", "elementFields": {"optional": [{"field": "grade", "allowedValues": ["fine", "coarse"]}]}}
    rules = {"optional": [{"field": "berth", "allowedValues": ["east", "west"]}, cargo]}
    barge = {"type": "Barge", "frontmatter": {"optional": [{"field": "draught", "allowedValues": ["low"]}]}}
    c = compiled(rules, [barge, {"type": "Ferry", "frontmatter": {"optional": [{"field": "draught"}, {"field": "route"}]}}], allowUnknownTypes=False)
    bad = lambda raw, types=(): [x[0] for x in profile.check_filters(c, list(types), [filters.parse_equals(raw)])]
    assert bad("berth=north") == ["ValueOutOfVocabulary"] and bad("bearth=east") == ["UndeclaredField"] and bad("berth=east") == []
    assert bad("cargo.grade=rough") == ["ValueOutOfVocabulary"] and bad("cargo.weight=1") == ["UndeclaredField"]
    assert bad("generated.at=x") == [] and bad("description=x") == [] and bad("type=Raft") == ["ValueOutOfVocabulary"]
    assert bad("draught=deep") == [] and bad("draught=deep", ["Barge"]) == ["ValueOutOfVocabulary"] and bad("route=a", ["Barge"]) == ["UndeclaredField"]


def test_version_unmet():
    c = compiled({}, requireBundleVersion="0.2")
    assert check.version_unmet(c, None) == ("0.2", None) and check.version_unmet(c, "0.1") == ("0.2", "0.1") and check.version_unmet(c, "0.3") is None


def test_registry(tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"team": {"one": {"name": "one", "frontmatter": {}}, "two": {"name": "two", "frontmatter": {}}}}))
    (tmp_path / "s.json").write_text("[")
    found, failed = registry.survey([str(tmp_path / "r.json"), str(tmp_path / "s.json"), str(tmp_path / "none.json")])
    assert [e.name for e in found] == ["team.one", "team.two"] and [f.category for f in failed] == ["malformed", "missing"]
    assert registry.lookup([str(tmp_path / "r.json")], "team.two").name == "two"
    with pytest.raises(LookupError):
        registry.lookup([str(tmp_path / "r.json"), str(tmp_path / "s.json")], "team.two")
    assert registry.sources((), {registry.SOURCES_VARIABLE: '["a", "b"]'}, ["c"], local=["b", "d"]) == ["a", "b", "d"]
    assert registry.discover(str(tmp_path)) == [str(tmp_path / "r.json")]


def test_documentation(tmp_path):
    c = compiled({"required": [{"field": "a", "allowedValues": ["x"], "description": "why"}]}, [{"type": "A b"}, {"type": "A-B"}, {"type": "C", "idPrefix": "C"}])
    pages = docgen.render(c)
    assert list(pages) == ["profile.md", "types/a-b.md", "types/a-b-2.md", "types/c.md"] and pages == docgen.render(c) and "- `a` (required): one of `x` — why" in pages["profile.md"]
    (tmp_path / "old.md").write_text("x")
    assert docgen.write(c, str(tmp_path)) == ["old.md"]
