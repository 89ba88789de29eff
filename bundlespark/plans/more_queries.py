"""Registered queries of Markdown facts, logs, handles, profiles, registries and bundles on disk, with their SQL."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids, posix, values
from ..operators import concepts, filters, graph, handles, index, logs, show, validate
from ..operators.concepts import from_rows, project
from ..sources import bundle, carriers, markdown, store
from . import check, docgen, profile, registry
from .catalogue import _profile, query


def _k() -> Column:
    return F.col("p_partkey")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _notes(spark: SparkSession, d: str, body, fm=None, facts: bool | str = True) -> DataFrame:
    """notes/KEY for every part, with the given body and frontmatter; ``facts`` may name the one kind that is wanted."""
    fm = F.struct(F.lit("Note").alias("type"), F.col("p_name").alias("title")) if fm is None else fm
    out = project(from_rows(carriers.spread(carriers.table(spark, d, "part")), _text("notes/", _k()), fm, body))
    return {"links": markdown.with_links, "footnotes": markdown.with_footnotes}.get(facts, markdown.with_facts)(out) if facts else out


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql_rows(rows: list[tuple], names: str) -> str:
    def shown(x):
        return "null" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"select * from (values {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({names})"


def _scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and tasks share: below spark.checkpoint.dir, or a local one on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    shared = None if shared is None else shared.removeprefix("file://").removeprefix("file:")
    if shared is not None:
        os.makedirs(shared, exist_ok=True)
    return tempfile.mkdtemp(prefix="bundle-", dir=shared)


# -- Markdown -----------------------------------------------------------------------


@query("select 'notes/' || p_partkey as concept_id, 'a' || (p_partkey % 5) || ',b' as labels from part")
def footnote_labels(spark, d):
    body = _text("Said [^a", _k() % 5, "] and [^b], again [^b], not `[^code]`.\n\n```\n[^block]\n```\n\n[^b]: a note\n")
    return _notes(spark, d, body, facts="footnotes").select("concept_id", F.array_join("footnotes", ",").alias("labels"))


@query("""select 'notes/' || p_partkey as concept_id, case p_partkey % 3 when 0 then 'id|name ' || p_partkey when 1 then 'a' end as header from part""")
def schema_headers(spark, d):
    head = _text("# Schema\n\n| `id` | name ", _k(), " |\n|----|:---|\n| 1 | x |\n")
    body = F.when(_k() % 3 == 0, head).when(_k() % 3 == 1, "# Other\n\n| x |\n|---|\n\n## SCHEMA\n\ntext\n\n| a |\n| - |\n").otherwise("| x |\n|---|\n")
    return _notes(spark, d, body).select("concept_id", F.array_join("schema_columns", "|").alias("header"))


@query("""select 'notes/' || p_partkey as concept_id, '/a' || p_partkey || '.md b.md?x=1&y=2 ref' || (p_partkey % 4) || '.md https://h/x in(1).md q.md' as links from part""")
def markdown_links(spark, d):
    body = _text("See [a](/a", _k(), ".md) and [b](<b.md?x=1&amp;y=2> \"title\"), ![no](c.png), `[no](d.md)`, \\[no](e.md), [Some  Ref][r].\n\n<div>\n[no](f.md)\n</div>\n\n<https://h/x> and [p](in(1).md)\n\n> [q](q.md)\n\n[R]: ref", _k() % 4, ".md\n")
    return _notes(spark, d, body, facts="links").select("concept_id", F.array_join("links", " ").alias("links"))


@query("""select 'notes/' || p_partkey as concept_id, 'c' || p_partkey || '.md in' || p_partkey || '.md q.md ' || case p_partkey % 2 when 0 then 'e.md' else '(e).md' end || ' r' || (p_partkey % 3) || '.md' as links from part""")
def markdown_nested_links(spark, d):
    """The inner of two nested links, links in an image's text, links in and around emphasis, an image in a link."""
    odd = F.when(_k() % 2 == 0, "e.md").otherwise("(e).md")
    body = _text("[a [b](c", _k(), ".md)](d.md) and ![x [l](in", _k(), ".md)](i.png), [![p](p.png)](q.md), **bold *[e](", odd, ")* end**, <i title='[no](f.md)'>[a [r] b](g h)</i>\n\n[R]: r", _k() % 3, ".md\n")
    return _notes(spark, d, body, facts="links").select("concept_id", F.array_join("links", " ").alias("links"))


@query("""select 'notes/' || p_partkey as source, 0 as link_pos, 'notes/x' || p_partkey as target from part union all select 'notes/' || p_partkey, 2, 'top' from part where p_partkey % 2 = 0""")
def link_positions(spark, d):
    body = F.when(_k() % 2 == 0, _text("[a](x", _k(), ".md) [b](http://w) [c](../top.md#s)")).otherwise(_text("[a](./x", _k(), ".md)"))
    return graph.dangling(_notes(spark, d, body, facts="links"), ordered=False)


@query("select 'notes/' || p_partkey as concept_id, '/notes/' || p_partkey || '.md' as target from part")
def link_target_text(spark, d):
    return carriers.table(spark, d, "part").select(_text("notes/", _k()).alias("concept_id"), ids.link_target(_text("notes/", _k())).alias("target"))


def _log_files(spark, d):
    """n/KEY/log.md: two days with entries, one that is no date, one without entries."""
    k = F.col("n_nationkey")
    text = _text("# Log ", k, "\n\nintro\n\n## 2024-01-0", k % 9 + 1, "\n\n* **Creation**: made ", F.col("n_name"), "\n* plain [x](y.md)\n\n## soon\n\n- **Note** said\n\n## 2024-02-30\n")
    return carriers.table(spark, d, "nation").select(_text("n/", k, "/log.md").alias("path"), text.alias("text"))


_DAY1 = "'2024-01-0' || (n_nationkey % 9 + 1)"


@query(f"""select 'n/' || n_nationkey || '/log.md' as log_path, 0 as day_pos, {_DAY1} as date, 0 as entry_pos, 'Creation' as kind, 'made ' || n_name as text from nation
 union all select 'n/' || n_nationkey || '/log.md', 0, {_DAY1}, 1, null, 'plain [x](y.md)' from nation union all select 'n/' || n_nationkey || '/log.md', 1, 'soon', 0, 'Note', 'said' from nation
 union all select 'n/' || n_nationkey || '/log.md', 2, '2024-02-30', null, null, null from nation""")
def log_parse(spark, d):
    return markdown.log_rows(_log_files(spark, d))


@query("""select 'n/' || n_nationkey || '/log.md' as log_path, p as day_pos, c as code, x as date from nation, (values (1, 'LogDateNotIso', 'soon'), (2, 'LogDateNotIso', '2024-02-30'), (2, 'LogEmptyDay', '2024-02-30')) t(p, c, x)""")
def log_structure(spark, d):
    return logs.check(markdown.log_rows(_log_files(spark, d))).where("structural").select("log_path", "day_pos", "code", "date")


@query(f"""select 'n/' || n_nationkey || '/log.md' as log_path, '# T' || n_nationkey || chr(10) || chr(10) || '## 2024-03-01' || chr(10) || '* **Update**: new' || chr(10) || chr(10) || '## ' || {_DAY1} || chr(10) || '* **Creation**: made ' || n_name || chr(10) || '* plain' || chr(10) as text from nation where n_nationkey = 3
 union all select 'n/' || n_nationkey || '/log.md', '# T' || n_nationkey || chr(10) || chr(10) || '## ' || {_DAY1} || chr(10) || '* **Creation**: made ' || n_name || chr(10) || '* plain' || chr(10) from nation where n_nationkey <> 3""")
def log_append_text(spark, d):
    k = F.col("n_nationkey")
    files = carriers.table(spark, d, "nation").select(_text("n/", k, "/log.md").alias("path"), _text("# T", k, "\n\n## 2024-01-0", k % 9 + 1, "\n\n* **Creation**: made ", F.col("n_name"), "\n* plain\n").alias("text"))
    titles = carriers.table(spark, d, "nation").select(_text("n/", k, "/log.md").alias("log_path"), _text("T", k).alias("title"))
    return logs.serialize(logs.append(markdown.log_rows(files), "n/3/log.md", "2024-03-01", "new"), titles)


@query("select 'LOT' as prefix, max(c_custkey) || repeat('0', 39) || '1' as number from customer where c_custkey % 3 <> 0 union all select 'MAX', '1' || repeat('0', 45) union all select 'NEW', '1'")
def id_next_unbounded(spark, d):
    """The next of numbers over 40 digits, and of one that is all nines."""
    k = F.col("c_custkey")
    handle = F.when(k % 3 == 0, "MAX-" + "9" * 45).otherwise(_text("LOT-", k, "0" * 40))
    c = project(from_rows(carriers.table(spark, d, "customer"), _text("lots/", k), F.struct(F.lit("Lot").alias("type"), handle.alias("docId"))))
    by = [handles.next_number(c, "docId", prefix) for prefix in ("LOT", "MAX", "NEW")]
    return by[0].unionByName(by[1]).unionByName(by[2])


_LINE = "select 'nations' as dir, 3 as rank, 'Nation' as type, {0} as step, {1} as name, {2} as text"


@query(_LINE.format(1, "'nations/' || n_nationkey || '.md'", "'- [' || n_name || '](' || n_nationkey || '.md)' || case when n_nationkey % 2 = 0 then ' - number ' || n_nationkey else '' end || chr(10)") + " from nation union all "
       + _LINE.format(0, "''", "'# Nation' || chr(10) || chr(10)") + " union all " + _LINE.format(2, "''", "chr(10)")
       + " union all select '', 1, 'Subdirectories', 0, '', '# Subdirectories' || chr(10) || chr(10) union all select '', 1, 'Subdirectories', 1, 'nations', '- [nations/](nations/index.md)' || chr(10) union all select '', 1, 'Subdirectories', 2, '', chr(10)")
def index_lines(spark, d):
    return index.lines(carriers.nations(spark, d))


@query("""select 'n/' || n_nationkey || '/c' as concept_id, '2024-02-02' as date, 'n/' || n_nationkey || '/log.md' as log_path, null as newest from nation where n_nationkey % 2 = 0""")
def log_empty_nearest(spark, d):
    k = F.col("n_nationkey")
    own = carriers.table(spark, d, "nation").where(k % 2 == 0).select(_text("n/", k, "/log.md").alias("path"), F.lit("# Only a title\n").alias("text"))
    root = spark.createDataFrame([("log.md", "# Log\n\n## 2030-01-01\n\n* x\n")], "path string, text string")
    c = project(from_rows(carriers.table(spark, d, "nation"), _text("n/", k, "/c"), F.struct(F.lit("Nation").alias("type"), F.lit("2024-02-02T01:02:03Z").alias("timestamp"))))
    return logs.stale(c, markdown.log_rows(own.unionByName(root)))


# -- identity, order, detail ------------------------------------------------------------


@query("select 'nations/7' as concept_id, (select n_name from nation where n_nationkey = 7) as title")
def find_concept(spark, d):
    return concepts.find(carriers.nations(spark, d), "nations/7").select("concept_id", "title")


@query("""select 'orders/' || o_orderkey as concept_id, 'id' as by from (select min(o_orderkey) as o_orderkey from orders) union all select 'orders/' || o_orderkey, 'handle' from (select max(o_orderkey) as o_orderkey from orders)""")
def resolve_concept(spark, d):
    c = carriers.orders(spark, d, lines=False)
    ends = carriers.table(spark, d, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    by = lambda raw, how: concepts.resolve(c, raw).select("concept_id", F.lit(how).alias("by"))
    return by(f"orders/{ends[0]}", "id").unionByName(by(f"ORD-{ends[1]}", "handle"))


@query("""select 'CUS-' || (c_custkey % 1000 + 1) as handle, 'customers/' || c_custkey as concept_id, n > 1 as ambiguous from (select c_custkey, count(*) over (partition by c_custkey % 1000) as n from customer) where c_custkey % 1000 = 12""")
def ambiguous_handle(spark, d):
    found = concepts.find_by_handle(carriers.customers(spark, d), "CUS-13", "docId").select(F.lit("CUS-13").alias("handle"), "concept_id")
    n = found.groupBy("handle").agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    return found.join(n, "handle").select("handle", "concept_id", "ambiguous")


@query("""select 'd' || n_nationkey || case n_nationkey % 3 when 0 then '/index.md' when 1 then '/log.md' else '/index.markdown' end as path, n_nationkey % 3 <> 2 as reserved, 'd' || n_nationkey as dir from nation""")
def reserved_files(spark, d):
    k = F.col("n_nationkey")
    path = F.concat(_text("d", k), F.when(k % 3 == 0, "/index.md").when(k % 3 == 1, "/log.md").otherwise("/index.markdown"))
    return carriers.table(spark, d, "nation").select(path.alias("path"), ids.is_reserved(path).alias("reserved"), ids.directory(path).alias("dir"))


@query("""select 'notes/' || p_partkey as concept_id, 'docId' as key, 'PRT-' || p_partkey as handle from part where p_partkey > 0 union all select 'notes/' || p_partkey, 'other', 'X-1' from part where p_partkey % 2 = 0""")
def handle_fields(spark, d):
    fm = F.struct(_text("PRT-", _k()).alias("docId"), F.when(_k() % 2 == 0, " X-1 ").otherwise("X-01").alias("other"), F.lit("no handle").alias("title"))
    return handles.fields(_notes(spark, d, F.lit(""), fm, facts=False))


@query("""select id, row_number() over (order by string_split(id, '/')) as place from (select 'a/' || n_nationkey as id from nation union all select 'a-b/' || n_nationkey from nation union all select 'a.c' from region where r_regionkey = 0)""")
def order_by_segments(spark, d):
    k = F.col("n_nationkey")
    some = carriers.table(spark, d, "nation").select(F.explode(F.array(_text("a/", k), _text("a-b/", k))).alias("id")).unionByName(spark.createDataFrame([("a.c",)], "id string"))
    return some.withColumn("place", F.row_number().over(Window.orderBy(*graph.by_segments("id"))).cast("long"))  # few rows


@query("""select 'nations/' || n_nationkey as concept_id, row_number() over (order by case when n_nationkey % 4 <> 0 then n_nationkey % 7 end desc nulls last, 'nations/' || n_nationkey) as place from nation""")
def menu_order(spark, d):
    k = F.regexp_extract("concept_id", "[0-9]+$", 0).cast("int")
    dated = carriers.nations(spark, d).withColumn("modified", F.when(k % 4 != 0, (k % 7).cast("double")))
    return dated.select("concept_id", F.row_number().over(Window.orderBy(*show.menu_order())).cast("long").alias("place"))  # few rows


@query("""select 'id' as label, 'nations/4' as value union all select 'type', 'Nation' union all select 'title', n_name from nation where n_nationkey = 4 union all select 'description', 'number 4'
 union all select 'trust', 'unverified' union all select 'status', 'stable' union all select 'staleness', 'ok'""")
def show_detail(spark, d):
    return show.detail(carriers.nations(spark, d), "nations/4", "2024-05-01").select("label", "value")


@query(_sql_rows([("inline", "select 1\n"), ("LookupError", "computations/3 has 2 computations"), ("LookupError", "computations/6 has no computation")], "kind, said"))
def show_computation(spark, d):
    c, have, out = carriers.parts(spark, d, facts=False), spark.createDataFrame([("sql/q.sql",)], "path string"), []
    for name in ("computations/7", "computations/3", "computations/6"):
        try:
            out.append(show.computation(c.withColumn("computation", F.lit(None).cast("string")), name, have))
        except LookupError as e:
            out.append(("LookupError", str(e)))
    return _values(spark, out, "kind string, said string")


@query("""select 'nations/' || n_nationkey as concept_id, case when n_nationkey % 2 = 0 then '{"description":"number ' || n_nationkey || '","title":"' || n_name || '","type":"Nation"}' else '{"title":"' || n_name || '","type":"Nation"}' end as json from nation""")
def concepts_json(spark, d):
    return concepts.frontmatter_json(carriers.nations(spark, d))


@query("""select 'nodes' as part, '{"id":"nations/' || n_nationkey || '","label":"' || n_name || '","type":"Nation","description":' || case when n_nationkey % 2 = 0 then '"number ' || n_nationkey || '"' else 'null' end || ',"resource":null,"tags":[]}' as json from nation
 union all select 'nodes', '{"id":"regions/' || r_regionkey || '","label":"' || r_name || '","type":"Region","description":null,"resource":null,"tags":[]}' from region
 union all select 'edges', '{"source":"nations/' || n_nationkey || '","target":"regions/' || n_regionkey || '"}' from nation""")
def graph_json(spark, d):
    both = carriers.nations(spark, d, "links").unionByName(carriers.regions(spark, d, "links"))
    return graph.as_json(both)


_VERSIONS = "case n_nationkey % 5 when 0 then '0.' || n_nationkey when 1 then n_nationkey || '.2' when 2 then 'v0.1' when 3 then '0.1.' || n_nationkey else '00.01' end"


@query(f"""select n_nationkey, case when n_nationkey % 5 in (0, 1, 4) then cast(split_part({_VERSIONS}, '.', 1) as int) end as major, case when n_nationkey % 5 in (0, 1, 4) then cast(split_part({_VERSIONS}, '.', 2) as int) end as minor from nation""")
def versions(spark, d):
    k = F.col("n_nationkey")
    v = ids.version(F.when(k % 5 == 0, _text("0.", k)).when(k % 5 == 1, _text(k, ".2")).when(k % 5 == 2, "v0.1").when(k % 5 == 3, _text("0.1.", k)).otherwise("00.01"))
    return carriers.table(spark, d, "nation").select("n_nationkey", v["major"].alias("major"), v["minor"].alias("minor"))


_GATES = [("0.1", False, False, "0.1", False), ("0.2", False, False, "0.2", True), ("0.9", False, False, "0.2", True), ("1.0", False, True, None, False), ("two", True, False, None, False), (None, False, False, None, False)]


@query(_sql_rows(_GATES, "declared, unparseable, not_understood, effective, at_least_0_2"))
def version_gate(spark, d):
    out = []
    for declared, *_ in _GATES:
        g = ids.Gate(declared)
        out.append((declared, g.unparseable, g.not_understood, None if g.effective is None else ".".join(map(str, g.effective)), g.at_least(0, 2)))
    return _values(spark, out, "declared string, unparseable boolean, not_understood boolean, effective string, at_least_0_2 boolean")


@query("""select 'notes/' || p_partkey as concept_id, 'LegacyFieldInDeclaredV2' as code, 'timestamp' as detail from part where p_partkey % 2 = 0
 union all select 'notes/' || p_partkey, 'MissingGeneratedField', '' from part where p_partkey % 4 = 3 union all select 'notes/' || p_partkey, 'GeneratedMustHaveActor', '' from part where p_partkey % 4 = 1""")
def validate_timestamps(spark, d):
    made = F.struct(F.when(_k() % 4 != 1, "human:x").alias("by"), F.lit("2024-01-01").alias("at"))
    none = F.lit(None).cast("string")
    fm = F.struct(F.lit("Note").alias("type"), F.col("p_name").alias("title"), F.col("p_brand").alias("description"), F.when(_k() % 2 == 0, "2024-01-01T00:00:00Z").otherwise(none).alias("timestamp"), F.when(_k() % 4 == 1, made).alias("generated"))
    return validate.documents(_notes(spark, d, F.lit("x"), fm), strict=True, version="0.2").select("concept_id", "code", "detail")


@query("select 5 as phase, 'BundleVersionNotUnderstood' as code, '1.0' as detail union all select 5, 'BundleVersionUnparseable', 'x'")
def validate_versions(spark, d):
    c = markdown.with_facts(carriers.nations(spark, d))
    return validate.validate(c, strict=True, version="1.0", ordered=False).unionByName(validate.validate(c, strict=True, version="x", ordered=False)).where("phase = 5").select("phase", "code", "detail")


@query("select true as core, false as advice, true as enforced, (select count(*) from nation where n_nationkey % 2 = 1) as n")
def validate_outcome(spark, d):
    c = markdown.with_facts(carriers.nations(spark, d))
    none, late = validate.validate(c.limit(0)), logs.check(markdown.log_rows(spark.createDataFrame([("log.md", "# L\n\n## 2024-01-01\n\n* a\n\n## 2024-01-02\n\n* b\n")], "path string, text string")))
    found = validate.documents(c, strict=True, version="0.1").where("code = 'MissingRecommendedField'")
    return spark.createDataFrame([(validate.failed(found), validate.failed(none, late), validate.failed(none, late, log_enforce=True), found.count())], "core boolean, advice boolean, enforced boolean, n long")


# -- profiles ---------------------------------------------------------------------------


def _checked(c: DataFrame, rules, **how) -> DataFrame:
    return check.check(c, rules, ordered=False, **how).select("concept_id", "code", "path", "detail")


@query("""select 'notes/' || p_partkey as concept_id, case p_partkey % 4 when 0 then 'MissingSchemaSection' else 'SchemaColumnsMismatch' end as code, '' as path, case p_partkey % 4 when 0 then '' else 'id, Other' end as detail from part where p_partkey % 4 in (0, 1)""")
def profile_schema_columns(spark, d):
    body = F.when(_k() % 4 == 0, "no section\n").when(_k() % 4 == 1, "# Schema\n\n| id | Other |\n|---|---|\n").otherwise("# Schema\n\n| ID | Name | more |\n|---|---|---|\n")
    return _checked(_notes(spark, d, body), _profile(types=[{"type": "Note", "requireSchemaSection": True, "schemaColumns": ["id", "name"]}]))


@query("""select 'notes/' || p_partkey as concept_id, case p_partkey % 3 when 0 then 'MissingDocumentId' else 'MalformedDocumentId' end as code, 'docId' as path, case p_partkey % 3 when 0 then 'PRT' else 'PAR-' || p_partkey end as detail from part where p_partkey % 3 < 2""")
def profile_handles(spark, d):
    fm = F.struct(F.lit("Note").alias("type"), F.when(_k() % 3 == 0, F.lit("  ")).when(_k() % 3 == 1, _text("PAR-", _k())).otherwise(_text("PRT-", _k())).alias("docId"))
    return _checked(_notes(spark, d, F.lit(""), fm, facts=False), _profile(types=[{"type": "Note", "idPrefix": "PRT"}], idField="docId"))


@query("""select 'orders/' || l_orderkey as concept_id, 'DuplicateNestedFieldValue' as code, 'lines.flag' as path, '"' || l_returnflag || '" at [' || string_agg(cast(rn - 1 as varchar), ', ' order by rn) || ']' as detail from
 (select l_orderkey, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag, l_linestatus, cast(trunc(l_quantity) as int)) as rn from lineitem where l_orderkey in (select o_orderkey from orders)) group by l_orderkey, l_returnflag having count(*) > 1""")
def profile_unique_by(spark, d):
    rules = {"optional": [{"field": "lines", "uniqueBy": "flag", "elementFields": {"required": [{"field": "flag", "cardinality": "scalar"}]}}]}
    return _checked(carriers.orders(spark, d), _profile(rules))


_POSIX = ["[[:digit:]]+", "x[]a]*", "[a&&b]", "[^[:space:]]+", "(Brand|x)#[1-3]{2}", "Brand.[^]-]+", "[[:alpha:]#]+[[.1.]-5]{1,2}", "B(r|ra)(nd|and)?#.*"]


@query("select 'notes/' || p_partkey as concept_id, p as pattern, regexp_full_match(t, p) as matched from part, (values (p_brand), (cast(p_partkey as varchar)), ('x]a' || p_size), ('x]a'), ('&'), ('a b')) s(t), (values "
       + ", ".join(f"('{p}')" for p in _POSIX if "[." not in p) + ") r(p)")
def posix_patterns(spark, d):
    texts = F.array("p_brand", _k().cast("string"), _text("x]a", F.col("p_size")), F.lit("x]a"), F.lit("&"), F.lit("a b"))
    each = carriers.table(spark, d, "part").select(_text("notes/", _k()).alias("concept_id"), F.explode(texts).alias("t"))
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col("t").rlike(posix.whole(p)).alias("matched")) for p in _POSIX if "[." not in p])
    return each.select("concept_id", F.explode(rows).alias("x")).select("concept_id", "x.pattern", "x.matched")


_URI = "case p_partkey % 4 when 0 then 'ticket:AB-' || p_partkey when 1 then 'ticket:ab' when 2 then 'mail:x' else 'no uri' end"


@query(f"""select 'notes/' || p_partkey as concept_id, case p_partkey % 4 when 1 then 'ExternalReferencePatternMismatch' when 2 then 'ExternalReferenceSchemeNotAllowed' else 'MalformedDocumentReference' end as code,
 'about' as path, '"' || {_URI} || '"' as detail from part where p_partkey % 4 > 0""")
def profile_uri_pattern(spark, d):
    raw = F.when(_k() % 4 == 0, _text("ticket:AB-", _k())).when(_k() % 4 == 1, "ticket:ab").when(_k() % 4 == 2, "mail:x").otherwise("no uri")
    rules = [{"field": "about", "reference": {"localPrefix": "PRT", "allowLocal": False, "externalUriSchemes": ["ticket"], "externalUriPattern": "ticket:[[:upper:]]{2}-[[:digit:]]+"}}]
    return _checked(_notes(spark, d, F.lit(""), F.struct(F.lit("Note").alias("type"), raw.alias("about")), facts=False), _profile({"optional": rules}))


@query("""select 'notes/' || p_partkey as concept_id, 'ValueFormatMismatch' as code, f as path, case f when 'size' then p_size || '.5' when 'link' then '"no link"' when 'seen' then '"2024-13-01T00:00:00Z"' else '"' || p_brand || '"' end as detail
 from part, (values ('size', 0), ('link', 1), ('seen', 2), ('who', 0)) t(f, r) where p_partkey % 3 = r""")
def profile_formats(spark, d):
    fm = F.struct(
        F.lit("Note").alias("type"), F.parse_json(F.when(_k() % 3 == 0, _text(F.col("p_size"), ".5")).otherwise(F.col("p_size").cast("string"))).alias("size"), F.when(_k() % 3 == 1, "no link").otherwise("https://h/x").alias("link"),
        F.when(_k() % 3 == 2, "2024-13-01T00:00:00Z").otherwise("2024-12-01T00:00:00.25Z").alias("seen"), F.when(_k() % 3 == 0, F.col("p_brand")).otherwise("process:x").alias("who"))
    rules = [{"field": "size", "format": "integer"}, {"field": "link", "format": {"uriWithScheme": "https"}}, {"field": "seen", "format": "rfc3339-utc"}, {"field": "who", "format": "actor"}]
    return _checked(_notes(spark, d, F.lit(""), fm, facts=False), _profile({"optional": rules}))


@query("select 'notes/' || p_partkey as concept_id, 'ValueNotInVocabulary' as code, 'size' as path, '\"s' || (p_size % 4) || '\"' as detail from part where p_size % 4 <> 1")
def profile_vocabulary_of_both(spark, d):
    fm = F.struct(F.lit("Note").alias("type"), _text("s", F.col("p_size") % 4).alias("size"))
    rules = {"optional": [{"field": "size", "allowedValues": ["s0", "s1", "s1"]}]}
    return _checked(_notes(spark, d, F.lit(""), fm, facts=False), _profile(rules, [{"type": "Note", "frontmatter": {"optional": [{"field": "size", "allowedValues": ["s1", "s2"]}]}}]))


_MERGED = [("base", "size", "scalar", "s0 s1", "integer", "optional"), ("Note", "extra", "list", "", None, "required"), ("Note", "size", "scalar", "s1", "non-negative-integer", "required")]


@query(_sql_rows(_MERGED, "scope, field, cardinality, allowed, format, presence"))
def profile_merged_rules(spark, d):
    rules = {"optional": [{"field": "size", "allowedValues": ["s0", "s1", "s0"], "format": "integer"}]}
    c = _profile(rules, [{"type": "Note", "frontmatter": {"required": [{"field": "size", "allowedValues": ["s1", "s2"], "format": "non-negative-integer"}, {"field": "extra", "elementFields": {"required": [{"field": "x"}]}}]}}])
    row = lambda scope, r: (scope, r.field, r.cardinality, " ".join(r.allowed), r.format[0] if r.format else None, "required" if (True, None) in r.presence else "optional")
    return _values(spark, [row("base", r) for r in c.base] + [row("Note", r) for r in c.by_type["Note"]], "scope string, field string, cardinality string, allowed string, format string, presence string")


_ERRORS = [("ConflictingCardinality", "Note", "a"), ("UnsatisfiableVocabulary", "Note", "b"), ("DuplicateFieldRule", None, "c"), ("ReferenceRequiresIdField", None, "e"), ("InvalidProfileVersion", None, ""), ("ReferencePrefixNotDeclared", None, "e")]


@query(_sql_rows(_ERRORS, "code, scope, path"))
def profile_errors(spark, d):
    base = {"optional": [{"field": "a", "cardinality": "scalar"}, {"field": "b", "allowedValues": ["x"]}, {"field": "c"}, {"field": "c"}, {"field": "e", "reference": {"localPrefix": "ZZ"}}]}
    own = {"optional": [{"field": "a", "cardinality": "list"}, {"field": "b", "allowedValues": ["y"]}]}
    try:
        _profile(base, [{"type": "Note", "frontmatter": own}], okfVersion="two")
    except profile.ProfileError as e:
        found = sorted({(code, scope, path) for code, scope, path, _ in e.errors if scope is None or code in ("ConflictingCardinality", "UnsatisfiableVocabulary")}, key=repr)
        return _values(spark, found, "code string, scope string, path string")
    return _values(spark, [], "code string, scope string, path string")


@query("select '0.2' as required, '0.1' as declared union all select '0.2', null")
def profile_version(spark, d):
    c = _profile(requireBundleVersion="0.2")
    return _values(spark, [x for v in ("0.1", "0.2", "0.3", None) if (x := check.version_unmet(c, v))], "required string, declared string")


@query("select true as same, 'p' as name, 2 as types")
def profile_json(spark, d):
    p = profile.load(json.dumps({"name": "p", "frontmatter": {"required": [{"field": "a", "format": {"documentHandle": "X"}, "when": {"field": "b", "hasValue": ["y"]}}]}, "types": [{"type": "T"}, {"type": "U", "idPrefix": "X"}]}))
    again = profile.load(profile.dump(p))
    return _values(spark, [(again == p and profile.dump(again) == profile.dump(p), again.name, len(again.types))], "same boolean, name string, types int")


@query(_sql_rows([("Data Set", "data-set"), ("Ünit", "nit"), ("!!", "type-3"), ("a b", "a-b"), ("A-B", "a-b-5"), ("a b 5", "a-b-5-6")], "name, slug"))
def page_names(spark, d):
    names = ["Data Set", "Ünit", "!!", "a b", "A-B", "a b 5"]
    return _values(spark, list(zip(names, docgen.slugs(names), strict=True)), "name string, slug string")


# -- registries and bundles on disk -------------------------------------------------------


def _registries(spark) -> str:
    top = _scratch(spark)
    one = lambda n: {"name": n, "frontmatter": {}, "types": []}
    files = {"a.json": one("alpha"), "b.json": {"x": {"y": one("beta")}, "z": one("gamma"), "other": 3}, "empty.json": {"k": 1}, "bad.json": None, "wrong.json": {"name": "w", "frontmatter": 7}}
    for name, value in files.items():
        with open(os.path.join(top, name), "w", encoding="utf-8") as f:
            f.write("{" if value is None else json.dumps(value))
    return top


@query(_sql_rows([("a.json", "", "alpha"), ("b.json", "x.y", "beta"), ("b.json", "z", "gamma")], "source, export, name"))
def registry_entries(spark, d):
    top = _registries(spark)
    entries, _ = registry.survey([os.path.join(top, n) for n in ("a.json", "b.json", "a.json", "empty.json")])
    return _values(spark, [(os.path.basename(e.source), e.name, e.profile.name) for e in entries], "source string, export string, name string")


@query(_sql_rows([("bad.json", "malformed"), ("empty.json", "empty"), ("none.json", "missing"), ("wrong.json", "invalid")], "source, category"))
def registry_failures(spark, d):
    top = _registries(spark)
    _, failures = registry.survey([os.path.join(top, n) for n in ("a.json", "bad.json", "empty.json", "none.json", "wrong.json")])
    return _values(spark, [(os.path.basename(f.source), f.category) for f in failures], "source string, category string")


@query(_sql_rows([("flag", "f l"), ("list", "e1 e2 l"), ("older", "o l"), ("configured", "c l"), ("built in", "b l")], "given, sources"))
def registry_sources(spark, d):
    listed, older = {registry.SOURCES_VARIABLE: '["e1", "e2"]', registry.LEGACY_VARIABLE: "o"}, {registry.LEGACY_VARIABLE: "o"}
    got = [("flag", registry.sources(["f"], listed, ["c"], ["b"], ["l"])), ("list", registry.sources([], listed, ["c"], ["b"], ["l"])), ("older", registry.sources([], older, ["c"], ["b"], ["l"])),
           ("configured", registry.sources([], {}, ["c"], ["b"], ["l"])), ("built in", registry.sources([], {}, [], ["b"], ["l"]))]
    return _values(spark, [(k, " ".join(v)) for k, v in got], "given string, sources string")


@query(_sql_rows([("beta", "beta"), ("x.y", "beta"), ("nope", None)], "asked, name"))
def registry_lookup(spark, d):
    top, out = _registries(spark), []
    for asked in ("beta", "x.y", "nope"):
        try:
            out.append((asked, registry.lookup([os.path.join(top, n) for n in ("a.json", "b.json")], asked).name))
        except LookupError:
            out.append((asked, None))
    return _values(spark, out, "asked string, name string")


@query(_sql_rows([("a.json",), ("b.json",)], "file"))
def registry_discovery(spark, d):
    return _values(spark, [(os.path.basename(p),) for p in registry.discover(_registries(spark))], "file string")


def _on_disk(spark, d) -> str:
    """Nations and regions as a bundle on disk, with indexes, a log, a stray file and an empty directory."""
    root = os.path.join(_scratch(spark), "b")
    both = carriers.nations(spark, d).unionByName(carriers.regions(spark, d))
    bundle.write(both, root)
    os.makedirs(os.path.join(root, "empty", "inner"))
    bundle.write_texts(spark.createDataFrame([("data/x.csv", "1"), ("nations/log.md", "# L\n\n## 2024-01-01\n\n* a\n"), ("regions/log.md", "# only a title\n")], "source_path string, text string"), root)
    bundle.write_index_lines(index.lines(both, bundle.inventory(spark, root), "0.2", bundle.directories(spark, root)), root)
    return root


@query("select 'nations/' || n_nationkey as concept_id, n_name as title, 'nations/' || n_nationkey || '.md' as source_path from nation union all select 'regions/' || r_regionkey, r_name, 'regions/' || r_regionkey || '.md' from region")
def bundle_read(spark, d):
    return bundle.read(spark, _on_disk(spark, d)).select("concept_id", "title", "source_path")


@query("""select 'nations/' || n_nationkey || '.md' as path from nation union all select 'regions/' || r_regionkey || '.md' from region
 union all select * from (values ('data/x.csv'), ('nations/log.md'), ('regions/log.md'), ('index.md'), ('nations/index.md'), ('regions/index.md'), ('data/index.md'), ('empty/index.md'), ('empty/inner/index.md')) t(path)""")
def bundle_inventory(spark, d):
    return bundle.inventory(spark, _on_disk(spark, d))


@query("select 'nations/log.md' as log_path, 0 as day_pos, '2024-01-01' as date union all select 'regions/log.md', null, null")
def bundle_logs(spark, d):
    return bundle.read_logs(spark, _on_disk(spark, d)).select("log_path", "day_pos", "date")


@query(_sql_rows([("version", "0.2"), ("root", "b"), ("available", "b"), ("empty index", "# Subdirectories\n\n- [inner/](inner/index.md)\n\n"), ("inner index", "\n"), ("data index", "# Files\n\n- [x.csv](x.csv)\n\n")], "what, said"))
def bundle_on_disk(spark, d):
    root = _on_disk(spark, d)

    def text(name):
        with open(os.path.join(root, name), encoding="utf-8") as f:
            return f.read()

    top = os.path.dirname(root)
    return _values(spark, [("version", bundle.declared_version(root)), ("root", " ".join(os.path.relpath(r, top) for r in bundle.discover(top))), ("available", " ".join(os.path.relpath(r, top) for r in bundle.available(f"{top}:/nowhere"))),
                           ("empty index", text("empty/index.md")), ("inner index", text("empty/inner/index.md")), ("data index", text("data/index.md"))], "what string, said string")


@query("select 'nations/' || n_nationkey as concept_id, 'nations/' || n_nationkey as stated from nation where n_nationkey % 2 = 0")
def filter_selectors(spark, d):
    wanted = [filters.parse_equals("type=Nation"), filters.present("description")]
    return filters.where(carriers.nations(spark, d), wanted).select("concept_id", F.concat(F.lit("nations/"), F.regexp_extract(values.text(values.get(F.col("fm"), "description")), "[0-9]+", 0)).alias("stated"))


def _stored(spark, d) -> DataFrame:
    """Customers as a stored corpus, in a folder of its own."""
    at = "file://" + os.path.join(_scratch(spark), "customers")
    store.save(carriers.customers(spark, d), at)
    return store.load(spark, at)


_STATUS = "case when c_acctbal < 0 then 'deprecated' when c_custkey % 3 = 0 then 'draft' end"


@query(f"select 'customers/' || c_custkey as concept_id from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and {_STATUS} = 'draft'")
def stored_filter(spark, d):
    wanted = [filters.parse_equals(x) for x in ("type=Customer", "tags=BUILDING", "tags=MACHINERY", "status=draft")]
    return store.where(_stored(spark, d), wanted).select("concept_id")


@query(f"""select 'customers/' || c_custkey as concept_id, 'Customer' as type, coalesce({_STATUS}, '-') as status, c_mktsegment || ', nation-' || c_nationkey as tags, 'process:load' || c_nationkey as "generated.by", c_name as title
 from customer where c_acctbal >= 0 and c_custkey % 3 <> 0 and c_custkey % 5 = 0""")
def stored_listing(spark, d):
    return store.listing(_stored(spark, d), [filters.absent("status"), filters.present("note"), filters.present("generated.by")], ["status", "tags", "generated.by"])
