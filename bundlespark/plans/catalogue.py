"""The registered queries of the library's operators and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import actors, paths, values
from ..operators import computations, concepts, filters, graph, handles, index, logs, provenance, trust, validate
from ..sources import bundle, carriers
from . import check, profile

TODAY = "2024-05-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_CUST = """(select *, 'customers/' || c_custkey as concept_id,
 case when c_acctbal < 0 then 'deprecated' when c_custkey % 3 = 0 then 'draft' end as status,
 '2024-01-' || lpad(cast(c_custkey % 28 + 1 as varchar), 2, '0') || 'T00:00:00Z' as seen from customer)"""
_ORD = "(select *, 'orders/' || o_orderkey as concept_id, strftime(o_orderdate, '%Y-%m-%d') as day from orders)"
_DOC = "(select *, lang || '/' || source || '/d' || doc_id as concept_id from documents)"


def _ids(df: DataFrame) -> DataFrame:
    return df.select("concept_id")


def _eq(*raw: str):
    return [filters.parse_equals(r) for r in raw]


@query(f"select concept_id from {_CUST} where c_mktsegment = 'BUILDING'")
def filter_tag_any(spark, d):
    return _ids(filters.where(carriers.customers(spark, d), _eq("tags=BUILDING")))


@query(f"select concept_id from {_CUST} where c_mktsegment in ('BUILDING', 'MACHINERY')")
def filter_or_same_key(spark, d):
    return _ids(filters.where(carriers.customers(spark, d), _eq("tags=BUILDING", "tags=MACHINERY")))


@query(f"select concept_id from {_CUST} where c_mktsegment = 'BUILDING' and status = 'draft'")
def filter_and_keys(spark, d):
    return _ids(filters.where(carriers.customers(spark, d), _eq("tags=BUILDING", "status=draft", "type=Customer")))


@query(f"select concept_id from {_CUST} where status is null")
def filter_missing_status(spark, d):
    return _ids(filters.where(carriers.customers(spark, d), [filters.absent("status")]))


@query(f"select concept_id from {_CUST} where status is not null")
def filter_present(spark, d):
    return _ids(filters.where(carriers.customers(spark, d), [filters.present("status")]))


@query("select '' as concept_id where false")
def filter_contradiction_empty(spark, d):
    return _ids(filters.where(carriers.customers(spark, d), [*_eq("status=draft"), filters.absent("status")]))


@query(f"select concept_id from {_ORD} where day = '1995-03-15'")
def filter_nested_record(spark, d):
    return _ids(filters.where(carriers.orders(spark, d, lines=False), _eq("generated.at=1995-03-15")))


@query(f"select concept_id from {_ORD} where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def filter_nested_list(spark, d):
    return _ids(filters.where(carriers.orders(spark, d), _eq("lines.flag=R")))


@query(f"select concept_id from {_ORD} where exists (select 1 from lineitem where l_orderkey = o_orderkey and cast(trunc(l_quantity) as int) = 7)")
def filter_number_as_text(spark, d):
    return _ids(filters.where(carriers.orders(spark, d), _eq("lines.qty=7")))


@query(f"select concept_id from {_CUST} where c_acctbal > 5000")
def filter_bool_as_text(spark, d):
    return _ids(filters.where(carriers.customers(spark, d), _eq("vip=true")))


@query(f"select concept_id from {_CUST} where c_custkey % 5 = 0")
def filter_null_present(spark, d):
    return _ids(filters.where(carriers.customers(spark, d), [filters.present("note")]))


@query(f"select concept_id, coalesce(status, 'stable') as status from {_CUST}")
def status_default_projection(spark, d):
    return carriers.customers(spark, d).select("concept_id", "status")


@query(f"select concept_id, 'Customer' as type, c_mktsegment || ', nation-' || c_nationkey as tags, coalesce(status, '-') as status, c_name as title from {_CUST}")
def concepts_listing(spark, d):
    return filters.listing(carriers.customers(spark, d), (), ["tags", "status"])


@query(f"""select concept_id, case c_custkey % 4 when 0 then 'human:n' || c_nationkey when 1 then 'process:p' || c_nationkey when 2 then 'human:n' || c_nationkey || ', loader/' || c_nationkey else '-' end as shown from {_CUST}""")
def show_nested_joined(spark, d):
    return carriers.customers(spark, d).select("concept_id", filters.show(("verified", "by")).alias("shown"))


@query(f"""select concept_id, 'docId,generated,' || case when c_custkey % 5 = 0 then 'note,' else '' end || 'stale_after,' || case when status is not null then 'status,' else '' end || 'tags,title,type,' ||
 case when c_custkey % 4 < 3 then 'verified,' else '' end || 'vip' as keys from {_CUST}""")
def frontmatter_keys(spark, d):
    return carriers.customers(spark, d).select("concept_id", F.array_join(values.keys(F.col("fm")), ",").alias("keys"))


@query(f"select concept_id from {_CUST} where c_custkey % 1000 + 1 = 7")
def find_by_handle(spark, d):
    return _ids(concepts.find_by_handle(carriers.customers(spark, d), " CUS-7 "))


_STALE = "'2024-0' || (c_custkey % 9 + 1) || '-15'"
_TIER = "case c_custkey % 4 when 3 then 'unverified' when 1 then 'machine-confirmed' else 'human-reviewed' end"


@query(f"select concept_id, {_TIER} as tier, coalesce(status, 'stable') as status, case when {_STALE} <= '{TODAY}' then 'stale since ' || {_STALE} else 'ok' end as staleness from {_CUST}")
def trust_report(spark, d):
    return trust.report(carriers.customers(spark, d), TODAY)


@query(f"select {_TIER} as tier, count(*) as n from {_CUST} group by 1")
def trust_tier_counts(spark, d):
    return carriers.customers(spark, d).groupBy(trust.tier(F.col("verified")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select concept_id, case when c_custkey % 4 < 3 then seen end as latest from {_CUST}")
def latest_verification(spark, d):
    return carriers.customers(spark, d).select("concept_id", trust.latest(F.col("verified")).alias("latest"))


@query(f"""select p_partkey as part, case p_partkey % 4 when 0 then 'none' when 1 then 'unparseable' when 2 then 'stale' else 'fresh' end as state from part""")
def staleness_states(spark, d):
    raw = F.when(F.col("p_partkey") % 4 == 1, "soon").when(F.col("p_partkey") % 4 == 2, TODAY).when(F.col("p_partkey") % 4 == 3, "2024-05-02")
    return carriers.table(spark, d, "part").select(F.col("p_partkey").alias("part"), trust.staleness(raw, TODAY)["state"].alias("state"))


@query(f"""select concept_id, case c_custkey % 5 when 0 then 'human' when 1 then 'process' when 2 then 'producer' else 'unclassified' end as kind,
 case c_custkey % 5 when 0 then c_name when 1 then c_name when 2 then 'a' end as id, case c_custkey % 5 when 2 then 'b/' || c_name end as version, true as same from {_CUST}""")
def actor_kinds(spark, d):
    k, name = F.col("c_custkey") % 5, F.col("c_name")
    raw = F.when(k == 0, F.concat(F.lit("human:"), name)).when(k == 1, F.concat(F.lit("process:"), name)).when(k == 2, F.concat(F.lit("a/b/"), name)).when(k == 3, "human:").otherwise(name)
    a = actors.parse(raw)
    return carriers.table(spark, d, "customer").select(F.concat(F.lit("customers/"), F.col("c_custkey").cast("string")).alias("concept_id"), a["kind"].alias("kind"), a["id"].alias("id"), a["version"].alias("version"), (actors.render(a) == raw).alias("same"))


@query(f"""select concept_id, 0 as pos, 's1' as label, '/data/a.csv' as resource, 'author human:u' || (o_orderkey % 10) || ', used ' || (o_orderkey % 100) || ' times' ||
 case when o_orderkey % 3 <> 0 then ' in 2023-01-01..2023-12-31' when o_orderkey % 2 = 0 then ' in 2024-01-01..2024-03-31' else ' since 2024-01-01' end as signals from {_ORD}
 union all select concept_id, 1, case when o_orderkey % 4 <> 0 then 's1' else '(no id)' end, '/data/b.csv', '' from {_ORD} where o_orderkey % 5 <> 0""")
def sources_report(spark, d):
    return provenance.report(carriers.orders(spark, d, lines=False), ordered=False)


@query("""select concept_id, case when o_orderkey % 5 = 0 then 1 end as without_resource, case when o_orderkey % 4 <> 0 then 's1' end as twice from """ + _ORD)
def source_problems(spark, d):
    o = carriers.orders(spark, d, lines=False).withColumns({"computation_blocks": F.expr("cast(array() as array<string>)"), "footnotes": F.expr("cast(array() as array<string>)")})
    found = validate.documents(o, strict=True)
    pick = lambda code: F.max(F.when(F.col("code") == code, F.col("detail")))
    some = found.groupBy("concept_id").agg(pick("SourceMissingResource").cast("int").alias("without_resource"), pick("DuplicateSourceId").alias("twice"))
    return o.select("concept_id").join(some, "concept_id", "left")


@query("""select 'customers/' || c_custkey as id, c_name as label, 'Customer' as type from customer union all select 'nations/' || n_nationkey, n_name, 'Nation' from nation union all select 'regions/' || r_regionkey, r_name, 'Region' from region""")
def graph_nodes(spark, d):
    return graph.nodes(carriers.geography(spark, d, facts=False)).select("id", "label", "type")


_EDGES = """(select 'customers/' || c_custkey as source, 'nations/' || c_nationkey as target from customer where c_nationkey in (select n_nationkey from nation)
 union select 'customers/' || c_custkey, 'regions/' || (c_nationkey % 7) from customer where c_nationkey % 7 in (select r_regionkey from region)
 union select 'nations/' || n_nationkey, 'regions/' || n_regionkey from nation)"""


@query(f"select source, target from {_EDGES}")
def graph_edges(spark, d):
    return graph.edges(carriers.geography(spark, d, "links"), ordered=False)


@query(f"""select id as concept_id, (select count(*) from {_EDGES} where source = id) as out_degree, (select count(*) from {_EDGES} where target = id) as in_degree
 from (select 'customers/' || c_custkey as id from customer union all select 'nations/' || n_nationkey from nation union all select 'regions/' || r_regionkey from region)""")
def graph_degrees(spark, d):
    return graph.degrees(carriers.geography(spark, d, "links"))


@query("""select 'customers/' || c_custkey as source, 1 as link_pos, 'regions/' || (c_nationkey % 7) as target from customer where c_nationkey % 7 not in (select r_regionkey from region)
 union all select 'regions/' || r_regionkey, 0, 'index' from region""")
def dangling_links(spark, d):
    return graph.dangling(carriers.geography(spark, d, "links"), ordered=False)


@query("select distinct 'orders/' || o_orderkey as source, 'customers/' || o_custkey as target from orders where o_custkey in (select c_custkey from customer)")
def graph_edges_dedup(spark, d):
    o = carriers.orders(spark, d, facts="links", lines=False).select("concept_id", "source_path", "links")
    none = F.expr("cast(array() as array<string>)").alias("links")
    return graph.edges(o.unionByName(carriers.customers(spark, d).select("concept_id", "source_path", none)), ordered=False).where("source like 'orders/%'")


@query("select 'customers/' || c_custkey as concept_id, 2 as copies from customer where c_custkey % 10 = 0")
def duplicate_concept_ids(spark, d):
    c = carriers.customers(spark, d).select("concept_id")
    return graph.duplicate_ids(c.unionByName(carriers.table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("customers/"), F.col("c_custkey").cast("string")).alias("concept_id"))))


@query("""select page_id, 'external' as url_kind, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, case page_id % 4 when 0 then 'pages/x' || page_id when 1 then 'a/b' when 3 then 'top.md' end as path,
 case page_id % 4 when 2 then 'escape' else 'bundle' end as kind from pages""")
def path_classification(spark, d):
    t = carriers.table(spark, d, "pages")
    k = F.col("page_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("./x"), F.col("page_id").cast("string"), F.lit("?q=1#f"))).when(k == 1, "/a/./c/../b").when(k == 2, "../../up").otherwise(" ../top.md ")
    at = F.lit("pages/p.md")
    return t.select("page_id", paths.classify(at, F.col("url"))["kind"].alias("url_kind"), paths.classify(at, F.col("url"))["scheme"].alias("scheme"), paths.classify(at, raw)["path"].alias("path"), paths.classify(at, raw)["kind"].alias("kind"))


_PART = "(select *, 'computations/' || p_partkey as concept_id from part)"


@query(f"""select concept_id, 1 as pos, 'computation' as field, 'computations/sql/q.sql' as target, 'sql/q.sql' as alternative from {_PART} where p_partkey % 10 < 4
 union all select concept_id, 3, 'attester.resource', 'tools/check.py', null from {_PART} where p_partkey % 5 = 0""")
def dangling_frontmatter_path(spark, d):
    have = spark.createDataFrame([("sql/q.sql",), ("tools/run.py",)], "path string")
    return validate.dangling_paths(carriers.parts(spark, d), have)


_LOG = "lang || case when cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 2 = 0 then '/' || source else '' end || '/log.md'"
_NEW = "case when cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 2 = 0 then '2024-02-20' else '2024-02-10' end"
_DAY = "'2024-02-' || lpad(cast(doc_id % 28 + 1 as varchar), 2, '0')"


@query(f"select concept_id, {_LOG} as log_path from {_DOC}")
def nearest_log(spark, d):
    return logs.nearest(carriers.documents(spark, d), carriers.document_logs(spark, d))


@query(f"select concept_id, {_DAY} as date, {_LOG} as log_path, {_NEW} as newest from {_DOC} where doc_id % 10 <> 0 and {_DAY} > {_NEW}")
def log_staleness(spark, d):
    return logs.stale(carriers.documents(spark, d), carriers.document_logs(spark, d))


@query(f"select concept_id, {_LOG} as log_path from {_DOC} where doc_id % 3 = 0 and {_LOG} <> 'en/log.md'")
def log_drift(spark, d):
    changed = carriers.documents(spark, d).where(F.regexp_extract("concept_id", "d([0-9]+)$", 1).cast("bigint") % 3 == 0).select(F.col("source_path").alias("path"))
    return logs.drift(carriers.documents(spark, d), carriers.document_logs(spark, d), changed.unionByName(spark.createDataFrame([("en/log.md",)], "path string")))


_EVENTS = "(select 'events/' || event_type || '/log.md' as log_path, cast(user_id as int) as day_pos, min(strftime(ts, '%Y-%m-%d')) as date, count(*) as entries from events group by event_type, user_id)"


@query(f"select log_path, day_pos, date, entries from {_EVENTS}")
def log_days(spark, d):
    return logs.days(carriers.event_logs(spark, d))


@query(f"""select log_path, day_pos, 'LogDaysOutOfOrder' as code, date, next_date, false as structural from (select *, lead(date) over (partition by log_path order by day_pos) as next_date from {_EVENTS}) where date < next_date""")
def log_out_of_order(spark, d):
    return logs.check(carriers.event_logs(spark, d))


_BLOCKS = "case when p_partkey % 7 < 3 then 1 when p_partkey % 7 = 3 then 2 else 0 end"
_FILE = "case when p_partkey % 10 < 4 then 1 else 0 end"


@query(f"""select concept_id, case when p_partkey % 6 <> 0 then 'bigquery' else '(no runtime)' end as runtime,
 case when p_partkey % 8 = 0 then 'year (integer, required)' when p_partkey % 4 = 0 then 'year (integer)' else '(no parameters)' end as parameters,
 case when {_FILE} + {_BLOCKS} = 0 then '(no computation)' when {_FILE} + {_BLOCKS} > 1 then '(' || ({_FILE} + {_BLOCKS}) || ' computations)' when {_FILE} = 1 then 'sql/q.sql' else 'inline' end as location,
 case when p_partkey % 15 = 0 then 'executor + attester' when p_partkey % 3 = 0 then 'executor' when p_partkey % 5 = 0 then 'attester' else '(neither)' end as contract from {_PART} where p_partkey % 2 = 0""")
def computations_report(spark, d):
    return computations.report(carriers.parts(spark, d))


@query(f"""select concept_id, case when {_FILE} = 1 and {_BLOCKS} > 0 then 'AttestedComputationHasBothComputations' when {_BLOCKS} > 1 then 'AttestedComputationHasManyBlocks' else 'AttestedComputationHasNoComputation' end as code
 from {_PART} where p_partkey % 2 = 0 and (({_FILE} = 1 and {_BLOCKS} > 0) or {_BLOCKS} > 1 or {_FILE} + {_BLOCKS} = 0)
 union all select concept_id, 'AttestedComputationMissingRuntime' from {_PART} where p_partkey % 2 = 0 and p_partkey % 6 = 0""")
def computation_contract(spark, d):
    return validate.documents(carriers.parts(spark, d), strict=True, version="0.2").select("concept_id", "code")


@query("""select doc_id, case when doc_id % 3 = 0 then 'b' when doc_id % 3 = 1 then 'x' else '' end as unknown_labels, case when doc_id % 3 = 0 then 'c' when doc_id % 3 = 1 then 'c' else '' end as uncited_ids from documents""")
def footnote_join(spark, d):
    k = F.col("doc_id") % 3
    labels = F.when(k == 0, F.array(F.lit("a"), F.lit("b"))).when(k == 1, F.array(F.lit("a"), F.lit("x"))).otherwise(F.expr("cast(array() as array<string>)"))
    found = provenance.uncited(labels, F.array(F.lit("a"), F.lit("c")))
    return carriers.table(spark, d, "documents").select("doc_id", F.array_join(found["unknown_labels"], ",").alias("unknown_labels"), F.array_join(found["uncited_ids"], ",").alias("uncited_ids"))


@query(f"select 'CUS' as prefix, cast(c_custkey % 1000 + 1 as bigint) as number, concept_id from {_CUST}")
def handles_list(spark, d):
    return handles.in_bundle(carriers.customers(spark, d), "docId").withColumn("number", F.col("number").cast("bigint"))


@query("select 'CUS' as prefix, cast(max(c_custkey % 1000 + 1) + 1 as bigint) as number from customer union all select 'NEW', 1")
def id_next(spark, d):
    c = carriers.customers(spark, d)
    return handles.next_number(c, "docId", "CUS").unionByName(handles.next_number(c, "docId", "NEW")).withColumn("number", F.col("number").cast("bigint"))


_HANDLE = f"(select 'CUS-' || (c_custkey % 1000 + 1) as handle, concept_id from {_CUST})"


@query(f"select handle, first_id, concept_id from (select handle, concept_id, min(concept_id) over (partition by handle) as first_id from {_HANDLE}) where concept_id <> first_id")
def duplicate_handles(spark, d):
    return handles.duplicates(carriers.customers(spark, d), "docId")


@query("select 'CUS' as prefix")
def observed_prefixes(spark, d):
    return handles.observed_prefixes(carriers.customers(spark, d))


@query(f"""select 'orders/' || l_orderkey as concept_id, l_returnflag as value, string_agg(cast(rn - 1 as varchar), ',' order by rn) as indexes from
 (select l_orderkey, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag, l_linestatus, cast(trunc(l_quantity) as int)) as rn from lineitem where l_orderkey in (select o_orderkey from orders)) group by 1, 2 having count(*) > 1""")
def list_uniqueness(spark, d):
    return handles.unique_values(carriers.orders(spark, d), "lines", "flag", ordered=False).withColumn("indexes", F.array_join("indexes", ","))


def _profile(fields: dict | None = None, types: list | None = None, **more) -> profile.Compiled:
    import json

    return profile.compile_profile(profile.load(json.dumps({"name": "p", "okfVersion": "0.2", "frontmatter": fields or {}, "types": types or [], "allowUnknownTypes": True, **more})))


def _deviations(concepts_, compiled, **how):
    return check.check(concepts_, compiled, ordered=False, **how).select("concept_id", "code", "path")


@query(f"select concept_id, 'MissingProfileField' as code, 'status' as path from {_CUST} where status is null")
def profile_required(spark, d):
    return _deviations(carriers.customers(spark, d), _profile({"required": [{"field": "status"}]}))


@query(f"select concept_id, 'MissingRecommendedProfileField' as code, 'verified' as path from {_CUST} where c_custkey % 4 in (0, 3)")
def profile_recommended(spark, d):
    return _deviations(carriers.customers(spark, d), _profile({"recommended": [{"field": "verified"}]}), strict=True)


@query(f"select concept_id, 'MissingProfileField' as code, 'verified' as path from {_CUST} where c_custkey % 4 in (0, 3) and status = 'draft'")
def profile_conditional(spark, d):
    rules = {"required": [{"field": "verified", "when": {"field": "status", "hasValue": ["draft"]}}], "optional": [{"field": "status", "cardinality": "scalar", "allowedValues": ["draft", "deprecated"]}]}
    return _deviations(carriers.customers(spark, d), _profile(rules))


@query(f"select concept_id, 'ValueNotInVocabulary' as code, 'status' as path from {_CUST} where status = 'deprecated'")
def profile_vocabulary(spark, d):
    return _deviations(carriers.customers(spark, d), _profile({"optional": [{"field": "status", "allowedValues": ["draft", "stable"]}]}))


@query(f"select concept_id, 'CardinalityMismatch' as code, 'tags' as path from {_CUST} union all select concept_id, 'CardinalityMismatch', 'verified' from {_CUST} where c_custkey % 4 = 0")
def profile_cardinality(spark, d):
    return _deviations(carriers.customers(spark, d), _profile({"optional": [{"field": "tags", "cardinality": "scalar"}, {"field": "verified", "cardinality": "list"}]}))


@query(f"select concept_id, 'ValueFormatMismatch' as code, 'title' as path from {_CUST}")
def profile_format(spark, d):
    rules = [{"field": "title", "format": "date"}, {"field": "stale_after", "format": "date"}, {"field": "docId", "format": {"documentHandle": "CUS"}}, {"field": "vip", "format": "boolean"}]
    return _deviations(carriers.customers(spark, d), _profile({"optional": rules}))


@query(f"select concept_id, 'FieldNotInProfile' as code, 'docId' as path from {_CUST} union all select concept_id, 'FieldNotInProfile', 'vip' from {_CUST}")
def profile_closed(spark, d):
    return _deviations(carriers.customers(spark, d), _profile({"optional": [{"field": "note"}]}, allowUnknownFields=False))


@query(f"""select 'orders/' || l_orderkey as concept_id, 'ValueNotInVocabulary' as code, 'lines[' || (rn - 1) || '].flag' as path from
 (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag, l_linestatus, cast(trunc(l_quantity) as int)) as rn from lineitem where l_orderkey in (select o_orderkey from orders)) where l_returnflag = 'R'""")
def profile_nested(spark, d):
    rules = {"optional": [{"field": "lines", "elementFields": {"required": [{"field": "flag", "allowedValues": ["A", "N"]}, {"field": "qty", "format": "non-negative-integer"}]}}]}
    return _deviations(carriers.orders(spark, d), _profile(rules))


@query(f"select concept_id, 'ValueFormatMismatch' as code, 'generated.by' as path from {_CUST}")
def profile_object(spark, d):
    return _deviations(carriers.customers(spark, d), _profile({"required": [{"field": "generated", "objectFields": {"required": [{"field": "by", "format": "human-actor"}, {"field": "at", "format": "rfc3339-utc"}]}}]}))


@query(f"select concept_id, 'PathPatternMismatch' as code, '' as path from {_DOC} where lang = 'en' and source <> 'src1'")
def profile_path_pattern(spark, d):
    return _deviations(carriers.documents(spark, d), _profile(types=[{"type": "Text en", "pathPattern": "*/src1/**"}, {"type": "Text fr", "pathPattern": "fr/*/*"}]))


@query(f"select concept_id, 'ResourceSchemeMismatch' as code, 'resource' as path from {_DOC} where lang = 'de'")
def profile_resource_scheme(spark, d):
    return _deviations(carriers.documents(spark, d), _profile(types=[{"type": "Text en", "resourceScheme": "corpus"}, {"type": "Text de", "resourceScheme": "https"}]))


@query(f"select concept_id, 'TypeNotInProfile' as code, 'type' as path from {_DOC} where lang <> 'en'")
def profile_unknown_type(spark, d):
    return _deviations(carriers.documents(spark, d), _profile(types=[{"type": "Text en"}], allowUnknownTypes=False))


@query(f"""select concept_id, 'DanglingHandleReference' as code, 'customer' as path from {_ORD} where o_custkey % 1000 + 1 not in (select c_custkey % 1000 + 1 from customer)
 union all select concept_id, case when o_orderkey = 0 then 'MalformedDocumentReference' else 'ReferenceHandlePrefixMismatch' end, 'docId' from {_ORD}
 union all select concept_id, 'DuplicateDocumentId', 'docId' from (select concept_id, min(concept_id) over (partition by handle) as first_id from {_HANDLE}) where concept_id <> first_id""")
def profile_reference(spark, d):
    rules = [{"field": "customer", "reference": {"localPrefix": "CUS"}}, {"field": "docId", "reference": {"localPrefix": "CUS"}}]
    types = [{"type": "Customer", "idPrefix": "CUS"}, {"type": "Order", "frontmatter": {"required": rules}}]
    both = carriers.customers(spark, d).unionByName(carriers.orders(spark, d, lines=False))
    return _deviations(both, _profile(types=types, idField="docId"))


@query(f"""select concept_id, 'DanglingPathReference' as code, 'computation' as path from {_PART} where p_partkey % 10 < 4
 union all select concept_id, 'DanglingPathReference', 'attester.resource' from {_PART} where p_partkey % 5 = 0""")
def profile_path_reference(spark, d):
    rules = {"optional": [{"field": "computation", "path": {}}, {"field": "executor", "objectFields": {"required": [{"field": "resource", "path": {}}]}}, {"field": "attester", "objectFields": {"required": [{"field": "resource", "path": {}}]}}]}
    return _deviations(carriers.parts(spark, d), _profile(rules), inventory=spark.createDataFrame([("tools/run.py",)], "path string"))


@query("select * from (values ('UndeclaredField', 'segmnt=x'), ('ValueOutOfVocabulary', 'segment=NAVAL'), ('ValueOutOfVocabulary', 'type=Vendor')) t(code, filter)")
def filter_profile_check(spark, d):
    rules = {"optional": [{"field": "segment", "allowedValues": ["BUILDING", "MACHINERY"]}]}
    found = profile.check_filters(_profile(rules, [{"type": "Customer"}], allowUnknownTypes=False), [], _eq("segment=NAVAL", "segment=BUILDING", "segmnt=x", "type=Vendor", "generated.by=z"))
    return spark.createDataFrame([(c, f) for c, f, _ in found], "code string, filter string")


@query("""select 'nations' as dir, 'Nation' as type, '- [' || n_name || '](' || n_nationkey || '.md)' || case when n_nationkey % 2 = 0 then ' - number ' || n_nationkey else '' end as bullet from nation""")
def index_bullets(spark, d):
    return index.bullets(carriers.nations(spark, d)).select("dir", "type", "bullet")


@query("""select 'nations' as dir, '# Nation' || chr(10) || chr(10) || string_agg('- [' || n_name || '](' || n_nationkey || '.md)' || case when n_nationkey % 2 = 0 then ' - number ' || n_nationkey else '' end, chr(10) order by 'nations/' || n_nationkey || '.md') || chr(10) || chr(10) as text from nation
 union all select '', '# Subdirectories' || chr(10) || chr(10) || '- [nations/](nations/index.md)' || chr(10) || chr(10)""")
def index_text(spark, d):
    return index.render(carriers.nations(spark, d))


@query("""select 2 as phase, 'customers/' || c_custkey as concept_id, 1 as pos, 'DanglingReference' as code, 'regions/' || (c_nationkey % 7) as detail from customer where c_nationkey % 7 not in (select r_regionkey from region)
 union all select 2, 'regions/' || r_regionkey, 0, 'DanglingReference', 'index' from region""")
def validate_permissive(spark, d):
    return validate.validate(carriers.geography(spark, d), ordered=False)


@query("""select code, count(*) as n from (
 select 'MissingRecommendedField' as code from customer union all select 'MissingRecommendedField' from nation where n_nationkey % 2 = 1 union all select 'MissingRecommendedField' from region
 union all select 'MissingGeneratedField' from nation union all select 'MissingGeneratedField' from region
 union all select 'DanglingReference' from customer where c_nationkey % 7 not in (select r_regionkey from region) union all select 'DanglingReference' from region) group by code""")
def validate_strict(spark, d):
    return validate.validate(carriers.geography(spark, d), strict=True, version="0.2", ordered=False).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"select concept_id, true as same from {_CUST}")
def roundtrip_serialize(spark, d):
    from ..sources import yamlio

    def back(batches):
        for pdf in batches:
            read = [yamlio.parse(t) for t in pdf["text"]]
            yield pdf.assign(again=[yamlio.to_json(fm) for fm, _ in read], body=[b for _, b in read])[["source_path", "again", "body"]]

    c = carriers.customers(spark, d)
    texts = bundle.serialized(c).mapInPandas(back, "source_path string, again string, body string")
    same = (F.to_json(F.parse_json("again")) == F.to_json("fm")) & (F.col("x.body") == F.col("c.body"))
    return c.alias("c").join(texts.alias("x"), "source_path").select("concept_id", same.alias("same"))
