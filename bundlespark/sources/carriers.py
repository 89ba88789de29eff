"""Concepts from ordinary tables, through the producer functions: what the queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.concepts import from_rows, project
from . import markdown


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores, whatever its files give: rows here are narrow and the work on each is much.

    One small file gives one task, and a file cut in more tasks than it has row groups leaves
    the others without rows, so the number of tasks doesn't tell.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, df._jdf.queryExecution().toRdd().getNumPartitions()))


def _when(condition: Column, value) -> Column:
    return F.when(condition, value if isinstance(value, Column) else F.lit(value))


def _at(key: Column) -> Column:
    return F.concat(F.lit("2024-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))


def _read(out: DataFrame, facts: bool | str) -> DataFrame:
    return markdown.with_links(out) if facts == "links" else markdown.with_facts(out) if facts else out


def customers(spark: SparkSession, sf_dir: str, facts: bool | str = False) -> DataFrame:
    """customers/KEY: tags, a status that some lack, verified in each of its spellings, a handle, a null key."""
    t = spread(table(spark, sf_dir, "customer"))
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    by = lambda who: F.struct(F.concat(F.lit(who), nation).alias("by"), _at(k).alias("at"))
    bare = F.to_json(by("human:n"))
    listed = F.to_json(F.array(by("process:p"), F.struct(F.lit(None).cast("string").alias("by"), _at(k).alias("at"))))
    mixed = F.to_json(F.array(by("human:n"), by("loader/")))
    verified = F.parse_json(F.when(k % 4 == 0, bare).when(k % 4 == 1, listed).when(k % 4 == 2, mixed))
    fm = F.struct(
        F.lit("Customer").alias("type"), F.col("c_name").alias("title"), F.array("c_mktsegment", F.concat(F.lit("nation-"), nation)).alias("tags"),
        F.when(F.col("c_acctbal") < 0, "deprecated").when(k % 3 == 0, "draft").alias("status"), verified.alias("verified"),
        F.concat(F.lit("CUS-"), (k % 1000 + 1).cast("string")).alias("docId"), (F.col("c_acctbal") > 5000).alias("vip"),
        _when(k % 5 == 0, F.parse_json(F.lit("null"))).alias("note"), F.concat(F.lit("2024-0"), (k % 9 + 1).cast("string"), F.lit("-15")).alias("stale_after"),
        F.struct(F.concat(F.lit("process:load"), nation).alias("by"), _at(k).alias("at")).alias("generated"))
    body = F.concat(F.lit("Lives in [home](/nations/"), nation, F.lit(".md), see also [region](../regions/"), (F.col("c_nationkey") % 7).cast("string"), F.lit(".md#top) and `[code](/x.md)`.\n"))
    out = project(from_rows(t, F.concat(F.lit("customers/"), k.cast("string")), fm, body))
    return _read(out, facts)


def nations(spark: SparkSession, sf_dir: str, facts: bool | str = False) -> DataFrame:
    t = table(spark, sf_dir, "nation")
    fm = F.struct(F.lit("Nation").alias("type"), F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("number "), F.col("n_nationkey").cast("string"))).alias("description"))
    body = F.concat(F.lit("Part of [it](/regions/"), F.col("n_regionkey").cast("string"), F.lit(".md).\n"))
    out = project(from_rows(t, F.concat(F.lit("nations/"), F.col("n_nationkey").cast("string")), fm, body))
    return _read(out, facts)


def regions(spark: SparkSession, sf_dir: str, facts: bool | str = False) -> DataFrame:
    t = table(spark, sf_dir, "region")
    fm = F.struct(F.lit("Region").alias("type"), F.col("r_name").alias("title"))
    out = project(from_rows(t, F.concat(F.lit("regions/"), F.col("r_regionkey").cast("string")), fm, F.lit("See [top](/index.md).\n")))
    return _read(out, facts)


def geography(spark: SparkSession, sf_dir: str, facts: bool | str = True) -> DataFrame:
    return customers(spark, sf_dir, facts).unionByName(nations(spark, sf_dir, facts)).unionByName(regions(spark, sf_dir, facts))


def orders(spark: SparkSession, sf_dir: str, facts: bool | str = False, lines: bool = True) -> DataFrame:
    """orders/KEY: generated on the order's day, its lines as records, sources with and without windows."""
    t = spread(table(spark, sf_dir, "orders")) if not lines else table(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    if lines:
        each = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey")).agg(F.sort_array(F.collect_list(F.struct(
            F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").cast("int").alias("qty")))).alias("lines"))
        t = t.join(each, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    else:
        t = t.withColumn("lines", F.lit(None).cast("array<struct<line:int>>"))
    window = F.struct(F.lit("2024-01-01").alias("from"), F.when(key % 2 == 0, "2024-03-31").alias("to"))
    sources = F.array(
        F.struct(F.lit("s1").alias("id"), F.lit("/data/a.csv").alias("resource"), F.concat(F.lit("human:u"), (key % 10).cast("string")).alias("author"), (key % 100).alias("usage_count"), F.when(key % 3 == 0, window).alias("usage_window")),
        F.struct(F.when(key % 4 != 0, F.lit("s1")).alias("id"), F.when(key % 5 != 0, F.lit("/data/b.csv")).alias("resource"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("bigint").alias("usage_count"), F.lit(None).cast("struct<from:string,to:string>").alias("usage_window")))
    fm = F.struct(
        F.lit("Order").alias("type"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), F.struct(F.lit("process:orders").alias("by"), day.alias("at")).alias("generated"),
        F.when(F.size("lines") > 0, F.col("lines")).alias("lines"), sources.alias("sources"), F.struct(F.lit("2023-01-01").alias("from"), F.lit("2023-12-31").alias("to")).alias("usage_window"),
        F.concat(F.lit("CUS-"), (F.col("o_custkey") % 1000 + 1).cast("string")).alias("customer"), F.concat(F.lit("ORD-"), key.cast("string")).alias("docId"))
    to = F.col("o_custkey").cast("string")
    body = F.concat(F.lit("For [a](/customers/"), to, F.lit(".md) and again [b](../customers/"), to, F.lit(".md).\n"))
    out = project(from_rows(t, F.concat(F.lit("orders/"), key.cast("string")), fm, body))
    return _read(out, facts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LANG/SOURCE/dID: resource, generated on a day that the id gives, the text as body."""
    t = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    fm = F.struct(F.concat(F.lit("Text "), F.col("lang")).alias("type"), F.concat(F.lit("corpus://"), F.col("source")).alias("resource"),
                  _when(key % 10 != 0, F.struct(F.lit("process:crawl").alias("by"), F.concat(F.lit("2024-02-"), F.lpad((key % 28 + 1).cast("string"), 2, "0")).alias("at"))).alias("generated"))
    return project(from_rows(t, F.concat_ws("/", "lang", "source", F.concat(F.lit("d"), key.cast("string"))), fm, F.coalesce("text", F.lit(""))))


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in each language's folder, and in the folders of sources whose number is even: one day, the 10th and the 20th."""
    t = table(spark, sf_dir, "documents")
    lang = t.select(F.concat("lang", F.lit("/log.md")).alias("log_path"), F.lit("2024-02-10").alias("date")).distinct()
    own = t.where(F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 2 == 0).select(F.concat_ws("/", "lang", "source", F.lit("log.md")).alias("log_path"), F.lit("2024-02-20").alias("date")).distinct()
    return lang.unionByName(own).select("log_path", F.lit(0).alias("day_pos"), "date", F.lit(0).alias("entry_pos"), F.lit("Update").alias("kind"), F.lit("x").alias("text"))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each event type: a day for each user of events in the order of user ids, so days come out of order."""
    t = table(spark, sf_dir, "events")
    day = t.groupBy("event_type", "user_id").agg(F.min(F.date_format("ts", "yyyy-MM-dd")).alias("date"), F.count(F.lit(1)).alias("n"))
    each = day.select(F.concat(F.lit("events/"), "event_type", F.lit("/log.md")).alias("log_path"), F.col("user_id").cast("int").alias("day_pos"), "date", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("entry_pos"))
    return each.select("log_path", "day_pos", "date", "entry_pos", F.lit("Event").alias("kind"), F.lit("x").alias("text"))


def parts(spark: SparkSession, sf_dir: str, facts: bool | str = True) -> DataFrame:
    """computations/KEY: attested computations with every combination of file, blocks and halves; other parts are notes."""
    t = spread(table(spark, sf_dir, "part"))
    k = F.col("p_partkey")
    fm = F.struct(
        F.when(k % 2 == 0, "Attested Computation").otherwise("Note").alias("type"), F.col("p_name").alias("title"), F.col("p_brand").alias("description"), F.struct(F.lit("human:p").alias("by"), F.lit("2024-01-01").alias("at")).alias("generated"),
        _when(k % 6 != 0, "bigquery").alias("runtime"), _when(k % 4 == 0, F.array(F.struct(F.lit("year").alias("name"), F.lit("integer").alias("type"), (k % 8 == 0).alias("required")))).alias("parameters"),
        _when(k % 10 < 4, "sql/q.sql").alias("computation"), _when(k % 3 == 0, F.struct(F.lit("/tools/run.py").alias("resource"))).alias("executor"), _when(k % 5 == 0, F.struct(F.lit("../tools/check.py").alias("resource"))).alias("attester"))
    block = "```sql\nselect 1\n```\n"
    body = F.concat(F.lit("Text.\n\n# Computation\n\n"), F.when(k % 7 < 3, block).when(k % 7 == 3, block + "\n" + block).otherwise("None.\n"), F.lit("\n# Other\n\n```\nx\n```\n"))
    return _read(project(from_rows(t, F.concat(F.lit("computations/"), k.cast("string")), fm, body)), facts)
