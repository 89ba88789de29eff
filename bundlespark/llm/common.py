"""What the operators share: shared storage, ranks, joins with hot keys, components.

Everything here is bounded per task and on the driver:

* ``materialise`` cuts lineage with a Parquet table in the folder that
  ``spark.checkpoint.dir`` names, so a lost executor never costs more than the
  stage it was running;
* ``with_rank`` numbers the rows of a key without ever sorting a key in one task;
* ``skew_join`` broadcasts only keys that hold over a thousandth of the rows, of
  which there can be at most a thousand;
* ``components`` is the alternating large-star / small-star algorithm; a task holds
  at most FOREST nodes at a time.

Tables that a result still reads stay until ``drop_written``; others are deleted as soon
as the step that needed them is done.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key with more than this share of the rows is hot. At most 1/HOT_SHARE keys are.
HOT_SHARE = 1e-3
#: Rows that one task ranks at a time.
RANK_ROWS = 50_000
#: Nodes of a forest that a task holds at a time.
FOREST = 1_000_000

_KEY = "bundlespark.scratch"
_written: list["Written"] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one, on a local master only."""
    for conf in (spark.conf, spark.sparkContext.getConf()):
        found = conf.get(_KEY, None) or conf.get("spark.checkpoint.dir", None)
        if found:
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="bundlespark-")
    spark.conf.set(_KEY, made)
    return made


class Written:
    """A table in the shared folder: ``df`` reads it, ``drop()`` deletes its files."""

    def __init__(self, df: DataFrame, at: str):
        self.spark, self.at = df.sparkSession, at
        schema = df.schema
        df.write.parquet(at)
        self.df = self.spark.read.schema(schema).parquet(at)
        _written.append(self)

    def drop(self) -> None:
        if self in _written:
            _written.remove(self)
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, what: str) -> Written:
    """Writes ``df`` to a fresh folder of the shared one and reads it from there."""
    return Written(df, f"{shared_dir(df.sparkSession)}/bundlespark/{what}-{uuid.uuid4().hex}")


def drop_written(spark: SparkSession) -> None:
    """Deletes the tables that results of this session still read; call it when those are consumed."""
    for table in [t for t in _written if t.spark is spark]:
        table.drop()


def fresh(taken, name: str) -> str:
    """``name``, or with underscores until no column of ``taken`` has it (in any case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def with_rank(df: DataFrame, keys: list[str], salt: Column, order: list[str], rows: int, name: str = "rank") -> DataFrame:
    """Adds a number from 0, gapless within equal ``keys``.

    A key's rows are dealt to buckets by ``salt`` (a long hash); each bucket is
    numbered on its own and starts where the earlier buckets of its key end, so no
    task ever holds a whole key. ``order`` makes a second run of a task number alike
    (rows equal in it must be equal throughout); ``rows``: the rows of ``df``, for the
    number of buckets. Keys must not be null.
    """
    buckets = max(32, 4 * -(-rows // RANK_ROWS))
    b, n, at = "_bucket", "_n", "_from"
    dealt = df.withColumn(b, F.pmod(salt, F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(at, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    within = Window.partitionBy(*keys, b).orderBy(*order)
    numbered = dealt.withColumn("_r", F.row_number().over(within) - 1)
    return numbered.join(starts, [*keys, b]).withColumn(name, (F.col("_r") + F.col(at)).cast("long")).drop("_r", at, b)


def skew_join(big: DataFrame, small: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``big`` joined (inner or left) with ``small``, which has one row a key and in ``count`` its rows of ``big``.

    Keys with over a thousandth of ``total`` rows, fewer than a thousand, go by
    broadcast; the others are small enough for any task of a shuffle.
    """
    hot_at = max(1.0, total * HOT_SHARE)
    rest = [c for c in small.columns if c not in (key, count)]
    hot = small.filter(F.col(count) > hot_at).select(key, *rest)
    cold = small.filter(F.col(count) <= hot_at).select(key, *rest)
    return big.join(F.broadcast(hot), key).unionByName(
        big.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how))


def _local_forest(batches):
    """Arrow batches of (a, b) in; the links of spanning forests of them, a star a tree, out; FOREST nodes at a time."""
    import pyarrow as pa

    up: dict[int, int] = {}

    def root(x):
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def stars():
        nodes = list(up)
        for i in range(0, len(nodes), 50_000):
            part = nodes[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])
        up.clear()

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) >= FOREST:
            yield from stars()
    yield from stars()


def components(links: DataFrame, what: str = "components") -> DataFrame:
    """Connected components of ``links`` (two long columns): a row (node, root) for each linked node.

    ``root`` is the smallest node of its component. Each partition is first reduced to
    a forest; then large-star and small-star steps alternate until nothing moves, which
    takes a number of rounds that grows with the logarithm of the longest chain. Nodes
    with very many links are joined by broadcast, see ``skew_join``.
    """
    a, b = links.columns[:2]
    first = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    forest = first.mapInArrow(_local_forest, "a long, b long").filter("a <> b")
    now = materialise(forest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), what)
    seen = None
    while True:
        mark = now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return now.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
        large = skew_join(both, least, "a", "n", 2 * mark[0]).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        mid = materialise(large.distinct(), what)
        least = mid.df.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = skew_join(mid.df, least, "a", "n", max(1, mark[0]))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        later = materialise(small.filter("a <> b").distinct(), what)
        now.drop()
        mid.drop()
        now = later

