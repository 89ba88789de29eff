"""Bundles on disk: directory trees of Markdown files, read in parallel and written back.

Reading and writing go through the data source of ``bundle_source``: tasks list, open and
parse the files, so on a cluster the bundle must lie on a file system that all machines
mount at the same place. Spark's own listing would pass over names that begin with '_' or
'.', which a bundle may have.
"""

from __future__ import annotations

import os
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import index
from ..operators.concepts import project
from . import bundle_source, markdown, yamlio
from .bundle_source import CONCEPTS, FILES, LOGS, RESERVED, BundleSource

_HIDDEN = {"node_modules", "dist", "build", "target", "dist-newstyle", "__pycache__"}
_REGISTERED = "bundlespark.source"


class BundleError(ValueError):
    """A file of the bundle that cannot be read as a concept."""


def _register(spark: SparkSession) -> None:
    if spark.conf.get(_REGISTERED, None) is None:
        spark.dataSource.register(BundleSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.conf.set(_REGISTERED, "yes")


def scan(spark: SparkSession, root: str, what: str = "concepts", columns: str = CONCEPTS) -> DataFrame:
    """The rows of the data source; of ``columns`` only what they need is worked out."""
    _register(spark)
    return spark.read.format("bundle").option("what", what).option("prune", "true").schema(columns).load(root)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every regular file, reserved and other ones included."""
    return scan(spark, root, "files", FILES)


def directories(spark: SparkSession, root: str) -> DataFrame:
    """(dir) of every directory below the root."""
    return scan(spark, root, "dirs", FILES).withColumnRenamed("path", "dir")


def read(spark: SparkSession, root: str, mode: str = "FAILFAST", facts: bool = True) -> DataFrame:
    """Projected concepts of the bundle at ``root``, with Markdown facts (if asked), file times and errors.

    FAILFAST raises BundleError for the smallest path that can't be read, found by a scan of
    its own that reads frontmatter only and keeps nothing; PERMISSIVE keeps such rows with
    the reason in ``error`` and no frontmatter.
    """
    bad_id = F.when(ids.from_path(F.col("source_path")).isNull(), F.lit("the file's name makes no concept id"))
    error = F.coalesce("error", bad_id)
    if mode == "FAILFAST":
        wrong = scan(spark, root, columns="source_path string, error string").withColumn("error", error).where("error is not null")
        first = wrong.agg(F.min(F.struct("source_path", "error")).alias("x")).select("x.*").first()
        if first[0] is not None:
            raise BundleError(f"{first[0]}: {first[1]}")
    raw = scan(spark, root, columns=CONCEPTS if facts else "source_path string, json string, body string, modified double, error string")
    raw = raw.withColumn("concept_id", ids.from_path(F.col("source_path"))).withColumn("error", error)
    return project(raw.withColumn("fm", F.parse_json(F.coalesce("json", F.lit("{}")))).drop("json"))


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """Rows of operators.logs for every log.md."""
    return markdown.log_rows(scan(spark, root, "logs", LOGS))


def log_titles(spark: SparkSession, root: str) -> DataFrame:
    """(log_path, title) of every log.md and of those that could be beside a file; a log yet to be written is named after its directory."""
    import pandas as pd

    @F.pandas_udf("string")
    def title(texts):
        return pd.Series([markdown.parse_log(t)[0] for t in texts], dtype=object)

    own = scan(spark, root, "logs", LOGS).select(F.col("path").alias("log_path"), title("text").alias("own"))
    at = inventory(spark, root).where(F.col("path").endswith(".md")).select(ids.directory(F.col("path")).alias("dir"))
    at = at.unionByName(spark.createDataFrame([("",)], "dir string")).distinct()
    named = at.withColumn("log_path", F.when(F.col("dir") == "", "log.md").otherwise(F.concat("dir", F.lit("/log.md"))))
    unwritten = F.concat(F.when(F.col("dir") == "", "Bundle").otherwise(F.col("dir")), F.lit(" Update Log"))
    return named.join(own, "log_path", "left").select("log_path", F.coalesce("own", unwritten).alias("title"))


def changed_since(spark: SparkSession, root: str, revision: str) -> DataFrame:
    """(path) of files that git finds changed since ``revision``; BundleError says why there is no answer."""
    import subprocess

    try:
        done = subprocess.run(["git", "-C", root, "diff", "--name-only", "--relative", revision, "--", "."], capture_output=True, text=True, check=False)
    except OSError as e:
        raise BundleError(str(e)) from e
    if done.returncode:
        raise BundleError((done.stderr or done.stdout).strip().split("\n")[0])
    return spark.createDataFrame([(p,) for p in done.stdout.split("\n") if p], "path string")


def declared_version(root: str) -> str | None:
    """okf_version of the root's index.md, text or number; None if there is none."""
    try:
        with open(os.path.join(root, "index.md"), encoding="utf-8") as f:
            found = yamlio.parse(f.read())[0].get("okf_version")
    except (OSError, yamlio.DocumentError):
        return None
    return None if found is None or isinstance(found, (dict, list, bool)) else str(found)


def _typed(path: str) -> bool:
    try:
        with open(path, encoding="utf-8") as f:
            t = yamlio.parse(f.read())[0].get("type")
    except (OSError, ValueError):
        return False
    return isinstance(t, str) and bool(t.strip())


def discover(top: str, depth: int = 4) -> list[str]:
    """Bundle roots below ``top``: directories with an index.md or a typed concept; nothing below a found one."""
    found: list[str] = []

    def down(at: str, left: int) -> None:
        names = sorted(os.scandir(at), key=lambda e: e.name)
        files = [e.name for e in names if e.is_file(follow_symlinks=False)]
        if "index.md" in files or any(n.endswith(".md") and n not in RESERVED and _typed(os.path.join(at, n)) for n in files):
            found.append(at)
        elif left:
            for e in names:
                if e.is_dir(follow_symlinks=False) and not e.name.startswith(".") and e.name not in _HIDDEN:
                    down(e.path, left - 1)

    if os.path.isdir(top):
        down(top, depth)
    return found


def available(environment: str | None) -> list[str]:
    """Roots of a colon-separated list of places, sorted, each once."""
    return sorted({r for top in (environment or "").split(":") if top for r in discover(top)})


def serialized(concepts: DataFrame) -> DataFrame:
    """(source_path, text) of every concept's document."""
    import pandas as pd

    @F.pandas_udf("string")
    def text(frontmatter, bodies):
        import json
        from decimal import Decimal

        return pd.Series([yamlio.serialize(json.loads(f, parse_float=Decimal), b or "") for f, b in zip(frontmatter, bodies, strict=True)], dtype=object)

    return concepts.select("source_path", text(F.to_json("fm"), F.col("body")).alias("text"))


def write(concepts: DataFrame, root: str) -> None:
    """Writes each concept's file below ``root``, all or none; other files stay."""
    write_texts(serialized(concepts), root)


def write_indexes(rendered: DataFrame, root: str) -> None:
    """Writes the index.md of each directory of operators.index.render."""
    write_texts(rendered.select(F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), F.lit("index.md")).alias("source_path"), "text"), root)


def write_index_lines(lines: DataFrame, root: str) -> None:
    """Writes the index.md of each directory of operators.index.lines, all or none.

    Lines are sorted by ranges, so a directory of any size is dealt to many tasks. Each
    appends to one staged file for a directory; one task joins the files of a directory that
    was cut, in order, by copying. No row holds more than a line and no task a whole index.
    """
    _register(lines.sparkSession)
    os.makedirs(root, exist_ok=True)
    top = os.path.join(root, bundle_source.STAGING, uuid.uuid4().hex)
    dealt = lines.select(*index.ORDER).repartitionByRange(*index.ORDER).sortWithinPartitions(*index.ORDER)
    pieces = dealt.mapInArrow(partial(bundle_source.pieces_of, top=top), "dir string, rank int, type string, step int, name string, piece string")
    whole = pieces.groupBy("dir").agg(F.sort_array(F.collect_list(F.struct("rank", "type", "step", "name", "piece"))).alias("x"))  # at most one a partition
    path = F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), F.lit("index.md"))
    try:
        whole.select(path.alias("source_path"), F.col("x.piece").alias("pieces")).write.format("bundle").mode("append").save(root)
    finally:
        bundle_source.forget(root, top)


def write_texts(files: DataFrame, root: str) -> None:
    """Writes files from (source_path, text), all or none; see ``bundle_source``."""
    _register(files.sparkSession)
    os.makedirs(root, exist_ok=True)
    files.select("source_path", "text").write.format("bundle").mode("append").save(root)
