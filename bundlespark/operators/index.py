"""index.md of every directory: subdirectories, files, then a section for each type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids


def bullet(source_path: Column, title: Column, description: Column) -> Column:
    name = ids.base_name(source_path)
    return F.concat(F.lit("- ["), F.coalesce(title, F.regexp_replace(name, r"\.[^.]*$", "")), F.lit("]("), name, F.lit(")"), F.coalesce(F.concat(F.lit(" - "), description), F.lit("")))


def bullets(projected: DataFrame) -> DataFrame:
    """(dir, type, source_path, bullet) of every concept."""
    return projected.select(ids.directory(F.col("source_path")).alias("dir"), "type", "source_path", bullet(F.col("source_path"), F.col("title"), F.col("description")).alias("bullet"))


def _parents(paths: DataFrame) -> DataFrame:
    """(dir, child) of every directory that holds files, at any depth."""
    at = F.filter(F.split(ids.directory(F.col("path")), "/"), lambda s: s != "")
    steps = F.when(F.size(at) > 0, F.transform(F.sequence(F.lit(1), F.size(at)), lambda n: F.struct(F.array_join(F.slice(at, F.lit(1), n - 1), "/").alias("dir"), F.element_at(at, n).alias("child"))))
    return paths.select(F.explode(steps).alias("x")).select("x.dir", "x.child").distinct()


def _there(projected: DataFrame, steps: DataFrame) -> DataFrame:
    """(dir) of every directory that has an index: those that hold something, and the root of a bundle with concepts."""
    return steps.select(F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), F.col("child")).alias("dir")).unionByName(projected.select(F.lit("").alias("dir")).limit(1)).distinct()


def _front(version: str) -> str:
    quoted = version.replace("\\", "\\\\").replace('"', '\\"')
    return f'---\nokf_version: "{quoted}"\n---\n\n'


#: What lines are put together by.
ORDER = ["dir", "rank", "type", "step", "name", "text"]


def lines(projected: DataFrame, inventory: DataFrame | None = None, version: str | None = None, directories: DataFrame | None = None) -> DataFrame:
    """(dir, rank, type, step, name, text): the lines of every index that ``render`` makes, a row each.

    The texts of a directory, in the order of the columns, are its index. A section is its
    heading (step 0), its entries (1) and the line that ends it (2), so nothing is gathered
    and a directory may be of any size; ``sources.bundle.write_index_lines`` writes them.
    Concepts without a type are in no section.
    """
    steps = _parents(projected.select(F.col("source_path").alias("path")) if inventory is None else inventory.select("path"))
    if directories is not None:
        steps = steps.unionByName(_parents(directories.select(F.concat("dir", F.lit("/")).alias("path")))).distinct()
    entry = lambda rank, kind, name, text: ["dir", F.lit(rank).alias("rank"), kind.alias("type"), F.lit(1).alias("step"), name.alias("name"), F.concat(text, F.lit("\n")).alias("text")]
    every = bullets(projected).where("type is not null").select(*entry(3, F.col("type"), F.col("source_path"), F.col("bullet")))
    child = F.col("child")
    every = every.unionByName(steps.select(*entry(1, F.lit("Subdirectories"), child, F.concat(F.lit("- ["), child, F.lit("/]("), child, F.lit("/index.md)")))))
    if inventory is not None:
        other = inventory.where(~ids.is_reserved(F.col("path"))).join(projected.select(F.col("source_path").alias("path")), "path", "left_anti")
        other = other.select(ids.directory(F.col("path")).alias("dir"), ids.base_name(F.col("path")).alias("f")).distinct()
        every = every.unionByName(other.select(*entry(2, F.lit("Files"), F.col("f"), F.concat(F.lit("- ["), "f", F.lit("]("), "f", F.lit(")")))))
    end = lambda step, text: F.struct(F.lit(step).alias("step"), F.lit("").alias("name"), text.alias("text"))
    ends = F.array(end(0, F.concat(F.lit("# "), F.col("type"), F.lit("\n\n"))), end(2, F.lit("\n")))
    sections = every.select("dir", "rank", "type").distinct().select("dir", "rank", "type", F.explode(ends).alias("x")).select("dir", "rank", "type", "x.*")
    there = _there(projected, steps)
    alone = lambda rows, rank, text: rows.select("dir", F.lit(rank).alias("rank"), F.lit("").alias("type"), F.lit(0).alias("step"), F.lit("").alias("name"), F.lit(text).alias("text"))
    out = every.unionByName(sections).unionByName(alone(there.join(every.select("dir").distinct(), "dir", "left_anti"), 4, "\n"))
    return out if version is None else out.unionByName(alone(there.where("dir = ''"), 0, _front(version)))


def render(projected: DataFrame, inventory: DataFrame | None = None, version: str | None = None, directories: DataFrame | None = None) -> DataFrame:
    """(dir, text): the index of every directory; the root's carries ``version`` as frontmatter if given.

    ``inventory`` has a column path with all files of the bundle; those that are neither
    concepts nor reserved are listed as files. A directory has an index whatever it holds;
    ``directories`` has a column dir with those that exist, for such as hold no file.
    """
    parts = bullets(projected).groupBy("dir", "type").agg(F.sort_array(F.collect_list(F.struct("source_path", "bullet"))).alias("b"))
    parts = parts.select("dir", F.lit(3).alias("rank"), "type", F.col("b.bullet").alias("b"))
    files = projected.select(F.col("source_path").alias("path")) if inventory is None else inventory.select("path")
    steps = _parents(files)
    if directories is not None:
        steps = steps.unionByName(_parents(directories.select(F.concat("dir", F.lit("/")).alias("path")))).distinct()
    subs = steps.groupBy("dir").agg(F.sort_array(F.collect_set("child")).alias("c"))
    subs = subs.select("dir", F.lit(1).alias("rank"), F.lit("Subdirectories").alias("type"), F.transform("c", lambda c: F.concat(F.lit("- ["), c, F.lit("/]("), c, F.lit("/index.md)"))).alias("b"))
    every = parts.unionByName(subs)
    if inventory is not None:
        other = inventory.where(~ids.is_reserved(F.col("path"))).join(projected.select(F.col("source_path").alias("path")), "path", "left_anti")
        other = other.select(ids.directory(F.col("path")).alias("dir"), ids.base_name(F.col("path")).alias("f")).groupBy("dir").agg(F.sort_array(F.collect_set("f")).alias("f"))
        every = every.unionByName(other.select("dir", F.lit(2).alias("rank"), F.lit("Files").alias("type"), F.transform("f", lambda f: F.concat(F.lit("- ["), f, F.lit("]("), f, F.lit(")"))).alias("b")))
    section = F.concat(F.lit("# "), F.col("type"), F.lit("\n\n"), F.array_join("b", "\n"))
    text = every.groupBy("dir").agg(F.sort_array(F.collect_list(F.struct("rank", "type", section.alias("s")))).alias("x")).select("dir", F.concat(F.array_join("x.s", "\n\n"), F.lit("\n\n")).alias("text"))
    text = _there(projected, steps).join(text, "dir", "full").select("dir", F.coalesce("text", F.lit("\n")).alias("text"))
    if version is None:
        return text
    return text.withColumn("text", F.when(F.col("dir") == "", F.concat(F.lit(_front(version)), "text")).otherwise(F.col("text")))
