"""Change logs: days and entries, their order, and which log covers a concept.

A log is rows (log_path, day_pos, date, entry_pos, kind, text); a day without entries
has one row whose entry_pos is NULL, a log without days one whose day_pos is NULL: it
covers its concepts all the same. See sources.markdown for reading them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids, values
from ..functions.trie import RadixTrie
from .lineage import cut

#: Logs, and characters of their paths, up to which they go to every worker.
TRIE_LOGS, TRIE_BYTES = 200_000, 16 << 20
#: Tasks that the rows that ask for one directory are dealt to.
SALTS = 16


def days(logs: DataFrame) -> DataFrame:
    """(log_path, day_pos, date, entries)."""
    return logs.where("day_pos is not null").groupBy("log_path", "day_pos", "date").agg(F.count("entry_pos").alias("entries")).orderBy("log_path", "day_pos")


def check(logs: DataFrame) -> DataFrame:
    """(log_path, day_pos, code, date, next_date, structural): days that are no date or empty, and pairs out of order."""
    d = days(logs)
    later = F.lead("date").over(Window.partitionBy("log_path").orderBy("day_pos"))
    d = d.withColumn("next_date", later)
    none = F.lit(None).cast("string").alias("next_date")
    bad = d.where(~ids.is_date(F.col("date"))).select("log_path", "day_pos", F.lit("LogDateNotIso").alias("code"), "date", none, F.lit(True).alias("structural"))
    empty = d.where("entries = 0").select("log_path", "day_pos", F.lit("LogEmptyDay").alias("code"), "date", none, F.lit(True).alias("structural"))
    order = d.where(ids.is_date(F.col("date")) & ids.is_date(F.col("next_date")) & (F.col("date") < F.col("next_date")))
    order = order.select("log_path", "day_pos", F.lit("LogDaysOutOfOrder").alias("code"), "date", "next_date", F.lit(False).alias("structural"))
    return bad.unionByName(empty).unionByName(order)


def _normal(path: Column) -> Column:
    return F.array_join(ids.segments(path), "/")


def nearest(concepts: DataFrame, logs: DataFrame) -> DataFrame:
    """(concept_id, log_path): the log in the deepest directory around each concept; NULL if there is none.

    A longest-prefix lookup. Directories of logs up to TRIE_LOGS and TRIE_BYTES go to every
    worker as a trie, and a concept's row is answered where it is. More of them are met by
    the directories of the concepts, each once: a directory without a log points to the one
    above it, and pointers are doubled until all have arrived, see ``_climb``.
    """
    at = logs.select("log_path").distinct().select("log_path", _normal(ids.directory(F.col("log_path"))).alias("dir"))
    at = at.groupBy("dir").agg(F.min("log_path").alias("log_path"))
    here = concepts.select("concept_id", _normal(ids.directory(F.col("source_path"))).alias("dir"))
    size = at.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("log_path")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= TRIE_LOGS and size["bytes"] <= TRIE_BYTES:
        found = here.withColumn("log_path", _trie_lookup(at)(F.col("dir")))
    else:
        found = _climb(here, at)
    return found.groupBy("concept_id").agg(F.max_by("log_path", F.length("log_path")).alias("log_path"))


def _trie_lookup(at: DataFrame):
    import pandas as pd

    trie = RadixTrie()
    for r in at.collect():  # at most TRIE_LOGS rows
        trie.put(tuple(r["dir"].split("/")) if r["dir"] else (), r["log_path"])
    shared = at.sparkSession.sparkContext.broadcast(trie)

    @F.pandas_udf("string")
    def deepest(dirs):
        known: dict[str, str | None] = {}
        for d in dirs:
            if d not in known:
                known[d] = shared.value.deepest(tuple(d.split("/")) if d else ())
        return pd.Series([known[d] for d in dirs], dtype=object)

    return deepest


def _climb(here: DataFrame, at: DataFrame) -> DataFrame:
    """``here`` with the log of the deepest directory around each, by joins over distinct directories.

    The root, which every directory would ask, is asked once; rows that ask for one
    directory are dealt to SALTS tasks.
    """
    spark = here.sparkSession
    root = at.where("dir = ''").select("log_path").first()
    dirs = here.select("dir").distinct()
    parts = F.split("dir", "/")
    every = dirs.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir")).where("dir <> ''").distinct()
    parent = F.when(F.col("log_path").isNull() & F.col("dir").contains("/"), F.regexp_replace("dir", "/[^/]*$", ""))
    now = cut(every.join(at.where("dir <> ''"), "dir", "left").withColumn("up", parent))
    while not now.where("up is not null").isEmpty():
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        above = now.select(F.col("dir").alias("up"), F.col("log_path").alias("found"), F.col("up").alias("further"), salt.alias("salt"))
        climbing = now.where("up is not null").withColumn("salt", F.pmod(F.xxhash64("dir"), F.lit(SALTS)).cast("int"))
        climbed = climbing.join(above, ["up", "salt"]).select("dir", F.col("found").alias("log_path"), F.col("further").alias("up"))
        now = cut(now.where("up is null").select("dir", "log_path", "up").unionByName(climbed))
    own = now.select(F.col("dir").alias("asked"), "log_path")
    found = here.join(own, F.col("dir") == F.col("asked"), "left").drop("asked")
    return found.withColumn("log_path", F.coalesce("log_path", F.lit(root[0] if root else None).cast("string")))


def recorded_date(fm: Column) -> Column:
    """The first ten characters of generated.at, else of timestamp; shorter texts don't count."""
    ten = lambda t: F.when(F.length(t) >= 10, F.left(t, F.lit(10)))
    return F.coalesce(ten(values.text(values.get(fm, "generated", "at"))), ten(values.text(values.get(fm, "timestamp"))))


def stale(concepts: DataFrame, logs: DataFrame) -> DataFrame:
    """(concept_id, date, log_path, newest): concepts dated after all that their nearest log records, or that have no log."""
    newest = logs.groupBy("log_path").agg(F.max("date").alias("newest"))
    dated = concepts.select("concept_id", recorded_date(F.col("fm")).alias("date")).where("date is not null")
    out = dated.join(nearest(concepts, logs), "concept_id").join(newest, "log_path", "left")
    return out.where("newest is null or date > newest").select("concept_id", "date", "log_path", "newest").orderBy("concept_id")


def drift(concepts: DataFrame, logs: DataFrame, changed: DataFrame) -> DataFrame:
    """(concept_id, log_path): changed concepts (``changed`` has a column path) whose nearest log did not change."""
    paths = changed.select(F.col("path").alias("p")).distinct()
    touched = concepts.join(paths, F.col("source_path") == F.col("p"), "left_semi")
    return nearest(touched, logs).join(paths, F.col("log_path") == F.col("p"), "left_anti").orderBy("concept_id")


def path_beside(concept_id: str | None) -> str:
    """The log in the directory of a concept; the root's without one."""
    return "/".join([*(concept_id or "").split("/")[:-1], "log.md"])


def append(logs: DataFrame, log_path: str, date: str, text: str, kind: str | None = "Update") -> DataFrame:
    """``logs`` with an entry first among those of its day; a new day goes before the first older one."""
    spark = logs.sparkSession
    own, rest = logs.where(F.col("log_path") == log_path), logs.where(F.col("log_path") != log_path)
    rows = [r.asDict() for r in own.where("day_pos is not null").orderBy("day_pos", "entry_pos").collect()]  # one log file
    groups: list[tuple[str, list]] = []
    for r in rows:
        if not groups or groups[-1][0] != (r["day_pos"], r["date"]):
            groups.append(((r["day_pos"], r["date"]), []))
        if r["entry_pos"] is not None:
            groups[-1][1].append((r["kind"], r["text"]))
    listed = [(d, e) for (_, d), e in groups]
    at = next((i for i, (d, _) in enumerate(listed) if d == date or date > (d or "")), len(listed))
    if at < len(listed) and listed[at][0] == date:
        listed[at][1].insert(0, (kind, text))
    else:
        listed.insert(at, (date, [(kind, text)]))
    new = [(log_path, i, d, j, k, t) for i, (d, e) in enumerate(listed) for j, (k, t) in enumerate(e or [(None, None)])]
    new = [(p, i, d, j if listed[i][1] else None, k, t) for p, i, d, j, k, t in new]
    made = spark.createDataFrame(new, "log_path string, day_pos int, date string, entry_pos int, kind string, text string")
    return rest.select(*made.columns).unionByName(made)


def serialize(logs: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(log_path, text): each log as Markdown; ``titles`` has log_path and title, '' where missing."""
    entry = F.concat(F.lit("* "), F.coalesce(F.concat(F.lit("**"), F.col("kind"), F.lit("**: ")), F.lit("")), F.col("text"))
    day = logs.groupBy("log_path", "day_pos", "date").agg(F.sort_array(F.collect_list(F.when(F.col("entry_pos").isNotNull(), F.struct("entry_pos", entry.alias("e"))))).alias("es"))
    lines = day.select("log_path", "day_pos", F.array_join(F.concat(F.array(F.concat(F.lit("## "), F.coalesce("date", F.lit("")))), F.col("es.e")), "\n").alias("part"))
    whole = lines.groupBy("log_path").agg(F.sort_array(F.collect_list(F.when(F.col("day_pos").isNotNull(), F.struct("day_pos", "part")))).alias("ds"))
    if titles is not None:
        whole = whole.join(titles.select("log_path", "title"), "log_path", "left")
    else:
        whole = whole.withColumn("title", F.lit(""))
    head = F.concat(F.lit("# "), F.coalesce("title", F.lit("")))
    return whole.select("log_path", F.concat(F.array_join(F.concat(F.array(head), F.col("ds.part")), "\n\n"), F.lit("\n")).alias("text"))
