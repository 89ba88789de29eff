"""Quality rules: counts within a text, and lines that too many documents of a host share.

Words are maximal runs without ASCII white space. A line's normal form is lower-cased,
its white space single blanks; lines are counted by a 64-bit hash of host and normal
form, once for each distinct document of the host: rows with the same text are one
document, so a much copied text makes no line frequent. A line above the limit of its
host is removed wherever that host has it, and a document that loses more than DEPLETED
of its words that way is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, skew_join

#: A line is frequent in more documents than this share of its host's distinct texts, and in more than LEAST.
SHARE = 0.08
LEAST = 5
#: The share of its words that a document may lose to frequent lines.
DEPLETED = 0.5
#: Fixed values of the rules within a text.
MIN_WORDS, WINDOW, REPEATED_PERCENT, SYMBOLS = 10, 5, 20, "#*$%&|<>"
#: Frequent lines up to which their keys, eight bytes each, go to every worker; beyond
#: that, documents are joined with the keys of the lines that they lose.
BROADCAST_LINES = 500_000


def _repeated(words: list[bytes]) -> int:
    """Words in windows of five that the text holds twice or more, the first included."""
    import numpy as np

    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    # A window of five is the pair of its first four and last words, those in turn pairs of pairs.
    two = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * (int(two.max()) + 1) + two[2:], return_inverse=True)[1]
    five, count = np.unique(four[:n] * len(number) + ids[4:], return_inverse=True, return_counts=True)[1:]
    at = np.flatnonzero(count[five] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def _normal(line: bytes) -> bytes:
    return b" ".join(line.split()).decode("utf-8", "replace").lower().encode()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(text: str | None) -> int:
    """What Spark's xxhash64 gives, for null too."""
    from xxhash import xxh64_intdigest

    return 42 if text is None else _signed(xxh64_intdigest(text.encode("utf-8", "replace"), 42))


def _keys(host: int, lines: list[bytes]) -> list[int]:
    from xxhash import xxh64_intdigest

    return [_signed(xxh64_intdigest(_normal(s), host & (1 << 64) - 1)) for s in lines]


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each document: id, hashes of host and text, the counts, its lines as keys and words, and its own number."""
    def work(batches):
        import pyarrow as pa

        kinds = [("id", pa.int64()), ("host", pa.int64()), ("hash", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))]
        for batch in batches:
            rows = []
            for key, host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text, host = text.as_py() or "", _hash(host)
                data = text.encode("utf-8", "replace")
                words = data.split()
                lines = [s for s in data.split(b"\n") if s and not s.isspace()]
                rows.append((key, host, _hash(text), len(words), len(b"".join(words).decode("utf-8", "replace")), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeated(words), _keys(host, lines), [len(s.split()) for s in lines]))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, (_, k) in zip(zip(*rows), kinds, strict=True)] if rows else [pa.array([], k) for _, k in kinds], [n for n, _ in kinds])

    measured = docs.select(F.col(id_col).cast("long"), F.col(host_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(
        work, "id long, host long, hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, keys array<long>, sizes array<int>")
    return measured.withColumn("row", F.monotonically_increasing_id())


def frequent_lines(measured: DataFrame) -> DataFrame:
    """(key, rows): the lines above their host's limit and how many rows have them.

    ``measured`` must be a written table, since rows are told apart by their numbers. Of
    each distinct text of a host one row is opened, so lines are counted once a document
    and in part before they are shuffled.
    """
    texts = measured.groupBy("host", "hash").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    texts = materialise(texts, "quality-texts").df
    hosts = materialise(texts.groupBy("host").agg(F.count(F.lit(1)).alias("texts")), "quality-hosts").df
    total = texts.count()
    each = measured.select("row", "host", "keys").join(texts.select("row", "copies"), "row").select("host", F.explode(F.array_distinct("keys")).alias("key"), "copies")
    per_line = each.groupBy("host", "key").agg(F.count(F.lit(1)).alias("texts_with"), F.sum("copies").alias("rows")).filter(F.col("texts_with") > LEAST)
    hosts = hosts.withColumn("n", F.col("texts"))
    return skew_join(per_line, hosts, "host", "n", total).filter(F.col("texts_with") > F.col("texts") * SHARE).groupBy("key").agg(F.sum("rows").alias("rows"))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each row of ``docs``: id, hashes of host and text, the counts, base_failed, removed, lost and kept.

    Null and empty texts have no words, fail the base rules and aren't kept; a null host
    is a host. Equal rows are judged alike and each comes back; rows that share an id
    only are each judged on their own text. ``removed`` has the keys of the frequent
    lines in the text (null: none), ``lost`` the words in them.
    """
    measured = materialise(measure(docs, id_col=id_col, text_col=text_col, host_col=host_col), "quality").df
    frequent = materialise(frequent_lines(measured), "quality-lines").df
    total = frequent.agg(F.sum("rows")).first()[0] or 0
    lines = measured.select("row", F.explode(F.array_distinct("keys")).alias("key"))
    gone = skew_join(lines, frequent, "key", "rows", total).groupBy("row").agg(F.collect_set("key").alias("removed"))
    out = measured.join(gone, "row", "left")
    among = F.filter(F.arrays_zip("keys", "sizes"), lambda x: F.array_contains("removed", x["keys"]))
    lost = F.when(F.col("removed").isNull(), 0).otherwise(F.aggregate(among, F.lit(0).cast("long"), lambda a, x: a + x["sizes"]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return (out.withColumn("lost", lost.cast("long")).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= F.col("n_words") * DEPLETED)).drop("keys", "sizes", "row"))


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The kept rows of ``docs``, frequent lines removed from their texts; columns and other rows stay as they are.

    Texts don't move if the frequent lines are few enough to go to every worker: each row
    is then judged again where it is read. Otherwise rows meet their verdicts by a join.
    """
    measured = materialise(measure(docs, id_col=id_col, text_col=text_col, host_col=host_col), "quality").df
    frequent = materialise(frequent_lines(measured), "quality-lines").df
    if frequent.count() > BROADCAST_LINES:
        return _clean_by_join(docs, id_col, text_col, host_col)
    keys = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in frequent.select("key").collect()))

    @F.pandas_udf("struct<kept:boolean,text:string>")
    def judged(texts, hosts):
        import pandas as pd

        out = []
        for text, host in zip(texts, hosts, strict=True):
            words, lines = (data := (text or "").encode("utf-8", "replace")).split(), data.split(b"\n")
            n = len(words)
            if n < MIN_WORDS or 100 * _repeated(words) > REPEATED_PERCENT * n:
                out.append((False, None))
                continue
            gone = [bool(s) and not s.isspace() and k in keys.value for s, k in zip(lines, _keys(_hash(host), lines), strict=True)]
            lost = sum(len(s.split()) for s, g in zip(lines, gone, strict=True) if g)
            rest = b"\n".join([s for s, g in zip(lines, gone, strict=True) if not g]).decode() if lost else None
            out.append((lost <= n * DEPLETED, rest))
        return pd.DataFrame(out, columns=["kept", "text"])

    judged = judged.asNondeterministic()  # else the optimizer runs it once for the filter and once more for the text
    verdict = fresh(docs.columns, "_verdict")
    told = docs.withColumn(verdict, judged(F.col(text_col).cast("string"), F.col(host_col).cast("string"))).filter(F.col(f"{verdict}.kept"))
    return told.withColumn(text_col, F.coalesce(F.col(f"{verdict}.text"), F.col(text_col))).select(*docs.columns)


def _clean_by_join(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    verdict = materialise(judge(docs, id_col=id_col, text_col=text_col, host_col=host_col), "quality-verdict").df
    a, b, c, d, e = (fresh(docs.columns, n) for n in ("_id", "_hash", "_kept", "_removed", "_host"))
    touched = verdict.filter("not kept or removed is not null")
    few = touched.select(F.col("id").alias(a), F.col("hash").alias(b), F.col("host").alias(e), F.col("kept").alias(c), F.col("removed").alias(d)).dropDuplicates([a, b, e])
    same = F.col(id_col).cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(b)) & (F.xxhash64(F.col(host_col).cast("string")) == F.col(e))
    left = docs.join(few, same, "left").filter(F.coalesce(F.col(c), F.lit(True)))

    @F.pandas_udf("string")
    def without(texts, hosts, removed):
        import pandas as pd

        out = []
        for text, host, keys in zip(texts, hosts, removed, strict=True):
            if text is not None:
                keys, lines = set(keys), text.encode("utf-8", "replace").split(b"\n")
                text = b"\n".join([s for s, k in zip(lines, _keys(host, lines), strict=True) if not s or s.isspace() or k not in keys]).decode()
            out.append(text)
        return pd.Series(out, dtype=object)

    has = F.col(d).isNotNull()
    cut = without(F.when(has, F.col(text_col)), F.coalesce(F.col(e), F.lit(0)), F.col(d))
    return left.withColumn(text_col, F.when(has, cut).otherwise(F.col(text_col))).select(*docs.columns)
