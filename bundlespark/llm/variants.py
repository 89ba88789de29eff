"""Spelling variants: words one inserted, deleted or replaced code point apart.

Two words are that close if they are equal once each loses the same place, or if one is
the other without one place. Every word therefore gets a key for each place, the hash of
what is left without it, and one for itself. The keys come from polynomial hashes modulo a
prime: the prefix before a place keeps its powers, the suffix after it is divided by the
base once, so all keys of a batch of words are a few NumPy operations over its code points
and a word of any length costs no more than its length. Keys are dealt to partitions by
their leading bits, sorted, and read in one pass; those that nothing shares go at once.
The rest get their strings back, by the number of the word, and are sorted and compared
once more, since hashes may collide. Within a key no pairs are made: a word needs how many
others there are and the best of them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Fixed values of the query: shortest word, fewest occurrences, how much commoner a form must be, one occurrence in so many is altered.
MIN_LENGTH, LEAST, TIMES, ALTERED = 6, 5, 5, 199
#: Two prime moduli's worth of key, and leading bits that choose a partition.
PRIME, BASES, RADIX = (1 << 31) - 1, (1_000_003, 998_244_353), 20
#: Code points of words that are hashed at a time.
AT_ONCE = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUNS = "[A-Za-zÀ-ÿ]{%d,}" % MIN_LENGTH


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", altered: int | None = ALTERED) -> DataFrame:
    """(word, n): the words of the texts and how often they occur; only built-in functions, counted in part before the shuffle.

    With ``altered`` one occurrence in so many loses a code point, chosen by the CRC-32 of
    the document's id and the word, as a source of known misspellings. A null id counts as
    an empty one.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(_RUNS), F.lit(0))).alias("run"))
    runs = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    if altered:
        crc, run = F.crc32(F.concat_ws(":", "id", "run")), F.col("run")
        at = F.pmod(F.col("crc"), F.length(run)).cast("int")
        runs = runs.withColumn("crc", crc).select(F.when(F.col("crc") % altered == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run).alias("run"))
    return runs.filter(F.length("run") >= MIN_LENGTH).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST)


def keys_of(words: list[str]):
    """(word, place, first, key) as arrays: a row for each place of each word, and one at place -1 for the word itself.

    ``first`` is false where the code point before is the same, so that what is left
    without it was there already. Words must not be empty.
    """
    import numpy as np

    size = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + 1
    end = np.cumsum(size)
    word, start = np.repeat(np.arange(len(words)), size), np.repeat(end - size, size)
    place = np.arange(len(code)) - start
    key, own = np.zeros(len(code), np.int64), np.zeros(len(words), np.int64)
    p = np.uint64(PRIME)
    for base in BASES:
        power = np.ones(1, np.uint64)
        while len(power) < size.max():
            power = np.concatenate([power, power * np.uint64(pow(base, len(power), PRIME)) % p])
        term = code % p * power[place] % p
        upto = np.cumsum(term)  # at most 2^31 each, so 2^33 code points fit
        before = np.concatenate([np.zeros(1, np.uint64), upto])[end - size]
        whole = upto[end - 1] - before
        left = upto - term - before[word]
        right = (whole[word] - left - term) % p * np.uint64(pow(base, -1, PRIME)) % p
        key = key << 31 | ((left + right) % p).astype(np.int64)
        own = own << 31 | (whole % p).astype(np.int64)
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (place[1:] == 0)
    return (np.concatenate([word, np.arange(len(words))]), np.concatenate([place, np.full(len(words), -1)]).astype(np.int32), np.concatenate([first, np.zeros(len(words), bool)]), np.concatenate([key, own]))


def _keys(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ids, words = batch.column("id").to_numpy(), batch.column("word").to_pylist()
        at = 0
        while at < len(words):
            upto, room = at + 1, AT_ONCE - len(words[at])
            while upto < len(words) and len(words[upto]) <= room:
                room -= len(words[upto])
                upto += 1
            word, place, first, key = keys_of(words[at:upto])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), pa.array(first), pa.array(ids[at:upto][word])], ["key", "place", "first", "id"])
            at = upto


def _by_key(batches):
    """Sorted batches cut so that no key lies in two of them."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        key = held.column("key").to_numpy()
        if len(key) and key[0] != key[-1]:
            cut = int(np.searchsorted(key, key[-1]))
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _shared(batches):
    """The rows that share their key and place with another, or whose key is also a word's own."""
    import numpy as np
    import pyarrow as pa

    for table in _by_key(batches):
        key, place, first = (table.column(c).to_numpy() for c in ("key", "place", "first"))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        own, others = np.add.reduceat((place < 0).astype(np.int64), starts)[group], np.add.reduceat(first.astype(np.int64), starts)[group]
        twin = np.zeros(len(key), bool)
        same = (key[1:] == key[:-1]) & (place[1:] == place[:-1]) & (place[1:] >= 0)
        twin[1:] |= same
        twin[:-1] |= same
        keep = twin | ((own > 0) & (others > 0) & (first | (place < 0)))
        yield from table.filter(pa.array(keep)).to_batches()


def _neighbours(batches):
    """For words with strings: (id, near words found here, the best one's n and number). No pair is found under two keys."""
    import itertools

    import pyarrow as pa

    def best(some):
        return min(((-n, i) for i, n in some))

    for table in _by_key(batches):
        out = []
        rows = zip(*(table.column(c).to_pylist() for c in ("key", "place", "first", "id", "word", "n")), strict=True)
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            own, lack, alike = {}, {}, {}
            for _, place, first, i, word, n in group:
                if place < 0:
                    own[word] = (i, n)
                    continue
                left = word[:place] + word[place + 1:]
                alike.setdefault((left, place), []).append((i, n))
                if first:
                    lack.setdefault(left, []).append((i, n))
            for left, (i, n) in own.items():
                if left in lack:
                    out.append((i, len(lack[left]), *best(lack[left])))
                    out += [(j, 1, -n, i) for j, _ in lack[left]]
            for some in alike.values():
                if len(some) > 1:
                    top = best(some)
                    second = best(x for x in some if x[0] != top[1])
                    out += [(i, len(some) - 1, *(second if i == top[1] else top)) for i, _ in some]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4, ["id", "near", "less", "best"])


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best, best_n): for the words (id, word, n) that have near words, how many, and the commonest of them.

    ``words`` must be a written table of distinct words; of words equally common the one
    with the smallest id is best.
    """
    radix = F.shiftright("key", 62 - RADIX)
    keys = words.select("id", "word").mapInArrow(_keys, "key long, place int, first boolean, id long")
    sorted_keys = keys.repartition(radix).sortWithinPartitions("key", "place")
    shared = materialise(sorted_keys.mapInArrow(_shared, "key long, place int, first boolean, id long"), "variant-keys")
    spelt = shared.df.join(words, "id").repartition(radix).sortWithinPartitions("key", "place").select("key", "place", "first", "id", "word", "n")
    found = spelt.mapInArrow(_neighbours, "id long, near long, less long, best long")
    best = found.groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "best")).alias("b"))
    out = materialise(best.select("id", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n")), "variant-neighbours").df
    shared.drop()
    return out


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(id, root) for (id, form) without cycles and of chains of at most 2 ** rounds steps: each round doubles the steps taken."""
    now = materialise(forms.select("id", F.col("form").alias("root")), "variant-roots")
    for _ in range(rounds):
        later = materialise(now.df.join(now.df.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root")), "variant-roots")
        now.drop()
        now = later
    return now.df


def group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", altered: int | None = ALTERED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least six code points that occurs five times or more.

    A word's form is its commonest near word, of equals the first in code-point order, if
    it occurs at least five times as often; forms are followed to the root. Null and empty
    texts have no words; rows with equal ids or texts count each; an empty table gives an
    empty result. A word's length is not limited. Other columns are ignored.
    """
    counted = vocabulary(docs, id_col=id_col, text_col=text_col, altered=altered)
    # Numbers follow the order of the words: the sort leaves them in range partitions, and numbers grow with the partition.
    words = materialise(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "variant-words").df
    near = neighbours(words)
    top = words.agg(F.max("n")).first()[0] or LEAST
    steps = int(math.log(max(1, top / LEAST), TIMES)) + 1  # each step makes n five times as large
    joined = materialise(words.join(near, "id", "left"), "variant-joined").df
    formed = joined.filter(F.col("best_n") >= F.col("n") * TIMES).select("id", F.col("best").alias("form"), F.col("best_n").alias("form_n"))
    formed = materialise(formed, "variant-forms").df
    name = lambda number, text: words.select(F.col("id").alias(number), F.col("word").alias(text))
    ends = formed.join(roots(formed, math.ceil(math.log2(steps + 1))), "id").withColumnRenamed("root", "root_id").withColumnRenamed("form", "form_id")
    ends = ends.join(name("form_id", "form"), "form_id").join(name("root_id", "root"), "root_id").select("id", "form", "form_n", "root")
    return joined.join(ends, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
