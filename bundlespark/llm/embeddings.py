"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a key, the signs of its projections on random directions
one after another, and vectors are ordered by it; those close in direction tend to share
a long beginning and so to stand close. Two vectors are compared in a pass if they stand
within WINDOW places of each other, or if they share the first signs, as many as the
logarithm of the number of vectors: that is the exact way for crowds longer than a
window. A pair counts in the first pass that compares it, which the places and keys of
all passes tell locally, so no pair is ever emitted: what leaves a pass are counts, and
the links of spanning forests, whose union over all passes gives the components. Equal
vectors go as one. Passes run one after another, each with one shuffle of the vectors;
there are more of them the more vectors there are, so that recall does not fall.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, materialise, skew_join, with_rank

#: Cosine from which vectors are linked.
COSINE = 0.9
#: Passes at least, and the share of pairs at COSINE that all passes together are to find.
PASSES = 10
RECALL = 0.99
#: Places within which the neighbours of a vector are compared, each way.
WINDOW = 64
#: Signs in a key; at least so many of them make a crowd.
SIGNS, LEAST_PREFIX = 62, 16
#: Places of a crowd that one task compares with as many others; places of windows in a
#: task, of which there are fewer while that gives every core several tasks.
BLOCK = 4096
LEAST_BLOCK, TASKS_A_CORE = 512, 4
_SEED = 20_240_601


def passes_for(count: int) -> int:
    """Passes that find RECALL of the pairs at COSINE among ``count`` vectors.

    A pass finds a smaller share of them the more vectors there are, since the crowd's
    signs grow with the logarithm: simulated 0.35 at 10,000 vectors and 0.13 at a million.
    The law here lies a little below that.
    """
    share = min(0.9, 0.34 * 0.85 ** math.log2(max(count, 1) / 10_000))
    return max(PASSES, math.ceil(math.log(1 - RECALL) / math.log(1 - share)))


def _directions(dim: int, passes: int):
    import numpy as np

    return np.random.default_rng(_SEED).standard_normal((dim, passes * SIGNS))


def _keyed(batches, passes: int):
    """(id, vector as 64-bit floats, dim, a key for each pass); all but the id null for vectors that can't link."""
    import numpy as np
    import pyarrow as pa

    made = {}
    for batch in batches:
        by_dim, rows = {}, []
        for i, values in enumerate(batch.column(1).to_pylist()):
            rows.append((None, None, None))
            if values and all(v is not None for v in values):
                x = np.asarray(values, np.float64)
                if np.isfinite(x).all() and x.any():
                    x /= np.abs(x).max()
                    by_dim.setdefault(len(values), []).append((i, x))
        for dim, some in by_dim.items():
            if dim not in made:
                made[dim] = _directions(dim, passes)
            signs = (np.stack([x for _, x in some]) @ made[dim] > 0).reshape(len(some), passes, SIGNS)
            keys = signs @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
            for (i, x), k in zip(some, keys, strict=True):
                rows[i] = ((x + 0.0).tobytes(), dim, k.tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["id", "vector", "dim", "keys"])


def _numbered(batches):
    """Sorted rows with the number of their partition and their place in it."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "part", "at"])
        at += n


def _places(reps: DataFrame, prefix: int) -> DataFrame:
    """(node, ranks, firsts, sizes): for each pass the place of a vector, and the first place and size of its crowd.

    firsts and sizes are 0 where the crowd is no longer than a window.
    """
    long = reps.select("node", "dim", F.posexplode("keys").alias("pass", "key"))
    order = ["pass", "dim", "key", "node"]
    parts = reps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = long.select(*order).repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    placed = materialise(dealt.mapInArrow(_numbered, "pass int, dim int, key long, node long, part int, at long"), "vector-order").df
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row a partition
    ranked = placed.join(F.broadcast(starts), "part").select("node", "pass", (F.col("start") + F.col("at")).alias("rank"), F.concat_ws(":", "pass", "dim", F.shiftright("key", SIGNS - prefix)).alias("crowd"))
    ranked = materialise(ranked, "vector-ranks").df
    crowds = ranked.groupBy("crowd").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")).filter(F.col("n") > WINDOW + 1).withColumn("size", F.col("n"))
    crowds = materialise(crowds, "vector-crowds").df
    zero = F.lit(0).cast("long")
    placed = skew_join(ranked, crowds, "crowd", "n", ranked.count(), "left").select("node", "pass", "rank", F.coalesce("first", zero).alias("first"), F.coalesce("size", zero).alias("size"))
    every = F.sort_array(F.collect_list(F.struct("pass", "rank", "first", "size")))
    return placed.groupBy("node").agg(every.alias("x")).select("node", F.col("x.rank").alias("ranks"), F.col("x.first").alias("firsts"), F.col("x.size").alias("sizes"))


def _compare(number: int, prefix: int, places: int):
    """For one task's rows: (node, null, links first found here) and (node, node, 0) for a forest."""
    def work(key, table):
        import numpy as np
        import pyarrow as pa

        crowd, first, low, high, dim = (k.as_py() for k in key)
        ranks = np.array(table.column("ranks").to_pylist(), np.int64).reshape(table.num_rows, number + 1)
        order = np.argsort(ranks[:, number], kind="stable")
        ranks = ranks[order]
        heads = np.array(table.column("keys").to_pylist(), np.int64).reshape(table.num_rows, number + 1)[order] >> (SIGNS - prefix)
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(-1, dim)[order]
        x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        node, many = (np.asarray(table.column(c))[order] for c in ("node", "n"))
        pos = ranks[:, number]
        links, label, edges = np.zeros(len(pos), np.int64), np.arange(len(pos)), []

        def root(i):
            while label[i] != i:
                label[i] = label[label[i]]
                i = label[i]
            return i

        def take(i, j):
            """Pairs that this task compares: those at COSINE that no earlier pass has compared."""
            for q in range(number):
                new = (np.abs(ranks[i, q] - ranks[j, q]) > WINDOW) & (heads[i, q] != heads[j, q])
                i, j = i[new], j[new]
            np.add.at(links, i, many[j])
            np.add.at(links, j, many[i])
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if (a := root(a)) != (b := root(b)):
                    label[max(a, b)] = min(a, b)
                    edges.append((node[a], node[b]))

        for at in range(0, len(pos), 256):
            if crowd:
                j0, j1 = at, len(pos)
            else:
                j0, j1 = at, min(len(pos), at + 256 + WINDOW)
            i, j = np.nonzero(x[at:at + 256] @ x[j0:j1].T >= COSINE)
            i, j = i + at, j + j0
            far = pos[j] - pos[i]
            if crowd:
                use = far > WINDOW
                if low != high:
                    use &= ((pos[i] - first) // BLOCK == low) & ((pos[j] - first) // BLOCK == high)
            else:
                use = (far > 0) & (far <= WINDOW) & (pos[j] // places == low)
            take(i[use], j[use])
        some = np.flatnonzero(links)
        return pa.Table.from_arrays([
            pa.array([*node[some].tolist(), *(int(a) for a, _ in edges)], pa.int64()),
            pa.array([*[None] * len(some), *(int(b) for _, b in edges)], pa.int64()),
            pa.array([*links[some].tolist(), *[0] * len(edges)], pa.int64())], ["a", "b", "links"])

    return work


def _pass(full: DataFrame, number: int, prefix: int, places: int) -> DataFrame:
    rank, first, size = (F.col(c)[number] for c in ("ranks", "firsts", "sizes"))
    zero = F.lit(0).cast("long")
    block = F.floor(rank / places).cast("long")

    def task(crowd, first, low, high):
        return F.struct(F.lit(crowd).alias("crowd"), first.alias("first"), low.alias("low"), high.alias("high"))

    windows = F.when(rank % places >= places - WINDOW, F.array(task(False, zero, block, zero), task(False, zero, block + 1, zero))).otherwise(F.array(task(False, zero, block, zero)))
    own = F.floor((rank - first) / BLOCK).cast("long")
    others = F.sequence(zero, F.greatest(zero, F.floor((size - 1) / BLOCK).cast("long")))
    crowds = F.when(size > 0, F.transform(others, lambda k: task(True, first, F.least(own, k), F.greatest(own, k)))).otherwise(F.filter(F.array(task(False, zero, zero, zero)), lambda _: F.lit(False)))
    tasks = full.select("node", "n", "dim", "vector", "keys", "ranks", F.explode(F.concat(windows, crowds)).alias("t"))
    keyed = tasks.select(F.col("t.crowd"), F.col("t.first"), F.col("t.low"), F.col("t.high"), "dim", "node", "n", "vector", *(F.slice(c, 1, number + 1).alias(c) for c in ("keys", "ranks")))
    return keyed.groupBy("crowd", "first", "low", "high", "dim").applyInArrow(_compare(number, prefix, places), "a long, b long, links long")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", exact: bool = False) -> DataFrame:
    """(id, n_links, component, kept) of every row of ``vectors``.

    n_links counts the other rows found at cosine 0.9 or more; component is the smallest
    id that links reach, the row's own included; kept tells whether the row is that one.
    Null, empty and zero vectors, and those with null or non-finite components, link with
    nothing, nor do vectors of different lengths with each other. Rows with equal ids are
    rows of their own; a null id names no component, unless the component has no other.
    With ``exact`` all vectors are one crowd, so a single pass compares every two of them,
    in blocks: nothing is missed, and the work grows with the square of their number.
    """
    passes = 1 if exact else passes_for(vectors.count())
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(partial(_keyed, passes=passes), "id long, vector binary, dim int, keys array<long>")
    rows = materialise(rows.withColumn("key", F.unhex(F.md5("vector"))), "vectors").df
    reps = rows.filter("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"), F.first("dim").alias("dim"), F.first("keys").alias("keys"))
    reps = materialise(reps.withColumn("one", F.lit(0)), "vector-classes").df
    count, total = reps.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not count:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(True).alias("kept"))
    numbers = materialise(with_rank(reps.select("one", "key"), ["one"], F.xxhash64("key"), ["key"], count, "node").select("key", "node"), "vector-nodes").df
    reps = reps.drop("one").join(numbers, "key")
    prefix = 0 if exact else min(SIGNS, max(LEAST_PREFIX, count.bit_length()))
    places = min(BLOCK, max(LEAST_BLOCK, count // (TASKS_A_CORE * vectors.sparkSession.sparkContext.defaultParallelism)))
    reps = materialise(reps, "vector-reps").df
    full = materialise(reps.join(_places(reps, prefix), "node"), "vector-places").df
    found = [materialise(_pass(full, number, prefix, places), f"vector-pass-{number}").df for number in range(passes)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    links = every.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(every.filter("b is not null").select("a", "b"), "vector-links").withColumnRenamed("node", "member")
    named = reps.select("node", "key", "least", "n").join(roots, F.col("node") == F.col("member"), "left").drop("member").withColumn("root", F.coalesce("root", "node"))
    named = materialise(named.join(links, "node", "left"), "vector-named").df
    names = named.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("members"))
    classes = skew_join(named, names, "root", "members", count).select("key", "n", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked = skew_join(rows.filter("key is not null").select("id", "key"), classes, "key", "n", total).select("id", "n_links", F.col("component"))
    alone = rows.filter("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
