"""Shards of near-equal size by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are sorted by size, largest first; each enters the shard with the
least remaining capacity that holds it, found in a balanced tree. The capacity is the
smallest with which the asked number of shards suffices. The driver sees only a
histogram: sizes are rounded up to 12 significant bits, so there are at most some 100,000
classes whatever the corpus, and groups of one class are placed together. Each group
then finds its shard by its rank in its class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, skew_join, with_rank

#: Significant bits of a size class.
BITS = 12


@dataclass
class _Node:
    key: tuple[int, int]
    height: int = 1
    left: "_Node | None" = None
    right: "_Node | None" = None


def _height(n):
    return n.height if n else 0


def _fixed(n):
    n.height = 1 + max(_height(n.left), _height(n.right))
    lean = _height(n.left) - _height(n.right)
    if lean > 1:
        if _height(n.left.left) < _height(n.left.right):
            n.left = _turned_left(n.left)
        return _turned_right(n)
    if lean < -1:
        if _height(n.right.right) < _height(n.right.left):
            n.right = _turned_right(n.right)
        return _turned_left(n)
    return n


def _turned_right(n):
    m = n.left
    n.left, m.right = m.right, n
    n.height = 1 + max(_height(n.left), _height(n.right))
    m.height = 1 + max(_height(m.left), _height(m.right))
    return m


def _turned_left(n):
    m = n.right
    n.right, m.left = m.left, n
    n.height = 1 + max(_height(n.left), _height(n.right))
    m.height = 1 + max(_height(m.left), _height(m.right))
    return m


class Tree:
    """A height-balanced search tree of (remaining capacity, bin)."""

    def __init__(self):
        self.root: _Node | None = None

    def add(self, key: tuple[int, int]) -> None:
        def into(n):
            if n is None:
                return _Node(key)
            if key < n.key:
                n.left = into(n.left)
            else:
                n.right = into(n.right)
            return _fixed(n)

        self.root = into(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def out_of(n, key):
            if key < n.key:
                n.left = out_of(n.left, key)
            elif key > n.key:
                n.right = out_of(n.right, key)
            elif n.left is None or n.right is None:
                return n.left or n.right
            else:
                m = n.right
                while m.left:
                    m = m.left
                n.key, n.right = m.key, out_of(n.right, m.key)
            return _fixed(n)

        self.root = out_of(self.root, key)

    def tightest(self, least: int) -> tuple[int, int] | None:
        """The smallest entry whose remaining capacity is at least ``least``."""
        n, best = self.root, None
        while n:
            if n.key[0] >= least:
                best, n = n.key, n.left
            else:
                n = n.right
        return best


def size_class(size: int) -> int:
    """``size`` rounded up to BITS significant bits."""
    shift = max(0, size.bit_length() - BITS)
    return -(-size >> shift) << shift


def _size_class(size: Column) -> Column:
    # bin() gives the binary digits, so their number is the bit length.
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - BITS)
    unit = F.pow(F.lit(2.0), shift).cast("long")
    return (F.floor((size + unit - 1) / unit) * unit).cast("long")


def best_fit_decreasing(counts: dict[int, int], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """For each bin, its (size, how many) by best fit decreasing; None if over ``most`` bins are needed."""
    tree, bins = Tree(), []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = tree.tightest(size)
            if at is None:
                if most is not None and len(bins) == most:
                    return None
                at = (capacity, len(bins))
                bins.append([])
                tree.add(at)
            room, i = at
            many = min(left, room // size)  # the tightest bin stays the tightest while it holds more
            bins[i].append((size, many))
            tree.remove(at)
            tree.add((room - many * size, i))
            left -= many
    return bins


def equal_bins(counts: dict[int, int], bins: int) -> list[list[tuple[int, int]]]:
    """``bins`` bins as equal as indivisible groups allow.

    A group larger than the mean of what is left gets a bin of its own; the others go
    best fit decreasing into the rest, with the smallest capacity that suffices.
    """
    left, own = dict(sorted(counts.items())), []
    total = sum(s * n for s, n in left.items())
    while len(own) < bins - 1 and left and (largest := max(left)) * (bins - len(own)) > total:
        own.append([(largest, 1)])
        total -= largest
        left[largest] -= 1
        if not left[largest]:
            del left[largest]
    rest = bins - len(own)
    if not left:
        return own + [[] for _ in range(rest)]
    low = max(max(left), -(-total // rest))
    high, found = low, best_fit_decreasing(left, low, rest)
    step = max(1, total // rest // 4096)
    while found is None:
        low, high, step = high + 1, high + step, step * 2
        found = best_fit_decreasing(left, high, rest)
    while low < high:
        middle = (low + high) // 2
        if (better := best_fit_decreasing(left, middle, rest)) is not None:
            high, found = middle, better
        else:
            low = middle + 1
    return own + found + [[] for _ in range(rest - len(found))]


def assign(docs: DataFrame, bins: int = 16, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, crc, shard, slot) of every row; rows of equal texts share a shard.

    size: UTF-8 bytes of the text plus 1; crc: its CRC-32, unsigned. Null and empty
    texts are one group. slot is gapless from 0 in a shard. Shards are of near-equal
    size as far as no group exceeds the mean; equal rows get slots of their own; no rows
    in, none out. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.unhex(F.md5(text)).alias("key"))
    rows = materialise(rows, "shard-rows").df
    groups = materialise(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("class", _size_class(F.col("size") * F.col("copies"))), "shard-groups").df
    counts = {r[0]: r[1] for r in groups.groupBy("class").count().collect()}
    plan, used = [], {}
    for shard, held in enumerate(equal_bins(counts, bins)):
        for size, many in held:
            at = used.get(size, 0)
            plan.append((size, at, at + many, shard))
            used[size] = at + many
    table = spark.createDataFrame(plan, "_class long, _first long, _end long, shard int")
    ranked = with_rank(groups, ["class"], F.xxhash64("key"), ["key"], sum(counts.values()))
    placed = ranked.join(F.broadcast(table), (F.col("class") == F.col("_class")) & (F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_end")))
    total = groups.agg(F.sum("copies")).first()[0] or 0
    put = materialise(skew_join(rows, placed.select("key", "copies", "shard"), "key", "copies", total).select("id", "size", "crc", "shard", F.monotonically_increasing_id().alias("row")), "shard-put").df
    return with_rank(put, ["shard"], F.xxhash64("row"), ["row"], total, "slot").select("id", "size", "crc", "shard", "slot")
