"""Vector codes by codebooks whose nearest entries are found through a VA-file.

Components become integers, vectors are cut into parts, and each part is coded by the
nearest entry of its codebook. The entries of a codebook are the VA-file: each of their
coordinates is quantised to BITS bits, the number of the cell it lies in, and what a cell
holds lies between its least and largest entry. A query looks its squared distances to the
two ends of each cell up in two tables of its own, summed over the coordinates a lower and
an upper bound for every entry; only entries whose lower bound is no larger than the
smallest upper bound are compared with it, in integers. The sums are products of the
tables with a 0-1 matrix in single precision, with a margin for rounding that can only add
candidates.

Rounds of assignment and averaging send to the driver at most a row for each coordinate of
each entry; the vectors are written once and never shuffled.
"""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, skew_join

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a cell's number; vectors that are bounded at a time.
BITS, AT_ONCE = 3, 1024
#: Scaled components are held within this, so that squared distances fit 64 bits.
LIMIT = 1 << 24
#: What single precision may make of a sum of squares, many times over.
MARGIN = 1e-3


class Cells:
    """The VA-file of a codebook: each entry's cells, and each cell's least and largest coordinate."""

    def __init__(self, book):
        import numpy as np

        self.book = book
        entries, width = book.shape
        cells = min(1 << BITS, entries)
        ordered = np.sort(book, axis=0)
        borders = ordered[np.arange(1, cells) * entries // cells]
        cell = np.stack([np.searchsorted(borders[:, k], book[:, k], side="right") for k in range(width)], 1) if width else np.zeros((entries, 0), np.int64)
        self.low, self.high = np.zeros((width, cells), np.float32), np.zeros((width, cells), np.float32)
        for k in range(width):
            for c in np.unique(cell[:, k]):
                held = book[cell[:, k] == c, k]
                self.low[k, c], self.high[k, c] = held.min(), held.max()
        chosen = np.zeros((width, cells, entries), np.float32)
        chosen[np.arange(width)[None, :], cell, np.arange(entries)[:, None]] = 1
        self.chosen = chosen.reshape(width * cells, entries)

    def candidates(self, x):
        """(rows, entries): the entries that may be nearest to each row of ``x``, at least one a row, both ascending."""
        import numpy as np

        at = x.astype(np.float32)[:, :, None]
        below, above = self.low - at, at - self.high
        lower = np.maximum(np.maximum(below, above), 0)
        upper = np.maximum(-below, -above)
        lower *= lower
        upper *= upper
        shape = (len(x), -1)
        bound = (upper.reshape(shape) @ self.chosen).min(1) if self.chosen.size else np.zeros(len(x), np.float32)
        least = lower.reshape(shape) @ self.chosen if self.chosen.size else np.zeros((len(x), len(self.book)), np.float32)
        return np.nonzero(least <= (bound * (1 + MARGIN) + 1)[:, None])

    def nearest(self, x):
        """(entry, squared distance) for each row of ``x``; ties go to the lower entry."""
        import numpy as np

        row, entry = self.candidates(x)
        away = x[row] - self.book[entry]
        square = np.einsum("ij,ij->i", away, away)
        least = np.minimum.reduceat(square, np.searchsorted(row, np.arange(len(x))))
        hit = np.flatnonzero(square == least[row])[::-1]
        code = np.empty(len(x), np.int64)
        code[row[hit]] = entry[hit]  # in falling order, so the lowest entry is written last
        return code, least


def _parts(batch, books):
    """For each chunk of a batch's vectors: where it begins, and per part the cells, its rows, their codes and distances."""
    import numpy as np

    width = sum(b.book.shape[1] for b in books)
    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width)
    edges = np.cumsum([0, *(b.book.shape[1] for b in books)])
    for at in range(0, len(x), AT_ONCE):
        some = x[at:at + AT_ONCE]
        yield some, [(piece := some[:, edges[p]:edges[p + 1]], *books[p].nearest(piece)) for p in range(len(books))]


def _sums(batches, books):
    """What this task adds to each coordinate of each entry: (part, entry, place, n, sum)."""
    import numpy as np
    import pyarrow as pa

    books = [Cells(b) for b in books]
    counts = [np.zeros(len(b.book), np.int64) for b in books]
    sums = [np.zeros(b.book.shape, np.int64) for b in books]
    for batch in batches:
        for _, parts in _parts(batch, books):
            for p, (piece, code, _) in enumerate(parts):
                counts[p] += np.bincount(code, minlength=len(counts[p]))
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                if piece.shape[1]:
                    sums[p][used] += np.add.reduceat(piece[order], first, axis=0)
    for p, (n, s) in enumerate(zip(counts, sums, strict=True)):
        used, width = np.flatnonzero(n), s.shape[1]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(used) * width, p, np.int32)), pa.array(np.repeat(used, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))),
            pa.array(np.repeat(n[used], width)), pa.array(s[used].reshape(-1))], ["part", "entry", "place", "n", "sum"])


def _codes(batches, books):
    import numpy as np
    import pyarrow as pa

    books = [Cells(b) for b in books]
    for batch in batches:
        codes, errors = [], []
        for _, parts in _parts(batch, books):
            text = np.stack([code for _, code, _ in parts], 1).astype(np.uint8).tobytes().hex()
            codes += [text[i:i + 2 * len(parts)] for i in range(0, len(text), 2 * len(parts))]
            errors.append(sum(d for _, _, d in parts))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(np.concatenate(errors) if errors else [], pa.int64())], ["id", "label", "code", "error"])


def _held(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label as text, v as integers) of the vectors that can be coded."""
    x = F.col("x")
    whole = F.size(x) > 0
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    read = vectors.select(F.col(id_col).cast("long").alias("id"), F.concat(F.lit("="), F.col(label_col).cast("string")).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    return read.filter(x.isNotNull() & whole & fine).select("id", F.coalesce("label", F.lit("")).alias("label"), scaled.alias("v"))


def encode(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each vector that can be coded.

    Dropped are null and empty vectors, those with null or non-finite components, and those
    of another length than most have (of the lengths that equally many have, the longest
    counts). Lengths that PARTS does not divide give the first parts a component more. A
    codebook has an entry for each of the 256 smallest ids, fewer if there are fewer
    vectors; rows with equal ids are ordered by their components, null ids come last. Rows
    with equal ids are otherwise rows of their own. Scaled components beyond LIMIT either
    way count as LIMIT, a component of 16,384. label_error is held at the largest long.
    An empty table gives an empty result. Other columns are ignored.
    """
    import numpy as np

    held = materialise(_held(vectors, id_col, vector_col, label_col), "vector-integers")
    lengths = held.df.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    spark, width, total = vectors.sparkSession, most["width"] if most else 0, most["n"] if most else 0
    rows = held.df.filter(F.size("v") == width)
    first = [r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()]
    if not first:
        return spark.createDataFrame([], "id long, code string, error long, label_error long, codebooks_sha256 string")
    books = np.array_split(np.array(first, np.int64), PARTS, axis=1)
    for _ in range(ROUNDS):
        added = rows.select("v").mapInArrow(partial(_sums, books=books), "part int, entry int, place int, n long, sum long")
        for r in added.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).collect():
            books[r["part"]][r["entry"], r["place"]] = r["sum"] // r["n"]
    said = hashlib.sha256(",".join(str(c) for b in books for c in b.reshape(-1).tolist()).encode()).hexdigest()
    coded = materialise(rows.mapInArrow(partial(_codes, books=books), "id long, label string, code string, error long"), "vector-codes").df
    largest = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    labels = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), largest).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n"))
    held.drop()
    return skew_join(coded, materialise(labels, "vector-labels").df, "label", "n", total).select("id", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))
