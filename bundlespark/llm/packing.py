"""Packing pieces into sequences of a fixed capacity.

Both packers plan on the driver over the histogram of lengths, which has at most
``capacity`` entries whatever the corpus, and return the plan as runs, whose number
depends on the histogram alone. Pieces of one length are alike to a plan, so a piece
finds its sequence by its rank among those of its length.

``configuration_plan`` solves the configuration linear program (fewest sequences, a
variable for each multiset of lengths that fits) by multiplicative weights: prices of
lengths fall exponentially with how far they are covered, a knapsack dynamic program
finds the most valuable completions under the prices, and those are used a little. The
fractional solution is rounded down, the rest solved again, and the last remainder
packed best fit decreasing. ``best_fit_plan`` is best fit decreasing throughout, with a
segment tree over capacities to find the tightest sequence.
"""

from __future__ import annotations

import logging
import math

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import materialise, with_rank

_log = logging.getLogger(__name__)

#: The share of the linear program's solution that is used whole; the remainder then
#: still has lengths of every size, which best fit needs to fill its sequences.
ROUNDED = 0.9

#: How the program is solved, one after another until a plan is within CLOSE of the lower
#: bound: rounds, rate, pricings a round, lengths up to which it is tried.
SOLVERS, CLOSE = ((30, 6.0, 1, 1 << 30), (30, 6.0, 12, 1 << 30), (100, 20.0, 12, 256)), 1.002
#: How often what rounding leaves is solved again.
SOLVES = 5

Config = tuple[tuple[int, int], ...]  # (length, how many of it), longest first


@dataclass
class SegmentTree:
    """Which capacities 0..size-1 have an open sequence; finds the smallest at or above one."""

    size: int
    tree: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.leaves = 1 << max(1, (self.size - 1).bit_length())
        self.tree = [0] * (2 * self.leaves)

    def add(self, at: int, by: int) -> None:
        i = at + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def first(self, least: int) -> int:
        """The smallest occupied capacity >= least, or -1."""
        i = least + self.leaves
        if least >= self.size:
            return -1
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, Config]]:
    """(how many sequences, what each holds) by best fit decreasing.

    Lengths are placed longest first, each into the open sequence with the least room
    that suffices. Sequences with equal contents are handled together.
    """
    tree = SegmentTree(capacity + 1)
    open_at: dict[int, list[list]] = {}  # room -> [[how many, contents]]
    closed: list[tuple[int, Config]] = []

    def put(many: int, room: int, held: Config) -> None:
        if many and room == 0:
            closed.append((many, held))
        elif many:
            open_at.setdefault(room, []).append([many, held])
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = tree.first(length)
            many, held = (left, ()) if room < 0 else open_at[room].pop()
            if room >= 0:
                tree.add(room, -1)
            else:
                room = capacity
            each = room // length
            full = min(many, left // each)
            put(full, room - each * length, (*held, (length, each)))
            left -= full * each
            many -= full
            if many and left:
                put(1, room - left * length, (*held, (length, left)))
                left, many = 0, many - 1
            if held:
                put(many, room, held)
    return closed + [(n, held) for groups in open_at.values() for n, held in groups]


def _knapsack(lengths, prices, capacity):
    """(value, choice) of the best filling of each room 0..capacity; choice: index of a length, or -1."""
    import numpy as np

    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(int(lengths[0]), capacity + 1):
        k = upto[room]
        worth = prices[:k] + value[room - lengths[:k]]
        value[room] = worth[best := int(worth.argmax())]
        choice[room] = best
    return value, choice


def configuration_lp(counts: dict[int, int], capacity: int, rounds: int = 30, rate: float = 6.0, repriced: int = 12) -> tuple[dict[Config, float], float]:
    """A fractional solution {configuration: times} and a lower bound on the sequences.

    Multiplicative weights: a length's price is its size times exp(-rate * (its covered
    share - the share of rounds done)). A round prices once and uses the best completion
    of every length, from the most valuable on, until the round's share of the sequences is
    spent. No length is used beyond its own share of the round: those that reach it are
    taken out and the others priced again, so a scarce length that fits everywhere, such
    as a very short one, doesn't hold up the rest.
    """
    import numpy as np

    lengths = np.array(sorted(counts))
    size, times, wanted = lengths.tolist(), {}, np.array([float(counts[x]) for x in sorted(counts)])
    covered = np.zeros(len(size))
    bound = max(float(wanted @ lengths) / capacity, float(wanted[2 * lengths > capacity].sum()))
    for step in range(rounds):
        lag = covered / wanted - (step + 0.5) / rounds
        prices = lengths / capacity * np.exp(-rate * np.clip(lag, -1, 1))
        share = np.minimum(wanted * 1.5 / rounds, wanted - covered)
        spent, using = 0.0, np.arange(len(size))
        for again in range(repriced):
            value, choice = _knapsack(lengths[using], prices[using], capacity)
            if not again:
                bound = max(bound, float(wanted @ prices) / value[capacity])
                budget = bound / rounds
            worth, then, mine = prices[using] + value[capacity - lengths[using]], choice.tolist(), using.tolist()
            for first in np.argsort(-worth, kind="stable").tolist():
                if spent >= budget:
                    break
                held, room, i = {}, capacity, first
                while i >= 0:
                    held[mine[i]] = held.get(mine[i], 0) + 1
                    room -= size[mine[i]]
                    i = then[room]
                much = min([budget - spent, *(share[i] / k for i, k in held.items())])
                if much <= 0:
                    continue
                key = tuple((size[i], held[i]) for i in sorted(held, reverse=True))
                times[key] = times.get(key, 0.0) + much
                for i, k in held.items():
                    covered[i] += much * k
                    share[i] -= much * k
                spent += much
            using = np.flatnonzero(share > 1e-9 * wanted)
            if spent >= budget or not len(using):
                break
    return times, bound


def used(plan: list[tuple[int, Config]]) -> int:
    return sum(many for many, _ in plan)


def _take(left: dict[int, int], chosen) -> list[tuple[int, Config]]:
    """Whole sequences of ``chosen`` (configuration, times), those used most first; takes them out of ``left``."""
    plan = []
    for held, much in sorted(chosen, key=lambda x: (-x[1], x[0])):
        many = min([int(much + 1e-9), *(left.get(n, 0) // k for n, k in held)])
        if many > 0:
            plan.append((many, held))
            for n, k in held:
                left[n] -= many * k
                if not left[n]:
                    del left[n]
    return plan


def configuration_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, Config]]:
    """(how many sequences, what each holds): the linear program, rounded.

    Two roundings of a solution are tried. One takes nine tenths of its exactly full
    sequences and leaves the rest to best fit, which then still has lengths of every size.
    The other takes every configuration of the solution, rounds it down, and solves what is
    left again while that gets anywhere. The shortest plan wins, best fit alone being one
    of them, so no plan is worse. How far it lies from the program's own lower bound is
    logged.
    """
    whole = [(counts[capacity], ((capacity, 1),))] if counts.get(capacity) else []
    lengths = {x: n for x, n in counts.items() if n and x < capacity}
    if not lengths:
        return whole
    best, bound = best_fit_plan(lengths, capacity), 0.0
    for rounds, rate, repriced, most in SOLVERS:
        if bound and used(best) <= math.ceil(bound - 1e-6) * CLOSE or len(lengths) > most:
            break
        times, least = configuration_lp(lengths, capacity, rounds, rate, repriced)
        bound = max(bound, least)
        left = dict(lengths)
        full = _take(left, [(held, ROUNDED * much) for held, much in times.items() if sum(n * k for n, k in held) == capacity])
        best = min(best, full + best_fit_plan(left, capacity), key=used)
        if used(best) <= math.ceil(bound - 1e-6) * CLOSE:
            break
        left, plan = dict(lengths), []
        for _ in range(SOLVES):
            before = sum(left.values())
            plan += _take(left, times.items())
            if not left or sum(left.values()) > 0.9 * before:
                break
            times, _ = configuration_lp(left, capacity, rounds, rate, repriced)
        best = min(best, plan + best_fit_plan(left, capacity), key=used)
    _log.info("%d sequences; the program's lower bound is %d", used(whole + best), used(whole) + math.ceil(bound - 1e-6))
    return whole + best


def runs(plan: list[tuple[int, Config]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of it a sequence, offset) for each run of a plan."""
    out, used, sequence = [], {}, 0
    for many, held in plan:
        offset = 0
        for length, each in held:
            at = used.get(length, 0)
            out.append((length, at, at + many * each, sequence, each, offset))
            used[length] = at + many * each
            offset += length * each
        sequence += many
    return out


PLANS = {"configuration": configuration_plan, "best_fit": best_fit_plan}


def place(cut: DataFrame, capacity: int, method: str = "configuration") -> DataFrame:
    """``cut`` (a written table with length and row, a number that no two rows share) with sequence_id and offset.

    Every piece gets a place; offsets are gapless from 0 in each sequence. No rows in,
    none out. The plan is made on the driver from at most ``capacity`` counts.
    """
    spark = cut.sparkSession
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    plan = runs(PLANS[method](counts, capacity)) if counts else []
    table = spark.createDataFrame(plan, "_length long, _first long, _end long, _sequence long, _each long, _offset long")
    ranked = with_rank(cut, ["length"], F.xxhash64("row"), ["row"], sum(counts.values()), "_rank")
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    return (ranked.join(F.broadcast(table), on)
            .withColumn("sequence_id", F.expr("_sequence + (_rank - _first) div _each"))
            .withColumn("offset", F.expr("_offset + (_rank - _first) % _each * length"))
            .drop("_length", "_first", "_end", "_sequence", "_each", "_offset", "_rank", "row"))


def pack(docs: DataFrame, path: str, capacity: int = 2048, *, method: str = "configuration", id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Tokenizes ``docs`` and places every piece; see ``tokens.pieces`` and ``place``.

    Null and empty texts are one piece, the final 0. Texts over ``capacity`` ids are cut,
    losslessly; equal rows are separate documents, whatever their ids. Other columns,
    whatever their names, are ignored.
    """
    cut = tokens.pieces(docs, path, capacity, id_col=id_col, text_col=text_col, ids=ids)
    return place(materialise(cut.withColumn("row", F.monotonically_increasing_id()), "pieces").df, capacity, method)


#: Ids that a task packs at a time, two bytes each: bounds its memory.
HELD_IDS = 16 << 20
#: The least filled share of a sequence that a task closes by itself.
FULL = 0.99
_MATRIX = "sequence_id long, input_ids binary, n_ids int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"


def _matrix_schema():
    import pyarrow as pa

    ints = pa.list_(pa.int32())
    return pa.schema([("sequence_id", pa.int64()), ("input_ids", pa.binary()), ("n_ids", pa.int32()), ("cu_seqlens", ints), ("position_resets", ints), ("doc_ids", pa.list_(pa.int64())), ("pieces", ints), ("starts", pa.list_(pa.int64()))])


def _matrix_row(number: int | None, parts: list[tuple[int, int, int, bytes]], size: int) -> dict:
    ends = [0]
    for p in parts:
        ends.append(ends[-1] + len(p[3]) // 2)
    return {"sequence_id": number, "input_ids": b"".join([p[3] for p in parts]).ljust(2 * size, b"\0"), "n_ids": ends[-1], "cu_seqlens": ends, "position_resets": ends[:-1],
            "doc_ids": [p[0] for p in parts], "pieces": [p[1] for p in parts], "starts": [p[2] for p in parts]}


def matrices(docs: DataFrame, path: str, capacity: int = 2048, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed id matrices: a row for each sequence, best fit decreasing, texts over ``capacity`` ids cut losslessly.

    Columns: sequence_id, input_ids (``capacity`` little-endian unsigned 16-bit ids, zeros
    after the last), n_ids, cu_seqlens (0, then where each segment ends),
    position_resets (where positions start again from 0), doc_ids, pieces and starts (of
    each segment: its document, number there and the document's ids before it).

    Each task packs what it tokenizes, up to ``HELD_IDS`` ids at a time, and closes the
    sequences that are filled to FULL. The pieces of the others, few if tasks are large,
    are packed by one plan for the whole input. So but for that plan's sequences all are
    filled to FULL, however the input is split, and ids are shuffled only where they have
    to meet. Null and empty texts are one id, 0; no rows in, none out.
    """
    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema, held, size, number = _matrix_schema(), {}, 0, TaskContext.get().partitionId() << 40

        def packed():
            nonlocal held, size, number
            rows = []
            for many, config in best_fit_plan({n: len(x) for n, x in held.items()}, capacity):
                for _ in range(many):
                    parts = [held[n].pop() for n, k in config for _ in range(k)]
                    if sum(n * k for n, k in config) >= FULL * capacity:
                        rows.append(_matrix_row(number, parts, capacity))
                        number += 1
                    else:
                        rows += [_matrix_row(None, [p], 0) for p in parts]
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            held, size = {}, 0
            yield pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flat = tokens.encode(text.as_py(), path, 2) + b"\0\0"
                for piece, at in enumerate(range(0, len(flat), 2 * capacity)):
                    part = flat[at:at + 2 * capacity]
                    held.setdefault(len(part) // 2, []).append((key, piece, at // 2, part))
                size += len(flat) // 2
                if size > HELD_IDS:
                    yield from packed()
        yield from packed()

    def joined(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [_matrix_row(-1 - number, [(p["doc_id"], p["piece"], p["start"], p["ids"]) for p in some], capacity) for number, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, _matrix_schema())

    raw = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, _MATRIX)
    made = materialise(raw.withColumn("row", F.monotonically_increasing_id()), "matrices").df
    left = made.where("sequence_id is null").select("row", F.col("n_ids").cast("long").alias("length"), F.col("doc_ids")[0].alias("doc_id"), F.col("pieces")[0].alias("piece"), F.col("starts")[0].alias("start"), F.col("input_ids").alias("ids"))
    held = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "ids"))).alias("held")
    rest = place(left, capacity, "best_fit").groupBy("sequence_id").agg(held).mapInArrow(joined, _MATRIX)
    return made.where("sequence_id is not null").drop("row").unionByName(rest)


def write_matrices(docs: DataFrame, path: str, to: str, capacity: int = 2048) -> None:
    """Writes ``matrices`` of ``docs`` as Parquet to ``to``, one file a task; ``read_matrix`` gives a file's ids back."""
    matrices(docs, path, capacity).write.parquet(to)


def read_matrix(rows) -> "tuple":
    """(ids as a matrix of unsigned 16-bit, a row a sequence; positions, counted anew in each segment) of collected rows."""
    import numpy as np

    ids = np.stack([np.frombuffer(r["input_ids"], "<u2") for r in rows]) if rows else np.zeros((0, 0), np.uint16)
    positions = np.tile(np.arange(ids.shape[1]), (len(rows), 1))
    for line, r in zip(positions, rows, strict=True):
        for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            line[a:b] = np.arange(b - a)
    return ids, positions
