"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits over word shingles. The anchors are the words of a covering
code, the perfect [63, 57] Hamming code on bits 0 to 62 with bit 63 free, whose
covering radius is 1: every fingerprint has an anchor within distance 1. If two
fingerprints differ in at most 2 bits, some point lies within 1 of both, so that
point's anchor lies within 1 + 1 = 2 of both. Hence each distinct fingerprint is
replicated to every anchor within covering radius plus half the threshold, 2 or 33 of
them, and any linked pair meets at one anchor at least; nothing is missed. (The radius
plus the whole threshold would also do, but with some 680 anchors a fingerprint.) A cell
holds at most the 2,081 fingerprints within 2 of its anchor, whatever the corpus, so
comparing within cells is bounded work. Equal fingerprints collapse before that.

Texts with much in common differ in more bits than such a code can bridge at once.
``similar`` therefore takes fingerprints of 512 bits and covers blocks of 23 of them with
the perfect [23, 12] Golay code, whose covering radius is 3. What fingerprints propose is
decided by the shingles themselves: no link is kept without its exact Jaccard similarity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, materialise, skew_join

#: Bits in which linked fingerprints may differ; the anchors' radius follows from it.
THRESHOLD = 2
#: Shingles whose bits are summed at a time, which bounds memory for very long texts.
_BLOCK = 65_536

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text; 0 without words.

    A-Z lower-cased, split at ASCII white space; shingles of ``words`` words with
    repeats (all words if there are fewer), XXH64 with seed 42; a bit is set if it is
    in over half of the hashes.
    """
    import numpy as np
    from xxhash import xxh64_digest

    w = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    total = np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        part = w[i:i + _BLOCK + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
        digests = b"".join([xxh64_digest(s, 42) for s in shingles])
        total += np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, hash of the text, fingerprint as a signed long) of every row, the whole text each."""
    def work(batches):
        import pyarrow as pa

        for batch in batches:
            out = [fingerprint(t.as_py(), words) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([x - (1 << 64) if x >> 63 else x for x in out], pa.int64())], ["id", "hash", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), _hash(text).alias("hash"), text.alias("text")).mapInArrow(work, "id long, hash long, fp long")


def _hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def anchors(fp):
    """For an array of n unsigned fingerprints, the anchors within 2: arrays (row, anchor)."""
    import numpy as np

    one = np.uint64(1)
    syndrome = np.zeros(len(fp), np.uint64)
    for i in range(1, 64):
        syndrome ^= ((fp >> np.uint64(i - 1)) & one) * np.uint64(i)
    rows = np.arange(len(fp))
    top = one << np.uint64(63)

    def flip(x, position):  # positions from 1; 0 flips nothing
        return np.where(position > 0, x ^ (one << (np.maximum(position, one) - one)), x)

    near = flip(fp, syndrome)
    out = [(rows, near), (rows, near ^ top)]
    off = syndrome != 0
    s, x, r = syndrome[off], fp[off], rows[off]
    for i in range(1, 64):
        i = np.uint64(i)
        j = s ^ i
        use = j > i
        out.append((r[use], flip(flip(x[use], np.full(int(use.sum()), i)), j[use])))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _replicate(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        every = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
        for i in range(0, len(every), 20_000):
            fp = every[i:i + 20_000]
            rows, at = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(fp[rows].view(np.int64))], ["anchor", "fp"])


def _cell_links(fps, threshold: int):
    """Links that keep connected what is within ``threshold`` in one cell: (a, b) pairs, a forest."""
    import numpy as np

    m, links = len(fps), []
    label = np.arange(m)
    for i in range(m - 1):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= threshold) + i + 1
        for j in near[label[near] != label[i]]:
            a, b = label[i], label[j]
            if a != b:
                links.append((fps[i], fps[j]))
                label[label == max(a, b)] = min(a, b)
    return links


def _compare(threshold: int):
    def work(batches):
        """Rows sorted by anchor; a cell may continue in the next batch."""
        import numpy as np
        import pyarrow as pa

        held_a, held_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def done(a, f):
            links = []
            if len(a):
                starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                ends = np.append(starts[1:], len(a))
                size = ends - starts
                two = starts[size == 2]
                near = two[np.bitwise_count((f[two] ^ f[two + 1]).view(np.uint64)) <= threshold]
                links += list(zip(f[near].tolist(), f[near + 1].tolist(), strict=True))
                for s, e in zip(starts[size > 2], ends[size > 2], strict=True):
                    links += [(int(x.view(np.int64)), int(y.view(np.int64))) for x, y in _cell_links(f[s:e].view(np.uint64), threshold)]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        for batch in batches:
            a = np.concatenate([held_a, np.asarray(batch.column(0), np.int64)])
            f = np.concatenate([held_f, np.asarray(batch.column(1), np.int64)])
            if not len(a):
                continue
            cut = int(np.flatnonzero(a != a[-1])[-1]) + 1 if a[0] != a[-1] else 0
            yield done(a[:cut], f[:cut])
            held_a, held_f = a[cut:], f[cut:]
        yield done(held_a, held_f)

    return work


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, hash, fp, root, component) of every row of ``docs``; linked are fingerprints within 2 bits.

    ``component`` is the smallest id that links reach, the row's own included; ``root``
    names the component by a fingerprint; ``hash`` is the text's. Null and
    empty texts have fingerprint 0 and link like any other; repeated rows each come back,
    with equal results; a null id is carried but never becomes a component's name unless
    all ids of the component are null. No rows in, none out; other columns are ignored.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, words), "simhash").df
    distinct = materialise(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct").df
    cells = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor")
    roots = components(cells.mapInArrow(_compare(THRESHOLD), "a long, b long"), "simhash-links")
    named = distinct.join(roots, distinct.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialise(named.select("fp", "least", "n", "root"), "simhash-roots").df
    names = named.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("members"))
    total = named.agg(F.count(F.lit(1)), F.sum("n")).first()
    classes = skew_join(named, names, "root", "members", total[0] or 0).select("fp", "n", "root", "component")
    return skew_join(fps, classes, "fp", "n", total[1] or 0).select("id", "hash", "fp", "root", "component")


#: Bits of the wide fingerprint that a similarity is read from, and of a block of it.
WIDE, BLOCK_BITS = 512, 23
#: Bits in which blocks may differ and still are sure to share an anchor; the Golay code's covering radius.
BLOCK_THRESHOLD, RADIUS = 2, 3
#: The share of pairs at the similarity asked for that all blocks together are to find.
RECALL = 0.97
#: Fingerprints that a cell holds on average, at most about, and those that a task holds of one cell.
CELL, CELL_ROWS = 256, 8192
#: Removed rows up to which their names go to every worker; beyond that they are joined.
BROADCAST_ROWS = 500_000
#: Fixed value: the generator polynomial of the binary [23, 12] Golay code.
GOLAY = 0xC75
_SEED = 20_240_611
#: Pairs that a class left open proposes a row and cell in the first round; each round takes eight times as many.
PROPOSED = 32
#: Pairs of one text that a task of the comparison of shingles gets, at most about.
PAIR_ROWS = 8192


def shingle_hashes(text: str | None, words: int = 5):
    """The distinct XXH64 of the shingles of a text, ascending; none without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not w:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64))


def wide_fingerprint(text: str | None, words: int = 5) -> bytes:
    """The WIDE-bit SimHash over the distinct shingles of ``words`` words of a text; zeros without words.

    Shingles as in ``fingerprint``; each shingle's further bits are mixed from its first 64.
    """
    import numpy as np

    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return bytes(WIDE // 8)
    total = np.zeros(WIDE, np.int64)
    step = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(hashes), _BLOCK // 16):
        x = hashes[i:i + _BLOCK // 16, None] + step
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the finalizer of splitmix64
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.view(np.uint8), axis=1)
        whole = len(bits) // 255 * 255  # so many bits at a time as a byte can count
        total += bits[:whole].reshape(-1, 255, WIDE).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes)).tobytes()


def apart(similarity: float) -> float:
    """The share of bits in which fingerprints of texts with this Jaccard similarity differ on average."""
    import math

    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def limit_for(similarity: float) -> int:
    """Bits in which linked fingerprints may differ: the average at ``similarity`` and one standard deviation, so that five in six pairs just there are linked."""
    p = apart(similarity)
    return int(WIDE * p + (WIDE * p * (1 - p)) ** 0.5)


def _near_golay():
    """(syndrome of each bit, for each syndrome the words within RADIUS + BLOCK_THRESHOLD / 2 that have it, and how many)."""
    import itertools

    import numpy as np

    def rest(x):
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GOLAY << (i - 11)
        return x

    bits = np.array([rest(1 << i) for i in range(23)], np.int64)
    near = [sum(1 << i for i in c) for k in range(RADIUS + BLOCK_THRESHOLD // 2 + 1) for c in itertools.combinations(range(23), k)]
    of: list[list[int]] = [[] for _ in range(2048)]
    for x in near:
        s = 0
        for i in range(23):
            if x >> i & 1:
                s ^= int(bits[i])
        of[s].append(x)
    many = np.array([len(x) for x in of])
    table = np.zeros((2048, many.max()), np.int64)
    for s, xs in enumerate(of):
        table[s, :len(xs)] = xs
    return bits, table, many


def _golay_anchors(x, near):
    """For an array of 23-bit words, the codewords near each: arrays (row, anchor as its 12 leading bits)."""
    import numpy as np

    bits, table, many = near
    syndrome = np.zeros(len(x), np.int64)
    for i in range(23):
        syndrome ^= (x >> i & 1) * bits[i]
    use = np.arange(table.shape[1]) < many[syndrome][:, None]
    return np.nonzero(use)[0], ((x[:, None] ^ table[syndrome]) >> 11)[use]


def blocks_for(count: int, similarity: float) -> tuple[int, int]:
    """(blocks, bits taken as they are beside each) with which cells stay small and RECALL is reached.

    Simulated: blocks of two texts at similarity 0.8 share an anchor in 0.59 of cases, at
    0.85 in 0.69, at 0.9 in 0.79; a cell takes 0.0013 of unrelated fingerprints, and half
    with each bit beside it.
    """
    import math

    beside = max(0, math.ceil(math.log2(max(1.0, count * 0.0013 / CELL))))
    shared = max(0.05, min(0.95, 0.59 + 2.0 * (similarity - 0.8))) * (1 - apart(similarity)) ** beside
    return max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - shared))), beside


def _cells(blocks: int, beside: int):
    """(key, node, fp, ...) for every cell of every (node, fp, ...): a row a block and anchor near it."""
    def work(batches):
        import numpy as np
        import pyarrow as pa

        near, r = _near_golay(), np.random.default_rng(_SEED)
        places = []
        for b in range(blocks):  # blocks have bits of their own as far as there are enough
            own = np.arange(23 * b, 23 * (b + 1)) if 23 * (b + 1) <= WIDE else r.choice(WIDE, 23, replace=False)
            places.append(np.concatenate([own, r.choice(np.setdiff1d(np.arange(WIDE), own), beside, replace=False)]))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fps = part.column(1)
                bits = np.unpackbits(np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(-1, WIDE // 8), axis=1)
                for b, at_bits in enumerate(places):
                    x = bits[:, at_bits[:23]].astype(np.int64) @ (1 << np.arange(23))
                    more = bits[:, at_bits[23:]].astype(np.int64) @ (1 << np.arange(beside)) if beside else 0
                    rows, anchor = _golay_anchors(x, near)
                    key = anchor | (more[rows] << 12 if beside else 0) | b << (12 + beside)
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(c.take(pa.array(rows)) for c in part.columns)], ["key", *part.schema.names])

    return work


def _wide_links(fps, limit: int):
    """Links (i, j) of a forest that connects what is within ``limit``, transitively.

    The first row left is compared with all others. Those within ``limit`` of it are its
    cluster; a row farther than twice that is within ``limit`` of none of them, so only
    the rows between are compared with the cluster, one by one.
    """
    import numpy as np

    n, links = len(fps), []
    if n <= 192:
        some = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2, dtype=np.int32) <= limit
        if some.sum() == n:
            return links
    left = np.arange(n)
    while len(left) > 1:
        first, left = left[0], left[1:]
        far = np.bitwise_count(fps[left] ^ fps[first]).sum(1, dtype=np.int32)
        own, fringe = left[far <= limit], left[(far > limit) & (far <= 2 * limit)]
        links += [(first, j) for j in own]
        for at in range(0, len(own), 1024):
            if not len(fringe):
                break
            some = own[at:at + 1024]
            hit = np.zeros(len(fringe), bool)
            for k, y in enumerate(fringe):
                close = np.flatnonzero(np.bitwise_count(fps[some] ^ fps[y]).sum(1, dtype=np.int32) <= limit)
                if len(close):
                    hit[k] = True
                    links.append((some[close[0]], y))
            fringe = fringe[~hit]
        left = left[far > limit]
    return links


def _open_links(fps, labels, limit: int, most: int):
    """For each row, the ``most`` nearest of the later rows that are within ``limit`` and of another class; (i, i) says that there are more.

    Classes come by size, smallest first; every row of one is compared with all later
    classes. So a cell of one class takes nothing, and one large class a pass over its
    rows for each row of the others.
    """
    import numpy as np

    _, of, many = np.unique(labels, return_inverse=True, return_counts=True)
    order = np.lexsort((np.arange(len(fps)), of, many[of]))
    fps, of, links = fps[order], of[order], []
    ends = np.flatnonzero(np.append(of[1:] != of[:-1], True)) + 1
    start = 0
    for end in ends[:-1].tolist():
        for i in range(start, end):
            far = np.bitwise_count(fps[end:] ^ fps[i]).sum(1, dtype=np.int32)
            near = np.flatnonzero(far <= limit)
            if len(near) > most:
                links.append((order[i], order[i]))
                near = near[np.argsort(far[near], kind="stable")[:most]]
            links += [(order[i], order[end + j]) for j in near]
        start = end
    return links


def _compare_wide(limit: int, most: int | None = None):
    """Links of the forest of each cell; with ``most``, those of ``_open_links``, whose classes the last column names."""
    def work(batches):
        """Rows sorted by cell and part of it; a cell may continue in the next batch."""
        import numpy as np
        import pyarrow as pa

        keys, nodes, fps, labels = [], [], [], []

        def done(last):
            k, n = np.concatenate(keys), np.concatenate(nodes)
            c = np.concatenate(labels) if labels else None
            f = np.frombuffer(b"".join(fps), np.uint64).reshape(-1, WIDE // 64)
            ends = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            if last:
                ends = np.append(ends, len(k))
            links, at = [], 0
            for end in ends.tolist():
                if end - at > 1:
                    found = _wide_links(f[at:end], limit) if most is None else _open_links(f[at:end], c[at:end], limit, most)
                    links += [(n[at + i], n[at + j]) for i, j in found]
                at = end
            keys[:], nodes[:], fps[:] = [k[at:]], [n[at:]], [f[at:].tobytes()]
            if c is not None:
                labels[:] = [c[at:]]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

        for batch in batches:
            keys.append(np.stack([np.asarray(batch.column(i)) for i in range(3)], axis=1))
            nodes.append(np.asarray(batch.column(3)))
            fps.append(b"".join(batch.column(4).to_pylist()))
            if most is not None:
                labels.append(np.asarray(batch.column(5)))
            yield done(False)
        if keys:
            yield done(True)

    return work


def _proposals(rows: DataFrame, blocks: int, beside: int, limit: int, most: int | None = None) -> DataFrame:
    """(a, b) that cells of ``rows`` (node, fp, and with ``most`` its class) propose, see ``_compare_wide``.

    A cell of more than CELL_ROWS is dealt out in parts, every two of which meet in a task.
    """
    own = ["node", "fp"] + ([] if most is None else ["class"])
    cells = rows.select(*own).mapInArrow(_cells(blocks, beside), "key long, node long, fp binary" + ("" if most is None else ", class long"))
    full = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_ROWS).withColumn("parts", F.ceil(F.col("n") / CELL_ROWS).cast("long"))
    full = materialise(full, "wide-full")
    held = full.df.agg(F.sum("n")).first()[0] or 0
    zero = F.lit(0).cast("long")
    if held:
        part = F.pmod(F.xxhash64("node"), F.col("parts"))
        pairs = F.transform(F.sequence(zero, F.col("parts") - 1), lambda k: F.struct(F.least(part, k).alias("low"), F.greatest(part, k).alias("high")))
        dealt = skew_join(cells, full.df, "key", "n", max(1, held), "left").select("key", *own, F.explode(F.when(F.col("parts").isNull(), F.array(F.struct(zero.alias("low"), zero.alias("high")))).otherwise(pairs)).alias("x"))
        dealt = dealt.select("key", "x.low", "x.high", *own)
    else:
        dealt = cells.select("key", zero.alias("low"), zero.alias("high"), *own)
    order = ["key", "low", "high"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_compare_wide(limit, most), "a long, b long")


def _shingles(docs: DataFrame, nodes: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of ``nodes`` (node, and in ``rep`` the id and hash of a row that has it)."""
    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                s = shingle_hashes(batch.column(1)[i].as_py(), words).view("int64")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s))], ["node", "shingles"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _hash(text).alias("hash"), text.alias("text"))
    named = nodes.select("node", F.col("rep.id").alias("rep_id"), F.col("rep.hash").alias("rep_hash"))
    few = named.count() <= BROADCAST_ROWS
    found = rows.join(F.broadcast(named) if few else named, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("hash") == F.col("rep_hash")))
    return found.select("node", "text").mapInArrow(work, "node long, shingles array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of ``pairs`` whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    Shingles of a text with many pairs are dealt out to a task for each PAIR_ROWS of them.
    """
    total, zero, dealt, parts = pairs.count(), F.lit(0).cast("long"), pairs.select("a", "b"), {}
    for end, other in (("a", "b"), ("b", "a")):
        many = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")).withColumn(f"parts_{end}", F.ceil(F.col("n") / PAIR_ROWS).cast("long"))
        parts[end] = materialise(many, "wide-many").df
        dealt = skew_join(dealt, parts[end], end, "n", total).withColumn(f"part_{end}", F.pmod(F.xxhash64(other), F.col(f"parts_{end}"))).drop(f"parts_{end}")
    both = dealt
    for end in ("a", "b"):
        copies = shingles.join(parts[end], F.col("node") == F.col(end))
        copies = copies.select(end, F.col("shingles").alias(f"of_{end}"), F.explode(F.sequence(zero, F.col(f"parts_{end}") - 1)).alias(f"part_{end}"))
        both = both.join(copies, [end, f"part_{end}"])
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(shared / (F.size("of_a") + F.size("of_b") - shared) >= similarity).select("a", "b")


def _classes(docs: DataFrame, distinct: DataFrame, count: int, similarity: float, words: int, id_col: str, text_col: str) -> DataFrame:
    """(member, root) of the nodes of ``distinct`` that verified links connect.

    A forest of what is near by fingerprint is verified first. Where a link of it is
    struck, the texts that hung together by it are open: in rounds, each proposes its
    nearest of other classes, more in each round, until every pair that is near and meets
    in a cell is in one class or was compared by its shingles.
    """
    blocks, beside = blocks_for(count, similarity)
    limit = limit_for(similarity)

    def ordered(links):
        return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    tried = materialise(ordered(_proposals(distinct, blocks, beside, limit)), "wide-tried").df
    ends = tried.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    shingles = materialise(_shingles(docs, distinct.join(ends, "node", "left_semi"), words, id_col, text_col), "wide-shingles")
    good = materialise(_verified(tried, shingles.df, similarity), "wide-good").df
    roots = components(good, "wide-links")
    if good.count() < tried.count():
        groups = materialise(components(tried, "wide-groups").withColumnRenamed("root", "grp"), "wide-groups").df
        struck = groups.join(tried.join(good, ["a", "b"], "left_anti").select(F.col("a").alias("node")).distinct(), "node", "left_semi")
        sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).join(struck.select("grp").distinct(), "grp", "left_semi")
        open_ = materialise(skew_join(groups, sizes, "grp", "n", max(1, groups.count())).select("node").join(distinct.select("node", "fp"), "node"), "wide-open").df
        most = PROPOSED
        while True:
            labelled = open_.join(roots, "node", "left").select("node", "fp", F.coalesce("root", "node").alias("class"))
            raw = materialise(_proposals(labelled, blocks, beside, limit, most), "wide-raw")
            more = not raw.df.where("a = b").isEmpty()
            new = materialise(ordered(raw.df).join(tried, ["a", "b"], "left_anti"), "wide-new").df
            raw.drop()
            if not new.isEmpty():
                tried, linked = tried.unionByName(new), materialise(_verified(new, shingles.df, similarity), "wide-good").df
                if not linked.isEmpty():
                    good = good.unionByName(linked)
                    roots = components(good, "wide-links")
            if not more:
                break
            most *= 8
    roots = materialise(roots.withColumnRenamed("node", "member"), "wide-members").df
    shingles.drop()
    return roots


def similar(docs: DataFrame, similarity: float = 0.8, words: int = 5, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, root, component) of every row of ``docs``; linked are texts with a similarity of ``similarity`` or more.

    The similarity is the Jaccard similarity of the sets of ``words``-word shingles.
    Pairs are proposed by WIDE-bit fingerprints that differ in at most ``limit_for`` bits:
    blocks of the fingerprint are replicated to every word of the Golay code
    within its covering radius plus half the block's threshold, and whole fingerprints
    are compared per anchor. More blocks are used the more texts there are; what they
    miss of the pairs at ``similarity`` is at most 1 - RECALL, and less of closer pairs.
    Each proposed link is then decided by the shingles (by XXH64); texts with equal
    fingerprints count as one, which only all but equal sets of shingles have.

    ``component`` is the smallest id that links reach. Null and empty texts are alike;
    repeated rows each come back; a null id names no component unless all of it are null.
    No rows in, none out; other columns are ignored.
    """
    def work(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([wide_fingerprint(t.as_py(), words) for t in batch.column(2)], pa.binary())], ["id", "hash", "fp"])

    text = F.col(text_col).cast("string")
    fps = docs.select(F.col(id_col).cast("long").alias("id"), _hash(text).alias("hash"), text.alias("text")).mapInArrow(work, "id long, hash long, fp binary")
    fps = materialise(fps.withColumn("key", F.xxhash64("fp")), "wide").df
    distinct = fps.groupBy("fp").agg(F.min("id").alias("least"), F.min(F.struct("id", "hash")).alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id())
    distinct = materialise(distinct, "wide-distinct").df
    count, total = distinct.agg(F.count(F.lit(1)), F.sum("n")).first()
    roots = _classes(docs, distinct, count, similarity, words, id_col, text_col)
    named = distinct.join(roots, F.col("node") == F.col("member"), "left").withColumn("root", F.coalesce("root", "node"))
    named = materialise(named.select("fp", "least", "n", "root"), "wide-roots").df
    names = named.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("members"))
    classes = skew_join(named, names, "root", "members", count).select("fp", "n", "root", "component")
    return skew_join(fps.drop("key"), classes, "fp", "n", total or 0).select("id", "hash", "root", "component")


def one_of_each(docs: DataFrame, similarity: float = 0.8, words: int = 5, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of ``similar``: that with the smallest id (null ids last), then the smallest hash of its text.

    Of rows equal in id and text one stays, whichever their other columns are. Texts move
    only if the rows that go are too many to name to every worker.
    """
    classes = materialise(similar(docs, similarity, words, id_col=id_col, text_col=text_col), "wide-classes").df
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("x")).select("root", "x.id", "x.hash")
    groups = classes.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    more = materialise(skew_join(classes, groups.join(first.select("root", F.col("id").alias("kept"), F.col("hash").alias("kept_hash")), "root"), "root", "n", classes.count()), "wide-more").df
    a, b = fresh(docs.columns, "_id"), fresh(docs.columns, "_hash")
    gone = more.where(~(F.col("id").eqNullSafe(F.col("kept")) & (F.col("hash") == F.col("kept_hash")))).select(F.col("id").alias(a), F.col("hash").alias(b)).distinct()
    gone = materialise(gone, "wide-gone").df
    few = gone.count() <= BROADCAST_ROWS
    same = F.col(id_col).cast("long").eqNullSafe(F.col(a)) & (_hash(F.col(text_col).cast("string")) == F.col(b))
    stay = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    repeated = classes.groupBy("id", "hash").count().filter("count > 1")
    return stay if repeated.isEmpty() else stay.dropDuplicates([id_col, text_col])
