"""Benchmark texts in documents, found through a distributed positional inverted index.

The index is dealt out by document: a segment holds some SEGMENT_BYTES of whole texts, the
terms in them, and for each term its postings, the places in the segment where it stands.
Segments are built where the texts are read and written as a table, so indexing shuffles
nothing, a frequent word is never one task's work, and one index serves any number of
benchmarks.

A benchmark goes to all segments in blocks of bounded size. In a segment each window of
ten words is looked up by its rarest word there. Neighbouring windows mostly have the same
one, so a word's postings are opened once for all of them, intersected with the postings of
the words beside it, each moved by its distance, and followed outwards while they agree: a
stretch of ten or more words is an occurrence of every window in it. Membership in a
posting list is asked of a table of the segment's places, which the lists fill.

Proximity: a window is near a place if all of its words stand within SPAN words there, in
any order. Postings of the rarest are intersected with those of the other words, from the
next rarest on, within that distance, and what is left is verified.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, with_rank

#: Words of a window. Items with fewer are one window.
WINDOW = 10
#: Words within which the words of a window are near each other.
SPAN = 20
#: Bytes of text in a segment, unless one document has more.
SEGMENT_BYTES = 4 << 20
#: A block of a benchmark: so many pieces of so many words each; longer words are known by a digest, so a block has at most 16 M words of at most LONGEST bytes.
BLOCK_PIECES, PIECE_WORDS, LONGEST = 16_384, 1_000, 64
#: Postings that are opened at a time.
AT_ONCE = 1 << 20

_OUT = "segment long, ordinal int, id long, n_words long, stretches array<struct<start:long,stop:long,item:string>>, near array<string>"


def _table():
    """Bytes of a text to bytes of its words, lower-cased, and blanks. All of a character outside ASCII belongs to a word."""
    return bytes(b if b > 0x7F or chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _short(word: bytes) -> bytes:
    import hashlib

    return word if len(word) <= LONGEST else b" " + hashlib.sha256(word).digest()


def _planes(values) -> bytes:
    """Integers as their lowest bytes, then the next, and so on, which compresses well for small ones."""
    return values.astype("<u4").view("u1").reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _segment(ids: list, texts: list[bytes]):
    """One row of the index. Places count words, with one place between documents."""
    import numpy as np
    import pyarrow as pa

    table = _table()
    data = np.frombuffer(b"\n".join([t.translate(table) for t in texts]) + b"\n", np.uint8)
    blank = data <= 0x20
    edge = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = stops - starts
    n_words = np.diff(np.concatenate([[0], np.searchsorted(starts, np.flatnonzero(data == 10))]))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[~blank]))]).dictionary_encode()
    term, terms = words.indices.to_numpy(), [_short(w) for w in words.dictionary.to_pylist()]
    place = np.arange(len(term)) + np.repeat(np.arange(len(ids)), n_words)
    order = np.argsort(term.astype(np.uint16) if len(terms) < 1 << 16 else term, kind="stable")
    counts = np.bincount(term, minlength=len(terms))
    postings = place[order]
    gaps = np.diff(postings, prepend=0)
    first = np.cumsum(counts) - counts
    gaps[first] = postings[first]
    return ids, n_words.tolist(), terms, counts.tolist(), _planes(gaps)


def _segments(batches):
    import pyarrow as pa

    def row(ids, texts):
        parts = _segment(ids, texts)
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(parts, kinds, strict=True)], ["ids", "n_words", "terms", "counts", "postings"])

    ids, texts, held = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_py() or b""
            if ids and held + len(data) > SEGMENT_BYTES:
                yield row(ids, texts)
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(data)
            held += len(data) + 1
    if ids:
        yield row(ids, texts)


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of segments: (segment, ids and n_words of its documents, terms, counts and postings of the terms).

    A null or empty text has no words; rows with equal ids are documents of their own; an
    empty table has no segments.
    """
    read = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"))
    made = read.mapInArrow(_segments, "ids array<long>, n_words array<long>, terms array<binary>, counts array<long>, postings binary")
    return materialise(made.withColumn("segment", F.monotonically_increasing_id()), "postings").df


def _pieces(batches):
    """(item, piece of its words): every window of an item lies in a piece, and a piece has no window twice."""
    import pyarrow as pa

    table = _table()
    for batch in batches:
        out = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = [_short(w) for w in (text.as_py() or b"").translate(table).split(b" ") if w]
            for at in range(0, max(1, len(words) - WINDOW + 1), PIECE_WORDS - WINDOW + 1):
                if words:
                    out.append((item or "", words[at:at + PIECE_WORDS]))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.binary()))], ["item", "words"])


class Block:
    """Pieces of a benchmark, one after another: their words as numbers of a vocabulary, and their windows."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]]):
        import numpy as np

        number: dict[bytes, int] = {}
        self.items = [item for item, _ in pieces]
        self.words = np.array([number.setdefault(w, len(number)) for _, words in pieces for w in words], np.int64)
        self.vocabulary = list(number)
        sizes = np.array([len(words) for _, words in pieces], np.int64)
        self.stop = np.cumsum(sizes)
        self.start = self.stop - sizes
        self.piece = np.repeat(np.arange(len(pieces)), sizes)
        left = self.stop[self.piece] - np.arange(len(self.words))  # words from here to the piece's end
        whole = np.minimum(sizes, WINDOW)[self.piece]
        self.window = np.flatnonzero(left >= whole)
        self.length = whole[self.window]


class Segment:
    """A row of the index, opened."""

    def __init__(self, row, block: Block):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        self.ids, self.n_words = row["ids"], np.array(row["n_words"], np.int64)
        counts, gaps = np.array(row["counts"], np.int64), _from_planes(row["postings"])
        self.first = np.cumsum(counts) - counts
        run = np.cumsum(gaps)
        self.postings = run - np.repeat(run[self.first] - gaps[self.first], counts) if len(run) else run
        self.document = np.cumsum(self.n_words + 1) - self.n_words - 1  # where each document begins
        self.places = np.full(int(self.n_words.sum()) + len(self.ids) + 2 * WINDOW, -1, np.int64)  # WINDOW places before, so that neighbours exist
        self.places[self.postings + WINDOW] = np.repeat(np.arange(len(counts)), counts)
        here = pc.index_in(pa.array(block.vocabulary, pa.binary()), value_set=pa.array(row["terms"], pa.binary())).fill_null(-2).to_numpy()
        self.word = here[block.words]  # -2: not in this segment
        self.count = np.where(self.word >= 0, np.append(counts, 0)[self.word], 0)

    def rarest(self, block: Block):
        """The windows all of whose words are here: (start, length, offset of its rarest word)."""
        import numpy as np

        none = np.iinfo(np.int64).max
        count = np.concatenate([self.count, np.full(WINDOW, none)])
        windows = np.lib.stride_tricks.sliding_window_view(count, WINDOW)[block.window]
        counted = np.where(np.arange(WINDOW) < block.length[:, None], windows, none)
        at = counted.argmin(1)
        here = counted[np.arange(len(at)), at] > 0
        return block.window[here], block.length[here], at[here]

    def open(self, words):
        """(which of ``words``, place): all postings of their terms, in lots of about AT_ONCE."""
        import numpy as np

        ends = np.cumsum(self.count[words])
        at = 0
        while at < len(words):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            counts = self.count[words[at:upto]]
            which = np.repeat(np.arange(at, upto), counts)
            within = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield which, self.postings[np.repeat(self.first[self.word[words[at:upto]]], counts) + within]
            at = upto

    def of(self, place):
        """The documents of places."""
        import numpy as np

        return np.searchsorted(self.document, place, "right") - 1


def _phrases(segment: Segment, block: Block):
    """(place, places, piece) of the stretches that agree with a piece in a whole window or more."""
    import numpy as np

    start, _, offset = segment.rarest(block)
    anchors = np.unique(start + offset)
    found = [np.zeros((3, 0), np.int64)]
    for which, place in segment.open(anchors):
        a = anchors[which]
        low, high = block.start[block.piece[a]], block.stop[block.piece[a]]
        word = np.append(segment.word, -3)
        # The word before or the one after must be there too: no window is one word long unless its item is.
        keep = (high - low == 1) | ((a + 1 < high) & (segment.places[place + WINDOW + 1] == word[a + 1])) | ((a > low) & (segment.places[place + WINDOW - 1] == word[a - 1]))
        a, place, low, high = a[keep], place[keep], low[keep], high[keep]
        sides = []
        for step in (-1, 1):
            reach, on = np.zeros(len(a), np.int64), np.ones(len(a), bool)
            for k in range(1, WINDOW):
                there = a + k * step
                on &= (there >= low) & (there < high)
                on &= segment.places[np.where(on, place + WINDOW + k * step, 0)] == word[np.where(on, there, -1)]
                reach += on
            sides.append(reach)
        left, right = sides
        long = left + right + 1 >= np.minimum(WINDOW, high - low)
        found.append(np.stack([(place - left)[long], (left + right + 1)[long], block.piece[a[long]]]))
    return np.concatenate(found, 1)


def _within(segment: Segment, terms: set, place: int, span: int) -> bool:
    """Whether all ``terms`` stand within ``span`` words of one document, ``place`` among them."""
    doc = int(segment.of(place))
    begin, end = segment.document[doc], segment.document[doc] + segment.n_words[doc]
    at: dict[int, int] = {}
    for p in range(max(begin, place - span + 1), min(end, place + span)):
        term = int(segment.places[p + WINDOW])
        if term in terms:
            at[term] = p
            if len(at) == len(terms) and p - min(at.values()) < span:
                return True
    return False


def _proximity(segment: Segment, block: Block, span: int):
    """(document, item) pairs: a window of the item has all its words within ``span`` words of the document."""
    import numpy as np

    found = set()
    for start, length, offset in zip(*segment.rarest(block), strict=True):
        item = block.items[block.piece[start]]
        words = segment.word[start:start + length]
        count = segment.count[start:start + length]
        terms = dict(sorted(zip(words.tolist(), count.tolist(), strict=True), key=lambda t: t[1]))
        first = segment.first[words[offset]]
        place = segment.postings[first:first + count[offset]]
        for term, n in list(terms.items())[1:]:
            others = segment.postings[segment.first[term]:segment.first[term] + n]
            after = np.searchsorted(others, place)
            near = (after < n) & (others[np.minimum(after, n - 1)] - place < span)
            near |= (after > 0) & (place - others[np.maximum(after - 1, 0)] < span)
            place = place[near]
            if not len(place):
                break
        for p in place.tolist():
            pair = (int(segment.of(p)), item)
            if pair not in found and _within(segment, set(terms), p, span):
                found.add(pair)
    return found


def _look_up(batches, block, span: int, every: bool):
    import numpy as np
    import pyarrow as pa

    block = block.value
    schema = pa.schema([("segment", pa.int64()), ("ordinal", pa.int32()), ("id", pa.int64()), ("n_words", pa.int64()), ("stretches", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("item", pa.string())]))), ("near", pa.list_(pa.string()))])
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            segment = Segment(row, block)
            stretches: dict[int, set] = {}
            place, size, piece = _phrases(segment, block)
            for p, d, n, i in zip(place.tolist(), segment.of(place).tolist(), size.tolist(), piece.tolist(), strict=True):
                stretches.setdefault(d, set()).add((p - int(segment.document[d]), n, block.items[i]))
            near: dict[int, list] = {}
            for d, item in sorted(_proximity(segment, block, span)) if span else ():
                near.setdefault(d, []).append(item)
            out = range(len(segment.ids)) if every else sorted({*stretches, *near})
            n_words = np.asarray(segment.n_words)
            yield pa.RecordBatch.from_arrays([
                pa.array([row["segment"]] * len(out), pa.int64()), pa.array(out, pa.int32()), pa.array([segment.ids[d] for d in out], pa.int64()), pa.array([int(n_words[d]) for d in out], pa.int64()),
                pa.array([[{"start": s, "stop": s + n, "item": i} for s, n, i in sorted(stretches.get(d, ()))] for d in out], schema.field("stretches").type), pa.array([near.get(d, []) for d in out], schema.field("near").type)], schema=schema)


def matches(postings: DataFrame, benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """A row for each document of an ``index``: (segment, ordinal, id, n_words, stretches, near).

    ``stretches`` are the exact matches (start, stop, item): words start to stop - 1 of the
    document agree with consecutive words of the item, a whole window or more; a longer
    match may come in overlapping stretches. ``near`` are the items of which a window has
    all its words within ``span`` words of the document (span 0: not looked for). Items
    without words match nothing; those without an id go by the empty string; items with one
    id are one. A benchmark of any size is matched in blocks of bounded size.
    """
    spark = postings.sparkSession
    cut = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string").cast("binary")).mapInArrow(_pieces, "item string, words array<binary>")
    pieces = materialise(cut, "benchmark-pieces")
    count = pieces.df.count()
    numbered = with_rank(pieces.df.withColumn("one", F.lit(0)), ["one"], F.xxhash64("item", "words"), ["item", "words"], count, "number")
    numbered = materialise(numbered.select("item", "words", F.floor(F.col("number") / BLOCK_PIECES).alias("block")), "benchmark-blocks")
    blocks, found = max(1, -(-count // BLOCK_PIECES)), None
    for block in range(blocks):
        held = [(r["item"], [bytes(w) for w in r["words"]]) for r in numbered.df.filter(F.col("block") == block).select("item", "words").collect()]
        some = postings.mapInArrow(partial(_look_up, block=spark.sparkContext.broadcast(Block(held)), span=span, every=not block), _OUT)
        found = some if found is None else found.unionByName(some)
    pieces.drop()
    numbered.drop()
    if blocks == 1:
        return found
    flat = lambda c: F.flatten(F.collect_list(c))
    return found.groupBy("segment", "ordinal").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_sort(flat("stretches")).alias("stretches"), F.array_distinct(flat("near")).alias("near"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) of every row of ``docs``.

    n_hit counts the words inside an exact match of a window, each once; n_items the items
    with one; items_sha256 is the digest of their ids, sorted and joined by commas; n_near
    counts the items with a window near a place of the document, exact matches among them.
    Null and empty texts have no words and match nothing; rows with equal ids are documents
    of their own; other columns are ignored. No benchmark items: nothing is contaminated.
    """
    found = matches(index(docs, id_col=id_col, text_col=text_col), benchmark, item_col=item_col, text_col=item_text_col, span=span)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["upto"], s["start"]))).alias("n"), F.greatest(a["upto"], s["stop"]).alias("upto"))
    items = F.array_sort(F.array_distinct(F.transform("stretches", lambda s: s["item"])))
    return found.select("id", "n_words", F.aggregate("stretches", start, step)["n"].alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("stretches") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))
