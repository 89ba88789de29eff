"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode.

The greedy encoding of a string ends in one token t such that what precedes t is
encoded on its own, and a token may follow another exactly if the two, written
together, are encoded as those two. So the encodings of all prefixes that a later token
could still start after are paths that only differ near their ends. A state of the
transducer holds, for the bytes read, those live paths without the tokens they share;
shared tokens are emitted at once, so a token leaves after the lookahead that the
longest vocabulary entry bounds. States and transitions are made when first needed and
forgotten when there are too many.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Transitions remembered in a worker process; all are forgotten beyond that.
TRANSITIONS = 400_000
#: Words remembered in a worker process: twice so many, of which the older half goes.
MEMO = 300_000
#: Characters of the longest word remembered, so that MEMO bounds bytes too.
LONGEST = 64
#: Ids decoded at a time.
_CHUNK = 65_536

Path = tuple[int, ...]


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class _State(dict):
    """byte -> (the state after it, the tokens emitted); moves are made when first asked for.

    key: (bytes that the longest live path lacks, ((how many of them, path) longest first), token emitted last).
    """

    __slots__ = ("key",)


class Transducer:
    """Encodes one pre-split piece at a time by merging the pair of lowest rank first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.token = ranks, {i: t for t, i in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.follows: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        #: The keys of the states, the states, and the states by their keys.
        self.states, self.moves, self.numbers = [], [], {}
        self._forget()

    def _forget(self) -> None:
        for state in self.moves:
            state.clear()  # states lead to each other
        for made in (self.states, self.moves, self.numbers):
            made.clear()
        self.start, self.made = self._state((b"", ((0, ()),), -1)), 0
        if len(self.follows) > TRANSITIONS:
            self.follows.clear()

    def _state(self, key) -> _State:
        if (state := self.numbers.get(key)) is None:
            state = self.numbers[key] = _State()
            state.key = key
            self.states.append(key)
            self.moves.append(state)
        return state

    def _merged(self, data: bytes) -> list[bytes]:
        get, none = self.ranks.get, 1 << 60
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = [get(data[i:i + 2], none) for i in range(len(data) - 1)]
        while ranks and (rank := min(ranks)) < none:
            at = ranks.index(rank)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], none)
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        key = (a, b)
        if (may := self.follows.get(key)) is None:
            x, y = self.token[a], self.token[b]
            one = self.ranks.get(x + y)
            may = self.follows[key] = not (one is not None and self._is_whole(one)) and self._merged(x + y) == [x, y]
        return may

    def _is_whole(self, t: int) -> bool:
        if (whole := self.whole.get(t)) is None:
            whole = self.whole[t] = len(self._merged(self.token[t])) == 1
        return whole

    def _move(self, state: _State, byte: int) -> tuple[_State, Path]:
        if self.made > TRANSITIONS:  # also within a piece, however long it is
            here = state.key
            self._forget()
            state = self._state(here)
        seen, live, last = state.key
        seen += bytes((byte,))
        end, get, prefixes = len(seen) - 1, self.ranks.get, self.prefixes
        new, paths = None, []
        for k, path in live:
            tail = seen[end - k:]
            if new is None and (t := get(tail)) is not None and self._is_whole(t):
                before = path[-1] if path else last
                if before < 0 or self._may_follow(before, t):
                    new = (*path, t)
            if tail in prefixes:
                paths.append((k + 1, path))
        paths.append((0, new))
        shared, out = 0, paths[0][1]
        if len(paths) == 1:
            shared = len(out)
        else:
            while len(out) > shared and all([len(p) > shared and p[shared] == out[shared] for _, p in paths]):
                shared += 1
        if shared:
            out = out[:shared]
            paths, last = [(k, p[shared:]) for k, p in paths], out[-1]
        else:
            out = ()
        keep = paths[0][0]
        key = (seen[end + 1 - keep:] if keep else b"", tuple(paths), last if any([not p for _, p in paths]) else -2)
        self.made += 1
        move = state[byte] = (self._state(key), out)
        return move

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token is that token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        state, out = self.start, []
        for byte in piece:
            try:
                state, got = state[byte]
            except KeyError:
                state, got = self._move(state, byte)
            if got:
                out += got
        return [*out, *state.key[1][-1][1]]


class _Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers.

    Full, it becomes the older half: pieces found there come back, the others are forgotten with it.
    """

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.encode, self.older = transducer.encode, {}

    def __missing__(self, piece: str) -> bytes:
        if (out := self.older.get(piece)) is None:
            ids = self.encode(piece.encode("utf-8", "surrogateescape"))
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


@lru_cache(2)
def _coder(path: str, pattern: str):
    import regex

    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return regex.compile(pattern).findall, _Pieces(Transducer(ranks)), table


class Utf8Stream:
    """Decodes chunks of bytes to text as they come; an unfinished character waits for the next chunk.

    A state is the bytes of the unfinished character, at most three; bytes that cannot
    be UTF-8 come out as lone surrogates (surrogateescape), so nothing is lost.
    """

    def __init__(self):
        self.waiting = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that more bytes could finish."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if 0x80 <= b < 0xC0:
                continue
            needs = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 1
            return back if needs > back else 0
        return 0

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.waiting + data
        cut = len(data) if last else len(data) - self._unfinished(data)
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "surrogateescape")


def encode_text(text: str | None, path: str, pattern: str) -> bytes:
    """The ids of a whole text (null: none) as little-endian unsigned 32-bit integers."""
    find, pieces, _ = _coder(path, pattern)
    return b"".join(map(pieces.__getitem__, find(text or "")))


def decode_ids(ids: bytes, path: str, pattern: str):
    """The text of ids as ``encode_text`` gives them, in chunks."""
    import numpy as np

    _, _, table = _coder(path, pattern)
    flat, stream = np.frombuffer(ids, "<u4"), Utf8Stream()
    for i in range(0, len(flat), _CHUNK):
        yield stream.feed(b"".join(map(table.__getitem__, flat[i:i + _CHUNK].tolist())))
    yield stream.feed(b"", last=True)


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, whole texts; ids as an array of long.

    With ``digests`` also ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 (of the bytes that decoding them gives). Null and empty
    texts have no ids. Rows are independent of each other, so repeated rows come back
    alike, in a map over the input without any shuffle; other columns are ignored.
    """
    names = ["doc_id", "n_tokens"] + ["ids"] * ids + ["ids_sha256", "decoded_sha256"] * digests
    kinds = {"doc_id": "long", "n_tokens": "long", "ids": "array<long>", "ids_sha256": "string", "decoded_sha256": "string"}

    def work(batches):
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        types = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int64()), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        for batch in batches:
            out = {n: [] for n in names}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flat = encode_text(text.as_py(), path, pattern)
                out["doc_id"].append(key)
                out["n_tokens"].append(len(flat) // 4)
                if ids:
                    out["ids"].append(np.frombuffer(flat, "<u4").astype(np.int64))
                if digests:
                    out["ids_sha256"].append(sha256(flat).hexdigest())
                    back = sha256()
                    for part in decode_ids(flat, path, pattern):
                        back.update(part.encode("utf-8", "surrogateescape"))
                    out["decoded_sha256"].append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(out[n], types[n]) for n in names], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, ", ".join(f"{n} {kinds[n]}" for n in names))


def decode(coded: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of a table of ids; bytes that are not UTF-8 come out as U+FFFD. Null ids: null text."""
    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = [None if x is None else "".join(decode_ids(np.asarray(x, "<u4").tobytes(), path, pattern)).encode("utf-8", "surrogateescape").decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<long>")).mapInArrow(work, "doc_id long, text string")
