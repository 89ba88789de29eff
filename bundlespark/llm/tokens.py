"""Token ids of whole texts as packed little-endian integers, and pieces of them.

The tokenizer lower-cases, drops white space and never merges across it, so a text's
ids are its words' ids one after another. Words are cut at ASCII blanks only (all of
which it drops) and looked up in a bounded memo; an unseen ASCII or Latin word goes
through the same normalisation and split and then straight to the merge model, any
other, and any that holds an added token, through the whole tokenizer.
"""

from __future__ import annotations

import struct
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words remembered in a worker process: twice so many, of which the older half goes.
MEMO = 200_000
#: Characters of the longest word remembered, so that MEMO bounds bytes too.
LONGEST = 64
#: The tokenizer's own pre-split, and the code points below which its
#: normal form composes nothing and lower-casing looks at one character at a time.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
_PLAIN = r"[\x20-\x7e¡-¬®-įı-ɏ]*"


class _Words(dict):
    """word -> its ids, ``width`` bytes each."""

    def __init__(self, path: str, width: int):
        super().__init__()
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merged, self.code = self.tokenizer.model.tokenize, "I" if width == 4 else "H"
        self.find, self.plain = regex.compile(_SPLIT).findall, regex.compile(_PLAIN).fullmatch
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, added)) or r"(?!)", regex.IGNORECASE).search
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.older: dict[str, bytes] = {}
        self.letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, word: str) -> bytes:
        if (out := self.older.get(word)) is None:
            if not self.plain(word) or self.added(word):
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
                out = struct.pack(f"<{len(ids)}{self.code}", *ids)
            elif word.isalpha():
                out = self.letters(low) if (low := word.lower()) == word else self[low]
            elif word[:-1].isalpha() and word[-1] in ".,;:!?":
                out = self[word[:-1]] + self[word[-1]]
            else:
                parts = self.find(word.lower())
                out = self.letters(word) if parts == [word] else b"".join([self[p] for p in parts])
        if len(word) <= LONGEST:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out

    def letters(self, part: str) -> bytes:
        """The ids of one part of the split."""
        if not part.isascii():
            part = "".join([self.letter[b] for b in part.encode()])
        ids = [t.id for t in self.merged(part)]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)


@lru_cache(4)
def _words(path: str, width: int) -> _Words:
    return _Words(path, width)


def encode(text: str | None, path: str, width: int = 4) -> bytes:
    """The ids of ``text`` (null: none), little-endian, ``width`` bytes each (2 or 4)."""
    return b"".join(map(_words(path, width).__getitem__, (text or "").replace("\n", " ").replace("\t", " ").split(" ")))


def pieces(docs: DataFrame, path: str, size: int, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """A row for each piece of at most ``size`` ids of each text's ids followed by a 0.

    Columns: doc_id, piece (from 0), start, length, ids_crc32 (of the ids as unsigned
    32-bit), and with ``ids`` the ids themselves as little-endian unsigned 16-bit, which
    the tokenizer's vocabulary must fit. Only texts of more than ``size`` ids are cut;
    none is empty, because of the final 0, so null and empty texts give one piece of one.
    """
    def work(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        width = 2 if ids else 4
        for batch in batches:
            rows, held = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flat = encode(text.as_py(), path, width) + bytes(width)
                for piece, at in enumerate(range(0, len(flat), size * width)):
                    part = flat[at:at + size * width]
                    crc = zlib.crc32(np.frombuffer(part, "<u2").astype("<u4").tobytes() if ids else part)
                    rows.append((key, piece, at // width, len(part) // width, crc, *([part] if ids else [])))
                held += len(flat) if ids else 0
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    import pyarrow as pa

    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * ids
    names, schema = [k for k, _ in kinds], pa.schema(kinds)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        work, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)
