"""Licence scans with a positional index of rare tokens.

A file holds a template if in some stretch of it, INSERTED words longer than the
template at most, at least COVERAGE of the template's words stand in the template's
order, and all of its key phrases stand there word for word. So words may be left out,
put in or replaced.

Of each template the places of its rarest words in the corpus are indexed, one more than
such a stretch may lack: whatever matches has one of them in place, however frequent
those words are. Each occurrence of an indexed word tells, by its relative position,
where the stretch may begin; where the key phrases stand narrows that down, and what is
left is aligned word by word. Word frequencies order the index only; what is found does
not depend on them, nor on what else a file holds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Label -> the phrase whose places are counted.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Label -> (notice as it stands in files, phrases that must stand in it).
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    "apache-2.0-notice": ("you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4 0",)),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    "lgpl-2.1": ("licensed under the gnu lesser general public license version 2 1", ("lesser general public license", "version 2 1")),
    "mit": ("released under the mit license", ("mit license",)),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("apache license version 2 0", "without warranties or conditions of any kind")),
    "bsd-2-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
        "even if advised of the possibility of such damage",
        ("redistributions of source code must retain", "redistributions in binary form must reproduce")),
    "bsd-3-clause": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("neither the name of", "to endorse or promote products derived from this software")),
    "boost-1.0": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so",
        ("accompanying documentation covered by this license", "prepare derivative works of the software")),
    "gpl-header": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ("under the terms of the gnu general public license", "published by the free software foundation")),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee", "appear in all copies")),
    "lgpl-header": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version of the license or at your option any later version "
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        ("under the terms of the gnu lesser general public license", "published by the free software foundation")),
    "mit-full": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ("permission is hereby granted", "shall be included in all copies or substantial portions of the software")),
    "mpl-2.0-header": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ("mozilla public license",)),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software", "released into the public domain")),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ("to alter it and redistribute it freely",)),
}
#: The share of a template's words that must stand in order.
COVERAGE = 0.8
#: Words by which a stretch may be longer than its template: this share of it, and so many at least.
INSERTED, LEAST_INSERTED = 0.1, 1

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII characters other than letters and digits."""
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where ``phrase`` stands in ``words``, overlapping places included."""
    found, at = [], -1
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at:at + len(phrase)] == phrase:
                found.append(at)
    except ValueError:
        return found


def stretch(n: int) -> int:
    """How long a stretch for a template of ``n`` words may be."""
    return n + max(LEAST_INSERTED, int(INSERTED * n))


def may_lack(n: int) -> int:
    """How many of a template's ``n`` words a match may lack."""
    return max(m for m in range(n) if (n - m) / n >= COVERAGE)


class Index:
    """Postings of each template's rarest words, enough of them that no match is without one."""

    def __init__(self, templates: dict[str, tuple[str, tuple[str, ...]]], documents: int, having: dict[bytes, int]):
        self.words = {label: text.encode().split() for label, (text, _) in templates.items()}
        self.keys = {label: [k.encode().split() for k in keys] for label, (_, keys) in templates.items()}
        self.idf = {w: math.log((documents + 1) / (having.get(w, 0) + 1)) for words in self.words.values() for w in words}
        self.needed = {label: frozenset(w for k in keys for w in k) for label, keys in self.keys.items()}
        self.postings: dict[bytes, list[tuple[str, int]]] = {}
        self.bits: dict[str, dict[bytes, int]] = {}
        for label, words in self.words.items():
            for at in sorted(range(len(words)), key=lambda i: (-self.idf[words[i]], words[i], i))[:may_lack(len(words)) + 1]:
                self.postings.setdefault(words[at], []).append((label, at))
            bits = self.bits.setdefault(label, {})
            for i, w in enumerate(words):
                bits[w] = bits.get(w, 0) | 1 << i

    def aligned(self, label: str, words: list[bytes]) -> int:
        """The most words of the template that stand in ``words`` in its order: a common subsequence, a bit a word."""
        bits, full = self.bits[label], (1 << len(self.words[label])) - 1
        row = full
        for w in words:
            if m := bits.get(w):
                row = (row + (row & m) | row & ~m) & full
        return (full ^ row).bit_count()

    def find(self, words: list[bytes]) -> dict[str, float]:
        """label -> the largest share of its words that stand in order, of the templates that the file holds."""
        present = self.idf.keys() & words
        open_to = {label for label, needed in self.needed.items() if needed <= present}
        found: dict[str, float] = {}
        if not open_to:
            return found
        at: dict[str, list[tuple[int, int]]] = {}
        for word in present & self.postings.keys():
            posted = [(label, place) for label, place in self.postings[word] if label in open_to]
            if posted:
                here = places(words, [word])
                for label, place in posted:
                    n = len(self.words[label])
                    at.setdefault(label, []).extend((x - place - may_lack(n) - stretch(n) + n, x - place + may_lack(n)) for x in here)
        for label, ranges in at.items():
            if share := self._best(label, words, _joined(ranges)):
                found[label] = share
        return found

    def _best(self, label: str, words: list[bytes], ranges: list[tuple[int, int]]) -> float:
        n = len(self.words[label])
        long, least = stretch(n), n - may_lack(n)
        for key in self.keys[label]:
            ranges = _both(ranges, _joined([(x + len(key) - long, x) for x in places(words, key)]))
        most = 0
        for low, high in ranges:
            # All that begins here together first; only if that has words enough, each place.
            low, step = max(low, 1 - long), max(1, high - low + 1)
            for start in range(low, high + 1, step := min(step, long)):
                end = min(high, start + step - 1)
                if self.aligned(label, words[max(0, start):end + long]) >= max(least, most + 1):
                    most = max([most, *(self.aligned(label, words[max(0, s):s + long]) for s in range(start, end + 1))])
        return most / n if most >= least else 0.0


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges, both ends included, as few as possible and in order."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _both(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What lies in a range of ``a`` and in one of ``b``, each in order."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        low, high = max(a[i][0], b[j][0]), min(a[i][1], b[j][1])
        if low <= high:
            out.append((low, high))
        if a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return out


def having(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """(documents, word -> documents that have it) over all of ``docs``: counts of the vocabulary only."""
    def work(batches):
        import pyarrow as pa

        n, counts = 0, dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in batch.column(0):
                n += 1
                for w in vocabulary.intersection(words_of(text.as_py())):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *counts], pa.binary()), pa.array([n, *counts.values()], pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r.word): r.n for r in rows}
    return counts.pop(b"", 0), counts


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates=TEMPLATES) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of the phrases, first_word and last_word are the smallest
    and largest start of one (null: none). labels holds base_labels and those of the
    templates found. score is the largest share of a found template's words in order; 0.5
    if there are phrases only; else 0. Null and empty texts have no words; a row's result
    depends on its text alone.
    """
    vocabulary = {w.encode() for text, _ in templates.values() for w in text.split()}
    index = Index(templates, *having(docs, vocabulary, text_col))
    wanted = {label: phrase.encode().split() for label, phrase in phrases.items()}
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def work(batches):
        import pyarrow as pa

        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                found = {label: at for label, phrase in wanted.items() if (at := places(words, phrase))}
                every = [x for at in found.values() for x in at]
                more = index.find(words)
                rows.append((key, len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(found)), ",".join(sorted({*found, *more})), max(more.values(), default=0.5 if found else 0.0)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        work, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
