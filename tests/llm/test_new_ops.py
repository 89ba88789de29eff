"""Decontamination, vector codes and spelling variants against brute force."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bundlespark.llm import decontamination as dec
from bundlespark.llm import queries, variants, vectorcodes

DOCS = "doc_id long, text string"


def clashing(df):
    for name in ("ID", "key", "segment", "ids", "n", "v", "code", "word", "run", "crc", "near", "block", "item", "one"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_vector_codes", "op13_spelling_variants"])
def test_same_as_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    ran = db.execute(queries.ORACLE_SQL[name])
    have = [c[0] for c in ran.description]
    assert sorted(have) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in have) for r in got.collect()))) == sorted(map(repr, ran.fetchall()))


# -- decontamination ------------------------------------------------------------------

R = random.Random(11)
VOCAB = ["w%d" % i for i in range(30)] + ["é", "ÀB", "日本", "x" * 80, "7"]
ITEMS = [(str(i), " ".join(R.choice(VOCAB) for _ in range(n))) for i, n in enumerate([25, 10, 9, 3, 1, 12, 40, 11])]
ITEMS += [("0", ITEMS[1][1]), (None, "alone " * 12), ("none", None), ("blank", " .,; "), ("short", "unheard of")]


def noise(n):
    return [R.choice(VOCAB) for _ in range(n)]


def planted():
    rows = []
    for i in range(60):
        words = noise(R.randint(0, 60))
        for _ in range(R.randint(0, 3)):
            item = (R.choice(ITEMS)[1] or "").split()
            a = R.randint(0, max(0, len(item) - 2))
            piece = item[a:a + R.randint(1, 30)]
            if R.random() < 0.4:
                R.shuffle(piece)
            at = R.randint(0, len(words))
            words[at:at] = piece
        rows.append((i, R.choice([" ", ", ", "\n"]).join(words)))
    return rows + [(100, None), (101, ""), (102, "..."), (None, ITEMS[6][1].upper()), (7, ITEMS[0][1]), (7, ITEMS[0][1]), (103, " ".join(noise(30_000)) + " " + ITEMS[6][1] + " " + " ".join(noise(100)))]


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, span):
    out, cut = [], [(i or "", terms(t)) for i, t in items]
    windows = {(i, tuple(w[j:j + min(10, len(w))])) for i, w in cut if w for j in range(len(w) - min(10, len(w)) + 1)}
    by_text = collections.defaultdict(set)
    for i, w in windows:
        by_text[w].add(i)
    for key, text in docs:
        words, hit, found, near = terms(text), set(), set(), set()
        for size in {len(w) for w in by_text}:
            for p in range(len(words) - size + 1):
                if (w := tuple(words[p:p + size])) in by_text:
                    hit.update(range(p, p + size))
                    found |= by_text[w]
        if span:
            spans = [set(words[p:p + span]) for p in range(max(1, len(words) - span + 1))]
            for w, names in by_text.items():
                if not names <= near and any(s.issuperset(w) for s in spans):
                    near |= names
        out.append((key, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(near)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_contamination(spark, monkeypatch, small):
    """Also with segments of a few hundred bytes, pieces of a dozen words, blocks of two pieces and few postings at a time."""
    rows = planted()
    if small:
        for name, value in (("SEGMENT_BYTES", 300), ("PIECE_WORDS", 12), ("BLOCK_PIECES", 9), ("AT_ONCE", 7)):
            monkeypatch.setattr(dec, name, value)
        rows = [r for r in rows if r[0] != 103]
    docs, items = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(ITEMS, "item_id string, text string").repartition(2)
    got = dec.contamination(clashing(docs), clashing(items))
    assert got.columns == ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"]
    want = brute(rows, ITEMS, 20)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert any(w[2] and w[6] > w[3] for w in want) and any(not w[2] for w in want)


def test_stretches_and_other_spans(spark):
    docs = [(1, "zero " + ITEMS[6][1] + " end"), (2, " ".join(reversed(ITEMS[1][1].split())))]
    index = dec.index(spark.createDataFrame(docs, DOCS))
    found = {r["id"]: r for r in dec.matches(index, spark.createDataFrame(ITEMS, "item_id string, text string"), span=10).collect()}
    covered = {p for s in found[1]["stretches"] if s["item"] == "6" for p in range(s["start"], s["stop"])}
    assert covered == set(range(1, 41)) and {s["item"] for s in found[2]["stretches"]} <= {"2", "3", "4"} and "1" in found[2]["near"]
    none = dec.matches(index, spark.createDataFrame(ITEMS, "item_id string, text string"), span=0).collect()
    assert all(not r["near"] for r in none)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame([(1, "a b c"), (None, None)], DOCS)
    assert dec.contamination(docs, items).collect() == []
    assert sorted((r["n_words"], r["contaminated"]) for r in dec.contamination(some, items).collect()) == [(0, False), (3, False)]


def test_index_holds_every_word_and_shuffles_nothing(spark):
    texts = [" ".join(noise(200)) for _ in range(20)]
    row = dec.index(spark.createDataFrame(list(enumerate(texts)), DOCS).coalesce(1)).collect()
    assert sum(sum(r["counts"]) for r in row) == 20 * 200
    places = dec._from_planes(row[0]["postings"])
    assert len(places) == 20 * 200
    plan = dec.matches(dec.index(spark.createDataFrame(list(enumerate(texts)), DOCS)), spark.createDataFrame(ITEMS, "item_id string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# -- vector codes -----------------------------------------------------------------------


def coded(rows, width):
    """(id, label, code, error) by comparing everything with everything."""
    held = [(i, [min(max(int(np.floor(1024.0 * x)), -vectorcodes.LIMIT), vectorcodes.LIMIT) for x in v], lab) for i, v, lab in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    first = [v for _, v, _ in sorted(held, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]]
    parts = np.array_split(np.arange(width), 4)
    books, x = [np.array([[v[k] for k in p] for v in first], dtype=object) for p in parts], np.array([v for _, v, _ in held], dtype=object)

    def assign(p):
        d = ((x[:, None, parts[p]] - books[p][None]) ** 2).sum(2) if len(parts[p]) else np.zeros((len(x), len(first)), dtype=object)
        return [min(range(len(first)), key=lambda e: (row[e], e)) for row in d], [min(row) for row in d]

    for _ in range(4):
        for p in range(4):
            code, _ = assign(p)
            for e in set(code):
                mine = [x[i, parts[p]] for i in range(len(x)) if code[i] == e]
                books[p][e] = [int(sum(c)) // len(mine) for c in zip(*mine, strict=True)] if len(parts[p]) else books[p][e]
    final = [assign(p) for p in range(4)]
    error = [sum(int(final[p][1][i]) for p in range(4)) for i in range(len(held))]
    total = collections.Counter()
    for (_, _, lab), e in zip(held, error, strict=True):
        total[lab] += e
    sha = hashlib.sha256(",".join(str(int(c)) for b in books for r in b for c in r).encode()).hexdigest()
    return sorted(((i, "".join("%02x" % final[p][0][k] for p in range(4)), error[k], min(total[lab], (1 << 63) - 1), sha) for k, (i, _, lab) in enumerate(held)), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, width, seed, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((max(1, n // 40), width))
    x = (centres[r.integers(0, len(centres), n)] + 0.3 * r.standard_normal((n, width))) * spread
    return [(int(i), [float(np.float32(c)) for c in v], int(r.integers(0, 4)) if i % 7 else None) for i, v in zip(r.permutation(n), x, strict=True)]


ODD = [(-5, None, 1), (-4, [], 1), (-3, [1.0, None] * 4, 1), (-2, [float("nan")] * 8, None), (-1, [float("inf")] * 8, 2), (-6, [1.0, 2.0], 3), (None, [0.5] * 8, None), (3, [0.25] * 8, 1), (3, [0.25] * 8, 1), (900, [3e38, -3e38] * 4, 3), (901, [0.0] * 8, 3)]


@pytest.mark.parametrize("rows,width", [(vectors(700, 8, 1) + ODD, 8), (vectors(120, 8, 2) + ODD, 8), (vectors(400, 10, 3), 10), (vectors(300, 3, 4), 3), (vectors(500, 16, 5, 1e-3), 16), ([(i, [1.0, -1.0, 0.5, 0.25], 1) for i in range(400)], 4)],
                         ids=["odd", "few", "uneven", "narrow", "ties", "equal"])
def test_vector_codes(spark, rows, width):
    got = vectorcodes.encode(clashing(spark.createDataFrame(rows, VECTORS).repartition(5)))
    assert got.columns == ["id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == coded(rows, width)


def test_no_vectors(spark):
    assert vectorcodes.encode(spark.createDataFrame([], VECTORS)).collect() == []
    assert vectorcodes.encode(spark.createDataFrame(ODD[:2], VECTORS)).collect() == []


def test_bounds_hold_the_nearest_and_leave_most_out():
    r = np.random.default_rng(9)
    for scale in (40, 1000, 1 << 24):
        book, x = r.integers(-scale, scale, (256, 16)), r.integers(-scale, scale, (500, 16))
        cells = vectorcodes.Cells(book)
        row, entry = cells.candidates(x)
        square = ((x[:, None].astype(object) - book[None]) ** 2).sum(2)
        code, least = cells.nearest(x)
        assert code.tolist() == [min(range(256), key=lambda e: (s[e], e)) for s in square] and least.tolist() == [min(s) for s in square]
        assert len(row) < 0.5 * square.size


# -- spelling variants ------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def grouped(docs, altered):
    count = collections.Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            count[run[:h % len(run)] + run[h % len(run) + 1:] if altered and h % altered == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    others = {w: sorted((-n[o], o) for o in n if o != w and abs(len(o) - len(w)) < 2 and near(o, w)) for w in n}
    form = {w: others[w][0][1] if others[w] and -others[w][0][0] >= 5 * n[w] else None for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n[w], len(others[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


def typed():
    r = random.Random(13)
    bases = ["station", "aaaaaaa", "abababab", "façades", "ÀÉÎÕÜß", "letters"] + ["".join(r.choice("abcdeé") for _ in range(r.randint(6, 9))) for _ in range(25)]
    bag = []
    for b in bases:
        for size in (700, 120, 20, 5, 5, 5, 4):
            w = list(b)
            for _ in range(r.randint(0, 2) if size < 700 else 0):
                at = r.randrange(len(w))
                w[at:at + r.randint(0, 1)] = r.choice(["", "b", "é", w[at]])
            bag += ["".join(w)] * size
    bag += ["planets"] * 250 + ["planetts"] * 40 + ["planettts"] * 6
    r.shuffle(bag)
    rows = [(i, r.choice([" ", "-", "1"]).join(bag[i * 40:i * 40 + 40])) for i in range(len(bag) // 40 + 1)]
    long = "".join(r.choice("abcxyz") for _ in range(3000))
    return rows + [(None, "Station STATION station stations"), (5, None), (6, ""), (7, "short only"), (8, (long + " ") * 30), (9, (long[:50] + long[51:] + " ") * 6), (10, (long[:70] + "q" + long[71:] + " ") * 5), (11, "station " * 3)]


@pytest.mark.parametrize("altered,at_once,collide", [(199, 1 << 20, False), (3, 50, False), (None, 1 << 20, True)])
def test_variants(spark, monkeypatch, altered, at_once, collide):
    """Also with few code points at a time, and with hashes so short that most keys collide."""
    monkeypatch.setattr(variants, "AT_ONCE", at_once)
    if collide:
        plain = variants.keys_of
        monkeypatch.setattr(variants, "_keys", _colliding(plain))
    rows = typed()
    got = variants.group(clashing(spark.createDataFrame(rows, DOCS).repartition(3)), altered=altered)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = grouped(rows, altered)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert altered == 3 or any(w[2] not in (w[0], w[1]) for w in want)  # a chain of forms


def _colliding(plain):
    def keys(batches):
        import pyarrow as pa

        for batch in batches:
            word, place, first, key = plain(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(key % 40), pa.array(place), pa.array(first), pa.array(batch.column("id").to_numpy()[word])], ["key", "place", "first", "id"])

    return keys


def test_keys_are_hashes_of_what_is_left():
    words = ["abcabc", "aaaaaa", "x", "日本語日本語", "bcabcé" * 50]
    word, place, first, key = variants.keys_of(words)
    own = {}
    for w, p, f, k in zip(word.tolist(), place.tolist(), first.tolist(), key.tolist(), strict=True):
        left = words[w] if p < 0 else words[w][:p] + words[w][p + 1:]
        assert own.setdefault(left, k) == k and f == (p >= 0 and (p == 0 or words[w][p] != words[w][p - 1]))
    assert len(set(own.values())) == len(own)


def test_no_words(spark):
    assert variants.group(spark.createDataFrame([], DOCS)).collect() == []
    assert variants.group(spark.createDataFrame([(1, None), (2, "a b c")], DOCS)).collect() == []
