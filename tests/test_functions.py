import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bundlespark.functions import actors, ids, paths, posix, trie, values
from bundlespark.operators import filters
from bundlespark.sources import inlines, markdown, yamlio


def column(spark, items, build, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}").orderBy("i").select(build(F.col("x"))).collect()]


def test_actors(spark):
    raw = ["human:ann", "process:etl", "tool/1/2", "human:", "/x", "x/", "plain", None, "Human:ann"]
    got = column(spark, raw, actors.parse)
    assert [g and g.kind for g in got] == ["human", "process", "producer", "unclassified", "unclassified", "unclassified", "unclassified", None, "unclassified"]
    assert (got[2].id, got[2].version) == ("tool", "1/2")
    assert column(spark, raw, lambda x: actors.render(actors.parse(x))) == raw


def test_concept_ids(spark):
    assert column(spark, ["a", "a/b.c-d", "_x/1", "-a", "a//b", "", ".a", "a/", "a b", "a\n"], ids.is_concept_id) == [True, True, True] + [False] * 7


def test_handles(spark):
    got = column(spark, ["IR-1", "A1-20", "IR-01", "IR-0", "1R-2", "IR", "IR-1 ", "X-" + "9" * 38, "X-" + "9" * 39], ids.handle)
    assert [g and (g.prefix, int(g.number)) for g in got] == [("IR", 1), ("A1", 20), None, None, None, None, None, ("X", int("9" * 38)), ("X", int("9" * 39))]


def test_dates_and_versions(spark):
    assert column(spark, ["2026-09-03", "2026-9-3", "2026-09-31", "x", None], ids.is_date) == [True, False, False, False, False]
    assert [ids.parse_version(x) for x in ("0.2", "1.10", "1", "1.2.3", "a.b", None)] == [(0, 2), (1, 10), None, None, None, None]
    assert ids.Gate("0.9").effective == (0, 2) and ids.Gate("1.0").not_understood and ids.Gate("x").unparseable and ids.Gate(None).effective is None


@pytest.mark.parametrize("raw,kind,path", [
    ("/a/b.md", "bundle", "a/b.md"), ("x.md#s", "bundle", "d/x.md"), ("../x.md?q", "bundle", "x.md"), ("../../x", "escape", None), ("https://e.org/x", "external", None),
    ("  ", "malformed", None), ("#top", "malformed", None), ("/", "malformed", None), (".", "bundle", "d"), ("s3://%ZZ", "bundle", "d/s3:/%ZZ"), ("\u3000/a.md\u3000", "bundle", "a.md")])
def test_classify(spark, raw, kind, path):
    got = column(spark, [raw], lambda x: paths.classify(F.lit("d/c.md"), x))[0]
    assert (got.kind, got.path) == (kind, path)


def reference_collapse(p):
    out = []
    for s in p.split("/"):
        if s == "..":
            if not out:
                return None
            out.pop()
        elif s not in ("", "."):
            out.append(s)
    return "/".join(out)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", ".", "..", ""]), max_size=6).map("/".join), min_size=1, max_size=20))
def test_collapse_law(spark, some):
    got = column(spark, some, paths.collapse)
    assert got == [reference_collapse(p) for p in some]


def test_scalar_text_and_presence(spark):
    fm = [json.dumps({"k": v}) for v in ("s", 12, 0.5, True, None, [], {}, ["a", 1, None])] + ["{}"]
    read = lambda build: [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(fm)], "i int, j string").withColumn("fm", F.parse_json("j")).orderBy("i").select(build).collect()]
    found = values.field_values(F.col("fm"), ("k",))
    assert read(F.size(found)) == [1, 1, 1, 1, 1, 0, 1, 3, 0]
    assert read(F.transform(found, values.scalar_text)) == [["s"], ["12"], ["0.5"], ["true"], [None], [], [None], ["a", "1", None], []]


def test_filter_grammar():
    assert filters.parse_equals("a.b=c=d") == filters.Filter("equals", ("a", "b"), "c=d")
    for bad in ("a", "=x", "a..b=1", "a.b.c=1", ".a=1"):
        with pytest.raises(filters.FilterError):
            filters.parse_equals(bad)
    assert filters.render(filters.present("a.b")) == "has a.b"


def test_yaml_spellings():
    fm, body = yamlio.parse("---\na: 2026-06-16T00:00:00Z\nb: 1:30\nc: 010\nd: yes\ne: true\nf: 12\ng: 0.50\nh: 123456789012345678901234567890\ni: ~\nj: '5'\n---\n\nText\n")
    assert json.loads(yamlio.to_json(fm)) == {"a": "2026-06-16T00:00:00Z", "b": "1:30", "c": "010", "d": "yes", "e": True, "f": 12, "g": 0.5, "h": 123456789012345678901234567890, "i": None, "j": "5"}
    assert '"g":0.50' in yamlio.to_json(fm) and body == "Text\n"
    assert yamlio.parse("no fence") == ({}, "no fence") and yamlio.parse("---\r\na: b\r\n---\r\n\r\nx") == ({"a": "b"}, "x")
    for bad in ("---\na: 1\n", "---\na: 1\na: 2\n---\n", "---\n- a\n---\n", "---\na: [\n---\n"):
        with pytest.raises(yamlio.DocumentError):
            yamlio.parse(bad)


_json = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=12), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(st.characters(codec="ascii", categories=["L", "N"]), min_size=1, max_size=6), c, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from(["type", "title", "tags", "zeta", "alpha", "status"]), _json, min_size=1, max_size=5))
def test_serialize_is_a_fixed_point(fm):
    text = yamlio.serialize(fm, "Body\n")
    again, body = yamlio.parse(text)
    assert again == fm and body == "Body\n" and yamlio.serialize(again, body) == text


def test_key_order():
    assert [line.split(":")[0] for line in yamlio.serialize({"zz": 1, "tags": ["a"], "type": "T", "aa": 2}, "").split("\n")[1:6]] == ["type", "tags", "- a", "aa", "zz"]


def test_links():
    body = "[a](x.md) `[b](y.md)` ![i](z.png) [c][ref] [d] <https://e.org> \\[e](f)\n\n    [code](no.md)\n\n```\n[f](no.md)\n```\n- item [g](<a b.md> \"t\")\n\n[ref]: r.md\n[d]: /d.md\n"
    assert markdown.links(body) == ["x.md", "r.md", "/d.md", "https://e.org", "a b.md"]


def test_computation_blocks_are_bounded():
    body = "```\nbefore\n```\n# Computation\n```sql\na\n```\n## Sub\n```\nb\n```\n# Next\n```\nc\n```\n"
    assert markdown.computation_blocks(body) == ["a\n", "b\n"]
    assert markdown.computation_blocks("Text\n") == []


def test_footnotes_outside_code():
    assert markdown.footnotes("A[^a] `[^b]` and [^c][^a].\n\n```\n[^d]\n```\n\n[^a]: note\n") == ["a", "c"]


def test_schema_columns():
    assert markdown.schema_columns("# Schema\n\ntext\n\n| Column | *Type* |\n|---|---|\n| a | b |\n") == ["Column", "Type"]
    assert markdown.schema_columns("# Schema\n\nnone\n") is None and markdown.schema_columns("| a |\n|---|\n") is None


def test_log():
    title, days = markdown.parse_log("# T\n\n## 2026-01-02\n\n* **Update**: did `x`\n* plain\n\n## bad\n")
    assert title == "T" and days == [("2026-01-02", [("Update", "did `x`"), (None, "plain")]), ("bad", [])]


def test_authoring(spark):
    from bundlespark.functions import authoring as a

    df = spark.createDataFrame([('{"type":"T","x":1,"n":null}',)], "j string").withColumn("fm", F.parse_json("j"))
    lit = F.lit
    made = df.select(
        F.to_json(a.set_key(F.col("fm"), "x", lit("y"))), F.to_json(a.remove_key(F.col("fm"), "x")), F.to_json(a.set_key(F.col("fm"), "x", lit(None).cast("string"))),
        F.to_json(a.set_key(F.col("fm"), "verified", F.array(a.event(lit("human:a"))))), F.to_json(a.set_key(F.col("fm"), "sources", F.array(a.source(lit("/r"), id=lit("s"), usage_count=lit(3), usage_window=a.window(lit("2024-01-01"), lit(None).cast("string"))))))).first()
    assert [json.loads(x) for x in made] == [
        {"type": "T", "x": "y", "n": None}, {"type": "T", "n": None}, {"type": "T", "n": None}, {"type": "T", "x": 1, "n": None, "verified": [{"by": "human:a"}]},
        {"type": "T", "x": 1, "n": None, "sources": [{"resource": "/r", "id": "s", "usage_count": 3, "usage_window": {"from": "2024-01-01"}}]}]
    common = df.select(F.to_json(a.common(lit("T"), lit("t"), lit(None).cast("string"), tags=F.array(lit("x"))))).first()[0]
    assert json.loads(common) == {"type": "T", "title": "t", "tags": ["x"]}


# -- inline Markdown --------------------------------------------------------------------


def shown(nodes):
    return "".join(n.text if n.kind == "text" else f"<{n.kind}{' ' + n.text if n.text else ''}>{shown(n.children)}</>" for n in nodes)


@pytest.mark.parametrize("text,tree", [
    ("[a [b](c.md)](d.md)", "[a <link c.md>b</>](d.md)"), ("![x [l](in.md)](i.png)", "<image i.png>x <link in.md>l</></>"), ("[![i](p.png)](q.md)", "<link q.md><image p.png>i</></>"),
    ("*a **b** c*", "<em>a <strong>b</> c</>"), ("***a** b*", "<em><strong>a</> b</>"), ("a*b*c_d_e", "a<em>b</>c_d_e"), ("**a*", "*<em>a</>"), ("foo***bar***baz", "foo<em><strong>bar</></>baz"), ("* a *", "* a *"), ("*foo**bar*", "<em>foo**bar</>"),
    ("*[z*](w.md)", "*<link w.md>z*</>"), ("**foo [*bar*](x) baz**", "<strong>foo <link x><em>bar</></> baz</>"), ("*a `*` b*", "<em>a <code *></> b</>"), ("`` ` ``", "<code `></>"),
    ("[a](<b c> 't')", "<link b c>a</>"), ("[a](b(c(d)e)f)", "<link b(c(d)e)f>a</>"), ("[a](b", "[a](b"), ("[a](b c)", "[a](b c)"), ("[x][Ref] [ref][] [REF] [no][nope]", "<link R>x</> <link R>ref</> <link R>REF</> [no][nope]"),
    ("[foo [ref]](z)", "[foo <link R>ref</>](z)"), ("[^n] \\[no](e) [^u](v)", "<note n></> [no](e) <link v>^u</>"), ("<a b='[n](o)'>[y](p)</a>", "<html <a b='[n](o)'>></><link p>y</><html </a>></>"),
    ("<https://h/x> <a@b.c>", "<link https://h/x>https://h/x</> <link mailto:a@b.c>a@b.c</>"), ("a&amp;b &nope; &", "a&b &nope; &")])
def test_inline_trees(text, tree):
    assert shown(inlines.parse(text, {"ref": "R"})) == tree


@pytest.mark.parametrize("text", ["[" * 100_000, "[a](b)" * 50_000, "[" * 50_000 + "]" * 50_000, "*a " * 50_000, "*a* " * 50_000, "**a *b " * 30_000, "[a](" * 50_000, "![" * 50_000 + "](x)" * 50_000, "<a b='" * 30_000, "_a__b___" * 20_000, "a**b" * 30_000 + "c* " * 30_000, "[*a" * 30_000 + "](x)" * 30_000])
def test_inline_markdown_in_linear_time(text):
    began = time.time()
    markdown.links(text)
    assert time.time() - began < 20


@given(st.text("ab *_[]()!`\\<>&\n", max_size=40))
@settings(max_examples=400, deadline=None)
def test_no_link_is_in_a_link(text):
    for x in inlines.walk(inlines.parse(text, {"a": "R"})):
        assert x.kind != "link" or not any(y.kind == "link" and not y.text.startswith("a:") for y in inlines.walk(x.children))
        assert x.kind != "text" or not x.children


@given(st.text("ab *_", max_size=30))
@settings(max_examples=400, deadline=None)
def test_emphasis_takes_marks_away_and_nothing_else(text):
    nodes = inlines.parse(text, {})
    marks = sum(2 if x.kind == "em" else 4 for x in inlines.walk(nodes) if x.kind in ("em", "strong"))
    said = inlines.plain(nodes)
    assert len(said) + marks == len(text) and [c for c in said if c not in "*_"] == [c for c in text if c not in "*_"]


# -- POSIX patterns, tries, runs ----------------------------------------------------------


@pytest.mark.parametrize("pattern,yes,no", [
    ("[[:digit:]]+", ["12", "0"], ["", "d", ":", "1a"]), ("[]a]", ["]", "a"], ["", "]a", "["]), ("[^]a]", ["b", "["], ["]", "a", "\n"]), ("[a&&b]", ["a", "b", "&"], ["&&", "c"]), ("[^[:space:]]", ["x", "\\"], [" ", "\t", "\n"]),
    ("a{2}b{1,}c{0,1}", ["aab", "aabbc"], ["ab", "aac", "aabcc"]), ("a|bc", ["a", "bc"], ["ac", "b"]), ("(a|ab)(c|bcd)", ["abcd", "ac", "abc"], ["abcdd"]), ("a.c", ["abc", "a.c"], ["a\nc", "ac"]),
    ("[a\\]", ["\\", "a"], [""]), ("\\d\\.", ["d."], ["1.", "dx"]), ("[a-c-]", ["-", "b"], ["d"]), ("[--/]", ["-", ".", "/"], [","]), ("[[.-.]x[=y=]]", ["-", "x", "y"], ["z"]), ("x{", ["x{"], ["x"]), ("a]b}", ["a]b}"], ["ab"]),
    ("^a$", ["a"], ["^a$"]), ("x\n^y", ["x\ny"], ["x^y"]), ("[[:upper:]é]+", ["AÉ".replace("É", "é")], ["a"]), ("\\<ab\\>.*", ["ab", "ab c"], ["abc"])])
def test_posix_patterns(spark, pattern, yes, no):
    got = column(spark, yes + no, lambda x: x.rlike(posix.whole(pattern)))
    assert got == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize("pattern", ["", "a||b", "(", ")", "(a", "*a", "a**", "a+?", "[a", "[[:nope:]]", "[z-a]", "a{3,2}", "a{999}", "\\", "[[.ab.]]", "(?=x)", "()", "a|"])
def test_what_is_not_posix(pattern):
    with pytest.raises(posix.PatternError):
        posix.to_java(pattern)


@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=5), st.integers(0, 99)), max_size=20), st.lists(st.lists(st.sampled_from("abcd"), max_size=7), max_size=10))
def test_tries_find_the_longest_prefix(held, asked):
    tree, plain = trie.RadixTrie(), {}
    for path, value in held:
        tree.put(tuple(path), str(value))
        plain[tuple(path)] = str(value)
    for path in asked:
        want = next((plain[tuple(path[:n])] for n in range(len(path), -1, -1) if tuple(path[:n]) in plain), None)
        assert tree.deepest(tuple(path)) == want


def test_runs(spark):
    lists = [["b", "a", "b", "c", "a", "b"], [], ["x"], ["z", "z"]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<string>")
    got = df.orderBy("i").select(F.transform(values.repeated(F.transform("x", lambda k, i: F.struct(k.alias("k"), i.alias("i")))), lambda run: F.struct(run[0]["k"].alias("k"), run["i"].alias("i"))).alias("r")).collect()
    assert [[(x.k, x.i) for x in r.r] for r in got] == [[("b", [0, 2, 5]), ("a", [1, 4])], [], [], [("z", [0, 1])]]
    began = time.time()
    long = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda n: F.struct((n % 50_000).alias("k"), n.alias("i"))).alias("x"))
    assert long.select(F.size(values.repeated(F.col("x")))).first()[0] == 50_000 and time.time() - began < 20


def test_numbers_of_any_length(spark):
    many = ["1", "9", "10", "19", "99", "8999", "9" * 60, "1" + "0" * 59, "4" + "9" * 70]
    assert column(spark, many, ids.successor) == [str(int(n) + 1) for n in many]
    df = spark.createDataFrame([(n,) for n in many], "n string")
    assert [r.n for r in df.orderBy(*ids.by_number(F.col("n"))).collect()] == sorted(many, key=int)
