"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from patterns. Those of the four base kinds that pass their checks are
always reported. Every candidate, of these and of further kinds, gets votes: of its
strict pattern, of gazetteers (issuers' prefixes, top-level domains, words of code and
markup), of the words before it, and of its characters. Expectation-maximisation over
the counts of vote patterns (at most a few thousand, whatever the corpus) estimates how
reliable each labeler is for each kind; a logistic span classifier is trained on the
resulting labels and becomes a column expression that accepts candidates of the further
kinds. Work is in proportion to the text: arrays of spans are built in blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: The kinds in their order and what matches them. Written with possessive
#: repeats and look-behinds where those match the same, so that none backtracks over a
#: long run of text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to have any of a kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Further kinds: candidates that the classifier decides on.
FURTHER = {
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = [*BASE, *FURTHER]
#: Patterns so strict that hardly anything else has their form.
STRICT = r"^(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z]{4}[0-9]{6,}|[^@]+@[^@]+\.[A-Za-z]{2,}|\+[0-9 ().-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{16}|[0-9]{4}(?:[ -][0-9]{4}){3})$"
#: Gazetteers, a kind each: what issuers and registries give out, and what they don't.
KNOWN = {
    "email": (r"(?i)\.(?:com|org|net|edu|gov|mil|int|info|biz|io|dev|app|eu|de|fr|es|uk|it|nl|be|ch|at|pl|se|no|dk|fi|pt|ie|us|ca|mx|br|jp|cn|in|au|nz)$", r"(?i)\.(?:png|jpe?g|gif|svg|js|css|py|html?|local|invalid|[0-9]+)$"),
    "ip": (r"^0*(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.", r"^(?:0+|0*127|0*22[4-9]|0*2[34][0-9]|0*25[0-5])\."),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[4-8]|6011|64|65|62|50|67)", r"^(?:0|1|7|8|9)"),
    "phone": (r"^\+(?:1|7|2[07]|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", r"^\+(?:0|80|83|89|99)"),
    "account": (r"^(?:AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR)", r"^(?:ISO|RFC|UTF|SHA|XX|ZZ|QQ)"),
    "secret": (r"^(?:AKIA|ASIA|gh[pousr]_|glpat-|sk-|sk_live|rk_live|pk_live|xox[abp]-|eyJ|AIza|ya29|npm_|SG\.)", r"(?i)(?:lorem|http|html|style|class|width|color|function|return|example_)"),
    "ssn": (r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", r"^(?:000|666|9)|-00-|-0000$"),
}
#: Words before a candidate that speak for and against it.
FOR = r"(?i)(?:token|key|secret|passw|pwd|api|ssn|social|account|iban|card|phone|tel|call|e-?mail|contact|ip|address)[\x20:=\"'#-]*$"
AGAINST = r"(?i)(?:commit|sha1|sha256|md5|isbn|version|build|page|http\S*|href|src|id)[\x20:=\"'#/-]*$"
#: Characters before a candidate that are looked at.
CONTEXT = 24
#: Elements that are gathered before they are put to the rest: bounds the copying in long arrays.
RUN = 256
#: Code points in a piece of a text that spans are cut from.
PIECE = 1024
#: The classifier's probability from which a candidate is reported.
ACCEPT = 0.5
VOTES = ("strict", "known", "before", "mixed")


def _let(x: Column, body) -> Column:
    """``body`` of ``x``, which is evaluated once."""
    return F.transform(F.array(x), body)[0]


def _scan(xs: Column, at: Column, step, kind: str) -> Column:
    """An array<``kind``>: ``step(state, x)`` gives the next state and what to put out, from ``at`` and from left to right.

    Growing an array copies it, so RUN elements at a time grow one of their own.
    """
    empty = F.expr(f"cast(array() as array<{kind}>)")

    def one(acc, x):
        then, out = step(acc["at"], x)
        return F.struct(then.alias("at"), F.concat(acc["out"], out).alias("out"))

    def run(acc, some):
        return F.aggregate(some, F.struct(acc["at"].alias("at"), empty.alias("out")), one, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def whole(p):
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(p)), F.lit(RUN)), lambda i: F.slice(p, i, F.lit(RUN)))
        return F.aggregate(runs, F.struct(at.alias("at"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out")), run, lambda acc: F.flatten(acc["out"]))

    return _let(xs, whole)


def _spans(text: Column, pattern: str, needs: str | None) -> Column:
    """array<struct<start, end, match, before>> of the leftmost non-overlapping matches; code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = _let(found, lambda f: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(f)), f, lambda c, m: F.struct(F.length(c).alias("gap"), F.right(c, F.lit(CONTEXT)).alias("before"), m.alias("match"))))
    kind = "struct<start:int,end:int,match:string,before:string>"

    def step(at, x):
        start = at + x["gap"]
        end = start + F.length(x["match"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), x["before"].alias("before")))

    out = _scan(pairs, F.lit(0), step, kind)
    return out if needs is None else F.when(text.rlike(needs), out).otherwise(F.expr(f"cast(array() as array<{kind}>)"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def digit(i):
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        n = F.length(_digits(m))
        return (n >= 8) & (n <= 15)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, x: Column) -> Column:
    m, before = x["match"], x["before"]
    mixed = F.length(F.regexp_replace(m, "[0-9]", "")) * 4 <= F.length(m) * 3
    return F.struct(
        _vote(m.rlike(STRICT), m.rlike("^[A-Za-z_-]+[0-9]{1,2}$")).alias("strict"),
        _vote(m.rlike(KNOWN[kind][0]), m.rlike(KNOWN[kind][1])).alias("known"),
        _vote(before.rlike(FOR), before.rlike(AGAINST)).alias("before"),
        _vote(mixed, ~mixed).alias("mixed"))


def _candidates(docs: DataFrame, text_col: str, to: dict[str, str]) -> DataFrame:
    """``docs`` with a column for each kind: its candidates that pass the kind's check, with their votes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs
    for kind, pattern in {**BASE, **FURTHER}.items():
        out = out.withColumn(to[kind], _spans(text, pattern, NEEDS.get(kind, "[0-9]")))
    for kind in KINDS:
        out = out.withColumn(to[kind], _voted(kind, to[kind]))
    return out


def _voted(kind: str, spans: str) -> Column:
    passed = F.filter(spans, lambda x: _passes(kind, x["match"]))
    return F.transform(passed, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _votes(kind, x).alias("votes")))


@dataclass
class Model:
    """The span classifier: a weight for each labeler and each kind, and an intercept; and the labelers' reliabilities by kind and labeler."""

    weights: dict[str, float]
    kinds: dict[str, float]
    intercept: float
    reliabilities: dict[tuple[str, str], tuple[float, float]]

    def accepts(self, kind: str, votes: Column) -> Column:
        score = F.lit(self.intercept + self.kinds[kind])
        for name in VOTES:
            score = score + F.lit(self.weights[name]) * votes[name]
        return score >= F.lit(math.log(ACCEPT / (1 - ACCEPT)))


def estimate(counts: dict[tuple, int], rounds: int = 50) -> tuple[dict[tuple, float], dict[tuple[str, str], tuple[float, float]]]:
    """Expectation-maximisation over {(kind, vote, ...): how many}.

    Returns the probability that each pattern is personal data, and for each kind and
    labeler its share of right votes (of those it casts) on data that is and that is not.
    Counts are smoothed by one vote each way, so no labeler becomes certain.
    """
    found = sorted({k[0] for k in counts})
    reliable = {(kind, v): (0.85, 0.85) for kind in found for v in VOTES}
    prior = dict.fromkeys(found, 0.5)
    sure: dict[tuple, float] = {}
    for _ in range(rounds):
        for key in counts:
            odds = math.log(prior[key[0]] / (1 - prior[key[0]]))
            for name, vote in zip(VOTES, key[1:], strict=True):
                yes, no = reliable[key[0], name]
                odds += vote and (math.log(yes / (1 - no)) if vote > 0 else math.log((1 - yes) / no))
            sure[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for kind in found:
            own = [(k, sure[k], n) for k, n in counts.items() if k[0] == kind]
            for i, name in enumerate(VOTES, 1):
                cast = [(k[i], p, n) for k, p, n in own if k[i]]
                yes = (sum(n * p for v, p, n in cast if v > 0) + 4) / (sum(n * p for _, p, n in cast) + 5)
                no = (sum(n * (1 - p) for v, p, n in cast if v < 0) + 4) / (sum(n * (1 - p) for _, p, n in cast) + 5)
                reliable[kind, name] = (min(0.99, max(0.55, yes)), min(0.99, max(0.55, no)))
            prior[kind] = (sum(p * n for _, p, n in own) + 1) / (sum(n for _, _, n in own) + 2)
    return sure, reliable


def train(counts: dict[tuple, int], sure: dict[tuple, float], steps: int = 400) -> tuple[dict[str, float], dict[str, float], float]:
    """Logistic regression of the estimated labels on votes and kind, by gradient steps with a small penalty."""
    weights, kinds, intercept = dict.fromkeys(VOTES, 0.0), dict.fromkeys(KINDS, 0.0), 0.0
    total = sum(counts.values()) or 1
    for _ in range(steps):
        gw, gk, gi = {v: 1e-3 * w for v, w in weights.items()}, {k: 1e-3 * w for k, w in kinds.items()}, 0.0
        for key, n in counts.items():
            z = intercept + kinds[key[0]] + sum(weights[v] * x for v, x in zip(VOTES, key[1:], strict=True))
            off = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - sure[key]) * n / total
            gi += off
            gk[key[0]] += off
            for v, x in zip(VOTES, key[1:], strict=True):
                gw[v] += off * x
        intercept -= gi
        weights = {v: w - gw[v] for v, w in weights.items()}
        kinds = {k: w - gk[k] for k, w in kinds.items()}
    return weights, kinds, intercept


def fit(docs: DataFrame, *, text_col: str = "text") -> Model:
    """The model of all of ``docs``: only the counts of vote patterns, at most 3^4 for a kind, reach the driver."""
    names = {k: f"_{k}" for k in KINDS}
    every = _candidates(docs.select(F.col(text_col).alias("_text")), "_text", names).select(F.explode(F.concat(*names.values())).alias("x"))
    rows = every.groupBy("x.kind", *[F.col(f"x.votes.{v}").alias(v) for v in VOTES]).count().collect()
    counts = {tuple(r)[:-1]: r[-1] for r in sorted(rows)}
    sure, reliable = estimate(counts)
    return Model(*train(counts, sure), reliable)


_SPAN = "struct<kind:string,start:int,end:int>"


def _span(x: Column) -> Column:
    return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def _apart(base: Column, more: Column) -> Column:
    """Those of ``more`` that overlap no span of ``base``; of them, left to right, those that overlap none kept before; by kind, then start."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, FURTHER)), x["kind"]).cast("int")
    event = lambda x, n: F.struct(x["start"].alias("start"), n.alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))
    kind = "struct<start:int,rank:int,end:int,kind:string>"
    none = F.expr(f"cast(array() as array<{kind}>)")
    events = F.array_sort(F.concat(F.transform(base, lambda x: event(x, F.lit(0))), F.transform(more, lambda x: event(x, rank(x)))))
    far = F.lit(2**31 - 1)
    # From the right: the next base span's start; from the left: the furthest end so far.
    clear = F.reverse(_scan(F.reverse(events), far, lambda at, x: (F.when(x["rank"] == 0, x["start"]).otherwise(at), F.when((x["rank"] == 0) | (x["end"] <= at), F.array(x)).otherwise(none)), kind))
    kept = _scan(clear, F.lit(0), lambda at, x: (F.when((x["rank"] == 0) | (x["start"] >= at), F.greatest(at, x["end"])).otherwise(at), F.when((x["rank"] > 0) & (x["start"] >= at), F.array(x)).otherwise(none)), kind)
    order = F.array_sort(F.transform(kept, lambda x: F.struct(x["rank"].alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.transform(order, _span)


def find(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with a column of spans: array<struct<kind, start, end>> by kind, then start; code points, end exclusive.

    All base spans, and the further candidates that the model accepts and that overlap no
    base span; of further ones that overlap, the leftmost stays, at one start the first
    kind. Null and empty texts have none. Rows are independent given the model.
    """
    to = {}
    for kind in KINDS:
        to[kind] = fresh([*docs.columns, *to.values(), name], f"_{kind}")
    out = _candidates(docs, text_col, to)
    more = fresh([*out.columns, name], "_more")
    out = out.withColumn(name, F.concat(*[F.transform(to[k], _span) for k in BASE]))
    out = out.withColumn(more, F.concat(*[F.transform(F.filter(to[k], lambda x: model.accepts(k, x["votes"])), _span) for k in FURTHER]))  # noqa: B023
    apart = F.when(F.size(more) > 0, _let(F.col(name), lambda b: _apart(b, F.col(more)))).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))
    return out.withColumn(name, F.concat(name, apart)).drop(more, *to.values())


def redact(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets, as [EMAIL]; overlapping spans become one, of the kind that starts first."""
    spans = fresh(docs.columns, "_spans")
    text = F.col(text_col)
    in_order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.upper(x["kind"]).alias("kind"))))
    last = F.array(F.struct(F.lit(2**31 - 1).alias("start"), F.lit(2**31 - 1).alias("end"), F.lit(None).cast("string").alias("kind")))
    kind = "struct<from:int,to:int,kind:string>"

    def step(at, x):  # what stands between the spans so far and this one, unless they overlap
        gap = F.array(F.struct(at.alias("from"), x["start"].alias("to"), x["kind"].alias("kind")))
        return F.greatest(at, x["end"]), F.when(x["start"] >= at, gap).otherwise(F.expr(f"cast(array() as array<{kind}>)"))

    gaps = _scan(F.concat(in_order, last), F.lit(0), step, kind)

    def cut(pieces, x):  # a gap's text, from the pieces that hold it
        first, end = F.floor(x["from"] / PIECE).cast("int"), F.least(F.floor((x["to"] - 1) / PIECE).cast("int") + 1, F.size(pieces))
        some = F.array_join(F.slice(pieces, first + 1, F.greatest(end - first, F.lit(0))), "")
        said = F.when(x["to"] > x["from"], F.substring(some, x["from"] % PIECE + 1, x["to"] - x["from"])).otherwise("")
        return F.concat(said, F.coalesce(F.concat(F.lit("["), x["kind"], F.lit("]")), F.lit("")))

    done = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda p: F.array_join(F.transform(gaps, lambda x: cut(p, x)), ""))
    return find(docs, model, text_col=text_col, name=spans).withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text)).select(*docs.columns)
