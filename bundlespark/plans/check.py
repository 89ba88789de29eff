"""Checking concepts against a compiled profile: deviations as rows.

Rules become column expressions, one array of deviations for each type; references to
handles and to files of the bundle become equi-joins. Rows are (phase, concept_id, ord,
code, path, detail): by concept, then rules by key, then the type's own checks, then
duplicate handles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import actors, ids, paths, posix, values
from ..operators import lookup
from ..operators.concepts import CORE_KEYS
from .profile import ANY, LIST, OBJECT, SCALAR, Compiled, Rule

_NONE = "cast(array() as array<struct<code:string,path:string,detail:string>>)"


def _none() -> Column:
    return F.expr(_NONE)


def _one(code, path, detail="") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(code).alias("code"), lit(path).alias("path"), lit(detail).alias("detail"))


def _if(condition: Column, code, path, detail="") -> Column:
    return F.when(condition, F.array(_one(code, path, detail))).otherwise(_none())


def shown(v: Column) -> Column:
    return F.coalesce(F.to_json(v), F.lit(""))


def state(rule: Rule, r: Column) -> Column:
    """missing, absent (there, but blank or empty), present, or wrong (of another shape) for a value as values.read gives it."""
    v, k = r["v"], r["k"]
    text = F.coalesce(~values.is_blank(r["t"]), F.lit(False))
    full = F.coalesce(F.size(r["xs"]) > 0, F.lit(False))
    member = F.coalesce(F.size(F.map_keys(F.when(k == "object", v).cast("map<string,variant>"))) > 0, F.lit(False))
    if rule.cardinality == SCALAR:
        out = F.when(k == "string", F.when(text, "present").otherwise("absent")).when(k.isin("number", "boolean"), "present").otherwise("wrong")
    elif rule.cardinality == LIST:
        out = F.when(k == "array", F.when(full, "present").otherwise("absent")).otherwise("wrong")
    elif rule.cardinality == OBJECT:
        out = F.when(k == "object", F.when(member, "present").otherwise("absent")).otherwise("wrong")
    else:
        assert rule.cardinality == ANY
        there = text | full | (member if rule.members is not None else F.lit(False))
        out = F.when(there, "present").otherwise("absent")
    return F.when(v.isNull(), "missing").otherwise(out)


def in_vocabulary(allowed, r: Column) -> Column:
    """Whether a text, or every element of a list, is one of ``allowed``."""
    ok = lambda t: F.coalesce(t.isin(list(allowed)), F.lit(False))
    return F.when(r["k"] == "array", F.forall(r["xs"], lambda x: ok(values.text(x)))).otherwise(ok(r["t"]))


def _text_format(name: str, value: str | None, t: Column) -> Column:
    if name == "rfc3339-utc":
        return t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z$") & F.try_to_timestamp(F.regexp_replace(t, r"\.[0-9]+Z$", "Z")).isNotNull()
    if name == "date":
        return ids.is_date(t)
    if name == "uri":
        return paths.uri_scheme(t).isNotNull()
    if name == "uriWithScheme":
        return paths.uri_scheme(t) == value.lower()
    if name == "documentHandle":
        return ids.handle(t)["prefix"] == value
    if name == "actor":
        return actors.parse(t)["kind"] != "unclassified"
    if name == "human-actor":
        return actors.is_human(t)
    return F.lit(False)


def _format_one(form, r: Column) -> Column:
    name, value = form
    number = F.lit(False)
    if name in ("integer", "non-negative-integer"):
        number = values.let(values.integer(r["v"]), lambda n: n.isNotNull() & (F.lit(True) if name == "integer" else n >= 0))
    out = F.when(r["k"] == "string", _text_format(name, value, r["t"])).when(r["k"] == "number", number).when(r["k"] == "boolean", F.lit(name == "boolean")).otherwise(False)
    return F.coalesce(out, F.lit(False))


def has_format(form, r: Column) -> Column:
    """Whether a value, or every element of a list, has the format; lists in lists are looked into once."""
    one = lambda x: values.let(values.read(x), lambda q: _format_one(form, q))
    inner = lambda q: F.when(q["k"] == "array", F.forall(q["xs"], one)).otherwise(_format_one(form, q))
    return F.when(r["k"] == "array", F.forall(r["xs"], lambda x: values.let(values.read(x), inner))).otherwise(_format_one(form, r))


def _members(rules) -> tuple[str, ...]:
    """The keys that ``rules`` of one field look at in a list's records; none if those can't be told apart as columns."""
    names = sorted({e.field for r in rules for e in r.elements or ()})
    return tuple(names) if len({n.lower() for n in names}) == len(names) else ()


def _records(v: Column, names: tuple[str, ...]) -> Column:
    """A list's records with the values under ``names``, all opened at once, null for what is no record; NULL for anything but a list."""
    return F.try_variant_get(v, "$", "array<struct<" + ",".join(f"`{n.replace('`', '``')}`:variant" for n in names) + ">>")


def _scopes(c: Compiled):
    return [*c.by_type.items(), (None, c.base)]


def _staged(concepts: DataFrame, c: Compiled) -> DataFrame:
    """``concepts`` with what rules ask of each key as columns, so that Spark compiles it and works it out once."""
    of: dict[str, list[Rule]] = {}
    for _, rules in _scopes(c):
        for r in rules:
            of.setdefault(r.field, []).append(r)
    if not of or "__v:" + next(iter(of)) in concepts.columns:
        return concepts
    col = lambda part, name: F.col(f"`__{part}:{name.replace('`', '``')}`")
    add = lambda df, part, what: df.withColumns({f"__{part}:{n}": x for n in of if (x := what(n)) is not None})
    out = add(concepts, "v", lambda n: values.get(F.col("fm"), n))
    out = add(out, "xs", lambda n: None if _plain(of[n]) else values.items(col("v", n)))
    out = add(out, "es", lambda n: _records(col("v", n), _members(of[n])) if _members(of[n]) else None)
    out = add(out, "k", lambda n: values.kind_of(col("v", n), col("es" if _members(of[n]) else "xs", n)))
    out = add(out, "t", lambda n: values.text_of(col("v", n), col("k", n)))
    states = {f"__s:{name}:{r.field}": state(r, _given(c, r)) for name, rules in _scopes(c) for r in rules}
    return out.withColumns(states)


def _plain(rules) -> bool:
    """Whether a list's elements are only looked at as records."""
    return bool(_members(rules)) and all(not r.allowed and not r.format and r.reference is None and r.path is None and r.elements and all(e.reference is None and e.path is None for e in r.elements) for r in rules)


def _given(c: Compiled, rule: Rule) -> dict[str, Column]:
    """A key's value as ``values.read`` gives it, from the columns of ``_staged``; es: its records, where rules ask for them."""
    every = [r for _, rules in _scopes(c) for r in rules if r.field == rule.field]
    col = lambda part: F.col(f"`__{part}:{rule.field.replace('`', '``')}`")
    names = _members(every)
    return {"v": col("v"), "k": col("k"), "t": col("t"), "xs": col("es" if _plain(every) else "xs")} | ({"es": col("es"), "names": names} if names else {})


def _state(name: str | None, rule: Rule) -> Column:
    return F.col(f"`__s:{str(name).replace('`', '``')}:{rule.field.replace('`', '``')}`")


def _presence(rule: Rule, strict: bool, sibling, path, nested: bool) -> Column:
    """The first presence clause that applies: required ones, then, if strict, recommended ones."""
    clauses = [c for c in rule.presence if c[0] is True] + ([c for c in rule.presence if c[0] is False] if strict else [])
    out = None
    for required, condition in reversed(clauses):
        code = ("Missing" if required else "MissingRecommended") + ("Nested" if nested else "") + "ProfileField"
        found = F.array(_one(code, path, f"when {condition.field} in {', '.join(condition.has_value)}" if condition else ""))
        holds = F.lit(True) if condition is None else F.coalesce(values.text(sibling(condition.field)).isin(list(condition.has_value)), F.lit(False))
        out = F.when(holds, found).otherwise(_none() if out is None else out)
    return _none() if out is None else out


def _value_checks(rule: Rule, r: Column, path) -> list[Column]:
    out = []
    if rule.allowed:
        out.append(_if(~in_vocabulary(rule.allowed, r), "ValueNotInVocabulary", path, shown(r["v"])))
    if rule.format:
        out.append(_if(~has_format(rule.format, r), "ValueFormatMismatch", path, shown(r["v"])))
    return out


def _repeated(rule: Rule, xs: Column, value) -> Column:
    """Deviations of values that a list's records hold more than once under the rule's key: sorted together, not compared one by one."""
    member = next(r for r in rule.elements if r.field == rule.unique_by)

    def keyed(x, i):
        key = lambda r: F.when(state(member, r) == "present", values.key_of(r))
        return values.let(values.read(value(x, member.field)), lambda r: F.struct(key(r).alias("k"), i.alias("i"), shown(r["v"]).alias("s")))

    said = lambda run: _one("DuplicateNestedFieldValue", f"{rule.field}.{rule.unique_by}", F.concat(run[0]["s"], F.lit(" at ["), F.array_join(F.transform(run, lambda y: y["i"].cast("string")), ", "), F.lit("]")))
    return F.transform(values.repeated(F.filter(F.transform(xs, keyed), lambda y: y["k"].isNotNull())), said)


def _rule(rule: Rule, v: Column, strict: bool, sibling, path) -> Column:
    """The deviations of one rule of a list's records or of an object; ``v`` is read once, whatever is asked of it."""
    return values.let(values.read(v), lambda r: values.let(state(rule, r), lambda there: _outcome(rule, r, there, strict, sibling, path, True)))


def _elements(rule: Rule, r, strict: bool) -> list[Column]:
    """The deviations of a list's records, of each by itself and of what they repeat."""
    if "es" in r if isinstance(r, dict) else False:
        xs, names = r["es"], r["names"]
        value = lambda x, k: x[k] if k in names else F.lit(None).cast("variant")
        is_record, whole = F.Column.isNotNull, values.items
    else:
        xs, value, is_record, whole = r["xs"], values.get, lambda x: values.kind(x) == "object", lambda v: r["xs"]

    def each(bad):
        def element(x, i):
            at = F.concat(F.lit(f"{rule.field}["), i.cast("string"), F.lit("]"))
            subs = [_rule(e, value(x, e.field), strict, lambda k: value(x, k), F.concat(at, F.lit("." + e.field))) for e in rule.elements]
            ok = F.concat(*subs) if subs else _none()
            return F.when(is_record(x), ok).otherwise(F.array(_one("NestedElementNotRecord", at, shown(F.get(bad, i)))))

        return F.flatten(F.transform(xs, element))

    # The elements themselves are only wanted where one is no record.
    some = values.let(F.when(F.exists(xs, lambda x: ~is_record(x)), whole(r["v"])), each)
    out = [F.when(r["k"] == "array", some).otherwise(_none())]
    if rule.unique_by is not None:
        out.append(F.when(r["k"] == "array", _repeated(rule, xs, value)).otherwise(_none()))
    return out


def _outcome(rule: Rule, r, there: Column, strict: bool, sibling, path, nested: bool = False) -> Column:
    """The deviations of one rule whose value was read as ``r`` and found ``there``."""
    given = _value_checks(rule, r, path)
    present = list(given)
    if rule.elements is not None:
        present += _elements(rule, r, strict)
    if rule.members is not None:
        subs = [_rule(m, values.get(r["v"], m.field), strict, lambda k: values.get(r["v"], k), f"{rule.field}.{m.field}") for m in rule.members]
        present.append(F.when(r["k"] == "object", F.concat(*subs) if subs else _none()).otherwise(_none()))
    together = lambda parts: F.concat(*parts) if parts else _none()
    missing = _presence(rule, strict, sibling, path, nested)
    return (F.when(there == "missing", missing).when(there == "absent", together([missing, *given]))
            .when(there == "present", together(present)).otherwise(F.array(_one("CardinalityMismatch", path, F.concat(F.lit(f"{rule.cardinality}: "), shown(r["v"]))))))


def path_regex(pattern: str) -> str:
    """Of a path pattern: '*' is one segment, a final '**' one or more."""
    parts = pattern.split("/")
    return "^" + "/".join("[^/]+(/[^/]+)*" if p == "**" and i == len(parts) - 1 else "[^/]*" if p == "*" else "\\Q" + p + "\\E" for i, p in enumerate(parts)) + "$"


def _fields(c: Compiled, name: str | None, rules: tuple[Rule, ...], strict: bool) -> Column:
    fm = F.col("fm")
    out = [_outcome(r, _given(c, r), _state(name, r), strict, lambda k: values.get(fm, k), r.field) for r in rules]
    if not c.profile.allow_unknown_fields:
        allowed = sorted({*CORE_KEYS, *(r.field for r in rules), *([c.profile.id_field] if c.profile.id_field else [])})
        out.append(F.transform(F.array_except(values.keys(fm), F.array(*map(F.lit, allowed))), lambda k: _one("FieldNotInProfile", k)))
    return F.concat(*out) if out else _none()


def _type_checks(c: Compiled, t) -> Column:
    fm, out = F.col("fm"), []
    if t.path_pattern is not None:
        out.append(_if(~F.col("concept_id").rlike(path_regex(t.path_pattern)), "PathPatternMismatch", "", t.path_pattern))
    if t.resource_scheme is not None:
        said = lambda raw: F.when(raw.isNull(), F.array(_one("MissingResource", "resource", t.resource_scheme))).otherwise(_if(~raw.startswith(t.resource_scheme + "://"), "ResourceSchemeMismatch", "resource", raw))
        out.append(values.let(values.text(values.get(fm, "resource")), said))
    if t.require_schema:
        have = F.col("schema_columns")
        want = F.array(*[F.lit(x.strip().lower()) for x in t.schema_columns]) if t.schema_columns else F.expr("cast(array() as array<string>)")
        same = F.slice(F.transform(have, lambda x: F.lower(values.strip(x))), 1, max(1, len(t.schema_columns))) == want if t.schema_columns else F.lit(True)
        out.append(F.when(have.isNull(), F.array(_one("MissingSchemaSection", ""))).otherwise(_if(~same, "SchemaColumnsMismatch", "", F.array_join(have, ", "))))
    if c.profile.id_field and t.id_prefix:
        raw = values.text(values.get(fm, c.profile.id_field))
        blank = F.coalesce(values.is_blank(raw), F.lit(True))
        bad = F.coalesce(ids.handle(raw)["prefix"] != t.id_prefix, F.lit(True))
        out.append(F.when(blank, F.array(_one("MissingDocumentId", c.profile.id_field, t.id_prefix))).otherwise(_if(bad, "MalformedDocumentId", c.profile.id_field, raw)))
    return F.concat(*out) if out else _none()


def _targets(c: Compiled, which: str):
    """(type or None, rule, selector depth, path builder) of every rule with a reference or a path."""
    for name, rules in [*c.by_type.items(), (None, c.base)]:
        for r in rules:
            if getattr(r, which) is not None:
                yield name, r, None
            for m in (*(r.elements or ()), *(r.members or ())):
                if getattr(m, which) is not None:
                    yield name, r, m


def _values_of(c: Compiled, name, r: Rule, m: Rule | None, number: int) -> Column:
    """array<struct<rule, path, v>> of the single values that a rule looks at, lists opened; ``number`` tells the rule."""
    own = F.col("type") == name if name is not None else ~F.col("type").isin(list(c.by_type)) if c.by_type else F.lit(True)
    none = F.expr("cast(array() as array<struct<rule:int,path:string,v:variant>>)")
    value = lambda at, v: F.struct(F.lit(number).alias("rule"), at.alias("path"), v.alias("v"))
    open_ = lambda at, q: F.when(q["k"] == "array", F.transform(q["xs"], lambda x, i: value(F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), x))).otherwise(F.array(value(at, q["v"])))
    given = lambda rule, at, v: values.let(values.read(v), lambda q: F.when(state(rule, q).isin("absent", "present"), open_(at, q)).otherwise(none))
    top = _given(c, r)
    if m is None:
        got = F.when(_state(name, r).isin("absent", "present"), open_(F.lit(r.field), top)).otherwise(none)
    else:
        inner = lambda x, at: F.when(values.kind(x) == "object", given(m, F.concat(at, F.lit("." + m.field)), values.get(x, m.field))).otherwise(none)

        lists = F.flatten(F.transform(top["xs"], lambda x, i: inner(x, F.concat(F.lit(r.field + "["), i.cast("string"), F.lit("]"))))) if r.elements is not None else none
        got = F.when(_state(name, r) == "present", F.when(top["k"] == "array", lists).otherwise(inner(top["v"], F.lit(r.field)) if r.members is not None else none)).otherwise(none)
    return F.when(own, got).otherwise(none)


def _by_rule(given: list) -> Column:
    """A column for each rule's number."""
    out = F.when(F.lit(False), given[0])
    for i, x in enumerate(given):
        out = out.when(F.col("rule") == i, x)
    return out


def _judge_reference(ref) -> Column:
    external = F.when(F.col("scheme").isNull(), "MalformedDocumentReference").when(~F.col("scheme").isin(list(ref.schemes)), "ExternalReferenceSchemeNotAllowed")
    if ref.pattern is not None:
        external = external.when(~F.col("raw").rlike(posix.whole(ref.pattern)), "ExternalReferencePatternMismatch")
    local = (F.when(F.lit(not ref.allow_local), "LocalDocumentReferenceNotAllowed").when(F.col("h.prefix") != ref.prefix, "ReferenceHandlePrefixMismatch")
             .when(F.col("owners").isNull(), "DanglingHandleReference").when((F.col("own_handle") == F.col("handle")) & (not ref.allow_self), "SelfDocumentReference"))
    return F.when(F.col("raw").isNull(), "MalformedDocumentReference").when(F.col("h").isNotNull(), local).otherwise(external)


def _judge_path(rule, whole_inventory: bool) -> Column:
    target = F.col("at.path")
    md = target.endswith(".md")
    gone = F.col("owners").isNull() & (F.lit(True) if whole_inventory else md)
    inside = (F.when(md & ids.from_path(target).isNull(), "MalformedPathReference")
              .when((target == F.col("source_path")) & (not rule.allow_self), "SelfDocumentReference").when(gone, "DanglingPathReference"))
    return (F.when(F.col("raw").isNull() | (F.col("at.kind") == "malformed"), "MalformedPathReference").when(F.col("at.kind") == "escape", "PathEscapesBundle")
            .when(F.col("at.kind") == "external", F.when(~F.col("at.scheme").isin(list(rule.schemes)), "ExternalReferenceSchemeNotAllowed")).otherwise(inside))


def _handle_text(c: Compiled) -> Column:
    """The text under the profile's id field."""
    key = c.profile.id_field
    return values.text(values.get(F.col("fm"), key)) if key else F.lit(None).cast("string")


def _own_handle(c: Compiled, text: Column) -> Column:
    """``text``, which stands under the profile's id field, where its prefix is the one that the concept's type declares."""
    owned = F.lit(None).cast("string")
    for t in c.profile.types:
        if t.id_prefix:
            owned = F.when(F.col("type") == t.type, F.lit(t.id_prefix)).otherwise(owned)
    return F.when(ids.handle_of(text)["prefix"] == owned, text)


def _tagged(tag: str, x: Column) -> Column:
    return F.concat(F.lit(tag + ":"), x)


def _opened(df: DataFrame, rows: Column, *keep: str) -> DataFrame:
    """(keep, x) of each element of ``rows`` that isn't null. A plain explode would have ``rows`` worked out twice, first to see whether there are any."""
    return df.select(*keep, F.explode_outer(rows).alias("x")).where("x is not null")


def _known(some: DataFrame, c: Compiled, looks: set[str], inventory: DataFrame | None) -> DataFrame:
    """(known, owners, first_id, again) of each tagged text that can be looked up: how many own it, the first of them by id, and how often that one owns it besides once."""
    there = [_tagged("h", F.col("own_handle"))] if "reference" in looks else []
    there += [_tagged("d", F.col("handle_text"))] if c.profile.id_field else []
    there += [_tagged("p", F.col("source_path"))] if "path" in looks and inventory is None else []
    known = _opened(some, F.array(*there), "concept_id").withColumnRenamed("x", "known") if there else None
    if "path" in looks and inventory is not None:
        files = inventory.select(F.lit("").alias("concept_id"), _tagged("p", F.array_join(ids.segments(F.col("path")), "/")).alias("known"))
        known = files if known is None else known.unionByName(files)
    each = known.groupBy("known", "concept_id").agg(F.count(F.lit(1)).alias("n"))
    least = each.groupBy("known").agg(F.sum("n").alias("owners"), F.min(F.struct("concept_id", "n", F.col("known").alias("what"))).alias("least"))
    return least.select("known", "owners", F.col("least.concept_id").alias("first_id"), (F.col("least.n") - 1).alias("again"), "least.what")


def _met(concepts: DataFrame, c: Compiled, found: Column, inventory: DataFrame | None) -> DataFrame:
    """(phase, concept_id, ord, code, path, detail) of the deviations ``found`` in each concept, of its references and paths, and of duplicate handles.

    Whatever rules look up is opened in the pass that finds the rest and carries a tag, h
    for handles and p for paths, as does the concept's own handle, d; all of it meets one
    table of owned handles and files in one join. So concepts are made twice, for what they
    ask and for what they own. Without an inventory only targets that end in .md can be
    known to be missing.
    """
    rules = [(which, getattr(m or r, which), name, r, m) for which in ("reference", "path") for name, r, m in _targets(c, which)]
    key, blank = c.profile.id_field, lambda kind: F.lit(None).cast(kind)
    row = lambda phase, ord_, code, path, detail, rule, v: F.struct(phase.alias("phase"), ord_.alias("ord"), code.alias("code"), path.alias("path"), detail.alias("detail"), rule.alias("rule"), v.alias("v"))
    concepts = _staged(concepts, c).withColumn("__found", found)
    rows = F.transform("__found", lambda x, i: row(F.lit(1), i, x["code"], x["path"], x["detail"], blank("int"), blank("variant")))
    if not rules and not key:
        return _opened(concepts, rows, "concept_id").select("x.phase", "concept_id", "x.ord", "x.code", "x.path", "x.detail")
    some = concepts.withColumn("handle_text", _handle_text(c)).withColumn("handle_text", F.when(~values.is_blank(F.col("handle_text")), F.col("handle_text")))
    some = some.withColumn("own_handle", _own_handle(c, F.col("handle_text")))
    if rules:
        opened = F.concat(*[_values_of(c, name, r, m, i) for i, (_, _, name, r, m) in enumerate(rules)])
        rows = F.concat(rows, F.transform(opened, lambda x: row(F.lit(2), F.lit(0), blank("string"), x["path"], blank("string"), x["rule"], x["v"])))
    if key:
        owner = row(F.lit(3), F.lit(0), F.lit("DuplicateDocumentId"), F.lit(key), F.col("handle_text"), blank("int"), blank("variant"))
        rows = F.concat(rows, F.slice(F.array(owner), F.lit(1), F.when(F.col("handle_text").isNotNull(), 1).otherwise(0)))
    each = _opened(some, rows, "concept_id", "source_path", "own_handle").select("concept_id", "source_path", "own_handle", "x.*").withColumn("raw", F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")))
    prefix = _by_rule([F.lit(own.prefix if which == "reference" else None).cast("string") for which, own, *_ in rules] or [blank("string")])
    is_path = F.col("rule") >= sum(which == "reference" for which, *_ in rules)
    each = each.withColumn("h", F.when(~is_path, ids.handle_of(F.col("raw")))).withColumn("handle", F.when(F.col("h.prefix") == prefix, F.col("raw"))).withColumn("scheme", F.when(~is_path & F.col("h").isNull(), paths.uri_scheme(F.col("raw"))))
    looks = {which for which, *_ in rules}
    at = F.when(is_path, paths.classify(F.col("source_path"), F.col("raw"))) if "path" in looks else blank("struct<kind:string,scheme:string,path:string>")
    each = each.withColumn("at", at)
    known = _known(some, c, looks, inventory)
    own = F.col("phase") == 3
    each = lookup.meet(each, F.when(own, _tagged("d", F.col("detail"))).when(is_path, _tagged("p", F.col("at.path"))).otherwise(_tagged("h", F.col("handle"))), known, "known", "concept_id", "path", "code")
    looked_up = _by_rule([_judge_reference(r) if which == "reference" else _judge_path(r, inventory is not None) for which, r, *_ in rules] or [blank("string")])
    first, also = F.col("phase") == 1, lambda text: F.concat_ws(" also on ", text, "first_id")
    code = F.when(first, F.col("code")).when(own, F.when(F.col("concept_id") != F.col("first_id"), F.col("code"))).otherwise(looked_up)
    out = each.select("phase", "concept_id", "ord", code.alias("code"), "path", F.when(first, F.col("detail")).when(own, also("detail")).otherwise(shown(F.col("v"))).alias("detail")).where("code is not null")
    if not key:
        return out
    # The first owner's further rows: more than one concept of one id. It asks for all that the join does, and of what was
    # aggregated only, so that both read one shuffle.
    more = known.where((F.col("owners") > 1) & (F.col("again") > 0) & F.col("what").startswith("d:")).select(
        F.lit(3).alias("phase"), F.explode(F.array_repeat("first_id", F.col("again").cast("int"))).alias("concept_id"), F.lit(0).alias("ord"), F.lit("DuplicateDocumentId").alias("code"), F.lit(key).alias("path"), also(F.substring("what", 3, 1 << 30)).alias("detail"))
    return out.unionByName(more)


def check(concepts: DataFrame, c: Compiled, *, strict: bool = False, inventory: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """All deviations of projected concepts (schema_columns is needed if a type requires a schema section)."""
    kind = F.col("type")
    fields, own = _fields(c, None, c.base, strict), _none()
    for t in c.profile.types:
        fields = F.when(kind == t.type, _fields(c, t.type, c.by_type[t.type], strict)).otherwise(fields)
        own = F.when(kind == t.type, _type_checks(c, t)).otherwise(own)
    unknown = _if(~kind.isin([t.type for t in c.profile.types]) if c.profile.types else F.lit(True), "TypeNotInProfile", "type", kind)
    unknown = _none() if c.profile.allow_unknown_types else unknown
    out = _met(concepts, c, F.concat(unknown, fields, own), inventory)
    return out.orderBy(F.when(F.col("phase") == 3, 1).otherwise(0), "concept_id", "phase", "ord", "path", "code") if ordered else out


def version_unmet(c: Compiled, declared: str | None) -> tuple[str, str | None] | None:
    """(required, declared) if the bundle doesn't declare at least the version that the profile requires."""
    need = ids.parse_version(c.profile.require_bundle_version)
    if need is None:
        return None
    have = ids.parse_version(declared)
    return None if have is not None and have >= need else (c.profile.require_bundle_version, declared)

