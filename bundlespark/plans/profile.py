"""Profiles: declarative rules for concepts, read from JSON and compiled on the driver.

A compiled profile holds merged rules for each type. Compilation rejects rules that
contradict each other or can never hold; all such errors are reported, in a fixed order.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from ..functions import posix
from ..functions.ids import KNOWN_VERSION, parse_version
from ..operators.concepts import CORE_KEYS

ANY, SCALAR, LIST, OBJECT = "any", "scalar", "list", "object"
#: Formats by name; two more take a parameter, written {"uriWithScheme": s} and {"documentHandle": p}.
FORMATS = ("rfc3339-utc", "date", "uri", "actor", "human-actor", "integer", "non-negative-integer", "boolean")
_SCALAR_FORMATS = ("integer", "non-negative-integer", "boolean")
_NARROWER = {("uri", "uriWithScheme"), ("actor", "human-actor"), ("integer", "non-negative-integer")}
#: Keys that a version took out of use, and formats that one brought.
SUPERSEDED = {"timestamp": (0, 2)}
INTRODUCED = {"actor": (0, 2), "human-actor": (0, 2)}


class ProfileError(ValueError):
    """The definition errors of a profile: (code, scope, path, detail)."""

    def __init__(self, errors):
        super().__init__("; ".join(f"{code} {scope or ''} {path} {detail}".strip() for code, scope, path, detail in errors))
        self.errors = errors


@dataclass(frozen=True)
class Condition:
    field: str
    has_value: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    prefix: str
    schemes: tuple[str, ...] = ()
    allow_self: bool = False
    allow_local: bool = True
    pattern: str | None = None


@dataclass(frozen=True)
class PathRule:
    schemes: tuple[str, ...] = ()
    allow_self: bool = False


@dataclass(frozen=True)
class Rule:
    """What is asked of one key; presence is ((required?, condition), ...)."""

    field: str
    description: str | None = None
    allowed: tuple[str, ...] = ()
    cardinality: str = ANY
    format: tuple[str, str | None] | None = None
    elements: tuple["Rule", ...] | None = None
    members: tuple["Rule", ...] | None = None
    reference: Reference | None = None
    path: PathRule | None = None
    unique_by: str | None = None
    presence: tuple[tuple[bool, Condition | None], ...] = ()


@dataclass(frozen=True)
class TypeRule:
    type: str
    rules: tuple[Rule, ...]
    description: str | None = None
    path_pattern: str | None = None
    resource_scheme: str | None = None
    require_schema: bool = False
    schema_columns: tuple[str, ...] = ()
    id_prefix: str | None = None


@dataclass(frozen=True)
class Profile:
    name: str
    version: str
    rules: tuple[Rule, ...]
    types: tuple[TypeRule, ...]
    description: str | None = None
    allow_unknown_types: bool = False
    allow_unknown_fields: bool = True
    id_field: str | None = None
    require_bundle_version: str | None = None


def _format(x):
    if x is None:
        return None
    if isinstance(x, dict):
        (name, value), = x.items()
        return (name, value)
    if x not in FORMATS:
        raise ValueError(f"unknown format {x!r}")
    return (x, None)


def _rule(x: dict, required: bool | None) -> Rule:
    ref, path, when = x.get("reference"), x.get("path"), x.get("when")
    condition = Condition(when["field"], tuple(when.get("hasValue", ()))) if when else None
    nested = lambda k: _rules(x[k]) if x.get(k) is not None else None
    return Rule(
        x["field"], x.get("description"), tuple(x.get("allowedValues") or ()), x.get("cardinality") or ANY, _format(x.get("format")), nested("elementFields"), nested("objectFields"),
        Reference(ref["localPrefix"], tuple(ref.get("externalUriSchemes") or ()), ref.get("allowSelf", False), ref.get("allowLocal", True), ref.get("externalUriPattern")) if ref is not None else None,
        PathRule(tuple(path.get("externalUriSchemes") or ()), path.get("allowSelf", False)) if path is not None else None, x.get("uniqueBy"),
        () if required is None and condition is None else ((required, condition),))


def _rules(x: dict) -> tuple[Rule, ...]:
    return tuple(_rule(r, kind) for key, kind in (("required", True), ("recommended", False), ("optional", None)) for r in x.get(key) or ())


def load(text: str) -> Profile:
    """A profile from JSON; keys left out take their defaults."""
    x = json.loads(text)
    types = tuple(TypeRule(t["type"], _rules(t.get("frontmatter") or {}), t.get("description"), t.get("pathPattern"), t.get("resourceScheme"), t.get("requireSchemaSection", False), tuple(t.get("schemaColumns") or ()), t.get("idPrefix")) for t in x.get("types") or ())
    return Profile(x["name"], x.get("okfVersion", "0.2"), _rules(x.get("frontmatter") or {}), types, x.get("description"), x.get("allowUnknownTypes", False), x.get("allowUnknownFields", True), x.get("idField"), x.get("requireBundleVersion"))


def _dump_rule(r: Rule) -> dict:
    cond = next((c for _, c in r.presence if c), None)
    return {
        "field": r.field, "description": r.description, "allowedValues": list(r.allowed), "cardinality": r.cardinality,
        "format": None if r.format is None else r.format[0] if r.format[1] is None else {r.format[0]: r.format[1]},
        "elementFields": None if r.elements is None else _dump_rules(r.elements), "reference": None if r.reference is None else {"localPrefix": r.reference.prefix, "externalUriSchemes": list(r.reference.schemes), "allowSelf": r.reference.allow_self, "allowLocal": r.reference.allow_local, "externalUriPattern": r.reference.pattern},
        "when": {"field": cond.field, "hasValue": list(cond.has_value)} if cond else None, "objectFields": None if r.members is None else _dump_rules(r.members),
        "path": None if r.path is None else {"externalUriSchemes": list(r.path.schemes), "allowSelf": r.path.allow_self}, "uniqueBy": r.unique_by}


def _dump_rules(rules) -> dict:
    kind = lambda r: r.presence[0][0] if r.presence else None
    return {name: [_dump_rule(r) for r in rules if kind(r) is want] for name, want in (("required", True), ("recommended", False), ("optional", None))}


def dump(p: Profile) -> str:
    """The stable JSON form of a profile; ``load`` reads it back."""
    types = [{"type": t.type, "description": t.description, "frontmatter": _dump_rules(t.rules), "pathPattern": t.path_pattern, "resourceScheme": t.resource_scheme, "requireSchemaSection": t.require_schema, "schemaColumns": list(t.schema_columns), "idPrefix": t.id_prefix} for t in p.types]
    return json.dumps({"name": p.name, "description": p.description, "okfVersion": p.version, "requireBundleVersion": p.require_bundle_version, "allowUnknownTypes": p.allow_unknown_types, "allowUnknownFields": p.allow_unknown_fields, "idField": p.id_field, "frontmatter": _dump_rules(p.rules), "types": types}, indent=2)


def refine(rule: Rule) -> Rule:
    """Vocabulary without repeats, and the cardinality that nested rules or the format imply."""
    shape = rule.cardinality
    if shape == ANY:
        if rule.members is not None and rule.elements is not None:
            shape = ANY
        elif rule.members is not None:
            shape = OBJECT
        elif rule.elements is not None:
            shape = LIST
        elif rule.format and rule.format[0] in _SCALAR_FORMATS:
            shape = SCALAR
    sub = lambda rs: None if rs is None else tuple(sorted((refine(r) for r in rs), key=lambda r: r.field))
    return replace(rule, allowed=tuple(dict.fromkeys(rule.allowed)), cardinality=shape, elements=sub(rule.elements), members=sub(rule.members))


def _narrow(a, b):
    """(merged, conflict) of two optional formats."""
    if a is None or b is None or a == b:
        return a or b, False
    if (a[0], b[0]) in _NARROWER:
        return b, False
    if (b[0], a[0]) in _NARROWER:
        return a, False
    return b, True


def merge(profile: Rule, own: Rule, scope: str | None, path: str, errors: list) -> Rule:
    """The rule that both scopes ask for; contradictions go to ``errors``."""
    def one(a, b, code):
        if a is not None and b is not None and a != b:
            errors.append((code, scope, path, f"{a} and {b}"))
        return b if b is not None else a

    allowed = own.allowed or profile.allowed
    if own.allowed and profile.allowed:
        allowed = tuple(v for v in profile.allowed if v in own.allowed)
        if not allowed:
            errors.append(("UnsatisfiableVocabulary", scope, path, f"{list(profile.allowed)} and {list(own.allowed)}"))
    shape = profile.cardinality if own.cardinality == ANY else own.cardinality
    if ANY not in (profile.cardinality, own.cardinality) and profile.cardinality != own.cardinality:
        errors.append(("ConflictingCardinality", scope, path, f"{profile.cardinality} and {own.cardinality}"))
    form, clash = _narrow(profile.format, own.format)
    if clash:
        errors.append(("ConflictingFieldFormat", scope, path, f"{profile.format} and {own.format}"))
    a, b = profile.reference, own.reference
    reference = b or a
    if a and b:
        one(a.prefix, b.prefix, "ConflictingReferencePrefix")
        pattern = one(a.pattern, b.pattern, "ConflictingExternalUriPatterns")
        reference = Reference(b.prefix, tuple(s for s in a.schemes if s in b.schemes), a.allow_self and b.allow_self, a.allow_local and b.allow_local, pattern)
    c, d = profile.path, own.path
    where = PathRule(tuple(s for s in c.schemes if s in d.schemes), c.allow_self and d.allow_self) if c and d else d or c

    def nested(x, y):
        if x is None or y is None:
            return y if y is not None else x
        return _merged(x, y, scope, path + ".", errors)

    return Rule(own.field, own.description or profile.description, allowed, shape, form, nested(profile.elements, own.elements), nested(profile.members, own.members), reference, where,
                one(profile.unique_by, own.unique_by, "ConflictingUniqueBy"), tuple(dict.fromkeys(profile.presence + own.presence)))


def _merged(a, b, scope, prefix, errors) -> tuple[Rule, ...]:
    left, right = {r.field: r for r in a}, {r.field: r for r in b}
    both = {k: merge(left[k], right[k], scope, prefix + k, errors) if k in left and k in right else left.get(k) or right[k] for k in {**left, **right}}
    return tuple(both[k] for k in sorted(both))


def _duplicates(names):
    return sorted({n for n in names if names.count(n) > 1})


def _check_scope(profile: Profile, rules, raw, scope, prefix, errors, version) -> None:
    """Errors of one scope's rules; ``raw`` as declared, ``rules`` by key after refinement."""
    by_kind: dict[str, set] = {}
    for r in raw:
        by_kind.setdefault(r.field, set()).add(r.presence[0][0] if r.presence else None)
    for name in _duplicates([r.field for r in raw]):
        errors.append(("ConflictingFieldRequirement" if len(by_kind[name]) > 1 else "DuplicateFieldRule", scope, prefix + name, ""))
    known = {r.field: r for r in rules}
    prefixes = {t.id_prefix for t in profile.types if t.id_prefix}
    for r in rules:
        path = prefix + r.field
        declared = next(x for x in raw if x.field == r.field)
        add = lambda code, detail="": errors.append((code, scope, path, detail))  # noqa: B023, E731
        if declared.elements is not None and declared.cardinality not in (ANY, LIST) and declared.members is None:
            add("ElementFieldsRequireList", declared.cardinality)
        if declared.members is not None and declared.cardinality in (SCALAR, LIST):
            add("ObjectFieldsRequireObjectShape", declared.cardinality)
        if r.format:
            name, value = r.format
            if name == "uriWithScheme" and not re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*", value or "") or name == "documentHandle" and not re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", value or ""):
                add("InvalidFormatParameter", value)
            if version and name in INTRODUCED and version < INTRODUCED[name]:
                add("FormatRequiresVersion", name)
        for kind, cond in r.presence:
            if cond is None:
                if version and kind is not None and not prefix and r.field in SUPERSEDED and version >= SUPERSEDED[r.field]:
                    add("FieldSupersededInVersion")
                continue
            if kind is None:
                add("OptionalFieldWithCondition")
            if not cond.has_value:
                add("EmptyConditionValues", cond.field)
            if cond.field == r.field:
                add("SelfConditionalField")
            elif cond.field not in known:
                add("ConditionFieldNotDeclared", cond.field)
            else:
                source = known[cond.field]
                if source.cardinality != SCALAR and not (source.cardinality == ANY and source.allowed):
                    add("ConditionFieldNotScalar", cond.field)
                elif not source.allowed:
                    add("ConditionFieldOpenVocabulary", cond.field)
                elif unreachable := [v for v in cond.has_value if v not in source.allowed]:
                    add("ConditionFieldHasUnreachableValues", f"{cond.field}: {unreachable}")
        if r.reference:
            if not re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", r.reference.prefix):
                add("InvalidReferencePrefix", r.reference.prefix)
            elif r.reference.allow_local and r.reference.prefix not in prefixes:
                add("ReferencePrefixNotDeclared", r.reference.prefix)
            if r.reference.allow_local and not profile.id_field:
                add("ReferenceRequiresIdField")
            if r.format:
                add("ReferenceWithFormat", str(r.format))
            if r.path:
                add("PathReferenceWithHandleReference")
            if r.reference.pattern is not None and (why := bad_pattern(r.reference.pattern)):
                add("InvalidExternalUriPattern", why)
        for s in (*(r.reference.schemes if r.reference else ()), *(r.path.schemes if r.path else ())):
            if not re.fullmatch(r"[a-z][a-z0-9+.-]*", s):
                add("InvalidExternalReferenceScheme", s)
        if r.unique_by is not None:
            member = {m.field: m for m in r.elements or ()}.get(r.unique_by)
            if r.elements is None:
                add("UniqueByRequiresElementFields", r.unique_by)
            elif member is None:
                add("UniqueByFieldNotDeclared", r.unique_by)
            else:
                if (True, None) not in member.presence:
                    add("UniqueByFieldNotUnconditionallyRequired", r.unique_by)
                if member.cardinality != SCALAR:
                    add("UniqueByFieldNotScalar", member.cardinality)
        for inner, was in ((r.elements, declared.elements), (r.members, declared.members)):
            if inner is not None:
                _check_scope(profile, inner, was if was is not None else inner, scope, path + ".", errors, version)


def bad_pattern(pattern: str) -> str | None:
    """Why ``pattern`` is no POSIX extended expression; None if it is one."""
    try:
        posix.to_java(pattern)
    except posix.PatternError as e:
        return str(e)
    return None


@dataclass(frozen=True)
class Compiled:
    """Merged rules: ``base`` for types without a rule of their own, ``by_type`` for the others; sorted by key."""

    profile: Profile
    base: tuple[Rule, ...]
    by_type: dict[str, tuple[Rule, ...]] = field(hash=False)


def compile_profile(p: Profile) -> Compiled:
    """Merges and checks a profile; ProfileError lists every contradiction."""
    errors: list = []
    version = parse_version(p.version)
    if version is None:
        errors.append(("InvalidProfileVersion", None, "", p.version))
    elif version[0] != KNOWN_VERSION[0]:
        errors.append(("ProfileVersionNotUnderstood", None, "", p.version))
        version = None
    else:
        version = min(version, KNOWN_VERSION)
    if p.require_bundle_version is not None and parse_version(p.require_bundle_version) is None:
        errors.append(("InvalidRequiredBundleVersion", None, "", p.require_bundle_version))
    errors += [("DuplicateTypeRule", name, "", "") for name in _duplicates([t.type for t in p.types])]
    first = lambda rules: tuple({r.field: r for r in reversed(rules)}[k] for k in sorted({r.field for r in rules}))
    base = tuple(refine(r) for r in first(p.rules))
    _check_scope(p, base, p.rules, None, "", errors, version)
    by_type = {}
    for t in p.types:
        own = tuple(refine(r) for r in first(t.rules))
        merged = _merged(base, own, t.type, "", errors)
        _check_type(p, merged, own, t, errors, version)
        by_type[t.type] = merged
    if errors:
        raise ProfileError(sorted(dict.fromkeys(errors), key=lambda e: (e[1] or "", e[2], e[0], e[3])))
    return Compiled(p, base, by_type)


def _check_type(p, merged, own, t, errors, version) -> None:
    """Checks a type's own rules; conditions may look at keys of the profile."""
    names = {r.field for r in own}
    found: list = []
    raw = tuple(t.rules) + tuple(r for r in merged if r.field not in names)
    _check_scope(p, merged, raw, t.type, "", found, version)
    errors += [e for e in found if e[2].split(".")[0] in names]


def check_filters(compiled: Compiled, types: list[str], filters) -> list[tuple[str, str, list[str]]]:
    """Filters that cannot match: (code, rendered filter, what is allowed). ``types`` restricts the scopes looked at.

    An undeclared key is an error unless it is a core key; a value must be in the union
    of the scopes' vocabularies, unless one of them leaves the key open.
    """
    from ..operators.filters import render

    p = compiled.profile
    scopes = [compiled.by_type[t] for t in types if t in compiled.by_type] if types else list(compiled.by_type.values())
    if not compiled.by_type or p.allow_unknown_types:
        scopes.append(compiled.base)
    out = []
    declared = sorted(compiled.by_type)
    for f in filters:
        if f.path == ("type",):
            if f.question == "equals" and not p.allow_unknown_types and declared and f.value not in declared:
                out.append(("ValueOutOfVocabulary", render(f), declared))
            continue
        found = []
        for rules in scopes or [compiled.base]:
            rule = next((r for r in rules if r.field == f.path[0]), None)
            if rule and len(f.path) == 2:
                subs = [r for r in (*(rule.elements or ()), *(rule.members or ())) if r.field == f.path[1]]
                if rule.elements is None and rule.members is None:
                    subs = [Rule(f.path[1])]
                rule = subs[0] if subs else None
                if rule is None:
                    found.append(None)
                    continue
            if rule:
                found.append(rule)
        rules = [r for r in found if r is not None]
        if not rules:
            core = f.path[0] in CORE_KEYS and not found
            if not core and f.path != (p.id_field,):
                out.append(("UndeclaredField", render(f), []))
        elif f.question == "equals" and all(r.allowed for r in rules):
            allowed = sorted({v for r in rules for v in r.allowed})
            if f.value not in allowed:
                out.append(("ValueOutOfVocabulary", render(f), allowed))
    return out
