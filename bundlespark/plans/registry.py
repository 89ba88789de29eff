"""Finding profiles: descriptors on disk, registries of several, and where they come from."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from . import profile

#: Environment variables that name registries, and folders never looked into.
SOURCES_VARIABLE, LEGACY_VARIABLE = "BUNDLE_PROFILE_REGISTRIES", "BUNDLE_PROFILE_REGISTRY"
_PASSED_OVER = {"node_modules", "dist", "build", "target", "dist-newstyle", "__pycache__"}


@dataclass(frozen=True)
class Entry:
    """A profile found: its source, its dotted name there ('' for the whole file), and itself."""

    source: str
    name: str
    profile: profile.Profile


@dataclass(frozen=True)
class Failure:
    """category: missing, unreadable (not opened), malformed (no JSON), invalid (no profile where one should be) or empty."""

    source: str
    category: str
    message: str


def exports(value, name: str = "") -> list[tuple[str, profile.Profile]]:
    """Profiles in a JSON value: the value itself, or those under its fields by dotted name."""
    if not isinstance(value, dict):
        return []
    if isinstance(value.get("name"), str) and "frontmatter" in value:
        return [(name, profile.load(json.dumps(value)))]
    return [x for k in sorted(value) for x in exports(value[k], f"{name}.{k}" if name else k)]


def read(source: str) -> list[Entry] | Failure:
    """The profiles of one registry file; nothing is ever fetched."""
    try:
        with open(source, encoding="utf-8") as f:
            found = exports(json.load(f))
    except FileNotFoundError as e:
        return Failure(source, "missing", str(e))
    except OSError as e:
        return Failure(source, "unreadable", str(e))
    except json.JSONDecodeError as e:
        return Failure(source, "malformed", str(e))
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return Failure(source, "invalid", str(e))
    return [Entry(source, n, p) for n, p in found] or Failure(source, "empty", "no profile in it")


def sources(flags=(), environment=None, configured=(), built_in=(), local=()) -> list[str]:
    """Registries in order of precedence: flags, a JSON list in the environment, the older variable, configuration, built in; local ones are added."""
    environment = environment or {}
    chosen = list(flags)
    if not chosen and environment.get(SOURCES_VARIABLE):
        chosen = json.loads(environment[SOURCES_VARIABLE])
    if not chosen and environment.get(LEGACY_VARIABLE):
        chosen = [environment[LEGACY_VARIABLE]]
    return list(dict.fromkeys([*(chosen or configured or built_in), *local]))


def survey(refs: list[str]) -> tuple[list[Entry], list[Failure]]:
    """Entries of all sources in their order, each (source, name) once; failures are kept beside them."""
    entries, failures = [], []
    for ref in dict.fromkeys(refs):
        got = read(ref)
        if isinstance(got, Failure):
            failures.append(got)
        else:
            entries += got
    return entries, failures


def lookup(refs: list[str], name: str) -> profile.Profile:
    """The one profile of that dotted or own name; LookupError for none, several, or if any source failed."""
    entries, failures = survey(refs)
    if failures:
        raise LookupError("; ".join(f"{f.source}: {f.message}" for f in failures))
    found = [e for e in entries if name in (e.name, e.profile.name)]
    if len(found) != 1:
        raise LookupError(f"no profile {name!r}" if not found else f"{name!r} is ambiguous: " + ", ".join(f"{e.source}#{e.name}" for e in found))
    return found[0].profile


#: What the compact table cuts its columns and descriptions to.
WIDTHS, DESCRIPTION = (14, 28, 28, 3, 5, 12), 98
HEAD = ("SOURCE", "EXPORT", "NAME", "OKF", "TYPES", "ID FIELD")


def _cut(text: str, width: int) -> str:
    return text if len(text) <= width else text[:width - 1] + "\u2026"


def table(entries: list[Entry], wide: bool = False) -> list[str]:
    """A line with the identity of each profile and one with its description; columns as wide as needed, or cut to WIDTHS."""
    rows = [(HEAD, None)]
    for e in entries:
        p = e.profile
        rows.append(((e.source, e.name or "(root)", p.name, p.version, str(len(p.types)), p.id_field or "-"), " ".join((p.description or "-").split())))
    widths = [max(len(r[i]) for r, _ in rows) for i in range(len(HEAD))] if wide else WIDTHS
    out = []
    for cells, said in rows:
        shown = [_cut(c, w) for c, w in zip(cells, widths, strict=True)]
        out.append("  ".join(c.rjust(w) if i in (3, 4) else c.ljust(w) for i, (c, w) in enumerate(zip(shown, widths, strict=True))).rstrip())
        if said is not None:
            out.append("  " + (said if wide else _cut(said, DESCRIPTION)))
    return out


def detail(e: Entry) -> list[str]:
    """A profile's settings, a line each, then its rules by presence and its types with theirs."""
    from . import docgen

    p = e.profile
    flag = lambda x: "true" if x else "false"
    out = [f"export: {e.name or '(root)'}", f"name: {p.name}", f"description: {p.description or '(none)'}", f"okfVersion: {p.version}", f"requireBundleVersion: {p.require_bundle_version or '(none)'}",
           f"allowUnknownTypes: {flag(p.allow_unknown_types)}", f"allowUnknownFields: {flag(p.allow_unknown_fields)}", f"idField: {p.id_field or '(none)'}"]

    def rules(some, indent):
        for title, is_one in (("required", lambda r: any(k is True for k, _ in r.presence)), ("recommended", lambda r: any(k is False for k, _ in r.presence) and not any(k is True for k, _ in r.presence)), ("optional", lambda r: all(k is None for k, _ in r.presence))):
            own = [r for r in some if is_one(r)]
            yield f"{indent}frontmatter.{title}:" + ("" if own else " (none)")
            yield from (indent + "  " + line for line in docgen.rule_lines(own))

    compiled = profile.compile_profile(p)
    out += rules(compiled.base, "")
    for t in p.types:
        out += [f"type: {t.type}", f"  description: {t.description or '(none)'}", f"  pathPattern: {t.path_pattern or '(none)'}", f"  resourceScheme: {t.resource_scheme or '(none)'}", f"  idPrefix: {t.id_prefix or '(none)'}"]
        out += rules(compiled.by_type[t.type], "  ")
    return out


def discover(top: str, depth: int = 4) -> list[str]:
    """JSON files below ``top`` that hold a profile."""
    found = []
    for at, dirs, files in os.walk(top):
        level = 0 if at == top else os.path.relpath(at, top).count(os.sep) + 1
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in _PASSED_OVER and not os.path.islink(os.path.join(at, d))) if level < depth else []
        found += [os.path.join(at, f) for f in sorted(files) if f.endswith(".json") and isinstance(read(os.path.join(at, f)), list)]
    return found
