"""Documentation of a profile as Markdown pages: one for the profile, one for each type. No clock: equal input, equal bytes."""

from __future__ import annotations

import itertools
import os
import re

from .profile import Compiled, Rule


def slugs(names: list[str]) -> list[str]:
    """A file name for each type, none twice: a name that is taken is numbered from the type's position on, an empty one always."""
    out: list[str] = []
    for position, name in enumerate(names, 1):
        stem = re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or f"type-{position}"
        numbered = (f"{stem}-{n}" for n in itertools.count(position))
        out.append(next(s for s in itertools.chain([stem], numbered) if s not in out))
    return out


def _phrases(r: Rule) -> list[str]:
    out = []
    if r.cardinality != "any":
        out.append(f"a {r.cardinality}" if r.cardinality != "object" else "an object")
    if r.allowed:
        out.append("one of " + ", ".join(f"`{v}`" for v in r.allowed))
    if r.format:
        out.append(f"format `{r.format[0]}`" + (f" `{r.format[1]}`" if r.format[1] else ""))
    if r.reference:
        parts = ([f"a handle `{r.reference.prefix}-N`"] if r.reference.allow_local else []) + [f"a `{s}:` URI" for s in r.reference.schemes]
        out.append("refers to " + " or ".join(parts))
    if r.path:
        out.append("a path in the bundle" + "".join(f" or a `{s}:` URL" for s in r.path.schemes))
    if r.unique_by:
        out.append(f"`{r.unique_by}` is unique in the list")
    for _, c in r.presence:
        if c:
            out.append(f"when `{c.field}` is " + " or ".join(f"`{v}`" for v in c.has_value))
    return out


def rule_lines(rules, depth: int = 0) -> list[str]:
    out = []
    for r in rules:
        need = "required" if any(k is True for k, _ in r.presence) else "recommended" if any(k is False for k, _ in r.presence) else "optional"
        out.append("  " * depth + f"- `{r.field}` ({need})" + (": " + "; ".join(_phrases(r)) if _phrases(r) else "") + (f" — {r.description}" if r.description else ""))
        for inner in (r.elements, r.members):
            out += rule_lines(inner or (), depth + 1)
    return out


def render(c: Compiled) -> dict[str, str]:
    """path -> text of every page."""
    p = c.profile
    names = slugs([t.type for t in p.types])
    root = [f"# {p.name}", ""] + ([p.description, ""] if p.description else []) + [f"Version `{p.version}`.", "", "## Every concept", "", *(rule_lines(c.base) or ["No rules."]), "", "## Types", ""]
    root += [f"- [{t.type}](types/{n}.md)" + (f" — {t.description}" if t.description else "") for t, n in zip(p.types, names, strict=True)] or ["No types."]
    pages = {"profile.md": "\n".join(root) + "\n"}
    for t, n in zip(p.types, names, strict=True):
        more = [s for s in (t.path_pattern and f"Path: `{t.path_pattern}`.", t.resource_scheme and f"Resource: `{t.resource_scheme}://`.", t.id_prefix and f"Handle: `{t.id_prefix}-N`.",
                            t.require_schema and "Schema section with columns " + ", ".join(f"`{x}`" for x in t.schema_columns) + ".") if s]
        text = [f"# {t.type}", ""] + ([t.description, ""] if t.description else []) + [x for s in more for x in (s, "")] + (rule_lines(c.by_type[t.type]) or ["No rules."])
        pages[f"types/{n}.md"] = "\n".join(text) + "\n"
    return pages


def write(c: Compiled, to: str) -> list[str]:
    """Writes the pages below ``to`` and returns other Markdown files found there, which stay."""
    pages = render(c)
    for path, text in pages.items():
        full = os.path.join(to, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8", newline="") as f:
            f.write(text)
    have = [os.path.relpath(os.path.join(at, f), to).replace(os.sep, "/") for at, _, files in os.walk(to) for f in files if f.endswith(".md")]
    return sorted(set(have) - set(pages))
