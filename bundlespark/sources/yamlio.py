"""Frontmatter: a YAML mapping between '---' fences, to JSON and back.

Dates and times stay text. Of YAML 1.1's spellings only true/false are booleans and only
plain decimal numbers are numbers; yes, 010 and 1:30 stay text. A key given twice is an
error. Decimals keep their digits.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

import yaml

from ..operators.concepts import CORE_KEYS as CORE



class DocumentError(ValueError):
    """A document whose frontmatter cannot be read."""


class _Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    yaml_implicit_resolvers: dict = {}

    def construct_mapping(self, node, deep=False):
        seen = set()
        for key, _ in node.value:
            k = key.value
            if k in seen:
                raise DocumentError(f"key {k!r} is given twice")
            seen.add(k)
        return {str(k.value): self.construct_object(v, deep=True) for k, v in node.value}


_RESOLVERS = (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("int", r"^[-+]?(?:0|[1-9][0-9]*)$", "-+0123456789"),
    ("float", r"^[-+]?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?$", "-+0123456789"),
)
for _tag, _pattern, _first in _RESOLVERS:
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), list(_first))
_Loader.add_constructor("tag:yaml.org,2002:int", lambda loader, node: int(node.value))
_Loader.add_constructor("tag:yaml.org,2002:float", lambda loader, node: Decimal(node.value))
_Loader.add_constructor("tag:yaml.org,2002:map", lambda loader, node: loader.construct_mapping(node, deep=True))


def to_json(o) -> str:
    """JSON text; decimals keep their digits, integers any size."""
    if isinstance(o, Decimal):
        return str(o)
    if isinstance(o, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{to_json(v)}" for k, v in o.items()) + "}"
    if isinstance(o, list):
        return "[" + ",".join(map(to_json, o)) + "]"
    return json.dumps(o, ensure_ascii=False)


def parse(text: str) -> tuple[dict, str]:
    """(frontmatter, body) of a document; without an opening fence all of it is body."""
    m = re.match(r"---\r?\n", text)
    if not m:
        return {}, text
    end = re.compile(r"^---[ \t]*\r?$", re.M).search(text, m.end())
    if not end:
        raise DocumentError("the frontmatter is not closed")
    try:
        found = yaml.load(text[m.end():end.start()], _Loader)  # noqa: S506  a SafeLoader
    except yaml.YAMLError as e:
        raise DocumentError(f"the frontmatter is no YAML: {str(e).splitlines()[0]}") from e
    if found is None:
        found = {}
    if not isinstance(found, dict):
        raise DocumentError("the frontmatter is not a mapping")
    rest = text[end.end():]
    rest = re.sub(r"^\r?\n", "", rest, count=1)
    return found, re.sub(r"^\r?\n", "", rest, count=1)


#: Plain scalars that would be read as something else than text.
_OTHER = re.compile("|".join(p for _, p, _ in _RESOLVERS) + r"|^(?:\.\.\.|-)(?: |$)")
#: Characters that YAML takes only escaped, or takes for a line's end.
_UNPRINTABLE = re.compile("[\x7f-\x9f\u2028\u2029\ud800-\udfff\ufeff\ufffe\uffff]")


def _scalar(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float, Decimal)):
        return str(v)
    plain = re.fullmatch(r"[A-Za-z0-9_/.][A-Za-z0-9_/.@ +-]*(?::(?! )[A-Za-z0-9_/.@+-]+)*", v) and v == v.strip()
    if plain and v != "---" and not _OTHER.match(v) and not v.startswith("- "):
        return v
    return _UNPRINTABLE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(v, ensure_ascii=False))


def _lines(v, indent: int, ranked: bool = True):
    pad = "  " * indent
    if isinstance(v, dict):
        for k in sorted(v, key=lambda k: (CORE.index(k) if ranked and k in CORE else len(CORE), k)):
            x = v[k]
            if isinstance(x, (dict, list)) and x:
                yield f"{pad}{_scalar(k)}:"
                yield from _lines(x, indent + (isinstance(x, dict)), False)
            else:
                yield f"{pad}{_scalar(k)}: " + ("{}" if x == {} and isinstance(x, dict) else "[]" if isinstance(x, list) else _scalar(x))
    else:
        for x in v:
            if isinstance(x, (dict, list)) and x:
                inner = list(_lines(x, indent + 1, False))
                yield f"{pad}- {inner[0].lstrip()}"
                yield from inner[1:]
            else:
                yield f"{pad}- " + ("{}" if isinstance(x, dict) else "[]" if isinstance(x, list) else _scalar(x))


def serialize(frontmatter: dict, body: str) -> str:
    """The document's text: core keys in their order, others by name, body ending in one newline at least."""
    head = "---\n" + "".join(line + "\n" for line in _lines(frontmatter, 0)) + "---\n\n" if frontmatter else ""
    return head + body + ("" if body.endswith("\n") or not body else "\n")
