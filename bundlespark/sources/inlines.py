"""Inline Markdown as a tree: code spans, links, images, autolinks, raw HTML, footnote references, emphasis.

One pass over the text with the specification's two stacks. Brackets wait on one until a
']' decides what they are: a link makes every '[' before it literal, since no link holds
another, while images hold links. Runs of '*' and '_' wait on the other; closing one looks
back for its opener no further than earlier searches of its kind got. Work is in
proportion to the text.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

#: ASCII punctuation, which a backslash takes literally; the longest label of a reference; how deep parentheses go in a target.
_ESCAPABLE, _LONGEST_LABEL, _DEPTH = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), 999, 32
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")
_EMAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>")
_TAG = re.compile(r"""</?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>""", re.S)
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)
_TITLE = re.compile(r"""\s+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))""", re.S)
_ANGLE = re.compile(r"<((?:[^<>\n\\]|\\.)*)>")
_PLAIN = re.compile(r"[^\\`<\[\]!*_&]+")
_SPACE = re.compile(r"\s*")
_MARKS = frozenset("\\`<[]!*_&")
_BARE = re.compile(r"[^\\()\s\x00-\x1f]+")
#: What most targets are, and most links: nothing in them needs a look of its own.
_CLEAR = re.compile(r"\(([^\\()<&\s\x00-\x1f]+)\)")
_CLEAR_LINK = re.compile(r"\[([^\\`<\[\]!*_&]+)\]\(([^\\()<&\s\x00-\x1f]+)\)")
#: Such links whose text stays on its line, by their targets; all else that may mean something.
CLEAR_LINE = re.compile(r"\[[^\\`<\[\]!*_&\n]+\]\(([^\\()<&\s\x00-\x1f]+)\)")
MARK = re.compile(r"[\\`<\[\]!*_&]")


@dataclass(slots=True)
class Node:
    """kind: text, code, html, note, link, image, em or strong; text of the first four, target of links and images."""

    kind: str
    text: str = ""
    children: list[Node] = field(default_factory=list)


@dataclass(slots=True)
class _Run:
    """A run of one delimiter. What it closes stands before, what it opens after the marks that are left over."""

    char: str
    count: int
    opener: bool
    closer: bool
    size: int
    closes: list[int] = field(default_factory=list)
    opens: list[int] = field(default_factory=list)


@dataclass(slots=True)
class _Bracket:
    image: bool
    node: int  # its place among the nodes
    at: int  # where the text after it begins
    runs: int  # delimiters before it
    bracket_after: bool = False


def label(text: str) -> str:
    """Labels of references are alike but for case and white space."""
    return " ".join(text.casefold().split())


def decoded(text: str) -> str:
    """A target or title with entities and backslash escapes read."""
    if "&" in text:
        text = _ENTITY.sub(lambda e: html.unescape(e[0]), text)
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text) if "\\" in text else text


def _punctuation(c: str) -> bool:
    return unicodedata.category(c)[0] in "PS"


def _run(text: str, at: int, upto: int) -> _Run:
    before, after = text[at - 1] if at else " ", text[upto] if upto < len(text) else " "
    left = not after.isspace() and (not _punctuation(after) or before.isspace() or _punctuation(before))
    right = not before.isspace() and (not _punctuation(before) or after.isspace() or _punctuation(after))
    if text[at] == "*":
        return _Run("*", upto - at, left, right, upto - at)
    return _Run("_", upto - at, left and (not right or _punctuation(before)), right and (not left or _punctuation(after)), upto - at)


def _pair(runs: list[_Run]) -> None:
    """Pairs closers with openers and notes on both what they open and close."""
    if not runs:
        return
    back, bottom, at = list(range(-1, len(runs) - 1)), {}, 0  # back: the run before that is still in play
    while at < len(runs):
        closer = runs[at]
        if not closer.closer or not closer.count:
            at += 1
            continue
        kind = (closer.char, closer.opener, closer.size % 3)
        least, i = bottom.get(kind, -1), back[at]
        while i > least:
            opener = runs[i]
            odd = (opener.closer or closer.opener) and (opener.size + closer.size) % 3 == 0 and (opener.size % 3 or closer.size % 3)
            if opener.opener and opener.count and opener.char == closer.char and not odd:
                break
            i = back[i]
        if i > least:
            used = 2 if min(runs[i].count, closer.count) > 1 else 1
            runs[i].count -= used
            closer.count -= used
            runs[i].opens.append(used)
            closer.closes.append(used)
            back[at] = i if runs[i].count else back[i]
        else:
            bottom[kind] = back[at]
            if not closer.opener:
                if at + 1 < len(runs):
                    back[at + 1] = back[at]
            at += 1
            continue
        if not closer.count:
            if at + 1 < len(runs):
                back[at + 1] = back[at]
            at += 1


def _tree(flat: list) -> list[Node]:
    """Nodes and runs in order to nodes, emphasis as parents."""
    kinds_here = set(map(type, flat))
    if kinds_here <= {str}:
        whole = "".join(flat)
        return [Node("text", whole)] if whole else []
    if _Run not in kinds_here:
        out: list[Node] = []
        for same, some in groupby(flat, type):
            if same is Node:
                out += some
            elif whole := "".join(some):
                out.append(Node("text", whole))
        return out
    levels: list[list[Node]] = [[]]
    kinds: list[int] = []

    def text(s: str) -> None:
        if s:
            if levels[-1] and levels[-1][-1].kind == "text":
                parts = levels[-1][-1].children
                parts.append(s)
            else:
                levels[-1].append(Node("text", "", [s]))

    for x in flat:
        if isinstance(x, Node):
            levels[-1].append(x)
        elif isinstance(x, str):
            text(x)
        else:
            for used in x.closes:
                inner = levels.pop()
                kinds.pop()
                levels[-1].append(Node("strong" if used == 2 else "em", "", inner))
            text(x.char * x.count)
            for used in reversed(x.opens):
                levels.append([])
                kinds.append(used)
    for node in levels[0] if len(levels) == 1 else ():
        _joined(node)
    return levels[0]


def _joined(top: Node) -> None:
    todo = [top]
    while todo:
        node = todo.pop()
        if node.kind == "text":
            if node.children:
                node.text, node.children = node.text + "".join(node.children), []
        elif node.kind in ("em", "strong"):
            todo += node.children


def _target(text: str, at: int) -> tuple[str, int] | None:
    """(target, place after) of '(target "title")' at a place."""
    if not text.startswith("(", at):
        return None
    if m := _CLEAR.match(text, at):
        return m[1], m.end()
    at = _SPACE.match(text, at + 1).end()
    if m := _ANGLE.match(text, at):
        target, at = m[1], m.end()
    elif text.startswith("<", at):
        return None
    else:
        start, depth = at, 0
        while at < len(text):
            if m := _BARE.match(text, at):
                at = m.end()
                continue
            c = text[at]
            if c == "\\" and text[at + 1:at + 2] in _ESCAPABLE:
                at += 2
                continue
            if c == "(":
                depth += 1
                if depth > _DEPTH:
                    return None
            elif c == ")":
                if not depth:
                    break
                depth -= 1
            elif c.isspace() or c < " ":
                break
            at += 1
        if depth:
            return None
        target = text[start:at]
    if m := _TITLE.match(text, at):
        at = m.end()
    at = _SPACE.match(text, at).end()
    return (decoded(target), at + 1) if text.startswith(")", at) else None


def parse(text: str, known: dict[str, str]) -> list[Node]:
    """The inline nodes of a block; ``known`` has the targets of references by label."""
    ticks: dict[int, list[int]] = {}
    for m in re.finditer("`+", text) if "`" in text else ():
        ticks.setdefault(len(m[0]), []).append(m.start())
    flat: list = []
    runs: list[_Run] = []
    stack: list[_Bracket] = []
    literal = 0  # so many brackets at the stack's bottom can't open links any more
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c not in _MARKS:
            m = _PLAIN.match(text, i)
            flat.append(m[0])
            i = m.end()
        elif c == "\\":
            flat.append(text[i + 1] if text[i + 1:i + 2] in _ESCAPABLE and i + 1 < n else c)
            i += 1 + (i + 1 < n and text[i + 1] in _ESCAPABLE)
        elif c == "`":
            upto = i
            while upto < n and text[upto] == "`":
                upto += 1
            same = ticks.get(upto - i, [])
            end = bisect_right(same, i)
            if end < len(same):
                code = text[upto:same[end]].replace("\n", " ")
                flat.append(Node("code", code[1:-1] if code.strip(" ") and code[0] == code[-1] == " " else code))
                i = same[end] + upto - i
            else:
                flat.append(text[i:upto])
                i = upto
        elif c == "<":
            if m := _AUTOLINK.match(text, i):
                flat.append(Node("link", m[1], [Node("text", m[1])]))
            elif m := _EMAIL.match(text, i):
                flat.append(Node("link", "mailto:" + m[1], [Node("text", m[1])]))
            elif m := _TAG.match(text, i):
                flat.append(Node("html", m[0]))
            else:
                flat.append(c)
            i = m.end() if m else i + 1
        elif c == "&":
            m = _ENTITY.match(text, i)
            flat.append(html.unescape(m[0]) if m else c)
            i = m.end() if m else i + 1
        elif c in "*_":
            upto = i
            while upto < n and text[upto] == c:
                upto += 1
            run = _run(text, i, upto)
            runs.append(run)
            flat.append(run)
            i = upto
        elif c == "[" or c == "!" and text.startswith("[", i + 1):
            if stack:
                stack[-1].bracket_after = True
            if c == "[" and (m := _CLEAR_LINK.match(text, i)):
                flat.append(Node("link", m[2], [Node("text", m[1])]))
                i = m.end()
                literal = len(stack)
                continue
            i += 1 + (c == "!")
            stack.append(_Bracket(c == "!", len(flat), i, len(runs)))
            flat.append("[" if c == "[" else "![")
        elif c == "]" and stack:
            opener, place = stack.pop(), len(stack)
            dead = not opener.image and place < literal
            literal = min(literal, place)
            i += 1
            if dead:
                flat.append("]")
                continue
            found = _target(text, i)
            raw = text[opener.at:i - 1] if i - 1 - opener.at <= _LONGEST_LABEL else ""
            if not found and raw.startswith("^") and not opener.image and not opener.bracket_after:
                del flat[opener.node:], runs[opener.runs:]
                flat.append(Node("note", raw[1:]))
                continue
            if not found:
                m = _LABEL.match(text, i)
                name = m[1] if m and m[1].strip() else raw if not opener.bracket_after else ""
                target = known.get(label(name)) if name.strip() else None
                found = None if target is None else (target, m.end() if m else i)
            if not found:
                flat.append("]")
                continue
            inner, own = flat[opener.node + 1:], runs[opener.runs:]
            del flat[opener.node:], runs[opener.runs:]
            _pair(own)
            flat.append(Node("image" if opener.image else "link", found[0], _tree(inner)))
            i = found[1]
            if not opener.image:
                literal = place
        else:
            flat.append(c)
            i += 1
    _pair(runs)
    return _tree(flat)


def walk(nodes: list[Node]) -> Iterator[Node]:
    """All nodes, parents before children, in the order of the text."""
    todo = nodes[::-1]
    while todo:
        node = todo.pop()
        yield node
        todo += node.children[::-1]


def plain(nodes: list[Node]) -> str:
    """What a reader sees: text and code, of links and images what stands in their brackets."""
    return "".join(f"[^{x.text}]" if x.kind == "note" else x.text for x in walk(nodes) if x.kind in ("text", "code", "note"))
