"""POSIX extended regular expressions as Java patterns that match the same texts as a whole.

As the reference reads them: '.' and negated brackets don't match a newline, '^' and '$'
hold at the borders of lines, a backslash takes the next character literally but for the
word and text borders. Brackets follow POSIX: a ']' first is literal, so are backslashes
and '&'; classes, single collating elements and equivalence classes are known.
"""

from __future__ import annotations

import re

#: The named classes, in ASCII.
CLASSES = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "blank": "\t ", "cntrl": "\x00-\x1f\x7f", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": "!-/:-@[-`{-~", "space": "\t-\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f"}
#: The largest bound of an interval.
MOST = 255
_WORD = "[0-9A-Za-z_]"
_BORDERS = {"`": r"\A", "'": r"\z", "<": rf"(?<!{_WORD})(?={_WORD})", ">": rf"(?<={_WORD})(?!{_WORD})",
            "b": rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))", "B": rf"(?:(?<!{_WORD})(?!{_WORD})|(?<={_WORD})(?={_WORD}))"}


class PatternError(ValueError):
    """Why a text is no POSIX extended expression."""


def _char(c: str) -> str:
    return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}"


def _span(low: str, high: str) -> str:
    return _char(low) if low == high else f"{_char(low)}-{_char(high)}"


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self, n: int = 1) -> str:
        return self.text[self.at:self.at + n]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def whole(self) -> str:
        out = self.branches()
        if self.at < len(self.text):
            raise PatternError(f"{self.peek()!r} at {self.at} has nothing to close")
        return out

    def branches(self) -> str:
        out = [self.branch()]
        while self.peek() == "|":
            self.take()
            out.append(self.branch())
        return "|".join(out)

    def branch(self) -> str:
        out = []
        while self.peek() and self.peek() not in "|)":
            out.append(self.piece())
        if not out:
            raise PatternError(f"an alternative at {self.at} is empty")
        return "".join(out)

    def piece(self) -> str:
        out = self.atom()
        if self.peek() and self.peek() in "*+?":
            return f"(?:{out}){self.take()}"
        if m := re.compile(r"\{([0-9]+)(,([0-9]*))?\}").match(self.text, self.at):
            low, high = int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1])
            if max(low, high or 0) > MOST or high is not None and high < low:
                raise PatternError(f"the interval {m[0]} is out of range")
            self.at = m.end()
            return f"(?:{out}){{{low}{'' if high == low else ',' + ('' if high is None else str(high))}}}"
        return out

    def atom(self) -> str:
        c = self.take()
        if c == "(":
            out = self.branches()
            if self.peek() != ")":
                raise PatternError("a group is not closed")
            self.take()
            return f"(?:{out})"
        if c == "[":
            return self.bracket()
        if c == "\\":
            if not self.peek():
                raise PatternError("ends in a backslash")
            return _BORDERS.get(c := self.take()) or _char(c)
        if c in "*+?" or c == "{" and self.peek().isdigit():
            raise PatternError(f"{c!r} at {self.at - 1} repeats nothing")
        return {".": r"[^\n]", "^": r"(?<![^\n])", "$": r"(?![^\n])"}.get(c) or _char(c)

    def bracket(self) -> str:
        negated = self.peek() == "^"
        self.at += negated
        out, first = [], True
        while first or self.peek() != "]":
            if not self.peek():
                raise PatternError("a bracket is not closed")
            if self.peek(2) == "[:":
                name = self.named(":")
                if name not in CLASSES:
                    raise PatternError(f"there is no class {name!r}")
                spans = re.findall("(.)-(.)|(.)", CLASSES[name], re.S)
                out += [_span(a, b) if a else _char(c) for a, b, c in spans]
            else:
                low = high = self.element()
                if self.peek() == "-" and self.peek(2) not in ("-", "-]"):
                    self.take()
                    high = self.element()
                    if high < low:
                        raise PatternError(f"the range {low}-{high} is reversed")
                out.append(_span(low, high))
            first = False
        self.take()
        return f"[{'^' if negated else ''}{''.join(out)}{chr(92) + 'n' if negated else ''}]"

    def named(self, mark: str) -> str:
        end = self.text.find(mark + "]", self.at + 2)
        if end < 0:
            raise PatternError(f"'[{mark}' is not closed")
        name, self.at = self.text[self.at + 2:end], end + 2
        return name

    def element(self) -> str:
        for mark in ".=":
            if self.peek(2) == "[" + mark:
                name = self.named(mark)
                if len(name) != 1:
                    raise PatternError(f"{name!r} is no single character")
                return name
        return self.take()


def to_java(pattern: str) -> str:
    """The Java pattern; PatternError if ``pattern`` isn't POSIX extended."""
    return _Parser(pattern).whole()


def whole(pattern: str) -> str:
    """A Java pattern that finds exactly the texts that ``pattern`` matches as a whole."""
    return rf"\A(?:{to_java(pattern)})\z"
