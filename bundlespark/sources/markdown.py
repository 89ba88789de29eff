"""What the operators need of Markdown: links, code blocks, footnotes, tables, logs.

A block scanner (fenced and indented code, ATX and setext headings, lists, block quotes);
what stands in a block is a tree, see ``inlines``. HTML blocks hold no Markdown. Work is
in proportion to the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import inlines

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_ITEM = re.compile(r"^( {0,3})([-*+]|[0-9]{1,9}[.)])(?:( +)(.*)|)$")
#: The tags that begin an HTML block, and those whose block ends with their closing tag.
_HTML = re.compile(r"^ {0,3}</?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?:[\s/>]|$)", re.I)
_RAW = ((re.compile(r"^ {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
        (re.compile(r"^ {0,3}<!--"), re.compile("-->")), (re.compile(r"^ {0,3}<\?"), re.compile(r"\?>")), (re.compile(r"^ {0,3}<![A-Za-z]"), re.compile(">")))
#: First marks of fences, of the lines under a heading and of list items.
_FENCES, _UNDERLINES, _BULLETS = frozenset("`~"), frozenset("=-"), frozenset("-*+0123456789")
_QUOTED = re.compile(r"(?: {0,3}> ?)*")
#: What a line of plain text doesn't begin with.
_BLOCK = re.compile(r"^[^A-Za-z\[\n]", re.M)
_DEFINITION = re.compile(r"^ {0,3}\[(?!\^)([^\]]+)\]:[ \t]*<?([^\s>]+)>?")


@dataclass
class Block:
    """kind: heading, code, text or item; level of headings; text; depth of list items."""

    kind: str
    text: str
    level: int = 0
    children: list[str] = field(default_factory=list)


def blocks(body: str) -> list[Block]:
    """The blocks of a document in order; text inside lists and quotes is taken without its markers."""
    out: list[Block] = []
    para: list[str] = []
    lines = body.replace("\r\n", "\n").split("\n")
    i, in_list = 0, False

    def close():
        if para:
            out.append(Block("text", "\n".join(para)))
            para.clear()

    while i < len(lines):
        line = lines[i].expandtabs(4)
        if ">" in line:
            line = line[_QUOTED.match(line).end():]
        lead = line.lstrip()[:1]  # what a line can begin is told by its first mark
        fence = lead in _FENCES and (_FENCE.match(line) or (in_list and _FENCE.match(line.strip())))
        if fence and not (fence[1][0] == "`" and "`" in fence[2]):
            close()
            mark, code = fence[1], []
            indent = len(line) - len(line.lstrip())
            i += 1
            while i < len(lines) and not re.match(rf"^\s*{re.escape(mark[0])}{{{len(mark)},}}\s*$", lines[i]):
                code.append(re.sub(rf"^ {{0,{indent}}}", "", lines[i]))
                i += 1
            out.append(Block("code", "\n".join(code) + "\n" if code else ""))
        elif raw := next((end for begin, end in _RAW if begin.match(line)), None) if lead == "<" else None:
            close()
            while i < len(lines) and not raw.search(lines[i]):
                i += 1
        elif lead == "<" and _HTML.match(line):
            close()
            while i + 1 < len(lines) and lines[i + 1].strip():
                i += 1
        elif not lead:
            close()
            if i + 1 < len(lines) and lines[i + 1].strip() and not lines[i + 1].startswith(" ") and not _ITEM.match(lines[i + 1]):
                in_list = False
        elif lead == "#" and (m := _ATX.match(line)):
            close()
            in_list = False
            out.append(Block("heading", (m[2] or "").strip(), len(m[1])))
        elif para and not in_list and lead in _UNDERLINES and (m := re.match(r"^ {0,3}(=+|-+)\s*$", line)):
            text = "\n".join(para).strip()
            para.clear()
            out.append(Block("heading", text, 1 if m[1][0] == "=" else 2))
        elif not para and not in_list and line.startswith("    "):
            code = []
            while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                code.append(lines[i][4:])
                i += 1
            while code and not code[-1].strip():
                code.pop()
            out.append(Block("code", "\n".join(code) + "\n"))
            continue
        elif lead in _BULLETS and (m := _ITEM.match(line)) and not re.match(r"^ {0,3}([-*_])( *\1){2,} *$", line):
            close()
            in_list = True
            item = [m[4] or ""]
            width = len(m[1]) + len(m[2]) + len(m[3] or " ")
            while i + 1 < len(lines) and lines[i + 1].strip() and not _ITEM.match(lines[i + 1]) and not _ATX.match(lines[i + 1]) and not _FENCE.match(lines[i + 1].strip()):
                i += 1
                item.append(lines[i].strip() if not lines[i].startswith(" " * width) else lines[i][width:])
            out.append(Block("item", "\n".join(item)))
        else:
            para.append(line)
        i += 1
    close()
    return out


def _definitions(every: list[Block]) -> dict[str, str]:
    known: dict[str, str] = {}
    for b in every:
        if b.kind == "text" and "]:" in b.text:
            for line in b.text.split("\n"):
                if m := _DEFINITION.match(line):
                    known.setdefault(inlines.label(m[1]), inlines.decoded(m[2]))
    return known


def _trees(every: list[Block]):
    """The inline nodes of each block that isn't code and may hold a link, link definitions left out."""
    known = _definitions(every)
    for b in every:
        if b.kind != "code" and ("[" in b.text or "<" in b.text):
            text = "\n".join(line for line in b.text.split("\n") if not _DEFINITION.match(line)) if known and b.kind == "text" else b.text
            yield inlines.parse(text, known)


def _links(every: list[Block]) -> list[str]:
    return [x.text for nodes in _trees(every) for x in inlines.walk(nodes) if x.kind == "link"]


def links(body: str) -> list[str]:
    """Targets of links in document order, those in an image's text too; images aren't links, what stands in code doesn't count."""
    if "[" not in body and "<" not in body:
        return []
    # Lines that begin with a letter or a link begin no other block; where plain links hold all that has a meaning, they are all.
    if not _BLOCK.search(body):
        parts = inlines.CLEAR_LINE.split(body)
        if not inlines.MARK.search("".join(parts[::2])):
            return parts[1::2]
    return _links(blocks(body))


def computation_blocks(body: str) -> list[str]:
    """Code blocks of the first section titled 'computation', up to the next heading as shallow."""
    return _computation_blocks(blocks(body))


def _computation_blocks(every: list[Block]) -> list[str]:
    level, out = 0, []
    for b in every:
        if b.kind == "heading":
            if level and b.level <= level:
                break
            if not level and plain(b.text).strip().lower() == "computation":
                level = b.level
        elif level and b.kind == "code":
            out.append(b.text)
    return out


def footnotes(body: str) -> list[str]:
    """Labels of footnote references outside code, each once, in the order first seen; definitions don't count."""
    return _footnotes(blocks(body))


def _footnotes(every: list[Block]) -> list[str]:
    known, out = _definitions(every), []
    for b in every:
        if b.kind != "code" and "[^" in b.text:
            text = re.sub(r"(?m)^ {0,3}\[\^[^\]\s]+\]:", "", b.text)
            out += [x.text for x in inlines.walk(inlines.parse(text, known)) if x.kind == "note" and x.text and not re.search(r"\s", x.text)]
    return list(dict.fromkeys(out))


def schema_columns(body: str) -> list[str] | None:
    """The header of the first table after the first heading 'schema'; None without either."""
    return _schema_columns(blocks(body))


def _schema_columns(every: list[Block]) -> list[str] | None:
    seen = False
    for b in every:
        if b.kind == "heading" and plain(b.text).strip().lower() == "schema":
            seen = True
        elif seen and b.kind == "text":
            rows = b.text.split("\n")
            for head, rule in zip(rows, rows[1:]):
                if "|" in head and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", rule) and "-" in rule:
                    cells = re.split(r"(?<!\\)\|", head.strip().removeprefix("|").removesuffix("|"))
                    return [plain(c.strip()) for c in cells]
    return None


def plain(text: str) -> str:
    """Inline text without its marks."""
    return inlines.plain(inlines.parse(text, {}))


def parse_log(text: str) -> tuple[str, list[tuple[str, list[tuple[str | None, str]]]]]:
    """(title, [(date, [(kind, text)])]): first level-1 heading, level-2 headings, list items; a leading bold is the kind."""
    title, days = None, []
    for b in blocks(text):
        if b.kind == "heading" and b.level == 1 and title is None:
            title = plain(b.text)
        elif b.kind == "heading" and b.level == 2:
            days.append((plain(b.text), []))
        elif b.kind == "item" and days:
            m = re.match(r"\*\*(.*?)\*\*|__(.*?)__", b.text, re.S)
            if m and plain(m[1] or m[2] or ""):
                rest = b.text[m.end():].lstrip()
                days[-1][1].append((plain(m[1] or m[2]), rest.removeprefix(":").strip()))
            elif not m:
                days[-1][1].append((None, b.text.strip()))
    return title or "", days


FACTS = "links array<string>, computation_blocks array<string>, footnotes array<string>, schema_columns array<string>"


def facts(body: str | None) -> dict:
    """All that FACTS names of one body, whose blocks are found once."""
    body = body or ""
    every = blocks(body)
    # Most bodies lack what the later ones look for, and then need no look for it.
    return {"links": _links(every), "computation_blocks": _computation_blocks(every) if "computation" in body.lower() else [],
            "footnotes": _footnotes(every) if "[^" in body else [], "schema_columns": _schema_columns(every) if "schema" in body.lower() else None}


def _with_lists(concepts: DataFrame, name: str, of) -> DataFrame:
    import pandas as pd

    @F.pandas_udf("array<string>")
    def read(bodies):
        return pd.Series([of(b or "") for b in bodies], dtype=object)

    # Else the optimizer has it run once for a filter on the lists that it opens and once more for the lists.
    return concepts.withColumn(name, read.asNondeterministic()("body"))


def with_links(concepts: DataFrame) -> DataFrame:
    """``concepts`` with the links of each body only."""
    return _with_lists(concepts, "links", links)


def with_footnotes(concepts: DataFrame) -> DataFrame:
    """``concepts`` with the footnote labels of each body only."""
    return _with_lists(concepts, "footnotes", lambda body: footnotes(body) if "[^" in body else [])


def with_facts(concepts: DataFrame) -> DataFrame:
    """``concepts`` with what Markdown says of each body: one pass, batch by batch."""
    import pandas as pd

    @F.pandas_udf(FACTS)
    def read(bodies):
        return pd.DataFrame([facts(b) for b in bodies], columns=["links", "computation_blocks", "footnotes", "schema_columns"])

    return concepts.withColumn("_facts", read.asNondeterministic()("body")).select("*", "_facts.*").drop("_facts")


def log_rows(files: DataFrame) -> DataFrame:
    """Rows of operators.logs from (path, text) of log files; a log without days has one row whose day_pos is NULL."""
    def work(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                own = []
                for d, (date, entries) in enumerate(parse_log(text)[1]):
                    own += [(path, d, date, e, kind, said) for e, (kind, said) in enumerate(entries)] or [(path, d, date, None, None, None)]
                rows += own or [(path, None, None, None, None, None)]
            out = pd.DataFrame(rows, columns=["log_path", "day_pos", "date", "entry_pos", "kind", "text"])
            yield out.astype({"day_pos": "Int32", "entry_pos": "Int32"})

    return files.select("path", "text").mapInPandas(work, "log_path string, day_pos int, date string, entry_pos int, kind string, text string")
