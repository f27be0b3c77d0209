"""Block structure of markdown by the open-block stack of CommonMark, with tables.

A line first goes down the open containers (quotes, lists, items) as far as it continues them; then new blocks are tried at
that place; text that starts none may still continue the innermost paragraph (lazy continuation). Only top-level blocks are
returned, but nested ones decide where these end. Tables are looked for at the top level alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

PAGE = re.compile(r"<!--\s*page:\s*(\d+)\s*-->", re.I)
ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"(`{3,}|~{3,})(.*)$")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
MARKER = re.compile(r"([-+*]|(\d{1,9})([.)]))(?= |$)")
SETEXT = re.compile(r"(=+|-+) *$")
DELIMITER = re.compile(r"[|\-: ]+$")
#: Names of tags that start an html block up to the next blank line (fixed values of the specification).
BLOCK_TAGS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
_ATTRIBUTE = r"""\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
#: Starts of html blocks and what ends them: a pattern within a line, or the next blank line (None).
HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?=\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(BLOCK_TAGS.split())})(?=\s|/?>|$)", re.I), None),
]
#: A whole tag alone on its line; it starts a block too, but not within a paragraph.
HTML_TAG = re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*(?:{_ATTRIBUTE})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$")
_LABEL = r"\[(?:[^\[\]\\]|\\.){1,999}\]"
_TITLE = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))"""
_TARGET = r"(?:<(?:[^<>\\\n]|\\.)*>|[^\s<]\S*)"
REFERENCE = re.compile(rf" {{0,3}}({_LABEL}):[ \t]*\n?[ \t]*{_TARGET}(?:(?:[ \t]+|[ \t]*\n[ \t]*){_TITLE}[ \t]*(?=\n|\Z)|[ \t]*(?=\n|\Z))")


@dataclass(frozen=True)
class Block:
    kind: str
    tag: str
    source: str
    level: int = 0
    heading: str | None = None
    page: int | None = None


@dataclass
class _Container:
    """A quote, a list (with its marker) or an item (with the width of its indent, its line, and whether it began blank)."""

    kind: str
    marker: str = ""
    width: int = 0
    line: int = 0
    blank: bool = False


@dataclass
class _Leaf:
    """The innermost block that lines go on: paragraph, fence, code, html or table."""

    kind: str
    line: int
    end: object = None


@dataclass
class _Top:
    kind: str
    tag: str
    first: int
    last: int
    level: int = 0
    heading: str | None = None


def _references(text: str) -> int:
    """How many lines of a paragraph are link definitions at its start."""
    at = 0
    while (m := REFERENCE.match(text, at)) and m[1].strip("[] \t\n"):
        at = m.end() + 1
        if at > len(text):
            break
    return text[:at].count("\n") + (at > len(text))


def _cells(line: str) -> list[str]:
    cells = [c.strip() for c in re.split(r"(?<!\\)\|", line.strip())]
    return cells[not cells[0] : len(cells) - (len(cells) > 1 and not cells[-1])]


@dataclass
class _Parser:
    lines: list[str]
    tops: list[_Top] = field(default_factory=list)
    stack: list[_Container] = field(default_factory=list)
    leaf: _Leaf | None = None

    def table_at(self, i: int) -> bool:
        """Whether a table's head and delimiter row stand at a line."""
        if i + 1 >= len(self.lines) or "|" not in self.lines[i]:
            return False
        row = self.lines[i + 1].expandtabs(4)
        bare = row.strip()
        if len(row) - len(row.lstrip()) > 3 or len(bare) < 2 or not DELIMITER.match(bare) or bare[:2] in ("- ", "  "):
            return False
        marks = _cells(bare)
        return bool(marks) and all(re.fullmatch(":?-+:?", c) for c in marks) and len(marks) == len(_cells(self.lines[i]))

    def open(self, kind: str, tag: str, i: int, **more) -> None:
        """A new block at the present place; at the top level it is one of the result."""
        if not self.stack:
            self.tops.append(_Top(kind, tag, i, i + 1, **more))

    def drop_list(self) -> None:
        """A list ends where something other than an item follows in it."""
        if self.stack and self.stack[-1].kind == "list":
            self.stack.pop()

    def close_paragraph(self) -> None:
        """A finished top-level paragraph loses its link definitions, and is none where nothing else is left."""
        if self.leaf and self.leaf.kind == "paragraph" and not self.stack:
            top = self.tops[-1]
            top.first += _references("\n".join(self.lines[top.first : top.last]))
            if top.first >= top.last:
                self.tops.pop()
        self.leaf = None

    def descend(self, i: int, s: str) -> tuple[int, int]:
        """How many open containers the line continues, and where its rest begins."""
        at = 0
        for depth, box in enumerate(self.stack):
            rest = s[at:]
            indent, blank = len(rest) - len(rest.lstrip(" ")), not rest.strip()
            if box.kind == "quote":
                if blank or indent > 3 or rest[indent] != ">":
                    return depth, at
                at += indent + 1
                at += s[at : at + 1] == " "
            elif box.kind == "item":
                if blank:
                    if box.blank and i == box.line + 1:
                        return depth, at
                elif indent >= box.width:
                    at += box.width
                else:
                    return depth, at
        return len(self.stack), at

    def keep(self, depth: int) -> None:
        """Closes the containers below a depth, and with them the leaf."""
        if depth < len(self.stack):
            self.close_paragraph()
            del self.stack[depth:]

    def line(self, i: int) -> None:
        s = self.lines[i].expandtabs(4)
        depth, at = self.descend(i, s)
        blank = not s[at:].strip()
        whole = depth == len(self.stack)
        leaf = self.leaf
        if leaf and leaf.kind != "paragraph":
            if not whole:
                self.leaf = leaf = None
            elif self.goes_on(leaf, i, s[at:], blank):
                if self.tops and (not blank or leaf.kind in ("fence", "html")):
                    self.tops[-1].last = i + 1
                return
        if blank:
            if self.leaf:
                self.close_paragraph()
            cut = next((d for d in range(depth, len(self.stack)) if self.stack[d].kind == "quote" or self.stack[d].blank), None)
            if cut is not None:
                self.keep(cut)
            return
        self.start(i, s, at, depth, whole)
        self.tops[-1].last = i + 1

    def goes_on(self, leaf: _Leaf, i: int, rest: str, blank: bool) -> bool:
        """Whether a line belongs to an open leaf; a leaf that ends with it or before it is closed."""
        indent = len(rest) - len(rest.lstrip(" "))
        if leaf.kind == "fence":
            if indent <= 3 and leaf.end.fullmatch(rest.strip()):
                self.leaf = None
            return True
        if leaf.kind == "html":
            if leaf.end is None and blank:
                self.leaf = None
                return False
            if leaf.end is not None and leaf.end.search(rest):
                self.leaf = None
            return True
        if leaf.kind == "code":
            if blank or indent >= 4:
                return True
        elif i == leaf.line + 1 or not (blank or indent >= 4 or self.interrupts(rest.lstrip(" "))):
            return True
        self.leaf = None
        return False

    @staticmethod
    def fence(rest: str) -> re.Match | None:
        m = FENCE.match(rest)
        return m if m and not (m[1][0] == "`" and "`" in m[2]) else None

    def interrupts(self, rest: str) -> bool:
        """Whether text (without indent) starts a block that may follow a paragraph or table without a blank line."""
        item = MARKER.match(rest)
        listed = bool(item and rest[item.end() :].strip() and (not item[2] or int(item[2]) == 1))
        return bool(rest[:1] == ">" or ATX.match(rest) or self.fence(rest) or RULE.match(rest) or listed or any(a.match(rest) for a, _ in HTML))

    def start(self, i: int, s: str, at: int, depth: int, whole: bool) -> None:
        """Opens what a line starts below ``depth`` open containers, or adds it to the paragraph."""
        paragraph = self.leaf is not None
        while True:
            rest = s[at:]
            indent = len(rest) - len(rest.lstrip(" "))
            rest = rest.lstrip(" ")
            if not rest:  # an empty item or quote
                return
            if indent >= 4:
                if paragraph:
                    return
                self.keep(depth)
                self.drop_list()
                self.open("code", "code", i)
                self.leaf = _Leaf("code", i)
                return
            tip = self.stack[depth - 1] if depth else None
            if paragraph and whole and depth == len(self.stack) and (m := SETEXT.match(rest)):
                if self.stack:
                    self.leaf = None
                    return
                top = self.tops[-1]
                body = self.lines[top.first : i]
                if (gone := _references("\n".join(body))) < len(body):
                    level = 1 if m[1][0] == "=" else 2
                    top.first += gone
                    top.kind, top.tag, top.level, top.heading = "heading", f"h{level}", level, "\n".join(x.strip() for x in body[gone:])
                    self.leaf = None
                    return
            if rest[0] == ">":
                self.keep(depth)
                self.close_paragraph()
                self.drop_list()
                self.open("blockquote", "blockquote", i)
                self.stack.append(_Container("quote"))
                at += indent + 1
                at += s[at : at + 1] == " "
            elif (item := None if RULE.match(rest) else MARKER.match(rest)) and not (paragraph and not (tip and tip.kind == "list") and not self.interrupts(rest)):
                after = rest[item.end() :]
                gap = len(after) - len(after.lstrip(" "))
                empty = not after.strip()
                gap = 1 if empty or gap > 4 else gap
                marker = item[3] or item[1]
                self.keep(depth)
                self.close_paragraph()
                if not (self.stack and self.stack[-1].kind == "list" and self.stack[-1].marker == marker):
                    self.drop_list()
                    self.open("list", "ol" if item[2] else "ul", i)
                    self.stack.append(_Container("list", marker))
                self.stack.append(_Container("item", width=indent + item.end() + gap, line=i, blank=empty))
                at += indent + item.end() + gap
            else:
                self.leaf_at(i, rest, depth, paragraph)
                return
            depth, paragraph, whole = len(self.stack), False, False

    def leaf_at(self, i: int, rest: str, depth: int, paragraph: bool) -> None:
        def fresh(kind: str, tag: str, leaf: _Leaf | None, **more) -> None:
            self.keep(depth)
            self.close_paragraph()
            self.drop_list()
            self.open(kind, tag, i, **more)
            self.leaf = leaf

        if m := ATX.match(rest):
            text = (m[2] or "").strip()
            fresh("heading", f"h{len(m[1])}", None, level=len(m[1]), heading=text.strip("#") and text)
        elif m := self.fence(rest):
            fresh("code", "code", _Leaf("fence", i, re.compile(re.escape(m[1][0]) + f"{{{len(m[1])},}}")))
        elif RULE.match(rest):
            fresh("hr", "hr", None)
        elif html := next(((a, end) for a, end in HTML if a.match(rest)), None):
            fresh("html", "html", None if html[1] and html[1].search(rest) else _Leaf("html", i, html[1]))
        elif not paragraph and HTML_TAG.match(rest):
            fresh("html", "html", _Leaf("html", i, None))
        elif depth == 0 and self.table_at(i) and not (paragraph and self.stack):
            fresh("table", "table", _Leaf("table", i))
        elif not paragraph:
            fresh("paragraph", "p", _Leaf("paragraph", i))


def parse_blocks(markdown: str) -> list[Block]:
    """Top-level blocks in order, each with its source lines right-stripped."""
    lines = re.sub(r"\r\n?", "\n", markdown).split("\n")
    parser = _Parser(lines)
    for i in range(len(lines)):
        parser.line(i)
    parser.stack.clear() if parser.stack else parser.close_paragraph()
    out = []
    for top in parser.tops:
        source = "\n".join(lines[top.first : top.last]).rstrip()
        if top.kind == "html":
            page = PAGE.search(source)
            out.append(Block("page_marker", "html", source, page=int(page[1])) if page else Block("other", "html", source))
        else:
            out.append(Block(top.kind, top.tag, source, top.level, top.heading))
    return out
