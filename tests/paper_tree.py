"""Sections and tables of a page by a small element tree: what the relational form is compared with."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from quillgraph.sources.papers import APPENDIX, LEFT_OUT

_NO_END = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADING = re.compile("h[1-6]$")


class Node:
    __slots__ = ("name", "kinds", "parent", "parts")

    def __init__(self, name: str, kinds: str = "", parent: Node | None = None) -> None:
        self.name, self.kinds, self.parent = name, kinds, parent
        self.parts: list[Node | str] = []

    def elements(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node) and p.name != "!"]

    def walk(self) -> Iterator[Node]:
        for e in self.elements():
            yield e
            yield from e.walk()

    def first(self, test) -> Node | None:
        return next((e for e in self.walk() if test(e)), None)

    def strings(self) -> Iterator[str]:
        for p in self.parts:
            if isinstance(p, str):
                if p.strip():
                    yield p.strip()
            elif p.name not in ("script", "style"):  # their text counts only where they are asked themselves
                yield from p.strings()

    def text(self, between: str = "") -> str:
        return between.join(self.strings())


class _Builder(HTMLParser):
    """A tree without math annotations, which repeat what stands beside them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        n = Node(tag, dict(attrs).get("class") or "", self.at)
        self.at.parts.append(n)
        if tag not in _NO_END:
            self.at = n

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.name != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent
        else:
            self.at.parts.append(Node("!"))  # what stands on both sides stays apart

    def handle_data(self, data: str) -> None:
        if self.at.parts and isinstance(self.at.parts[-1], str):
            self.at.parts[-1] += data
        else:
            self.at.parts.append(data)

    def handle_comment(self, data: str) -> None:
        self.at.parts.append(Node("!"))


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    for e in [b.top, *b.top.walk()]:
        e.parts = [p for p in e.parts if not (isinstance(p, Node) and p.name in ("annotation", "annotation-xml"))]
    return b.top


def _is_heading(e: Node) -> bool:
    return bool(_HEADING.match(e.name))


def _left_out(header: str) -> bool:
    low = header.lower()
    return low.startswith(LEFT_OUT) or "paper checklist" in low.split("\n")[0]


def clean_header(raw: str) -> str | None:
    """A header without numbering, appendices marked Apdx; None if the section is left out."""
    header = re.sub(r"^[\d.]+\s*", "", re.sub(r"^[IVXLC]+(?=[A-Z])", "", raw))
    if _left_out(header):
        return None
    low = header.lower()
    start = next((a for a in APPENDIX if low.startswith(a)), None)
    if start is not None:
        rest = re.sub(r"^[\d.]+\s*", "", re.sub(r"^\s*:?\s*", "", header[len(start) :]))
        lettered = re.match(r"[A-Z]", rest)
        mark, title = ("Apdx_" + rest[0], re.sub(r"^[\s:]*", "", rest[1:]).strip()) if lettered else ("Apdx", rest.strip())
        return f"{mark}: {title}" if title else mark
    numbered = re.match(r"([AS])\.(\d+)\s*(.*)", header)
    if numbered:
        mark, title = f"Apdx_{numbered[1]}.{numbered[2]}", numbered[3].strip()
        return f"{mark}: {title}" if title else mark
    return header


def sections(top: Node) -> list[dict]:
    """Sections by h2; by h3 if that gives more and h2 gives one at most; else the outermost; without
    any section element, what stands between headings."""
    every = [e for e in top.walk() if e.name == "section"]
    own = [(s, next((c for c in s.elements() if _is_heading(c)), None)) for s in every]
    by = {n: [(s, h) for s, h in own if h is not None and h.name == n] for n in ("h2", "h3")}
    chosen = by["h3"] if len(by["h2"]) <= 1 and len(by["h3"]) > len(by["h2"]) else by["h2"]
    if not chosen:
        outer = [s for s in every if not any(a.name == "section" for a in _above(s))]
        chosen = [(s, h) for s in outer if (h := s.first(_is_heading)) is not None]
    out = []
    for s, h in chosen:
        raw = h.text()
        header = clean_header(raw)
        if header is None:
            continue
        for inner in [e for e in s.walk() if e.name == "section"]:
            head = inner.first(_is_heading)
            if head is not None and _left_out(re.sub(r"^[\d.]+\s*", "", head.text())):
                for e in [inner, *inner.walk()]:  # and all inside, also for later sections
                    e.parts = []
        text = s.text(" ")
        text = text[len(raw) :].strip() if text.startswith(raw) else text
        if text:
            out.append({"header": header, "text": text})
    return out or _between_headings(top)


def _above(e: Node) -> Iterator[Node]:
    while e.parent is not None:
        e = e.parent
        yield e


def _between_headings(top: Node) -> list[dict]:
    out = []
    for h in [e for e in top.walk() if _is_heading(e)]:
        header = re.sub(r"^[\d.]+\s*", "", h.text())
        if _left_out(header):
            continue
        after = h.parent.elements()
        body = []
        for e in after[after.index(h) + 1 :]:
            if _is_heading(e):
                break
            if (t := e.text(" ")) != "":
                body.append(t)
        if body:
            out.append({"header": header, "text": "\n\n".join(body)})
    return out


def tables(top: Node) -> list[dict]:
    """Tables in marked containers with their captions; without any, plain tables of two rows or more."""

    def rows(t: Node) -> list[list[str]]:
        lines = ([c.text() for c in r.walk() if c.name in ("td", "th")] for r in t.walk() if r.name == "tr")
        return [x for x in lines if x]

    out = []
    for e in top.walk():
        if "ltx_table" in e.kinds or "table-wrapper" in e.kinds:
            t, c = e.first(lambda x: x.name == "table"), e.first(lambda x: "caption" in x.kinds)
            if t is not None and (r := rows(t)):
                out.append({"caption": c.text() if c is not None else "", "rows": r})
    return out or [{"caption": "", "rows": r} for e in top.walk() if e.name == "table" and len(r := rows(e)) > 1]


