"""HTML fragments as Markdown: a scanner cuts a text into events, and a stack of open elements folds them into lines."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from loomspark.functions import fences

# The tags that are taken for markup; anything else in angle brackets is a placeholder and stays.
KNOWN = {
    "a", "abbr", "b", "blockquote", "br", "caption", "center", "code", "col", "colgroup", "dd", "div", "dl", "dt", "em", "figcaption", "figure", "font", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "i", "img", "kbd", "label",
    "li", "nobr", "ol", "p", "pre", "q", "s", "samp", "section", "small", "span", "strong", "sub", "sup", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "tt", "u", "ul", "var",
}
#: Elements that have no content.
_VOID = {"br", "col", "hr", "img"}
#: Elements that an opening tag ends where their own closing tag was left out, up to the element that holds them.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "caption"}, "th": {"td", "th", "caption"}, "tr": {"td", "th", "tr", "caption"}, "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "thead", "tbody"}, "p": {"p"}}
_HOLDERS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "p": {"div", "td", "th", "li", "blockquote", "section"}}
_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


@dataclass
class Event:
    """kind: text, open or close; value: the text, or the tag's name in lower case."""

    kind: str
    value: str
    attributes: dict[str, str] = field(default_factory=dict)
    closed: bool = False


def _tag(text: str, at: int) -> tuple[Event, int] | None:
    """The tag that begins at a '<' and the position after it; None if it isn't one of the known names or doesn't end."""
    n = len(text)
    i = at + 1
    closing = i < n and text[i] == "/"
    i += closing
    start = i
    while i < n and text[i] in _NAME:
        i += 1
    name = text[start:i].lower()
    if name not in KNOWN or i >= n or not (text[i].isspace() or text[i] in "/>"):
        return None
    attributes: dict[str, str] = {}
    closed = False
    while i < n:
        c = text[i]
        if c == ">":
            return Event("close" if closing else "open", name, attributes, closed), i + 1
        if c == "<":
            return None
        if c.isspace() or c in "/\"'=":
            closed = c == "/"
            i += 1
            continue
        start = i
        while i < n and not text[i].isspace() and text[i] not in "=>/<":
            i += 1
        key, value = text[start:i].lower(), ""
        after = i
        while after < n and text[after].isspace():
            after += 1
        if after < n and text[after] == "=":
            i = after + 1
            while i < n and text[i].isspace():
                i += 1
            if i < n and text[i] in "\"'":
                end = text.find(text[i], i + 1)
                if end < 0:
                    return None
                value, i = text[i + 1 : end], end + 1
            else:
                start = i
                while i < n and not text[i].isspace() and text[i] not in "<>":
                    i += 1
                value = text[start:i]
        attributes.setdefault(key, html.unescape(value))
        closed = False
    return None


def events(text: str) -> Iterator[Event]:
    """Texts and known tags in order. Comments are left out; whatever else has an angle bracket is text."""
    at = 0
    while True:
        i = text.find("<", at)
        plain = at
        found = None
        while i >= 0 and found is None:
            if text.startswith("<!--", i) and (end := text.find("-->", i + 4)) >= 0:
                found = (None, end + 3)
            else:
                found = _tag(text, i)
                if found is None:
                    i = text.find("<", i + 1)
        if found is None:
            if plain < len(text):
                yield Event("text", text[plain:])
            return
        if i > plain:
            yield Event("text", text[plain:i])
        if found[0] is not None:
            yield found[0]
        at = found[1]


@dataclass
class _Element:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    out: list[str] = field(default_factory=list)
    #: Of a table: its caption and rows; of a row: its cells (is a head, text).
    caption: str = ""
    rows: list[list[tuple[bool, str]]] = field(default_factory=list)
    holds_table: bool = False

    def text(self) -> str:
        return "".join(self.out)

    def line(self) -> str:
        return " ".join(self.text().split())


def _around(mark: str) -> Callable[[_Element], str]:
    return lambda e: f"{mark}{e.text().strip()}{mark}" if e.text().strip() else ""


def _bold(e: _Element) -> str:
    inner = e.text().strip()
    return " (required)" if inner == "*" else f"**{inner}**" if inner else ""


def _anchor(e: _Element) -> str:
    shown, target = e.text().strip(), e.attributes.get("href", "")
    return f"[{shown}]({target})" if shown and target else shown


def _table(e: _Element) -> str:
    """Two columns give 'key: value', more give 'head: cell; ...'; a row with an empty first cell goes on with the row before; without heads, cells by bars."""
    rows = [r for r in e.rows if r]
    heads = [text for _, text in rows.pop(0)] if rows and all(head for head, _ in rows[0]) else []
    lines = [f"Table: {e.caption}"] if e.caption else []
    items: list[str] = []
    for row in rows:
        cells = [text for _, text in row]
        said = [c for c in cells if c]
        if items and len(cells) > 1 and not cells[0]:
            if said:
                items[-1] += "\n  " + " ".join(said)
        elif len(cells) == 2:
            items.append("- " + ": ".join([cells[0], *([cells[1]] if cells[1] else [])]))
        elif heads and len(cells) == len(heads):
            items.append("- " + "; ".join(f"{h}: {c}" for h, c in zip(heads, cells) if c))
        elif said:
            items.append("- " + " | ".join(cells))
    return "\n" + "\n".join(lines + items) + "\n"


def _heading(e: _Element) -> str:
    return f"\n{'#' * int(e.name[1])} {e.text().strip()}\n"


#: What a finished element leaves; elements that aren't listed leave their content.
_LEAVES: dict[str, Callable[[_Element], str]] = {
    **dict.fromkeys(("b", "strong"), _bold), **dict.fromkeys(("em", "i", "var"), _around("*")), **dict.fromkeys(("code", "kbd", "samp", "tt"), lambda e: f"`{e.text()}`"), **dict.fromkeys(("div", "p"), lambda e: f"\n{e.text()}\n"), **{f"h{k}": _heading for k in range(1, 7)},
    "a": _anchor, "br": lambda e: "\n", "dd": lambda e: "\n  " + e.text().lstrip(), "dt": lambda e: "\n- " + e.text().lstrip(), "hr": lambda e: "\n", "img": lambda e: e.attributes.get("alt", ""), "label": lambda e: e.text() + " ",
    "li": lambda e: "\n- " + e.text().lstrip(), "pre": lambda e: "\n```\n" + e.text().strip("\n") + "\n```\n", "table": _table,
}


class _Fold:
    def __init__(self) -> None:
        self.stack = [_Element("")]

    def inside(self, *names: str) -> bool:
        return any(e.name in names for e in self.stack)

    def add(self, text: str) -> None:
        top = self.stack[-1]
        if top.name not in ("table", "thead", "tbody", "tfoot", "tr", "colgroup"):  # between cells there is only space
            top.out.append(text)

    def finish(self, told: bool = True) -> None:
        """Ends the innermost element; one without a closing tag (told is False) leaves its content as it is, but for those whose closing tag may be left out."""
        e = self.stack.pop()
        above = self.stack[-1]
        if e.name in ("td", "th", "caption", "tr"):
            table = next((x for x in reversed(self.stack) if x.name == "table"), None)
            if table is not None:
                if e.name == "caption":
                    table.caption = e.line()
                elif e.name != "tr":
                    if not table.rows:
                        table.rows.append([])
                    table.rows[-1].append((e.name == "th", e.text().strip() if e.holds_table else e.line()))
                return
        if e.name == "code" and any(x.name == "pre" for x in self.stack):
            above.out.append(e.text())
        elif told or e.name in _ENDS:
            left = _LEAVES.get(e.name, _Element.text)(e)
            if left == " (required)" and above.out:  # it takes the place of the space before
                above.out[-1] = above.out[-1].rstrip()
            above.out.append(left)
        elif e.name == "table":  # never closed: what its cells say, as words
            above.out.append(" ".join(text for row in e.rows for _, text in row if text))
        else:
            above.out.append(e.text())
        if e.name == "table" or e.holds_table:
            above.holds_table = True

    def open(self, name: str, attributes: dict[str, str], closed: bool) -> None:
        if name in _ENDS:
            holders = _HOLDERS.get(name, {"table"})
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].name in holders:
                    break
                if self.stack[k].name in _ENDS[name]:
                    while len(self.stack) > k:
                        self.finish()
        self.stack.append(_Element(name, attributes))
        if name == "tr":
            table = next((x for x in reversed(self.stack) if x.name == "table"), None)
            if table is not None:
                table.rows.append([])
        if name in _VOID or closed:
            self.finish()

    def close(self, name: str) -> None:
        if name in _VOID or not self.inside(name):
            if name == "br":
                self.add("\n")
            return
        while self.stack[-1].name != name:
            self.finish(told=False)
        self.finish()


def convert(fragment: str) -> str:
    """A fragment as Markdown, its fenced code left alone; a text without '<' and '&' comes back as it is. Tags that are never closed leave their content."""
    if "<" not in fragment and "&" not in fragment:
        return fragment
    return fences.outside(fragment, _prose) if any(m in fragment for m in fences.MARKS) else _prose(fragment)


def _prose(fragment: str) -> str:
    fold = _Fold()
    for e in events(fragment):
        if e.kind == "text":
            fold.add(html.unescape(e.value).replace("\xa0", " "))
        elif e.kind == "open":
            fold.open(e.value, e.attributes, e.closed)
        else:
            fold.close(e.value)
    while len(fold.stack) > 1:
        fold.finish(told=False)
    return fold.stack[0].text()


def count_tags(text: str) -> int:
    """Known tags left in the prose of a text."""
    return sum(e.kind != "text" for code, part in fences.parts(text) if not code for e in events(part))
