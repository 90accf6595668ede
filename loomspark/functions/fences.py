"""Fenced code in Markdown: a line that begins with three backticks or tildes opens a block, the next such line closes it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = ("```", "~~~")
#: A fenced block, open to the end if it is never closed, as group 1; or a comment in the prose, which no fence line interrupts.
_BLOCK_OR_COMMENT = r"(?ms)(^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[^\n]*$|\z))|<!--(?:(?!-->|^[ \t]*(?:```|~~~)).)*-->"
_BLOCK = r"(?ms)^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[^\n]*(?:\n|\z)|\z)"


def parts(text: str) -> Iterator[tuple[bool, str]]:
    """(is code, part) in order, fence lines belonging to their code; joined, the parts are the text."""
    held: list[str] = []
    code = False
    for line in text.splitlines(keepends=True):
        mark = line.lstrip()[:3] in MARKS
        if mark and not code and held:
            yield False, "".join(held)
            held = []
        held.append(line)
        if mark and code:
            yield True, "".join(held)
            held = []
        code ^= mark
    if held:
        yield code, "".join(held)


def outside(text: str, change: Callable[[str], str]) -> str:
    """The text with its prose changed and its code as it was."""
    return "".join(part if code else change(part) for code, part in parts(text))


def without_comments(text: Column) -> Column:
    """A text without the HTML comments of its prose; those inside of code stay. In the JVM."""
    return F.regexp_replace(text, _BLOCK_OR_COMMENT, "$1")


def prose(text: Column) -> Column:
    """A text without its fenced blocks. In the JVM."""
    return F.regexp_replace(text, _BLOCK, "")
