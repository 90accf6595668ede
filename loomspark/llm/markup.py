"""Problem 5: markup residue in texts, by flat text blocks with their neighbours' word counts and link densities and a decision tree."""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import spread

FAMILIES = ("html", "markdown", "wiki", "latex")

# ---- blocks

_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})([^\n]*)$")
_CODE_SPAN = re.compile(r"(`+)(?!`)[^\n]+?(?<!`)\1(?!`)")
_WORD = re.compile(r"[^\W_]+")
_LINK = re.compile(r"!?\[([^\]\n]*)\](?:\([^)\n]*\)|\[[^\]\n]*\])|\[\[(?:[^|\]\n]*\|)?([^\]\n]*)\]\]|<a\b[^>]*>(.*?)</a>", re.I | re.S)


class Block(NamedTuple):
    """A run of lines without a blank line between, or a whole fenced code block."""

    text: str
    code: bool


#: What goes on over blank lines, by how it begins and ends.
_LONG = (("<!--", "-->"), ("<pre", "</pre>"), ("\\begin{verbatim}", "\\end{verbatim}"), ("\\begin{lstlisting}", "\\end{lstlisting}"), ("\\[", "\\]"), ("{|", "|}"))


def _goes_on(line: str) -> str:
    """The end of what a line opens and leaves open, or ''."""
    for begins, ends in _LONG:
        at = line.rfind(begins)
        if at >= 0 and ends not in line[at:]:
            return ends
    return ""


def blocks_of(text: str) -> list[Block]:
    """A fence that is never closed takes the rest of the text; other constructs that go on over blank lines are one block if they end at all."""
    out: list[Block] = []
    run: list[str] = []
    fence, fenced, until = "", False, ""
    lines = text.splitlines() if "\r" in text else text.split("\n")
    long = any(begins in text for begins, _ in _LONG)

    def flush() -> None:
        if run:
            out.append(Block("\n".join(run), fenced))
            run.clear()

    for i, line in enumerate(lines):
        m = _FENCE.match(line)
        if fenced:
            run.append(line)
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not m.group(2).strip():
                flush()
                fenced = False
        elif until:
            run.append(line)
            until = "" if until in line else until
        elif m:
            flush()
            fenced, fence = True, m.group(1)
            run.append(line)
        elif line.strip():
            run.append(line)
            if long and (ends := _goes_on(line)) and any(ends in x for x in lines[i + 1 :]):
                until = ends
        else:
            flush()
    flush()
    return out


# ---- marks of each family. The tags, commands and forms of the four languages.

_TAGS = "a abbr b big blockquote body br caption center cite code col dd del details div dl dt em figcaption figure font footer h1 h2 h3 h4 h5 h6 head hr html i iframe img ins kbd li mark nav ol p pre q s samp section small span strike strong style sub summary sup table tbody td tfoot th thead tr tt u ul var"
_ANY = {
    "html": "<&",
    "markdown": "*_~[]>|=-!",
    "wiki": "[{'=;#_<*",
    "latex": "\\$",
}
_TAG_NAMES = "|".join(sorted(_TAGS.split(), key=len, reverse=True))
_ATTRIBUTE = r"\s+(?:[a-zA-Z_:][-\w:.]*\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=]+)|(?:allowfullscreen|async|checked|controls|defer|disabled|hidden|itemscope|loop|multiple|nowrap|open|readonly|required|reversed|selected)(?=[\s/>]))"
# Names that Python gives a meaning between double underscores.
_DUNDER = r"__(?:abs|add|aenter|aexit|all|and|annotations|await|bool|bytes|call|class|contains|copy|debug|deepcopy|del|delattr|delete|delitem|dict|dir|doc|enter|eq|exit|file|float|format|future|ge|get|getattr|getitem|getstate|gt|hash|iadd|import|index|init|int|invert|iter|le|len|lt|main|missing|module|mul|name|ne|neg|new|next|not|or|pow|qualname|radd|reduce|repr|reversed|set|setattr|setitem|setstate|sizeof|slots|str|sub|subclasses|version|xor)__"
_STRONG = {
    "html": re.compile(rf"</?(?:{_TAG_NAMES})(?:{_ATTRIBUTE})*\s*/?>|<!--.*?-->|<!DOCTYPE\b|&(?:[a-zA-Z][a-zA-Z0-9]{{1,30}}|#\d{{1,7}}|#[xX][0-9a-fA-F]{{1,6}});", re.I | re.S),
    "markdown": re.compile(
        rf"(?<![*\w])\*\*\*?(?=[^\s*])[^*\n]*?[^\s*]\*\*\*?(?!\*)|(?<![_\w.])(?!{_DUNDER})__(?=[^\s_])[^\n]*?[^\s_]__(?![_\w(.])|~~(?=\S)[^~\n]+~~|!?\[[^\]\n]*\]\((?:[/#.\w][^)\s]*|<[^>\n]*>)(?:\s+\"[^\"\n]*\")?\)"
        r"|\[[^\]\n\d^][^\]\n]*\]\[[^\]\n\d][^\]\n]*\]|\[\^[^\]\n]+\]|^[ ]{0,3}\[[^\]\n\d][^\]\n]*\]:[ ]+\S+|^[ ]{0,3}>[ ]?\S|^[ ]*[-*+][ ]\[[ xX]\][ ]|^[ ]{0,3}(?:\*[ ]?){3,}$|^[ ]{0,3}(?:_[ ]?){3,}$|^\|?[ ]*:?-{3,}:?[ ]*(?:\|[ ]*:?-{3,}:?[ ]*)+\|?$"
        r"|(?<![*\w])\*(?=[^\s*.])[^*\n]*?[^\s*]\*(?![*\w])|(?<![_\w])_(?=[^\s_])[^_\n]*?[^\s_]_(?![_\w])|^[^\s|#>-][^\n|]*\n(?:={3,}|-{3,})[ ]*$",
        re.M,
    ),
    "wiki": re.compile(
        r"\[\[[^\[\]\n]+\]\]|\{\{(?=[a-zA-Z#:!])[^{}]*\}\}|(?<!')'{5}(?=[^'\s])[^'\n]+'{5}|(?<!')'{3}(?=[^'\s])[^'\n]+'{3}(?!')|(?<!')'{2}(?=[^'\s])[^'\n]+'{2}(?!')|^={2,6}[ ]*[^=\n]+?[ ]*={2,6}[ ]*$|^\{\||^\|\}|^!.*!!|^\|-[ ]*$|<ref\b|</ref>|<nowiki>|__(?:TOC|NOTOC|NOEDITSECTION)__|^#REDIRECT\b|^;[ ]?[^;:\n]+[ ]:[ ]|\[(?:https?:)?//[^\]\s]+ [^\]\n]+\]",
        re.M,
    ),
    "latex": re.compile(
        r"\\(?:begin|end)\{[a-zA-Z]+\*?\}|\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{|(?<![\w:\\/.])\\(?:item|hline|maketitle|noindent|alpha|beta|gamma|lambda|ldots|cdot|times|sum|log|frac|sqrt|tableofcontents|newpage|par|centering|toprule|midrule|bottomrule)\b|\$\$[^$]+\$\$|\$(?![\s$])[^$\n]*[\\^_{}][^$\n]*(?<!\s)\$|\\\([^\n]*?\\\)|\\\[.*?\\\]",
        re.S,
    ),
}
_WEAK = {
    "html": re.compile(rf"<(?:{_TAG_NAMES})\s[^<>\n]*>|&[a-z]{{2,8}}\b(?!;)", re.I),
    "markdown": re.compile(rf"{_DUNDER}|^[ ]*[*+][ ]\S|^\|.*\|$|\*\w|\w\*", re.M),
    "wiki": re.compile(r"\{\{\s[^{}]*\}\}|\{\{[.$%<-][^{}]*\}\}|^\*+[ ]?\w|'{3}|==", re.M),
    "latex": re.compile(r"(?<![\w:\\/.])\\[a-zA-Z]+|\\[%&_#]|(?<=\w)~\\|``[^`\n]+''"),
}

FEATURES = ("strong", "weak", "words", "links", "words_before", "links_before", "words_after", "links_after", "share", "strong_near")


def _bare(block: Block) -> str:
    return "" if block.code else _CODE_SPAN.sub(" ", block.text) if "`" in block.text else block.text


def _strong(family: str, text: str) -> int:
    marks = _STRONG[family].finditer(text)
    if family == "html":  # an entity has a name that HTML knows
        return sum(1 for m in marks if m.group()[0] != "&" or m.group()[1] == "#" or m.group()[1:] in html.entities.html5)
    return sum(1 for _ in marks)


def _shape(text: str) -> tuple[int, float]:
    """(words, share of them in the texts of links)."""
    words = len(_WORD.findall(text))
    linked = sum(len(_WORD.findall(next((g for g in m.groups() if g is not None), ""))) for m in _LINK.finditer(text)) if "[" in text or "<a" in text else 0
    return words, linked / words if words else 0.0


def features(blocks: list[Block], family: str, bare: list[str] | None = None) -> list[tuple[float, ...]]:
    """Of each block, for one family: its strong and weak marks, its own and both neighbours' words and link density, marks a word, and the strong marks of the neighbours.
    Words are counted only around blocks that have a mark of the family, as without marks nothing is residue."""
    signs = _ANY[family]
    bare = bare if bare is not None else [_bare(b) for b in blocks]
    signed = [any(c in t for c in signs) for t in bare]
    strong = [_strong(family, t) if s else 0 for t, s in zip(bare, signed)]
    shape: dict[int, tuple[int, float]] = {-1: (0, 0.0), len(bare): (0, 0.0)}
    out = []
    for i, text in enumerate(bare):
        weak = sum(1 for _ in _WEAK[family].finditer(text)) if signed[i] else 0
        if not strong[i] + weak:
            out.append((0.0,) * len(FEATURES))
            continue
        for j in (i - 1, i, i + 1):
            if j not in shape:
                shape[j] = _shape(bare[j])
        near = (strong[i - 1] if i else 0) + (strong[i + 1] if i + 1 < len(bare) else 0)
        out.append((strong[i], weak, *shape[i], *shape[i - 1], *shape[i + 1], (strong[i] + weak) / (shape[i][0] + 1), near))
    return out


# ---- the decision tree and its labelled table

#: Texts, and the families of which each of their blocks (between blank lines) holds residue, blocks by bars. A label without bars holds for all blocks.
LABELLED: tuple[tuple[str, str], ...] = (
    ("The <b>cache</b> is warm.", "html"), ("<p>A paragraph of plain words about a queue.</p>", "html"), ("First line<br/>second line", "html"), ("Fish &amp; chips are served.", "html"), ("It&#8217;s late &mdash; very late.", "html"),
    ("<ul>\n<li>one</li>\n<li>two</li>\n</ul>", "html"), ("Words <!-- a remark --> words", "html"), ("See <a href=\"/x/y/\">the page</a> for more.", "html"), ("<table><tr><td>1</td></tr></table>", "html"), ("<details><summary>More</summary>", "html"),
    ("Replace <step-name> with the name of yours.", ""), ("The R&D route uses 18 * 38 workers.", ""), ("The ledger is kept while a < b and c > 12.", ""), ("Write <your-token> and <file-name> here.", ""), ("AT&T and B&B are names.", ""), ("Use <name> or <owner> as placeholders.", ""),
    ("This is **important** to know.", "markdown"), ("This is __important__ to know.", "markdown"), ("A ~~wrong~~ right word.", "markdown"), ("See [the page](/docs/x/) for more.", "markdown"), ("![chart](/images/a.svg) shows it", "markdown"), ("> quoted words of someone\n> and more of them", "markdown"),
    ("A heading of words\n==========\nand the text", "markdown"), ("Another heading\n----------\nand the text", "markdown"), ("| a | b |\n|---|:---|\n| 1 | 2 |", "markdown"), ("***", "markdown"), ("- [ ] to do\n- [x] done", "markdown"), ("A claim[^12] with a note.", "markdown"), ("The [narrow][request-ref] timer", "markdown"), ("[request-ref]: /docs/x/ \"Title\"", "markdown"),
    ("Words in *italics* here.", "markdown"), ("Words in _italics_ here.", "markdown"), ("A ***very*** strong word.", "markdown"),
    ("# A heading", ""), ("## Another heading\nand its text", ""), ("- one\n- two\n- three", ""), ("1. first\n2. second", ""), ("Files that match *.yaml or step-*.yaml are read.", ""), ("The array [0][4096] is shared, see [1] and [2].", ""), ("Set max_open_files to 3 * 4.", ""), ("```\n**x** <b>y</b> [[z]] \\textbf{w}\n```", ""), ("Use `**kwargs` and `<b>` and `[[x]]` and `\\item`.", ""), ("A range of 7-36 (or ~57) is used.", ""), ("snake_case_name and other_snake_name stay.", ""), ("5 * 6 * 7 is 210", ""), ("Sources [1] and [2] describe it.", ""),
    ("See [[Target page]] for more.", "wiki"), ("See [[Target|the page]] for more.", "wiki"), ("{{Note|a remark}} on this", "wiki"), ("{{Infobox\n| size = 3\n| kind = local\n}}", "wiki"), ("A '''bold''' word.", "wiki"), ("An ''italic'' word.", "wiki"), ("Both '''''at once'''''.", "wiki"), ("== A heading ==\nand its text", "wiki"), ("=== Deeper ===", "wiki"), ("{| class=\"x\"\n! a !! b\n|-\n| 1 || 2\n|}", "wiki"), ("#REDIRECT [[Elsewhere]]", "wiki"), ("; term : what it means", "wiki"), ("A fact.<ref>Source.</ref>", "wiki"), ("It's the workers' and owners' own.", ""), ("if a == b and c == d then stop", ""), ("He said 'yes' and 'no'.", ""), ("A note; cache : no such thing.", ""),
    ("\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}", "latex"), ("A \\textbf{bold} word.", "latex"), ("Words\\footnote{A note.} go on.", "latex"), ("The size $\\alpha^{16}$ is fixed.", "latex"), ("The bound $n_{max} \\le 18$ holds.", "latex"), ("$$ w_i = \\frac{c_i}{\\sum_j c_j} $$", "latex"), ("\\[ T = 12 \\cdot \\log_2(n) \\]", "latex"), ("At \\(t = \\frac{1}{2}\\) it ends.", "latex"), ("\\section{A heading}", "latex"), ("See~\\cite{key} and (see \\ref{sec:x}).", "latex"), ("\\begin{tabular}{ll}\na & b \\\\\n\\end{tabular}", "latex"),
    ("On that system the path is C:\\backoffs\\new_branch.", ""), ("It costs $ 72 per tidegate and $ 8 per cache.", ""), ("The setting is read from $HOME/.release on start.", ""), ("From $HOME/.x to $PATH and back.", ""), ("Write D:\\data\\item\\begin there.", ""), ("Plain words without anything in them.", ""), ("Prices of $5 and $6 are low.", ""),
    # Strong marks among plain blocks; weak marks beside strong ones belong to them, weak marks among plain blocks don't.
    ("Plain words about a queue and its owner.\n\nThe <b>cache</b> is warm.\n\nMore plain words about it.", "|html|"), ("The <b>cache</b> is warm.\n\nWrite&nbsp<i lone>so</i> here.", "html|html"), ("A first line of words.\n\nif x <b and y> c then the queue is full\n\nA last line of words.", "||"), ("Ask AT&T or R&D for the copyright, &copy or not.\n\nA last line of words.", "|"),
    ("See [the page](/docs/x/) and [that page](/docs/y/).\n\n* one more item\n* another item\n\n[Next](/docs/z/)", "markdown|markdown|markdown"), ("Words of a plain kind go before it.\n\n* one item\n* another item of the list\n\nWords of a plain kind go after it.", "||"), ("**Sizes** of all queues\n\n| a | b |\n| 1 | 2 |\n\n> said by someone", "markdown|markdown|markdown"), ("The grep of all logs follows here.\n\n| a | b | c of the log that was read this morning by the owner |\n\nThe end of the log.", "||"),
    ("The class has a method __init__ that sets all of its fields up before use.", ""), ("Call __main__ or __name__ as the guard says.\n\nThen the module runs.", "|"), ("The size is 3*n or n*4 of all rows in the table.\n\nThe queue is 2*k long.", "|"), ("A glob of *.yaml and step* is read from the folder by the loader.", ""),
    ("See [[Target page]].\n\n* plain item\n* other item\n\n== A heading ==", "wiki|wiki|wiki"), ("The chart sets the name.\n\nname: {{ .Values.name }}\n\nThe release is installed.", "||"), ("Set it to {{ item }} in each round of the loop over all of the hosts.", ""), ("Compare a == b and b == c before the merge.\n\nThen c == d holds as well.", "|"), ("Write {{$x}} or {{- if y }} in the chart.\n\nAll else is text.", "|"),
    ("\\section{A heading}\n\nA size of 3\\% \\quad and more.\n\nAs \\ref{x} says.", "latex|latex|latex"), ("The path is D:\\new or \\share of that system.\n\nUse \\n for a line end in the format.", "|"), ("A plain block of words.\n\nSay ``quoted'' of it and go on.\n\nAnother plain block.", "||"), ("\\begin{center}\n\n``Quoted'' words \\dots\n\n\\end{center}", "latex|latex|latex"),
    # A menu: short blocks of links, with a short block of weak marks between; long blocks of words around a link, with weak marks in prose.
    ("[Home](/) [Docs](/docs/)\n\n* Owners\n\nA text of many plain words about a queue that nobody owns yet.", "markdown|markdown|"), ("A text of many plain words about a queue that nobody owns yet, with [a link](/x/) in it somewhere.\n\nIt takes 3*n or n*4 of all of the rows in the table, as the owner says, and not more than that.", "markdown|"), ("[[A]] [[B]] [[C]]\n\n* indented\n\nA text of many plain words about a queue that nobody owns yet.", "wiki|wiki|"),
    ("A text of many plain words about a [[queue]] that nobody owns yet, as far as anyone can say.\n\nThe loop sets {{ item }} in each of its rounds over all of the hosts, and c == d holds as well by then.", "wiki|"), ("<a href=\"/\">Home</a> <a href=\"/docs/\">Docs</a>\n\nA&nbspB\n\nA text of many plain words about a queue that nobody owns yet.", "html|html|"), ("A text of many plain words about a <b>queue</b> that nobody owns yet, as far as anyone can say.\n\nAsk AT&T or R&D about it all if x <b and y> c, as the owner of the queue said so often before.", "html|"),
    # One link alone, as in a menu, and one link in a sentence, with one more item after them.
    ("[Home](/)\n\n* Owners\n\nA text of many plain words about a queue that nobody owns yet.", "markdown|markdown|"), ("See the [page](/x/) of the owner of the queue for all of the rest of it.\n\n* Owners\n\nA text of many plain words about a queue that nobody owns yet.", "markdown||"), ("A text of many plain words.\n\n* Owners\n\n[Home](/)", "|markdown|markdown"),
    ("[[Home]]\n\n* Owners\n\nA text of many plain words about a queue that nobody owns yet.", "wiki|wiki|"), ("See the [[page]] of the owner of the queue for all of the rest of it.\n\n* Owners\n\nA text of many plain words about a queue that nobody owns yet.", "wiki||"), ("A text of many plain words.\n\n* Owners\n\nSee the [[page]] of the owner of the queue for all of the rest of it.", "||wiki"),
    ("[The home of all owners of queues and of their caches and sizes](/)\n\n* Owners\n\nA text of many plain words about a queue that nobody owns yet.", "markdown|markdown|"), ("[[The home of all owners of queues and of their caches and sizes]]\n\n* Owners\n\nA text of many plain words about a queue that nobody owns yet.", "wiki|wiki|"), ("See the [page](/x/) of it.\n\n* Owners\n\nA text of many plain words about a queue that nobody owns yet.", "markdown||"), ("See the [[page]] of it.\n\n* Owners\n\nA text of many plain words.", "wiki||"),
    ("A text of many plain words about a \\textbf{queue} that nobody owns yet, as far as anyone can say.\n\nThe share is called \\files on that system, as the owner of the queue said so often before.", "latex|"),
)


class Tree(NamedTuple):
    feature: int
    limit: float
    below: Tree | int
    above: Tree | int


def grow(x: np.ndarray, y: np.ndarray, depth: int = 4, least: int = 3) -> Tree | int:
    """A binary classification tree by Gini impurity; ties go to the earlier feature and the lower limit."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return int(y.mean() >= 0.5)
    impurity = lambda s: 2 * s.mean() * (1 - s.mean()) * len(s)
    best = (impurity(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= limit
            if low.sum() >= least and (~low).sum() >= least:
                score = impurity(y[low]) + impurity(y[~low])
                if score < best[0] - 1e-9:
                    best = (score, f, float(limit))
    if best[1] < 0:
        return int(y.mean() >= 0.5)
    low = x[:, best[1]] <= best[2]
    below, above = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return below if isinstance(below, int) and below == above else Tree(best[1], best[2], below, above)


def classify(tree: Tree | int, row: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        tree = tree.below if row[tree.feature] <= tree.limit else tree.above
    return tree


def rows_of(labelled: tuple[tuple[str, str], ...], family: str) -> tuple[list[tuple[float, ...]], list[int]]:
    """Features and labels of the blocks of some labelled texts that have a mark of the family."""
    x, y = [], []
    for text, label in labelled:
        blocks = blocks_of(text)
        labels = label.split("|") if "|" in label else [label] * len(blocks)
        for row, own in zip(features(blocks, family), labels):
            if row[0] + row[1]:
                x.append(row)
                y.append(int(family in own.split()))
    return x, y


def train(labelled: tuple[tuple[str, str], ...] = LABELLED, depth: int = 6) -> Tree | int:
    """One tree for all families, from the blocks of all labelled texts that have a mark."""
    x, y = [], []
    for family in FAMILIES:
        rows, labels = rows_of(labelled, family)
        x += rows
        y += labels
    return grow(np.array(x, float), np.array(y), depth, 1)


_TREE: list = []


def residue_of(blocks: list[Block]) -> list[set[str]]:
    """Of each block the families of which it holds residue, as the tree says."""
    if not _TREE:
        _TREE.append(train())
    bare = [_bare(b) for b in blocks]
    out: list[set[str]] = [set() for _ in blocks]
    for family in FAMILIES:
        if any(c in t for t in bare for c in _ANY[family]):
            for held, row in zip(out, features(blocks, family, bare)):
                if row[0] + row[1] and classify(_TREE[0], row):
                    held.add(family)
    return out


def families_of(text: str | None) -> list[str]:
    """The families of which some block holds residue."""
    if not text:
        return []
    found = set().union(*residue_of(blocks_of(text)))
    return [f for f in FAMILIES if f in found]


# ---- clean text

#: By family, in this order: what becomes of its marks. Formulas stay between dollars, headings get #, lists -, code fences.
_STEPS: tuple[tuple[str, re.Pattern, object], ...] = tuple(
    (family, re.compile(p, f), r)
    for family, p, f, r in (
        # Formulas are kept between dollars.
        ("latex", r"\\\[(.*?)\\\]", re.S, r"$$\1$$"),
        ("latex", r"\\begin\{(?:equation|align|displaymath)\*?\}(.*?)\\end\{(?:equation|align|displaymath)\*?\}", re.S, r"$$\1$$"),
        ("latex", r"\\\(([^\n]*?)\\\)", 0, r"$\1$"),
        # Headings.
        ("html", r"<h([1-6])\b[^>]*>(.*?)</h\1>", re.I | re.S, lambda m: "\n" + "#" * int(m.group(1)) + " " + m.group(2).strip() + "\n"),
        ("wiki", r"^(={2,6})[ ]*([^=\n]+?)[ ]*\1[ ]*$", re.M, lambda m: "#" * len(m.group(1)) + " " + m.group(2)),
        ("markdown", r"^([^\s|#>-][^\n|]*)\n={3,}[ ]*$", re.M, r"# \1"),
        ("markdown", r"^([^\s|#>-][^\n|]*)\n-{3,}[ ]*$", re.M, r"## \1"),
        ("latex", r"\\(chapter|section|subsection|subsubsection)\*?\{([^{}]*)\}", 0, lambda m: {"chapter": "#", "section": "##", "subsection": "###"}.get(m.group(1), "####") + " " + m.group(2)),
        # Code and lists.
        ("html", r"<pre\b[^>]*>\s*(?:<code\b[^>]*>)?(.*?)(?:</code>)?\s*</pre>", re.I | re.S, r"\n```\n\1\n```\n"),
        ("latex", r"\\begin\{(?:verbatim|lstlisting)\}(.*?)\\end\{(?:verbatim|lstlisting)\}", re.S, r"\n```\1```\n"),
        ("html", r"<code\b[^>]*>([^<\n]*)</code>", re.I, r"`\1`"),
        ("html", r"<li\b[^>]*>\s*", re.I, "\n- "),
        ("latex", r"^[ \t]*\\item\b[ \t]*", re.M, "- "),
        ("markdown", r"^[ ]*[*+][ ]+(?![*+ ])", re.M, "- "),
        ("markdown", r"^([ ]*- )\[[ xX]\] ", re.M, r"\1"),
        ("wiki", r"^\*+[ ]?(?=[^\s*])", re.M, "- "),
        ("wiki", r"^;[ ]?([^;:\n]+?)[ ]:[ ]", re.M, r"- \1: "),
        ("wiki", r"^#REDIRECT\s+", re.M, ""),
        # Tables: a row a line, cells by bars.
        ("markdown", r"^\|?[ ]*:?-{3,}:?[ ]*(?:\|[ ]*:?-{3,}:?[ ]*)+\|?$\n?", re.M, ""),
        ("html", r"</t[dh]>\s*<t[dh]\b[^>]*>", re.I, " | "),
        ("html", r"</tr>", re.I, "\n"),
        ("wiki", r"^\{\|.*$\n?|^\|[-}][ ]*$\n?", re.M, ""),
        ("wiki", r"^[!|][ ]?(.*(?:!!|\|\|).*)$", re.M, lambda m: re.sub(r"\s*(?:!!|\|\|)\s*", " | ", m.group(1))),
        ("latex", r"\\begin\{\w+\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*\n?|\\end\{\w+\*?\}\n?", 0, ""),
        # Links give their texts.
        ("markdown", r"!?\[([^\]\n]*)\]\([^)\n]*\)", 0, r"\1"),
        ("markdown", r"\[([^\]\n\d^][^\]\n]*)\]\[[^\]\n\d][^\]\n]*\]", 0, r"\1"),
        ("markdown", r"^[ ]{0,3}\[[^\]\n\d][^\]\n]*\]:[ ]+\S.*$\n?", re.M, ""),
        ("markdown", r"\[\^[^\]\n]+\]:?", 0, ""),
        ("wiki", r"\[\[(?:[^|\]\n]*\|)?([^\]\n]*)\]\]", 0, r"\1"),
        ("wiki", r"\[(?:https?:)?//[^\]\s]+ ([^\]\n]+)\]", 0, r"\1"),
        ("wiki", r"\{\{(?![\s.$%<-])[^{}|]*\|([^{}]*)\}\}|\{\{(?![\s.$%<-])[^{}]*\}\}", 0, lambda m: (m.group(1) or "").strip()),
        ("wiki", r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", re.S, ""),
        # Emphasis, quotation and rules.
        ("markdown", r"^[ ]{0,3}(?:(?:\*[ ]?){3,}|(?:_[ ]?){3,})$\n?", re.M, ""),
        ("markdown", r"(?<![*\w])\*{1,3}(?=[^\s*.])([^*\n]*?[^\s*])\*{1,3}(?![*\w])", 0, r"\1"),
        ("markdown", rf"(?<![_\w.])(?!{_DUNDER})_{{1,2}}(?=[^\s_])([^\n]*?[^\s_])_{{1,2}}(?![_\w(])", 0, r"\1"),
        ("markdown", r"~~([^~\n]+)~~", 0, r"\1"),
        ("wiki", r"'{2,5}(?=[^'\s])([^'\n]+)'{2,5}", 0, r"\1"),
        ("markdown", r"^[ ]{0,3}>[ ]?", re.M, ""),
        # The rest of tags and commands.
        ("html", r"<!--.*?-->", re.S, ""),
        ("html", r"<br\s*/?>|</?(?:p|div|tr|table|ul|ol|section|details|blockquote)\b[^>]*>|</summary>|</li>", re.I, "\n"),
        ("html", rf"</?(?:{_TAG_NAMES})(?:{_ATTRIBUTE})*\s*/?>|<!DOCTYPE[^<>]*>", re.I, ""),
        ("latex", r"~?\\(?:ref|cite|label|index)\*?\{[^{}]*\}", 0, ""),
        ("latex", r"\\footnote\{([^{}]*)\}", 0, r" (\1)"),
        ("latex", r"\\(?:textbf|textit|emph|texttt|underline|text)\{([^{}]*)\}", 0, r"\1"),
        ("latex", r"``([^`\n]+)''", 0, r'"\1"'),
    )
)
_FORMULA = re.compile(r"(\$\$.*?\$\$|\$[^$\n]+\$|```.*?```)", re.S)
_ENTITY = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,30}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});")


def _cleaned(text: str, families: set[str]) -> str:
    """A run of blocks without the residue of some families; code spans and formulas stay as they are."""
    spans: list[str] = []

    def keep(m: re.Match) -> str:
        spans.append(m.group())
        return f"\x00{len(spans) - 1}\x00"

    t = _CODE_SPAN.sub(keep, text.replace("\x00", ""))
    for family, pattern, by in _STEPS:
        if family in families:
            t = pattern.sub(by, t)
    if "html" in families:
        t = "".join(p if i % 2 else _ENTITY.sub(lambda m: html.unescape(m.group()), p) for i, p in enumerate(_FORMULA.split(t)))
    t = re.sub("\x00(\\d+)\x00", lambda m: spans[int(m.group(1))], t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+$", "", t, flags=re.M)).strip("\n")


def clean(text: str | None) -> str | None:
    """The text without residue: headings as #, lists as -, code in fences and formulas in dollars. Only blocks that the tree takes for residue change, and
    only by the steps of their families; all else, and what is inside code, stays as it is, but for blank lines in a row."""
    if text is None:
        return None
    blocks = blocks_of(text)
    parts: list[str] = []
    run: list[str] = []
    of: set[str] = set()

    def flush() -> None:
        if run:
            t = _cleaned("\n\n".join(run), of) if of else "\n\n".join(run)
            if t.strip():
                parts.append(t)
            run.clear()

    for block, families in zip(blocks, residue_of(blocks)):
        if block.code or families != of:
            flush()
        of = families
        if block.code:
            parts.append(block.text)
        else:
            run.append(block.text)
    flush()
    return "\n\n".join(parts)


# ---- operators


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found = [], []
        for key, text in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist()):
            for family in families_of(text):
                ids.append(key)
                found.append(family)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["row_key", "family"])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column("row_key"), pa.array([clean(t) for t in batch.column("text").to_pylist()], pa.string())], names=["row_key", "text"])


def _keyed(df: DataFrame, id: str, text: str) -> DataFrame:
    return spread(df.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("row_key"), F.col(text).alias("text")))


def residue(df: DataFrame, id: str, text: str) -> DataFrame:
    """(row_key, family): one row per family of markup of which some block of the text holds residue, without a shuffle.

    Outside of residue are headings with #, lists with - or 1., fenced code, code in backticks and all inside of it, and placeholders such
    as <some-name>. Null, empty and blank texts have none; null ids are left out; repeated rows give repeated results.
    """
    return _keyed(df, id, text).mapInArrow(_find, "row_key long, family string")


def cleaned(df: DataFrame, id: str, text: str) -> DataFrame:
    """(row_key, text): the clean text of every row; null stays null, blank becomes empty."""
    return _keyed(df, id, text).mapInArrow(_clean, "row_key long, text string")
