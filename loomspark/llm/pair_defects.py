"""Problem 6: broken prompt and response pairs, by a pushdown parser, greedy string tiling, script and language checks and a refusal grammar."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.languages import differ
from loomspark.llm.truncation import PRIOR, ending, line_counts
from loomspark.llm.words import words

# ---- empty

_INVISIBLE = re.compile("[\\s­​-‏⁠﻿]+")
_REFERENCES = re.compile(r"\[\d+\]|\(\d+\)")
# Strings that stand for no answer.
_NOTHING = {"null", "none", "nil", "nan", "n/a", "na", "undefined", "no answer", "empty", "tbd", "todo"}


def is_empty(answer: str | None) -> bool:
    """No content: nothing but space, invisible characters, punctuation, reference numbers or a word for nothing."""
    core = _REFERENCES.sub("", _INVISIBLE.sub(" ", answer or "")).strip()
    bare = core.strip(" ()[]{}<>\"'`*_.-–—…:;,!?#|/\\")
    return not bare or bare.lower() in _NOTHING or core.lower() in _NOTHING


# ---- refusal grammar

#: A context-free grammar over lower-cased words. An alternative is a row of symbols (capitals), words, and word choices by bars; a symbol or word with ? may be left out, a symbol with * may come
#: any number of times. REFUSAL is derived from the beginning of an answer.
GRAMMAR: dict[str, tuple[str, ...]] = {
    "REFUSAL": ("OPENER* CLAUSE", "OPENER* FOREIGN"),
    "OPENER": (
        "SORRY", "sorry|apologies|unfortunately|regrettably|honestly|hmm|hm|well|sadly", "to be honest|fair", "as AN? WORD* assistant|model", "after|having reading|read|reviewing|reviewed|checking|checked SOURCE", "based|going on|by SOURCE", "from SOURCE", "thanks|thank for asking|you", "but|that|however|though|and",
        "i have|'ve read|checked|searched|reviewed SOURCE", "according to SOURCE", "good|great|fair question",
    ),
    "SORRY": ("i am|'m VERY? sorry|afraid", "i apologize|apologise", "my apologies", "we are|'re sorry"),
    "VERY": ("very|so|really|truly",),
    "AN": ("a|an|the",),
    "CLAUSE": ("SELF UNABLE", "SELF LACKS", "SELF DECLINES", "SOURCE SILENT", "none|nothing|nowhere in|of SOURCE", "ASKED CANNOT? NOT? be|been answered|determined|confirmed|told", "ASKED UNCOVERED", "no ADJ? answer|information|details|evidence can|could|was|is|has|exists", "there is|'s|are NOTHING INFO", "it is|'s not|unclear|unknown from SOURCE", "ASKED OUTSIDE"),
    "SELF": ("i", "we", "the|this model|assistant|system"),
    "NOT": ("not", "n't"),
    "CANNOT": ("cannot", "can|could|will|would|do|does|did not|n't|'t", "ca|wo n't", "can|could never"),
    "UNABLE": (
        "am|'m|was|are|were|is|'re unable|not|n't ABLE? to ACT", "CANNOT REALLY* ACT", "CANNOT be ABLE to ACT", "have|has|'ve not|n't been able to ACT", "must|have|will have to? decline|refuse|pass", "would|'d rather not ACT", "am|'m not going|willing|allowed|permitted to ACT",
        "am|'m not sure|certain", "do|does not|n't REALLY* know", "have no idea|clue|way",
    ),
    "ABLE": ("able",),
    "REALLY": ("really|actually|reliably|honestly|safely|fully|possibly|even|yet|currently|simply|just",),
    "ACT": ("answer|help|determine|find|say|tell|provide|assist|give|locate|confirm|respond|speculate|comment|guess|discuss|share|know|see|offer|verify|address|establish|identify|derive|conclude|infer|work",),
    "LACKS": ("have|has|'ve|found|find|see|saw NOTHING INFO", "CANNOT have|see|find ENOUGH INFO", "CANNOT have ENOUGH INFO", "lack|lacks ENOUGH? INFO", "have|'ve nothing|insufficient INFO?"),
    "NOTHING": ("no|not|insufficient|nothing|little ENOUGH?", "n't ENOUGH"),
    "ENOUGH": ("enough|sufficient|any|the|an|a|adequate",),
    "INFO": ("ADJ* information|answer|data|details|detail|evidence|context|knowledge|mention|reference|basis|material|documentation|passage|excerpt",),
    "ADJ": ("relevant|reliable|clear|definite|definitive|direct|further|specific|such|good|certain|useful",),
    "DECLINES": ("decline|declines|declined|refuse|refuses|refused to ACT", "decline|refuse|pass"),
    "SOURCE": ("DET* KIND TAIL*", "what|anything|everything i was|have|had been? given|available|here|read", "what is|was provided|given|available"),
    "DET": ("the|these|those|this|that|your|my|any|all|both|of|provided|given|available|supplied|retrieved|quoted|cited|above|current|attached",),
    "KIND": ("excerpt|excerpts|passage|passages|document|documents|documentation|docs|context|source|sources|material|materials|text|texts|reference|references|information|pages|page|snippets|knowledge",),
    "TAIL": ("i was|have|had been? given|available|here", "i have|can see|access", "provided|above|available|given|supplied|retrieved|at|hand|here|to|me",),
    "SILENT": (
        "do|does|did not|n't REALLY* contain|cover|mention|answer|say|include|address|describe|explain|give|provide|discuss|have|hold|tell|state|specify|help|touch|go|support", "say|says|said|contain|contains|mention|mentions|include|includes|give|gives|provide|provides|have|has|offer|offers|hold|holds NOTHING INFO?", "lack|lacks", "are|is silent|insufficient|not",
        "make|makes no mention|reference",
    ),
    "ASKED": ("this|that|it|such", "the|this|that|your question|answer|topic|matter|request|information|detail", "what you ask|asked|want"),
    "UNCOVERED": ("is|are|was|'s not|n't|never REALLY* covered|answered|mentioned|addressed|described|included|contained|given|stated|found|documented|explained|discussed|specified|part|in|within|available", "CANNOT be covered|answered|found|determined|derived|told|confirmed", "do|does not|n't appear|seem|exist|occur", "CANNOT appear"),
    "OUTSIDE": ("is|lies|falls|goes|'s outside|beyond|out",),
    "WORD": ("ai|language|automated|helpful|virtual|digital|support|honest",),
    "FOREIGN": (
        "LEIDER* ich kann|konnte|weiß|weiss|habe|finde ANY* nicht|nichts|keine|keinen|kein", "LEIDER* kann|konnte|weiß|habe ich ANY* nicht|nichts|keine|keinen|kein", "das|dies|diese|dazu|darauf kann|konnte|weiß|habe|finde ich ANY* nicht|nichts|keine|keinen", "die|den|der quellen|auszüge|auszügen|texte|dokumentation|unterlagen enthalten|enthält|sagen|sagt|geben ANY* nichts|keine|nicht|keinen",
        "LAMENTO* no puedo|sé|se|tengo|encuentro|encontré|dispongo|hay", "LAMENTO* los|las|el|la extractos|fuentes|documentos|contexto|documentación no", "HELAS* je ne peux|sais|trouve|dispose|puis", "HELAS* je n'ai", "HELAS* les|la|le extraits|sources|documents|documentation|contexte ne", "INFELIZ* não posso|sei|tenho|encontrei|consigo|há", "PURTROPPO* non posso|so|ho|trovo|riesco", "HELAAS* ik kan|weet|heb|vind ANY* niet|geen|niets", "HELAAS* dat kan|weet ik niet",
        "jag kan|vet inte", "nie mogę|wiem|mam", "bilmiyorum|cevaplayamam|yanıtlayamam",
    ),
    "ANY": ("*",),
    "LEIDER": ("leider|entschuldigung|tut|mir|leid|aber",),
    "LAMENTO": ("lo|siento|lamentablemente|lamento|perdón|desafortunadamente|disculpa|pero",),
    "HELAS": ("désolé|désolée|malheureusement|pardon|hélas|mais",),
    "INFELIZ": ("desculpe|infelizmente|lamento|mas",),
    "PURTROPPO": ("purtroppo|spiacente|scusa|mi|dispiace|ma",),
    "HELAAS": ("helaas|sorry|maar",),
}
#: Words that a derivation by ANY* may skip.
_SKIP = 12
_RULES = {name: tuple(tuple((s.rstrip("?*"), s[-1] if len(s) > 1 and s[-1] in "?*" else "") if s.rstrip("?*").isupper() else (frozenset(s.rstrip("?").split("|")), "?" if s[-1] == "?" else "") for s in row.split()) for row in rows) for name, rows in GRAMMAR.items() if name != "ANY"}
_TOKEN = re.compile(r"n't\b|'(?:m|ve|d|re|s|ll|t)\b|n'ai\b|[^\W\d_]+(?=n't\b)|[^\W\d_]+|\d+")


def _tokens(answer: str) -> Iterator[str]:
    return (m.group() for m in _TOKEN.finditer(answer.replace("’", "'").lower()))


def _heads(stack: tuple | None, out: set) -> bool:
    """Adds to `out` the (words, stack after one of them) with which a stack may go on, and says whether it may end here. A stack is what is left of a row and the stack below it, or None at the end; no symbol may begin with itself."""
    if stack is None:
        return True
    row, below = stack
    what, times = row[0]
    rest = (row[1:], below) if len(row) > 1 else below
    ends = _heads(rest, out) if times or what == "ANY" else False
    if isinstance(what, frozenset):
        out.add((what, rest))
    elif what == "ANY":
        left = times if isinstance(times, int) else _SKIP
        if left:
            out.add((None, ((("ANY", left - 1), *row[1:]), below)))
    else:
        for own in _RULES[what]:
            ends |= _heads((own, stack if times == "*" else rest), out)
    return ends


class _State(dict):
    """The heads of all stacks after some words, and by a next word the state after it, which is made when it is first asked for. REFUSAL has 202."""

    known: dict[frozenset, _State] = {}

    def __init__(self, heads: frozenset):
        self.heads = heads

    @classmethod
    def of(cls, stacks: list[tuple | None]) -> _State | None:
        """The state of some stacks, or None if one of them may end."""
        out: set = set()
        if any([_heads(s, out) for s in stacks]):
            return None
        heads = frozenset(out)
        if heads not in cls.known:
            cls.known[heads] = cls(heads)
        return cls.known[heads]

    def __missing__(self, word: str | None) -> _State | None:
        after = _State.of([stack for words, stack in self.heads if words is None or word in words])
        self[word] = after
        return after


_VOCABULARY = frozenset(w for rows in _RULES.values() for row in rows for what, _ in row if isinstance(what, frozenset) for w in what)


@lru_cache
def _start(symbol: str) -> _State | None:
    return _State.of([(row, None) for row in _RULES[symbol]])


def derived(symbol: str, tokens: Iterable[str]) -> bool:
    """Whether some beginning of the tokens is derived from a symbol of the grammar: all stacks of its pushdown automaton are followed side by side, a word at a time, until one ends or none is left."""
    state = _start(symbol)
    for t in tokens:
        if state is None or not state.heads:
            break
        state = state[t if t in _VOCABULARY else None]
    return state is None


def is_refusal(answer: str) -> bool:
    """An answer that begins with what the grammar derives, however far that goes; an apology or a 'cannot' about the matter itself isn't."""
    return derived("REFUSAL", _tokens(answer))


# ---- copies of the question: greedy string tiling

_LEAD = re.compile(r"^\W*(?:you asked|your question|question|the question (?:is|was)|q|answer|a)\s*[:—–-]\s*", re.I | re.M)
#: Words of the shortest tile, and the shares of the answer and of the question that tiles must cover.
TILE, OF_ANSWER, OF_QUESTION = 2, 0.8, 0.75
#: So many words in a row that no tile covers say something of their own.
OWN_WORDS = 5


def tiling(a: list[str], b: list[str], least: int = TILE, reuse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a and of b are covered by the longest common runs, taken greedily without overlap, down to `least` words. With `reuse`, words of a may be in several tiles, as where b repeats a."""
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    used = np.zeros(len(a), bool)
    starts: dict[tuple, list[int]] = {}
    for i in range(len(a) - least + 1):
        starts.setdefault(tuple(a[i : i + least]), []).append(i)
    while True:
        best, where = 0, (0, 0)
        j = 0
        while j <= len(b) - max(least, best + 1):
            if free_b[j : j + least].all():
                for i in starts.get(tuple(b[j : j + least]), ()):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                        n += 1
                    if n > best:
                        best, where = n, (i, j)
            j += 1
        if best < least:
            return used, ~free_b
        i, j = where
        used[i : i + best] = True
        free_b[j : j + best] = False
        if not reuse:
            free_a[i : i + best] = False


def copies_question(question: str, answer: str) -> bool:
    """Nothing but the question, once or again and again: tiles cover nearly all words of both, whatever frame, case or punctuation is around, and leave no
    OWN_WORDS words of the answer in a row. The order of the words counts."""
    q, a = words(question), words(_LEAD.sub("", answer))
    if len(q) < 3 or not a:
        return False
    known = set(q)
    if sum(w in known for w in a) < OF_ANSWER * len(a):  # tiles can't cover more
        return False
    of_q, of_a = tiling(q, a, reuse=True)
    own = np.diff(np.flatnonzero(np.r_[True, of_a, True])).max() - 1
    return of_a.mean() >= OF_ANSWER and of_q.mean() >= OF_QUESTION and own < OWN_WORDS


# ---- truncation: a pushdown parser and the ending

# HTML elements that must be closed.
_PAIRED = "a abbr article aside b blockquote body button center cite code del details div dl em figure footer form h1 h2 h3 h4 h5 h6 header html i iframe ins kbd label main mark nav ol pre q s samp section select small span strong style sub summary sup table tbody textarea tfoot thead title tt u ul var video"
_NAMES = "|".join(sorted(_PAIRED.split(), key=len, reverse=True))
_TOKENS = re.compile(
    rf"^[ \t>]*(?:`{{3,}}|~{{3,}}).*$|^[ \t]*(?:[-*+•]|\d+[.)])(?=[ \t]|$)|`+|\\(?:begin|end)\{{[a-zA-Z]+\*?\}}|\\.|</?(?:{_NAMES})(?:\s[^<>]*)?/?>|<!--|-->|\$\$|[()\[\]{{}}“”„«»]|\"|:[ \t]*$|\n[ \t]*\n|\n", re.M | re.I
)
_CLOSES = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_NOTE = re.compile(r"[(\[](?:the )?(?:answer|response|output|text)? ?(?:was |is )?(?:truncated|cut off|incomplete)[^)\]]*[)\]]\s*$", re.I)
#: What a whole text never leaves open.
_BLOCKS = ("```", "~~~", "<!--", "$$", "\\begin", "<table", "<ul", "<ol", "<dl", "<pre", "<details", "<thead", "<tbody", "item", "list")


def open_structures(text: str) -> list[str]:
    """What a pushdown parser holds on its stack at the end of a text: fences, code spans, brackets, quotations, tags, comments, environments, formulas and lists not closed.

    A list is open ("list") after a line that announces one with a colon until a line follows; an item is open ("item") while nothing stands after its marker."""
    stack: list[str] = []
    for m in _TOKENS.finditer(text):
        t = m.group()
        if t[0] == "\n":
            if stack and stack[-1] == "`" and t.count("\n") > 1:  # a code span ends with its paragraph
                stack.pop()
            continue
        mark = t.strip(" \t>")[:3]
        top = stack[-1] if stack else ""
        if mark in ("```", "~~~") and (m.start() == 0 or text[m.start() - 1] == "\n"):
            if top == mark:
                stack.pop()
            elif top not in ("```", "~~~"):
                stack.append(mark)
            continue
        if top in ("```", "~~~"):
            continue
        if top == "<!--":
            if t == "-->":
                stack.pop()
            continue
        if t[0] == "`":
            if top == "`":
                stack.pop()
            else:
                stack.append("`")
        elif top == "`":
            continue
        elif t.startswith(("\\begin", "\\end")):
            name = t[t.index("{") :]
            if t.startswith("\\begin"):
                stack.append("\\begin" + name)
            elif "\\begin" + name in stack:
                del stack[len(stack) - 1 - stack[::-1].index("\\begin" + name) :]
        elif t[0] == "\\":
            continue
        elif t == "<!--":
            stack.append(t)
        elif t == "-->":
            continue
        elif t[0] == "<":
            name = re.match(r"</?([a-z0-9]+)", t, re.I).group(1).lower()
            if t[1] == "/":
                if "<" + name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index("<" + name) :]
            elif not t.endswith("/>"):
                stack.append("<" + name)
        elif t in ('"', "$$"):
            if t in stack:
                del stack[stack.index(t) :]
            else:
                stack.append(t)
        elif t[0] == ":":
            if not text[m.end() :].strip():
                stack.append("list")
        elif t in "([{“„«":
            stack.append("“" if t == "„" else t)
        elif t in _CLOSES:
            if _CLOSES[t] in stack:
                del stack[len(stack) - 1 - stack[::-1].index(_CLOSES[t]) :]
        elif t == "“" and "“" in stack:
            stack.pop()
        elif not text[m.end() :].strip():  # a marker and nothing after it
            stack.append("item")
    return stack


def is_truncated(answer: str, stop_reason: str | None, total: np.ndarray, ends: np.ndarray) -> bool:
    text = answer.strip()
    if _NOTE.search(text):
        return True
    kind, odds = ending(text, None, total, ends)
    left = open_structures(text)
    if any(x.startswith(_BLOCKS) for x in left):
        return True
    if kind in ("sentence_end", "own_dots") or kind == "closed_block" and not left:
        return False
    if left and kind in ("item", "open_item", "open_sentence", "open_link"):
        return True
    if kind == "open_sentence" and re.fullmatch(r"[`*_\"“']*[\w./-]+[`*_\"”']*(?: [\w./-]+){0,2}", text):
        return stop_reason == "max_tokens"  # a bare name or value may be all there is to say
    prior = 2.0 if stop_reason in ("max_tokens", "length") else PRIOR
    return prior + odds > 0


def defect(question: str | None, answer: str | None, answerable: bool | None, stop_reason: str | None, total: np.ndarray, ends: np.ndarray) -> str | None:
    if is_empty(answer):
        return "empty"
    if question and copies_question(question, answer):
        return "copies_question"
    if is_refusal(answer):
        return None if answerable is False else "refusal"
    if question and differ(question, answer):
        return "other_language"
    return "truncated" if is_truncated(answer, stop_reason, total, ends) else None


def _judge(counts):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ends = counts.value
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("question", "answer", "answerable", "stop_reason")]
            kinds = [defect(q, a, ok, stop, total, ends) for q, a, ok, stop in zip(*cols)]
            yield pa.record_batch([batch.column("row_id"), batch.column("run"), pa.array(kinds, pa.string())], names=["row_id", "run", "defect"])

    return work


def pair_kinds(rows: DataFrame) -> DataFrame:
    """(row_id, run, defect): for every different row_id its kind of defect, or null.

    Exactly one kind: empty comes first, then copies_question, refusal, other_language and truncated. Of redelivered rows the last loaded
    counts. `found` and `stop_reason` are only hints. A null answer is empty; with a null or very short question nothing is held against
    it; a null answerable counts as answerable; null row ids are left out; other columns are ignored; no rows give no rows.
    """
    spark = rows.sparkSession
    columns = ["run", "question", "answer", "answerable", "stop_reason"]
    one = rows.where("row_id is not null").groupBy("row_id").agg(F.max_by(F.struct(*columns), F.coalesce(F.col("loaded_at").cast("long"), F.lit(-1))).alias("r")).select(F.col("row_id").cast("long").alias("row_id"), *[f"r.{c}" for c in columns])
    counts = line_counts(rows.select(F.col("answer").alias("text")).where("text is not null"))
    return one.mapInArrow(_judge(spark.sparkContext.broadcast(counts)), "row_id long, run string, defect string")


def defect_report(rows: DataFrame) -> DataFrame:
    """Per run and defect: pairs, and their share of the run's pairs; good pairs are listed as 'none'."""
    kinds = pair_kinds(rows).withColumn("defect", F.coalesce("defect", F.lit("none")))
    counts = kinds.groupBy("run", "defect").agg(F.count("*").alias("pairs"))
    totals = counts.groupBy(F.col("run").alias("r")).agg(F.sum("pairs").alias("all"))
    return counts.join(totals, F.col("run").eqNullSafe(F.col("r"))).select("run", "defect", "pairs", F.round(F.col("pairs") / F.col("all"), 6).alias("share"))
