"""Splitting (2), markup (5), pairs (6), encoding (8), leaks (9) and truncation (10)."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import bpe, languages, leakage, markup, pair_defects, splitting, truncation

NO_COUNTS = (np.zeros(truncation.BUCKETS, np.int64), np.zeros(truncation.BUCKETS, np.int64))


# ---- 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", "end.", "\n", "\n\n", "- item", "# Head", "```\n", "x"]), max_size=900), st.integers(8, 60), st.integers(0, 7))
def test_pieces_cover_all_words_under_the_limit(parts, limit, overlap):
    text = " ".join(parts)
    words = text.split()
    out = []
    pieces = splitting.split(text, limit, overlap)
    for i, p in enumerate(pieces):
        own = p.text.split()
        assert 0 < len(own) <= limit and own == words[p.first_word : p.last_word]
        if i:
            assert p.first_word == pieces[i - 1].last_word - overlap
        out += own if i == 0 else own[overlap:]
    assert out == words


def test_cuts_take_the_strongest_boundary():
    text = "\n\n".join(" ".join(f"p{k}w{i}" for i in range(100)) for k in range(5))
    assert [p.boundary for p in splitting.split(text)][:-1] == ["paragraph"] * (len(splitting.split(text)) - 1)
    assert [p.first_word for p in splitting.split(" ".join(["x"] * 570))] == [0, 270]


def test_blocks_of_code_keep_together():
    code = "\n".join(f"line{i} a b" for i in range(17)) + "\n\n# not a heading\n- not an item"
    blocks = [{"size": 60 * 5 - 1, "is_code": False}, {"size": len(code), "is_code": True}, {"size": 60 * 5 - 1, "is_code": False}]
    text = "\n\n".join([" ".join(["word"] * 60), code, " ".join(["more"] * 60)])
    pieces = splitting.split(text, 130, 10, splitting.code_ranges(blocks))
    assert [p.boundary for p in pieces][:-1] == ["code_block"] and pieces[0].text.endswith("an item")
    _, kinds = splitting.boundaries(text, splitting.code_ranges(blocks))
    assert set(kinds[61 : 60 + len(code.split())]) == {"word", "line"} and kinds[60] == kinds[60 + len(code.split())] == "code_block"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", "line", "sentence", "paragraph"]), min_size=1, max_size=400), st.integers(6, 30), st.integers(0, 4))
def test_no_needless_cut_inside_a_sentence(kinds, limit, overlap):
    got = splitting.cuts(kinds, limit, overlap)
    n, best = len(kinds), {0: 0}
    # Fewest cuts inside of sentences over all ways to cut, by the position of the last cut.
    for at in range(1, n + 1):
        before = [best[p] for p in best if p < at and at - (p - overlap if p else 0) <= limit and (not p or p > overlap)]
        if before and (at == n or at > overlap):
            best[at] = min(before) + (at < n and kinds[at] == "word")
    assert sum(kinds[p] == "word" for p in got) == (best[n] if n > limit else 0)


def test_sections_with_code(spark):
    rows = [("s", [("w " * 200, False), ("x\n" * 150, True), (None, None)], None, 1), ("t", [("w", False)], None, 1), ("u", None, None, 1), ("v", [], None, 1)]
    df = spark.createDataFrame(rows, "key string, blocks array<struct<text:string,is_code:boolean>>, loaded_at timestamp, text int")
    items = splitting.oversized_items("t", df, "key", None, "loaded_at", blocks="blocks")
    pieces = splitting.split_items(items).orderBy("piece").collect()
    assert [(p.item_key, p.boundary) for p in pieces] == [("s", "code_block"), ("s", "end")]
    check = splitting.piece_checks(splitting.split_items(items)).first()
    assert (check.words, check.within_limit, check.shares_overlap) == (350, True, True)


def test_oversized_items(spark):
    many = "w " * 301
    rows = [("a", many, None, 1), ("a", many, None, 1), ("b", "w " * 300, None, 1), ("c", None, None, 1), ("d", "", None, 1), (None, many, None, 1)]
    df = spark.createDataFrame(rows, "key string, text string, loaded_at timestamp, piece int")
    items = splitting.oversized_items("t", df, "key", "text", "loaded_at")
    assert [tuple(r) for r in items.select("src", "item_key").collect()] == [("t", "a")]
    assert splitting.split_items(items).count() == 2 and splitting.split_items(items.limit(0)).count() == 0


# ---- 5


@pytest.mark.parametrize("text,label", markup.LABELLED)
def test_labelled_texts(text, label):
    blocks = markup.blocks_of(text)
    labels = label.split("|") if "|" in label else [label] * len(blocks)
    assert markup.families_of(text) == [f for f in markup.FAMILIES if any(f in own.split() for own in labels)]


HELD_OUT = [
    ("Keep it <em>warm</em> in every long sentence that goes on about caches and queues and their owners.", "html"), ("A & B < C > D", ""), ("In a long line about queues *must* is the only mark that stands among all of these plain words.", "markdown"),
    ("{{Stub}}\nA text about a thing.", "wiki"), ("[[Category:Things]]", "wiki"), ("\\subsection*{Metrics}\\label{sec:m}", "latex"), ("```\nopen fence with **bold** and <b>", ""), ("See `[[x]]` and `$a_b$` there.", ""),
    ("**Title:** words and a [**link**](/docs/x/ \"t\") with \\emph{force}", "markdown latex"), ("C:\\new\\item\\begin and D:\\sum", ""), ("Use <my-name> for $HOME and 3 * 4 * 5 of R&D [1][2].", ""),
]


@pytest.mark.parametrize("text,family", HELD_OUT)
def test_held_out_texts(text, family):
    assert markup.families_of(text) == [f for f in markup.FAMILIES if f in family.split()]


#: Texts whose blocks need their neighbours, apart from the table that the tree is grown from.
HELD_BLOCKS = (
    ("Keep it <em>warm</em> now.\n\nA plain block of words.\n\nAnd <b>cold</b>.", "html||html"),
    ("Before it words of text go on and on about the owner.\n\nwhile a <i and j> b holds, the queue of the owner is drained by the worker\n\nAfter it words of text go on.", "||"),
    ("Text says R&D and Q&A are kept.\n\nAll the rest is plain.", "|"),
    ("**Owners** and [queues](/q/)\n\n* one\n* two\n\n[More](/m/) of it", "markdown|markdown|markdown"),
    ("A long plain text about owners and queues and their sizes.\n\n* one\n* two\n\nA long plain text about caches and their owners.", "||"),
    ("The hook is __enter__ and then __exit__ in each of the classes here.", ""),
    ("The cost is 5*n plus n*2 for each of the owners that hold a queue here.", ""),
    ("[[Queue]] [[Owner]]\n\n* Cache\n\n'''Sizes''' of all", "wiki|wiki|wiki"),
    ("Helm writes {{ .Release.Name }} there.\n\nThen it is used.", "|"),
    ("In a loop {{ host }} is set by the tool to each of the names of the list.", ""),
    ("The test a == b fails and so does b == c in most of the runs of it.", ""),
    ("\\textbf{Sizes}\n\nup to 5\\% \\dots\n\n\\emph{more}", "latex|latex|latex"),
    ("Use \\t for a tab in the pattern.\n\nAnd no more than that.", "|"),
    ("A path like E:\\temp\\file is read by the loader of that system.", ""),
    ("[A](/a/) [B](/b/) [C](/c/)\n\n+ D\n\nMany plain words stand here about a queue and its owner and more.", "markdown|markdown|"),
    ("Many plain words stand here about a <i>queue</i> and its owner and about more of them than one can say.\n\nSo if a <b or c> d and R&D agree, the owner of the queue says so to all of the other owners.", "html|"),
    ("Many plain words stand here about [a queue](/q/) and its owner and about more of them than one can say.\n\nIt grows by 4*n or by m*2 in each of the rounds of the loop, as the owner of the queue says to all.", "markdown|"),
    ("[Up](/up/)\n\n+ Sizes\n\nMany plain words stand here about a queue and its owner.", "markdown|markdown|"),
    ("Many plain words about [a queue](/q/) stand here for its owner.\n\n+ Sizes\n\nMany plain words stand here about a queue and its owner.", "markdown||"),
    ("[[Up]]\n\n* Sizes\n\nMany plain words stand here about a queue and its owner.", "wiki|wiki|"),
    ("Many plain words about a [[queue]] stand here for its owner.\n\n* Sizes\n\nMany plain words stand here about a queue and its owner.", "wiki||"),
    ("Said ``so'' by the owner of the queue.\n\nNothing more was said then.", "|"),
    ("> quoted by someone\n\n| x | y |\n| 1 | 2 |\n\n~~old~~ new", "markdown|markdown|markdown"),
    ("The output was | a | b | in the log of the run.\n\n| c | d and more of the words that the log of the run had in it on that day |\n\nEnd.", "||"),
)


def accuracy(tree, table):
    got = [(markup.classify(tree, row), own) for f in markup.FAMILIES for row, own in zip(*markup.rows_of(table, f))]
    return sum(a == b for a, b in got) / len(got)


def test_held_out_accuracy():
    tree, one_test = markup.train(), markup.train(depth=1)
    assert accuracy(tree, HELD_BLOCKS) >= 0.95 > accuracy(one_test, HELD_BLOCKS)

    def used(t):
        return {markup.FEATURES[t.feature]} | used(t.below) | used(t.above) if not isinstance(t, int) else set()

    assert used(tree) & {"words_before", "words_after", "words"} and used(tree) & {"links", "links_before", "links_after"} and "strong_near" in used(tree)


@pytest.mark.parametrize(
    "text",
    ["def __init__(self): ...", "name: {{ .Values.name }}", "if x <b and y> c then", "say &copy in plain, AT&T and R&D", "* one\n* two", "C:\\new\\item", "a == b", "`**x**` and `<b>`", "Write <your-token> here & there", "x.__dict__ or __name__"],
)
def test_plain_text_is_left_alone(text):
    assert markup.clean(text) == text and markup.families_of(text) == []


def test_only_residue_changes():
    text = "Plain * text & more.\n\nA **bold** word and __init__ here.\n\nname: {{ .Values.name }}\n\n<p>if a <b and c> d &copy x &amp; y</p>"
    assert markup.clean(text) == "Plain * text & more.\n\nA bold word and __init__ here.\n\nname: {{ .Values.name }}\n\nif a <b and c> d &copy x & y"
    assert markup.clean("<pre>\na\n\nb\n</pre>") == "```\na\n\nb\n```" and markup.clean("<!-- a\n\nb -->c") == "c"


def test_clean_text_keeps_structure():
    text = "<h2>Head</h2>\n\n<ul><li>one</li><li><b>two</b></li></ul>\n\n```py\nx = '**a**' # [[b]]\n```\n\n\\[ a_1 = 2 \\] and '''bold''' [link](/x/) `<b>`\n\nTitle\n=====\n\n{| class=\"x\"\n! a !! b\n|-\n| 1 || 2\n|}"
    out = markup.clean(text)
    assert "## Head" in out and "- one\n" in out and "- two" in out and "```py\nx = '**a**' # [[b]]\n```" in out and "$$ a_1 = 2 $$" in out and "bold link `<b>`" in out and "# Title" in out and "1 | 2" in out
    assert markup.clean(None) is None and markup.clean("") == "" and markup.clean(" \n") == ""
    plain = "# A\n\n- one\n- two\n\nPlain <some-name> words & more."
    assert markup.clean(plain) == plain


def test_markup_operators(spark):
    df = spark.createDataFrame([(1, "<b>x</b> **y**", "h"), (2, None, "h"), (3, " ", "h"), (None, "<b>x</b>", "h"), (1, "<b>x</b>", "h"), (4, "plain " * 50000, "h")], "id long, text string, family string")
    assert sorted((r.row_key, r.family) for r in markup.residue(df, "id", "text").collect()) == [(1, "html"), (1, "html"), (1, "markdown")]
    assert markup.residue(df.limit(0), "id", "text").count() == 0
    assert {r.row_key: r.text for r in markup.cleaned(df.where("id < 4"), "id", "text").collect() if r.row_key != 1} == {2: None, 3: ""}


# ---- 6

Q = "How do I warm the shallow cache of silent-queue-3 when two late owners poll it?"
GOOD = "Set the flag first. Then the cache of silent-queue-3 is warmed while both owners wait for it. [1]"


@pytest.mark.parametrize(
    "answer,want",
    [
        (None, "empty"), ("", "empty"), (" \xa0\t", "empty"), ("​", "empty"), ("N/A", "empty"), ("[1][2]", "empty"), ("...", "empty"), ("-", "empty"), (GOOD, None), ("Yes.", None), ("`someName`", None), ("Sorry, that setting moved: use newName now [2].", None),
        ("You cannot warm a cache once the flag is set [1].", None), ("I do not know.", "refusal"), ("Unfortunately, the excerpts do not contain an answer to this [1].", "refusal"), ("As an assistant I am not able to answer questions about it.", "refusal"),
        (Q, "copies_question"), (f"**{Q.lower()}**", "copies_question"), (f"You asked: {Q}", "copies_question"), (f"{Q} The cache is warmed by its owner before the second one polls it. [1]", None),
        ("Der Speicher wird nach 3 Minuten durch eine Kopie ersetzt und ist nicht mehr warm.", "other_language"), ("silent-queue-3の設定を確認します。", "other_language"), ("The owners poll the cache and then", "truncated"), (GOOD + "\n\n```yaml\na: 1", "truncated"),
        (GOOD + "\n\n(Answer truncated: output limit reached.)", "truncated"), ("Steps:\n\n- Warm the cache\n- Poll the owner", None), ("It is warm (see the", "truncated"),
    ],
)
def test_defects(answer, want):
    assert pair_defects.defect(Q, answer, True, "end_turn", *NO_COUNTS) == want


def test_declining_what_cannot_be_answered_is_right():
    assert pair_defects.defect(Q, "I do not know.", False, "end_turn", *NO_COUNTS) is None
    assert pair_defects.defect(None, GOOD, None, None, *NO_COUNTS) is None


@pytest.mark.parametrize(
    "text,left",
    [
        ("a (b [c", ["(", "["]), ("```\n(\n```", []), ('say "x', ['"']), ("`(`", []), ("<table><tr><td>one", ["<table"]), ("<ul><li>x</ul> <b>y", ["<b"]), ("Use <your-name> (so)", []), ("\\begin{itemize}\n\\item x", ["\\begin{itemize}"]), ("\\begin{a}(\\end{a}", []), ("Steps:", ["list"]), ("Steps:\n\n- one", []), ("- one\n-", ["item"]),
        ("1. one\n2. ", ["item"]), ("<!-- a (b", ["<!--"]), ("~~~\nx", ["~~~"]), ("It is $$x", ["$$"]), ("", []), ("a `b\n\nc", []), ("“a „b” c”", []),
    ],
)
def test_pushdown(text, left):
    assert pair_defects.open_structures(text) == left


def test_tiling():
    a, b = pair_defects.tiling("a b c d e".split(), "x a b c y c d e".split(), 3)
    assert a.tolist() == [True, True, True, False, False] and b.sum() == 3
    assert pair_defects.tiling([], ["a"])[1].sum() == 0
    assert pair_defects.tiling("a b c".split(), "a b c a b c".split(), 3)[1].sum() == 3 and pair_defects.tiling("a b c".split(), "a b c a b c".split(), 3, True)[1].all()


@pytest.mark.parametrize(
    "answer,want",
    [
        (f"Question: {Q}\nAnswer: {Q}", True), (f"{Q} {Q}", True), (Q.replace("warm", "wram").replace("owners", "ownres"), True), (" ".join(reversed(Q.split())), False), (f"{Q} Only its first owner may do that. [1]", False), ("silent-queue-3", False),
    ],
)
def test_copies(answer, want):
    assert pair_defects.copies_question(Q, answer) == want


@pytest.mark.parametrize(
    "answer,want",
    [
        ("Unfortunately this is not covered by what I was given.", True), ("The model declined to answer this question.", True), ("I'm sorry, but the sources provided don't mention it.", True), ("Sorry, I can't help with that.", True), ("As an AI language model, I cannot answer this.", True), ("After reading the excerpts: the documentation I was given says nothing about it.", True),
        ("There isn't enough information in the context.", True), ("None of the passages mention that flag.", True), ("It's unclear from the documents.", True), ("I wasn't able to find an answer.", True), ("We do not have sufficient data to say.", True), ("That question is outside the scope of the documentation.", True), ("Leider kann ich das nicht beantworten.", True), ("Lo siento, no puedo responder.", True), ("Je ne sais pas.", True),
        ("You cannot warm a cache once it is set.", False), ("The probe is unable to release proxies until it is unbound.", False), ("Sorry to say, oldName was removed in 1.42; use newName.", False), ("The excerpt on q-3 says that ports can't be mounted without it; set it.", False), ("No image is validated while the probe is manual.", False), ("This is not a cache but a queue.", False), ("I set the flag first.", False), ("There are no caches in a queue.", False), ("", False),
    ],
)
def test_refusals(answer, want):
    assert pair_defects.is_refusal(answer) == want


LONG_REFUSAL = "I am very sorry, but honestly, " * 40 + "the excerpts do not mention it."


@pytest.mark.parametrize(
    "answer,want",
    [
        (LONG_REFUSAL, True), (" " * 700 + "I do not know.", True), ("— " * 400 + "I do not know.", True), ("as an " + "helpful " * 60 + "assistant I cannot answer", True), ("Sorry. " * 20_000 + "I cannot help.", True),
        ("Sorry. " * 20_000 + "The flag is set first.", False), ("that " * 20_000 + "is a cache", False), (" " * 579 + "The text says nothingness.", False),
    ],
)
def test_refusals_are_read_to_their_end(answer, want):
    assert pair_defects.is_refusal(answer) == want


@pytest.mark.parametrize(
    "lang,text",
    [
        ("pl", "Pamięć podręczna jest zastępowana po trzech minutach i nie jest już ciepła."), ("tr", "Önbellek üç dakika sonra yenisiyle değiştirilir ve artık sıcak değildir."), ("sv", "Cachen ersätts efter tre minuter och är inte längre varm."), ("fi", "Välimuisti korvataan kolmen minuutin kuluttua eikä se ole enää lämmin."), ("hu", "A gyorsítótár három perc után cserélődik, és már nem meleg."),
        ("ro", "Memoria cache este înlocuită după trei minute și nu mai este caldă."), ("id", "Cache diganti setelah tiga menit dan tidak lagi hangat."), ("nl", "De cache wordt na drie minuten vervangen en is niet meer warm."), ("it", "La memoria viene sostituita dopo tre minuti e non è più calda."), ("fr", "Le cache est remplacé après trois minutes et il n'est plus chaud."), ("de", "Der Speicher wird nach drei Minuten ersetzt und ist nicht mehr warm."),
        ("es", "La memoria se reemplaza después de tres minutos y ya no está caliente."), ("vi", "Bộ nhớ đệm được thay thế sau ba phút và không còn ấm nữa."), ("cyrillic", "Кэш заменяется через три минуты и больше не тёплый."), ("arabic", "يتم استبدال ذاكرة التخزين المؤقت بعد ثلاث دقائق."),
    ],
)
def test_languages_that_no_rule_names(lang, text):
    assert languages.language(text) == lang and languages.differ(Q, text) and not languages.differ(text, text)


@pytest.mark.parametrize("text", [GOOD, "Yes.", "`someName`", "The cache of silent-queue-3 is warmed.", "quorctl get queues --all", "Users detach a degraded buffer. [3]", ""])
def test_english_stays_english(text):
    assert not languages.differ(Q, text)


def test_pairs_table(spark):
    kind = "row_id long, run string, question string, answer string, answerable boolean, stop_reason string, loaded_at timestamp, defect string"
    df = spark.createDataFrame([(1, "r", Q, None, True, None, None, "x"), (1, "r", Q, None, True, None, None, "x"), (2, "r", None, GOOD, None, None, None, "x"), (None, "r", Q, "", True, None, None, "x")], kind)
    assert {r.row_id: r.defect for r in pair_defects.pair_kinds(df).collect()} == {1: "empty", 2: None}
    assert pair_defects.pair_kinds(df.limit(0)).count() == 0


def test_long_refusals_in_a_table(spark):
    kind = "row_id long, run string, question string, answer string, answerable boolean, stop_reason string, loaded_at timestamp"
    df = spark.createDataFrame([(1, "r", Q, LONG_REFUSAL, True, "end_turn", None), (2, "r", Q, LONG_REFUSAL, False, "end_turn", None), (3, "r", Q, " " * 700 + "I do not know.", None, None, None)], kind)
    assert {r.row_id: r.defect for r in pair_defects.pair_kinds(df).collect()} == {1: "refusal", 2: None, 3: "refusal"}


# ---- 8


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(max_size=60), max_size=5))
def test_encoding_equals_the_library(texts, reference):
    ids, at = bpe._Encoder(bpe.DEFAULT_VOCABULARY).batch(texts)
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [reference(t) for t in texts]


def test_token_statistics(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "a", None)], "doc_id long, text string, source string")
    assert {r.source: (r.texts, r.without_tokens, r.tokens) for r in bpe.token_statistics(df).collect()} == {"x": (3, 1, 4), None: (1, 0, 1)}


def test_encoding_table(spark, reference):
    odd = ["aaaaaaa" * 300, "<|endoftext|>", "²³ ⅷ½", " \n\n  x  ", "don't we'LL", "x" * 30000]
    rows = [(1, None, 0), (2, "", 0), (None, "word", 0), (2, "", 0), *[(10 + i, t, 0) for i, t in enumerate(odd)]]
    got = bpe.encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect()
    assert len(got) == len(rows) and sorted((r.doc_id or -1, r.ids) for r in got) == sorted((a or -1, reference(t or "")) for a, t, _ in rows)
    assert bpe.encode_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- 9


def test_leaks(spark):
    rng = random.Random(5)
    passage = lambda: [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(50)]
    passages = {i: passage() for i in range(20)}
    filler = lambda n: [f"z{rng.randrange(9000)}" for _ in range(n)]
    docs, want = [], set()
    for d in range(60):
        i = rng.randrange(20)
        words = list(passages[i])
        kind = d % 6
        if kind == 0:
            words = words[: rng.randrange(27, 50)]
        elif kind == 1:
            words = words[:25] + filler(8) + words[25:]
        elif kind == 2:
            for k in range(5, 50, 10):
                words[k] = "changed"
        elif kind == 3:
            words = words[10:18]  # a phrase
        elif kind == 4:
            rng.shuffle(words)
        elif kind == 5:
            words = [w.upper() + rng.choice([",", "\n", "</b>"]) for w in words]
        docs.append((d, " ".join(filler(100) + words + filler(100))))
        if kind not in (3, 4):
            want.add((d, i))
    docs += [(100, None), (101, ""), (102, "x"), (None, " ".join(passages[0]))]
    held = spark.createDataFrame([(i, " ".join(w), 0) for i, w in passages.items()] + [(50, None, 0), (51, "not there", 0), (None, "a b c d e f", 0)], "item_id long, text string, doc_id int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = leakage.leaked_passages(df, held)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert {r.item_id for r in leakage.leak_report(got, held.where("item_id is not null")).where("documents = 0").collect()} >= {50, 51}
    assert leakage.leaked_passages(df.limit(0), held).count() == 0 and leakage.leaked_passages(df, held.limit(0)).count() == 0


def test_short_passages_leak_as_a_whole(spark):
    held = spark.createDataFrame([(1, "one two three four"), (2, "Lonely"), (3, "one two"), (4, "..."), (5, "a b c d e f g h")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "say ONE, two <b>three</b> four then"), (2, "one two four three"), (3, "so lonely here"), (4, "c d e f"), (5, "")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_passages(docs, held).collect()} == {(1, 1), (1, 3), (2, 3), (3, 2)}


def test_the_search_finds_every_window():
    rng = random.Random(9)
    passages = {i: [f"w{rng.randrange(12)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 30]))] for i in range(40)}
    texts = [[f"w{rng.randrange(12)}" for _ in range(rng.choice([0, 1, 4, 5, 60]))] for _ in range(60)]
    got = leakage.WuManber(passages).search(texts)
    for text, found in zip(texts, got):
        want = {}
        for i, p in passages.items():
            m = min(leakage.PATTERN, len(p))
            for at in range(len(text) - m + 1):
                for k in range(len(p) - m + 1):
                    if text[at : at + m] == p[k : k + m]:
                        want.setdefault(i, set()).add((k, at))
        assert {i: set(x) for i, x in found.items()} == want


def test_several_rounds_find_the_same(spark, monkeypatch):
    held = spark.createDataFrame([(i, " ".join(f"p{i}w{k}" for k in range(40))) for i in range(12)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "so " + " ".join(f"p{i}w{k}" for k in range(40))) for i in range(12)], "doc_id long, text string")
    monkeypatch.setattr(leakage, "WORDS_A_ROUND", 100)
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_passages(docs, held).collect()} == {(i, i) for i in range(12)}


# ---- 10


@pytest.mark.parametrize(
    "text,cut",
    [
        ("A whole sentence.", False), ("A sentence that stops in the mid", True), ("He reads the log and", True), ("It waits…", True), ("It waits, and so on ...", False), ("It wai...", True), ("Words (read more)", True), ("Words [...]", True), ("```\nx = 1", True), ("```\nx = 1\n```", False),
        ("A.\n\n| a | b |\n| 1 | 2 |", False), ("A.\n\n| a | b |\n| 1 |", False), ("A.\n\n| a | b |\n| 1 | 2", True), ("A.\n\n— the cache team, 1.42", False), ("See also: /docs/x/y-3/", False), ("A tag ends it.</p>", False), ("確認します。", False), ("ノードの設定は", True), ("broken byte \ufffd", True), ("Steps:\n- ", True),
    ],
)
def test_endings(text, cut):
    assert (truncation.PRIOR + truncation.ending(text, None, *NO_COUNTS)[1] > 0) == cut


def test_censored_fit_recovers_the_parameters():
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(6.5, 0.6, 20000)).astype(int)
    cut = np.minimum(x, 800)
    lengths, counts = np.unique(cut, return_counts=True)
    mu, sd = truncation.fit_censored(lengths, counts, {800: int((cut == 800).sum())})
    assert abs(mu - 6.5) < 0.03 and abs(sd - 0.6) < 0.03


def test_limits_and_rates(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(i) for _ in range(rng.randrange(20, 120))) + "."
        limited = i % 2 == 0
        rows.append((i, text[:400] if limited else text, "limited" if limited else "free", None))
    truth = {r[0] for r in rows if r[2] == "limited" and not r[1].endswith(".")}
    rows += [(1000, None, "free", None), (1001, "", "free", None), (1002, " \n", None, 5), (1003, "whole text.", None, None), (1, rows[1][1], "free", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    assert [(r.source, r.limit) for r in truncation.length_limits(df).collect()] == [("limited", 400)]
    assert {r.doc_id for r in truncation.truncated(df).collect()} == truth
    rates = {r.source: (r.texts, r.cut) for r in truncation.truncation_rates(df).collect()}
    assert rates["limited"] == (300, len(truth)) and rates[""] == (1, 0)
    assert truncation.truncated(df.limit(0)).count() == 0


def test_leaks_in_short_or_distant_parts():
    words = [f"w{i}" for i in range(40)]
    search = leakage.WuManber({1: words})
    short = [*words[:4], "x", *words[5:9], "y", *words[10:14], "a", "remark", *words[14:20]]  # two words changed, one remark
    distant = [*words[:10], *[f"remark{i}" for i in range(60)], *words[10:20]]
    filler = [f"f{i}" for i in range(200)]
    for text in (short, distant):
        assert [item for item, _ in search.leaks(filler + text + filler)] == [1]
    assert search.leaks(filler + words[:6] + filler + words[20:26] + filler) == []
    strewn = [*words[30:35], *filler[:20], *words[20:24], *filler[20:40], *words[10:15], *filler[40:60], *words[:4]]
    assert search.leaks(filler + strewn + filler) == []
