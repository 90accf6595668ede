"""Template calls, HTML, fences, sections and chunks."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.functions import fences, html, sections, shortcodes
from loomspark.operators import pages

TERMS = {"tidegate": {"title": "Tidegate", "body": "Holds back writes. <b>Slow</b> ones too.\n\n<!-- more -->\n\nSince 1.41."}}
GATES = {"ShallowCache": [{"stage": "alpha", "fromVersion": "1.41", "toVersion": "1.42", "defaultValue": False}, {"stage": "beta", "fromVersion": "1.43", "toVersion": None, "defaultValue": True}]}
FILES = {"before.md": "---\ntitle: x\n---\nRun {{< skew currentVersion >}} first.", "round.md": "again {{< include \"round.md\" >}}", "relay/queue.yaml": "    relay:\n      size: 3\n", "gates/ShallowCache": "Keeps it {{< glossary_tooltip term_id=\"tidegate\" >}}."}
SITE = shortcodes.Site("1.43", "1.44", {"latest": "v1.44", "owner": "cache team"}, {"cleanup_heading": "Cleaning up", "warning": "Beware:"}, TERMS, GATES, FILES, {"/docs/tasks/drain/": "Drain"}, {"1.43": "1.43.7"}, "Quorvane")


def shape(nodes):
    """A tree as nested tuples: texts, and (name, arguments, inner)."""
    return [n if isinstance(n, str) else (n.name, *n.args, *sorted(n.named.items()), *([shape(n.inner)] if n.inner is not None else [])) for n in nodes]


@pytest.mark.parametrize(
    "text,want",
    [
        ("", []), ("{{ .Values.size }} and {{<", ["{{ .Values.size }} and {{<"]), ("{{< skew prevMinorVersion>}}", [("skew", "prevMinorVersion")]), ("{{%heading `cleanup`%}}!", [("heading", "cleanup"), "!"]),
        ("{{< figure\n src=/a.svg\n caption=\"A \\\"wide\\\" one\" >}}", [("figure", ("caption", 'A "wide" one'), ("src", "/a.svg"))]), ("{{< tab include=`x > y.md` / >}}.", [("tab", ("include", "x > y.md")), "."]),
        ("{{< warning >}}a{{< skew x >}}b{{< /warning >}}c", [("warning", ["a", ("skew", "x"), "b"]), "c"]), ("{{< tabs >}}{{% tab name=x %}}1{{% /tab %}}{{% tab name=y %}}2{{% /tab %}}{{< /tabs >}}", [("tabs", [("tab", ("name", "x"), ["1"]), ("tab", ("name", "y"), ["2"])])]),
        ("{{< p >}}{{< q >}}t{{< /p >}}u{{< /q >}}", [("p", [("q",), "t"]), "u"]), ("x{{< /p >}}y", ["xy"]), ("{{< p >}}left open {{< q >}}", [("p",), "left open ", ("q",)]), ("{{</* p \"a\" */>}} stays", ['{{< p "a" >}} stays']), ('{{< p "open >}} stays', ['{{< p "open >}} stays']),
    ],
)
def test_calls(text, want):
    assert shape(shortcodes.parse(text)) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "{{< p >}}", "{{< /p >}}", "{{% q x=1 %}}", "{{% /q %}}", "{{<", ">}}", "\n"]), max_size=20))
def test_no_text_is_lost(parts):
    def texts(nodes):
        return "".join(n if isinstance(n, str) else texts(n.inner or []) for n in nodes)

    calls = ("{{< p >}}", "{{< /p >}}", "{{% q x=1 %}}", "{{% /q %}}")
    if not any(p in ("{{<", ">}}") for p in parts):
        assert texts(shortcodes.parse("".join(parts))) == "".join(p for p in parts if p not in calls)
    else:
        shortcodes.parse("".join(parts))


@pytest.mark.parametrize(
    "text,want",
    [
        ("{{< warning >}}\nFrom {{< skew currentPatchVersion >}} on.\n{{< /warning >}}", "**Beware:** From 1.43.7 on."), ('{{% heading "cleanup" %}}', "Cleaning up"), ('{{< alert title="Mind" >}}x{{< /alert >}}', "**Mind:** x"), ("{{< alert >}} x {{< /alert >}}", "x"),
        ('A {{< glossary_tooltip term_id="TideGate" >}}', "A Tidegate"), ('{{< glossary_tooltip text="gates" term_id="tidegate" >}}', "gates"), ('{{< glossary_definition term_id="tidegate" length="short" prepend="It" >}}', "It holds back writes. **Slow** ones too."), ('{{< glossary_definition term_id="tidegate" >}}', "Holds back writes. **Slow** ones too.\n\nSince 1.41."),
        ('{{< skew nextMinorVersion >}} {{< skew prevMinorVersion >}} {{< skew oldestMinorVersion >}} {{< skew latestVersion >}}', "1.45 1.43 1.42 1.44"), ('{{< skew currentVersionAddMinor -2 "-" >}} {{< skew latestVersionAddMinor 1 >}}', "1-41 1.45"), ("{{< latest-version >}} {{< latest-semver >}} {{< release-branch >}} {{< param owner >}}", "v1.44 1.44 release-1.44 cache team"),
        ('{{< include "before" >}}', "Run 1.43 first."), ('{{< code_sample file="/relay/queue.yaml" >}}', "Example file `relay/queue.yaml`:\n\n```yaml\nrelay:\n  size: 3\n```"), ('{{< highlight py "hl_inline=true" >}} x {{< /highlight >}}', "`x`"), ("{{< highlight py >}}\n  <b>x</b>\n{{< /highlight >}}", "```py\n<b>x</b>\n```"),
        ('{{< tabs >}}{{< tab name="A" codelang="sh" >}}ls{{< /tab >}}{{< tab name="B" include="before.md" />}}{{< /tabs >}}', "**A**\n\n```sh\nls\n```\n**B**\n\nRun 1.43 first."), ('{{< details summary="More" >}}x{{< /details >}}', "**More**\n\nx"), ('{{< table caption="Sizes" >}}\n|a|\n{{< /table >}}', "Table: Sizes\n\n|a|"),
        ('{{< figure title="A" alt="b" >}}', "*Figure: A b*"), ('[d]({{< ref "/docs/tasks/drain#fast" >}}) {{< link text="t" url="/u/" >}}', "[d](/docs/tasks/drain/#fast) [t](/u/)"), ('{{< feature-gate-description name="ShallowCache" >}}', "`ShallowCache`: Keeps it Tidegate."), ("{{< mermaid >}}a-->b{{< /mermaid >}}x", "x"), ("{{< dockershim-removal >}}", "**Note:** dockershim_message"),
        ("```\n{{< skew currentVersion >}} <b>x</b> <!-- kept -->\n```\n<b>y</b> <!-- gone -->", "```\n1.43 <b>x</b> <!-- kept -->\n```\n**y**"),
    ],
)
def test_rendering(text, want):
    r = shortcodes.clean(text, SITE)
    assert r.text == want + "\n" and r.warnings == []


def test_states_and_warnings():
    r = shortcodes.clean('{{< feature-state feature_gate_name="ShallowCache" >}}\n{{< feature-state state="stable" for_server_version="v1.42" >}}\n{{< nothing-such >}}kept{{< /nothing-such >}}', SITE)
    assert r.text == "Feature state: `Quorvane v1.43 [beta]` enabled by default\nFeature state: `Quorvane v1.42 [stable]`\nkept\n"
    assert [(s["feature_gate"], s["state"], s["since"], s["default_enabled"]) for s in r.states] == [("ShallowCache", "beta", "1.43", True), (None, "stable", "1.42", None)]
    assert r.warnings == ["unknown call: nothing-such"]
    assert shortcodes.clean('{{< include "round.md" >}}', SITE).warnings == ["include too deep: round.md"]
    missing = '{{< include "no.md" >}}{{< param no >}}{{< skew no >}}{{< glossary_tooltip term_id="no" >}}{{< ref "no" >}}{{< code file="no" >}}{{< feature-state feature_gate_name="no" >}}'
    assert len(shortcodes.clean(missing, SITE).warnings) == 7
    assert shortcodes.clean("{{< version-check >}}", SITE, {"min-server-version": "1.42"}).text == "Your server must be at or later than version 1.42. To check the version, enter `version`.\n"
    assert shortcodes.clean('{{< ref "drain.md#x" >}}', SITE, None, "/docs/tasks/fill/").text == "/docs/tasks/drain/#x\n"


@pytest.mark.parametrize(
    "markup,want",
    [
        ("Keep `<owner>/<queue>` & <your-token>", "Keep `<owner>/<queue>` & <your-token>"), ("<B>Drain</B> the <code>tidegate</code>&#8212;<var>now</var>", "**Drain** the `tidegate`—*now*"), ("<a href='/docs/a/'><b>A</b></a> <a name=x></a><img src=i alt='An image'>", "[**A**](/docs/a/) An image"),
        ("one<br>two<br/>three", "one\ntwo\nthree"), ("<h3 id=z>Sizes </h3>", "\n### Sizes\n"), ("<ol><li>a<li>b <i>c</i></ol>", "\n- a\n- b *c*"), ("<dl><dt>k<dd>v</dl>", "\n- k\n  v"), ("<pre><code>a &lt;b&gt;\n</code></pre>", "\n```\na <b>\n```\n"), ("<!-- a <b>remark</b> -->x", "x"), ("<b>open and <span>left", "open and left"), ("x</b> y", "x y"), ("a<b", "a<b"),
        ("<table><tr><th>Flag</th><th>Of</th><th>Is</th></tr><tr><td>-v</td><td>all</td><td></td></tr></table>", "\n- Flag: -v; Of: all\n"), ("<table><tr><td>size <strong>*</strong></td><td>How many\n  rows.</td></tr><tr><td></td><td>At least 3.</td></tr></table>", "\n- size (required): How many rows.\n  At least 3.\n"),
        ("<table><tr><td>a<td>b<td>c</table>", "\n- a | b | c\n"), ("<table><caption>T</caption><tr><td>k</td><td><table><tr><td>i</td><td>j</td></tr></table></td></tr></table>", "\nTable: T\n- k: - i: j\n"), ("<table><tr><td>never <i>closed", "never closed"),
        ("<b>x</b>\n```\n<b>y</b> &lt; <table>\n```\n<i>z</i>", "**x**\n```\n<b>y</b> &lt; <table>\n```\n*z*"), ("~~~\n<b>open fence</b>", "~~~\n<b>open fence</b>"),
    ],
)
def test_html(markup, want):
    assert html.convert(markup) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abtr d'\"=&;!-`\n", max_size=60))
def test_html_never_fails(text):
    assert isinstance(html.convert(text), str)


def test_fences(spark):
    text = "a <!-- x -->\n```py\n<!-- y -->\n```\nb <!-- z\n~~~\nc --> d\n~~~\n<!-- w -->e"
    assert [code for code, _ in fences.parts(text)] == [False, True, False, True, False] and "".join(p for _, p in fences.parts(text)) == text
    row = spark.createDataFrame([(text,), (None,), ("```\nopen <!-- a -->",)], "t string").select(fences.without_comments(F.col("t")).alias("c"), fences.prose(F.col("t")).alias("p")).collect()
    assert row[0].c == "a \n```py\n<!-- y -->\n```\nb <!-- z\n~~~\nc --> d\n~~~\ne" and row[0].p == "a <!-- x -->\nb <!-- z\n<!-- w -->e"
    assert row[1].c is None and row[2].c == "```\nopen <!-- a -->" and row[2].p == ""


def test_sections():
    page = "Words first.\n\n## Fill\n\nF.\n\n#### Deep {#very-deep}\n\nD.\n\n### Less deep\n\nL.\n\n## Fill\n\n~~~\n## not a heading\n~~~\n\n```\nnever closed\n\n## Last"
    got = sections.parse_sections("Queue", page)
    assert [(s.path[1:], s.anchor) for s in got] == [([], ""), (["Fill"], "fill"), (["Fill", "Deep"], "very-deep"), (["Fill", "Less deep"], "less-deep"), (["Fill"], "fill-1"), (["Last"], "last")]
    assert [b.is_code for b in got[4].blocks] == [False, True, False]
    assert [b.text for b in sections.parse_sections("Q", "# Q\n\nOnly this.")[0].blocks] == ["# Q", "Only this."]


def test_states_hold_below_their_section():
    text = "\n\n".join(["## Cache", "Feature state: `v1.43 [beta]`", "c " * 90, "### Shallow", "s " * 90, "## Queue", "q " * 90])
    state = {"feature_gate": "ShallowCache", "state": "beta", "since": "1.43", "default_enabled": True}
    assert {c["anchor"]: c["feature_states"] for c in sections.chunk("P", text, [state])} == {"cache": [state], "shallow": [state], "queue": []}
    assert sections.assign_states(sections.parse_sections("P", text + "\n\nFeature state: `v1.44 [stable]`"), [state]) == 2


def test_chunks():
    small = sections.chunk("P", "## One\n\nFew words.\n\n## Two\n\n" + "many " * 80)
    assert [(c["anchor"], c["heading_path"]) for c in small] == [("one", ["P", "One"])] and small[0]["text"].split()[-1] == "many"
    code = sections.chunk("P", "## C\n\n~~~sh\n" + "\n".join(f"drain --queue q{i} --wait {i}" for i in range(300)) + "\n~~~", most=200)
    assert len(code) > 3 and all(c["n_tokens"] <= 200 and c["text"].count("~~~") == 2 for c in code)
    items = sections.chunk("P", "\n".join(f"- item {i}\n  {'goes on ' * 10}" for i in range(60)), most=150)
    assert all(c["text"].startswith("- item") and c["text"].rstrip().endswith("on") for c in items)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["word word", "## Head", "", "```", "  more", "# One", "x" * 30, "a b c d e f g h i j k l"]), max_size=60), st.integers(5, 40))
def test_chunks_keep_all_words_under_the_limit(lines, most):
    text = "\n".join(lines)
    got = sections.chunk("T", text, None, most, 3)
    assert all(c["n_tokens"] <= most for c in got)
    if "```" not in text:
        assert " ".join(c["text"] for c in got).split() == text.split()


def test_pages(spark):
    df = spark.createDataFrame([("p", "T", "{{< note >}}<b>x</b>{{< /note >}} {{< no >}}", 1), ("q", None, None, 2), ("r", "T", "plain", 3)], "id string, title string, text string, warnings int")
    got = {r.id: r for r in pages.render_pages(df, "id", "text", SITE).collect()}
    assert got["p"].text == "**Note:** **x**\n" and got["q"].text is None and got["r"].text == "plain\n"
    assert {r.id: r.text for r in pages.convert_html(df, "id", "text").where("id <> 'p'").collect()} == {"q": None, "r": "plain"}
    assert [r.chunk_id for r in pages.chunk_pages(df, "id", "title", "text").orderBy("chunk_id").collect()] == ["p::0", "r::0"]
    assert pages.chunk_pages(df.limit(0), "id", "title", "text").count() == 0
    report = pages.cleaning_report(pages.render_pages(df, "id", "text", SITE), "id").where("id = 'p'").first()
    assert (report.pages, report.warnings, report.tags_left) == (1, 1, 0)
    assert [tuple(r) for r in pages.warning_counts(pages.render_pages(df, "id", "text", SITE)).collect()] == [("unknown call: no", 1)]


def test_pages_by_joins(spark, monkeypatch):
    rows = [(1, '{{< include "before.md" >}}{{< feature-gate-description name="ShallowCache" >}}', "/docs/a/"), (2, '{{< glossary_definition term_id="TIDEGATE" >}}{{< feature-state feature_gate_name="ShallowCache" >}}', None), (3, "none", None), (4, None, None), (5, '{{< include "round.md" >}}{{< param owner >}}', None)]
    df = spark.createDataFrame(rows, "id long, t string, path string")
    glossary = spark.createDataFrame([(k, v["title"], v["body"]) for k, v in TERMS.items()], "id string, title string, body string")
    gates = spark.createDataFrame([(k, v) for k, v in GATES.items()], "name string, stages array<struct<stage:string,fromVersion:string,toVersion:string,defaultValue:boolean>>")
    files = spark.createDataFrame(list(FILES.items()), "key string, value string")
    names = {"params": spark.createDataFrame(list(SITE.params.items()), "key string, value string"), "labels": spark.createDataFrame(list(SITE.labels.items()), "key string, value string")}
    whole = pages.site_of("1.43", "1.44", glossary=glossary, gates=gates, files=files, product="Quorvane", **names)
    want = {r.id: r for r in pages.render_pages(df, "id", "t", whole, None, "path").collect()}
    own = pages.site_of("1.43", "1.44", product="Quorvane", **names)
    got = {r.id: r for r in pages.render_pages_by_joins(df, "id", "t", own, glossary, gates, files, None, "path").collect()}
    assert got == want and "Keeps it Tidegate" in got[1].text and len(got[2].feature_states) == 1 and got[5].warnings
    monkeypatch.setattr(pages, "SITE_MOST", 10)
    assert pages.site_of("1.43", "1.44", files=files) is None
    assert json.loads(json.dumps(want[3].text)) == "none\n"


def test_registered_functions(spark):
    from loomspark.functions import registered

    registered.register(spark)
    assert spark.sql("SELECT html_to_markdown('<b>x</b>')").first()[0] == "**x**"
    assert spark.sql("SELECT c.ord, c.anchor FROM (SELECT '## A\n\nwords' AS t) p, LATERAL chunk_text('T', p.t, 100, 5) c").collect()[0].anchor == "a"
