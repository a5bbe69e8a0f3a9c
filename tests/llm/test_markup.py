import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tiesmith.llm import markup as m

CASES = [
    ("<h2 id='a'>\n<em>Dense</em> waves &amp; R&amp;D\n</h2>\n<p>Text.</p>", [("heading", "Dense waves & R&D")]),
    ("<ul>\n<li>One <a href=\"./X_y\">link</a>\n<li>Two<ul><li>Inner</li></ul></li>\n</ul>", [("list_item", "One link"), ("list_item", "Two"), ("list_item", "Inner")]),
    ("<pre class=\"code\">\nif (a &lt; 2 &amp;&amp; b) return;\n</pre>", [("code", "if (a < 2 && b) return;")]),
    ("<pre><code>x := y ** 2\n# c</code></pre>", [("code", "x := y ** 2 # c")]),
    ("What <span class=\"tex\">\\(a &lt; b\\)</span> is <math> c^2 </math>.", [("formula", "a < b"), ("formula", "c^2")]),
    ("## Pure **waves** ##\n\ntext\n\nTitle (5%)\n----------\n\n**Bold** title\n=====\n", [("heading", "Pure waves"), ("heading", "Title (5%)"), ("heading", "Bold title")]),
    ("1. One [A (b)](./A_%28b%29)\n2. Two\n    * Inner `x`\n", [("list_item", "One A (b)"), ("list_item", "Two"), ("list_item", "Inner x")]),
    ("# Title\n## Part\ntext\n", [("heading", "Title"), ("heading", "Part")]),
    ("```\na\n\nb\n```\n\n<pre>\nc\n\nd</pre>\n\n\\begin{verbatim}\ne\n\nf\n\\end{verbatim}\n", [("code", "a b"), ("code", "c d"), ("code", "e f")]),
    ("```\na\n\nprose\n\n<pre>b\n\nprose", [("code", "a"), ("code", "b")]),
    ("```python\n# not a heading\n* no item\n```\n\n~~~\na\n~~~\n", [("code", "# not a heading * no item"), ("code", "a")]),
    ("A [link](./X) and $\\frac{a}{b}$ and \\(x=1\\).\n\n$$\nE = m\n$$\n", [("formula", "\\frac{a}{b}"), ("formula", "x=1"), ("formula", "E = m")]),
    ("==Slow [[Tide|tides]]==\n\n# One {{lang|xx|word}}\n#Two [[X]]\n## Deep\n\n* A '''b'''\n*C\n", [("heading", "Slow tides"), ("list_item", "One word"), ("list_item", "Two X"), ("list_item", "Deep"), ("list_item", "A b"), ("list_item", "C")]),
    ("[[X]]<source lang=\"f\">a < b</source> <syntaxhighlight lang=\"p\">c</syntaxhighlight>", [("code", "a < b"), ("code", "c")]),
    ("\\documentclass{article}\n\\begin{document}\n\\section{Waves \\& 5\\%}\n\\begin{itemize}\n\\item One {\\it fast} \\href{./X_\\%28a\\%29}{link}\n\\item Two \\cite{r}\n\\end{itemize}\n\\begin{verbatim}\n* x \\y\n\\end{verbatim}\n\\[a+b\\]\n\\end{document}", [("heading", "Waves & 5%"), ("list_item", "One fast link"), ("list_item", "Two"), ("code", "* x \\y"), ("formula", "a+b")]),
]


@pytest.mark.parametrize(("text", "elements"), CASES)
def test_elements(text, elements):
    doc = m.Document(text)
    assert doc.marked and doc.elements() == elements


PLAIN = [
    "where 5 < 7 and 9 > 3 [sic] in C# minor with R&D", "for $3,200 and later $40 as sample #12 at ~40 degrees", "the set {a, b} (*) see below a == b at 5*3*2 cm", "x^2 larger using file plate_07_b on \\\\store\\plates",
    "paid $ 256.15 million for it, $ 3 more", "inverted** wave and a star* here", "1. and 2. edition", "", "   ", "just words\nand more words",
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_texts_stay(text):
    doc = m.Document(text)
    assert not doc.marked and not doc.elements() and doc.clean()[0] == text


@pytest.mark.parametrize("text", ["a </div> b", "x <span class=x>y", "a **screen** b [l](./X)", "''x'' [[Y]]", "{{citation needed}} x", "a&nbsp;b", "<!-- c --> d", "[301]: ./Note"])
def test_residue_is_markup(text):
    doc = m.Document(text)
    assert doc.marked
    assert not any(c in doc.clean()[0] for c in ("<", "[[", "{{", "**", "''", "&nbsp;", "]:"))


def test_boilerplate_goes_by_its_score():
    prose = "<p>" + "Long, flowing text about waves, tides and stars, with commas. " * 6 + "</p>"
    links = "".join(f'<li><a href="./P{k}">Page {k}</a></li>' for k in range(12))
    page = f"<html><body><nav><ul>{links}</ul></nav><div class='content'>{prose}{prose}</div><div class='sidebar'><a href='./x'>more</a></div><section>{prose}</section></body></html>"
    doc = m.Document(page)
    clean, _ = doc.clean()
    assert "Page 3" not in clean and "more" not in clean and clean.count("flowing") == 18 and not doc.elements()


PROSE = "<p>" + "Long, flowing text about waves, tides and stars, with commas. " * 6 + "</p>"


@pytest.mark.parametrize(
    ("block", "stays"),
    [
        ("<div>Share this page with a friend</div>", False), ("<div><a href='./login'>Login</a></div>", False), ("<table><tr><td><a href='./a'>One</a> <a href='./b'>Two</a></td></tr></table>", False),
        ("<ul>" + "<li><a href='./x'>Page of links</a></li>" * 9 + "</ul>", False), ("<div>It ended here.</div>", True), ("<ul><li>Small item</li></ul>", True), ("<div><h3>Head</h3></div>", True),
        ("<div class='menu'>It ended here.</div>", False), ("<div class='menu'>" + PROSE + "</div>", True), ("<section>" + "Words and <a href='./x'>a link</a> in a text that goes on for a while, as texts do. " * 2 + "</section>", True),
        ("<pre>x = 1</pre>", True), ("<div>never closed <b>x</b>", True),
    ],
)
def test_scores_decide_without_names(block, stays, monkeypatch):
    page = f"<html><body><div>{PROSE}{PROSE}</div>{block}</body></html>"
    shown = m._TAG.sub("", block).split()[0]
    assert (shown in m.Document(page).clean()[0].replace("Long, flowing", "", 12 if "Long" not in block else 0)) == stays
    monkeypatch.setattr(m, "dull", lambda work, tags: [])
    assert shown in m.Document(page).clean()[0]


@pytest.mark.parametrize("size", [300, 5_000, 100_000])
def test_inline_marks_of_any_length(size):
    words = "word " * (size // 5)
    doc = m.Document(f"A $x = {words}y$ and **{words}end** and `{words}end`.")
    assert doc.elements() == [("formula", f"x = {words}y")] and not set("*`") & set(doc.clean()[0])
    wrapped = m.Document("Some **bold\nand long** words\n\nno **bold\n\nhere** at all")
    assert wrapped.clean()[0] == "Some bold\nand long words\n\nno **bold\n\nhere** at all"


def test_templates_of_any_depth():
    deep = "{{a|" * 20_000 + "x" + "}}" * 20_000
    assert m.Document(f"One {deep} two").clean()[0] == "One  two"
    assert m.Document("One {{lang|fr|mot {{nowrap|a b}} {{gone|x}}}} {{{raw}}} {{open").clean()[0] == "One mot a b  {} {{open"
    assert m.Document("{{x|{y} z}} [[A]]").clean()[0] == "{{x|{y} z}} A"


def test_links_follow(spark):
    text = "Intro <b>bold</b> [link word](./Target_x) &amp; end"
    a = text.index("link word")
    links = [(a, a + 9, "link word", "Target x"), (None, None, "gone", "G"), (6, 9, "<b>", "Markup"), (5, 900, "far", "F")]
    kind = "doc_id bigint, text string, links array<struct<start_char:int,end_char:int,surface:string,target_title:string>>, elements int"
    rows = {r.doc_id: r for r in m.cleaned(spark.createDataFrame([(1, text, links, 0), (2, None, None, 0), (3, "", [None], 0)], kind)).collect()}
    held = rows[1].links
    assert rows[1].clean_text == "Intro bold link word & end"
    assert rows[1].clean_text[held[0].start_char : held[0].end_char] == held[0].surface == "link word"
    assert [x.start_char for x in held[1:]] == [None, None, None]
    assert rows[2].clean_text is None and rows[2].links is None and rows[3].clean_text == ""


def test_frame_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "## Head\n\ntext", "x"), (3, "## Head\n\ntext", "x"), (4, "word " * 100_000 + "<b>x</b>", "x")], "doc_id bigint, text string, marked string")
    rows = m.parse(df).collect()
    assert sorted((r.doc_id, r.marked, len(r.elements)) for r in rows) == [(1, False, 0), (2, False, 0), (3, True, 1), (3, True, 1), (4, True, 0)]
    assert m.parse(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "<h2>", "</h2>", "\n\n", "\n", "* ", "# ", "## ", "==", "[[", "]]", "{{", "}}", "**", "''", "$", "\\(", "\\)", "\\item ", "\\section{", "}", "```", "<pre>", "</pre>", "&amp;", "word", " a b ", "|", "](./x)", "["]), max_size=25))
def test_any_mixture_is_taken(parts):
    text = "".join(parts)
    doc = m.Document(text)
    clean, starts = doc.clean()
    assert len(starts) == len(text) + 1 and starts[-1] == len(clean) and starts == sorted(starts)
    assert all(k in m.KINDS and c == " ".join(c.split()) and c for k, c in doc.elements())


def test_very_long_texts_take_time_in_proportion():
    import time

    page = "<div>" + "<h2>Head</h2><ul>" + "<li>Item <a href='./X'>x</a> one</li>" * 20_000 + "</ul></div>\n\n" + "* One [[X]]\n" * 20_000 + "\n\\begin{itemize}\n" + "\\item A {\\it b}\n" * 20_000
    began = time.time()
    doc = m.Document(page)
    assert len(doc.ranges) == 60_001 and {k for k, _ in doc.elements()} == {"heading", "list_item"}
    assert time.time() - began < 30
