"""What style sheets hide, and the article of pages that don't mark one."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import gates, html, readability
from inkwell.operators.visibility import Sheet, _steps, declarations, specificity

SENTENCE = "The committee, which met on Monday, found that the bridge, built in 1911, needs repairs before winter comes."
LINKS = "".join(f'<li><a href="/{w}">{w} and more of it</a></li>' for w in ("news", "sports", "weather", "travel", "shop"))


def page(body, css=""):
    return f'<html lang="en"><head><title>T</title><style>{css}</style></head><body>{body}</body></html>'


@pytest.mark.parametrize(("css", "hidden"), [
    (".a{display:none}", True), (".a { color: red; DISPLAY : None !important }", True), ("p.a{visibility:hidden}", True), (".a{opacity:0.0}", True), (".a{opacity:.5}", False),
    ("#x .a{display:none} .a{display:block}", True), (".a{display:none} div p.a{display:block}", False), (".a{display:none!important} #x p.a{display:block}", True),
    (".a{display:none} .a{display:block}", False), ("div > .a{display:none}", True), ("body > .a{display:none}", False), ("body .c .a{display:none}", False), ("i + .a{display:none}", True),
    ("b ~ .a{display:none}", True), ("b + .a{display:none}", False), ("[data-k=v].a{display:none}", True), (".a:not(.b){display:none}", False), (".z, .a{display:none}", True),
    ("@media print{.a{display:none}}", False), ("@media screen{.a{display:none}}", True), ("@media only screen {.b{color:red} .a{display:none}} .a{color:blue}", True),
    ("@import url(x.css); .a{display:none}", True), ("/* .a{display:none} */", False), (".a:hover{display:none}", False), (".a{display:none", True), ("} .a{display:none}", False), ("", False),
])
def test_rules_hide(css, hidden):
    root = html.parse(page('<div id="x"><b>1</b><i>2</i><p class="a b" data-k="v">secret</p></div>', css))
    assert html.style_sheet(root).hides(html.find(root, "p")) is hidden


def test_inline_styles_come_first():
    root = html.parse(page('<p class="a" style="display:block">shown</p><p class="b" style="display:block">gone</p><p style="opacity: 0">gone</p>', ".a{display:none} .b{display:none!important}"))
    assert [html.style_sheet(root).hides(n) for n in root.walk() if n.tag == "p"] == [False, True, True]
    assert declarations("display:none!important;display:block") == {"display": ("none", True)}
    assert specificity(_steps("#a .b[c=d] > e:not(.f)")) == (1, 3, 1) and _steps("a > > b") is None and _steps("a::before") is None
    assert Sheet("", html.selects).shown(html.parse("<p>").children[0]) == {}


def test_hidden_text_of_nested_elements_goes(spark):
    body = '<main><p>Shown.</p><div class="off"><p>Hidden <b class="on">deeply</b></p></div><ul><li class="x">one</li><li>two</li></ul></main>'
    text = spark.createDataFrame([(page(body, ".off{display:none} .on{display:inline} ul > .x{visibility:hidden}"),)], "h string").select(html.extract_column(F.col("h")).alias("e")).first().e
    assert text.markdown == "Shown.\n\n-   two"


def test_an_article_without_its_navigation():
    paragraphs = "".join(f"<p>{SENTENCE} Part {k}.</p>" for k in range(5))
    for around in ('<div class="wrap"><div class="box">{}</div><div class="links"><ul>{}</ul></div></div>', '<table><tr><td>{}</td></tr></table><div><ul>{}</ul></div>', "<div>{}</div><ul>{}</ul>"):
        got = html.extract(page(around.format(paragraphs, LINKS)))
        assert got["markdown"].count("committee") == 5 and "weather" not in got["markdown"], around
        assert got["read_words"] < got["whole_words"]
    marked = html.extract(page(f"<main>{paragraphs}<ul>{LINKS}</ul></main>"))
    assert "weather" in marked["markdown"] and marked["read_words"] is None


def test_neighbours_join_an_article():
    body = f'<div id="p"><p>A short one.</p><div class="story"><p>{SENTENCE}</p><p>{SENTENCE}</p><p>{SENTENCE}</p></div><p>{SENTENCE}</p><p><a href="x">{SENTENCE}</a></p></div>'
    parts = readability.article(html.find(html.parse(page(body)), "body"))
    assert [p.tag for p in parts] == ["p", "div", "p"] and parts[0].text() == "A short one."


def test_pages_without_paragraphs_stay_whole():
    for body in ("", "<div>short</div>", f"<ul>{LINKS}</ul>"):
        got = html.extract(page(body))
        assert got["read_words"] == 0 and got["text"] == html.parse(f"<body>{body}</body>").text()
    long = "".join(f"<li>item {k} is one of many that stand in a list</li>" for k in range(80))
    kept = html.extract(page(f"<div><p>{SENTENCE}</p></div><ul>{long}</ul>"))
    assert kept["whole_words"] > 600 and "item 79" in kept["markdown"]


def test_the_choice_is_the_same_in_both_forms(spark):
    rows = [(w, r) for w in (0, 1, 299, 300, 599, 600, 1000) for r in (0, 1, 119, 120, 210, 349, 350, 600)]
    got = spark.createDataFrame(rows, "w long, r long").select("w", "r", gates.readability_fits(F.col("w"), F.col("r")).alias("fits")).collect()
    assert all(bool(x.fits) == readability.fits(x.w, x.r) for x in got)
