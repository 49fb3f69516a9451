"""Element trees and styles: pages of the table against a plain stack, cases by hand."""

from html.parser import HTMLParser

import oracle
import pytest
from gristmill.functions import markup
from gristmill.operators import pages


class PlainStack(HTMLParser):
    """Parents and depths by the standard library's tag stream."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.rows = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "div", "article", "h1", "footer", "nav", "ul", "section", "table"):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == "p":
                    del self.open[k:]
                    break
                if self.open[k][0] in ("td", "th", "html"):
                    break
        if self.open and self.open[-1][0] == "head" and tag not in ("meta", "title", "style", "script", "link"):
            self.open.pop()
        self.rows.append((tag, self.open[-1][1] if self.open else -1, len(self.open)))
        if tag not in ("br", "meta", "img", "hr", "link", "input"):
            self.open.append((tag, len(self.rows) - 1))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break


def test_every_element_of_every_page(spark):
    table = spark.read.parquet(f"{oracle.DATA}/pages.parquet")
    got = {}
    for r in pages.elements(table).select("page_id", "node", "tag", "parent", "depth", "last", "n_children").collect():
        got.setdefault(r.page_id, {})[r.node] = r
    for page in table.collect():
        plain = PlainStack()
        plain.feed(page.html.rsplit("<", 1)[0] if page.html.rfind("<") > page.html.rfind(">") else page.html)
        own = got[page.page_id]
        assert [(own[n].tag, own[n].parent, own[n].depth) for n in range(len(plain.rows))] == plain.rows
        for n, r in own.items():
            below = [k for k in own if n != k and n in list(ancestors(own, k))]
            assert (r.last, r.n_children) == (max(below, default=n), sum(own[k].parent == n for k in own))
        if page.page_id > 40:
            break


def ancestors(own, k):
    while own[k].parent >= 0:
        k = own[k].parent
        yield k


def outline(page):
    return [(e.tag, e.parent) for e in markup.tree(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("just text < 3 > 2 <", []),
        ("<p>a<p>b<div>c</div>", [("p", -1), ("p", -1), ("div", -1)]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", [("ul", -1), ("li", 0), ("li", 0), ("ul", 2), ("li", 3), ("li", 0)]),
        ("<table><tr><td>a<td>b<tr><td><p>c<table><tr><td>d</table></table><i>", [("table", -1), ("tr", 0), ("td", 1), ("td", 1), ("tr", 0), ("td", 4), ("p", 5), ("table", 5), ("tr", 7), ("td", 8), ("i", -1)]),
        ("<b>1<i>2</b>3</i>4<u>5</u>", [("b", -1), ("i", 0), ("u", -1)]),
        ("<br><img src=x><a/><b>x", [("br", -1), ("img", -1), ("a", -1), ("b", -1)]),
        ("<script>if (a<b) '</p>'</script><em>", [("script", -1), ("em", -1)]),
        ("<dl><dt>a<dd>b<dt>c</dl><select><option>1<option>2</select>", [("dl", -1), ("dt", 0), ("dd", 0), ("dt", 0), ("select", -1), ("option", 4), ("option", 4)]),
        ("<html><head><title>x</title><p>y</head></html>", [("html", -1), ("head", 0), ("title", 1), ("p", 0)]),
        ("<!-- <b> --><!DOCTYPE html><?x <y>?><c>", [("c", -1)]),
    ],
)
def test_outline(page, want):
    assert outline(page) == want


def test_attributes_and_intervals():
    page = """<div ID=a class='x y' Data-Q="1 &gt; 2" hidden title=say"so><b checked>t</b></div>tail"""
    div, b = markup.tree(page)
    assert div.attributes == {"id": "a", "class": "x y", "data-q": "1 > 2", "hidden": "", "title": 'say"so'}
    assert page[div.start : div.end] == page[: page.index("tail")] and page[b.start : b.end] == "<b checked>t</b>"
    assert markup.parent_at([div, b], page.index("t</b>")) == 1 and markup.parent_at([div, b], len(page) - 1) == -1


def hidden(style, page="<div {}><i>text</i></div>", sheet=""):
    found = markup.tree(f"<style>{sheet}</style>" + page.format(f'style="{style}"' if style else ""))
    return markup.looks(found)[-1]


@pytest.mark.parametrize("style", ["display:none", "DISPLAY : NONE !important", "visibility:hidden", "visibility:collapse", "font-size:0", "font-size:2px", "font-size: 1%", "opacity:0", "opacity:.05", "color:#fff", "color:white;background:#fefefe", "overflow:hidden;max-height:0", "width:0; overflow:hidden", "position:absolute;left:-9999px", "text-indent:-9999px"])
def test_hiding_styles(style):
    assert hidden(style) != ""


@pytest.mark.parametrize("style", ["", "display:block", "font-size:12px", "opacity:1", "opacity:0.5", "color:#fff;background:#000", "overflow:hidden", "max-height:0", "overflow:hidden; max-height:10px", "position:absolute;left:10px", "position:static;left:-9999px", "text-indent:2em", "display:none;display:block"])
def test_showing_styles(style):
    assert hidden(style) == ""


def test_what_is_inherited_and_what_can_be_undone():
    assert hidden("display:none", '<div {}><i style="display:block">t</i></div>') == "display"
    assert hidden("visibility:hidden", '<div {}><i style="visibility:visible">t</i></div>') == ""
    assert hidden("font-size:0", '<div {}><i style="font-size:12px">t</i></div>') == ""
    assert hidden("font-size:40px", '<div {}><i style="font-size:5%">t</i></div>') == "font"
    assert hidden("opacity:0.2", '<div {}><i style="opacity:0.2">t</i></div>') == "opacity"
    assert hidden("background:#000", '<div {}><i style="color:#010101">t</i></div>') == "colour"


@pytest.mark.parametrize(
    ("sheet", "page", "reason"),
    [
        (".x{display:none}", '<p class="a x">t', "display"),
        ("#q{display:none}", '<p id=q>t', "display"),
        ("p.x{display:none} .y{display:block}", '<p class="x y">t', "display"),
        (".y{display:block} p.x{display:none}", '<p class="x y">t', "display"),
        (".x{display:none} .x{display:block}", '<p class="x">t', ""),
        (".x{display:none!important} #q{display:block}", '<p class=x id=q>t', "display"),
        (".x{display:none!important}", '<p class=x style="display:block">t', "display"),
        (".x{display:none}", '<p class=x style="display:block">t', ""),
        ("div .x i{display:none}", '<div><p><span class=x><b><i>t', "display"),
        ("div > i{display:none}", '<div><b><i>t', ""),
        ("div > b > i{display:none}", '<div><b><i>t', "display"),
        ("div b > i{display:none}", '<div><b><b><i>t', "display"),
        ("@media screen { .x { display: none } }", '<p class=x>t', "display"),
        ("a:hover{display:none} /* p{display:none} */ *{color:red}", "<a>t", ""),
        ("h1, p , .z{display:none}", "<p>t", "display"),
    ],
)
def test_sheets(sheet, page, reason):
    assert markup.looks(markup.tree(f"<style>{sheet}</style>{page}"))[-1] == reason


def test_shown_and_hidden_text():
    page = '<title>T</title><p>one &amp; <b style="display:none">two <i>three</i></b> four<script>x</script>'
    assert markup.shown_text(page) == ("one & four", "T two three x")


def test_references_without_semicolon_stay():
    page = "<title>a &amp;&amp</title><p>b &amp;&amp c &lt; &copy &#65; &#66</p>"
    assert markup.shown_text(page) == ("b &&amp c < &copy A &#66", "a &&amp")


def test_tables(spark):
    rows = [(1, "<p>a", "x"), (1, "<p>a", "x"), (None, "<b><i></b>", "y"), (2, None, "z"), (3, "", "z")]
    df = spark.createDataFrame(rows, "page_id long, html string, node string")
    got = pages.elements(df)
    assert got.columns == ["page_id", "node", "parent", "depth", "last", "tag", "n_children", "start", "end", "attributes", "own_text", "hidden_by"]
    assert sorted((r.page_id or 0, r.tag, r.parent) for r in got.collect()) == [(0, "b", -1), (0, "i", 0), (1, "p", -1), (1, "p", -1)]
    assert [(r.parent, r.child, r.place) for r in pages.children(got).collect()] == [(0, 1, 0)]
    assert pages.elements(df.limit(0)).count() == 0
    assert {(r.page_id, r.shown_text) for r in pages.shown(df).collect()} == {(1, "a"), (None, ""), (2, ""), (3, "")}


@pytest.mark.parametrize("page", ["<" * 200_000, '<a b="' * 50_000, "<p>" * 30_000, "</p>" * 100_000, "<a " + "x " * 200_000, "<li>" * 50_000, "<p><button>" + "<div>" * 60_000, "<b>" * 60_000 + "</i>" * 60_000])
def test_hostile_pages_take_seconds(page):
    import time

    began = time.time()
    markup.looks(markup.tree(page))
    assert time.time() - began < 20
