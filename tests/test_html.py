"""Golden pages for the tree contract, text, entities and attributes."""

from siftpage.operators.html import elements, page_text, tokens

PAGES = {
    1: "",
    2: "   ",
    3: "just text",
    4: "<html><head><title>One</title><title>Two</title></head><body>x</body></html>",
    5: "<body><ul><li>a<ul><li>b<li>c</ul><li>d</ul></body>",
    6: "<body><p>one<p>two<div>three</div></body>",
    7: '<body><p class="a b" ID=x class=dup data-q=\'1&amp;2\'>q</p></body>',
    8: '<body><a title="a>b" href=/x/>t</a><!-- <b>no</b> --><i>y</i></body>',
    9: '<body>a<script>var t="</p><b>";</script>b</body>',
    10: "<body>A &lt;b&gt; &#65;&#x42;&nbsp;&copy &bogus; &eacute;</body>",
    11: "<body><table><tr><td>1<td>2<tr><td>3</table></body>",
    12: "<body><div>" + "<b>k</b>" * 20 + "<i><u><s>deep</s></u></i></div></body>",
    13: "<body><b><p>open<div>x</b>y</div></body></html>tail",
}


def table(spark):
    rows = [(k, f"http://x/{k}", v) for k, v in PAGES.items()]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def shape(rows, page):
    """tag:parent pairs in document order."""
    return [(r.tag, r.parent_eid) for r in rows if r.page_id == page]


def test_tree(spark):
    rows = elements(table(spark)).orderBy("page_id", "eid").collect()
    assert shape(rows, 1) == [] and shape(rows, 2) == []
    assert shape(rows, 3) == [("body", None)]
    assert shape(rows, 5) == [
        ("body", None), ("ul", 0), ("li", 1), ("ul", 2), ("li", 3), ("li", 3), ("li", 1),
    ]
    assert shape(rows, 6) == [("body", None), ("p", 0), ("p", 0), ("div", 0)]
    assert shape(rows, 11) == [
        ("body", None), ("table", 0), ("tr", 1), ("td", 2), ("td", 2), ("tr", 1), ("td", 5),
    ]
    assert [r.tag for r in rows if r.page_id == 8] == ["body", "a", "i"]
    assert [r.depth for r in rows if r.page_id == 12][-3:] == [2, 3, 4]
    assert shape(rows, 13)[1:] == [("b", 0), ("p", 1), ("div", 1)]


def test_attributes_and_text(spark):
    rows = {(r.page_id, r.tag): r for r in elements(table(spark)).collect()}
    assert rows[(7, "p")].attrs == {"class": "a b", "id": "x", "data-q": "1&2"}
    assert rows[(8, "a")].attrs == {"title": "a>b", "href": "/x/"}
    assert rows[(8, "a")].text == "t"


def test_page_text(spark):
    text = {r.page_id: r for r in page_text(table(spark)).collect()}
    assert len(text) == len(PAGES)
    assert text[4].title == "One" and text[4].body == "One Two x"
    assert text[9].body == "a b" and text[9].joined == "ab"
    assert text[10].body == "A <b> AB\xa0&copy &bogus; é"
    assert text[8].body == "t y"
    assert text[13].repairs > 0


def test_tokens_and_elements_agree(spark, folder):
    from siftpage.sources.tables import pages

    p = pages(spark, folder)
    starts = tokens(p).filter("kind = 'start'").groupBy("tag").count()
    nodes = elements(p).groupBy("tag").count()
    assert sorted(map(tuple, starts.collect())) == sorted(map(tuple, nodes.collect()))
