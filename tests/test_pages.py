from playmetrics.catalog import QUERIES
from playmetrics.operators import pages as op

from .conftest import table

HTML = """<!DOCTYPE html><html><head><title>T</title></head><body><h1>Big <b>news</b> &amp; more</h1>
<span class="green">one</span><p><span class="red green">two</span><br>tail<span class='blue'>three</span></p>
<table id="gifts"><tr><th>Item</th></tr><tr><td>Vase</td><td>$5</td><td><img src="a.jpg"></td></tr><tr><td>Jar<td></tr></table>
<h1>Second</h1></body></html>"""


def pages(spark):
    rows = [(1, HTML), (2, "<html><h1>outside</h1><body><p>x</p></body></html>"), (3, ""), (4, None), (5, "<p>loose</div> text")]
    return spark.createDataFrame(rows, "page_id bigint, html string")


def test_heading(spark):
    found = dict(table(op.page_heading(op.page_trees(pages(spark)))))
    assert found == {1: "Big news & more", 2: None, 3: None, 4: None, 5: None}


def test_find_all_by_class_and_id(spark):
    nodes = op.page_trees(pages(spark))
    assert table(op.find_all(nodes, "span", {"class": "green"}), "page_id", "match", "text") == [(1, 0, "one"), (1, 1, "two")]
    assert len(table(op.find_all(nodes, "table", {"id": "gifts"}))) == 1
    assert table(op.find_all(nodes, "p"), "page_id", "text") == [(1, "twotailthree"), (2, "x"), (5, "loose text")]


def test_children_descendants_siblings(spark):
    nodes = op.page_trees(pages(spark))
    rows = table(op.children(nodes, "table", {"id": "gifts"}), "pos", "tag", "text")
    assert rows == [(0, "tr", "Item"), (1, "tr", "Vase$5"), (2, "tr", "Jar")]
    below = table(op.descendants(nodes, "table", {"id": "gifts"}), "level", "tag")
    assert below.count((1, "tr")) == 3 and (3, "img") in below and len([t for t in below if t[1] == "td"]) == 5
    after = table(op.next_siblings(nodes, "table", {"id": "gifts"}), "step", "tag", "text")
    assert after == [(1, "tr", "Vase$5"), (2, "tr", "Jar")]
    price = op.previous_sibling_of_parent(nodes, "img", {"src": "a.jpg"})
    assert table(price) == [(1, "$5")]
    assert table(op.previous_sibling_of_parent(nodes, "th")) == [(1, None)]


def test_nodes_as_rows(spark):
    rows = table(op.page_nodes(pages(spark)).where("page_id = 5"), "node", "parent", "depth", "last", "tag", "text")
    assert rows == [(0, -1, 0, 1, "p", "loose text"), (1, 0, 1, 1, None, "loose text")]


def test_relations_need_no_shuffle(spark):
    nodes = op.page_trees(pages(spark))
    for found in (op.page_heading(nodes), op.find_all(nodes, "p"), op.children(nodes, "tr"), op.descendants(nodes, "p"),
                  op.next_siblings(nodes, "table"), op.previous_sibling_of_parent(nodes, "p")):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_deep_page_holds_its_text_once(spark):
    deep = spark.createDataFrame([(1, "<div>" * 3000 + "word " * 2000 + "</div>" * 3000)], "page_id bigint, html string")
    found = op.descendants(op.page_trees(deep), "div").where("level > 2990").collect()
    assert len(found) == 10 and all(len(r["text"]) == 10_000 for r in found)


def test_descendants_query_has_the_text_of_elements(spark, tmp_path):
    spark.createDataFrame(
        [(1, "u", "<body><article><p>one <b>two</b></p>end</article></body>")], "page_id bigint, url string, html string"
    ).write.parquet(f"{tmp_path}/pages.parquet")
    found = table(QUERIES["descendants"](spark, str(tmp_path)), "level", "tag", "text")
    assert found == [(1, "p", "one two"), (1, None, "end"), (2, "b", "two"), (2, None, "one "), (3, None, "two")]
