"""Nodes of HTML pages.

A page is parsed once, in the task that holds it, into one row: its text and an array of nodes.
Each node carries interval labels, the last node below it and where its text starts and stops in the page's
text, so children, descendants and siblings are conditions on one array and a node's text is cut out of the
page's after the choice.  Nothing is shuffled, and a text is held once, not once per level.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that never have content.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)

#: Nodes that are handed over together.
OUT_NODES = 20_000

NODE = (
    "struct<node:int,parent:int,pos:int,depth:int,last:int,start:int,stop:int,tag:string,attrs:map<string,string>>"
)
ARROW_NODE = pa.struct(
    [(name, pa.int32()) for name in ("node", "parent", "pos", "depth", "last", "start", "stop")]
    + [("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))]
)


class _Nodes(HTMLParser):
    """Collects elements and text nodes in document order.

    A closing tag ends the nearest open element of its name and everything opened inside it;
    one without an open element is ignored.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.children: dict[int, int] = {}
        self.texts: list[str] = []
        self.size = 0

    def _add(self, tag: str | None, attrs: dict | None) -> int:
        node = len(self.rows)
        parent = self.open[-1] if self.open else -1
        pos = self.children.get(parent, 0)
        self.children[parent] = pos + 1
        named = None if attrs is None else list(attrs.items())
        self.rows.append(
            dict(node=node, parent=parent, pos=pos, depth=len(self.open), last=node, start=self.size, stop=self.size, tag=tag, attrs=named)
        )
        return node

    def handle_starttag(self, tag, attrs):
        node = self._add(tag, {k: v or "" for k, v in reversed(attrs)})
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, {k: v or "" for k, v in reversed(attrs)})

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[at]]["tag"] == tag:
                self._close(at)
                return

    def handle_data(self, data):
        before = self.rows[-1] if self.rows else None
        inside = self.open[-1] if self.open else -1
        if not (before and before["tag"] is None and before["parent"] == inside):
            self._add(None, None)
        self.texts.append(data)
        self.size += len(data)
        self.rows[-1]["stop"] = self.size

    def _close(self, at: int) -> None:
        last = len(self.rows) - 1
        for node in self.open[at:]:
            self.rows[node]["last"], self.rows[node]["stop"] = last, self.size
        del self.open[at:]

    def finish(self) -> list[dict]:
        self.close()
        self._close(0)
        return self.rows


def page_trees(pages: DataFrame) -> DataFrame:
    """``page_id, plain, nodes`` of ``pages(page_id, html)``, one row per page; a null page has no nodes.

    ``plain`` is the text of all text nodes in order.  ``node`` numbers nodes in document order, ``last`` is
    the last node below, ``pos`` the position among the parent's children, ``parent`` -1 at the top,
    ``start`` and ``stop`` the node's text in ``plain``.  Text nodes have no tag.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pending, size = [], 0

            def out():
                ids, plain, nodes = zip(*pending, strict=True)
                columns = [pa.array(ids, pa.int64()), pa.array(plain, pa.string()), pa.array(nodes, pa.list_(ARROW_NODE))]
                return pa.RecordBatch.from_arrays(columns, ["page_id", "plain", "nodes"])

            for page, html in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist(), strict=True):
                parser = _Nodes()
                parser.feed(html or "")
                pending.append((page, "".join(parser.texts) if html is not None else None, parser.finish()))
                size += len(parser.rows)
                if size >= OUT_NODES:
                    yield out()
                    pending, size = [], 0
            if pending:
                yield out()

    given = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html")
    return given.mapInArrow(parse, f"page_id bigint, plain string, nodes array<{NODE}>")


def _text(node: Column) -> Column:
    return F.substring("plain", node["start"] + 1, node["stop"] - node["start"])


def page_nodes(pages: DataFrame) -> DataFrame:
    """The nodes of `page_trees` as rows, with their text."""
    trees = page_trees(pages)
    found = trees.select("page_id", "plain", F.explode("nodes").alias("n"))
    return found.select("page_id", "n.node", "n.parent", "n.pos", "n.depth", "n.last", "n.tag", "n.attrs", _text(F.col("n")).alias("text"))


def _has(node: Column, tag: str | None, attrs: Mapping[str, str] | None = None) -> Column:
    """Tag name and attribute values; a class matches any word of the attribute."""
    test = node["tag"] == tag if tag else node["tag"].isNotNull()
    for name, value in (attrs or {}).items():
        held = F.element_at(node["attrs"], F.lit(name))
        if name == "class":
            test = test & (F.array_contains(F.split(held, r"\s+"), value) | (held == value))
        else:
            test = test & (held == value)
    return F.coalesce(test, F.lit(False))


def _first(tag: str | None, attrs: Mapping[str, str] | None = None, nodes: str | Column = "nodes") -> Column:
    return F.get(F.filter(nodes, lambda n: _has(n, tag, attrs)), F.lit(0))


def _below(node: Column, top: Column) -> Column:
    return (node["node"] > top["node"]) & (node["node"] <= top["last"])


def page_heading(trees: DataFrame, tag: str = "h1") -> DataFrame:
    """Text of the first heading inside the body of each page; null where there is none."""
    heads = F.filter("nodes", lambda n: _has(n, tag) & _below(n, F.col("_body")))
    first = trees.withColumn("_body", _first("body")).withColumn("_head", F.get(heads, F.lit(0)))
    return first.select("page_id", _text(F.col("_head")).alias("heading"))


def find_all(trees: DataFrame, tag: str, attrs: Mapping[str, str] | None = None) -> DataFrame:
    """Text of every matching node, numbered within its page from 0."""
    matches = F.filter("nodes", lambda n: _has(n, tag, attrs))
    found = trees.select("page_id", "plain", F.posexplode(matches).alias("match", "n"))
    return found.select("page_id", "match", "n.node", _text(F.col("n")).alias("text"))


def _with_first(trees: DataFrame, tag: str, attrs: Mapping[str, str] | None) -> DataFrame:
    """Pages with a match; ``_m`` is the first match of the page."""
    return trees.withColumn("_m", _first(tag, attrs)).where(F.col("_m").isNotNull())


def children(trees: DataFrame, tag: str, attrs: Mapping[str, str] | None = None) -> DataFrame:
    """Nodes directly below the first match."""
    mine = F.filter("nodes", lambda n: n["parent"] == F.col("_m.node"))
    below = _with_first(trees, tag, attrs).select("page_id", "plain", F.explode(mine).alias("n"))
    return below.select("page_id", "n.pos", "n.node", "n.tag", _text(F.col("n")).alias("text"))


def descendants(trees: DataFrame, tag: str, attrs: Mapping[str, str] | None = None) -> DataFrame:
    """All nodes below the first match, with their depth below it."""
    mine = F.filter("nodes", lambda n: _below(n, F.col("_m")))
    below = _with_first(trees, tag, attrs).select("page_id", "plain", "_m", F.explode(mine).alias("n"))
    return below.select(
        "page_id", (F.col("n.depth") - F.col("_m.depth")).alias("level"), "n.node", "n.tag", _text(F.col("n")).alias("text")
    )


def next_siblings(
    trees: DataFrame, tag: str, attrs: Mapping[str, str] | None = None, child: str = "tr"
) -> DataFrame:
    """Siblings after the first ``child`` element below the first match (any depth)."""
    inner = F.get(F.filter("nodes", lambda n: _has(n, child) & _below(n, F.col("_m"))), F.lit(0))
    later = F.filter("nodes", lambda n: (n["parent"] == F.col("_c.parent")) & (n["pos"] > F.col("_c.pos")))
    found = _with_first(trees, tag, attrs).withColumn("_c", inner).select("page_id", "plain", "_c", F.explode(later).alias("n"))
    return found.select(
        "page_id", (F.col("n.pos") - F.col("_c.pos")).alias("step"), "n.node", "n.tag", _text(F.col("n")).alias("text")
    )


def previous_sibling_of_parent(trees: DataFrame, tag: str, attrs: Mapping[str, str] | None = None) -> DataFrame:
    """Text of the node just before the parent of the first match; null where there is none."""
    found = _with_first(trees, tag, attrs).withColumn("_p", F.get("nodes", F.col("_m.parent"))).where(F.col("_p").isNotNull())
    before = F.filter("nodes", lambda n: (n["parent"] == F.col("_p.parent")) & (n["pos"] == F.col("_p.pos") - 1))
    return found.withColumn("_b", F.get(before, F.lit(0))).select("page_id", _text(F.col("_b")).alias("text"))
