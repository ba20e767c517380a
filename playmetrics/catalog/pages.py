"""Node extraction from the page table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages
from .registry import query, table


def plain(markup: str) -> str:
    """SQL for the text of a piece of markup; the closing semicolon of these names is optional."""
    text = f"regexp_replace({markup}, '<[^>]*>', '', 'g')"
    for name, char in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&nbsp;?", "\u00a0"), ("&amp;?", "&")):
        text = f"regexp_replace({text}, '{name}', '{char}', 'g')"
    return text


def trees(spark, sf):
    return pages.page_trees(table(spark, sf, "pages"))


#: Nodes of every page from its list of tags: a walk with the stack of open elements, then the last node below
#: each element from the depths, and its text from the text nodes up to there.
NODES = f"""tokens AS (
  SELECT page_id, unnest(flatten(list_transform(
    regexp_extract_all(html, '(?s)<!.*?>|<(?:script|style)[^>]*>.*?</(?:script|style)>|<[^>]*>|[^<]+'),
    lambda t: CASE WHEN regexp_matches(t, '(?s)^<(script|style)[^>]*>.*</')
      THEN [regexp_extract(t, '^<[^>]*>'), regexp_extract(t, '(?s)^<[^>]*>(.*)</', 1), regexp_extract(t, '</[^<]*$')] ELSE [t] END))) AS token
  FROM pages),
named AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id) AS i, token, CASE WHEN token[1] <> '<' THEN 'text' WHEN token[2] = '/' THEN 'close'
    WHEN regexp_matches(token, '^<(area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr)\\b') THEN 'void' ELSE 'open' END AS kind,
    regexp_extract(token, '^</?([a-z0-9]+)', 1) AS tag
  FROM tokens WHERE token <> '' AND token[1:2] <> '<!'),
walk AS (
  SELECT page_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(node INTEGER, tag VARCHAR)[]) AS stack, -1 AS node, -2 AS text_parent,
    CAST(NULL AS INTEGER) AS made, 0 AS depth, -1 AS parent, CAST(NULL AS VARCHAR) AS tag, CAST(NULL AS VARCHAR) AS part
  FROM pages
  UNION ALL
  SELECT n.page_id, n.i,
    CASE n.kind WHEN 'open' THEN list_append(w.stack, {{'node': w.node + 1, 'tag': n.tag}})
      WHEN 'close' THEN CASE WHEN list_contains(list_transform(w.stack, lambda e: e.tag), n.tag)
        THEN w.stack[:len(w.stack) - list_position(list_reverse(list_transform(w.stack, lambda e: e.tag)), n.tag)] ELSE w.stack END
      ELSE w.stack END,
    CASE WHEN n.kind IN ('open', 'void') OR (n.kind = 'text' AND w.text_parent <> coalesce(w.stack[-1].node, -1)) THEN w.node + 1 ELSE w.node END,
    CASE n.kind WHEN 'text' THEN coalesce(w.stack[-1].node, -1) WHEN 'close' THEN w.text_parent ELSE -2 END,
    CASE WHEN n.kind IN ('open', 'void') OR (n.kind = 'text' AND w.text_parent <> coalesce(w.stack[-1].node, -1)) THEN w.node + 1
      WHEN n.kind = 'text' THEN w.node END,
    len(w.stack), coalesce(w.stack[-1].node, -1), CASE WHEN n.kind IN ('open', 'void') THEN n.tag END,
    CASE WHEN n.kind = 'text' THEN {plain("n.token")} END
  FROM walk w JOIN named n ON n.page_id = w.page_id AND n.i = w.i + 1),
parts AS (SELECT page_id, made AS node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(tag) AS tag, string_agg(part, '' ORDER BY i) AS part
  FROM walk WHERE made IS NOT NULL GROUP BY 1, 2),
spans AS (SELECT a.*, coalesce((SELECT min(b.node) FROM parts b WHERE b.page_id = a.page_id AND b.node > a.node AND b.depth <= a.depth), 1000000000) - 1 AS last,
  row_number() OVER (PARTITION BY a.page_id, a.parent ORDER BY a.node) - 1 AS pos FROM parts a),
nodes AS (SELECT s.*, coalesce((SELECT string_agg(t.part, '' ORDER BY t.node) FROM parts t WHERE t.page_id = s.page_id AND t.tag IS NULL
  AND t.node BETWEEN s.node AND s.last), '') AS text FROM spans s)"""


@query(
    "page_heading",
    f"""WITH b AS (SELECT page_id, regexp_extract(html, '<body>.*', 0, 's') AS body FROM pages)
    SELECT page_id, CASE WHEN contains(body, '<h1>') THEN {plain("regexp_extract(body, '<h1>(.*?)</h1>', 1, 's')")} END AS heading FROM b""",
)
def _(spark, sf):
    return pages.page_heading(trees(spark, sf))


@query(
    "find_all",
    f"""WITH t AS (SELECT page_id, regexp_extract_all(html, '<div class="ad">(.*?)</div>', 1, 's') AS found FROM pages),
    u AS (SELECT page_id, unnest(range(len(found))) AS match, unnest(found) AS part FROM t)
    SELECT page_id, CAST(match AS INTEGER) AS match, {plain("part")} AS text FROM u""",
)
def _(spark, sf):
    found = pages.find_all(trees(spark, sf), "div", {"class": "ad"})
    return found.select("page_id", "match", "text")


FIRST = "top AS (SELECT page_id, min(node) AS node FROM nodes WHERE tag = '{0}' GROUP BY 1)"


@query(
    "children",
    f"""WITH RECURSIVE {NODES}, {FIRST.format("article")}
    SELECT page_id, CAST(pos AS INTEGER) AS pos, n.node, tag, text FROM nodes n JOIN top USING (page_id) WHERE n.parent = top.node""",
)
def _(spark, sf):
    return pages.children(trees(spark, sf), "article")


@query(
    "descendants",
    f"""WITH RECURSIVE {NODES}, {FIRST.format("article")}
    SELECT n.page_id, CAST(n.depth - m.depth AS INTEGER) AS level, n.node, n.tag, n.text FROM nodes n JOIN top USING (page_id)
    JOIN nodes m ON m.page_id = top.page_id AND m.node = top.node WHERE n.node > m.node AND n.node <= m.last""",
)
def _(spark, sf):
    return pages.descendants(trees(spark, sf), "article")


@query(
    "next_siblings",
    f"""WITH t AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<ul>(.*?)</ul>', 1, 's'), '<li>(.*?)</li>', 1, 's') AS found FROM pages),
    u AS (SELECT page_id, unnest(range(len(found))) AS step, unnest(found) AS part FROM t)
    SELECT page_id, CAST(step AS INTEGER) AS step, 'li' AS tag, {plain("part")} AS text FROM u WHERE step > 0""",
)
def _(spark, sf):
    after = pages.next_siblings(trees(spark, sf), "ul", child="li")
    return after.select("page_id", "step", "tag", "text")


@query(
    "previous_sibling_of_parent",
    f"""WITH RECURSIVE {NODES}, {FIRST.format("p")}
    SELECT m.page_id, b.text FROM top JOIN nodes m USING (page_id, node) JOIN nodes p ON p.page_id = m.page_id AND p.node = m.parent
    LEFT JOIN nodes b ON b.page_id = p.page_id AND b.parent = p.parent AND b.pos = p.pos - 1""",
)
def _(spark, sf):
    return pages.previous_sibling_of_parent(trees(spark, sf), "p")


@query(
    "node_counts",
    """WITH t AS (SELECT unnest(regexp_extract_all(regexp_replace(html, '<(script|style)>.*?</', '<\\1></', 'gs'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
    SELECT tag, count(*) AS nodes FROM t GROUP BY 1""",
)
def _(spark, sf):
    tags = trees(spark, sf).select(F.explode("nodes.tag").alias("tag"))
    return tags.where(F.col("tag").isNotNull()).groupBy("tag").agg(F.count(F.lit(1)).alias("nodes"))
