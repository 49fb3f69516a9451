"""Queries over the element trees of web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import markup
from gristmill.operators import pages as P
from gristmill.plans.registry import query, read
from gristmill.plans.web import _decoded

_SHOWN_SQL = r"regexp_replace(regexp_replace(html, '(?is)<!--.*?(-->|$)|<(script|style|title)\b.*?(</(script|style|title)>|$)', ' ', 'g'), '(?s)<[^>]*(>|$)', ' ', 'g')"


@query(f"""SELECT page_id, length(regexp_replace(t, '\\s', '', 'g'))::INT AS shown_chars, len(regexp_extract_all(t, '[A-Za-z]+'))::INT AS shown_words
  FROM (SELECT page_id, {_decoded(_SHOWN_SQL)} AS t FROM pages)""")
def html_visibility(spark, sf_dir):
    """How much of each page shows, by its tree and styles."""
    shown = P.shown(read(spark, sf_dir, "pages"))
    return shown.select("page_id", F.length(F.regexp_replace("shown_text", r"\s", "")).alias("shown_chars"), F.size(F.regexp_extract_all("shown_text", F.lit("[A-Za-z]+"), F.lit(0))).alias("shown_words"))


def _last(stack: str, name: str) -> str:
    """Place of the last element of that name in a stack, 0 if there is none."""
    return f"CASE WHEN list_contains({stack}, {name}) THEN len({stack}) + 1 - list_position(list_reverse({stack}), {name}) ELSE 0 END"


_CLOSES_P = ", ".join(f"'{t}'" for t in sorted(markup.CLOSES_P))
_VOID = ", ".join(f"'{t}'" for t in sorted(markup.VOID))
_HEAD = ", ".join(f"'{t}'" for t in sorted({*markup.HEAD, "head"}))


@query(rf"""WITH RECURSIVE t AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(-->|$)|(<(script|style|title)\b[^>]*>).*?(</(script|style|title)>|$)', '\2\4', 'g'), '</?[a-zA-Z][a-zA-Z0-9]*') AS tags FROM pages),
  z AS (SELECT page_id, tags, 0 AS i, []::VARCHAR[] AS stack, []::INT[] AS nodes, -1 AS node, NULL::INT AS parent, NULL::INT AS depth, NULL::VARCHAR AS tag FROM t UNION ALL
    SELECT page_id, tags, i + 1, CASE WHEN closing THEN stack[:keep] WHEN name IN ({_VOID}) THEN stack[:keep] ELSE list_append(stack[:keep], name) END, CASE WHEN closing OR name IN ({_VOID}) THEN nodes[:keep] ELSE list_append(nodes[:keep], node + 1) END,
      CASE WHEN closing THEN node ELSE node + 1 END, CASE WHEN closing THEN NULL WHEN keep = 0 THEN -1 ELSE nodes[keep] END, CASE WHEN closing THEN NULL ELSE keep END, CASE WHEN closing THEN NULL ELSE name END
    FROM (SELECT *, CASE WHEN closing THEN CASE WHEN own > 0 THEN own - 1 ELSE len(stack) END WHEN name IN ({_CLOSES_P}) AND p > 0 THEN p - 1 ELSE len(stack) END AS keep
      FROM (SELECT *, {_last("stack", "name")} AS own, {_last("stack", "'p'")} AS p FROM (SELECT *, starts_with(tags[i + 1], '</') AS closing, lower(ltrim(tags[i + 1], '</')) AS name FROM z WHERE i < len(tags))))),
  e AS (SELECT page_id, node, parent, depth, tag FROM z WHERE tag IS NOT NULL)
  SELECT e.page_id, e.node, e.parent, e.depth, e.tag, coalesce(min(x.node) FILTER (x.depth <= e.depth) - 1, max(x.node), e.node)::INT AS last, count(*) FILTER (x.parent = e.node)::INT AS n_children, CASE WHEN e.tag IN ({_HEAD}) THEN 'head' ELSE '' END AS hidden_by
  FROM e LEFT JOIN e x ON x.page_id = e.page_id AND x.node > e.node GROUP BY e.page_id, e.node, e.parent, e.depth, e.tag""")
def html_tree(spark, sf_dir):
    """Every element of every page with its parent, depth and nested interval."""
    return P.elements(read(spark, sf_dir, "pages")).select("page_id", "node", "parent", "depth", "last", "tag", "n_children", "hidden_by")


@query("""SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(-->|$)|(<(script|style|title)\\b[^>]*>).*?(</(script|style|title)>|$)', '\\2', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY 1, 2""")
def html_tree_tags(spark, sf_dir):
    """Elements of the tree by tag: what scripts and comments hold is none."""
    return P.elements(read(spark, sf_dir, "pages")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))
