"""Pages as tables of elements: one pass a page inside the tasks, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import markup

#: Elements of a batch of output, roughly.
ROWS = 20_000
_ELEMENT = [
    ("node", pa.int32(), "int"), ("parent", pa.int32(), "int"), ("depth", pa.int32(), "int"), ("last", pa.int32(), "int"), ("tag", pa.string(), "string"), ("n_children", pa.int32(), "int"), ("start", pa.int64(), "long"),
    ("end", pa.int64(), "long"), ("attributes", pa.map_(pa.string(), pa.string()), "map<string,string>"), ("own_text", pa.string(), "string"), ("hidden_by", pa.string(), "string"),
]


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row an element: (id_col, node, parent, depth, last, tag, n_children, start, end, attributes, own_text, hidden_by).

    Nodes are numbered from 0 in page order; the descendants of a node are those
    numbered up to its ``last``; the parent of a topmost element is -1. start and
    end are places in the page. own_text is the text directly inside, as written;
    hidden_by says why an element does not show ('' if it does).
    Null and empty pages give no rows; repeated rows and ids are kept apart only
    by their rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, *(n for n, _, _ in _ELEMENT)]
        for b in batches:
            owner, rows = [], []

            def batch(b=b, owner=owner, rows=rows) -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True))
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), *(pa.array(c, t) for c, (_, t, _) in zip(columns, _ELEMENT, strict=True))], names)

            for i, page in enumerate(b.column(1)):
                found = markup.tree(page.as_py())
                why = markup.looks(found)
                rows += [(n, e.parent, e.depth, e.last, e.tag, e.children, e.start, e.end, list(e.attributes.items()), "".join(e.text), w) for n, (e, w) in enumerate(zip(found, why, strict=True))]
                owner += [i] * len(found)
                if len(rows) > ROWS:
                    yield batch()
                    owner.clear()
                    rows.clear()
            if rows:
                yield batch()

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"`{n}` {t}" for n, _, t in _ELEMENT))


def children(tree: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id_col, parent, child, place): the children of every node, in order."""
    from pyspark.sql import Window

    order = Window.partitionBy(id_col, "parent").orderBy("node")
    return tree.filter("parent >= 0").select(id_col, "parent", F.col("node").alias("child"), (F.row_number().over(order) - 1).alias("place"))


def shown(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, shown_text, hidden_text) of every page; null and empty pages have empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [markup.shown_text(p.as_py()) for p in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t[0] for t in texts], pa.string()), pa.array([t[1] for t in texts], pa.string())], [id_col, "shown_text", "hidden_text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, shown_text string, hidden_text string")
