"""XML as a table of nodes, numbered so that axes are range conditions.

pre and post number the starts and ends of nodes in one count: a descendant's interval lies inside its ancestor's.
Attributes are a map on their element; value is the string value and xml the serialised node.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_DDL = "doc string, pre int, post int, parent int, level int, kind string, name string, value string, attrs map<string,string>, xml string"
COLUMNS = [c.split()[0] for c in NODE_DDL.split(", ")]
#: Nodes, and characters of their values and XML, that make up a frame; a document isn't cut.
FRAME_ROWS, FRAME_CHARS = 20_000, 8_000_000


def nodes_of(doc: str, text: str) -> list[tuple]:
    """Rows of the node table, in document order; the document node is the first."""
    rows: list[list] = [[doc, 0, 0, -1, 0, "document", None, "", {}, ""]]
    stack, count = [0], 0
    parts: list[list[str]] = [[]]  # serialised children of open nodes
    texts: list[list[str]] = [[]]

    def leaf(kind: str, name: str | None, value: str, xml: str) -> None:
        nonlocal count
        if kind == "text" and rows[-1][5] == "text" and rows[-1][3] == rows[stack[-1]][1] and len(rows) - 1 > stack[-1]:
            rows[-1][7] += value
            rows[-1][9] += xml
        else:
            count += 1
            rows.append([doc, count, count, rows[stack[-1]][1], len(stack), kind, name, value, {}, xml])
        parts[-1].append(xml)
        if kind == "text":
            texts[-1].append(value)

    def start(name: str, attrs: list[str]) -> None:
        nonlocal count
        count += 1
        rows.append([doc, count, 0, rows[stack[-1]][1], len(stack), "element", name, "", dict(zip(attrs[::2], attrs[1::2])), ""])
        stack.append(len(rows) - 1)
        parts.append([])
        texts.append([])

    def end(name: str) -> None:
        nonlocal count
        count += 1
        row = rows[stack.pop()]
        inner, value = "".join(parts.pop()), "".join(texts.pop())
        tag = name + "".join(f" {k}={quoteattr(v)}" for k, v in row[8].items())
        row[2], row[7], row[9] = count, value, f"<{tag}>{inner}</{name}>" if inner else f"<{tag}/>"
        parts[-1].append(row[9])
        texts[-1].append(value)

    p = expat.ParserCreate()
    p.ordered_attributes, p.buffer_text = True, True
    p.StartElementHandler, p.EndElementHandler = start, end
    p.CharacterDataHandler = lambda s: leaf("text", None, s, escape(s))
    p.CommentHandler = lambda s: leaf("comment", None, s, f"<!--{s}-->")
    p.ProcessingInstructionHandler = lambda t, s: leaf("processing-instruction", t, s, f"<?{t} {s}?>")
    p.Parse(text, True)
    rows[0][2], rows[0][7], rows[0][9] = count + 1, "".join(texts[0]), "".join(parts[0])
    return [tuple(r) for r in rows]


def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of documents, many documents to a frame: one for each would cost more than parsing it."""
    rows, held = [], 0
    for batch in batches:
        for doc, text in zip(batch["doc"], batch["xml"]):
            found = nodes_of(doc, text)
            rows += found
            held += sum(len(r[7]) + len(r[9]) for r in found)
            if len(rows) >= FRAME_ROWS or held >= FRAME_CHARS:
                yield pd.DataFrame(rows, columns=COLUMNS)
                rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=COLUMNS)


def node_table(documents: DataFrame) -> DataFrame:
    """documents(doc, xml) -> the node table; each document is parsed in one task, a null one has no nodes."""
    return documents.where("xml IS NOT NULL").select(F.col("doc").cast("string").alias("doc"), "xml").mapInPandas(frames, NODE_DDL)
