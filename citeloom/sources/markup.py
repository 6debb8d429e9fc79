"""Fields of web pages and mails. Trees are parsed with the standard library, batch by batch; flat links by patterns in the JVM."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Tree(HTMLParser):
    """Nested nodes [tag, attributes, children]; text is a str child. Unclosed nodes end with their parent."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.stack = [self.root]
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.stack[-1][2].append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1][2].append([tag, {k: v or "" for k, v in attrs}, []])

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] == tag), 0)
        if at:
            del self.stack[at:]

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def _walk(node: list) -> Iterator[tuple[list, list]]:
    todo = [(node, c) for c in reversed(node[2])]
    while todo:
        parent, n = todo.pop()
        if isinstance(n, list):
            yield parent, n
            todo += [(n, c) for c in reversed(n[2])]


def _text(node: list) -> str:
    out, todo = [], list(reversed(node[2]))
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            todo += reversed(n[2])
    return "".join(out)


def find_nodes(page: str | None, attribute: str, value: str) -> list[str]:
    """Texts of all nodes whose attribute has the value, in document order."""
    return [_text(n) for _, n in _walk(_Tree(page).root) if n[1].get(attribute) == value] if page else []


def labelled_field(page: str | None, labels: list[str]) -> tuple[str | None, str | None]:
    """(value, label) of the first label that is all of a div: the text of the second child of its parent."""
    if page:
        by_text = {}
        for parent, n in _walk(_Tree(page).root):
            if n[0] == "div" and all(isinstance(c, str) for c in n[2]):
                by_text.setdefault(_text(n), parent)
        for label in labels:
            if label in by_text:
                children = [c for c in by_text[label][2] if isinstance(c, list)]
                if len(children) > 1:
                    return _text(children[1]), label
    return None, None


def extract_nodes(df: DataFrame, key: str, page: str, attribute: str, value: str) -> DataFrame:
    """(key, node_no, text) of the nodes with an attribute."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, node_no int, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, i, t) for k, p in zip(b[key], b[page]) for i, t in enumerate(find_nodes(p, attribute, value))], columns=[key, "node_no", "text"])

    return df.select(key, page).mapInPandas(run, schema)


def extract_fields(df: DataFrame, key: str, page: str, fields: dict[str, list[str]]) -> DataFrame:
    """One column per field; each is looked up under its labels in turn, NULL if none is there."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, " + ", ".join(f"`{f}` string" for f in fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *[labelled_field(p, labels)[0] for labels in fields.values()]) for k, p in zip(b[key], b[page])], columns=[key, *fields])

    return df.select(key, page).mapInPandas(run, schema)


def mail_subject_is(headers: Column, subject: str) -> Column:
    return F.exists(headers, lambda h: (h["name"] == "Subject") & (h["value"] == subject))


def mail_body(encoded: Column) -> Column:
    """URL-safe base64 to text."""
    return F.decode(F.unbase64(F.translate(encoded, "-_", "+/")), "UTF-8")


def link_texts(html: Column, prefix: str) -> Column:
    """Texts of the anchors whose address begins with a prefix."""
    return F.regexp_extract_all(html, F.lit(rf'<a href="\Q{prefix}\E[^"]*"[^>]*>([^<]*)</a>'), F.lit(1))


def page_ok(text: Column) -> Column:
    return ~F.coalesce(F.contains(text, F.lit("Error 404")), F.lit(False))
