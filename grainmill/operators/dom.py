"""Nodes of HTML pages and their ranking for a task, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

NODE = "array<struct<ordinal:int,depth:int,tag:string,parent:int,text:string>>"
_ALONE = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ACTIVE = frozenset("a button input select textarea option label summary".split())
_HIDDEN = frozenset(("script", "style", "template", "noscript"))
_WORD = re.compile(r"\w+")


class _Nodes(HTMLParser):
    """All elements in document order with their own text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open = [], []

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1] if self.open else -1
        said = " ".join(v for k, v in attrs if v and k in ("alt", "aria-label", "placeholder", "title", "value"))
        self.nodes.append({"ordinal": len(self.nodes), "depth": len(self.open), "tag": tag, "parent": parent, "text": said})
        if tag not in _ALONE:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]]["tag"] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if self.open and self.nodes[self.open[-1]]["tag"] not in _HIDDEN:
            node, text = self.nodes[self.open[-1]], " ".join(data.split())
            if text:
                node["text"] = f"{node['text']} {text}".strip()


def nodes_of(html: str | None) -> list[dict]:
    parser = _Nodes()
    parser.feed(html or "")
    parser.close()
    return parser.nodes


def dom_nodes(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, nodes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("parent", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([nodes_of(t.as_py()) for t in batch.column(1)], kind)], names=["key", "nodes"])

    return pages.select(key, html).mapInArrow(run, f"key {pages.schema[key].dataType.simpleString()}, nodes {NODE}").withColumnRenamed("key", key)


def rank_nodes(nodes: list[dict], task: str, budget: int) -> list[dict]:
    """The best nodes that fit a byte budget, in document order.

    A node's score: whether its text stands in the task or holds it, task words in its own text, task words in its ancestors', whether it can
    be acted on. By score and then document order, each node that still fits is taken; one that doesn't is passed over.
    """
    task = " ".join(task.casefold().split())
    wanted, words, above = set(_WORD.findall(task)), [], []
    for n in nodes:
        words.append(set(_WORD.findall(n["text"].casefold())))
        above.append(set() if n["parent"] < 0 else above[n["parent"]] | words[n["parent"]] & wanted)
    scored = []
    for n, own, over in zip(nodes, words, above, strict=True):
        text = n["text"].casefold()
        if text or n["tag"] in _ACTIVE:
            scored.append(((bool(text) and (text in task or task in text), len(wanted & own), len(wanted & over), n["tag"] in _ACTIVE), n))
    chosen, used = [], 0
    for _, n in sorted(scored, key=lambda x: (tuple(-int(v) for v in x[0]), x[1]["ordinal"])):
        size = len(f"<{n['tag']}> {n['text']}\n".encode())
        if used + size <= budget:
            chosen.append(n)
            used += size
    return sorted(chosen, key=lambda n: n["ordinal"])


def ranked_dom(pages: DataFrame, task: str, *, budget: int = 2048, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, kept, observation): the pruned page as text, its nodes in document order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rank_nodes(nodes_of(t.as_py()), task, budget) for t in batch.column(1)]
            text = ["".join(f"<{n['tag']}> {n['text']}\n" for n in page) for page in found]
            yield pa.record_batch([batch.column(0), pa.array([len(p) for p in found], pa.int32()), pa.array(text, pa.string())], names=["key", "kept", "observation"])

    return pages.select(key, html).mapInArrow(run, f"key {pages.schema[key].dataType.simpleString()}, kept int, observation string").withColumnRenamed("key", key)
