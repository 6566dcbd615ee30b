"""GML text of a graph to tables and back."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import write_text

_TOKEN = re.compile(r'"([^"]*)"|\[|\]|[^\s\[\]"]+')
NODES = "entity string, pages array<int>"
EDGES = "src string, dst string, relation string, page_num int, source_page string, subject_original string, object_original string, first_seq long, last_seq long"


def _parse(text: str) -> list[tuple[str, object]]:
    """Nested (key, value) lists."""
    tokens = [(m.group(0), m.group(1)) for m in _TOKEN.finditer(re.sub(r"(?m)^\s*#.*$", "", text))]
    at = 0

    def block() -> list[tuple[str, object]]:
        nonlocal at
        out = []
        while at < len(tokens) and tokens[at][0] != "]":
            key = tokens[at][0]
            raw, quoted = tokens[at + 1]
            at += 2
            if raw == "[":
                out.append((key, block()))
                at += 1
            elif quoted is not None:
                out.append((key, html.unescape(quoted)))
            else:
                out.append((key, float(raw) if re.search(r"[.eE]", raw) else int(raw)))
        return out

    return block()


def parse_gml(text: str) -> tuple[list[tuple], list[tuple]]:
    """(nodes, edges) rows; comma-separated pages become arrays, edges are numbered as they come."""
    graph = next((v for k, v in _parse(text) if k == "graph"), [])
    labels, nodes, edges = {}, [], []
    for kind, block in graph:
        if kind == "node":
            d = dict(block)
            labels[d["id"]] = str(d.get("label", d["id"]))
            nodes.append((labels[d["id"]], [int(p) for p in str(d.get("pages", "")).split(",") if p.strip().isdigit()]))
    for kind, block in graph:
        if kind == "edge":
            d, n = dict(block), len(edges)
            page = d.get("page_num", d.get("pagenum"))
            text_of = lambda *names: next((str(d[x]) for x in names if x in d), None)  # noqa: E731, B023
            edges.append((labels[d["source"]], labels[d["target"]], text_of("relation"), None if page is None else int(page), text_of("source_page", "sourcepage"), text_of("subject_original"), text_of("object_original"), n, n))
    return nodes, edges


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GML files; each is parsed in the task that reads it."""
    raw = spark.read.text(path, wholetext=True)

    @F.udf("struct<nodes:array<struct<entity:string,pages:array<int>>>,edges:array<struct<src:string,dst:string,relation:string,page_num:int,source_page:string,subject_original:string,object_original:string,first_seq:long,last_seq:long>>>")
    def parsed(text):  # one row a file
        return parse_gml(text)

    both = raw.select(parsed("value").alias("g"))
    return both.select(F.explode("g.nodes").alias("n")).select("n.*"), both.select(F.explode("g.edges").alias("e")).select("e.*")


def _quote(x: object) -> str:
    return json.dumps(x) if isinstance(x, (int, float)) else '"' + html.escape(str(x), quote=True).encode("ascii", "xmlcharrefreplace").decode() + '"'


def gml_lines(nodes: DataFrame, edges: DataFrame):
    """Lines of a GML export, fetched partition by partition; an export is one file and so one stream."""
    yield "graph ["
    yield "  directed 1"
    ids = {}
    for r in nodes.orderBy("entity").toLocalIterator():
        ids[r["entity"]] = len(ids)
        yield f'  node [\n    id {ids[r["entity"]]}\n    label {_quote(r["entity"])}\n    pages {_quote(",".join(map(str, sorted(r["pages"] or []))))}\n  ]'
    kept = [c for c in ("relation", "page_num", "source_page", "subject_original", "object_original") if c in edges.columns]
    for r in edges.orderBy("first_seq", "src", "dst").toLocalIterator():
        extra = "".join(f"\n    {c} {_quote(r[c])}" for c in kept if r[c] is not None)
        yield f'  edge [\n    source {ids[r["src"]]}\n    target {ids[r["dst"]]}{extra}\n  ]'
    yield "]"


def write_gml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes the export as one file to any store that Spark reaches."""
    write_text(nodes.sparkSession, path, (line + "\n" for line in gml_lines(nodes, edges)))
