"""An HTML page of a graph's most central nodes, drawn in the browser without any library."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from .store import write_text

_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:1em}}text{{font-size:11px}}line{{stroke:#999}}circle{{fill:#357}}</style>
<h1>{title}</h1><p>{note}</p><svg id="g" width="1000" height="1000" viewBox="-1.15 -1.15 2.3 2.3"></svg>
<script>
const data = {data}, svg = document.getElementById("g"), at = {{}};
const add = (kind, values, text) => {{
  const e = document.createElementNS("http://www.w3.org/2000/svg", kind);
  for (const k in values) e.setAttribute(k, values[k]);
  if (text) e.textContent = text;
  svg.appendChild(e); return e;
}};
data.nodes.forEach((n, i) => {{
  const turn = i * 2.399963, r = Math.sqrt((i + 0.5) / data.nodes.length);
  at[n.entity] = [r * Math.cos(turn), r * Math.sin(turn)];
}});
data.edges.forEach(e => {{
  const [a, b] = [at[e.src], at[e.dst]];
  const line = add("line", {{x1: a[0], y1: a[1], x2: b[0], y2: b[1], "stroke-width": 0.002}});
  const tip = document.createElementNS("http://www.w3.org/2000/svg", "title");
  tip.textContent = e.src + " " + e.relation + " " + e.dst; line.appendChild(tip);
}});
data.nodes.forEach(n => {{
  const [x, y] = at[n.entity];
  add("circle", {{cx: x, cy: y, r: 0.008 + 0.03 * n.centrality}});
  add("text", {{x: x + 0.015, y: y, style: "font-size:0.025px"}}, n.entity);
}});
</script>
"""


def write_page(spark: SparkSession, edges: DataFrame, path: str, title: str, most: int = 200) -> None:
    """Writes the page of the ``most`` nodes of highest centrality and the links between them to any store."""
    top = graph.centrality(edges).orderBy(F.desc("centrality"), "entity").limit(most)
    nodes = [r.asDict() for r in top.collect()]  # at most ``most``
    kept = spark.createDataFrame([(n["entity"],) for n in nodes], "entity string")
    links = [r.asDict() for r in graph.induced(edges, kept).select("src", "relation", "dst").collect()]
    data = json.dumps({"nodes": [{"entity": n["entity"], "centrality": float(n["centrality"])} for n in nodes], "edges": links}, ensure_ascii=False).replace("</", "<\\/")
    note = f"{len(nodes)} nodes of highest centrality, {len(links)} links between them"
    write_text(spark, path, [_PAGE.format(title=html.escape(title), note=note, data=data)])
