"""The graph as one compact JSON document, and a page that shows it."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame

from textloom.operators import graph

#: Version of the document, precomputed hubs.
GRAPH_VERSION, TOP_HUBS = "1.0", 25


def write_json(nodes: DataFrame, edges: DataFrame, path: str, facts: dict) -> None:
    """Write nodes and edges in canonical order with their metrics; a row at a time passes
    through the driver, and the file replaces the old one at once."""
    counts = graph.metrics(nodes, edges).first()
    hubs = [r.id for r in graph.hubs(nodes.drop("degree"), edges, TOP_HUBS).collect()]
    draft = Path(f"{path}.new")
    compact = {"ensure_ascii": False, "separators": (",", ":")}
    with draft.open("w", encoding="utf-8") as out:
        head = facts | {"graph_version": GRAPH_VERSION, "metrics": counts.asDict() | {"top_hubs": hubs}}
        out.write(json.dumps(head, **compact)[:-1])
        for name, rows in zip(("nodes", "edges"), graph.ordered(nodes, edges)):
            out.write(f',"{name}":[')
            for n, row in enumerate(rows.toJSON().toLocalIterator()):
                out.write("," * (n > 0) + row)
            out.write("]")
        out.write("}")
    os.replace(draft, path)


PAGE = """<!doctype html><meta charset="utf-8"><title>graph</title>
<style>body{font:14px sans-serif;margin:1em}li{cursor:pointer}main{display:flex;gap:2em}</style>
<p id="counts"></p><input id="find" placeholder="search"><main><ul id="list"></ul><ul id="near"></ul></main>
<script type="application/json" id="data">%s</script>
<script>
const graph = JSON.parse(document.getElementById("data").textContent), byId = new Map(graph.nodes.map(n => [n.id, n]));
const item = (text, go) => { const li = document.createElement("li"); li.textContent = text; li.onclick = go; return li; };
const near = id => document.getElementById("near").replaceChildren(...graph.edges.filter(e => e.source === id || e.target === id).slice(0, 20)
  .map(e => { const other = e.source === id ? e.target : e.source; return item(e.kind + " " + (byId.get(other) || {label: other}).label, () => near(other)); }));
const list = text => document.getElementById("list").replaceChildren(...graph.nodes.filter(n => (n.id + " " + n.label).toLowerCase().includes(text))
  .slice(0, 500).map(n => item(n.kind + " " + n.label, () => near(n.id))));
document.getElementById("counts").textContent = graph.metrics.node_count + " nodes, " + graph.metrics.edge_count + " edges";
document.getElementById("find").oninput = e => list(e.target.value.toLowerCase());
list("");
</script>
"""


def write_html(json_path: str, path: str) -> None:
    """A page of its own with the document in it; `</` is escaped, so no text can end it."""
    data = Path(json_path).read_text("utf-8").replace("</", "<\\/")
    draft = Path(f"{path}.new")
    draft.write_text(PAGE.replace("%s", data, 1), "utf-8")
    os.replace(draft, path)
