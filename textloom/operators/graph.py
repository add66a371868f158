"""Property graph as two DataFrames: nodes(id, kind, label, file_path, start_line, end_line)
and edges(source, target, kind). Stored directed, walked undirected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.refs import decoded_refs, markdown_links
from textloom.operators.resolve import import_edges, resolve_links, resolve_notes
from textloom.shared import written

#: Hubs shown at most, hops of a path, nodes that a viewer shows in full.
MOST_HUBS, MOST_HOPS, FULL_VIEW = 50, 10, 3000


def adjacency(edges: DataFrame) -> DataFrame:
    """node, neighbour, kind in both directions."""
    return edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "kind").unionAll(edges.select("target", "source", "kind"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`nodes` with degree: edges at either end, `contains` left out; 0 where there is none."""
    counted = adjacency(edges.where("kind <> 'contains'")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(counted, nodes["id"] == counted["node"], "left").select(nodes["*"], F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, top_n: int = 10) -> DataFrame:
    """The `top_n` nodes of the highest degree, ties by id."""
    if not 1 <= top_n <= MOST_HUBS:
        raise ValueError(f"top_n must be between 1 and {MOST_HUBS}")
    return degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(top_n)


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count and edge_count."""
    return nodes.agg(F.count(F.lit(1)).alias("node_count")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edge_count"))))


def ordered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by id, edges by source, target and kind: the order of an export."""
    return nodes.orderBy("id"), edges.orderBy("source", "target", "kind")


def details(nodes: DataFrame, edges: DataFrame, node_id: str, most: int = 20) -> DataFrame:
    """The first `most` neighbours of a node by label and id."""
    return explain(nodes, edges, node_id).orderBy("label", "id", "edge_kind").limit(most)


def by_kind(neighbours: DataFrame) -> DataFrame:
    """kind and the sorted (label, id) of the neighbours of each edge kind."""
    return neighbours.groupBy(F.col("edge_kind").alias("kind")).agg(F.sort_array(F.collect_set(F.struct("label", "id"))).alias("neighbours"))


def kind_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def explain(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Neighbours of a node: edge_kind, id, kind, label, file_path, each once."""
    near = adjacency(edges).where(F.col("node") == node_id).select(F.col("neighbour").alias("id"), F.col("kind").alias("edge_kind")).distinct()
    return near.join(nodes, "id").select("edge_kind", "id", "kind", "label", "file_path")


def distances(edges: DataFrame, source: str, most: int = MOST_HOPS, target: str | None = None) -> DataFrame:
    """node, hops, parent, edge_kind of all nodes within `most` hops of `source`, by
    breadth-first rounds; stops once `target` is met. Of equally short ways the one by the
    smallest (parent, kind) counts."""
    spark = edges.sparkSession
    around = adjacency(edges).where("node <> neighbour").distinct().persist()
    frontier = spark.createDataFrame([(source, 0, None, None)], "node string, hops int, parent string, edge_kind string")
    rounds = [frontier]  # a table a hop, none of them written again
    for hop in range(1, most + 1):
        if target is not None and not frontier.where(F.col("node") == target).isEmpty():
            break
        step = frontier.select("node").join(around, "node").groupBy(F.col("neighbour").alias("node")).agg(F.min(F.struct(F.col("node").alias("parent"), F.col("kind"))).alias("via"))
        seen = reduce(DataFrame.unionByName, rounds)
        step = step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hops"), F.col("via.parent").alias("parent"), F.col("via.kind").alias("edge_kind"))
        frontier = written(step, "frontier")
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    around.unpersist()
    return reduce(DataFrame.unionByName, rounds)


def shortest_path(edges: DataFrame, source: str, target: str, most: int = MOST_HOPS) -> list[tuple[str, str | None]]:
    """[(node, kind of the edge to the next)] from source to target; empty if there is no
    way within `most` hops, a single node if both are the same. The way back reads a row a
    hop."""
    reached = distances(edges, source, most, target)
    way: list[tuple[str, str | None]] = []
    node, kind = target, None
    for _ in range(most + 1):
        row = reached.where(F.col("node") == node).first()
        if row is None:
            return []
        way.append((node, kind))
        if row.parent is None:
            return way[::-1]
        node, kind = row.parent, row.edge_kind
    return []


def resolve_node(nodes: DataFrame, text: str) -> DataFrame:
    """tier and columns of the nodes that a text may mean, best tier only.

    Tiers: 1 the id; 2 the label, any case; 3 the path, files and documents first; 4 the end
    of id, path or label; 5 the end of a file's or document's path where tier 4 has several.
    One row is a hit, more are ambiguous, none is not found.
    """
    wanted = text.strip()
    if not wanted:
        raise ValueError("a node is required")
    is_file = F.col("kind").isin("file", "doc")
    ends = F.col("id").endswith(wanted) | F.coalesce(F.col("file_path").endswith(wanted), F.lit(False)) | F.col("label").endswith(wanted)
    tiers = F.when(F.col("id") == wanted, 1).when(F.lower("label") == wanted.lower(), 2).when((F.col("file_path") == wanted) & is_file, 3).when(F.col("file_path") == wanted, 3.5).when(ends, 4)
    found = nodes.withColumn("tier", tiers.cast("double")).where("tier is not null")
    best = found.agg(F.min("tier").alias("best"))
    found = found.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")
    everything = Window.partitionBy()  # the rows of one tier for one text
    by_path = (F.col("tier") == 4) & is_file & F.col("file_path").endswith(wanted)
    found = found.withColumn("__paths", F.sum(by_path.cast("int")).over(everything)).withColumn("__all", F.count(F.lit(1)).over(everything))
    found = found.where((F.col("tier") != 4) | (F.col("__all") == 1) | (F.col("__paths") != 1) | by_path)
    return found.select(F.when((F.col("tier") == 4) & (F.col("__all") > 1) & (F.col("__paths") == 1), 5).otherwise(F.floor("tier")).cast("int").alias("tier"), *nodes.columns)


def view(nodes: DataFrame, edges: DataFrame, top_n: int = 25, most: int = FULL_VIEW) -> DataFrame:
    """Ids of what a viewer shows at first: all nodes if they are `most` at most, else `focus`."""
    few = nodes.limit(most + 1).count() <= most
    return nodes.select("id") if few else focus(nodes, edges, top_n)


def focus(nodes: DataFrame, edges: DataFrame, top_n: int = 25) -> DataFrame:
    """Ids of the hubs and of all that is one edge away from one."""
    top = hubs(nodes, edges, top_n).select(F.col("id").alias("node"))
    near = adjacency(edges).join(F.broadcast(top), "node", "left_semi").select("neighbour")
    return top.unionAll(near).distinct().select(F.col("node").alias("id"))


def visible(nodes: DataFrame, edges: DataFrame, node_kinds: list[str], edge_kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the kinds, and edges of the kinds between two of them."""
    shown = nodes.where(F.col("kind").isin(node_kinds))
    ids = shown.select("id")
    kept = edges.where(F.col("kind").isin(edge_kinds))
    for end in ("source", "target"):  # both ends are shown
        kept = kept.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return shown, kept.select(*edges.columns)


def search(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """Ids of nodes whose id or label holds the text, in any case, and of their neighbours."""
    low = text.lower()
    hit = nodes.where(F.lower("id").contains(low) | F.lower("label").contains(low)).select(F.col("id").alias("node"))
    return hit.unionAll(adjacency(edges).join(hit, "node", "left_semi").select("neighbour")).distinct().select(F.col("node").alias("id"))


def of_paths(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """The chunks of the files in `paths` (path)."""
    return chunks.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select(*chunks.columns)


def _source_path(source: Column) -> Column:
    return F.regexp_extract(source, "^(?:file|sym|sec):([^#]*)", 1)


def _note_nodes(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the annotations (id, label) that an edge still leads to, each under the first
    path that it stands in."""
    at = edges.where("kind = 'annotates'").groupBy(F.col("target").alias("id")).agg(F.min(_source_path(F.col("source"))).alias("file_path"))
    none = F.lit(None).cast("int")
    return labels.distinct().join(at, "id").select("id", F.lit("rationale").alias("kind"), "label", "file_path", none.alias("start_line"), none.alias("end_line"))


def build(files: DataFrame, chunks: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an index: files(path), chunks with their encoded references (taken
    from the whole text, before any is cut), imports(path, raw_import)."""
    nodes, labels, edges = _contributed(files, chunks, imports)
    return nodes.unionByName(_note_nodes(labels, edges)), edges


def updated(nodes: DataFrame, edges: DataFrame, files: DataFrame, chunks: DataFrame, imports: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after only the content of the code files `changed` (path) has changed: what
    they contribute is made anew, all else stays. The same as `build` of everything."""
    ids = changed.select(F.col("path").alias("__path")).distinct()
    fresh, labels, new = _contributed(files, of_paths(chunks, changed), imports.join(changed.select("path"), "path", "left_semi"))
    kept = edges.join(ids, _source_path(F.col("source")) == F.col("__path"), "left_anti")
    edges = kept.unionByName(new).dropDuplicates(["source", "target", "kind"])
    columns = ["id", "kind", "label", "file_path", "start_line", "end_line"]
    units = nodes.select(*columns).where("kind in ('symbol', 'section')").join(ids, F.col("file_path") == F.col("__path"), "left_anti")
    labels = labels.unionByName(nodes.where("kind = 'rationale'").select("id", "label"))
    return fresh.unionByName(units).unionByName(_note_nodes(labels, edges)), edges


def _contributed(files: DataFrame, chunks: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """File and unit nodes, labels of annotations, and edges."""
    is_doc = F.lower("path").endswith(".md")
    file_nodes = files.select(F.concat(F.lit("file:"), F.col("path")).alias("id"), F.when(is_doc, "doc").otherwise("file").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("label"), F.col("path").alias("file_path"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    section = F.col("language") == "markdown"
    node_id = F.concat_ws("", F.when(section, "sec:").otherwise("sym:"), F.col("file_path"), F.lit("#"), F.col("scope_name"))
    units = chunks.withColumn("node", node_id)
    latest = F.max_by(F.struct("start_line", "end_line"), F.struct("start_line", "end_line")).alias("lines")
    unit_nodes = units.groupBy("node").agg(F.min("scope_name").alias("label"), F.min("file_path").alias("file_path"), F.min("language").alias("language"), latest)
    unit_nodes = unit_nodes.select(F.col("node").alias("id"), F.when(section, "section").otherwise("symbol").alias("kind"), "label", "file_path", F.col("lines.start_line").alias("start_line"), F.col("lines.end_line").alias("end_line"))
    contains = units.select(F.concat(F.lit("file:"), F.col("file_path")).alias("source"), F.col("node").alias("target"), F.lit("contains").alias("kind"))
    links = units.where(section).select("node", F.col("file_path"), F.explode(markdown_links(F.col("content"), F.col("file_path"))).alias("link"))
    linked = resolve_links(links.select("node", "file_path", "link.*"), files).where("resolved is not null")
    links_to = linked.select(F.col("node").alias("source"), F.concat(F.lit("file:"), F.col("resolved")).alias("target"), F.lit("links_to").alias("kind"))
    refs = units.where(~section).select("node", F.explode(decoded_refs(F.col("references"))).alias("ref")).select("node", "ref.*")
    notes = refs.where("kind = 'annotation'").withColumn("id", F.concat(F.lit("rat:"), F.substring(F.sha1(F.concat_ws(":", "key", "text")), 1, 12)))
    labels = notes.select("id", F.col("text").alias("label"))
    annotates = notes.select(F.col("node").alias("source"), F.col("id").alias("target"), F.lit("annotates").alias("kind"))
    stems = files.where(is_doc).select("path")
    cited = resolve_notes(refs.where("kind <> 'annotation'").select("node", "key"), stems).where("note_path is not null")
    cites = cited.select(F.col("node").alias("source"), F.concat(F.lit("file:"), F.col("note_path")).alias("target"), F.lit("cites").alias("kind"))
    imported = import_edges(imports, files).select(F.concat(F.lit("file:"), F.col("path")).alias("source"), F.concat(F.lit("file:"), F.col("resolved")).alias("target"), F.lit("imports").alias("kind"))
    edges = reduce(DataFrame.unionByName, (contains, links_to, annotates, cites, imported))
    edges = edges.where("source <> target").dropDuplicates(["source", "target", "kind"])
    return file_nodes.unionByName(unit_nodes), labels, edges
