"""The service: index a workspace into snapshots, then search, map and ask the graph."""

from __future__ import annotations

import os
import re
import subprocess
import sys
import time
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.paths import path_of_uri
from textloom.functions.refs import encoded_refs
from textloom.functions.text import slug
from textloom.operators import chunking, code, enrich, export, graph, search, summary
from textloom.sources import workspace as ws
from textloom.sources.snapshots import Snapshot, Store

#: Size of the default vectors, results of a search, texts embedded at once.
DIMENSIONS, MOST_RESULTS, EMBED_BATCH = 384, 50, 32
#: Share of each phase of an index run, in order.
PHASES = {"scan": 0.05, "hash": 0.10, "chunk": 0.30, "embed": 0.45, "persist": 0.05, "graph": 0.05}
#: Where the index lies if neither an argument nor INDEX_DIR says so.
INDEX_DIR = ".code-index"

Embed = Callable[[list[str]], list[list[float]]]


def hashed_vector(text: str) -> list[float]:
    """A deterministic unit vector from the text's words: stands in for a trained model,
    whose place any function from texts to vectors can take."""
    v = np.zeros(DIMENSIONS)
    for word in re.findall(r"\w+", text.lower()):
        h = zlib.crc32(word.encode())
        v[h % DIMENSIONS] += 1 if h & 1 << 31 else -1
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).tolist()


def hashed_vectors() -> Embed:
    """Loads the default embedder, which is nothing but a function."""
    return lambda texts: [hashed_vector(t) for t in texts]


_EMBEDDERS: dict[Callable, Embed] = {}


def embedder(load: Callable[[], Embed]) -> Embed:
    """What `load` gives, loaded once in each process and only when it is needed."""
    if load not in _EMBEDDERS:
        _EMBEDDERS[load] = load()
    return _EMBEDDERS[load]


def embed_batches(texts: list[str], load: Callable[[], Embed], progress: Callable[[int, int], None] | None = None) -> list[list[float]]:
    """The vectors of the texts, EMBED_BATCH at once; no model is loaded for none."""
    found: list[list[float]] = []
    for begin in range(0, len(texts), EMBED_BATCH):
        found += embedder(load)(texts[begin : begin + EMBED_BATCH])
        if progress:
            progress(len(found), len(texts))
    return found


def index_dir(given: str | None = None, start: str | None = None) -> tuple[str, str]:
    """(folder of the index, what decided): the argument, a path or file URI; INDEX_DIR in the
    environment; the first folder from `start` upwards that has an index; `start` itself."""
    if given:
        return str(Path(path_of_uri(given)).resolve()), "argument"
    if os.environ.get("INDEX_DIR"):
        return str(Path(path_of_uri(os.environ["INDEX_DIR"])).resolve()), "environment"
    here = Path(start or os.getcwd()).resolve()
    for folder in (here, *here.parents):
        if (folder / INDEX_DIR / "manifest.json").is_file():
            return str(folder / INDEX_DIR), "found"
    return str(here / INDEX_DIR), "default"


class Progress:
    """Percent of an index run by its phases' shares; 100 only when it has finished."""

    def __init__(self, tell: Callable[[str, int], None] | None):
        self.tell, self.took, self.began = tell, {}, time.monotonic()

    def done(self, phase: str) -> None:
        self.took[phase] = round(time.monotonic() - self.began - sum(self.took.values()), 3)
        if self.tell:
            self.tell(phase, min(99, round(100 * sum(PHASES[p] for p in self.took))))

    def finish(self) -> dict[str, float]:
        if self.tell:
            self.tell("finished", 100)
        return self.took


def index_in_background(workspace: str, folder: str, log: str, paths: list[str] | None = None, full: bool = False) -> int:
    """Start an index run as a process of its own and give its id; a header and all it says
    are appended to `log`."""
    command = [sys.executable, "-m", "textloom", "index", "--workspace", workspace, "--index-dir", folder, *(["--full"] if full else []), *(["--paths", *paths] if paths else [])]
    with open(log, "a", encoding="utf-8") as out:
        out.write(f"--- {datetime.now(UTC).isoformat()} {' '.join(command[2:])}\n")
        out.flush()
        return subprocess.Popen(command, stdout=out, stderr=out, stdin=subprocess.DEVNULL, start_new_session=True).pid


class Engine:
    def __init__(self, spark: SparkSession, index_dir: str, load: Callable[[], Embed] = hashed_vectors):
        self.spark, self.store, self.load = spark, Store(spark, index_dir), load
        self._graph: tuple[str, DataFrame, DataFrame] | None = None

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        load = self.load

        def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(embed_batches(batch.tolist(), load), dtype=object)

        return chunks.withColumn("vector", F.pandas_udf(each, "array<float>")(F.col("content")))

    def _chunks(self, files: DataFrame, repo: str) -> DataFrame:
        """Chunks without vectors. References are those of a symbol's whole text, before it
        is cut; Markdown, plain texts and SQL have none."""
        plain = ("text", "xml", "razor", "dart", "pascal", "vb6")
        none = F.array().cast("array<string>")
        markdown = chunking.markdown_sections(files.where("language = 'markdown'"), "path").withColumn("language", F.lit("markdown"))
        packed = chunking.explode_paragraphs(files.where(F.col("language").isin(*plain)), "path", keep=("language",))
        symbols = code.code_chunks(files.where(~F.col("language").isin("markdown", *plain)))
        symbols = symbols.withColumn("references", F.when(F.col("language") == "sql", none).otherwise(encoded_refs(F.col("content")))).withColumn("content", chunking.truncated(F.col("content")))
        rows = markdown.unionByName(packed).withColumn("references", none).unionByName(symbols)
        rows = rows.withColumn("id", chunking.chunk_id(F.col("content"), F.col("file_path"), F.col("start_line"), F.col("end_line")))
        return rows.withColumn("repo", F.lit(repo)).withColumn("indexed_at", F.lit(datetime.now(UTC).isoformat()))

    def index(self, workspace: str, paths: list[str] | None = None, full: bool = False, dry_run: bool = False, debounce: bool = False, progress: Callable[[str, int], None] | None = None) -> dict:
        """Bring the index up to date: only files whose time or size changed are read, only
        those whose content changed are chunked again, and a new snapshot is published when
        all its tables are written. `debounce` skips a run shortly after another of the same
        commit."""
        scanned = ws.scan(self.spark, workspace, paths)
        eligible = scanned.where("skipped is null").select("path", "mtime", "size", "language")
        if dry_run:
            counts = summary.dry_run(eligible)
            return {"counts": {r.path: r.eligible_files for r in counts.collect()}, "recommended": [r.path for r in summary.recommended(counts).collect()]}
        head, repo = ws.git_head(workspace), re.sub(r".*/", "", workspace.rstrip("/"))
        with self.store.lock() as mine:
            if not mine:
                return {"skipped_reason": "another run holds the lock"}
            phases = Progress(progress)
            old = self.store.snapshot() if self.store.exists() else None
            if debounce and old and self._debounced(old.manifest, head):
                return {"skipped_reason": "the last run was moments ago, at the same commit"}
            if full and not paths:
                old = None
            known = old.table("files") if old else self.spark.createDataFrame([], "path string, mtime double, size long, language string, sha256 string")
            scope = F.lit(False)
            for root in ws.scan_roots(workspace, paths):
                scope = scope | (F.lit(root == ".") | (F.col("path") == root) | F.col("path").startswith(f"{root}/"))
            skipped = {r.skipped: r["count"] for r in scanned.where("skipped is not null").groupBy("skipped").count().collect()}
            phases.done("scan")
            same = eligible.join(known.select("path", "mtime", "size", "sha256"), ["path", "mtime", "size"], "left_semi") if not full else eligible.limit(0)
            read = ws.with_content(eligible.join(same.select("path"), "path", "left_anti"), workspace).persist()
            now = read.drop("content").unionByName(same.join(known.select("path", "sha256"), "path"))
            diff = summary.file_diff(now, known.where(scope), full=full).persist()
            counts = {r.status: r["count"] for r in diff.groupBy("status").count().collect()}
            phases.done("hash")
            told = {"counts": counts, "skipped": skipped}
            if old and not (counts.keys() & {"new", "changed", "deleted", "touched"}):
                return {"snapshot": old.folder.name, **told, "graph": "skipped-unchanged", "phase_durations_s": phases.finish()}
            changed = diff.where("status in ('new', 'changed')").select("path")
            gone = diff.where("status in ('changed', 'deleted')").select("path")
            work, draft = read.join(changed, "path", "left_semi"), self.store.draft()
            fresh = draft.put("new_chunks", self._chunks(work, repo))
            phases.done("chunk")
            new, imported = draft.put("embedded", self._embedded(fresh)), code.imports(work)
            terms = search.postings(fresh, "content", "id", ("file_path",))
            phases.done("embed")
            if old:
                new, terms = summary.replaced(old.table("chunks"), gone, new), summary.replaced(old.table("postings"), gone, terms)
                imported = old.table("imports").join(gone, "path", "left_anti").unionByName(imported)
            files = draft.put("files", now.unionByName(known.where(~scope).select(*now.columns)))
            chunks, imports = draft.put("chunks", new), draft.put("imports", imported)
            draft.put("postings", terms.repartition("bucket"), "bucket")
            draft.put("text_stats", search.text_stats(chunks, "content"))
            phases.done("persist")
            how = self._graph_tables(draft, old, counts, changed, files, chunks, imports)
            facts = summary.status(chunks).first().asDict() | {"git_head_sha": head, "last_indexed_at": datetime.now(UTC).isoformat(), "workspace": str(Path(workspace).resolve()), "embedding_dim": DIMENSIONS}
            draft.drop("new_chunks", "embedded")
            self.store.commit(draft, facts)
            phases.done("graph")
            read.unpersist()
            diff.unpersist()
            return {"snapshot": draft.folder.name, **told, "graph": how, "phase_durations_s": phases.finish()}

    def _debounced(self, manifest: dict, head: str | None) -> bool:
        row = self.spark.range(1).select(summary.is_debounced(F.to_timestamp(F.lit(manifest["last_indexed_at"])), F.current_timestamp(), F.lit(manifest.get("git_head_sha")).cast("string"), F.lit(head).cast("string")).alias("x"))
        return row.first().x

    def _graph_tables(self, draft: Snapshot, old: Snapshot | None, counts: dict, changed: DataFrame, files: DataFrame, chunks: DataFrame, imports: DataFrame) -> str:
        """Write nodes and edges: only what changed files contribute if the old graph knows
        all files and none that changed is a document, else the whole graph."""
        only_code = old is not None and not counts.keys() & {"new", "deleted"} and changed.where(F.lower("path").endswith(".md")).isEmpty()
        if only_code:
            nodes, edges = graph.updated(old.table("nodes"), old.table("edges"), files, chunks, imports, changed)
        else:
            nodes, edges = graph.build(files, chunks, imports)
        edges = draft.put("edges", edges)
        draft.put("nodes", graph.degrees(nodes, edges))
        return "incremental-code" if only_code else "full"

    def search(self, query: str, top_k: int = 5, repo: str | None = None, language: str | None = None, path_prefix: str | None = None, include_content: bool = False, limit: int | None = None) -> dict:
        """The best chunks by hybrid ranking: places and, if asked, contents; Markdown hits
        with their links, code hits with what they cite. `limit` goes before top_k."""
        top_k = top_k if limit is None else limit
        if not query.strip():
            raise ValueError("a query is required")
        if not 1 <= top_k <= MOST_RESULTS:
            raise ValueError(f"top_k must be between 1 and {MOST_RESULTS}")
        began, snapshot = time.monotonic(), self.store.snapshot()
        chunks, files = snapshot.table("chunks"), snapshot.table("files")
        where = search.predicate(repo, language, path_prefix)
        vectors = search.knn(chunks, "vector", embed_batches([query], self.load)[0], "id", where=where)
        allowed = None if where is None else chunks.where(where)
        texts = search.bm25_indexed(snapshot.table("postings"), snapshot.table("text_stats"), re.findall(r"\w+", query.lower()), "id", allowed=allowed)
        found = search.rrf([vectors.select("id", "score"), texts], "id", top_k)
        hits = chunks.drop("vector").join(F.broadcast(found), "id").persist()
        rows = hits.orderBy(F.desc("score"), "id").collect()
        sections = snapshot.table("chunks").where("scope_type = 'section'").select("file_path", "scope_name", "start_line")
        links, refs = {}, {}
        for r in enrich.markdown_references(hits, files, sections).orderBy("n").collect():
            extra = {k: v for k, v in (("alias", r.alias), ("candidates", r.candidates)) if v}
            links.setdefault(r.id, []).append({"file_path": r.file_path, "anchor": r.anchor, "resolved_section": r.resolved_section} | extra)
        for r in enrich.code_references(hits, files).orderBy("n").collect():
            entry = {"kind": r.kind, "key": r.key} | ({"text": r.text} if r.kind == "annotation" else {"note_path": r.note_path})
            refs.setdefault(r.id, []).append(entry | ({"candidates": r.candidates} if r.candidates else {}))
        hits.unpersist()
        results = []
        for r in rows:
            item = {"id": r.id, "file_path": r.file_path, "repo": r.repo, "symbol": r.scope_name, "type": r.scope_type, "language": r.language, "lines": [r.start_line, r.end_line], "score": r.score}
            item |= {"content": r.content} if include_content else {}
            item |= {"markdown_references": links[r.id]} if r.id in links else {}
            item |= {"rationale_refs": refs[r.id]} if r.id in refs else {}
            results.append(item)
        return {"results": results, "total_chunks_searched": snapshot.manifest["total_chunks"], "query_time_ms": round((time.monotonic() - began) * 1000, 2)}

    def _loaded_graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of the published snapshot, kept until another is published."""
        snapshot = self.store.snapshot()
        if self._graph is None or self._graph[0] != str(snapshot.folder):
            for df in self._graph[1:] if self._graph else ():
                df.unpersist()
            self._graph = (str(snapshot.folder), snapshot.table("nodes").persist(), snapshot.table("edges").persist())
        return self._graph[1], self._graph[2]

    def graph(self, mode: str, target: str | None = None, source: str | None = None, top_n: int = 10) -> dict:
        nodes, edges = self._loaded_graph()
        if mode == "hubs":
            return {"hubs": [r.asDict() for r in graph.hubs(nodes.drop("degree"), edges, top_n).collect()]}
        if mode not in ("path", "explain"):
            raise ValueError("mode must be hubs, path or explain")
        ends = []
        for text in [target] if mode == "explain" else [source, target]:
            hits = graph.resolve_node(nodes, text or "").collect()
            if len(hits) != 1:
                return {"error": "ambiguous" if hits else "not found", "candidates": sorted(r.id for r in hits)[:20]}
            ends.append(hits[0].id)
        if mode == "explain":
            near = graph.explain(nodes, edges, ends[0])
            grouped = {r.kind: [n.asDict() for n in r.neighbours] for r in graph.by_kind(near).collect()}
            notes = [r.file_path for r in near.where("kind = 'doc'").select("file_path").distinct().orderBy("file_path").collect()]
            rationale = [r.label for r in near.where("kind = 'rationale'").orderBy("label", "id").collect()]
            return {"node": ends[0], "neighbours": grouped, "rationale": rationale, "notes": notes}
        way = graph.shortest_path(edges, *ends)
        return {"found": bool(way), "hops": max(0, len(way) - 1), "path": way}

    def export_graph(self, folder: str) -> dict:
        """Write graph.json and graph.html into a folder; a page that fails costs nothing else."""
        nodes, edges = self._loaded_graph()
        manifest, target = self.store.manifest(), Path(folder)
        target.mkdir(parents=True, exist_ok=True)
        facts = {"generated_at": datetime.now(UTC).isoformat(), "workspace_repo": Path(manifest["workspace"]).name}
        export.write_json(nodes, edges, str(target / "graph.json"), facts)
        export.write_html(str(target / "graph.json"), str(target / "graph.html"))
        return {"json": str(target / "graph.json"), "html": str(target / "graph.html")}

    def symbol_map(self, repo: str | None = None, path_prefix: str | None = None, max_depth: int = 3) -> str:
        """The map's lines and, last, how many files and symbols there are."""
        where = search.predicate(repo, None, path_prefix)
        chunks = self.store.snapshot().table("chunks")
        chunks = chunks if where is None else chunks.where(where)
        totals = summary.map_totals(chunks, max_depth).first()
        return "\n".join([*(r.line for r in summary.map_lines(chunks, max_depth).toLocalIterator()), f"{totals.total_files} files, {totals.total_symbols} symbols"])

    def status(self, workspace: str | None = None) -> dict:
        facts = {"index_path": str(self.store.folder.resolve()), "embedding_dim": DIMENSIONS, "storage_backend": "parquet", "reindexing": self.store.is_locked()}
        if not self.store.exists():
            return facts | {"index_exists": False, "total_chunks": 0, "repos": [], "languages": [], "last_indexed_at": None, "git_head_sha": None, "is_stale": False, "graph_available": False}
        try:
            snapshot = self.store.snapshot()
        except RuntimeError as e:
            return facts | {"index_exists": True, "error": str(e), "graph_available": False}
        sha, head = snapshot.manifest.get("git_head_sha"), ws.git_head(workspace or snapshot.manifest["workspace"])
        return facts | {"index_exists": True, **snapshot.manifest, "is_stale": bool(sha and head and sha != head), "graph_available": (snapshot.folder / "edges").is_dir()}

    def section_of(self, file_path: str, anchor: str) -> str | None:
        """The first section of a file whose name has the anchor's slug."""
        sections = self.store.snapshot().table("chunks").where((F.col("file_path") == file_path) & (F.col("scope_type") == "section")).select("scope_name", "start_line").orderBy("start_line")
        return next((r.scope_name for r in sections.collect() if slug(r.scope_name) == slug(anchor)), None)
