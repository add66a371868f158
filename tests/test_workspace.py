"""Indexing a workspace: what is read, changed, published and found."""

import json
import shutil

import pytest

from textloom.engine import INDEX_DIR, Engine, embed_batches, index_dir
from textloom.functions.paths import path_of_uri
from textloom.operators import graph as graphs
from textloom.operators import code
from textloom.sources import workspace as ws
from textloom.sources.snapshots import Store, version_key


def test_scanners():
    python = code.python_chunks("class A:\n    def f(self):\n        pass\n\ndef g():\n    pass\n")
    assert [(k, n, a, b) for k, n, a, b, _ in python] == [("class", "A", 1, 3), ("method", "A.f", 2, 3), ("function", "g", 5, 6)]
    script = code.braced_chunks("class A {\n  run(x) {\n    if (x) { return '}' }\n  }\n}\nfunction f() {\n}\n")
    assert [(k, n) for k, n, *_ in script] == [("class", "A"), ("method", "A.run"), ("function", "f")]
    sql = code.sql_chunks("CREATE TABLE t (a int);\n-- x;\nSELECT ';' FROM t;\nCREATE OR REPLACE VIEW v AS SELECT 1;")
    assert [(s, n) for s, n, *_ in sql] == [("table", "t"), ("query", "select_t"), ("view", "v")]
    assert code.script_imports("import a from './a';\nexport { b } from \"./b\";\n") == ["./a", "./b"]


def test_versions_and_lock(spark, tmp_path):
    assert version_key("2.0.0") < version_key("2.1.0") and version_key("x.1") == (0, 1)
    store = Store(spark, str(tmp_path))
    with store.lock() as mine, Store(spark, str(tmp_path)).lock() as other:
        assert mine and not other and store.is_locked()
    assert not store.is_locked() and not store.exists()


def test_index(spark, tmp_path):
    top = tmp_path / "work"
    for path, text in {"pkg/__init__.py": "", "pkg/a.py": "# see DEC-2\nimport pkg._b\ndef run_unique_token():\n    # WHY: speed\n    return 1\n", "pkg/_b.py": "def go():\n    pass\n", "docs/dec-002-x.md": "# Choice\ntext\n", "docs/o.md": "# Top\nsee [x](dec-002-x.md)\n", "node_modules/x.js": "x", ".git/y.py": "y", "skip.log.txt": "no", ".indexignore": "*.log.txt\n", "n.txt": "one\n\ntwo"}.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    scanned = {r.path: r.skipped for r in ws.scan(spark, str(top)).collect()}
    assert {p for p, s in scanned.items() if s is None} == {"pkg/__init__.py", "pkg/a.py", "pkg/_b.py", "docs/dec-002-x.md", "docs/o.md", "n.txt"}
    with pytest.raises(ValueError):
        ws.scan_roots(str(top), ["../x"])
    engine = Engine(spark, str(tmp_path / "index"))
    assert not engine.status()["index_exists"] and not engine.status()["reindexing"]
    assert engine.index(str(top), dry_run=True)["counts"] == {"pkg": 3, "docs": 2, "n.txt": 1}
    assert engine.index(str(top))["counts"] == {"new": 6}
    hit = engine.search("run_unique_token", include_content=True)["results"][0]
    assert hit["file_path"] == "pkg/a.py" and "WHY" in hit["content"]
    assert engine.index(str(top)).get("graph") == "skipped-unchanged"
    assert engine.graph("path", "docs/dec-002-x.md", "docs/o.md")["hops"] == 2
    kinds = {r.kind for r in engine.store.snapshot().table("edges").collect()}
    assert {"contains", "links_to", "imports", "annotates"} <= kinds
    (top / "pkg/a.py").write_text("def other():\n    pass\n")
    (top / "docs/o.md").unlink()
    changed = engine.index(str(top))
    assert changed["counts"] == {"changed": 1, "deleted": 1, "unchanged": 4}
    incremental = {(r.file_path, r.scope_name) for r in engine.store.snapshot().table("chunks").collect()}
    rebuilt = Engine(spark, str(tmp_path / "again"))
    rebuilt.index(str(top), full=True)
    assert incremental == {(r.file_path, r.scope_name) for r in rebuilt.store.snapshot().table("chunks").collect()}
    assert engine.status()["total_chunks"] == len(incremental) and "other" in engine.symbol_map()
    assert engine.graph("hubs", top_n=3)["hubs"] and engine.graph("explain", "nothing at all")["error"] == "not found"


def test_sql_chunks_lose_no_statement():
    rows = ",\n".join(f"  ({i}, 'value number {i}')" for i in range(100))
    text = f"GRANT SELECT ON t TO u;\nWITH a AS (SELECT 1) SELECT * FROM a;\nINSERT INTO t VALUES\n{rows};\n-- end"
    found = code.sql_chunks(text)
    assert [(c[0], c[1]) for c in found[:2]] == [("statement", "statement_1"), ("statement", "statement_2")]
    parts = found[2:]
    assert len(parts) > 1 and [c[1] for c in parts] == [f"t (Parte {i})" for i in range(1, len(parts) + 1)]
    assert all(len(c[4]) <= 1000 and c[4].split("\n") == text.replace(";", "").split("\n")[c[2] - 1 : c[3]] for c in parts)
    assert "\n".join(c[4] for c in parts) == f"INSERT INTO t VALUES\n{rows}"


LONG = "def long_one():\n" + "".join(f"    x{i} = {i}  # {'pad' * 12}\n" for i in range(12)) + "    # WHY: in the middle\n" + "".join(f"    y{i} = {i}  # {'pad' * 12}\n" for i in range(12))


def test_snapshots_references_and_enrichment(spark, tmp_path):
    top = tmp_path / "work"
    files = {"a.py": LONG, "b.py": "# DEC-3\ndef two():\n    # see DEC-3 and ADR-1\n    return 2\n", "n.txt": "# NOTE: no reference\n", "docs/dec-003-x.md": "# Choice\ntext\n", "docs/o.md": "# Top\nsee [x](dec-003-x.md#choice) uniquemarkdown\n", "q.sql": "SELECT 1; -- WHY: none\n"}
    for path, text in files.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    told = []
    engine = Engine(spark, str(tmp_path / "index"))
    first = engine.index(str(top), progress=lambda phase, percent: told.append((phase, percent)))
    assert [p for p, _ in told] == ["scan", "hash", "chunk", "embed", "persist", "graph", "finished"] and told[-1][1] == 100 and max(n for _, n in told[:-1]) <= 99
    assert first["graph"] == "full" and set(first["phase_durations_s"]) == {"scan", "hash", "chunk", "embed", "persist", "graph"}
    edges = engine.store.snapshot().table("edges")
    # The note stands in lines that the stored content has no more; texts and SQL have no references.
    assert {r.source for r in edges.where("kind = 'annotates'").collect()} == {"sym:a.py#long_one"}
    assert {(r.source, r.target) for r in edges.where("kind = 'cites'").collect()} == {("sym:b.py#two", "file:docs/dec-003-x.md")}
    code_hit = engine.search("two", limit=1, top_k=9)["results"][0]
    assert code_hit["rationale_refs"] == [{"kind": "cite", "key": "dec-003", "note_path": "docs/dec-003-x.md"}, {"kind": "cite", "key": "adr-001", "note_path": None}]
    found = engine.search("uniquemarkdown", language="markdown")
    assert found["results"][0]["markdown_references"] == [{"file_path": "docs/dec-003-x.md", "anchor": "choice", "resolved_section": "Choice"}] and "content" not in found["results"][0]
    assert found["total_chunks_searched"] == engine.status()["total_chunks"]
    (top / "b.py").write_text("def two():\n    # NOTE: changed_token\n    return 3\n")
    assert engine.index(str(top), debounce=True)["graph"] == "incremental-code"
    pinned = engine.store.snapshot()
    rebuilt = graphs.build(*(pinned.table(t) for t in ("files", "chunks", "imports")))
    assert {tuple(r) for r in pinned.table("edges").collect()} == {tuple(r) for r in rebuilt[1].collect()}
    columns = ["id", "kind", "label", "file_path"]
    assert {tuple(r) for r in pinned.table("nodes").select(columns).collect()} == {tuple(r) for r in rebuilt[0].select(columns).collect()}
    assert engine.search("changed_token")["results"][0]["file_path"] == "b.py"
    # A run that breaks before the commit changes nothing for readers.
    (top / "b.py").write_text("def three():\n    pass\n")
    whole, engine._graph_tables = engine._graph_tables, lambda *_: 1 / 0
    with pytest.raises(ZeroDivisionError):
        engine.index(str(top))
    assert engine.store.manifest()["snapshot"] == pinned.folder.name and engine.graph("hubs", top_n=2)["hubs"]
    engine._graph_tables = whole
    assert engine.index(str(top))["counts"]["changed"] == 1 and engine.graph("explain", "three")["neighbours"].keys() == {"contains"}
    out = engine.export_graph(str(tmp_path / "out"))
    document = json.load(open(out["json"]))
    assert document["metrics"]["node_count"] == len(document["nodes"]) and document["nodes"] == sorted(document["nodes"], key=lambda n: n["id"])
    assert "</script" not in open(out["html"]).read().split('id="data">')[1].split("</script>")[0]
    shutil.rmtree(top / "docs")
    assert engine.index(str(top))["graph"] == "full"


def test_index_dir_uris_and_batches(tmp_path, monkeypatch):
    monkeypatch.delenv("INDEX_DIR", raising=False)
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    assert index_dir(None, str(inner)) == (str(inner / INDEX_DIR), "default")
    (tmp_path / INDEX_DIR).mkdir()
    (tmp_path / INDEX_DIR / "manifest.json").write_text("{}")
    assert index_dir(None, str(inner)) == (str(tmp_path / INDEX_DIR), "found")
    monkeypatch.setenv("INDEX_DIR", str(inner))
    assert index_dir(None, "/")[1] == "environment" and index_dir("file:///x%20y", "/") == ("/x y", "argument")
    assert path_of_uri("file:///C:/x") == "C:/x" and path_of_uri("/plain") == "/plain"
    loads, sizes = [], []

    def load():
        loads.append(1)
        return lambda texts: sizes.append(len(texts)) or [[0.0]] * len(texts)

    assert embed_batches([], load) == [] and not loads
    assert len(embed_batches(["x"] * 70, load)) == 70 and sizes == [32, 32, 6] and len(loads) == 1
    embed_batches(["x"], load)
    assert len(loads) == 1
