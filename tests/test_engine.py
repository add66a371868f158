"""The core engine: every query against its SQL, and the behaviours SQL can't say."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.functions import paths, refs, text
from textloom.operators import chunking, graph, resolve, search, summary
from textloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 9) if isinstance(value, float) else float(value) if hasattr(value, "is_finite") else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in found.collect()), key=repr)
    wanted = duck.sql(catalogue.ORACLES[name])
    assert sorted(wanted.columns) == columns
    at = [wanted.columns.index(c) for c in columns]
    assert got == sorted(([plain(r[i]) for i in at] for r in wanted.fetchall()), key=repr)


def test_line_packing_leaves_no_document_out(spark):
    texts = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").count()
    assert catalogue.QUERIES["line_pack_chunks"](spark, DATA).select("doc_id").distinct().count() == texts


def test_line_packing_of_all_equals_sql(spark, tmp_path):
    texts = ["", "short", "short\n", "a\nb\n\n", "x" * 1500, "y" * 1500 + "\n", "z " * 600 + "\n\n\n", "line of words\n" * 200, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in catalogue.QUERIES["line_pack_chunks"](spark, str(tmp_path)).collect()}
    assert got == set(con.sql(catalogue.ORACLES["line_pack_chunks"]).fetchall()) and {r[0] for r in got} == set(range(8))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_paths(spark):
    assert one(spark, paths.normalised(F.lit("a/./b/../c//d"))) == "a/c/d"
    assert one(spark, paths.normalised(F.lit("../a"))) == "../a"
    assert one(spark, paths.language(F.lit("x/Y.TSX"))) == "typescript"
    assert one(spark, paths.language(F.lit("x/.gitignore"))) is None
    assert one(spark, paths.is_ignored(F.lit("a/node_modules/b.js")))
    assert not one(spark, paths.is_ignored(F.lit("a/_b.py")))
    rules = paths.ignore_rules("*.log\n!keep.log\nbuild/\n/top.txt\na/**/z\n")
    verdict = lambda p: one(spark, paths.matches_rules(F.lit(p), rules))
    assert [verdict(p) for p in ("x/a.log", "keep.log", "q/build/x", "top.txt", "q/top.txt", "a/b/c/z")] == [True, False, True, True, False, True]


def test_text(spark):
    assert text.slug("Olá, Mundo_novo -- Já!") == "ola-mundo-novo-ja"
    assert one(spark, text.strip(F.lit(" \t x　"))) == "x"
    assert one(spark, text.tokens(F.lit("Snake_case É x"))) == ["snake_case", "é", "x"]


def test_refs(spark):
    found = one(spark, refs.encoded_refs(F.lit("# NOTE: hi\nDECISÃO 7, dec-7 [[a/B.md]] [[c.png]]\n// why: because")))
    assert found == ["cite:dec-007", "wikilink:b", "note:hi", "why:because"]
    assert one(spark, refs.decode_refs(F.lit("nonsense"))) == []


def test_search(spark):
    rows = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0]), (2, "beta", [0.0, 0.0]), (3, None, None), (4, "alpha", [0.6, 0.8])], "id int, t string, v array<double>")
    assert [r.id for r in search.knn(rows, "v", [1.0, 0.0], "id").collect()] == [1, 4]
    assert [r.id for r in search.bm25(rows, "t", ["alpha"], "id").collect()] == [4, 1]
    assert search.bm25(rows, "t", [], "id").count() == 0
    fused = search.hybrid(rows, text="t", vector="v", id_column="id", terms=["alpha"], query=[1.0, 0.0], limit=5).collect()
    assert [r.id for r in fused] == [1, 4] and fused[0].score == pytest.approx(1 / 60 + 1 / 61)


def test_chunking(spark):
    long = "\n\n".join("p" * n for n in (600, 500, 300, 1200))
    assert [len(c) for c in one(spark, chunking.paragraph_chunks(F.lit(long)))] == [600, 802, 1200]
    files = spark.createDataFrame([("docs/a.md", "start\n# One\nx\n## Two\ny\n")], "file_path string, content string")
    rows = chunking.markdown_sections(files).orderBy("start_line").collect()
    assert [(r.scope_name, r.start_line, r.end_line) for r in rows] == [("Intro", 1, 2), ("One", 2, 4), ("Two", 4, 6)]


@pytest.fixture(scope="module")
def built(spark):
    files = spark.createDataFrame([(p,) for p in ("pkg/a.py", "pkg/b.py", "docs/overview.md", "docs/dec-002-x.md")], "path string")
    chunks = spark.createDataFrame(
        [
            ("pkg/a.py", "run", "function", 1, 5, "python", "cut", ["cite:dec-002", "why:fast"]),
            ("pkg/b.py", "go", "function", 1, 2, "python", "pass", []),
            ("docs/overview.md", "Overview", "section", 1, 3, "markdown", "see [x](dec-002-x.md) and [[nothing]]", []),
            ("docs/dec-002-x.md", "Choice", "section", 1, 3, "markdown", "text", None),
        ],
        "file_path string, scope_name string, scope_type string, start_line int, end_line int, language string, content string, references array<string>",
    )
    imports = spark.createDataFrame([("pkg/a.py", "pkg.b"), ("pkg/a.py", "os")], "path string, raw_import string")
    return graph.build(files, chunks, imports)


def test_graph(built):
    nodes, edges = built
    assert nodes.count() == 9 and edges.count() == 8
    top = graph.hubs(nodes, edges, 2).collect()
    assert [(r.id, r.degree) for r in top] == [("file:docs/dec-002-x.md", 2), ("sym:pkg/a.py#run", 2)]
    way = graph.shortest_path(edges, "file:pkg/a.py", "file:docs/dec-002-x.md")
    assert [n for n, _ in way] == ["file:pkg/a.py", "sym:pkg/a.py#run", "file:docs/dec-002-x.md"]
    assert graph.shortest_path(edges, "file:pkg/b.py", "file:docs/overview.md", 1) == []
    assert [r.id for r in graph.resolve_node(nodes, "overview.md").collect()] == ["file:docs/overview.md"]
    assert len(graph.shortest_path(edges, "file:pkg/a.py", "file:pkg/a.py")) == 1


def test_notes_prefix(spark):
    keys = spark.createDataFrame([("dec-002",), ("dec-00",), ("none",)], "key string")
    docs = spark.createDataFrame([("d/DEC-002-x.md",), ("d/dec-003.md",)], "path string")
    found = {r.key: r.note_path for r in resolve.resolve_notes(keys, docs).collect()}
    assert found == {"dec-002": "d/DEC-002-x.md", "dec-00": None, "none": None}


def test_diff_full(spark):
    a = spark.createDataFrame([("x", 1.0, 1, None)], "path string, mtime double, size long, sha256 string")
    b = spark.createDataFrame([("x", 1.0, 1, "h"), ("y", 1.0, 1, "h")], a.schema)
    assert {r.path: r.status for r in summary.file_diff(a, b).collect()} == {"x": "unchanged", "y": "deleted"}
    assert {r.path: r.status for r in summary.file_diff(a, b, full=True).collect()} == {"x": "changed", "y": "deleted"}


def test_paragraph_lines_of_repeats(spark):
    body = "same\n\n" + "x" * 990 + "\n\nsame\n\n" + "y" * 995 + "\n\nsame"
    files = spark.createDataFrame([("d/t.txt", body)], "file_path string, content string")
    rows = chunking.explode_paragraphs(files).orderBy("start_line").collect()
    assert [(r.scope_name, r.start_line, r.end_line) for r in rows] == [("t_chunk_1", 1, 3), ("t_chunk_2", 5, 7), ("t_chunk_3", 9, 9)]
    nul = spark.createDataFrame([("d/a.md", "# One\nx\x00y\n# Two\nz")], "file_path string, content string")
    assert [r.scope_name for r in chunking.markdown_sections(nul).orderBy("start_line").collect()] == ["One", "Two"]


def test_streams_in_append_mode(spark, tmp_path):
    from textloom.streaming.ingest import drain, windowed_counts

    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-09 00:00:00", "b")]
    spark.createDataFrame(rows, "ts string, event_type string").selectExpr("cast(ts as timestamp) ts", "event_type").write.parquet(f"{tmp_path}/in")
    drain(spark, f"{tmp_path}/in", "*.parquet", f"{tmp_path}/check", windowed_counts, f"{tmp_path}/out", mode="append")
    assert [(r.event_type, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a", 2)]


def test_text_read_drops_bad_bytes(spark):
    rows = spark.createDataFrame([(bytearray(b"a\xff\xc3\xa9b"),), (None,)], "x binary")
    assert [r.t for r in rows.select(text.decode_text(F.col("x")).alias("t")).collect()] == ["a\u00e9b", None]
