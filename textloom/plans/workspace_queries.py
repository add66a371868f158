"""Queries of the operators that index a workspace, over files made from the tables' keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.paths import ignore_rules
from textloom.functions.refs import decode_refs, decoded_refs, encode_ref
from textloom.operators import chunking, code, enrich, graph, summary
from textloom.plans.registry import query, table
from textloom.sources import workspace

NONE = "array<string>"


def text_of(*parts) -> Column:
    """A text of strings and columns, one behind the other."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def keyed(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).cast("int").alias("k"))


PATHS = "CASE k % 7 WHEN 0 THEN 'src/a' || k || '.py' WHEN 1 THEN 'x/node_modules/b' || k || '.js' WHEN 2 THEN 'src/.hidden/c.py' WHEN 3 THEN 'doc/D' || k || '.MD' WHEN 4 THEN 'bin/e.exe' WHEN 5 THEN 'log/f' || k || '.txt' ELSE 'big/g.sql' END"
RULES = "*.txt\n!f1*.txt\n"


@query(f"""
WITH files AS (SELECT c_custkey AS k FROM customer), named AS (SELECT k, {PATHS} AS path, k * 40000 AS size FROM files)
SELECT k, path, CASE k % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'python' WHEN 3 THEN 'markdown' WHEN 5 THEN 'text' WHEN 6 THEN 'sql' END AS language,
  CASE WHEN k % 7 IN (1, 2) OR k % 7 = 5 AND NOT starts_with(path, 'log/f1') THEN 'ignored' WHEN k % 7 = 4 THEN 'unsupported' WHEN size > 2097152 THEN 'too big' END AS skipped
FROM named
""")
def scan_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files are eligible, and why others aren't."""
    k = F.col("k")
    path = F.when(k % 7 == 0, text_of("src/a", k, ".py")).when(k % 7 == 1, text_of("x/node_modules/b", k, ".js")).when(k % 7 == 2, F.lit("src/.hidden/c.py")).when(k % 7 == 3, text_of("doc/D", k, ".MD"))
    path = path.when(k % 7 == 4, F.lit("bin/e.exe")).when(k % 7 == 5, text_of("log/f", k, ".txt")).otherwise(F.lit("big/g.sql"))
    files = keyed(spark, sf_dir, "customer", "c_custkey").withColumns({"path": path, "size": k.cast("long") * 40000})
    return workspace.decided(files, ignore_rules(RULES)).select("k", "path", "language", "skipped")


@query("""
WITH d AS (SELECT c_custkey AS k FROM customer), long AS (SELECT repeat('a', 600) AS a, repeat('b', 600) AS b)
SELECT 'docs/' || k || '.md' AS file_path, 'Intro' AS scope_name, 'section' AS scope_type, 1 AS start_line, 2 AS end_line, sha256('intro ' || k) AS content_sha256 FROM d WHERE k % 3 <> 0
UNION ALL SELECT 'docs/' || k || '.md', 'One ' || k, 'section', 2, 6, sha256('# One ' || k || chr(10) || 'body' || chr(10) || chr(10) || 'more') FROM d WHERE k % 3 <> 0
UNION ALL SELECT 'docs/' || k || '.md', 'Two (Parte 1)', 'section', 6, 7, sha256('## Two' || chr(10) || a) FROM d, long WHERE k % 3 <> 0
UNION ALL SELECT 'docs/' || k || '.md', 'Two (Parte 2)', 'section', 9, 9, sha256(b) FROM d, long WHERE k % 3 <> 0
UNION ALL SELECT 'docs/' || k || '.md', CAST(k AS VARCHAR), 'chunk', 1, 3, sha256('plain ' || k || chr(10) || chr(10) || 'second') FROM d WHERE k % 3 = 0
""")
def markdown_section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, long ones in parts, and a file without headings."""
    k = F.col("k")
    headed = text_of("intro ", k, "\n# One ", k, "\nbody\n\nmore\n## Two\n", "a" * 600, "\n\n", "b" * 600, "\n")
    files = keyed(spark, sf_dir, "customer", "c_custkey").select(text_of("docs/", k, ".md").alias("file_path"), F.when(k % 3 == 0, text_of("plain ", k, "\n\nsecond")).otherwise(headed).alias("content"))
    return chunking.markdown_sections(files).withColumn("content_sha256", F.sha2("content", 256)).drop("content")


@query("""
WITH d AS (SELECT c_custkey AS k FROM customer)
SELECT 'p/m' || k || '.py' AS file_path, 'class' AS scope_type, 'C' || k AS scope_name, 1 AS start_line, 3 AS end_line, sha256('class C' || k || ':' || chr(10) || '    def run(self):' || chr(10) || '        pass') AS content_sha256 FROM d
UNION ALL SELECT 'p/m' || k || '.py', 'method', 'C' || k || '.run', 2, 3, sha256('    def run(self):' || chr(10) || '        pass') FROM d
UNION ALL SELECT 'p/m' || k || '.py', 'function', 'f', 6, 7, sha256('def f():' || chr(10) || '    return ' || k) FROM d
UNION ALL SELECT 'p/m' || k || '.js', 'class', 'A', 1, 5, sha256('class A {' || chr(10) || '  go(x) {' || chr(10) || '    return ' || k || ';' || chr(10) || '  }' || chr(10) || '}') FROM d
UNION ALL SELECT 'p/m' || k || '.js', 'method', 'A.go', 2, 4, sha256('  go(x) {' || chr(10) || '    return ' || k || ';' || chr(10) || '  }') FROM d
UNION ALL SELECT 'p/m' || k || '.rs', 'module', 'm' || k, 1, 2, sha256('fn main() {}' || chr(10)) FROM d
""")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of Python and script files, and a module for a language without a scanner."""
    k, d = F.col("k"), keyed(spark, sf_dir, "customer", "c_custkey")
    file = lambda end, language, *text: d.select(text_of("p/m", k, end).alias("path"), F.lit(language).alias("language"), text_of(*text).alias("content"))
    files = file(".py", "python", "class C", k, ":\n    def run(self):\n        pass\n\n\ndef f():\n    return ", k, "\n")
    files = files.unionAll(file(".js", "javascript", "class A {\n  go(x) {\n    return ", k, ";\n  }\n}\n")).unionAll(file(".rs", "rust", "fn main() {}\n"))
    return code.code_chunks(files).withColumn("content_sha256", F.sha2("content", 256)).drop("content", "language")


@query("""
WITH d AS (SELECT c_custkey AS k FROM customer)
SELECT 'p/m' || k || '.py' AS path, unnest(['os', 'a.b', '..x' || k, '.']) AS raw_import FROM d
UNION ALL SELECT 'p/m' || k || '.ts', unnest(['./m' || k, 'lib']) FROM d
""")
def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What Python and script files import; other languages import nothing."""
    k, d = F.col("k"), keyed(spark, sf_dir, "customer", "c_custkey")
    file = lambda end, language, *text: d.select(text_of("p/m", k, end).alias("path"), F.lit(language).alias("language"), text_of(*text).alias("content"))
    files = file(".py", "python", "import os, a.b as c\nimport os\nfrom ..x", k, " import y\nfrom . import z\n")
    files = files.unionAll(file(".ts", "typescript", "import q from './m", k, "';\nexport { r } from \"lib\";\n")).unionAll(file(".rs", "rust", "use a;\n"))
    return code.imports(files)


@query("""
WITH d AS (SELECT c_custkey AS k FROM customer)
SELECT 'q' || k || '.sql' AS file_path, 'table' AS scope_type, 't' || k AS scope_name, 1 AS start_line, 2 AS end_line FROM d
UNION ALL SELECT 'q' || k || '.sql', 'query', 'select_t' || k, 3, 3 FROM d
UNION ALL SELECT 'q' || k || '.sql', 'statement', 'statement_3', 4, 4 FROM d
UNION ALL SELECT 'q' || k || '.sql', 'view', 'v' || k, 5, 5 FROM d
""")
def sql_statement_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("k"), keyed(spark, sf_dir, "customer", "c_custkey")
    text = text_of("CREATE TABLE t", k, "\n  (a int);\nSELECT ';' FROM t", k, ";\nGRANT x TO y;\nCREATE OR REPLACE VIEW v", k, " AS SELECT 1;\n")
    return code.code_chunks(d.select(text_of("q", k, ".sql").alias("path"), F.lit("sql").alias("language"), text.alias("content"))).drop("content", "language")


def small_index(spark: SparkSession, sf_dir: str, older: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, chunks and imports: a module for each nation, which cites a decision, shares a
    note with others and imports the next module, and a document for every second one.
    `older`: as it was before some modules changed."""
    k, d = F.col("k"), keyed(spark, sf_dir, "nation", "n_nationkey")
    was = (k % 4 == 1) if older else F.lit(False)
    module, note = text_of("pkg/m", k, ".py"), F.format_string("docs/dec-%03d-note.md", k)
    even = d.where("k % 2 = 0")
    files = d.select(module.alias("path")).unionAll(even.select(note.alias("path")))
    refs = F.when(was, F.array(F.lit("why:old reasons"))).otherwise(F.array(F.format_string("cite:dec-%03d", k), text_of("note:shared ", k % 3), text_of("cite:adr-", k)))
    unit = lambda path, name, kind, language, content, references: (path.alias("file_path"), F.lit(name).alias("scope_name"), F.lit(kind).alias("scope_type"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit(language).alias("language"), content.alias("content"), references.alias("references"))
    chunks = d.select(*unit(module, "run", "function", "python", F.lit("cut"), refs))
    link = F.format_string("[x](dec-%03d-note.md) [y](none.md) [[dec-%03d-note]]", (k + 2) % 24, (k + 4) % 24)
    chunks = chunks.unionAll(even.select(*unit(note, "Top", "section", "markdown", link, F.array().cast(NONE))))
    imports = d.select(module.alias("path"), F.when(was, F.lit("pkg.m0")).otherwise(text_of("pkg.m", (k + 1) % 25)).alias("raw_import"))
    return files, chunks, imports.unionAll(d.select(module, F.lit("os")))


GRAPH_SQL = """
d AS (SELECT n_nationkey AS k, 'pkg/m' || n_nationkey || '.py' AS module, 'docs/dec-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '-note.md' AS note FROM nation),
edges AS (
  SELECT 'file:' || module AS source, 'sym:' || module || '#run' AS target, 'contains' AS kind FROM d
  UNION SELECT 'file:' || note, 'sec:' || note || '#Top', 'contains' FROM d WHERE k % 2 = 0
  UNION SELECT 'sym:' || module || '#run', 'rat:' || substr(sha1('note:shared ' || (k % 3)), 1, 12), 'annotates' FROM d
  UNION SELECT 'sym:' || module || '#run', 'file:' || note, 'cites' FROM d WHERE k % 2 = 0
  UNION SELECT 'sec:' || a.note || '#Top', 'file:' || b.note, 'links_to' FROM d a JOIN d b ON a.k % 2 = 0 AND b.k IN ((a.k + 2) % 24, (a.k + 4) % 24)
  UNION SELECT 'file:' || a.module, 'file:' || b.module, 'imports' FROM d a JOIN d b ON b.k = (a.k + 1) % 25)
"""


@query(f"WITH {GRAPH_SQL} SELECT source, target, kind FROM edges")
def graph_build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(*small_index(spark, sf_dir))[1]


@query(f"""
WITH {GRAPH_SQL},
nodes AS (
  SELECT 'file:' || module AS id, 'file' AS kind, 'm' || k || '.py' AS label, module AS file_path FROM d
  UNION ALL SELECT 'file:' || note, 'doc', substr(note, 6), note FROM d WHERE k % 2 = 0
  UNION ALL SELECT 'sym:' || module || '#run', 'symbol', 'run', module FROM d
  UNION ALL SELECT 'sec:' || note || '#Top', 'section', 'Top', note FROM d WHERE k % 2 = 0
  UNION ALL SELECT 'rat:' || substr(sha1('note:shared ' || (k % 3)), 1, 12), 'rationale', 'shared ' || (k % 3), min(module) FROM d GROUP BY k % 3),
ends AS (SELECT source AS e FROM edges WHERE kind <> 'contains' UNION ALL SELECT target FROM edges WHERE kind <> 'contains')
SELECT id, kind, label, file_path, count(e) AS degree FROM nodes LEFT JOIN ends ON e = id GROUP BY 1, 2, 3, 4
""")
def graph_build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*graph.build(*small_index(spark, sf_dir))).select("id", "kind", "label", "file_path", "degree")


@query(f"WITH {GRAPH_SQL} SELECT source, target, kind FROM edges")
def graph_incremental_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as it was, brought up to date for the modules that changed."""
    nodes, edges = graph.build(*small_index(spark, sf_dir, older=True))
    changed = keyed(spark, sf_dir, "nation", "n_nationkey").where("k % 4 = 1").select(text_of("pkg/m", F.col("k"), ".py").alias("path"))
    return graph.updated(nodes, edges, *small_index(spark, sf_dir), changed)[1]


@query("""
WITH d AS (SELECT n_nationkey AS k, 'src/r' || n_regionkey || '/' || lower(n_name) || '.py' AS path, n_name FROM nation)
SELECT path AS entry, '' AS name, path AS line FROM d
UNION ALL SELECT path, n_name, '  ' || CASE k % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'func' WHEN 2 THEN 'method' END || ' ' || n_name FROM d WHERE k % 4 <> 3
UNION ALL SELECT 'totals', '', (SELECT count(*) FROM d) || ' ' || (SELECT count(*) FROM d WHERE k % 4 <> 3)
""")
def map_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's lines in order (an entry, then its symbols; modules aren't listed), and totals."""
    nation, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    kind = F.when(k % 4 == 0, "class").when(k % 4 == 1, "function").when(k % 4 == 2, "method").otherwise("module")
    symbols = nation.select(text_of("src/r", F.col("n_regionkey"), "/", F.lower("n_name"), ".py").alias("file_path"), kind.alias("scope_type"), F.col("n_name").alias("scope_name"))
    totals = summary.map_totals(symbols, 2).select(F.lit("totals").alias("entry"), F.lit("").alias("name"), F.concat_ws(" ", "total_files", "total_symbols").alias("line"))
    return summary.map_lines(symbols, 2).unionByName(totals)


LINKED = "f AS (SELECT n_nationkey AS k FROM nation)"


@query(f"""
WITH {LINKED}
SELECT k, 0 AS n, 'docs/b' || k || '.md' AS file_path, 'part-' || k AS anchor, CASE WHEN k % 2 = 0 THEN 'Part ' || k END AS resolved_section, CAST(NULL AS VARCHAR) AS alias, '' AS candidates FROM f
UNION ALL SELECT k, 1, CASE WHEN k % 3 = 0 THEN 'notes/only-0.md' END, NULL, NULL, 'see', CASE WHEN k % 3 = 1 THEN 'notes/only-1.md,old/only-1.md' ELSE '' END FROM f
""")
def search_markdown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of Markdown hits: to sections by anchor, and wikilinks with one, two or no document."""
    k, d = F.col("k"), keyed(spark, sf_dir, "nation", "n_nationkey")
    content = text_of("see [l](b", k, ".md#part-", k, ") and [[Only-", k % 3, "|see]]")
    hits = d.select("k", F.lit("markdown").alias("language"), text_of("docs/a", k, ".md").alias("file_path"), content.alias("content"))
    fixed = spark.createDataFrame([("notes/only-0.md",), ("notes/only-1.md",), ("old/only-1.md",)], "path string")
    files = d.select(text_of("docs/b", k, ".md").alias("path")).unionAll(fixed)
    sections = d.where("k % 2 = 0").select(text_of("docs/b", k, ".md").alias("file_path"), text_of("Part ", k).alias("scope_name"), F.lit(1).alias("start_line"))
    return enrich.markdown_references(hits, files, sections, "k").withColumn("candidates", F.array_join("candidates", ","))


@query(f"""
WITH {LINKED}
SELECT k, 0 AS n, 'cite' AS kind, 'dec-' || (k % 3) AS key, CAST(NULL AS VARCHAR) AS text, CASE WHEN k % 3 = 0 THEN 'docs/dec-0-x.md' END AS note_path, CASE WHEN k % 3 = 1 THEN 'docs/dec-1-x.md,docs/dec-1-y.md' ELSE '' END AS candidates FROM f
UNION ALL SELECT k, 1, 'annotation', 'why', 'because: ' || k, NULL, '' FROM f
""")
def search_code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of code hits with one, two or no document, and annotations."""
    k, d = F.col("k"), keyed(spark, sf_dir, "nation", "n_nationkey")
    hits = d.select("k", F.lit("python").alias("language"), F.array(text_of("cite:dec-", k % 3), text_of("why:because: ", k), F.lit("nonsense")).alias("references"))
    files = spark.createDataFrame([("docs/dec-0-x.md",), ("docs/dec-1-x.md",), ("docs/dec-1-y.md",), ("src/dec-2.py",)], "path string")
    return enrich.code_references(hits, files, "k").withColumn("candidates", F.array_join("candidates", ","))


@query(f"""
WITH {LINKED}
SELECT k, 'cite' AS kind, 'adr-' || k AS key, CAST(NULL AS VARCHAR) AS text, 'cite:adr-' || k AS encoded FROM f WHERE k % 3 <> 0
UNION ALL SELECT k, 'annotation', 'note', 'a "b": ' || k, 'note:a "b": ' || k FROM f WHERE k % 3 <> 0
""")
def reference_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored JSON lists of references decoded and encoded again; bad JSON has none."""
    k, d = F.col("k"), keyed(spark, sf_dir, "nation", "n_nationkey")
    stored = F.when(k % 3 == 0, F.lit("{not a list")).otherwise(text_of('["cite:adr-', k, '", "note:a \\"b\\": ', k, '"]'))
    refs = d.select("k", F.explode(decoded_refs(decode_refs(stored))).alias("r"))
    return refs.select("k", "r.*", encode_ref(F.col("r")).alias("encoded"))
