"""All queries of the core engine and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.refs import markdown_links, rationale_refs
from textloom.functions.text import ASCII_TOKEN, slugify
from textloom.operators import chunking, graph, resolve, search, summary
from textloom.plans import workspace_queries  # noqa: F401  registers its queries
from textloom.plans.registry import ORACLES, QUERIES, query, table  # noqa: F401
from textloom.shared import shared_path, written
from textloom.streaming.ingest import drain, windowed_counts

FLAGSHIP = "hybrid_rrf"

#: The query of the search examples: terms and the vector of the first row.
TERMS = ["the", "tion", "ing", "cióna"]


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: one row's."""
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding)


VECTOR_SQL = """
scored AS (
  SELECT vec_id, label,
         list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
         / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)))) AS score
  FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0))
"""


@query(f"WITH {VECTOR_SQL} SELECT vec_id, round(score, 9) AS score FROM scored WHERE score IS NOT NULL ORDER BY score DESC, vec_id LIMIT 50")
def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.knn(table(spark, sf_dir, "embeddings"), "embedding", first_vector(spark, sf_dir), "vec_id")
    return found.select("vec_id", F.round("score", 9).alias("score"))


@query(f"WITH {VECTOR_SQL} SELECT vec_id, label, round(score, 9) AS score FROM scored WHERE score IS NOT NULL AND label = 3 ORDER BY score DESC, vec_id LIMIT 50")
def knn_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.knn(table(spark, sf_dir, "embeddings"), "embedding", first_vector(spark, sf_dir), "vec_id", where=F.col("label") == 3)
    return found.select("vec_id", "label", F.round("score", 9).alias("score"))


_TERMS_SQL = ", ".join(f"('{t}')" for t in sorted(set(TERMS)))
BM25_SQL = f"""
words AS (SELECT doc_id, lang, source, regexp_extract_all(lower(coalesce(text, '')), '{ASCII_TOKEN}') AS w FROM documents),
terms(t) AS (VALUES {_TERMS_SQL}),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(w)::DOUBLE) AS avgdl FROM words),
dfs AS (SELECT t, count(*) FILTER (list_contains(w, t))::DOUBLE AS df FROM words, terms GROUP BY t),
parts AS (
  SELECT doc_id, lang, source, len(w)::DOUBLE AS dl, t, len(list_filter(w, lambda x: x = t))::DOUBLE AS tf FROM words, terms),
bm AS (
  SELECT doc_id, lang, source,
         sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM parts JOIN dfs USING (t), stats WHERE tf > 0 GROUP BY doc_id, lang, source)
"""


@query(f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", TERMS, "doc_id", pattern=ASCII_TOKEN)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM bm WHERE lang = 'es' AND starts_with(source, 'src1') ORDER BY bm.score DESC, doc_id LIMIT 50")
def bm25_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    where = (F.col("lang") == "es") & F.col("source").startswith("src1")
    found = search.bm25(docs, "text", TERMS, "doc_id", where=where, pattern=ASCII_TOKEN)
    return found.select("doc_id", F.round("score", 6).alias("score"))


def text_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings of documents and their statistics, as tables."""
    return written(search.postings(docs, "text", "doc_id", pattern=ASCII_TOKEN), "postings"), written(search.text_stats(docs, "text", ASCII_TOKEN), "text-stats")


@query(f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 50")
def bm25_postings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_topk, from a text index: its making is part of the query."""
    found = search.bm25_indexed(*text_index(table(spark, sf_dir, "documents").select("doc_id", "text")), TERMS, "doc_id")
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM bm WHERE lang = 'es' AND starts_with(source, 'src1') ORDER BY bm.score DESC, doc_id LIMIT 50")
def bm25_postings_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    allowed = docs.where((F.col("lang") == "es") & F.col("source").startswith("src1"))
    found = search.bm25_indexed(*text_index(docs.select("doc_id", "text")), TERMS, "doc_id", allowed=allowed)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(f"""
WITH {BM25_SQL}, {VECTOR_SQL},
rows_in AS (SELECT doc_id FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang = 'en'),
arm1 AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS r FROM scored JOIN rows_in ON doc_id = vec_id QUALIFY r < 50),
arm2 AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM bm JOIN rows_in USING (doc_id) QUALIFY r < 50)
SELECT doc_id, round(sum(1.0::DOUBLE / (r + 60)), 9) AS score FROM (SELECT * FROM arm1 UNION ALL SELECT * FROM arm2) GROUP BY doc_id
ORDER BY sum(1.0::DOUBLE / (r + 60)) DESC, doc_id LIMIT 20
""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms among documents that have a vector and are English; BM25 statistics are
    those of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    wanted = F.col("lang") == "en"
    arm1 = search.knn(vectors.join(docs.where(wanted).select("doc_id"), "doc_id", "left_semi"), "embedding", first_vector(spark, sf_dir), "doc_id")
    with_vector = docs.join(vectors.select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    arm2 = search.bm25(with_vector, "text", TERMS, "doc_id", where=wanted & F.col("has"), pattern=ASCII_TOKEN)
    found = search.rrf([arm1.select("doc_id", "score"), arm2.select("doc_id", "score")], "doc_id", 20)
    return found.select("doc_id", F.round("score", 9).alias("score"))


def as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the files of a workspace."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("file_path"), F.col("source").alias("repo"), F.col("lang").alias("language"), F.coalesce("text", F.lit("")).alias("content"))


FILES_SQL = "files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS file_path, source AS repo, lang AS language, coalesce(text, '') AS content FROM documents)"


@query(f"WITH {FILES_SQL} SELECT doc_id, file_path FROM files WHERE starts_with(file_path, 'src1/e') AND language = 'es'")
def path_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = search.predicate(language="es", path_prefix="src1\\e")
    return as_files(spark, sf_dir).where(where).select("doc_id", "file_path")


@query(f"WITH {FILES_SQL} SELECT count(*) AS total_chunks, array_to_string(list_sort(list(DISTINCT repo)), ',') AS repos, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages FROM files")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.status(as_files(spark, sf_dir)).select("total_chunks", F.array_join("repos", ",").alias("repos"), F.array_join("languages", ",").alias("languages"))


@query("""
WITH paths AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages),
parts AS (SELECT p, string_split(p, '/') AS x FROM paths)
SELECT CASE WHEN len(x) > 2 THEN x[1] || '/...' ELSE p END AS entry, CAST(sum(CASE WHEN len(x) > 2 THEN 0 ELSE 1 END) AS BIGINT) AS n_symbols, count(DISTINCT p) AS n_files
FROM parts GROUP BY 1
""")
def symbol_map_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    symbols = pages.select(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("file_path"), F.lit("page").alias("scope_type"), F.col("page_id").cast("string").alias("scope_name"))
    return summary.symbol_map(symbols, max_depth=1)


@query(f"""
WITH {FILES_SQL}, counts AS (SELECT repo AS path, count(*) AS eligible_files FROM files GROUP BY 1)
SELECT path, eligible_files, path IN (SELECT path FROM counts WHERE eligible_files > 1 AND (SELECT sum(eligible_files) FROM counts) > 200 ORDER BY eligible_files DESC, path LIMIT 3) AS recommended FROM counts
""")
def dry_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = summary.dry_run(as_files(spark, sf_dir).select(F.col("file_path").alias("path")))
    first = summary.recommended(counts).select("path", F.lit(True).alias("first"))
    return counts.join(F.broadcast(first), "path", "left").select("path", "eligible_files", F.coalesce("first", F.lit(False)).alias("recommended"))


PACK_SQL = """
WITH RECURSIVE {source},
run AS (
  SELECT id, 1 AS i, parts[1] AS cur, length(parts[1]) + {between} AS size, 0 AS n, parts, CAST(NULL AS VARCHAR) AS done FROM src WHERE len(parts) > 0
  UNION ALL
  SELECT id, i + 1,
         CASE WHEN size + length(parts[i + 1]) > 1000 THEN parts[i + 1] ELSE cur || '{joint}' || parts[i + 1] END,
         CASE WHEN size + length(parts[i + 1]) > 1000 THEN length(parts[i + 1]) ELSE size + length(parts[i + 1]) + {between} END,
         CASE WHEN size + length(parts[i + 1]) > 1000 THEN n + 1 ELSE n END, parts,
         CASE WHEN size + length(parts[i + 1]) > 1000 THEN cur END
  FROM run WHERE i < len(parts)),
chunks AS (
  SELECT id, n - 1 AS n, done AS chunk FROM run WHERE done IS NOT NULL
  UNION ALL SELECT id, n, cur FROM run WHERE i = len(parts))
"""

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LINES_SQL = PACK_SQL.format(
    source="cut AS (SELECT doc_id AS id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i < len(string_split(text, chr(10))) THEN x || chr(10) ELSE x END), lambda x: x <> '') AS parts FROM documents WHERE text IS NOT NULL), src AS (SELECT id, parts FROM cut WHERE length(text) > 1000 AND len(parts) > 1)",
    between=0,
    joint="",
)


@query(f"""
{LINES_SQL},
one AS (SELECT id, text, string_split_regex(regexp_replace(text, '({LINE_END})$', ''), '{LINE_END}') AS x FROM cut WHERE length(text) <= 1000 OR len(parts) <= 1),
found AS (
  SELECT id, n, rtrim(chunk, chr(10)) AS chunk FROM chunks
  UNION ALL
  SELECT id, 0, CASE WHEN length(text) > 1000 AND len(x) > 10 THEN array_to_string(list_concat(x[1:7], ['{chunking.CUT_MARK}'], x[-3:]), chr(10)) ELSE text END FROM one)
SELECT id AS doc_id, CAST(n AS INTEGER) AS n, sha256(chunk) AS chunk_sha256, length(chunk) AS n_chars FROM found
""")
def line_pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: also short ones and those of a single line."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.line_chunks(F.col("text"))).alias("n", "chunk"))
    return chunks.select("doc_id", "n", F.sha2("chunk", 256).alias("chunk_sha256"), F.length("chunk").cast("long").alias("n_chars"))


PARAGRAPHS_SQL = PACK_SQL.format(
    source="src AS (SELECT conv_id AS id, list_filter(list(trim(text, ' ' || chr(9) || chr(10) || chr(13)) ORDER BY turn), lambda x: x <> '') AS parts FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)",
    between=2,
    joint="' || chr(10) || chr(10) || '",
)


@query(f"{PARAGRAPHS_SQL} SELECT id AS conv_id, CAST(n AS INTEGER) AS n, sha256(chunk) AS chunk_sha256 FROM chunks")
def paragraph_pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n\n").alias("content"))
    chunks = whole.select("conv_id", F.posexplode(chunking.paragraph_chunks(F.col("content"))).alias("n", "chunk"))
    return chunks.select("conv_id", "n", F.sha2("chunk", 256).alias("chunk_sha256"))


@query(f"""
WITH l AS (SELECT doc_id, text, string_split(rtrim(text, chr(10)), chr(10)) AS x FROM documents)
SELECT doc_id, CASE WHEN length(text) > 1000 AND len(x) > 10
  THEN sha256(array_to_string(list_concat(x[1:7], ['{chunking.CUT_MARK}'], x[-3:]), chr(10))) ELSE sha256(text) END AS content_sha256 FROM l
""")
def truncate_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(chunking.truncated(F.col("text")), 256).alias("content_sha256"))


@query(f"WITH {FILES_SQL} SELECT doc_id, substr(sha256(content || file_path || '1-' || (1 + length(content) - length(replace(content, chr(10), '')))), 1, 16) AS chunk_id FROM files")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.functions.text import count_of

    files = as_files(spark, sf_dir)
    last = F.lit(1) + count_of(F.col("content"), "\n")
    return files.select("doc_id", chunking.chunk_id(F.col("content"), F.col("file_path"), F.lit(1), last).alias("chunk_id"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The files now, and an older list without some of them and with others changed."""
    files = as_files(spark, sf_dir).select("doc_id", F.col("file_path").alias("path"), (F.col("doc_id") % 5).cast("double").alias("mtime"), F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"))
    now = files.where("doc_id % 7 <> 3")
    was = files.where("doc_id % 11 <> 4").withColumns({
        "mtime": F.when(F.col("doc_id") % 3 == 0, F.col("mtime")).otherwise(F.col("mtime") - 1),
        "sha256": F.when(F.col("doc_id") % 13 == 5, F.lit("0")).otherwise(F.col("sha256")),
    })
    return now, was


VERSIONS_SQL = f"""
{FILES_SQL}, base AS (SELECT doc_id, file_path AS path, doc_id % 5 AS mtime, length(content) AS size, sha256(content) AS sha FROM files),
now AS (SELECT * FROM base WHERE doc_id % 7 <> 3),
was AS (SELECT doc_id, path, CASE WHEN doc_id % 3 = 0 THEN mtime ELSE mtime - 1 END AS mtime, size, CASE WHEN doc_id % 13 = 5 THEN '0' ELSE sha END AS sha FROM base WHERE doc_id % 11 <> 4),
diff AS (
  SELECT coalesce(n.path, w.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN w.path IS NULL THEN 'new'
         WHEN n.mtime = w.mtime AND n.size = w.size THEN 'unchanged' WHEN n.sha = w.sha THEN 'touched' ELSE 'changed' END AS status
  FROM now n FULL JOIN was w ON n.path = w.path)
"""


@query(f"WITH {VERSIONS_SQL} SELECT path, status FROM diff")
def file_diff_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.file_diff(*_versions(spark, sf_dir))


@query(f"WITH {VERSIONS_SQL} SELECT path AS file_path, sha AS sha256 FROM was WHERE path NOT IN (SELECT path FROM diff WHERE status IN ('deleted', 'changed')) UNION ALL SELECT path, sha FROM now WHERE path IN (SELECT path FROM diff WHERE status IN ('new', 'changed'))")
def delete_append_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, was = _versions(spark, sf_dir)
    diff = summary.file_diff(now, was)
    old = was.select(F.col("path").alias("file_path"), "sha256")
    added = now.join(diff.where("status in ('new', 'changed')"), "path", "left_semi").select(F.col("path").alias("file_path"), "sha256")
    return summary.replaced(old, diff.where("status in ('deleted', 'changed')"), added)


def _with_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with references in front that depend on their id."""
    n = F.col("doc_id").cast("string")
    head = F.concat_ws(
        "", F.lit("# see DECISÃO-"), (F.col("doc_id") % 30).cast("string"), F.lit(" and adr_"), (F.col("doc_id") % 7).cast("string"), F.lit("\n# WHY: because of "), n,
        F.lit("\n// see [[notes/Guide-"), (F.col("doc_id") % 4).cast("string"), F.lit(".md]] [[image.png]]\n"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("content"))


@query("""
SELECT doc_id, 'cite' AS kind, 'dec-' || lpad(CAST(doc_id % 30 AS VARCHAR), 3, '0') AS key, CAST(NULL AS VARCHAR) AS text FROM documents
UNION ALL SELECT doc_id, 'cite', 'adr-' || lpad(CAST(doc_id % 7 AS VARCHAR), 3, '0'), NULL FROM documents
UNION ALL SELECT doc_id, 'annotation', 'why', 'because of ' || doc_id FROM documents
UNION ALL SELECT doc_id, 'wikilink', 'guide-' || (doc_id % 4), NULL FROM documents
""")
def rationale_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _with_refs(spark, sf_dir).select("doc_id", F.explode(rationale_refs(F.col("content"))).alias("r"))
    return refs.select("doc_id", "r.kind", "r.key", "r.text")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    name = F.concat_ws("", F.lit("docs/Dec-"), F.format_string("%03d", F.col("n_nationkey")), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("-"), F.col("n_name"))).otherwise(F.lit("")), F.lit(".md"))
    return nation.select(name.alias("path")).unionAll(nation.where("n_nationkey % 4 = 0").select(F.format_string("old/dec-%03d-copy.md", F.col("n_nationkey"))))


@query("""
WITH notes AS (
  SELECT 'docs/Dec-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || CASE WHEN n_nationkey % 2 = 0 THEN '-' || n_name ELSE '' END || '.md' AS path FROM nation
  UNION ALL SELECT 'old/dec-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '-copy.md' FROM nation WHERE n_nationkey % 4 = 0),
stems AS (SELECT path, lower(regexp_extract(path, '([^/]+)[.]md$', 1)) AS stem FROM notes),
refs AS (SELECT doc_id, 'dec-' || lpad(CAST(doc_id % 30 AS VARCHAR), 3, '0') AS key FROM documents),
exact AS (SELECT key, list_sort(list(path)) AS p FROM (SELECT DISTINCT key FROM refs) JOIN stems ON stem = key GROUP BY key),
longer AS (SELECT key, list_sort(list(path)) AS p FROM (SELECT DISTINCT key FROM refs) JOIN stems ON starts_with(stem, key || '-') GROUP BY key)
SELECT doc_id, r.key, CASE WHEN len(coalesce(e.p, l.p)) = 1 THEN coalesce(e.p, l.p)[1] END AS note_path,
       CASE WHEN len(coalesce(e.p, l.p)) > 1 THEN array_to_string(coalesce(e.p, l.p), ',') ELSE '' END AS candidates
FROM refs r LEFT JOIN exact e ON r.key = e.key LEFT JOIN longer l ON r.key = l.key
""")
def note_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _with_refs(spark, sf_dir).select("doc_id", F.explode(rationale_refs(F.col("content"))).alias("r")).where("r.kind = 'cite' and r.key like 'dec-%'")
    found = resolve.resolve_notes(refs.select("doc_id", F.col("r.key").alias("key")), _notes(spark, sf_dir))
    return found.select("doc_id", "key", "note_path", F.array_join("candidates", ",").alias("candidates"))


@query("""
SELECT doc_id, 'guide/' || source || '.md' AS target, CAST(NULL AS VARCHAR) AS stem, 'top' AS anchor, CAST(NULL AS VARCHAR) AS alias FROM documents
UNION ALL SELECT doc_id, NULL, 'note-' || (doc_id % 9), 'Part One', 'see' FROM documents
UNION ALL SELECT doc_id, 'docs/sub/x' || (doc_id % 3) || '.md', NULL, NULL, NULL FROM documents
""")
def markdown_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat_ws(
        "", F.lit("[a](../guide/"), F.col("source"), F.lit(".md#top) [b](https://x.org/y.md) [c](#here) ![d](pic.png) [[Note-"), (F.col("doc_id") % 9).cast("string"),
        F.lit("#Part One|see]] [[./sub/x"), (F.col("doc_id") % 3).cast("string"), F.lit("]] [[#pure]] [[file.txt]] [a](../guide/"), F.col("source"), F.lit(".md#top)"),
    )
    links = table(spark, sf_dir, "documents").select("doc_id", F.explode(markdown_links(body, F.lit("docs/index.md"))).alias("l"))
    return links.select("doc_id", "l.target", "l.stem", "l.anchor", "l.alias")


@query("""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(line)), '[ \t_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '-') AS slug
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS line FROM documents)
""")
def heading_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", slugify(F.split(F.coalesce("text", F.lit("")), "\n")[0]).alias("slug"))


@query("""
WITH sections AS (SELECT 'f' || n_regionkey || '.md' AS file_path, 'The ' || upper(substr(n_name, 1, 1)) || ' Part' AS scope_name, n_nationkey AS start_line FROM nation),
first AS (SELECT file_path, lower(replace(scope_name, ' ', '-')) AS slug, arg_min(scope_name, start_line) AS section FROM sections GROUP BY 1, 2)
SELECT c_custkey, l.file_path, anchor, section
FROM (SELECT c_custkey, 'f' || (c_custkey % 6) || '.md' AS file_path, 'the_' || lower(substr(c_mktsegment, 1, 1)) || ' part!' AS anchor FROM customer) l
LEFT JOIN first f ON l.file_path = f.file_path AND replace(replace(replace(anchor, '_', '-'), ' ', '-'), '!', '') = slug
""")
def anchor_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    sections = nation.select(F.format_string("f%d.md", F.col("n_regionkey")).alias("file_path"), F.concat_ws(" ", F.lit("The"), F.upper(F.substring("n_name", 1, 1)), F.lit("Part")).alias("scope_name"), F.col("n_nationkey").alias("start_line"))
    links = customer.select("c_custkey", F.format_string("f%d.md", F.col("c_custkey") % 6).alias("file_path"), F.concat(F.lit("the_"), F.lower(F.substring("c_mktsegment", 1, 1)), F.lit(" part!")).alias("anchor"))
    return resolve.resolve_anchors(links, sections)


@query("""
WITH files AS (SELECT 'pkg/' || lower(replace(n_name, ' ', '_')) || '.py' AS path FROM nation UNION ALL SELECT 'pkg/sub/__init__.py' UNION ALL SELECT 'web/a.tsx' UNION ALL SELECT 'web/lib/index.ts'),
imports AS (
  SELECT 'pkg/sub/m' || c_custkey || '.py' AS path, '..' || lower(replace(n_name, ' ', '_')) AS raw_import, 'pkg/' || lower(replace(n_name, ' ', '_')) || '.py' AS resolved FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'pkg/sub/m' || c_custkey || '.py', 'pkg.sub.thing', 'pkg/sub/__init__.py' FROM customer
  UNION ALL SELECT 'pkg/sub/m' || c_custkey || '.py', 'os.path', NULL FROM customer
  UNION ALL SELECT 'web/c' || c_custkey || '.ts', CASE WHEN c_custkey % 2 = 0 THEN './a' ELSE './lib' END, CASE WHEN c_custkey % 2 = 0 THEN 'web/a.tsx' ELSE 'web/lib/index.ts' END FROM customer)
SELECT path, raw_import, resolved FROM imports WHERE resolved IN (SELECT path FROM files)
""")
def import_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    module = F.lower(F.replace(F.col("n_name"), F.lit(" "), F.lit("_")))
    fixed = spark.createDataFrame([("pkg/sub/__init__.py",), ("web/a.tsx",), ("web/lib/index.ts",)], "path string")
    files = nation.select(F.concat(F.lit("pkg/"), module, F.lit(".py")).alias("path")).unionAll(fixed)
    python = F.format_string("pkg/sub/m%d.py", F.col("c_custkey")).alias("path")
    imports = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(python, F.concat(F.lit(".."), module).alias("raw_import"))
    for raw in ("pkg.sub.thing", "os.path"):
        imports = imports.unionAll(customer.select(python, F.lit(raw)))
    imports = imports.unionAll(customer.select(F.format_string("web/c%d.ts", F.col("c_custkey")), F.when(F.col("c_custkey") % 2 == 0, "./a").otherwise("./lib")))
    return resolve.import_edges(imports, files)


HREF = 'href="([^"#?]+)'


def page_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages and what they link to: a node per URL, an edge per distinct link."""
    pages = table(spark, sf_dir, "pages")
    edges = pages.select(F.col("url").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1)))).alias("target"), F.lit("links_to").alias("kind"))
    edges = edges.where("source <> target").dropDuplicates(["source", "target", "kind"])
    outer = edges.select(F.col("target").alias("id")).join(pages.select(F.col("url").alias("id")), "id", "left_anti").distinct()
    nodes = pages.select(F.col("url").alias("id")).distinct().withColumn("kind", F.lit("page")).unionAll(outer.withColumn("kind", F.lit("target")))
    return nodes.withColumns({"label": F.element_at(F.split("id", "/"), -1), "file_path": F.col("id")}), edges


PAGES_SQL = f"""
edges AS (SELECT DISTINCT url AS source, unnest(regexp_extract_all(coalesce(html, ''), '{HREF}', 1)) AS target, 'links_to' AS kind FROM pages),
real_edges AS (SELECT * FROM edges WHERE source <> target),
nodes AS (SELECT DISTINCT url AS id, 'page' AS kind FROM pages UNION ALL SELECT DISTINCT target, 'target' FROM real_edges WHERE target NOT IN (SELECT url FROM pages)),
deg AS (SELECT id, kind, count(e) AS degree FROM nodes LEFT JOIN (SELECT source AS e FROM real_edges UNION ALL SELECT target FROM real_edges) ON e = id GROUP BY 1, 2)
"""


@query(f"WITH {PAGES_SQL} SELECT source, target, kind FROM real_edges")
def html_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_graph(spark, sf_dir)[1]


@query(f"WITH {PAGES_SQL} SELECT id, kind, degree FROM deg")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*page_graph(spark, sf_dir)).select("id", "kind", "degree")


@query(f"WITH {PAGES_SQL} SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 30")
def graph_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs(*page_graph(spark, sf_dir), 30).select("id", "degree")


@query(f"WITH {PAGES_SQL} SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def graph_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.kind_counts(page_graph(spark, sf_dir)[0])


def entity_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions contain nations; customers and suppliers cite theirs."""
    region, nation, customer, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    node = lambda df, tag, key, kind, label: df.select(F.concat(F.lit(f"{tag}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"), F.concat(F.lit(f"{kind}/"), F.col(label)).alias("file_path"))
    edge = lambda df, tag, key, other, to, kind: df.select(F.concat(F.lit(f"{tag}:"), F.col(key).cast("string")).alias("source"), F.concat(F.lit(f"{other}:"), F.col(to).cast("string")).alias("target"), F.lit(kind).alias("kind"))
    nodes = node(region, "r", "r_regionkey", "doc", "r_name").unionAll(node(nation, "n", "n_nationkey", "file", "n_name")).unionAll(node(customer, "c", "c_custkey", "symbol", "c_name")).unionAll(node(supplier, "s", "s_suppkey", "section", "s_name"))
    edges = edge(nation, "r", "n_regionkey", "n", "n_nationkey", "contains").unionAll(edge(customer, "c", "c_custkey", "n", "c_nationkey", "cites")).unionAll(edge(supplier, "s", "s_suppkey", "n", "s_nationkey", "links_to"))
    return nodes, edges


ENTITY_SQL = """
nodes AS (
  SELECT 'r:' || r_regionkey AS id, 'doc' AS kind, r_name AS label, 'doc/' || r_name AS file_path FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'file', n_name, 'file/' || n_name FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'symbol', c_name, 'symbol/' || c_name FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'section', s_name, 'section/' || s_name FROM supplier),
edges AS (
  SELECT 'r:' || n_regionkey AS source, 'n:' || n_nationkey AS target, 'contains' AS kind FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'cites' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'links_to' FROM supplier),
adj AS (SELECT source AS node, target AS neighbour, kind FROM edges UNION ALL SELECT target, source, kind FROM edges)
"""


@query(f"WITH {ENTITY_SQL} SELECT DISTINCT a.kind AS edge_kind, id, n.kind AS kind, label, file_path FROM adj a JOIN nodes n ON id = neighbour WHERE node = 'n:7'")
def graph_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.explain(*entity_graph(spark, sf_dir), "n:7")


@query(f"WITH {ENTITY_SQL} SELECT DISTINCT a.kind AS edge_kind, id, n.kind AS kind, label, file_path FROM adj a JOIN nodes n ON id = neighbour WHERE node = 'n:7' ORDER BY label, id, edge_kind LIMIT 20")
def graph_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.details(*entity_graph(spark, sf_dir), "n:7")


@query(f"""
WITH {ENTITY_SQL}, near AS (SELECT DISTINCT a.kind, label, id FROM adj a JOIN nodes n ON id = neighbour WHERE node = 'n:7')
SELECT kind, string_agg(label || '=' || id, ',' ORDER BY label, id) AS neighbours FROM near GROUP BY kind
""")
def graph_neighbours_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.by_kind(graph.explain(*entity_graph(spark, sf_dir), "n:7"))
    return found.select("kind", F.array_join(F.transform("neighbours", lambda n: F.concat_ws("=", n["label"], n["id"])), ",").alias("neighbours"))


@query(f"WITH {ENTITY_SQL} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.metrics(*entity_graph(spark, sf_dir))


@query(f"""
WITH {ENTITY_SQL}, shown AS (SELECT id FROM nodes WHERE kind IN ('file', 'symbol'))
SELECT source, target, kind FROM edges WHERE kind IN ('cites', 'contains') AND source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)
""")
def viewer_visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.visible(*entity_graph(spark, sf_dir), ["file", "symbol"], ["cites", "contains"])[1]


@query(f"""
WITH {ENTITY_SQL}, hit AS (SELECT id FROM nodes WHERE contains(lower(id), 'ani') OR contains(lower(label), 'ani'))
SELECT id FROM hit UNION SELECT neighbour FROM adj WHERE node IN (SELECT id FROM hit)
""")
def viewer_search_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.search(*entity_graph(spark, sf_dir), "ANI")


@query(f"""
WITH RECURSIVE {ENTITY_SQL},
walk AS (SELECT 'n:3' AS node, 0 AS hops UNION SELECT neighbour, hops + 1 FROM walk JOIN adj USING (node) WHERE hops < 4)
SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY node
""")
def graph_bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distances(entity_graph(spark, sf_dir)[1], "n:3", most=4).select("node", "hops")


@query(f"""
WITH {ENTITY_SQL},
wanted(q) AS (VALUES ('n:4'), ('europe'), ('file/CHINA'), ('ANIA'), ('RICA'), ('nothing')),
tiers AS (
  SELECT q, id, kind, label, file_path, CASE WHEN id = q THEN 1 WHEN lower(label) = lower(q) THEN 2 WHEN file_path = q THEN 3
         WHEN ends_with(id, q) OR ends_with(file_path, q) OR ends_with(label, q) THEN 4 END AS tier FROM nodes, wanted),
best AS (SELECT *, min(tier) OVER (PARTITION BY q) AS b FROM tiers WHERE tier IS NOT NULL),
last AS (SELECT *, count(*) OVER (PARTITION BY q) AS n, count(*) FILTER (tier = 4 AND kind IN ('file', 'doc') AND ends_with(file_path, q)) OVER (PARTITION BY q) AS p FROM best WHERE tier = b)
SELECT q, CAST(CASE WHEN tier = 4 AND n > 1 AND p = 1 THEN 5 ELSE tier END AS INTEGER) AS tier, id FROM last
WHERE NOT (tier = 4 AND n > 1 AND p = 1) OR (kind IN ('file', 'doc') AND ends_with(file_path, q))
""")
def resolve_node_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, found = entity_graph(spark, sf_dir)[0], None
    for q in ("n:4", "europe", "file/CHINA", "ANIA", "RICA", "nothing"):
        one = graph.resolve_node(nodes, q).select(F.lit(q).alias("q"), "tier", "id")
        found = one if found is None else found.unionAll(one)
    return found


@query(f"""
WITH {PAGES_SQL}, top AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 25)
SELECT id FROM top UNION SELECT target FROM real_edges WHERE source IN (SELECT id FROM top) UNION SELECT source FROM real_edges WHERE target IN (SELECT id FROM top)
""")
def viewer_focus_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.focus(*page_graph(spark, sf_dir), 25)


@query("""
SELECT o_orderkey, o_orderstatus <> 'F' AS stale, epoch(TIMESTAMP '1998-08-02 00:00:00') - epoch(o_orderdate) < 300 AND o_orderstatus = 'F' AS debounced FROM orders
""")
def staleness_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status, head, now = F.col("o_orderstatus"), F.lit("F"), F.to_timestamp(F.lit("1998-08-02 00:00:00"))
    return orders.select("o_orderkey", summary.is_stale(status, head).alias("stale"), summary.is_debounced(F.col("o_orderdate").cast("timestamp"), now, status, head).alias("debounced"))


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def incremental_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream that ends when all files have been read."""
    root = shared_path(spark, "stream")
    drain(spark, sf_dir, "events.parquet", f"{root}/checkpoint", windowed_counts, f"{root}/counts")
    counts = spark.read.parquet(f"{root}/counts")
    return counts.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n")
