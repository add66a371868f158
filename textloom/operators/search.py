"""Exact vector search, BM25 and their fusion by reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.paths import prefix
from textloom.functions.text import WORD_TOKEN, tokens

#: Candidates of each arm, and the smoothing of reciprocal ranks.
CANDIDATES, RRF_K = 50, 60
#: BM25 parameters.
K1, B = 1.2, 0.75


def predicate(repo: str | None = None, language: str | None = None, path_prefix: str | None = None, strict: bool = True) -> Column | None:
    """The conjunction of the given filters, null if there is none. `strict=False` drops a
    prefix's last slash, so that `src/` also finds `src2/`."""
    found = None
    for column, value in (("repo", repo), ("language", language)):
        if value:
            found = (F.col(column) == value) if found is None else found & (F.col(column) == value)
    if path_prefix:
        starts = F.col("file_path").startswith(prefix(path_prefix, strict))
        found = starts if found is None else found & starts
    return found


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine in double; null for null or zero vectors."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    return F.try_divide(dot(vector, wanted), F.sqrt(dot(vector, vector)) * F.lit(norm))


def knn(rows: DataFrame, vector: str, query: list[float], id_column: str, limit: int = CANDIDATES, where: Column | None = None) -> DataFrame:
    """The `limit` rows nearest by cosine, exact; the filter comes before the limit."""
    rows = rows if where is None else rows.where(where)
    scored = rows.withColumn("score", cosine(F.col(vector), query)).where("score is not null")
    return scored.orderBy(F.desc("score"), id_column).limit(limit)


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == F.lit(term)))


def bm25(rows: DataFrame, text: str, terms: list[str], id_column: str, limit: int = CANDIDATES, where: Column | None = None, pattern: str = WORD_TOKEN) -> DataFrame:
    """The `limit` rows best by BM25. Statistics are those of all rows, the filter limits
    the candidates only; rows with no query term are none. Without terms it is empty.

    One pass makes the statistics, one row; the other scores row by row without a shuffle:
    the query's terms are literals, so no postings are needed.
    """
    terms = sorted(set(terms))
    words = tokens(F.col(text), pattern)
    if not terms:
        return rows.limit(0).withColumn("score", F.lit(0.0))
    has = [F.sum(F.array_contains("__w", t).cast("long")).alias(f"df{i}") for i, t in enumerate(terms)]
    stats = rows.select(words.alias("__w")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("__w").cast("double")).alias("avgdl"), *has)
    candidates = rows if where is None else rows.where(where)
    scored = candidates.withColumn("__w", words).where(F.arrays_overlap("__w", F.array(*map(F.lit, terms))))
    scored = scored.join(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for i, t in enumerate(terms):
        tf = _times("__w", t).cast("double")
        idf = F.log(1.0 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("__w") / F.col("avgdl")))
    scored = scored.withColumn("score", total).select(*rows.columns, "score")
    return scored.orderBy(F.desc("score"), id_column).limit(limit)


#: Buckets of terms: a query reads only the files of its terms' buckets.
TERM_BUCKETS = 64


def _bucket(term) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def postings(rows: DataFrame, text: str, id_column: str, keep: tuple[str, ...] = (), pattern: str = WORD_TOKEN) -> DataFrame:
    """The text index: term, id, tf, dl (tokens of the row) and bucket, and the columns
    `keep`; rows without tokens have none. Terms are counted before the shuffle."""
    words = rows.select(id_column, *keep, tokens(F.col(text), pattern).alias("__w"))
    each = words.select(id_column, *keep, F.size("__w").alias("dl"), F.explode("__w").alias("term"))
    counted = each.groupBy("term", id_column, "dl", *keep).agg(F.count(F.lit(1)).alias("tf"))
    return counted.withColumn("bucket", _bucket(F.col("term")))


def text_stats(rows: DataFrame, text: str, pattern: str = WORD_TOKEN) -> DataFrame:
    """One row: n (rows) and avgdl (their mean number of tokens)."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens(F.col(text), pattern)).cast("double")).alias("avgdl"))


def bm25_indexed(index: DataFrame, stats: DataFrame, terms: list[str], id_column: str, limit: int = CANDIDATES, allowed: DataFrame | None = None) -> DataFrame:
    """id and score of the `limit` rows best by BM25, from `postings` and `text_stats`: reads
    only the postings of the terms. `allowed` (ids) limits the candidates, not the statistics."""
    terms = sorted(set(terms))
    if not terms:
        return index.select(id_column, F.lit(0.0).alias("score")).limit(0)
    buckets = [r[0] for r in index.sparkSession.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"))).distinct().collect()]
    hits = index.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row per term of the query
    hits = hits if allowed is None else hits.join(allowed.select(id_column), id_column, "left_semi")
    joined = hits.join(F.broadcast(df), "term").join(F.broadcast(stats))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return joined.groupBy(id_column).agg(F.sum(part).alias("score")).orderBy(F.desc("score"), id_column).limit(limit)


def rrf(arms: list[DataFrame], id_column: str, limit: int, k: int = RRF_K) -> DataFrame:
    """id and score of ranked arms (id, score; at most CANDIDATES rows each) fused."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), id_column)) - 1
    ranked = [arm.select(id_column, (1.0 / (rank + k)).alias("part")) for arm in arms]
    union = ranked[0]
    for arm in ranked[1:]:
        union = union.unionByName(arm)
    return union.groupBy(id_column).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), id_column).limit(limit)


def hybrid(rows: DataFrame, *, text: str, vector: str, id_column: str, terms: list[str], query: list[float], limit: int, where: Column | None = None, pattern: str = WORD_TOKEN) -> DataFrame:
    """Both arms over the same rows, then fused; `rows` has text and vector."""
    vectors = knn(rows.select(id_column, vector, *_used(rows, where)), vector, query, id_column, where=where)
    texts = bm25(rows.drop(vector), text, terms, id_column, where=where, pattern=pattern)
    return rrf([vectors.select(id_column, "score"), texts.select(id_column, "score")], id_column, limit)


def _used(rows: DataFrame, where: Column | None) -> list[str]:
    return [c for c in ("repo", "language", "file_path", "lang", "source") if where is not None and c in rows.columns]
