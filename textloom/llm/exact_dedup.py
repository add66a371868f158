"""Exact document dedup with a heavy-hitter split (operator 7), DataFrame functions only.

Texts are equal when they are identical after each run of ASCII white space became one
space; their SHA-256 stands for them. A Misra-Gries summary (Spark's frequent-items sketch:
mergeable, bounded counters) proposes digests that may be frequent. One pass verifies them:
exact count and winner of each proposal, a few rows whatever the data's size. The verified
winners are broadcast and settle their rows where they lie, without a shuffle; what remains
has no group above a small share of the rows and is shuffled by digest as usual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import WS, free_name, written

#: Counters of the summary: any digest with more than 1/COUNTERS of the rows is found.
COUNTERS = 4096
#: Proposals kept from the summary; bounds what is broadcast (about 100 bytes each).
PROPOSALS = 1024


def normalised(text: Column) -> Column:
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", " ")


def proposals(digests: DataFrame, digest: str, counters: int = COUNTERS, most: int = PROPOSALS) -> DataFrame:
    """Digests that may be frequent, at most `most` rows, from a Misra-Gries summary."""
    top = digests.agg(F.expr(f"approx_top_k({digest}, {most}, {counters})").alias("top"))
    return top.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias(digest))


def decide(docs: DataFrame, *, key: str = "doc_id", text: str = "text", counters: int = COUNTERS, most: int = PROPOSALS) -> DataFrame:
    """One row per row of `docs`: key, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest key stays; a null key counts as the largest,
    and of rows that repeat both key and text exactly one stays. Null texts equal empty
    ones. Other columns of `docs`, whatever their names, play no part. An empty table gives
    an empty result.
    """
    rows = written(
        docs.select(
            F.col(f"`{key}`").alias("key"),
            F.monotonically_increasing_id().alias("at"),
            F.sha2(normalised(F.col(f"`{text}`")), 256).alias("digest"),
        ),
        "digests",
    )
    order = F.struct(F.col("key").isNull().alias("none"), "key", "at")
    winners = (
        rows.join(F.broadcast(proposals(rows, "digest", counters, most)), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size"))
    )
    winners = written(winners, "winners")  # at most `most` rows: their broadcast is bounded
    settled = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    by_digest = Window.partitionBy("digest")
    rest = rest.select("*", F.min(order).over(by_digest).alias("first"), F.count(F.lit(1)).over(by_digest).alias("size"))
    return settled.select(*rest.columns).unionByName(rest).select(
        F.col("key").alias(key),
        F.col("first.key").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("at") == F.col("first.at")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; `key` should name each row.

    Rows that repeat a kept key with another text are not affected by it: a row goes only
    if its own text has an earlier copy.
    """
    mark = free_name(docs, "sha256")
    kept = decide(docs, key=key, text=text).where("kept").select(F.col(key).alias(f"{mark}_key"), F.col("text_sha256").alias(f"{mark}_other"))
    marked = docs.withColumn(mark, F.sha2(normalised(F.col(f"`{text}`")), 256))
    same = F.col(f"`{key}`").eqNullSafe(F.col(f"{mark}_key")) & (F.col(mark) == F.col(f"{mark}_other"))
    return marked.join(kept, same, "left_semi").dropDuplicates([key, mark]).drop(mark)
