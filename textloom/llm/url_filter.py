"""URL filter: blocked Bloom filter, then an exact hash join (operator 1).

Rules are canonical URLs: a host (which also stands for its subdomains) and the start of a
path. A page's URL can only fit rules that have the shape of a suffix of its host and a
prefix of its path, so it is probed once for each shape among the rules (labels of the host,
length of the path), which meet it in a join: few, however many rules there are, and the plan
doesn't grow with them. A split-block Bloom filter (256-bit
blocks, one bit in each of eight words, all probes in one cache line) lets through what may
be listed; an exact hash join on (host, path) removes its false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import written

#: The odd multipliers of the split-block filter in the Parquet format.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: Bits per listed rule, and the bound of what is broadcast: beyond it the filter gets
#: fuller and lets more through, which the exact join still removes.
BITS_PER_RULE, MOST_BYTES = 16, 64 << 20


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z in lower case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def blooms(rules: DataFrame) -> tuple[np.ndarray, int]:
    """The filter over the column `h` (64-bit hashes): its blocks, built where the rules
    lie and merged per block, at most MOST_BYTES whatever the number of rules."""
    count = max(1, rules.count())
    blocks = max(1, min(MOST_BYTES // 32, -(-count * BITS_PER_RULE // 256)))
    block = F.expr(f"pmod(shiftrightunsigned(h, 32), {blocks}L)").alias("block")
    words = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(((h & 2147483647L) * {salt}L) & 4294967295L, 27) as int))").alias(f"w{i}") for i, salt in enumerate(SALTS)]
    merged = rules.select(block, *words).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])
    filled = np.zeros((blocks, 8), np.uint64)
    for row in merged.toLocalIterator():  # as many rows as blocks, of bounded size
        filled[row[0]] = row[1:]
    return filled.astype(np.uint32), blocks


def may_hold(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter; never false for one that is."""
    h = hashes.view(np.uint64)
    block, low = (h >> np.uint64(32)) % np.uint64(len(filled)), h & np.uint64(0x7FFFFFFF)  # 31 bits: products stay below 2 ** 63
    left = np.arange(len(h))  # what all words so far have: few go on to the next
    for word, salt in zip(filled.T, SALTS):
        bit = ((low[left] * np.uint64(salt)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
        left = left[(word[block[left]] >> bit.astype(np.uint32)) & 1 == 1]
    found = np.zeros(len(h), bool)
    found[left] = True
    return found


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule and verdict of every row of `pages`.

    `rules` has host, path and verdict (`allow` or `block`); equal rules count once, block
    before allow, and rules with a null are ignored. A rule fits its host and all
    subdomains if the URL's path starts with the rule's; the longest (host and path
    together, then host) wins, and where none fits `rule` is null and the verdict `default`.
    Null URLs and those without `://` have empty host and path. Repeated rows are judged
    alike, extra columns play no part, empty tables give empty or default results. How
    skewed the hosts are doesn't matter: rules are joined by broadcast when Spark finds
    them small, and by shuffle otherwise, after the filter has taken out the other pages.
    """
    listed = rules.dropna(subset=["host", "path", "verdict"]).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    listed = written(listed.where("host <> ''"), "rules").withColumn("h", F.xxhash64("host", "path"))
    shapes = written(listed.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("p")).distinct(), "rule-shapes")
    most = shapes.agg(F.max("n")).first()[0]
    rows = written(pages.select(F.col(f"`{key}`").alias("key"), F.monotonically_increasing_id().alias("at"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path")), "urls")
    if most is None:
        best = rows.select("key", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
        return best.withColumnRenamed("key", key)
    # Labels of a suffix: as many as the host has, but no more than any rule's.
    labels = F.sequence(F.lit(1), F.least(F.lit(most), F.size(F.split("host", r"\."))))
    probed = rows.select("at", "host", "path", F.explode(labels).alias("n")).join(shapes, "n").where("p <= length(path)")
    probed = probed.select("at", F.expr("substring_index(host, '.', -n)").alias("host"), F.expr("substring(path, 1, p)").alias("path")).where("host <> ''")
    probed = probed.withColumn("h", F.xxhash64("host", "path"))
    filled = rows.sparkSession.sparkContext.broadcast(blooms(listed)[0])

    @F.pandas_udf("boolean")
    def possible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in batches:
            yield pd.Series(may_hold(filled.value, h.to_numpy(np.int64)))

    hits = probed.where(possible("h")).join(listed.drop("h"), ["host", "path"])
    rank = F.struct(F.length("host") + F.length("path"), F.length("host"), F.concat("host", "path").alias("rule"), "verdict")
    won = hits.groupBy("at").agg(F.max(rank).alias("w")).select("at", "w.rule", "w.verdict")
    judged = rows.join(won, "at", "left")
    return judged.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
