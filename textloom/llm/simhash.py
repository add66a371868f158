"""SimHash near-dedup with deletion-variant signatures (operator 5).

Fingerprints that differ in at most BITS bits, cut into so few segments that some segment
differs in at most one bit, agree in that segment if that bit is a wildcard. So each distinct
fingerprint is indexed by the variants of its segments with one bit deleted. An equality
join that tests the differing bits keeps what meets a near one, at most one row per variant
however many are near; in each variant these are compared until they are connected (see
`buckets`), and the links go to distributed connected components. Copies share a
fingerprint and are collapsed first.

Texts that share 0.8 of their shingles differ in some 10 of 64 bits, too many for so few
segments. `similar` therefore indexes three fingerprints of the set of shingles in 16-bit
segments by the same variants, tests all their bits in the join, and verifies by the shares
of their shingles. Of small sets, where a bit says little, it finds all pairs by the
shingles they begin with.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import buckets
from textloom.llm.common import WS, free_name, returned, written
from textloom.llm.components import components

#: Fixed values of the contract: words a shingle, hash seed, differing bits of a link.
SHINGLE, SEED, BITS = 4, 42, 4
#: Of `similar`: words a shingle, the least share of shingles, 64-bit words of a fingerprint
#: and bits of a segment. Of pairs at 0.8 a share of 0.98 has a segment that differs in one
#: bit at most, at 0.85 0.999. Wider segments suit more documents, and then need more words.
SET_SHINGLE, SIMILARITY, WORDS, SEGMENT = 5, 0.8, 3, 16
#: Pairs with a set of at most EXACT shingles don't depend on fingerprints. For those, the
#: most frequent shingles, from COMMON sets on and RANKED at most, come last in prefixes;
#: that bounds work, not results.
EXACT, COMMON, RANKED = 64, 64, 20_000

#: Sets of a block, with their hashes, that meet another block at most; bounds memory.
MEMBERS = 2_000

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_words = re.compile(f"[^{WS}]+").findall
#: Row v holds the bits of byte v, the highest first.
_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
#: Columns of a set fingerprint's words.
_WORDS = [f"w{i}" for i in range(WORDS)]


def shingles_of(text: str | None, shingle: int) -> list[str]:
    """Shingles of the whole lower-cased text; all its words if they are fewer."""
    words = _words(text.translate(LOWER)) if text else []
    if len(words) < shingle:
        return [" ".join(words)] if words else []
    return list(map(" ".join, zip(*(words[i:] for i in range(shingle)))))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes (a row of bytes each) have each bit."""
    if len(hashes) < 64:
        return np.unpackbits(hashes, axis=1).sum(0)
    return np.concatenate([np.bincount(hashes[:, i], minlength=256) @ _BYTE for i in range(hashes.shape[1])])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a whole text as a signed integer; 0 without words."""
    shingles = shingles_of(text, shingle)
    if not shingles:
        return 0
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed))), np.uint8).reshape(-1, 8)
    ones = _ones(hashes)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """key and fp (bigint) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                fp = [fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"key {kind}, fp bigint")


def segments(bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs in at most one bit."""
    n = bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def differing(words: list[str], a: str, b: str) -> Column:
    """How many bits of the columns `words` of a and b differ."""
    return sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in words[1:]), F.bit_count(F.col(f"{a}.{words[0]}").bitwiseXOR(F.col(f"{b}.{words[0]}"))))


def met(rows: DataFrame, node: str, cuts: list[tuple[str, int, int]], near: Column) -> DataFrame:
    """`rows` under each one-wildcard variant (column `variant`) in which they meet a near row.

    `cuts` are segments: word column, first bit, width. A segment has a variant for each of
    its bits, that bit cleared and named in the variant, so segments that differ in one bit
    or none have a variant in common. Rows meet in a semi-join: a row comes at most once per
    variant however many are near it. `near` compares aliases l and r. The join is always
    by shuffle: Spark's estimate of a table's size doesn't count the rows that `explode` makes,
    so without the hint it would build the whole index in the driver to broadcast it.
    """
    width = max(w for _, _, w in cuts)
    variants, bit = [], 0
    for word, first, w in cuts:
        value = f"(shiftrightunsigned({word}, {first}) & {(1 << w) - 1}L)"
        for j in range(w):
            variants.append(f"cast(({value} & {~(1 << j)}L) | {bit << width}L as int)")
            bit += 1
    index = rows.select("*", F.explode(F.array(*map(F.expr, variants))).alias("variant"))
    same = (F.col("l.variant") == F.col("r.variant")) & (F.col(f"l.{node}") != F.col(f"r.{node}"))
    return index.alias("l").join(index.alias("r").hint("merge"), same & near, "left_semi")


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """x, y: a forest over the distinct fingerprints `fp` that connects all that differ in
    `bits` or less."""
    near = differing(["fp"], "l", "r") <= bits
    rows = written(met(distinct.select("fp"), "fp", [("fp", a, w) for a, w in segments(bits)], near), "met-fingerprints")

    def compare(batch: pa.RecordBatch):
        fp = batch.column("fp").to_numpy()
        return lambda at, y: at[np.bitwise_count((fp[at] ^ fp[y]).view(np.uint64)) <= bits], lambda x, y: True

    return written(buckets.links(rows, "variant", "fp", compare), "fingerprint-links")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """One row per row of `docs`: key, fingerprint (16 hex digits), component_id.

    component_id is the smallest key that links reach, the row's own included. Null and
    empty texts have fingerprint zero and link like any other; rows with a null key link as
    others do but name no component unless all of its keys are null. Repeated rows give
    repeated results; other columns play no part; an empty table gives an empty result.
    """
    fps = written(fingerprints(docs, key=key, text=text, shingle=shingle, seed=seed), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies")), "distinct-fingerprints")
    return _named(fps, distinct, links(distinct, bits), key)


def _named(fps: DataFrame, distinct: DataFrame, pairs: DataFrame, key: str, by: str = "fp") -> DataFrame:
    """The component of each row of `fps`, from the links of its distinct fingerprints, or
    of what else `by` names.

    Only fingerprints with copies or links are looked up, and from tables, not aggregates:
    so the joins stay plain shuffles, of which skew handling splits a fingerprint's copies
    or a component's fingerprints however many they are.
    """
    roots = components(pairs, "x", "y").withColumnRenamed("node", by)
    grouped = written(roots.join(distinct.select(by, "first"), by), "linked-fingerprints")
    smallest = written(grouped.groupBy("root").agg(F.min("first").alias("smallest")), "component-ids")
    merged = grouped.join(smallest, "root").select(by, "smallest")
    named = distinct.join(merged, by, "left").where("copies > 1 or smallest is not null")
    named = written(named.select(by, F.coalesce("smallest", "first").alias("component_id")), "named-fingerprints")
    component = F.coalesce("component_id", "key").alias("component_id")
    return fps.join(named, by, "left").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component)


def set_fingerprint(text: str | None, shingle: int = SET_SHINGLE, seed: int = SEED) -> tuple[bytes, int, int, np.ndarray]:
    """WORDS times 64 bits of the SimHash of the set of a whole text's shingles, its size,
    a hash that tells different sets apart, and the shingles' hashes.

    Where as many shingles have a bit as haven't, the one with the least hash decides, so
    that short texts don't crowd around zero.
    """
    shingles = set(shingles_of(text, shingle))
    if not shingles:
        return bytes(8 * WORDS), 0, 0, np.empty(0, np.int64)
    encoded = [s.encode() for s in shingles]
    parts = [xxhash.xxh64_digest(s, seed) + xxhash.xxh3_128_digest(s, seed) for s in encoded]
    hashes = np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), 8 * WORDS)
    ones, n = 2 * _ones(hashes), len(parts)
    tie = np.unpackbits(np.frombuffer(min(parts), np.uint8))
    same = int.from_bytes(xxhash.xxh3_64_digest(b"\n".join(sorted(encoded)), seed), "big", signed=True)
    return np.packbits((ones > n) | ((ones == n) & (tie == 1))).tobytes(), n, same, hashes[:, :8].copy().view(np.int64)[:, 0]


def set_fingerprints(docs: DataFrame, key: str, text: str, shingle: int, seed: int, most: float) -> DataFrame:
    """key, t (hash of the text), w0.. (bigint words), n (shingles), s (hash of their set) of
    every row, and h (hashes of the shingles) of rows that have `most` of them or fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with returned():
            yield from made_of(batches)

    def made_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                made = [set_fingerprint(t, shingle, seed) for t in batch.column(2).to_pylist()]
                words = np.frombuffer(b"".join(f for f, _, _, _ in made), ">i8").reshape(-1, WORDS).astype(np.int64)
                columns = [batch.column(0), batch.column(1), *[pa.array(words[:, i]) for i in range(WORDS)], pa.array([n for _, n, _, _ in made], pa.int64()), pa.array([s for _, _, s, _ in made], pa.int64())]
                columns.append(pa.array([h if 0 < n <= most else None for _, n, _, h in made], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "t", *_WORDS, "n", "s", "h"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, t bigint, {', '.join(f'{w} bigint' for w in _WORDS)}, n bigint, s bigint, h array<bigint>")


def most_bits(total: int, similarity: float) -> int:
    """Differing bits of `total` that sets at `similarity` stay within, by four deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(total * p + 4 * math.sqrt(total * p * (1 - p)))


def _near_sets(similarity: float):
    """The comparison of sets for `buckets.links`: near in all bits (unless one is small) and
    in size, since the smaller set can't share more than it has."""
    most = most_bits(64 * WORDS, similarity)

    def compare(batch: pa.RecordBatch):
        words = np.stack([batch.column(w).to_numpy() for w in _WORDS])
        n = batch.column("n").to_numpy()

        def likely(at: np.ndarray, y: int | np.ndarray) -> np.ndarray:
            least, largest = np.minimum(n[at], n[y]), np.maximum(n[at], n[y])
            fits = least >= similarity * largest - 1e-9
            at, least, y = at[fits], least[fits], y[fits] if np.ndim(y) else y
            bits = np.bitwise_count((words[:, at] ^ words[:, y].reshape(WORDS, -1)).view(np.uint64)).sum(0)
            return at[(bits <= most) | (least <= EXACT)]

        return likely, lambda x, y: True

    return compare


def close_sets(distinct: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """x, y: a forest over the sets `s` that connects those with a segment that differs in one
    bit at most and that are near in all bits and in size."""
    sized = F.least("l.n", "r.n") >= similarity * F.greatest("l.n", "r.n") - 1e-9
    near = sized & (differing(_WORDS, "l", "r") <= most_bits(64 * WORDS, similarity))
    cuts = [(w, first, SEGMENT) for w in _WORDS for first in range(0, 64, SEGMENT)]
    rows = written(met(distinct.select("s", *_WORDS, "n"), "s", cuts, near), "met-sets")
    return buckets.links(rows, "variant", "s", _near_sets(similarity))


def close_small_sets(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """x, y: a forest over `sets` (s, n, h) that connects all pairs with `similarity` of which
    one has EXACT shingles at most: none is missing.

    Sets at `similarity` have a shingle in common among the first n - ceil(similarity * n)
    + 1 of each, in any order that is the same for all; rare shingles first makes few meet.
    The first common shingle leaves room for the overlap that similarity needs.
    """
    often = sets.select(F.explode("h").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") >= COMMON)
    ranks = sets.sparkSession.sparkContext.broadcast({r.v: r.sets for r in often.orderBy(F.desc("sets"), "v").limit(RANKED).collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for batch in batches:
            own, counts = [], []
            for n, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                counts.append(n - math.ceil(similarity * n - 1e-9) + 1)
                own += sorted(h, key=lambda v: (rank.get(v, 0), v))[: counts[-1]]
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            place = [i for c in counts for i in range(c)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *[batch.column(i).take(at) for i in range(2)], pa.array(place, pa.int64())], names=["v", "s", "n", "at"])

    rows = written(sets.select("s", "n", "h").mapInArrow(run, "v bigint, s bigint, n bigint, at bigint"), "shingle-prefixes")
    live = rows.groupBy("v").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").select("v")
    rows = written(rows.join(written(live, "live-shingles"), "v", "left_semi"), "met-prefixes")

    def compare(batch: pa.RecordBatch):
        n, place = batch.column("n").to_numpy(), batch.column("at").to_numpy()

        def likely(at: np.ndarray, y: int | np.ndarray) -> np.ndarray:
            least, largest = np.minimum(n[at], n[y]), np.maximum(n[at], n[y])
            room = np.minimum(n[at] - place[at], n[y] - place[y])
            return at[(least <= EXACT) & (least >= similarity * largest - 1e-9) & (room >= similarity / (1 + similarity) * (n[at] + n[y]) - 1e-9)]

        return likely, lambda x, y: True

    return buckets.links(rows, "v", "s", compare)


def similar_sets(members: DataFrame, similarity: float) -> DataFrame:
    """x, y: a forest over `members` (bucket, s, words, n, h: sorted hashes of all shingles)
    that connects the sets of a bucket which share `similarity`."""
    close = _near_sets(similarity)

    def compare(batch: pa.RecordBatch):
        likely, _ = close(batch)
        h = batch.column("h")
        ends, values = h.offsets.to_numpy(), h.values.to_numpy()

        def sure(x: int, y: int) -> bool:
            a, b = values[ends[x] : ends[x + 1]], values[ends[y] : ends[y + 1]]
            both = len(np.intersect1d(a, b, assume_unique=True))
            return both >= similarity * (len(a) + len(b) - both)

        return likely, sure

    return buckets.links(members, "bucket", "s", compare, most=MEMBERS)


def similar(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SET_SHINGLE, seed: int = SEED, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs`: key, fingerprint (16 hex digits), component_id.

    Texts link if their sets of shingles share `similarity` or more (intersection over
    union). The index finds which sets are close, closeness connects them to groups, and in
    each group all that are close are measured by the hashes of all their shingles, until
    they are connected: all pairs there are where a set has EXACT shingles or fewer, else
    about 0.98 of those at 0.8; component_id is the smallest key that links reach. Only texts
    with equal sets of shingles count as copies unmeasured. Null and empty texts, and those
    without words, are copies of each other. Null keys, repeated rows, other columns and an
    empty table are as in `near_duplicates`.
    """
    fps = written(set_fingerprints(docs, key, text, shingle, seed, EXACT / similarity + 1), "set-fingerprints")
    # The text that stands for a set's copies in the verification.
    chosen = F.min(F.struct("t", *_WORDS, "n")).alias("chosen")
    distinct = fps.groupBy("s").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"), chosen).select("s", "first", "copies", "chosen.*")
    distinct = written(distinct, "distinct-set-fingerprints")
    sets = written(fps.where("h is not null").select("s", "n", "h").dropDuplicates(["s"]), "small-sets")
    close = written(close_sets(distinct.where(F.col("n") > EXACT), similarity).union(close_small_sets(sets, similarity)), "close-sets")
    groups = components(close, "x", "y").select(F.col("node").alias("s"), F.col("root").alias("bucket"))
    groups = written(groups.join(distinct.select("s", "t", *_WORDS, "n"), "s"), "close-groups")
    texts = docs.select(F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("text"))
    hashes = _hashes(texts.join(groups.select("t"), "t", "left_semi").dropDuplicates(["t"]), shingle, seed)
    members = written(groups.join(written(hashes, "met-hashes"), "t").drop("t"), "close-members")
    found = written(similar_sets(members, similarity), "set-links")
    return _named(fps.select("key", F.col(_WORDS[0]).alias("fp"), "s"), distinct, found, key, "s")


def _hashes(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """t and h, the sorted hashes of the different shingles of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                own = [np.unique(set_fingerprint(t, shingle, seed)[3]) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["t", "h"])

    return texts.select("t", "text").mapInArrow(run, "t bigint, h array<bigint>")


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", groups=near_duplicates, **how) -> DataFrame:
    """One row of `docs` for each component, all columns kept.

    `groups` is near_duplicates or similar. The row that stays has the smallest key (null
    last) and, of rows that repeat it with other texts, the smallest hash of the text; so
    neither null nor repeated keys take a component's last row away.
    """
    k, t = free_name(docs, "key"), free_name(docs, "hash")
    hashed = F.xxhash64(F.col(f"`{text}`"))
    row = F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("key"), hashed.alias("t"))
    named = groups(docs.select(row.alias("row"), F.col(f"`{text}`").alias("text")), key="row", text="text", **how)
    keep = named.where(F.col("row").eqNullSafe(F.col("component_id"))).select(F.col("row.key").alias(k), F.col("row.t").alias(t)).distinct()
    rows = docs.withColumn(t, hashed).join(keep.withColumnRenamed(t, f"{t}_"), F.col(f"`{key}`").eqNullSafe(F.col(k)) & (F.col(t) == F.col(f"{t}_")), "left_semi")
    return rows.dropDuplicates([key, t]).drop(t)
