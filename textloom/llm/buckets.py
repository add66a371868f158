"""Links inside buckets, without all pairs of a bucket and without a bucket in one task.

Rows that share a bucket may be near each other. A bucket of more than LEAST_BLOCK rows is
cut into blocks of about eight times the root of its size, and each two blocks meet in a group
of their own; so a group is small however large its bucket is, and groups spread over all
tasks. Inside a group rows are compared one after the other with those before them, but
only with those that they aren't connected to yet: what comes out is a forest, at most one
link per row of a group, that connects exactly what all near pairs together connect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import returned, written

#: Rows of a block at least and at most; they bound a group, not what is compared.
LEAST_BLOCK, MOST_BLOCK = 128, 20_000
#: Rows a task remembers as connected before it starts anew; bounds memory, not results.
MOST_NODES = 2_000_000
#: Groups of so many rows at most are compared in bulk, all groups of a batch at once.
SMALL = 16


class Forest(dict):
    """Union-find over anything that can be a key."""

    def root(self, x):
        top = x
        while (up := self.get(top, top)) != top:
            top = up
        while x != top:
            up = self.get(x, x)
            self[x] = top
            x = up
        return top

    def join(self, x, y) -> None:
        self[self.root(x)] = self.root(y)


def dealt(rows: DataFrame, bucket: str, node: str, most: int = MOST_BLOCK) -> DataFrame:
    """`rows` (a written table) in the groups of their buckets: adds lo, hi and own, the
    blocks that meet and the row's; sorted by bucket, lo and hi inside partitions."""
    hot = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LEAST_BLOCK)
    block = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(most), 8 * F.sqrt("size")))
    hot = written(hot.select(bucket, F.ceil(F.col("size") / block).cast("int").alias("blocks")), "hot-buckets")
    blocks = F.coalesce("blocks", F.lit(1))
    spread = rows.join(hot, bucket, "left").withColumn("own", F.pmod(F.xxhash64(node, F.lit("block")), blocks).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    return spread.drop("blocks", "other").repartition(bucket, "lo", "hi").sortWithinPartitions(bucket, "lo", "hi", node)


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole groups only, and where the groups begin (and the last ends)."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        begins = _begins(held, names)
        if begins[-1]:
            yield held.slice(0, begins[-1]), begins
            held = held.slice(begins[-1])
    if held is not None:
        yield held, np.append(_begins(held, names), held.num_rows)


def _begins(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in names:
        key = batch.column(name).to_numpy(zero_copy_only=False)
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _small_pairs(begins: np.ndarray, likely: Callable) -> list[list[int]]:
    """Rows (y, x), x before y, that may be near in groups of SMALL rows at most; in order."""
    size = np.diff(begins)
    nth = np.arange(begins[-1]) - np.repeat(begins[:-1], size)
    nth[np.repeat(size > SMALL, size)] = 0
    found = [np.empty((0, 2), np.int64)]
    for apart in range(1, SMALL):
        y = np.flatnonzero(nth >= apart)
        if not len(y):
            break
        x = likely(y - apart, y)
        found.append(np.stack([x + apart, x], 1))
    pairs = np.concatenate(found)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist()


def links(rows: DataFrame, bucket: str, node: str, near: Callable, most: int = MOST_BLOCK) -> DataFrame:
    """x, y: a forest over the nodes of `rows` that connects all near ones of a bucket.

    `near(batch)` gives `likely(at, y)` (which of the rows `at` may be near row y, or each near
    its own one if y is an array, in bulk) and `sure(x, y)` (whether they are), on the rows of a batch. `most` bounds a block.
    """
    kind = rows.schema[node].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with returned():
            yield from linked(batches)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch, begins in whole_groups(batches, [bucket, "lo", "hi"]):
            nodes, own = batch.column(node).to_pylist(), batch.column("own").to_numpy()
            within = (batch.column("lo").to_numpy() == batch.column("hi").to_numpy()).tolist()
            likely, sure = near(batch)
            if len(forest) > MOST_NODES:
                forest.clear()
            found: list[tuple] = []
            for y, x in _small_pairs(begins, likely):
                if (within[x] or own[x] != own[y]) and forest.root(nodes[x]) != forest.root(nodes[y]) and sure(x, y):
                    found.append((nodes[x], nodes[y]))
                    forest.join(nodes[x], nodes[y])
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
                if b - a <= SMALL:
                    continue
                # Labels of the trees that the group's nodes are in at present.
                numbers: dict = {}
                label = np.array([numbers.setdefault(forest.root(n), len(numbers)) for n in nodes[a:b]])
                if len(numbers) == 1:
                    continue
                for y in range(a + 1, b):
                    at = np.arange(a, y)
                    at = at[(label[: y - a] != label[y - a]) & (within[a] | (own[a:y] != own[y]))]
                    at = likely(at, y) if len(at) else at
                    while len(at):
                        x = int(at[0])
                        if sure(x, y):
                            found.append((nodes[x], nodes[y]))
                            forest.join(nodes[x], nodes[y])
                            label[label == label[x - a]] = label[y - a]
                        at = at[1:]
                        at = at[label[at - a] != label[y - a]]
            if found:
                x, y = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(x, batch.column(node).type), pa.array(y, batch.column(node).type)], names=["x", "y"])

    return dealt(rows, bucket, node, most).mapInArrow(run, f"x {kind}, y {kind}")
