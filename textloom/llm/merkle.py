"""Document fingerprints by Merkle trees over paragraphs and sections (operator 6).

A text is cut into paragraphs (lines), a paragraph into passages at the ends of sentences;
runs of paragraphs form sections. Section borders are set by the paragraphs' own content
(a hash that ends in zero bits), so an insertion moves only the borders next to it. Passages
are the leaves; each node hashes its children, and the root with the text's length is the
fingerprint. Equal roots mean equal texts. Where roots differ, only branches that differ are
followed, down to the passages that were edited.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import shared_path, shuffle_width

#: A section ends after a paragraph whose hash is a multiple of this, and has at most
#: MOST_PARAGRAPHS; a passage is a sentence, or so many characters without a full stop.
SECTION, MOST_PARAGRAPHS, PASSAGE = 8, 64, 120

_paragraphs = re.compile(r"[^\n]*\n|[^\n]+").findall
_passages = re.compile(rf"[^.!?]{{1,{PASSAGE}}}[.!?]*|[.!?]+", re.S).findall


def _hash(parts: Iterable[bytes], level: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16, person=level).digest()


@dataclass
class Tree:
    """root; sections as (hash, paragraphs); paragraphs as (hash, passages); passages as
    (hash, characters)."""

    root: bytes
    size: int
    sections: list

    def hex(self) -> str:
        return self.root.hex()


def tree(text: str | None) -> Tree:
    """The tree of a whole text; null counts as empty. Joined, the leaves are the text."""
    text = text or ""
    sections, current = [], []
    for paragraph in _paragraphs(text):
        leaves = [(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=16).digest(), len(p)) for p in _passages(paragraph)]
        node = _hash([h for h, _ in leaves], b"paragraph")
        current.append((node, leaves))
        if node[-1] % SECTION == 0 or len(current) == MOST_PARAGRAPHS:
            sections.append((_hash([h for h, _ in current], b"section"), current))
            current = []
    if current:
        sections.append((_hash([h for h, _ in current], b"section"), current))
    root = _hash([len(text).to_bytes(8, "little"), *(h for h, _ in sections)], b"root")
    return Tree(root, len(text), sections)


def _apart(a: list, b: list) -> tuple[list, list, int]:
    """Nodes of a that b lacks, nodes of b that a lacks, and characters in both."""
    left = Counter(h for h, _ in b)
    only_a, shared = [], 0
    for h, children in a:
        if left[h]:
            left[h] -= 1
            shared += children if isinstance(children, int) else _length(children)
        else:
            only_a.append((h, children))
    only_b = []
    for h, children in reversed(b):
        if left[h]:
            left[h] -= 1
            only_b.append((h, children))
    return only_a, only_b[::-1], shared


def _length(nodes: list) -> int:
    return sum(x if isinstance(x, int) else _length(x) for _, x in nodes)


def likeness(a: Tree, b: Tree) -> float:
    """Twice the characters in common branches over both sizes: 1 iff the texts are equal."""
    if a.root == b.root:
        return 1.0
    shared, x, y = 0, a.sections, b.sections
    for _ in range(3):  # sections, their paragraphs, their passages
        x, y, same = _apart(x, y)
        shared += same
        if not x or not y or isinstance(x[0][1], int):
            break
        x, y = [c for _, cs in x for c in cs], [c for _, cs in y for c in cs]
    found = 2 * shared / max(1, a.size + b.size)
    return min(found, 1 - 1e-9)  # unequal texts with the same passages in another order


def edits(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Ranges of characters of `a` in passages that `b` lacks: where the edits are."""
    missing = Counter(h for _, ps in b.sections for _, ls in ps for h, _ in ls)
    ranges, at = [], 0
    for _, paragraphs in a.sections:
        for _, leaves in paragraphs:
            for h, n in leaves:
                if missing[h]:
                    missing[h] -= 1
                elif ranges and ranges[-1][1] == at:
                    ranges[-1] = (ranges[-1][0], at + n)
                else:
                    ranges.append((at, at + n))
                at += n
    return ranges


def edited(text: str, after: str) -> str:
    """The last floor(n/2) code points of `text` replaced by the first as many of `after`."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare(text: str, after: str, own: Tree, following: Tree) -> tuple:
    changed = edited(text, after)
    new = tree(changed)
    return len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.hex(), new.hex(), likeness(own, new), likeness(own, following)


RESULT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def fingerprint(docs: DataFrame, *, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """`docs` with the fingerprint of each whole text; null texts count as empty."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: tree(t).hex())

    roots = F.pandas_udf(each, "string")
    return docs.withColumn(name, roots(F.col(f"`{text}`")))


def compare_with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next row is the next by ascending key, after the last the first; rows that repeat a
    key follow each other by text, null keys come first; a single row is its own next. Rows are
    ranged by key and sorted within their range, so a row and its next lie together; only
    the first and last row of each range (as many as tasks) go through a second step. Null
    texts count as empty; extra columns play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    width = max(2, shuffle_width(spark))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(width, "key").sortWithinPartitions("key", "text")
    ranged = ranged.withColumn("part", F.spark_partition_id())
    # `edge`: null in finished rows, else the text of a range's first (head) or last row.
    fields = [("key", kind, pa.null()), ("part", T.IntegerType(), pa.int32()), ("edge", T.StringType(), pa.string()), ("head", T.BooleanType(), pa.bool_())]
    result = [("n_chars", T.LongType(), pa.int64()), *((c, T.StringType(), pa.string()) for c in RESULT[1:4]), *((c, T.DoubleType(), pa.float64()) for c in RESULT[4:])]
    schema = T.StructType([T.StructField(n, t) for n, t, _ in [*fields, *result]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (key, text, tree) of the row before

        def out(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*found))
            types = [kind, *(t for _, _, t in [*fields, *result][1:])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        none = (None,) * len(result)
        part = own_kind = None
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                found = []
                part, own_kind = batch.column(2)[0].as_py(), batch.column(0).type
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    new = (k, t, tree(t))
                    if held is None:
                        found.append((k, part, t, True, *none))
                    else:
                        found.append((held[0], part, None, None, *compare(held[1], t, held[2], new[2])))
                    held = new
                if found:
                    yield out(found, own_kind)
        if held is not None:
            yield out([(held[0], part, held[1], False, *none)], own_kind)

    path = shared_path(spark, "merkle")
    ranged.mapInArrow(run, schema).write.parquet(path)
    found = spark.read.schema(schema).parquet(path)
    edges = found.where("edge is not null")
    heads = edges.where("head").select(F.col("part").alias("next_part"), F.col("edge").alias("after"))
    # One row per task in this window: which range with rows comes next.
    order = edges.where("head").select("part").withColumn("next_part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    last = edges.where("not head").join(order, "part").join(heads, "next_part").select("key", F.col("edge").alias("text"), "after")

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [compare(t, a, tree(t), tree(a)) for t, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = list(zip(*rows)) if rows else [()] * len(result)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, _, t) in zip(columns, result))], names=["key", *RESULT])

    tail = last.mapInArrow(join_edges, T.StructType([T.StructField("key", kind)] + [T.StructField(n, t) for n, t, _ in result]))
    return found.where("edge is null").select("key", *RESULT).unionByName(tail).withColumnRenamed("key", key)
