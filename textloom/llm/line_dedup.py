"""Line dedup by a segment-partition edit join (operator 2).

Lines are near-equal within as many edits as the shorter one allows: of characters one for
each 10 of its characters, CHARS at most, or of words one for each 10 of its words, WORDS at
most. So spelling and numbers may differ in short lines, and whole words in long ones.

A line that allows k edits is cut into k + 1 segments at its start, whose size its length
band sets. Whatever is edited, some segment i survives after exactly i edits, so it stands in
a line that isn't shorter at a shift from -min(i, k - i) to i. Every line is indexed by its
segments and probes, for its own band and, where it is hardly longer, the band below, with
its substrings at those places. A pass over all lines counts which keys two lines meet in; a
second one brings the lines of those keys, which are compared by banded bit-parallel edit
distance, but only with lines that they aren't connected to yet (see `buckets`).

Keys are polynomial hashes from prefix sums, made for many lines at once. A Bloom filter of
bounded size picks the lines of the second pass, and an exact join takes out what it lets
through by mistake.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import buckets
from textloom.llm.common import WS, free_name, returned, written
from textloom.llm.components import components
from textloom.llm.url_filter import blooms, may_hold

#: Characters or words of a line for each edit, and the most edits of either kind.
EACH, CHARS, WORDS = 10, 2, 3
#: Lines that a task remembers in order not to index a repeated line each time.
SEEN_LINES = 200_000
#: Characters whose hashes are made at once (a longer line is one batch); bounds memory.
BATCH_CHARS = 1 << 19

#: What a blank line consists of; for bytes, what `isspace` and `strip` take.
BLANK = " \t\n\x0b\x0c\r"
_digest = xxhash.xxh3_128_digest
_split = re.compile(f"[^{WS}]+").findall
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def allowed(size: int, most: int) -> int:
    """Edits that a line of `size` characters or words allows."""
    return min(most, size // EACH)


def bands(most: int) -> list[int]:
    """The least size of each length band: a fifth more each, never across a change of what
    is allowed."""
    found, size = [], EACH
    while size < 1 << 31:
        found.append(size)
        further = max(size + most, size + size // 5)
        change = (size // EACH + 1) * EACH
        size = min(further, change) if size < EACH * most else further
    return found


def selection(edits: int) -> list[tuple[int, int]]:
    """(segment, shift) of the substrings that a line probes in a band of `edits` edits."""
    return [(i, s) for i in range(edits + 1) for s in range(-min(i, edits - i), i + 1)]


def edit_distance(a, b, most: int) -> int:
    """Edits between the strings or lists a and b, or most + 1 if there are more.

    What both begin and end with is stripped; the rest runs through a bit-parallel column
    of differences that holds only the diagonals within `most` of the main one.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    lo, hi = 0, len(a)
    while lo < hi:  # longest common start, by halves
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[lo:], b[lo:]
    lo, hi = 0, len(a)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    m, n = len(a), len(b)
    if not m:
        return n
    # Bit k of the band's words is row j - most + k of column j; rows above 0 never match.
    width = 2 * most + 1
    band, top = (1 << width) - 1, 1 << (width - 1)
    plus, minus = band & ~((1 << most) - 1), 0
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + most)
    score = min(m, most)  # of the band's lowest row that there is
    for j, c in enumerate(b):
        # The band moves down by one row with each column.
        match = where.get(c, 0) >> j & band
        x = match | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & band
        across_plus = minus | (~(d0 | plus) & band)
        across_minus = d0 & plus
        if j + most < m:
            score += not d0 & top
        else:
            bit = 1 << (m - 1 - j + most)  # the last row, which rises in the band
            score += bool(across_plus & bit) - bool(across_minus & bit)
        y = d0 >> 1
        plus = (across_minus | (~(y | across_plus) & band)) & band
        minus = y & across_plus
    return min(score, most + 1)


class _Powers:
    """Powers of the hashes' base and of its inverse modulo 2 ** 64, as many as needed yet."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def forget(self) -> None:
        """Keep no more than batches of usual lines need."""
        self.up, self.down = (x[: 2 * BATCH_CHARS].copy() for x in (self.up, self.down))

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(size - 1, x, np.uint64)), dtype=np.uint64) for x in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(_BASE)
    return h


class Hashed:
    """A sequence of symbols whose substrings have hashes of what stands in them."""

    def __init__(self, symbols: np.ndarray) -> None:
        up, self.down = _powers.first(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        sums = self.sums[1:]
        np.add(symbols, np.uint64(1), out=sums)
        sums *= up[:-1]
        np.cumsum(sums, out=sums)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.down[begin])


class Lines:
    """Many lines at once: their characters and words, keys and marks."""

    def __init__(self, lines: list[str]) -> None:
        self.text = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.chars = np.fromiter(map(len, lines), np.int64, len(lines))
        self.first = np.cumsum(self.chars + 1) - self.chars - 1
        self.by_char = Hashed(self.text)
        blank = (self.text == 32) | (self.text - np.uint32(9) <= 4)  # below 9 it wraps
        change = np.flatnonzero(blank != np.append(True, blank[:-1]))
        begin, end = change[::2], change[1::2]  # a line end closes every word
        self.word_hashes = self.by_char.of(begin, end)
        self.first_word = np.searchsorted(begin, self.first)
        self.words = np.diff(np.append(self.first_word, len(begin)))
        self.by_word = Hashed(self.word_hashes)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, line number, whether the line is indexed under it) of all lines: keys
        without the mark are only probed."""
        parts = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool))]
        for kind, hashed, first, size, most in ((0, self.by_char, self.first, self.chars, CHARS), (1, self.by_word, self.first_word, self.words, WORDS)):
            least = np.array(bands(most))
            band = np.searchsorted(least, size, "right") - 1
            for lower in (0, 1):  # its own band, and the one below if a line there is near
                for k in range(1, most + 1):
                    near = band - lower
                    on = near >= 0
                    on[on] = np.minimum(most, least[near[on]] // EACH) == k
                    if lower:
                        on[on] = size[on] - k < least[band[on]]
                    at = np.flatnonzero(on)
                    if not len(at):
                        continue
                    segment = least[near[at]] // (k + 1)
                    tag = _mixed((near[at] * 2 + kind).astype(np.uint64))
                    i, shift = np.array(selection(k)).T
                    begin = np.multiply.outer(i, segment) + shift[:, None]
                    nth, of = np.nonzero((begin >= 0) & (begin + segment <= size[at]))
                    to = first[at[of]] + begin[nth, of]
                    key = _mixed(hashed.of(to, to + segment[of]) ^ tag[of] ^ i[nth].astype(np.uint64))
                    parts.append((key, at[of], (shift[nth] == 0) & (not lower)))
        key, line, own = (np.concatenate(x) for x in zip(*parts))
        return key.view(np.int64), line, own

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """64 parities of each line's characters and of its words: an edit changes two."""
        one = np.uint64(1)
        chars = np.bitwise_xor.reduceat(one << (self.text & np.uint32(63)).astype(np.uint64), self.first)
        words = np.zeros(len(self.chars), np.uint64)
        some = self.words > 0
        if some.any():
            words[some] = np.bitwise_xor.reduceat(one << (self.word_hashes >> np.uint64(58)), self.first_word[some])
        return chars.view(np.int64), words.view(np.int64)


def near_lines_of(a: str, b: str) -> bool:
    """Whether two lines are near-equal."""
    k = allowed(min(len(a), len(b)), CHARS)
    if abs(len(a) - len(b)) <= k and edit_distance(a, b, k) <= k:
        return True
    a, b = _split(a), _split(b)
    k = allowed(min(len(a), len(b)), WORDS)
    return k > 0 and abs(len(a) - len(b)) <= k and edit_distance(a, b, k) <= k


def _ids(digests: list[bytes]) -> np.ndarray:
    """The first half of each digest as a number."""
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)[:, 0] if digests else np.empty(0, np.int64)


class _Seen(set):
    """Lines met lately; forgets them all when there are too many."""

    def new(self, digest: bytes) -> bool:
        if digest in self:
            return False
        if len(self) >= SEEN_LINES:
            self.clear()
        self.add(digest)
        return True


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches, and the lines of their texts in UTF-8."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 128):
            batch = whole.slice(begin, 128)
            yield batch, [t.split(b"\n") if t is not None else [] for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _real_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Lines long enough to have near-equals, each once as far as the task remembers."""
    with returned():
        yield from _new_lines(batches)
        _powers.forget()


def _new_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    seen, found, digests, size = _Seen(), [], [], 0
    for _, texts in _texts(batches, 0):
        for lines in texts:
            for line in lines:
                if len(line) >= EACH and not line.isspace() and seen.new(d := _digest(line)) and len(content := line.decode()) >= EACH:
                    found.append(content)
                    digests.append(d)
                    size += len(content)
                    if size >= BATCH_CHARS:
                        yield found, digests
                        found, digests, size = [], [], 0
    if found:
        yield found, digests


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, t and text: t tells texts under one key apart; equal rows are one document."""
    return docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("text"))


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, t, no (from 0) and 128-bit digest of every line; null digest: a blank line."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, 2):
            counts = [len(x) for x in texts]
            at = np.repeat(np.arange(len(counts)), counts)
            digests = [_digest(line) if line.strip() else None for lines in texts for line in lines]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array([i for n in counts for i in range(n)], pa.int32()), pa.array(digests, pa.binary())],
                names=["key", "t", "no", "line"],
            )

    return identified(docs, key, text).mapInArrow(run, f"key {kind}, t bigint, no int, line binary")


def line_keys(texts: DataFrame) -> DataFrame:
    """key, id and own of all lines: see `Lines.keys`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, digests in _real_lines(batches):
            key, line, own = Lines(lines).keys()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(_ids(digests)[line]), pa.array(own)], names=["key", "id", "own"])

    return texts.mapInArrow(run, "key bigint, id bigint, own boolean")


def met_lines(texts: DataFrame, live: DataFrame) -> DataFrame:
    """line (digest), content, sizes, marks and keys (with `own`) of the lines that have
    keys in `live`, and of some more that the filter lets through."""
    filled = texts.sparkSession.sparkContext.broadcast(blooms(live)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, digests in _real_lines(batches):
            made = Lines(lines)
            key, line, own = made.keys()
            kept = np.flatnonzero(may_hold(filled.value, key))
            if not len(kept):
                continue
            kept = kept[np.argsort(line[kept], kind="stable")]
            at, counts = np.unique(line[kept], return_counts=True)
            ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
            marks = [m[at] for m in made.marks()]
            columns = [pa.array([digests[i] for i in at], pa.binary()), pa.array([lines[i] for i in at], pa.string()), pa.array(made.chars[at]), pa.array(made.words[at]), *map(pa.array, marks)]
            columns += [pa.ListArray.from_arrays(ends, pa.array(key[kept])), pa.ListArray.from_arrays(ends, pa.array(own[kept]))]
            yield pa.RecordBatch.from_arrays(columns, names=["line", "content", "chars", "words", "char_mark", "word_mark", "keys", "owns"])

    return texts.mapInArrow(run, "line binary, content string, chars bigint, words bigint, char_mark bigint, word_mark bigint, keys array<bigint>, owns array<boolean>")


def _near(batch: pa.RecordBatch):
    """The comparisons of `buckets.links` for lines."""
    chars, words, char_mark, word_mark, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chars", "words", "char_mark", "word_mark", "own_key"))
    content = batch.column("content")

    def likely(at: np.ndarray, y: int | np.ndarray) -> np.ndarray:
        near = np.zeros(len(at), bool)
        for size, mark, most in ((chars, char_mark, CHARS), (words, word_mark, WORDS)):
            k = np.minimum(most, np.minimum(size[at], size[y]) // EACH)
            near |= (k > 0) & (np.abs(size[at] - size[y]) <= k) & (np.bitwise_count((mark[at] ^ mark[y]).view(np.uint64)) <= 2 * k)
        return at[near & (own[at] | own[y])]

    return likely, lambda x, y: near_lines_of(content[x].as_py(), content[y].as_py())


def near_lines(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """x, y: digests of near-equal lines, a forest that connects what all pairs connect."""
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    keys = line_keys(texts).groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max("own").alias("own"))
    live = written(keys.where("a <> b and own").select(F.col("key").alias("h")), "live-keys")
    met = written(met_lines(texts, live).dropDuplicates(["line"]), "met-lines")
    rows = met.select(*[c for c in met.columns if c not in ("keys", "owns")], F.explode(F.arrays_zip("keys", "owns")).alias("k"))
    rows = rows.select("*", F.col("k.keys").alias("bucket"), F.col("k.owns").alias("own_key")).drop("k")
    rows = written(rows.join(live, rows["bucket"] == live["h"], "left_semi"), "line-buckets")
    return written(buckets.links(rows, "bucket", "line", _near), "line-links")


def decide(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line: key, t, no, class_key, class_no, class_texts and kept.

    Lines are what stands between line feeds. A class is what equality and near-equality
    connect; its first line, by ascending key (null last), then line number, names it and is
    the only one kept. class_texts counts the different texts in the class. A line under 10
    characters allows no edit, so it is connected to equal ones only.
    Blank lines are classes of their own and always kept. A null text has no lines, an empty
    one a blank line. Rows that repeat key and text are one document, whose lines come as
    often as it does and are decided alike; rows with the same key but other texts are told
    apart by t. Lines of any length take part whole. An empty table gives an empty result.
    """
    lines = written(line_table(docs, key, text), "lines")
    roots = components(near_lines(docs, text=text), "x", "y").withColumnRenamed("node", "line")
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("no"), F.col("t"))
    real = lines.where("line is not null")
    # Only lines that come again or have links are looked up, and from tables, not aggregates:
    # so the joins stay plain shuffles, of which skew handling splits a line's copies.
    once = real.groupBy("line").agg(F.min(order).alias("own"), F.count(F.lit(1)).alias("copies"))
    again = once.join(roots, "line", "left").where("copies > 1 or root is not null")
    again = written(again.select("line", "own", F.coalesce("root", "line").alias("class")), "lines-again")
    firsts = written(again.groupBy("class").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("class_texts")), "class-firsts")
    named = written(again.join(firsts, "class").select("line", "class_texts", "first"), "named-lines")
    first, one = F.coalesce("first", order), F.lit(1).cast("long").alias("class_texts")
    real = real.join(named, "line", "left").select("key", "t", "no", first["key"].alias("class_key"), first["no"].alias("class_no"), F.coalesce("class_texts", one).alias("class_texts"), (order == first).alias("kept"))
    blank = lines.where("line is null").select("key", "t", "no", F.col("key").alias("class_key"), F.col("no").alias("class_no"), one, F.lit(True).alias("kept"))
    return real.unionByName(blank).withColumnRenamed("key", key)


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """`docs` with only the kept lines in their texts; `length`, if there, counted anew.

    Every row stays, even one that has lost all its lines: its text is then empty. Of rows
    that repeat key and text all lose or keep the same lines.
    """
    gone = decide(docs, key=key, text=text).where("not kept")
    k, t, drop = (free_name(docs, x) for x in ("key", "t", "drop"))
    gone = gone.groupBy(F.col(key).alias(k), F.col("t").alias(t)).agg(F.collect_set("no").alias(drop))
    rows = docs.join(gone, F.col(f"`{key}`").eqNullSafe(F.col(k)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(t)), "left").drop(k, t)
    at, names = docs.columns.index(text), docs.columns
    lengthy = names.index(length) if length in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 128):
                batch = whole.slice(begin, 128)
                texts = batch.column(at).to_pylist()
                drops = batch.column(len(names)).to_pylist()
                for i, d in enumerate(drops):
                    if d:
                        d = set(d)
                        texts[i] = "\n".join(x for n, x in enumerate(texts[i].split("\n")) if n not in d)
                columns = [batch.column(i) for i in range(len(names))]
                columns[at] = pa.array(texts, pa.string())
                if lengthy >= 0:
                    columns[lengthy] = pa.array([len(x) if d else old for x, d, old in zip(texts, drops, columns[lengthy].to_pylist())], columns[lengthy].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.select(*[F.col(f"`{c}`") for c in names], F.col(drop)).mapInArrow(run, docs.schema)
