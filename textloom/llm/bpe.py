"""BPE encoding and decoding (operator 10).

A word's symbols form a doubly linked list; a priority queue holds the rank of every
adjacent pair that the vocabulary can merge. The lowest rank is merged first, entries whose
symbols have changed since are skipped as stale, and each merge pushes the two new pairs.
Decoding concatenates the vocabulary strings. Every text is encoded whole; words repeat, so
each worker keeps the ids of words it has met lately (see `CACHE_WORDS`).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import returned

#: Words in a generation of a worker's memory, which holds two; bounds memory, not results.
CACHE_WORDS = 400_000

#: White space as the vocabulary's rules see it.
WHITE = "\t-\r \x85\xa0  -     　"

#: Letters, numbers and lower-case forms of Unicode 16 and 17 that the tokenizers
#: library knows and older character tables don't; (first, last) and (first, last, lower first).
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
NEW_LOWER = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)

#: Capital letters that `str.lower` treats otherwise than letter by letter, or doesn't know.
_LOWER = {0x3A3: 0x3C3} | {a + i: low + i for a, b, low in NEW_LOWER for i in range(b - a + 1)}


def character_class(kind: str, new: tuple) -> str:
    """The inside of a character class: all of a general category (L or N) and `new`."""
    found = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == kind:
            if found and found[-1][1] == c - 1:
                found[-1][1] = c
            else:
                found.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in [*found, *new])


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBPE:
    """Encoder and decoder for a vocabulary file whose words carry an end mark."""

    def __init__(self, spec: dict, cache_words: int = CACHE_WORDS):
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in vocab.items()}
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + end] for b in range(256)]
        # A pair of symbols is one number, and so is a queue entry: rank, then position.
        self.ranks: dict[int, int] = {}
        self.pairs: list[int] = []
        self.merged: list[int] = []
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks[vocab[a] << 20 | vocab[b]] = rank
            self.pairs.append(vocab[a] << 20 | vocab[b])
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s for s, i in self.special.items()}
        pretokens = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for named, plain in ((r"\s", WHITE), (r"\p{L}", character_class("L", NEW_LETTERS)), (r"\p{N}", character_class("N", NEW_NUMBERS))):
            pretokens = pretokens.replace(named, plain)
        self.split = re.compile(pretokens).findall
        self.words = re.compile(f"[^{WHITE}]+").findall
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_start = {s[:1] for s in by_length}
        self.cut = re.compile("(" + "|".join(map(re.escape, by_length)) + ")").split if by_length else None
        self.packed_words = _Lately(self.word, cache_words)
        self.packed_pieces = _Lately(self.piece, cache_words // 2)

    @classmethod
    def from_file(cls, path: str, **kw) -> WordBPE:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f), **kw)

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece, by merging its symbols in order of rank."""
        data = piece.encode()
        ids = [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]
        n = len(ids)
        if n == 1:
            return ids
        rank_of, pairs = self.ranks.get, self.pairs
        queue = []
        for i in range(n - 1):
            if (r := rank_of(ids[i] << 20 | ids[i + 1])) is not None:
                queue.append(r << 32 | i)
        if not queue:
            return ids
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            entry = pop(queue)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j < 0 or ids[i] < 0 or ids[i] << 20 | ids[j] != pairs[r]:
                continue  # stale: one of the two has been merged since
            ids[i] = new = self.merged[r]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of(new << 20 | ids[k])) is not None:
                    push(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank_of(ids[h] << 20 | new)) is not None:
                push(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> bytes:
        return array("I", self.merge(piece)).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a run without white space, packed as little-endian 32-bit integers."""
        if self.cut and not self.special_start.isdisjoint(word):
            parts = self.cut(word)
            if len(parts) > 1:
                return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self.word(p) for p in parts)
        if not word.isascii():
            # Lower case letter by letter: a final capital sigma has no form of its own.
            word = unicodedata.normalize("NFC", word).translate(_LOWER)
        return b"".join(map(self.packed_pieces.__getitem__, self.split(word.lower())))

    def encode_packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        self.packed_words.trim()
        self.packed_pieces.trim()
        return b"".join(map(self.packed_words.__getitem__, self.words(text)))

    def encode(self, text: str | None) -> list[int]:
        ids = array("I")
        ids.frombytes(self.encode_packed(text))
        return ids.tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary strings of `ids`, one after the other, parted by a space."""
        return " ".join(map(self.strings.__getitem__, ids))


class _Lately(dict):
    """What `make` gave for the keys met lately: two generations of at most `most` keys."""

    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most, {}

    def trim(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:  # a huge word hardly comes twice and would fill the memory
            self[key] = value
        return value


_LOADED: dict[str, WordBPE] = {}


def _load(path: str) -> WordBPE:
    if path not in _LOADED:
        _LOADED[path] = WordBPE.from_file(path)
    return _LOADED[path]


def encode(docs: DataFrame, vocabulary: str, *, text: str = "text", ids: str | None = "ids", decoded: str | None = None, digests: bool = False) -> DataFrame:
    """Every row of `docs` with the token ids of its whole text.

    `ids` names an added array<int> column, `decoded` an added string column (None: left
    out); `digests` adds n_tokens, ids_sha256 and decoded_sha256. Added columns replace
    columns of the same name (in any case). Null and empty texts have no tokens and decode to the empty
    string; repeated rows are encoded alike; an empty table stays empty. The vocabulary file
    goes to every executor through Spark; it is a parameter and never copied elsewhere.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))] if ids else []
    added += [T.StructField(decoded, T.StringType())] if decoded else []
    if digests:
        added += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    new = {f.name.lower() for f in added}
    kept = [c for c in docs.columns if c.lower() not in new]
    wanted = [*kept, *([] if text in kept else [text])]
    schema = T.StructType([docs.schema[c] for c in kept] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(SparkFiles.get(name))
        with returned():
            try:
                yield from encoded(bpe, batches)
            finally:  # the vocabulary stays for the next task, the words met don't
                bpe.packed_words.forget()
                bpe.packed_pieces.forget()

    def encoded(bpe: WordBPE, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                out: dict[str, list] = {f.name: [] for f in added}
                all_ids: list[bytes] = []
                for t in batch.column(wanted.index(text)).to_pylist():
                    packed = bpe.encode_packed(t)
                    row = array("I")
                    row.frombytes(packed)
                    if ids:
                        all_ids.append(packed)
                    if decoded or digests:
                        back = bpe.decode(row)
                        if decoded:
                            out[decoded].append(back)
                    if digests:
                        out["n_tokens"].append(len(row))
                        out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
                if ids:
                    ends = np.cumsum([0, *(len(p) // 4 for p in all_ids)], dtype=np.int32)
                    out[ids] = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(all_ids), np.int32))
                kind = {"n_tokens": pa.int64()}
                columns = [batch.column(wanted.index(c)) for c in kept]
                columns += [v if k == ids else pa.array(v, kind.get(k, pa.string())) for k, v in out.items()]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *out])

    return docs.select(*[F.col(f"`{c}`") for c in wanted]).mapInArrow(run, schema)
