"""Language of documents and of their words by a linear-chain CRF (operator 4).

Each word has affix, character n-gram and lexicon features with a weight per language;
learned transitions join neighbouring words, and forward-backward gives each word's
distribution, so code-switched passages are labelled word by word. Documents are labelled
only as a whole, so training is in two steps: word labels start as their document's, are
then inferred by a chain with sticky transitions, and weights and transitions are fitted to
those by the CRF's likelihood. A document's language weighs the words' distributions over
the whole text, its opening and its close, with learned weights: a passage in another
language in the middle doesn't change the language of a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.crf import marginals
from textloom.llm.wordtable import WordTable, feature_slots, letters, sums, words_of

#: Bounds of the training sample: documents, chosen by hash over all that may be used, and the
#: characters of each (longer ones are left out of the sample, none is cut).
SAMPLE_DOCS, SAMPLE_CHARS = 800, 50_000
SLOTS = 1 << 17
LEXICON_WORDS = 400  # a language
ENDS = 12  # words that count as opening or close


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Affixes of one to four letters, character bigrams and trigrams, the word itself."""
    return feature_slots(words, SLOTS, prefixes=(1, 2, 3, 4), suffixes=(1, 2, 3, 4), grams=(2, 3))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # slot, language
    lexicon: dict[str, list[int]]  # word -> languages that use it often
    in_lexicon: np.ndarray  # lexicon language, language
    transition: np.ndarray
    start: np.ndarray
    document: np.ndarray  # weights of whole, opening, close

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log scores per language, then 1 if the word has a letter."""
        plain = [letters(w) for w in words]
        out = np.zeros((len(words), len(self.languages) + 1))
        out[:, :-1] = sums(self.weights, *features(plain), len(words))
        for i, w in enumerate(plain):
            for k in self.lexicon.get(w, ()):
                out[i, :-1] += self.in_lexicon[k]
        out[:, -1] = [bool(w) for w in plain]
        return out

    def table(self) -> WordTable:
        return WordTable(len(self.languages) + 1, self.emissions)

    def words(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distributions of the words with a letter, and their number in each text."""
        real = rows[:, -1] > 0
        own = np.add.reduceat(np.append(real, False), np.concatenate([[0], np.cumsum(counts)[:-1]])) * (counts > 0) if len(counts) else counts
        return marginals(rows[real, :-1], own, self.transition, self.start), own

    def texts(self, table: WordTable, texts: list[str | None]) -> list[tuple[str, float]]:
        _, rows, counts = table.look_up(texts)
        chances, own = self.words(rows, counts)
        out = scores(parts(chances, own), self.document)
        best = out.argmax(1)
        return [("und", 0.0) if not n else (self.languages[b], float(s[b])) for n, b, s in zip(own, best, out)]


def parts(chances: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(text, part, language): log mean distribution over the whole, opening and close."""
    labels = chances.shape[1]
    total = np.concatenate([np.zeros((1, labels)), np.cumsum(chances, axis=0)])
    end = np.cumsum(counts)
    begin = end - counts
    near = np.minimum(counts, ENDS)
    out = np.empty((len(counts), 3, labels))
    for i, (a, b) in enumerate(((begin, end), (begin, begin + near), (end - near, end))):
        out[:, i] = (total[b] - total[a]) / np.maximum(b - a, 1)[:, None]
    return np.log(out + 1e-3)


def scores(parts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = np.einsum("tpl,p->tl", parts, weights)
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit(texts: list[str], langs: list[str], steps: int = 30) -> Model | None:
    """Train on whole texts; None if none of them has a letter."""
    languages = sorted(set(langs))
    n = len(languages)
    seen: dict[str, int] = {}
    at, counts, truth = [], [], []
    by_lang = [Counter() for _ in languages]
    for text, lang in zip(texts, langs):
        own = [w for w in map(letters, words_of(text)) if w]
        if own:
            at += [seen.setdefault(w, len(seen)) for w in own]
            counts.append(len(own))
            truth.append(languages.index(lang))
            by_lang[truth[-1]].update(own)
    if not counts:
        return None
    at, counts, truth = np.array(at), np.array(counts), np.array(truth)
    vocabulary = list(seen)
    flat, word_of = features(vocabulary)
    lexicon: dict[str, list[int]] = {}
    for k, c in enumerate(by_lang):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]:
            lexicon.setdefault(w, []).append(k)
    listed = np.zeros((len(vocabulary), n))
    for w, ks in lexicon.items():
        listed[seen[w], ks] = 1
    weights, in_lexicon = np.zeros((SLOTS, n)), np.zeros((n, n))
    transition, start = np.eye(n) * 4, np.zeros(n)
    state = [np.zeros_like(x) for x in (weights, in_lexicon, transition, start)]

    def emissions() -> np.ndarray:
        return sums(weights, flat, word_of, len(vocabulary)) + listed @ in_lexicon

    def climb(rate: float, grads: list[np.ndarray]) -> None:
        """A step of AdaGrad on all parameters."""
        for x, s, g in zip((weights, in_lexicon, transition, start), state, grads):
            g = g - 1e-4 * x
            s += g * g
            x += rate * g / np.sqrt(s + 1e-8)

    def pull(gap: np.ndarray) -> list[np.ndarray]:
        """Gradients of the emission's parameters, from those of the words' scores."""
        words = np.stack([np.bincount(at, gap[:, k], len(vocabulary)) for k in range(n)], 1) / len(at)
        slot = np.stack([np.bincount(flat, words[word_of, k], SLOTS) for k in range(n)], 1)
        return [slot, listed.T @ words]

    labels = np.eye(n)[np.repeat(truth, counts)]
    for _ in range(steps // 2):  # words apart, labelled as their documents
        e = emissions()[at]
        p = np.exp(e - e.max(1, keepdims=True))
        climb(0.2, [*pull(labels - p / p.sum(1, keepdims=True)), 0 * transition, 0 * start])
    labels = marginals(emissions()[at], counts, transition, start)  # sticky: passages
    heads = np.cumsum(counts) - counts
    follows = np.ones(len(at), bool)
    follows[heads] = False
    later = np.flatnonzero(follows)
    moves = labels[later - 1].T @ labels[later]
    for _ in range(steps // 2):  # the chain's likelihood
        p, expected = marginals(emissions()[at], counts, transition, start, pairs=True)
        gap = labels - p
        climb(0.1, [*pull(gap), (moves - expected) / len(at), gap[heads].mean(0)])
    chances = marginals(emissions()[at], counts, transition, start)
    seen_parts = parts(chances, counts)
    document = np.ones(3)
    for _ in range(200):
        gap = np.eye(n)[truth] - scores(seen_parts, document)
        document += 0.5 * np.einsum("tl,tpl->p", gap, seen_parts) / len(truth)
        document = np.maximum(document, 0)
    return Model(languages, weights, lexicon, in_lexicon, transition, start, document)


def sample(docs: DataFrame, usable: Column, *, key: str, text: str, lang: str, most: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """Usable (text, lang) of the `most` ids that a hash puts first over all; at most twice as
    many rows, where ids come again. The same on every run."""
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    order = F.xxhash64(k, F.lit("train"))
    usable = usable & F.col(f"`{lang}`").isNotNull() & t.rlike(r"\p{L}") & (F.length(t) <= SAMPLE_CHARS)
    ids = docs.where(usable).select(order.alias("o"), k.alias("id")).orderBy("o", "id").limit(most).distinct()
    rows = docs.where(usable).join(F.broadcast(ids.select("id")), k == F.col("id"), "left_semi")
    # An id that comes again and again with other texts can't make the sample larger.
    picked = rows.select(order.alias("o"), k.alias("k"), t.alias("t"), F.col(f"`{lang}`").alias("l")).orderBy("o", "k", "t", "l").limit(2 * most)
    return [(r.t, r.l) for r in picked.collect()]


def predict(docs: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE_DOCS) -> DataFrame:
    """key, held_out, lang_pred and score of every row, from its whole text alone.

    Learns from rows that aren't held out and whose `lang` isn't null, at most `most`. Null
    texts and texts without a letter are `und` with score 0; with nothing to learn from, all
    are. Rows with a null key are held out. Repeated rows get equal results; other columns
    play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    aside = F.coalesce(held_out, F.lit(True))
    learnt = sample(docs, ~aside, key=key, text=text, lang=lang, most=most)
    model = spark.sparkContext.broadcast(fit([t for t, _ in learnt], [x for _, x in learnt]))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        words = own.table() if own else None
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                found = own.texts(words, batch.column(2).to_pylist()) if own else [("und", 0.0)] * batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                    names=[key, "held_out", "lang_pred", "score"],
                )

    rows = docs.select(F.col(f"`{key}`").alias("k"), aside.alias("h"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")
