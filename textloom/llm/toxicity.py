"""Counterfactual-regularised toxicity classifier (operator 9).

A sentence's logit is a bias plus its words' scores, a word's score the sum of the weights
of its word, affix and trigram features; a text is as toxic as its worst sentence.
Labels are on documents only, so training goes in rounds: all sentences of a toxic document
count as toxic at first, then only those the last round found to be the cause. In each
labelled sentence every identity term is swapped for each other term of its group, and the
squared change of the sentence's score is penalised: a model that finds a sentence toxic
because of whom it mentions pays for it, so a neutral mention of a group costs nothing.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import free_name, returned
from textloom.llm.wordtable import WordTable, feature_slots, letters, sums, words_of

#: Bounds of the training sample: toxic documents, chosen by hash over all, how many times as
#: many clean ones, and the characters of each (longer ones are left out of the sample).
SAMPLE_DOCS, CLEAN_TIMES, SAMPLE_CHARS = 1000, 3, 20_000
SLOTS = 1 << 18
#: What goes on without a stop is scored in sentences of this many words; each word is in one.
SENTENCE = 40
#: Weight of the counterfactual penalty and of the squared weights.
SWAP_PENALTY, DECAY = 100.0, 1e-6

#: Terms for groups of people that can stand for each other in a sentence.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs", "hindous"), ("noirs", "blancs", "arabes", "asiatiques"), ("immigrés", "réfugiés", "étrangers"),
    ("frauen", "männer"), ("muslime", "christen", "juden", "hindus"), ("schwarze", "weiße", "araber", "asiaten"), ("einwanderer", "flüchtlinge", "ausländer"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos", "hindúes"), ("negros", "blancos", "árabes", "asiáticos"), ("inmigrantes", "refugiados", "extranjeros"),
)

#: Keeps AdaGrad from taking full steps for features that hardly occur.
DAMP = 1e-5

_ENDS = ".!?…。！？"


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return feature_slots(words, SLOTS, prefixes=(3, 4, 5), suffixes=(3,))


def ends(word: str) -> bool:
    """Whether a full stop, exclamation or question mark follows the word's letters."""
    if word[-1].isalpha():
        return False
    i = len(word)
    while i and not word[i - 1].isalnum():
        i -= 1
    return any(c in _ENDS for c in word[i:])


def sentence_starts(stop: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where sentences begin among the words of many texts: after a stop, at the first
    word of a text, and every SENTENCE words where no stop comes."""
    n = len(stop)
    begins = np.zeros(n + 1, bool)
    begins[1:] = stop
    begins[(np.cumsum(counts) - counts)[counts > 0]] = True
    at = np.flatnonzero(begins[:n])
    since = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    return np.flatnonzero(since % SENTENCE == 0)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float  # of a text's logit on that of its worst sentence
    shift: float

    def rows(self, words: list[str]) -> np.ndarray:
        """Each word's score, whether it ends a sentence, and a number for its letters (a
        hash that a float holds): words that differ in their signs only are one."""
        plain = [letters(w) for w in words]
        out = np.empty((len(words), 3))
        out[:, 0] = sums(self.weights[:, None], *features(plain), len(words))[:, 0]
        out[:, 1] = [ends(w) for w in words]
        out[:, 2] = [xxhash.xxh3_64_intdigest(w) >> 11 for w in plain]
        return out

    def table(self) -> WordTable:
        return WordTable(3, self.rows)

    def texts(self, table: WordTable, texts: list[str | None]) -> np.ndarray:
        """Score (0 to 1) of each whole text."""
        _, rows, counts = table.look_up(texts)
        logit = self.shift + self.slope * worst(rows, counts, self.bias)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def first_in_sentence(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where a word comes for the first time in its sentence: only there does it count."""
    sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
    _, first = np.unique(sentence * (int(at.max()) + 1) + at, return_index=True)
    return np.sort(first)


def worst(rows: np.ndarray, counts: np.ndarray, bias: float) -> np.ndarray:
    """Logit of the worst sentence of each text; a text without words has the bias only."""
    out = np.full(len(counts), bias)
    if len(rows):
        starts = sentence_starts(rows[:, 1] > 0, counts)
        once = np.zeros(len(rows))
        _, at = np.unique(rows[:, 2], return_inverse=True)
        new = first_in_sentence(at, starts)
        once[new] = rows[new, 0]
        sentence = np.add.reduceat(once, starts) + bias
        some = counts > 0
        first = np.searchsorted(starts, (np.cumsum(counts) - counts)[some])
        out[some] = np.maximum.reduceat(sentence, first)
    return out


def swapped(at: np.ndarray, sentence_of: np.ndarray, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, term, other, whether other is in the sentence already) of all swaps.

    `at` are the different words of each sentence and `pairs` (term, other) by word number.
    """
    term, other = np.array(pairs).T
    order = np.argsort(term, kind="stable")
    term, other = term[order], other[order]
    met = np.flatnonzero(np.isin(at, term))
    low, high = np.searchsorted(term, at[met], "left"), np.searchsorted(term, at[met], "right")
    where = np.repeat(met, high - low)
    nth = np.arange(len(where)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    new = other[np.repeat(low, high - low) + nth]
    width = int(max(at.max(initial=0), term.max(), other.max())) + 1
    there = np.isin(sentence_of[where] * width + new, sentence_of * width + at)
    return sentence_of[where], at[where], new, there


def swap_penalty(word: np.ndarray, logit: np.ndarray, at: np.ndarray, sentence_of: np.ndarray, swaps: tuple) -> tuple[float, np.ndarray, float]:
    """The mean squared change of a sentence's score when a term is swapped, and its
    gradient by the words' scores `word` and by the bias; `logit` are the sentences'."""
    sentence, term, other, there = swaps
    if not len(sentence):
        return 0.0, np.zeros(len(word)), 0.0
    score = 1 / (1 + np.exp(-np.clip(logit[sentence], -500, 500)))
    change = np.where(there, 0.0, word[other]) - word[term]
    after = 1 / (1 + np.exp(-np.clip(logit[sentence] + change, -500, 500)))
    gap = score - after
    own = 2 * gap * score * (1 - score) / len(gap)  # by the sentence's logit
    new = -2 * gap * after * (1 - after) / len(gap)  # by the swapped sentence's logit
    both = np.bincount(sentence, own + new, len(logit))
    by_word = np.bincount(at, both[sentence_of], len(word)) - np.bincount(term, new, len(word)) + np.bincount(other, np.where(there, 0.0, new), len(word))
    return float((gap**2).mean()), by_word, float(both.sum())


def fit(texts: list[str], toxic: list[int], rounds: int = 3, steps: int = 40) -> Model:
    """Train on whole texts; equal texts count once. Needs both labels to learn anything."""
    unique = dict(zip(texts, toxic))
    texts, truth = list(unique), np.array(list(unique.values()), bool)
    if truth.all() or not truth.any():
        sure = 6.0 if len(truth) and truth.all() else -6.0
        return Model(np.zeros(SLOTS), 0.0, 0.0, sure)
    seen: dict[str, int] = {}
    at, stop, counts = array("q"), bytearray(), []
    for text in texts:
        words = words_of(text)
        at.extend(seen.setdefault(letters(w), len(seen)) for w in words)
        stop.extend(map(ends, words))
        counts.append(len(words))
    at, counts = np.frombuffer(at, np.int64), np.array(counts, np.int64)
    starts = sentence_starts(np.frombuffer(stop, np.bool_), counts)
    length = np.diff(np.append(starts, len(at)))
    sentence_of = np.repeat(np.arange(len(starts)), length)
    document = np.repeat(np.arange(len(counts)), counts)[starts]
    new = first_in_sentence(at, starts)
    at, sentence_of = at[new], sentence_of[new]
    pairs = [(seen.setdefault(term, len(seen)), seen.setdefault(other, len(seen))) for group in IDENTITY_TERMS for term in group for other in group if other != term]
    swaps = swapped(at, sentence_of, pairs)
    vocabulary = list(seen)
    slot, word_of = features(vocabulary)
    weights, bias = np.zeros(SLOTS), np.zeros(1)
    squares, bias_squares = np.zeros(SLOTS), np.zeros(1)
    label = truth[document].astype(float)
    share = np.where(truth, 0.5 / truth.sum(), 0.5 / (~truth).sum())
    weight = (share / np.maximum(np.bincount(document, minlength=len(truth)), 1))[document]
    for turn in range(rounds):
        for _ in range(steps):
            word = np.bincount(word_of, weights[slot], len(vocabulary))
            logit = np.bincount(sentence_of, word[at], len(starts)) + bias
            gap = weight * (label - 1 / (1 + np.exp(-np.clip(logit, -500, 500))))
            pull = np.bincount(at, gap[sentence_of], len(vocabulary))
            _, by_word, by_bias = swap_penalty(word, logit, at, sentence_of, swaps)
            pull -= SWAP_PENALTY * by_word
            grad = np.bincount(slot, pull[word_of], SLOTS) - DECAY * weights
            squares += grad * grad
            weights += 0.3 * grad / np.sqrt(squares + DAMP)
            up = gap.sum() - SWAP_PENALTY * by_bias
            bias_squares += up**2
            bias += 0.3 * up / np.sqrt(bias_squares + 1e-12)
        word = np.bincount(word_of, weights[slot], len(vocabulary))
        logit = np.bincount(sentence_of, word[at], len(starts)) + bias
        peak = np.full(len(truth), -np.inf)
        np.maximum.at(peak, document, logit)
        peak[np.isinf(peak)] = bias[0]
        # Of toxic texts keep the sentences that are the cause: the worst and all near it.
        if turn < rounds - 1:
            cause = (logit >= peak[document] - 1e-9) | (logit > np.maximum(0.0, peak[document] / 2))
            toxic_weight = np.where(truth[document] & cause, 1.0, 0.0)
            total = np.maximum(np.bincount(document, toxic_weight, len(truth)), 1e-9)
            weight = np.where(truth[document], share[document] * toxic_weight / total[document], weight)
    slope, shift = 1.0, 0.0
    for _ in range(300):
        gap = share * (truth - 1 / (1 + np.exp(-np.clip(slope * peak + shift, -500, 500))))
        slope, shift = max(slope + 0.2 * (gap * peak).sum(), 1e-3), shift + 0.5 * gap.sum()
    return Model(weights, float(bias[0]), float(slope), float(shift))


def sample(docs: DataFrame, labels: DataFrame, usable: Column, *, key: str, text: str, label: str, most: int = SAMPLE_DOCS) -> list[tuple[str, int]]:
    """Usable (text, label) of `most` toxic and CLEAN_TIMES as many clean ids at most, those
    that a hash puts first over all; at most twice as many rows, where ids come again. The
    same on every run. A document labelled more than once counts as toxic if any of its labels
    says so.
    """
    k = F.col(f"`{key}`")
    marks = labels.where(k.isNotNull() & F.col(f"`{label}`").isNotNull() & usable).groupBy(k.alias("id")).agg((F.max(f"`{label}`") > 0).cast("int").alias("y"))
    order = [F.xxhash64("id", F.lit("train")), F.col("id")]
    picked = marks.where("y = 1").orderBy(*order).limit(most).unionAll(marks.where("y = 0").orderBy(*order).limit(CLEAN_TIMES * most))
    rows = docs.select(k.alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).where(F.length("t") <= SAMPLE_CHARS).join(F.broadcast(picked), "id")
    return [(r.t, r.y) for r in rows.orderBy("id", "t", "y").limit(2 * (1 + CLEAN_TIMES) * most).collect()]


def train(docs: DataFrame, labels: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE_DOCS) -> Model:
    learnt = sample(docs, labels, ~held_out, key=key, text=text, label=label, most=most)
    return fit([t for t, _ in learnt], [y for _, y in learnt])


def scored(docs: DataFrame, model: Model, *, text: str = "text", score: str = "score") -> DataFrame:
    """`docs` with the score (0 to 1) of each whole text as last column.

    Null and empty texts get a score too. A column that is there under the name `score` is
    replaced; all other columns stay as they are.
    """
    from pyspark.sql import types as T

    kept = [c for c in docs.columns if c.lower() != score.lower()]
    at = kept.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with returned():
            yield from judged(batches)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        words = own.table()
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                found = own.texts(words, batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*kept, score])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def predict(docs: DataFrame, labels: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE_DOCS) -> DataFrame:
    """key, held_out, score and predicted (1 from a score of 0.5) of every row of `docs`.

    `held_out` is a condition on the key; rows with a null key are held out. Only labels of
    rows that aren't are learnt from. Repeated rows get equal results; an empty table gives
    an empty result; without labels of both kinds all rows get the same score.
    """
    aside = F.coalesce(held_out, F.lit(True))
    model = train(docs, labels, aside, key=key, text=text, label=label, most=most)
    rows = docs.select(F.col(f"`{key}`"), aside.alias("held_out"), F.col(f"`{text}`").alias("__text"))
    rows = scored(rows, model, text="__text")
    return rows.select(F.col(f"`{key}`"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, held_out: Column, *, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of `docs` that score below 0.5, with all their columns."""
    model = train(docs, labels, F.coalesce(held_out, F.lit(True)), key=key, text=text, label=label, most=most)
    name = free_name(docs, "score")
    return scored(docs, model, text=text, score=name).where(F.col(name) < 0.5).drop(name)
