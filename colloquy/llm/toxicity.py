"""Toxicity by class-conditional Kneser-Ney models with shared backoff.

Each class, toxic and ordinary, has a model of the characters of words. The longest contexts
(the six characters before, or all since the word's start) are counted for each class; their
discounted mass goes to shorter contexts, whose continuation counts are shared: they are those
of both classes together. So a rare expression gets what both classes know of its parts, and
only what one class has seen more of speaks for it. A toxic text is taken for a mixture: of its
words a small share comes from the toxic model and the rest from the ordinary one. Its evidence
is the difference of the two log-likelihoods over the number of its words, drawn towards none in
very short texts; the score is a logistic function of this evidence alone, whose two constants
are fitted on labelled texts by models that were counted without them.

Where neither class has seen a gram, both chances back off to the same shared one, which
cancels; the ratio of the two backoff weights is left. So the model that is shipped has a number
for each gram and for each context, in arrays sorted by hash, and no shorter ones.

Learned from a bounded sample: at most `sample` labelled texts of each class (those with the
smallest hash of the id), each whole. Their words are counted in Spark. Scoring covers every
whole text.

Defined results: a null or empty text, or one without letters, has no evidence and gets the
score of that; repeated rows are scored each; labels that are null or other than 0 and 1 are
none; of labels that repeat an id the larger counts, and of texts that do one is learned from; if a class has no labelled text, every
score is 0; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Spelled, bounded_sample, found_in, let_go, remainder, stored, table, text_batches, word_lists, words

ORDER = 7
DISCOUNT = 0.75
SAMPLE = 1200
MIXED = 0.01  # the share of a toxic text's words that are its class's own
CHUNK = 1 << 14  # words that are spelled at once
SHORT = 10  # words' worth of no evidence that every text has besides its own


def top(spelled: Spelled) -> tuple[np.ndarray, ...]:
    """Of every character but the starts: its place, its longest gram, that one's context, its gram
    without the first character, and how long that is."""
    at = np.flatnonzero(spelled.place > 0).astype(np.int32)
    n = np.minimum(spelled.place[at] + 1, ORDER).astype(np.int8)
    gram, context, rest = (np.zeros(len(at), np.uint64) for _ in range(3))
    for k, (shorter, grams) in enumerate(spelled.grams(ORDER), 1):
        here = n == k
        gram[here], context[here], rest[here] = grams[at[here]], shorter[at[here] - 1], shorter[at[here]]
    return at, gram, context, rest, n - 1


class Merged:
    """Different keys, each with the columns of its first row and the sums of its weights."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.columns: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []

    def add(self, keys: np.ndarray, columns: list[np.ndarray], weights: list[np.ndarray]) -> None:
        every, first, one = np.unique(np.concatenate([self.keys, keys]), return_index=True, return_inverse=True)
        old = self.columns or [c[:0] for c in columns]
        self.columns = [np.concatenate([x, y])[first] for x, y in zip(old, columns, strict=True)]
        sums = self.sums or [np.zeros(0) for _ in weights]
        self.sums = [np.bincount(one, np.concatenate([x, y]), len(every)) for x, y in zip(sums, weights, strict=True)]
        self.keys = every


def shared_chances(longer: list[Merged], base: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length from 0: grams and the chance of their last character after the others, by continuation
    counts (how many different characters a gram follows) of all words.

    longer[k]: the different grams of k + 1 characters, with the last k, those but the last of
    these, and the last k - 1.
    """
    out = [(np.zeros(1, np.uint64), np.full(1, base))]
    for k in range(1, ORDER):
        rest, context, shorter = longer[k].columns
        gram, first, one = np.unique(rest, return_index=True, return_inverse=True)
        follows = np.bincount(one, minlength=len(gram))
        _, of = np.unique(context[first], return_inverse=True)
        total, kinds = np.bincount(of, follows)[of], np.bincount(of)[of]
        before = found_in(*out[k - 1], shorter[first])[0]
        out.append((gram, np.maximum(follows - DISCOUNT, 0) / total + DISCOUNT * kinds / total * before))
    return out


@dataclass
class Evidence:
    """log P(c | context; toxic) - log P(c | context; ordinary), by gram and, for the rest, by context."""

    grams: np.ndarray
    of_gram: np.ndarray
    contexts: np.ndarray
    of_context: np.ndarray

    def of(self, found: list[str]) -> np.ndarray:
        """Of whole words: log((1 - MIXED) + MIXED * P(word; toxic) / P(word; ordinary))."""
        if not found:
            return np.zeros(0)
        spelled = Spelled(found)
        at, gram, context, _, _ = top(spelled)
        value, there = found_in(self.grams, self.of_gram, gram)
        back, known = found_in(self.contexts, self.of_context, context)
        ratio = np.bincount(spelled.word[at], np.where(there, value, np.where(known, back, 0.0)), len(found))
        return np.log1p(MIXED * np.expm1(np.minimum(ratio, 50.0)))


def class_chances(n: np.ndarray, context: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of grams that occur n times in a class: the chance of the last character, and by context the backoff weight."""
    total, kinds = np.bincount(context, n), np.bincount(context, n > 0)
    weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    return np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1)[context] + weight[context] * shared, weight


def evidence(found: list[str], toxic: np.ndarray, ordinary: np.ndarray) -> Evidence:
    """From different words and how often each class has them; so many are spelled at once."""
    there = np.flatnonzero((toxic + ordinary) > 0)
    if not len(there):
        return Evidence(*(np.zeros(0, t) for t in (np.uint64, np.float32, np.uint64, np.float32)))
    tops, longer, characters = Merged(), [Merged() for _ in range(ORDER)], np.zeros(0, np.uint64)
    for start in range(0, len(there), CHUNK):
        part = there[start : start + CHUNK]
        spelled = Spelled([found[k] for k in part])
        characters = np.union1d(characters, spelled.codes)
        at, gram, context, rest, n = top(spelled)
        word = part[spelled.word[at]]
        tops.add(gram, [context, rest, n], [toxic[word], ordinary[word]])
        before = None
        for k, (shorter, grams) in enumerate(spelled.grams(ORDER)):  # grams of k + 1 characters
            if k:
                at = np.flatnonzero(spelled.place >= k)
                _, first = np.unique(grams[at], return_index=True)
                at = at[first]
                longer[k].add(grams[at], [shorter[at], before[at - 1], before[at]], [])
            before = shorter
    chances = shared_chances(longer, 1.0 / len(characters))
    contexts, of = np.unique(tops.columns[0], return_inverse=True)
    behind = np.zeros(len(tops.keys))
    for k in range(1, ORDER):
        here = tops.columns[2] == k
        behind[here] = found_in(*chances[k], tops.columns[1][here])[0]
    (a, wa), (b, wb) = (class_chances(n, of, behind) for n in tops.sums)
    return Evidence(tops.keys, np.log(a / b).astype(np.float32), contexts, np.log(wa / wb).astype(np.float32))


@dataclass
class Model:
    evidence: Evidence | None
    shift: float = 0.0
    slope: float = 0.0
    kept: dict[str, float] = field(default_factory=dict)

    def normalised(self, texts: list[str | None], most: int = 150_000) -> list[float]:
        """The evidence of each text over its length. Keeps that of words, up to a number of them."""
        every = [words(t) for t in texts]
        new = list({w for ws in every for w in ws if w not in self.kept})
        if len(self.kept) + len(new) > most:
            self.kept.clear()
            new = list({w for ws in every for w in ws})
        for k in range(0, len(new), CHUNK):
            part = new[k : k + CHUNK]
            self.kept.update(zip(part, self.evidence.of(part).tolist(), strict=True))
        get = self.kept.__getitem__
        return [sum(map(get, ws)) / (len(ws) + SHORT) for ws in every]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.evidence is None:
            return np.zeros(len(texts))
        z = self.shift + self.slope * np.array(self.normalised(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Shift and slope of a logistic function, by Newton's method, both classes of equal weight."""
    scale = float(np.abs(x).max()) or 1.0
    a = np.stack([np.ones(len(x)), x / scale], axis=1)
    w = np.zeros(2)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1] / scale)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """From rows whose crc32 of the id modulo 5 isn't 0; at most `sample` of each class."""
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter((remainder(id_col, 5) != 0) & F.col("toxic").isin(0, 1))
    marked = bounded_sample(marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), ["toxic"], "doc_id", sample)
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    once = texts.join(F.broadcast(marked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = stored(once.select("text", "toxic", half.alias("half")), "toxicity-sample")

    n = lambda h, c: F.count(F.when((F.col("half") == h) & (F.col("toxic") == c), 1)).alias(f"n{h}{c}")
    counts = rows.select("half", "toxic", F.explode(word_lists(F.col("text"))).alias("word")).groupBy("word").agg(*(n(h, c) for h in (0, 1) for c in (0, 1))).toPandas()
    vocabulary = counts.word.tolist()
    toxic, ordinary = (np.stack([counts[f"n{h}{c}"].to_numpy(float) for h in (0, 1)]) for c in (1, 0))
    del counts
    if not (toxic.sum() and ordinary.sum()):
        return Model(None)
    held = [Model(evidence(vocabulary, toxic[1 - h], ordinary[1 - h])) for h in (0, 1)]  # for the texts of half h
    at = F.when(F.col("half") == 0, normalised(spark, F.col("text"), held[0])).otherwise(normalised(spark, F.col("text"), held[1]))
    got = rows.select("toxic", at.alias("x")).toPandas()  # two numbers for each row of the sample
    shift, slope = calibrated(got.x.to_numpy(float), got.toxic.to_numpy(float))
    model = Model(evidence(vocabulary, toxic.sum(axis=0), ordinary.sum(axis=0)), shift, slope)
    let_go()
    return model


def normalised(spark: SparkSession, text: Column, model: Model) -> Column:
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(shipped.value.normalised(texts.tolist()), dtype=float)

    return of(text)


def toxicity(spark: SparkSession, text: Column, model: Model, batch: int = 256) -> Column:
    """The score of a text, 0 to 1."""
    text_batches(spark)
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shipped.value
        for texts in batches:
            parts = [own.scores(texts.iloc[k : k + batch].tolist()) for k in range(0, len(texts), batch)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype=float)
        own.kept.clear()
        let_go()

    return score(text)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    found = docs.select(F.col(id_col).alias("doc_id"), toxicity(docs.sparkSession, F.col(text_col), model).alias("score"))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
