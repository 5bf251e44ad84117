"""Language identification of words, spans and texts.

Script ranges narrow the languages that a word may have; a word's score for each is its mean
log-likelihood under the language's character grams; a Viterbi search over the words of a text,
with a penalty for each switch, labels spans. The text's language is the one whose spans hold
the most letters, and the score is its share of them.

Most texts need no search: let b be the language of the largest total. Any run of words that
another labelling gives to other languages costs a switch at least, and gains at most the sum,
over the run, of the best other language's score less that of b. If the largest such sum of any
run is below the penalty, no switch can pay and all words are b, which is what the search finds.

Learned from a bounded sample: at most `sample` texts of each language (those with the smallest
hash of the id), each whole; of rows that repeat an id one is learned from. Words are counted in
Spark, so what reaches the driver are the different words of the sample. Prediction covers whole
texts.

Defined results: a null text, or one without a letter, is `und` with score 0, as is every text
if nothing was learned; words in a script of which no language was learned may have any language;
ties go to the language that sorts first; repeated rows are predicted each; an empty table
gives an empty result; columns other than id, text and language are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Spelled, bounded_sample, found_in, let_go, remainder, stored, table, text_batches, word_lists, words

SAMPLE = 1000
GRAMS = (2, 3)
PENALTY = 6.0  # nats for a switch
FLOOR = 0.02  # of a language's letters are in words that score less than those that count as its own
SHARE = 0.01  # of a language's letters that must be in a script for it to be one of its scripts
#: First code points of ranges of scripts, in order.
RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"),
]
_STARTS, _SCRIPTS = [a for a, _ in RANGES], [b for _, b in RANGES]


def script(char: str) -> str:
    return _SCRIPTS[bisect_right(_STARTS, ord(char)) - 1]


#: Words that are spelled at once.
CHUNK = 1 << 14


def grams_of(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all grams of words and the word of each; and the number of grams of each word."""
    spelled = Spelled(found)
    hashes, of = [], []
    for n, (_, grams) in enumerate(spelled.grams(max(GRAMS)), 1):
        if n in GRAMS:
            at = np.flatnonzero(spelled.place >= n - 1)
            hashes.append(grams[at])
            of.append(spelled.word[at])
    word = np.concatenate(of)
    return np.concatenate(hashes), word, np.bincount(word, minlength=len(found))


def gram_counts(found: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different grams, sorted, and how often each language has them."""
    keys, sums = np.zeros(0, np.uint64), np.zeros((0, counts.shape[1]))
    for k in range(0, len(found), CHUNK):
        gram, word, _ = grams_of(found[k : k + CHUNK])
        every, one = np.unique(np.concatenate([keys, gram]), return_inverse=True)
        old, new = one[: len(keys)], one[len(keys) :]
        total = np.stack([np.bincount(new, c[k : k + CHUNK][word], len(every)) for c in counts.T], axis=1)
        total[old] += sums
        keys, sums = every, total
    return keys, sums


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # sorted hashes
    scores: np.ndarray  # a row for each gram, a column for each language
    unseen: np.ndarray
    scripts: dict[str, tuple[bool, ...]]
    floors: np.ndarray  # for each language, the least mean score of a word that counts as its own

    def means(self, found: list[str]) -> np.ndarray:
        """The mean score of each word's grams, for each language."""
        out = np.zeros((len(found), len(self.languages)))
        for k in range(0, len(found), CHUNK):
            gram, word, n = grams_of(found[k : k + CHUNK])
            score, there = found_in(self.grams, self.scores, gram)
            score[~there] = self.unseen
            for x in range(len(self.languages)):
                out[k : k + CHUNK, x] = np.bincount(word, score[:, x], len(n)) / n
        return out


def fit(found: list[str], counts: np.ndarray, languages: list[str], least: int = 2) -> Model:
    """From different words and how often each language (a column, in the order of the sorted names) has them."""
    if not languages:
        return Model([], *(np.zeros(0) for _ in range(3)), {}, np.zeros(0))
    sizes = np.fromiter(map(len, found), float, len(found))
    scripts: dict[str, np.ndarray] = {}
    for w, n, size in zip(found, counts, sizes, strict=True):
        name = script(w[0])
        scripts[name] = scripts.get(name, 0) + n * size
    letters = np.maximum(1, sizes @ counts) if found else np.ones(len(languages))
    grams, n = gram_counts(found, counts)
    total, often = n.sum(axis=0), (n >= least).any(axis=1)
    size = often.sum() + 1
    score = lambda x: np.log((x + 0.5) / (total + 0.5 * size))
    known = {s: tuple((v >= SHARE * letters).tolist()) for s, v in scripts.items()}
    model = Model(languages, grams[often], score(n[often]), score(np.zeros(len(languages))), {s: v for s, v in known.items() if any(v)}, np.zeros(len(languages)))
    means = model.means(found)
    for k in range(len(languages)):
        own = np.flatnonzero(counts[:, k]) if found else np.zeros(0, int)
        if len(own):
            order = own[np.argsort(means[own, k])]
            below = np.cumsum(counts[order, k] * sizes[order])
            model.floors[k] = means[order[np.searchsorted(below, FLOOR * below[-1])], k]
    return model


def fit_texts(texts: list[str], languages: list[str]) -> Model:
    """From texts in memory."""
    names = sorted(set(languages))
    counted = Counter((w, x) for t, x in zip(texts, languages, strict=True) for w in words(t))
    found = sorted({w for w, _ in counted})
    return fit(found, np.array([[counted[w, x] for x in names] for w in found], float).reshape(len(found), len(names)), names)


def switch_may_pay(scores: np.ndarray, best: int, penalty: float) -> bool:
    """Whether some run of words gains the penalty at least by other languages than the best."""
    if scores.shape[1] < 2:
        return False
    own = scores[:, best].copy()
    others = scores.copy()
    others[:, best] = -np.inf
    sums = np.concatenate([[0.0], np.cumsum(others.max(axis=1) - own)])
    return bool((sums - np.minimum.accumulate(sums)).max() >= penalty)


def viterbi(scores: list[np.ndarray], penalty: float = PENALTY, together: int = 1 << 20) -> list[np.ndarray]:
    """The labels of each text's words. Texts go through in step, sorted by length.

    A state's best score is its own of the step before, or the best of any less the penalty;
    whether it switched, and from which, is kept to trace the labels back.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(scores)
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    at = 0
    while at < len(order) and len(scores[order[at]]):
        longest = len(scores[order[at]])
        group = order[at : at + max(1, min(len(order), together // longest))]
        group = [k for k in group if len(scores[k])]
        at += len(group)
        _in_step(scores, group, penalty, out)
    return out


def _in_step(scores: list[np.ndarray], group: list[int], penalty: float, out: list[np.ndarray]) -> None:
    lengths = np.array([len(scores[k]) for k in group])
    n, steps, states = len(group), int(lengths[0]), scores[group[0]].shape[1]
    padded = np.zeros((steps, n, states))
    for j, k in enumerate(group):
        padded[: lengths[j], j] = scores[k]
    switched = np.zeros((steps, n, states), bool)
    best_from = np.zeros((steps, n), np.int8)
    now = padded[0].copy()
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than the step
    for t in range(1, steps):
        m = active[t]
        best = now[:m].argmax(axis=1)
        jump = now[:m][np.arange(m), best][:, None] - penalty
        to = jump > now[:m]
        switched[t, :m], best_from[t, :m] = to, best
        now[:m] = np.where(to, jump, now[:m]) + padded[t, :m]
    labels = np.zeros((steps, n), np.int8)
    state = now.argmax(axis=1).astype(np.int8)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        labels[t, :m] = state[:m]
        if t:
            state[:m] = np.where(switched[t, np.arange(m), state[:m]], best_from[t, :m], state[:m])
    for j, k in enumerate(group):
        out[k] = labels[: lengths[j], j].copy()


class Labeller:
    """Labels the words of texts; keeps the scores of words in a table, up to a number of words."""

    def __init__(self, model: Model, most: int = 150_000) -> None:
        self.model, self.most = model, most
        self._clear()

    def _clear(self) -> None:
        n = len(self.model.languages)
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, n))
        self.own = np.zeros((0, n), bool)

    def _learn(self, texts: list[list[str]]) -> None:
        """Puts the words that aren't there yet into the table."""
        new = list({w for ws in texts for w in ws if w not in self.index})
        if len(new) + len(self.index) > self.most:
            self._clear()
            new = list({w for ws in texts for w in ws})
        if not new:
            return
        means = self.model.means(new)
        kinds = [script(w[0]) for w in new]
        allowed = {s: np.array(self.model.scripts.get(s) or [True] * len(self.model.languages)) for s in set(kinds)}
        known = np.array([s in self.model.scripts for s in kinds])
        may = np.stack([allowed[s] for s in kinds])
        sizes = np.fromiter(map(len, new), float, len(new))
        self.own = np.concatenate([self.own, (means >= self.model.floors) & may & known[:, None]])
        self.table = np.concatenate([self.table, (means - np.where(may, 0.0, 50.0)) * np.sqrt(np.minimum(sizes, 12))[:, None]])
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))

    def label(self, texts: list[str | None], penalty: float = PENALTY) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """Of each text its words, their places in the table, and their labels as positions among the languages."""
        every = [words(t) for t in texts]
        if not self.model.languages:
            return [([], np.zeros(0, np.int64), np.zeros(0, np.int8)) for _ in every]
        self._learn(every)
        get = self.index.__getitem__
        places = [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in every]
        labels: list[np.ndarray] = []
        search = []
        for k, at in enumerate(places):
            scores = self.table[at]
            best = int(scores.sum(axis=0).argmax()) if len(at) else 0
            labels.append(np.full(len(at), best, np.int8))
            if len(at) and switch_may_pay(scores, best, penalty):
                search.append(k)
        for k, found in zip(search, viterbi([self.table[places[k]] for k in search], penalty), strict=True):
            labels[k] = found
        return list(zip(every, places, labels, strict=True))

    def predict(self, texts: list[str | None], own: bool = False) -> list[tuple[str, float]]:
        """The language with the most letters and its share of them; `und` if there is none.

        With `own` a word gives its letters to its label only if it counts as that language's
        own. Words of a script that wasn't learned, or less likely than nearly all of a
        language's words, count for none.
        """
        out = []
        for found, at, labels in self.label(texts):
            if not len(labels):
                out.append(("und", 0.0))
                continue
            sizes = np.fromiter(map(len, found), float, len(found))
            letters = np.bincount(labels, sizes * self.own[at, labels] if own else sizes, len(self.model.languages))
            best = int(letters.argmax())
            out.append((self.model.languages[best] if letters[best] else "und", float(letters[best] / sizes.sum())))
        return out

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """Language, first word and the word after the last."""
        ((_, _, labels),) = self.label([text])
        cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
        return [(self.model.languages[labels[a]], a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """From rows with a language whose crc32 of the id modulo 4 isn't 2; at most `sample` rows of each."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = found.filter((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = bounded_sample(found.select("doc_id", "lang").distinct(), ["lang"], "doc_id", sample)
    rows = found.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    counts = stored(rows.select("lang", F.explode(word_lists(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "language-words")
    languages = sorted(r.lang for r in ids.select("lang").distinct().collect())
    wide = counts.groupBy("word").pivot("lang", languages).agg(F.sum("n")) if languages else counts.select("word").limit(0)
    got = wide.na.fill(0).toPandas()
    let_go()
    return fit(got.word.tolist(), got[languages].to_numpy(float).reshape(len(got), len(languages)), languages)


def language(spark: SparkSession, text: Column, model: Model, batch: int = 256, own: bool = False) -> Column:
    """lang_pred and score of a text; with `own` only words that count as a language's own give it letters."""
    text_batches(spark)
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shipped.value)
        for texts in batches:
            rows = [r for k in range(0, len(texts), batch) for r in labeller.predict(texts.iloc[k : k + batch].tolist(), own)]
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])
        del labeller
        let_go()

    return predicted(text)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""
    found = docs.select(F.col(id_col).alias("doc_id"), language(docs.sparkSession, F.col(text_col), model).alias("p"))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "p.lang_pred", "p.score")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
