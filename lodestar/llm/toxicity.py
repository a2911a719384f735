"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; each model sees the text's features and the probabilities
that the earlier models gave. In training these are out-of-fold, so a later model meets them as sure
or unsure as they are on new text. Features: which words and word beginnings (4 to 6 letters) a text
has, of those that tell the classes apart in the training rows, and a few shares of characters.

The models are fitted on a bounded sample of labelled rows (``sample`` rows a class of the last
category, ``sample_chars`` characters in all, texts of at most ``text_chars``); scoring is one pass
over all documents, whole. ``labels`` states two things of a document, so the chain has two links:
``poor`` (one minus quality; not a kind of toxicity, but what tells junk from prose) and ``toxic``.
Any number of categories may be given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, doc_columns, fresh, pieces_of, small_batches, stored

#: Labelled rows of each class, and characters, that the models are fitted on; longer texts are left out of the fit.
SAMPLE, SAMPLE_CHARS, TEXT_CHARS = 3000, 24_000_000, 1_000_000
FOLDS = 3
#: Features that a model may use.
SELECTED = 3000
BEGINNINGS = (4, 5, 6)
#: Words that a worker remembers the features of.
WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS, _SPACES = re.compile(r"[^\W\d_]"), re.compile(r"\s")


def shares(text: str, words: list[str]) -> list[float]:
    """Letters, white space, distinct words, word length and length of a text, each about 0 to 1."""
    n = max(1, len(text))
    letters = sum(map(len, words))
    return [letters / n, text.count(" ") / n, len(set(words)) / max(1, len(words)), letters / max(1, len(words)) / 16, float(np.log1p(len(text)) / 12)]


SHARES = 5


@dataclass
class Link:
    """One model of the chain: weights of features (words or beginnings), of shares and of earlier probabilities."""

    category: str
    weights: dict[str, float] = field(default_factory=dict)
    dense: np.ndarray = field(default_factory=lambda: np.zeros(SHARES))
    bias: float = 0.0
    threshold: float = 0.5


def _features(word: str) -> list[str]:
    return [f"{word}$", *(word[:k] for k in BEGINNINGS if len(word) >= k)]


class Corpus:
    """The sample's features, numbered: for each text the sorted distinct ones."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        of_word: dict[str, np.ndarray] = {}
        self.rows, dense = [], []
        for t in texts:
            words = _WORD.findall(t.lower())
            for w in (own := set(words)):
                if w not in of_word:
                    of_word[w] = np.array([number.setdefault(f, len(number)) for f in _features(w)], np.int32)
            self.rows.append(np.unique(np.concatenate([of_word[w] for w in own])) if own else np.empty(0, np.int32))
            dense.append(shares(t, words))
        self.names = list(number)
        self.dense = np.array(dense).reshape(len(texts), SHARES)

    def select(self, at: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Features that differ most between the classes, in standard errors, seen in three texts at least."""
        count = [np.bincount(np.concatenate([self.rows[i] for i in at[y == k]] or [np.empty(0, np.int32)]), minlength=len(self.names)) for k in (0, 1)]
        size = [max(1, int((y == k).sum())) for k in (0, 1)]
        rate = [(c + 0.5) / (n + 1) for c, n in zip(count, size, strict=True)]
        z = np.abs(rate[1] - rate[0]) / np.sqrt(sum(r * (1 - r) / n for r, n in zip(rate, size, strict=True)))
        z[(count[0] + count[1]) < 3] = 0
        best = np.argsort(-z, kind="stable")[:SELECTED]
        return best[z[best] > 3]


def _fit(corpus: Corpus, at: np.ndarray, y: np.ndarray, extra: np.ndarray, rounds: int = 120, l2: float = 2e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression by Adam on the selected features, the shares and the earlier probabilities."""
    chosen = corpus.select(at, y)
    column = np.full(len(corpus.names) + 1, -1, np.int64)
    column[chosen] = np.arange(len(chosen))
    own = [c[c >= 0] for c in (column[corpus.rows[i]] for i in at)]
    rows, cols = np.repeat(np.arange(len(at)), [len(c) for c in own]), np.concatenate([*own, np.empty(0, np.int64)]).astype(np.int64)
    dense = np.hstack([corpus.dense[at], extra[at]])
    mean, std = dense.mean(0), dense.std(0) + 1e-6
    dense = (dense - mean) / std
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    w, d, b = np.zeros(len(chosen)), np.zeros(dense.shape[1]), 0.0
    m, v = np.zeros(len(w) + len(d) + 1), np.zeros(len(w) + len(d) + 1)
    for k in range(1, rounds + 1):
        score = b + dense @ d + np.bincount(rows, w[cols], minlength=len(at))
        g = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / len(at)
        grad = np.concatenate([np.bincount(cols, g[rows], minlength=len(w)) + l2 * w, dense.T @ g + l2 * d, [g.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, d, b = w - step[: len(w)], d - step[len(w) : -1], b - step[-1]
    return chosen, w, d / std, float(b - (d / std) @ mean)


def _score(corpus: Corpus, at: np.ndarray, extra: np.ndarray, model: tuple) -> np.ndarray:
    chosen, w, d, b = model
    weight = np.zeros(len(corpus.names))
    weight[chosen] = w
    s = np.array([weight[corpus.rows[i]].sum() for i in at]) + np.hstack([corpus.dense[at], extra[at]]) @ d + b
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def fit_chain(texts: list[str], labels: dict[str, list[int]]) -> list[Link]:
    """Models for the categories in the order of ``labels``. A category with one class always has its share."""
    corpus, n = Corpus(texts), len(texts)
    every = np.arange(n)
    fold = every % FOLDS
    extra, out = np.zeros((n, 0)), []
    for category, values in labels.items():
        y = np.array(values)
        link = Link(category, dense=np.zeros(SHARES + extra.shape[1]))
        if n < 2 * FOLDS or min(y.sum(), n - y.sum()) < FOLDS:
            p = float(y.mean()) if n else 0.0
            link.bias, link.threshold = float(np.log((p + 1e-9) / (1 - p + 1e-9))), 2.0
            oof = np.full(n, p)
        else:
            oof = np.zeros(n)
            for f in range(FOLDS):
                oof[fold == f] = _score(corpus, every[fold == f], extra, _fit(corpus, every[fold != f], y[fold != f], extra))
            chosen, w, d, b = _fit(corpus, every, y, extra)
            keep = np.abs(w) > 1e-3
            link.weights = {corpus.names[i]: float(x) for i, x in zip(chosen[keep], w[keep], strict=True)}
            link.dense, link.bias = d, b
            tried = np.linspace(0.2, 0.98, 79)
            # few clean documents may be lost: one weighs as much as five found
            gain = [((oof >= t) & (y == 1)).sum() - 5 * ((oof >= t) & (y == 0)).sum() for t in tried]
            best = np.flatnonzero(np.array(gain) == max(gain))
            link.threshold = float(tried[best[len(best) // 2]])
        extra = np.hstack([extra, oof[:, None]])
        out.append(link)
    return out


def probabilities(chain: list[Link], texts: list[str]) -> np.ndarray:
    """(texts, categories): each link's probability, fed to the links after it."""
    out = np.zeros((len(texts), len(chain)))
    for i, t in enumerate(texts):
        words = _WORD.findall(t.lower())
        own = {f for w in set(words) for f in _features(w)}
        x = shares(t, words)
        for k, link in enumerate(chain):
            s = link.bias + float(np.dot(link.dense, x)) + sum(map(link.weights.__getitem__, own & link.weights.keys()))
            x = [*x, 1 / (1 + np.exp(-min(30.0, max(-30.0, s))))]
        out[i] = x[SHARES:]
    return out


def sample(docs: DataFrame, labels: DataFrame, categories: dict[str, str], rows: int = SAMPLE, chars: int = SAMPLE_CHARS, text_chars: int = TEXT_CHARS) -> tuple[list[str], dict[str, list[int]]]:
    """Texts and labels of at most ``rows`` labelled documents a class of the last category, by hashed doc_id.

    All bounds hold before anything reaches the driver. A doc_id counts once: of several rows the text
    that sorts first, of labels that disagree the largest. Texts of over ``text_chars`` characters are
    left out, and those after the first ``chars`` characters in the hashed order. Null labels and ids
    are left out.
    """
    last = list(categories)[-1]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.expr(e).cast("int").alias(c) for c, e in categories.items())).dropna()
    known = known.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories))
    order = F.xxhash64("doc_id")
    chosen = known.where(F.col(last) == 1).orderBy(order).limit(rows).union(known.where(F.col(last) == 0).orderBy(order).limit(rows))
    # at most 2 * rows rows, so chosen may be broadcast
    found = doc_columns(docs).where(F.length("text") <= text_chars).join(F.broadcast(chosen), "doc_id")
    found = stored(found.groupBy("doc_id", *categories).agg(F.min("text").alias("text")).withColumn("h", order), "toxicity-sample")
    so_far = F.sum(F.length("text")).over(Window.orderBy("h", "doc_id"))  # over at most 2 * rows rows
    fit = found.select("doc_id", so_far.alias("chars")).where(F.col("chars") <= chars).select("doc_id")
    own = found.join(fit, "doc_id").toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    discard(found)
    return own["text"].to_pylist(), {c: own[c].to_pylist() for c in categories}


#: Categories and how labels state them, in the order of the chain.
CATEGORIES = {"poor": "1 - quality", "toxic": "toxic"}


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None) -> list[Link]:
    texts, values = sample(docs, labels, categories or CATEGORIES)
    return fit_chain(texts, values)


def score(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """Per document: doc_id, p_<category> and the last category's verdict. One pass, no shuffle.

    Null texts count as empty; null doc_ids stay; repeated rows are scored alike; an empty table gives
    no rows; labels that are null are left out; without labels of both classes nothing is rejected.
    """
    names = [f"p_{link.category}" for link in chain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = Scorer(chain)
        for batch in pieces_of(batches):
            p = fast(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(chain))), pa.array(p[:, -1] >= chain[-1].threshold)], ["doc_id", *names, chain[-1].category])

    return doc_columns(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + f", {chain[-1].category} boolean")


class Scorer:
    """:func:`probabilities`, each distinct word looked up once in the chain's features."""

    def __init__(self, chain: list[Link]):
        self.chain = chain
        self.names = set().union(*(link.weights for link in chain))
        self.hits: dict[str, tuple[str, ...]] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        out, hits, names = np.zeros((len(texts), len(self.chain))), self.hits, self.names
        for i, t in enumerate(texts):
            words = _WORD.findall(t.lower())
            distinct = set(words)
            if unseen := distinct.difference(hits):
                if len(hits) > WORDS:
                    hits.clear()
                    unseen = distinct
                hits.update((w, tuple([f for f in (w + "$", w[:4], w[:5], w[:6]) if f in names])) for w in unseen)
            own = set().union(*map(hits.__getitem__, distinct))
            x = shares(t, words)
            for k, link in enumerate(self.chain):
                s = link.bias + float(np.dot(link.dense, x)) + sum([link.weights[f] for f in own if f in link.weights])
                x.append(1 / (1 + np.exp(-min(30.0, max(-30.0, s)))))
            out[i] = x[SHARES:]
        return out


def reject(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """The rows of ``docs``, all columns, that the chain doesn't reject."""
    flag = fresh(docs, "lodestar_rejected")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = Scorer(chain)
        at = -1
        for batch in pieces_of(batches):
            p = fast(batch.column(batch.num_columns + at).to_pylist())
            kept = batch.filter(pa.array(p[:, -1] < chain[-1].threshold))
            yield kept.drop_columns([flag])

    return docs.withColumn(flag, F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(run, docs.schema)
