"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased runs of letters and of their beginnings of four to six
letters (which inflected forms share), each hashed to a bucket. The score is the
logistic of a bias, a weight for each bucket and, for each pair of buckets, the product of their
latent vectors, so that two terms that are harmless alone can weigh together.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import keep_ids, once

#: Buckets of hashed terms.
BUCKETS = 1 << 18
#: Labelled rows of each class that the fit takes at most, in the order of a hash of their ids.
PER_CLASS = 6_000
#: Rows of the fit's sample that a bucket must occur in to be given weights.
LEAST_ROWS = 8
#: Steps of the fit at least, however few rows there are.
LEAST_STEPS = 400
#: Scores from here on are toxic.
THRESHOLD = 0.7

#: Letters of a word's beginnings that are terms of their own.
BEGINNINGS = (4, 5, 6)

_WORDS = re.compile(r"[^\W\d_]+")
#: Words whose buckets a worker remembers.
_REMEMBERED = 500_000


def held_out(id_col) -> F.Column:
    """Rows that no fit may see: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class _Buckets(dict):
    """Word to the buckets of its terms, those without weights left out."""

    def __init__(self, used: np.ndarray | None = None):
        self.used = used

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > _REMEMBERED:
            self.clear()
        terms = [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]
        buckets = {zlib.crc32(term.encode()) % BUCKETS for term in terms}
        found = self[word] = tuple(b for b in buckets if self.used is None or self.used[b])
        return found

    def of(self, text: str | None) -> set[int]:
        """The buckets of a whole text's terms."""
        return set(chain.from_iterable(map(self.__getitem__, set(_WORDS.findall((text or "").lower())))))


@dataclass
class Machine:
    """Bias, weights (buckets), latent vectors (buckets x factors); zero where a bucket has none."""

    bias: float
    weights: np.ndarray
    latent: np.ndarray

    def packed(self) -> tuple:
        at = np.flatnonzero(self.weights.astype(bool) | self.latent.any(axis=1))
        return self.bias, at, self.weights[at], self.latent[at]


class Scorer:
    def __init__(self, bias: float, at: np.ndarray, weights: np.ndarray, latent: np.ndarray):
        self.bias, self.weights, self.latent = bias, weights, latent
        used = np.zeros(BUCKETS, bool)
        used[at] = True
        self.place = np.full(BUCKETS, -1)
        self.place[at] = np.arange(len(at))
        self.buckets = _Buckets(used)

    def score(self, text: str | None) -> float:
        found = self.buckets.of(text)
        x = self.bias
        if found:
            at = self.place[sorted(found)]
            v = self.latent[at]
            x += float(self.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum()))
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def fit_machine(buckets: np.ndarray, cuts: np.ndarray, labels: np.ndarray, factors: int = 4, epochs: int = 14, batch: int = 256, rate: float = 0.1, lasso: float = 4e-4, ridge: float = 1e-4, seed: int = 7) -> Machine:
    """Fit by mini-batches of AdaGrad on the log loss, with soft thresholds on the weights.

    Row k has the buckets from ``cuts[k]`` to ``cuts[k + 1]``. Without both classes among the labels
    the machine has a bias alone: the smoothed share of label 1.
    """
    weights, latent = np.zeros(BUCKETS), np.zeros((BUCKETS, factors))
    prior = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(prior / (1 - prior)))
    if not len(labels) or labels.min() == labels.max():
        return Machine(bias, weights, latent)
    at = np.flatnonzero(np.bincount(buckets, minlength=BUCKETS) >= LEAST_ROWS)
    place = np.full(BUCKETS, -1, np.int32)
    place[at] = np.arange(len(at))
    places = place[buckets]
    cuts = np.concatenate([[0], np.cumsum(places >= 0)])[cuts]
    places = places[places >= 0]
    rows = len(labels)
    random = np.random.default_rng(seed)
    epochs = max(epochs, -(-LEAST_STEPS * batch // rows))
    w, v = np.zeros(len(at)), random.normal(0, 0.01, (len(at), factors))
    w_sum, v_sum, b_sum = np.full(len(at), 1e-2), np.full((len(at), factors), 1e-2), 1e-2
    for _ in range(epochs):
        order = random.permutation(rows)
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            y = labels[some]
            n = cuts[some + 1] - cuts[some]
            idx = places[np.repeat(cuts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            row = np.repeat(np.arange(len(some)), n)
            vi = v[idx]
            s = np.stack([np.bincount(row, vi[:, f], len(some)) for f in range(factors)], 1)
            sq = np.bincount(row, (vi * vi).sum(1), len(some))
            x = bias + np.bincount(row, w[idx], len(some)) + 0.5 * ((s * s).sum(1) - sq)
            g = (1 / (1 + np.exp(-np.clip(x, -40, 40))) - y) / len(some)
            b_sum += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(b_sum)
            gi = g[row]
            touched, back = np.unique(idx, return_inverse=True)
            gw = np.bincount(back, gi)
            w_sum[touched] += gw * gw
            step = rate / np.sqrt(w_sum[touched])
            new = w[touched] - step * gw
            w[touched] = np.sign(new) * np.maximum(0, np.abs(new) - step * lasso)
            for f in range(factors):
                gv = np.bincount(back, gi * (s[row, f] - vi[:, f])) + ridge * v[touched, f]
                v_sum[touched, f] += gv * gv
                v[touched, f] -= 0.3 * rate * gv / np.sqrt(v_sum[touched, f])
    weights[at], latent[at] = w, v
    return Machine(bias, weights, latent)


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toxic, buckets) of the fit's sample: at most ``per_class`` labelled rows of each class.

    Rows come in the order of a hash of their ids, so the sample doesn't hang on how the table is
    stored. A document with several labels counts with the largest; null labels and held-out rows
    don't count.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(~held_out(F.col("_id")))
    order = [F.xxhash64("_id"), F.col("_id")]
    # the limits are the documented bound of the fit's sample
    sample = marks.where("toxic = 1").orderBy(*order).limit(per_class).union(marks.where("toxic = 0").orderBy(*order).limit(per_class))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    found = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select(F.col("_id").cast("long").alias("doc_id"), "toxic", "_text")

    def run(batches):
        buckets = _Buckets()
        for batch in batches:
            sets = [sorted(buckets.of(text)) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int32()))], names=["doc_id", "toxic", "buckets"])

    return found.mapInArrow(run, "doc_id long, toxic int, buckets array<int>")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, **columns: str) -> Machine:
    """A machine fitted on the driver to the bounded sample of ``training_rows``."""
    sample = training_rows(docs, labels, per_class, **columns).toArrow().sort_by([("doc_id", "ascending")])
    lists = sample["buckets"].combine_chunks()
    buckets, cuts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    marks = sample["toxic"].to_numpy().astype(float)
    del sample, lists
    return fit_machine(buckets, cuts, marks)


def score_texts(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, from its whole text alone.

    Null and empty texts score the bias. Repeated rows and null ids give rows of their own; no
    other column is read.
    """
    # the broadcast holds at most BUCKETS weights
    shared = once(docs.sparkSession.sparkContext.broadcast(machine.packed()), Scorer)

    def run(batches):
        scorer = shared()
        for batch in batches:
            scores = [scorer.score(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns.

    An id whose rows have several texts stays only if none of them is toxic.
    """
    scores = score_texts(docs, fit(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    clean = scores.groupBy("doc_id").agg(F.max("predicted").alias("worst")).where("worst = 0").select("doc_id")
    return keep_ids(docs, clean, id_col)
