"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of a weight for each of its words and
of their beginnings (PREFIXES characters, so that unseen words of a known stem count); a run of sentences has the noisy-or
1 - prod(1 - p). A document's probability, in the fit and in its score alike, is the largest noisy-or of up to NEAR sentences in a
row: the bias of thousands of clean sentences doesn't add up to a toxic text, whatever the length. Only documents have labels,
and the weights are fitted to them through that, by Adam over the whole sample in numpy; the run that counts is looked for anew
in every step. The sentences that make a document toxic are then those with a high probability of their own.

The sample for fitting is bounded: at most SAMPLE_ROWS labelled documents, those with the least hashes of their ids. Of a
clean text of more than SAMPLE_WORDS words, a run of sentences of as many words is taken from a hashed place on, whose runs are runs of
the text; a longer toxic text is left out, as a part of it need not be toxic. Of all these, texts in the order of a hash are taken until they have SAMPLE_TOTAL words. Words count as features if they stand in at least LEAST_ROWS documents of
the sample and the log-likelihood ratio of word and label there is at least LEAST_RATIO (rare words else learn the noise
of single labels), at most MOST_FEATURES of them. Scores are given to every whole text.

Defined cases: null or empty text has one empty sentence, whose score is the one of the bias alone; labels that are
null are left out, several labels of an id count as their maximum; without labelled rows of both kinds every score is
the prior of the labels seen (0 without any); repeated rows are scored alike; a table without rows gives none; other
columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from sys import intern
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import drop_scratch, fresh, only, scratch, slices, texts, unknown

SAMPLE_ROWS = 6_000
SAMPLE_WORDS = 20_000
SAMPLE_TOTAL = 4_000_000
LEAST_ROWS = 3
LEAST_RATIO = 20.0
MOST_FEATURES = 50_000
FOLDS = 5
#: Sentences in a row, at most, that make a text toxic together.
NEAR = 128
PREFIXES = (4, 5, 6, 7)
#: Words whose weights a task remembers.
REMEMBERED = 300_000

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


class WordWeights(dict):
    """Each word's sum of weights, made when first asked for; emptied when full."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = x = sum(self.weights.get(f, 0.0) for f in features(word))
        return x


class Model(NamedTuple):
    bias: float
    weights: dict[str, float]
    constant: float | None = None

    def ready(self) -> Model:
        """With weights by word instead of by feature."""
        return self._replace(weights=WordWeights(self.weights))

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, log-odds) of each sentence, in code points."""
        w, b = self.weights.__getitem__, self.bias
        return [(m.start(), m.end(), b + sum(map(w, WORD.findall(m.group().lower())))) for m in SENTENCE.finditer(text)] or [(0, 0, b)]

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        w, b = self.weights.__getitem__, self.bias
        quiet = math.log1p(math.exp(b))
        loud = []  # -log of the probability that a sentence isn't toxic
        for s in SENTENCE.findall(text) or [""]:
            z = sum(map(w, WORD.findall(s.lower())))
            loud.append(softplus(b + z) if z else quiet)
        return -math.expm1(-most_in_a_row(loud))


def most_in_a_row(x: list[float], near: int = NEAR) -> float:
    """The largest sum of `near` neighbours, or of all where there are fewer."""
    if len(x) <= near:
        return sum(x)
    upto = np.append(0.0, np.cumsum(x))
    return float((upto[near:] - upto[:-near]).max())


class Runs:
    """The runs of `near` sentences of the documents that have more, to look for each one's largest sum again and again."""

    def __init__(self, doc: np.ndarray, near: int):
        self.near, n = near, len(doc)
        starts = np.arange(max(n - near + 1, 0))
        self.starts = starts[doc[starts] == doc[starts + near - 1]]
        # documents of `near` sentences at least; those with more have several starts
        of = doc[self.starts]
        self.first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, np.int64)
        self.counts = np.diff(np.append(self.first, len(of)))
        self.inside = np.isin(doc, of)

    def active(self, x: np.ndarray) -> np.ndarray:
        """1 for the sentences in their document's run of the largest sum, the first of equals, and in documents of one run."""
        if not len(self.starts):
            return np.ones(len(x))
        upto = np.append(0.0, np.cumsum(x))
        sums = upto[self.starts + self.near] - upto[self.starts]
        most = np.repeat(np.maximum.reduceat(sums, self.first), self.counts)
        at = np.minimum.reduceat(np.where(sums >= most, self.starts, len(x)), self.first)
        edge = np.zeros(len(x) + 1)
        edge[at] += 1
        edge[at + self.near] -= 1
        return np.where(self.inside, np.cumsum(edge[:-1]), 1.0)


def softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def sample(df: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, toxic of at most `rows` labelled documents outside the held-out fold."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return only(df, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def likelihood_ratio(both: int, word: int, toxic: int, rows: int) -> float:
    """G-squared of a word's and the label's presence in `rows` documents."""
    cells = ((both, word, toxic), (word - both, word, rows - toxic), (toxic - both, rows - word, toxic), (rows - word - toxic + both, rows - word, rows - toxic))
    return 2 * sum(n * math.log(n * rows / (a * b)) for n, a, b in cells if n)


def fit(bags: list[list[list[str]]], y: np.ndarray, least_rows: int = LEAST_ROWS, least_ratio: float = LEAST_RATIO, steps: int = 300, rate: float = 0.1, decay: float = 1e-4, most_features: int = MOST_FEATURES, near: int = NEAR) -> Model:
    """Fit weights to documents given as lists of sentences given as lists of words."""
    if not len(y) or y.min() == y.max():
        return Model(0.0, {}, float(y.mean()) if len(y) else 0.0)
    rows: dict[str, int] = {}
    toxic: dict[str, int] = {}
    for bag, label in zip(bags, y, strict=True):
        for w in {f for w in {w for s in bag for w in s} for f in features(w)}:
            rows[w] = rows.get(w, 0) + 1
            if label > 0:
                toxic[w] = toxic.get(w, 0) + 1
    ratio = {w: likelihood_ratio(toxic.get(w, 0), k, int((y > 0).sum()), len(y)) for w, k in rows.items() if k >= least_rows}
    names = sorted((w for w, x in ratio.items() if x >= least_ratio), key=lambda w: (-ratio[w], w))[:most_features]
    place = {w: i for i, w in enumerate(names)}
    feats, sents, docs = [], [], []
    for d, bag in enumerate(bags):
        for s in bag or [[]]:
            known = [place[f] for w in s for f in features(w) if f in place]
            feats += known
            sents += [len(docs)] * len(known)
            docs.append(d)
    feat, sent, doc = np.array(feats, np.int64), np.array(sents, np.int64), np.array(docs, np.int64)
    n, m = len(y), len(names)
    runs = Runs(doc, near)
    counted = np.minimum(np.bincount(doc, minlength=n), near).sum()
    w, b = np.zeros(m), -math.log(max(2.0, 2.0 * counted / max(1.0, y.sum())))
    mean, square = np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(sent, w[feat], minlength=len(doc))
        p = 1 / (1 + np.exp(-z))
        loud = np.logaddexp(0, z)
        active = runs.active(loud)
        quiet = -np.bincount(doc, loud * active, minlength=n)  # log of the noisy-or's complement
        some = np.maximum(-np.expm1(quiet), 1e-12)
        by_doc = np.where(y > 0, -np.exp(quiet) / some, 1.0)
        g = by_doc[doc] * p * active / n
        grad = np.append(np.bincount(feat, g[sent], minlength=m) + decay * w, g.sum())
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w -= move[:m]
        b -= move[m]
    return Model(float(b), {x: float(v) for x, v in zip(names, w, strict=True) if abs(v) > 1e-3})


def part_of(bag: list[list[str]], most_words: int) -> list[list[str]]:
    """A run of sentences of at most `most_words` words in all, from a hashed place on; longer sentences are passed over."""
    fits = [s for s in bag if len(s) <= most_words]
    upto = np.append(0, np.cumsum([len(s) for s in fits]))
    # from any of these places on there are enough words for a whole run
    places = max(1, int(np.searchsorted(upto, upto[-1] - most_words, side="right")))
    start = zlib.crc32(" ".join(w for s in fits[:100] for w in s).encode()) % places
    end = int(np.searchsorted(upto, upto[start] + most_words, side="right")) - 1
    return fits[start:end]


def train(df: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_words: int = SAMPLE_WORDS, total_words: int = SAMPLE_TOTAL) -> Model:
    """Fit to a bounded sample of labelled documents. Sentences are cut into words on the executors."""
    unknown(df, ["doc_id", "text"])
    unknown(labels, ["doc_id", "toxic"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, toxic in zip(texts(b), b.column("toxic").to_pylist(), strict=True):
                bag = [WORD.findall(s.lower()) for s in SENTENCE.findall(text)]
                long = sum(map(len, bag)) > most_words
                bag = part_of(bag, most_words) if long and toxic <= 0 else bag
                out.append(None if long and toxic > 0 else "\n".join(" ".join(s) for s in bag))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column("toxic")], ["bag", "toxic"])

    chosen = sample(df, labels, rows)
    bags = chosen.mapInArrow(cut, f"bag string, toxic {chosen.schema['toxic'].dataType.simpleString()}").filter(F.col("bag").isNotNull())
    # the sample is cut once, written, and measured before any of it is sent to the driver
    bags = scratch(bags.withColumn("n", F.size(F.split("bag", "[ \n]")).cast("long")).withColumn("h", F.xxhash64("bag")), "toxicity-sample")
    sizes = bags.groupBy("h").agg(F.sum("n").alias("n"))  # at most `rows` of them
    upto = sizes.withColumn("upto", F.sum("n").over(Window.orderBy("h")))
    last = upto.filter(F.col("upto") <= total_words).agg(F.max("h")).first()[0]
    found = bags.filter(F.col("h") <= (last if last is not None else -(1 << 63))).select("bag", "toxic").toArrow()
    drop_scratch(bags)
    pairs = sorted(zip(found.column("bag").to_pylist(), found.column("toxic").to_pylist(), strict=True))  # sums then add up alike
    bags = [[[intern(w) for w in s.split(" ")] if s else [] for s in x.split("\n")] for x, _ in pairs]
    return fit(bags, np.array([y for _, y in pairs], np.float64))


def scored(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """keep columns, score (or another name): the score of each whole text. The model is bounded by MOST_FEATURES and sent with the task."""
    unknown(df, [*keep, "text"])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value.ready()
        for whole in batches:
            for b in slices(whole):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([m.score(t) for t in texts(b)], pa.float64())], [*keep, name])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return only(df, *dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{fields}, `{name}` double")


def locate(df: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence, start, end, score of the sentences whose own probability is at least `least`."""
    unknown(df, ["doc_id", "text"])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value.ready()
        for whole in batches:
            for b in slices(whole):
                rows = [(d, i, s, e, 1 / (1 + math.exp(-z))) for d, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True) if m.constant is None for i, (s, e, z) in enumerate(m.sentences(t)) if z >= math.log(least / (1 - least))]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.float64())], ["doc_id", "sentence", "start", "end", "score"])

    return only(df, "doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, sentence bigint, start bigint, end bigint, score double")


def judged(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_offending, worst_start, worst_end: the score of each whole text and where a toxic one offends.

    Offending sentences are those with a probability of their own of at least a half. The worst sentence is the most
    probable of them, the first of equals, in code points; it is null in texts that score below a half, and so it is where none
    offends by itself: such a text is toxic by several of its sentences together.
    """
    unknown(df, ["doc_id", "text"])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def one(m: Model, text: str) -> tuple[float, int, int | None, int | None]:
        score = m.score(text)
        if score < 0.5 or m.constant is not None:
            return score, 0, None, None
        found = [s for s in m.sentences(text) if s[2] >= 0]
        start, end, _ = max(found, key=lambda s: (s[2], -s[0])) if found else (None, None, None)
        return score, len(found), start, end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value.ready()
        for whole in batches:
            for b in slices(whole):
                cols = list(zip(*(one(m, t) for t in texts(b)), strict=True))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "score", "n_offending", "worst_start", "worst_end"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return only(df, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_offending bigint, worst_start bigint, worst_end bigint")


def judge(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending, worst_start, worst_end."""
    out = judged(df, train(df, labels))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted, "n_offending", "worst_start", "worst_end")


def keep_clean(df: DataFrame, labels: DataFrame) -> DataFrame:
    """df less the documents with a score of at least 0.5."""
    (name,) = fresh(df, "score")
    return scored(df, train(df, labels), tuple(df.columns), name).filter(F.col(name) < 0.5).drop(name)
