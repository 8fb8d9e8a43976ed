"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its hashed byte n-grams and itself; the embeddings of a bag's members are averaged and go
through a linear softmax. Misspelt and unseen words share n-gram vectors with known ones. A few harmful words
vanish in the average of a long text, so bags are windows of words, and a text is as toxic as its worst window:
training takes the worst window of each text by the present model, besides random ones of harmless texts.

For scoring, embeddings and softmax collapse into one number for each bucket, so a window's logit is a mean of
numbers; whole texts are scored, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.grams import Grams, byte_classes, per_text
from marlstone.llm.shared import few_by_hash, held_out, lowered, written
from marlstone.shipping import ship

_CLASSES = byte_classes(digits=True)


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    #: The training sample: at most so many documents of each label, and code points of all of them; of documents in
    #: the order of their ids' hashes each that still fits is taken, whole.
    per_label: int = 2000
    most_chars: int = 8 << 20
    sizes: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 18
    width: int = 8
    window: int = 8
    epochs: int = 8
    rate: float = 0.1
    seed: int = 7


@dataclass
class Model:
    """A number for each bucket, and the line from a text's worst window to its logit."""

    table: np.ndarray
    slope: float
    shift: float
    settings: Settings


def _bag(text: bytes, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams in the order of its words, and where each word's begin (and the last end)."""
    block = Grams(text, settings.sizes, settings.bits, _CLASSES, whole_words=True)
    words = np.concatenate(block.words) if block.n_words else np.zeros(0, dtype=np.int32)
    order = np.argsort(words, kind="stable")
    buckets = (np.concatenate(block.buckets) if block.n_words else np.zeros(0, dtype=np.int32))[order]
    return buckets, np.searchsorted(words[order], np.arange(block.n_words + 1))


def worst_window(sums: np.ndarray, counts: np.ndarray, window: int) -> tuple[float, int]:
    """The highest mean over ``window`` words running (all of them, if fewer), and where it begins."""
    if not len(sums):
        return 0.0, 0
    if len(sums) <= window:
        return float(sums.sum() / max(counts.sum(), 1)), 0
    s, c = np.concatenate([[0.0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(counts)])
    means = (s[window:] - s[:-window]) / np.maximum(c[window:] - c[:-window], 1)
    at = int(means.argmax())
    return float(means[at]), at


def train(texts: list[bytes], toxic: list[int], settings: Settings = Settings()) -> Model:
    """Stochastic gradient descent on embeddings and softmax together; texts are lower-cased UTF-8."""
    random = np.random.default_rng(settings.seed)
    size = 1 << settings.bits
    vectors = ((random.random((size, settings.width)) - 0.5) / settings.width).astype(np.float32)
    softmax = np.zeros((settings.width, 2), dtype=np.float32)
    softmax[:, 1] = random.normal(0, 0.1, settings.width)
    bias = np.zeros(2, dtype=np.float32)
    seen = [np.zeros_like(vectors), np.zeros_like(softmax), np.zeros_like(bias)]
    bags = [_bag(t, settings) for t in texts]
    truth = np.asarray(toxic, dtype=np.int64)
    if len(set(toxic)) < 2:
        share = float(np.clip(truth.mean() if len(truth) else 0.0, 0.01, 0.99))
        return Model(np.zeros(size, dtype=np.float32), 1.0, float(np.log(share / (1 - share))), settings)
    # Both labels weigh the same.
    importance = np.where(truth == 1, len(truth) / (2 * truth.sum()), len(truth) / (2 * (len(truth) - truth.sum())))

    def worst(i: int, table: np.ndarray) -> tuple[float, int]:
        buckets, cuts = bags[i]
        if not len(buckets):
            return 0.0, 0
        return worst_window(np.add.reduceat(table[buckets], cuts[:-1]), np.diff(cuts), settings.window)

    for epoch in range(settings.epochs):
        rate = settings.rate * (1 - epoch / settings.epochs)
        table = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
        for i in random.permutation(len(bags)):
            buckets, cuts = bags[i]
            n = len(cuts) - 1
            if not n:
                continue
            begins = [0] if epoch < 2 else [worst(i, table)[1]]
            if epoch >= 2 and truth[i] == 0 and n > settings.window:
                begins.append(int(random.integers(0, n - settings.window + 1)))
            for begin in begins:
                end = n if epoch < 2 else min(n, begin + settings.window)
                ids, times = np.unique(buckets[cuts[begin] : cuts[end]], return_counts=True)
                part = (times / times.sum()).astype(np.float32)[:, None]
                mean = (vectors[ids] * part).sum(axis=0)
                logits = mean @ softmax + bias
                error = np.exp(logits - logits.max())
                error /= error.sum()
                error[truth[i]] -= 1
                error *= importance[i] / len(begins)
                steps = [(vectors, ids, part * (softmax @ error)[None, :]), (softmax, ..., np.outer(mean, error)), (bias, ..., error)]
                # Adaptive rates: what is seen seldom, such as harmful words, moves as far as what is seen often.
                for (target, at, gradient), past in zip(steps, seen):
                    past[at] += gradient * gradient
                    target[at] -= rate * gradient / np.sqrt(past[at] + 1e-12)
    table = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    worsts = np.array([worst(i, table)[0] for i in range(len(bags))])
    slope, shift = _line(worsts, truth)
    return Model(table, slope, shift, settings)


def _line(values: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on one number, both labels weighing the same."""
    centre, scale = values.mean(), max(values.std(), 1e-9)
    x = np.column_stack([(values - centre) / scale, np.ones(len(values))])
    weight = np.where(truth == 1, 0.5 / truth.sum(), 0.5 / (len(truth) - truth.sum()))
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - truth)) + 1e-4 * beta * [1, 0]
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-4, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * centre / scale)


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """Scores from 0 to 1 of whole lower-cased texts."""
    s, table = model.settings, model.table[:, None]

    def of_block(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        block = Grams(raw, s.sizes, s.bits, _CLASSES, whole_words=True)
        return block.starts - 1, np.column_stack([block.sums(table)[:, 0], block.counts()])

    words = per_text(texts, 2, of_block)
    worsts = np.array([worst_window(w[:, 0], w[:, 1], s.window)[0] for w in words])
    return 1 / (1 + np.exp(-np.clip(model.slope * worsts + model.shift, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[list[bytes], list[int]]:
    """The bounded sample: labelled documents outside the held-out fold, by a hash of their id; labels of one id are averaged.

    Of several texts under one id the first in order is learned from.
    """
    marked = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    # At most twice per_label ids: a proven bound.
    wanted = F.broadcast(few_by_hash(marked, settings.per_label, "y", 2))
    found = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(wanted, "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    found, _ = written(found, "toxicity-sample")
    chosen, chars = [], [0, 0]
    for doc_id, y, n in found.select("doc_id", "y", F.length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if chars[y] + n <= settings.most_chars:
            chars[y] += n
            chosen.append(doc_id)
    rows = found.where(F.col("doc_id").isin(chosen)).orderBy("doc_id").toArrow()
    return lowered(rows["text"].combine_chunks()), rows["y"].to_pylist()


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (higher: likelier toxic), predicted (1 from 0.5 on).

    Null texts and texts without words have a worst window of 0; very long texts are scored whole, in blocks. Where the sample lacks one of the labels, every
    score is the share of toxic ones, kept off 0 and 1. Null labels are not learned from; a null id counts as
    held out. Repeated rows get repeated results. Other columns are ignored; an empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = train(*training_rows(named, labels, settings), settings)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(shipped.value, lowered(batch.column(2)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(scores, pa.float64()), "predicted": pa.array((scores >= 0.5).astype(np.int32))})

    rows = named.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    ship(docs.sparkSession)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
