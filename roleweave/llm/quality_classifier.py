"""Operator 4: quality classifier, logistic regression on hashed word n-grams.

Words are runs of letters and digits, and runs of other visible characters;
unigrams and bigrams are hashed to ``2 ** BITS`` features, each with its share
of the text's n-grams as value; where a trigram was seen before in the text,
its bigram counts as feature ``SEEN`` instead.  Weights are learned by follow-the-regularised
leader (per coordinate, L1 and L2) in one streamed pass after another over a
bounded sample of labelled rows; scoring is a sparse dot product, a gather of
weights and a sum for each text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .base import Scratch, query, table

BITS = 18
SEEN = 0
KINDS = np.full(256, 2, np.uint8)
KINDS[A.SPACE] = 0
KINDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all uni- and bigrams, and the range of each text (words, then word pairs, by place)."""
    w = A.Words(data, offsets, KINDS)
    pairs = A.mix(w.hash[:-1] * A.BASES[0] + w.hash[1:]) if len(w.hash) > 1 else np.zeros(0, A.U)
    text = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    whole = np.flatnonzero(text[2:] == text[:-2])
    triples = A.mix(pairs[whole] * A.BASES[0] + w.hash[whole + 2])
    order = np.lexsort((triples, text[whole]))
    again = (triples[order][1:] == triples[order][:-1]) & (text[whole][order][1:] == text[whole][order][:-1])
    seen = whole[order[1:][again]]
    both = np.empty(2 * len(w.hash), np.int64)
    both[::2] = (w.hash >> A.U(64 - BITS)).astype(np.int64)
    both[1:-1:2] = (pairs >> A.U(64 - BITS)).astype(np.int64)
    both[2 * seen + 1] = SEEN
    keep = np.ones(len(both), bool)
    last = w.bounds[1:][np.diff(w.bounds) > 0] - 1
    keep[2 * last + 1] = False  # no pair across texts
    count = np.diff(w.bounds)
    size = np.maximum(2 * count - 1, 0)
    return both[keep], np.concatenate(([0], np.cumsum(size)))


def _features():
    def run(batches):
        for batch in batches:
            data, offsets = A.utf8(batch.column("text"))
            for lo, hi in A.slices(offsets):
                f, bounds = ngrams(data, offsets[lo : hi + 1])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(f.astype(np.int32)))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("rank"), part.column("label"), lists], names=["rank", "label", "f"])

    return run


class Ftrl:
    """Follow the regularised leader, per coordinate."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float, scale: float):
        self.alpha, self.beta, self.l1, self.l2, self.scale = alpha, beta, l1, l2, scale
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, f: np.ndarray) -> np.ndarray:
        z = self.z[f]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[f])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, features: np.ndarray, label: int) -> None:
        f, x = np.unique(features, return_counts=True)
        f, x = np.append(f, 1 << BITS), np.append(x * (self.scale / max(1, len(features))), 1.0)
        w = self.weights(f)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[f] + g * g) - np.sqrt(self.n[f])) / self.alpha
        self.z[f] += g - sigma * w
        self.n[f] += g * g


def _train(epochs: int, options: dict):
    def run(batches):
        rows = []
        for batch in batches:
            lists = A.Lists(batch.column("f"))
            for r, label in enumerate(batch.column("label").to_pylist()):
                rows.append((lists[r].copy(), label))
        model = Ftrl(**options)
        for _ in range(epochs):
            for f, label in rows:
                model.learn(f, label)
        w = model.weights(np.arange((1 << BITS) + 1)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])

    return run


def train(labelled: DataFrame, max_rows: int = 12_000, epochs: int = 3, alpha=0.5, beta=1.0, l1=0.05, l2=0.1, scale=20.0) -> np.ndarray:
    """Weights from rows (id, text, label), the bias last.

    Learns from at most ``max_rows`` rows, those of least hash of their id: a
    bounded sample, whatever the input.  Features are made by all tasks; one
    task runs the learner, which is sequential, over the sample.
    """
    sample = labelled.select(F.xxhash64(F.col("id").cast("string")).alias("rank"), F.col("label").cast("int").alias("label"), "text")
    scratch = Scratch(labelled.sparkSession, "classifier")
    feats = scratch.write(sample.mapInArrow(_features(), "rank long, label int, f array<int>"), "features")
    options = {"alpha": alpha, "beta": beta, "l1": l1, "l2": l2, "scale": scale}
    ordered = feats.orderBy("rank", "label", F.size("f")).limit(max_rows).coalesce(1)
    rows = ordered.mapInArrow(_train(epochs, options), "weights binary").collect()
    scratch.drop(feats)
    return np.frombuffer(rows[0]["weights"], np.float32) if rows else np.zeros((1 << BITS) + 1, np.float32)


def _score(shared, scale: float):
    def run(batches):
        weights = shared.value.astype(np.float64)
        for batch in batches:
            data, offsets = A.utf8(batch.column("text"))
            scores = np.zeros(len(batch))
            for lo, hi in A.slices(offsets):
                f, bounds = ngrams(data, offsets[lo : hi + 1])
                sums = np.concatenate(([0.0], np.cumsum(weights[f])))
                sums = sums[bounds[1:]] - sums[bounds[:-1]]
                scores[lo:hi] = weights[-1] + scale * sums / np.maximum(1, np.diff(bounds))
            scores = 1 / (1 + np.exp(-np.clip(scores, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], names=["id", "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray, scale: float = 20.0) -> DataFrame:
    """(id, score) of every row of docs (id, text); a text without words has the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB, whatever the data
    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(_score(shared, scale), f"id {kind}, score double")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3, **options) -> DataFrame:
    """Score of every whole text for label 1, learned from labels of rows that are not held out.

    Rows: id, held_out (crc32 of the id as text is divisible by 5), score,
    predicted (1 if score >= cut); one for each input row.

    Null texts count as empty and, like texts without words, get the bias.  A
    null id is not held out and has no label.  Labels other than 0 and 1 are
    ignored; several labels of an id are examples each.  Without labels every
    score is 0.5.  Repeated rows are answered alike.  An empty table gives an
    empty result; further columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("label in (0, 1) and id is not null")
    known = known.filter(~held_out(F.col("id")))
    max_rows = options.get("max_rows", 12_000)
    known = known.orderBy(F.xxhash64(F.col("id").cast("string")), "id", "label").limit(max_rows)
    weights = train(docs.join(known, "id"), **options)
    scored = score(docs, weights, options.get("scale", 20.0))
    return scored.select(
        "id", held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted")
    )


@query("op4_quality_classifier")
def op4(spark, sf_dir):
    out = classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")
