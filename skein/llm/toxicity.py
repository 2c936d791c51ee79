"""Toxicity by multiple-instance learning (operator 9).

A document is a bag of sentences. A sentence's score is a logistic function of its words' weights; the document's is
the noisy-or of its sentences' (one minus the product of one minus each). Weights are trained from document labels
alone, so the model itself finds which sentences carry the label, and ``scored`` names the worst sentence.

A word's weight is the sum of the hashed weights of the word and of its first three to six letters, so inflected forms
share evidence; a penalty on absolute weights (``SPARSE``) keeps only words that many documents bear out. Training uses a
bounded sample: up to about ``POSITIVE`` and ``NEGATIVE`` labelled documents, weighted back to the share of each label, and
of these, in hashed order, as many as fit in ``MOST_IDS`` features. All documents are scored on their whole texts.

Defined results: null, empty and word-less texts score 0. Labels that are null are ignored; a document with several
labels counts as toxic if one says so. Without labels of both kinds every score is 0. Labels, lang, source
and doc_id never reach a score. Rows without doc_id are scored but never learned from. Repeated rows are scored one by
one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import slices, written

POSITIVE, NEGATIVE, MOST_IDS = 2_500, 5_000, 16_000_000
BITS, EPOCHS, RATE, SPARSE = 18, 50, 0.3, 1e-4

#: Enders of sentences become line breaks, other ASCII signs blanks.
_TABLE = bytes(10 if c in b".!?\n" else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def sentences(text: str | None) -> list[list[bytes]]:
    """Words of each sentence that has one."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE)
    return [words for s in raw.split(b"\n") if (words := s.split())]


def _ids(word: bytes) -> tuple[int, ...]:
    whole = word.decode("utf-8", "replace")
    heads = (f"{k}{whole[:k]}" for k in (3, 4, 5, 6) if len(whole) >= k)
    return tuple(xxhash.xxh32_intdigest(x) >> (32 - BITS) for x in (word, *heads))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        known: dict[bytes, tuple] = {}
        bags = []
        for text in batch.column("text").to_pylist():
            bags.append([[i for w in dict.fromkeys(s) for i in (known.get(w) or known.setdefault(w, _ids(w)))] for s in sentences(text)])
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(x) for x in bags], pa.int32()), batch.column("toxic"),
             pa.array([[len(s) for s in x] for x in bags], pa.list_(pa.int32())),
             pa.array([[i for s in x for i in s] for x in bags], pa.list_(pa.int32())), batch.column("at")],
            names=["n", "toxic", "sizes", "ids", "at"],
        )


def train(toxic: np.ndarray, counts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of hashed words and, last, the bias, by adaptive proximal gradient steps on the weighted log-loss of the noisy-or.

    ``counts`` sentences a document, ``sizes`` features a sentence, ``ids`` the features, end to end."""
    w, seen = np.zeros(2**BITS + 1), np.full(2**BITS + 1, 1e-8)
    w[-1] = -6.0
    s_at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    d_at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    of_sentence, of_doc = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(counts)), counts)
    weight = weight / weight.sum()
    for _ in range(EPOCHS):
        z = np.add.reduceat(w[ids], s_at) + w[-1]
        total = np.add.reduceat(np.logaddexp(0, z), d_at)
        miss = np.exp(-total)
        slope = weight * np.where(toxic, -miss / np.maximum(1 - miss, 1e-9), 1.0)
        dz = slope[of_doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(ids, dz[of_sentence], 2**BITS), dz.sum())
        seen += grad**2
        step = RATE / np.sqrt(seen)
        w -= step * grad
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step[:-1] * SPARSE, 0)
    return w


def _that_fit(rows: DataFrame) -> DataFrame:
    """``at`` of the rows that are taken in its order, as long as they have ``MOST_IDS`` features together."""
    total, taken = 0, []
    for at, size in sorted(tuple(r) for r in rows.groupBy("at").agg(F.sum(F.size("ids"))).collect()):  # a row a sampled document
        if total + size <= MOST_IDS:
            total += size
            taken.append((at,))
    return rows.sparkSession.createDataFrame(taken, "at long")


def model(docs: DataFrame, labels: DataFrame, learn_from: Column, positive: int = POSITIVE, negative: int = NEGATIVE) -> np.ndarray | None:
    """Weights trained on the documents that ``labels`` (doc_id, toxic) mark and ``learn_from`` (a condition) allows."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    labels = labels.where("doc_id is not null and toxic is not null").where(learn_from)
    labels = written(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    n = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return None
    part = {1: min(1.0, positive / n[1]), 0: min(1.0, negative / n[0])}
    least = F.when(F.col("toxic") == 1, F.lit(int(part[1] * 1e6))).otherwise(F.lit(int(part[0] * 1e6)))
    some = labels.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < least)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    at = F.xxhash64(F.lit("order"), "doc_id", "text").alias("at")
    rows = rows.join(F.broadcast(some.limit(2 * (positive + negative))), "doc_id").select("text", "toxic", at)
    rows = rows.mapInArrow(_bags, "n int, toxic int, sizes array<int>, ids array<int>, at long").where("n > 0")
    rows = written(rows, "bags")
    rows = rows.join(F.broadcast(_that_fit(rows)), "at").toArrow()
    toxic = rows["toxic"].to_numpy() == 1
    if not toxic.any() or toxic.all():
        return None
    flat = lambda c: rows[c].combine_chunks().flatten().to_numpy()
    return train(toxic, rows["n"].to_numpy(), flat("sizes"), flat("ids"), np.where(toxic, 1 / part[1], 1 / part[0]))


def scored(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """doc_id, score, and the worst sentence: its number from 0, score and words; null for texts without a word."""
    if weights is None:
        weights = np.append(np.zeros(2**BITS), -800.0)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2 ** BITS floats, 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value

        class Known(dict):
            def __missing__(self, word):
                value = self[word] = float(sum(w[i] for i in _ids(word)))
                return value

        known = Known()
        for batch in slices(batches, "text"):
            if len(known) > 300_000:
                known.clear()
            score, at, worst, said = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = sentences(text)
                if not own:
                    score.append(0.0), at.append(None), worst.append(None), said.append(None)
                    continue
                z = np.array([sum(map(known.__getitem__, dict.fromkeys(s))) for s in own]) + float(w[-1])
                score.append(float(-np.expm1(-np.logaddexp(0, z).sum())))
                at.append(int(z.argmax()))
                worst.append(float(1 / (1 + np.exp(-z.max()))))
                said.append(b" ".join(own[at[-1]]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(at, pa.int32()), pa.array(worst, pa.float64()), pa.array(said, pa.string())],
                names=["doc_id", "score", "worst_at", "worst_score", "worst_sentence"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, worst_at int, worst_score double, worst_sentence string")
