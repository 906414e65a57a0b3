"""Toxicity scores by non-negative positive-unlabelled learning.

Linear classifiers over hashed words are trained from confirmed toxic texts (P) and unlabelled ones (U): a sample of all
documents, whether or not somebody labelled them, in which labels are not looked at. With class prior p and logistic loss l, the risk of calling U negative, corrected for the positives in it, is
    p * E_P[l(+)] + max(0, E_U[l(-)] - p * E_P[l(-)]);
where the part in max() falls below zero in a batch, the step ascends it instead, so that it can't be driven there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import PLAIN, REMEMBERED, byte_rows

#: Texts that training takes at most, confirmed and unlabelled: the bound of the sample, and of what reaches the driver
#: (the distinct words of each). A hash of doc_id decides which ones.
MOST_POSITIVE, MOST_UNLABELLED = 4_000, 12_000
BITS = 18
CLASSIFIERS = 3
#: A word is a feature if the evidence (in nats) that P holds it more or less often than U is at least this.
EVIDENCE = 8.0


class Slots(dict):
    """word -> feature slot."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = slot = xxhash.xxh3_64_intdigest(word) >> (64 - BITS)
        return slot


def features(text: bytes, slots: Slots) -> np.ndarray:
    """Slots of the distinct words of a whole text."""
    words = set(text.translate(PLAIN).split())
    return np.unique(np.fromiter(map(slots.__getitem__, words), dtype=np.int32, count=len(words)))


def slope(z: np.ndarray, n_p: int, prior: float) -> np.ndarray:
    """What to descend by, for each margin of a batch (P first, then U): the gradient of the risk, or where its part in
    max() is negative, that of the part's negation."""
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = np.logaddexp(0, z)
    p, u = slice(0, n_p), slice(n_p, None)
    g, n_u = np.empty(len(z)), len(z) - n_p
    if soft[u].mean() >= prior * soft[p].mean():
        g[p], g[u] = -prior / n_p, s[u] / n_u
    else:
        g[p], g[u] = prior * s[p] / n_p, -s[u] / n_u
    return g


def train(rows: list[np.ndarray], confirmed: int, prior: float, seed: int, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier. rows: each text's slots; the first ones are P, the others U."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    in_p = np.bincount(np.concatenate(rows[:confirmed]), minlength=size).astype(float)
    in_u = np.bincount(np.concatenate(rows[confirmed:]), minlength=size).astype(float)
    expected = (in_u + 1) * confirmed / (len(rows) - confirmed)
    usable = in_p * np.log(np.maximum(in_p, 1e-9) / expected) - (in_p - expected) >= EVIDENCE
    rows = [r[usable[r]] for r in rows]
    weights, bias = np.zeros(size), np.log(prior / (1 - prior))
    moment, bias_moment = np.zeros(size), 0.0  # squared gradients (Adagrad)
    p_rows, u_rows = np.arange(confirmed), np.arange(confirmed, len(rows))
    for _ in range(epochs):
        batches = max(1, len(u_rows) // 256)
        for p, u in zip(np.array_split(rng.permutation(p_rows), batches), np.array_split(rng.permutation(u_rows), batches)):
            if not len(p):
                p = rng.choice(p_rows, 1)
            both = np.concatenate((p, u))
            slots = np.concatenate([rows[i] for i in both])
            row = np.repeat(np.arange(len(both)), [len(rows[i]) for i in both])
            z = bias + np.bincount(row, weights[slots], minlength=len(both))
            g = slope(z, len(p), prior)
            touched, at = np.unique(slots, return_inverse=True)
            grad = np.bincount(at, g[row], minlength=len(touched)) + 1e-6 * weights[touched]
            moment[touched] += grad * grad
            weights[touched] -= 0.5 * grad / np.sqrt(moment[touched] + 1e-8)
            bias_moment += g.sum() ** 2
            bias -= 0.2 * g.sum() / np.sqrt(bias_moment + 1e-8)
    return weights.astype(np.float32), float(bias)


def held_out(doc_id) -> F.col:
    """The rows whose labels are never learnt from: crc32 of doc_id as text, by 5, leaves 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, prior: float | None = None) -> list[tuple[np.ndarray, float]]:
    """Classifiers from confirmed toxic documents and a sample of all documents.

    Labels are read of rows that are not held out, and only to confirm. prior is the share of toxic documents in the
    corpus; by default that of confirmed rows in the rows of labels, which supposes that labels were given to a random
    sample. Rows that repeat a doc_id are one text. Without a confirmed document there is no classifier, and every score
    is 0.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("toxic"))
    known = known.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    if not n_toxic:
        return []
    order, no = F.xxhash64(F.lit(17), "doc_id"), F.lit(False)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    p = known.filter("toxic").orderBy(order).limit(MOST_POSITIVE).select("doc_id", F.lit(True).alias("p"), no.alias("u"))
    u = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(order).limit(MOST_UNLABELLED)
    chosen = p.union(u.select("doc_id", no, F.lit(True))).groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            found = [features(t or b"", slots).tolist() for t in byte_rows(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "p", "u", "slots"])

    # chosen has a fixed bound of rows, so it may be broadcast whatever the corpus' size.
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "p", "u", "text")
    rows = rows.mapInArrow(extract, "doc_id long, p boolean, u boolean, slots array<int>")
    table = rows.groupBy("doc_id").agg(F.min(F.struct("p", "u", "slots")).alias("r")).select("doc_id", "r.*").toArrow().sort_by("doc_id")
    in_p, in_u = (table.column(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("p", "u"))
    if not in_p.any() or not in_u.any():
        return []
    slots = [np.asarray(x, dtype=np.int32) for chunk in table.column("slots").chunks for x in chunk.to_numpy(zero_copy_only=False)]
    if prior is None:
        prior = min(0.9, max(1e-4, n_toxic / n))
    use = [slots[i] for i in (*np.flatnonzero(in_p), *np.flatnonzero(in_u))]
    return [train(use, int(in_p.sum()), prior, seed) for seed in range(CLASSIFIERS)]


def score(documents: DataFrame, models: list[tuple[np.ndarray, float]]) -> DataFrame:
    """Every document with its score, the mean of the classifiers' probabilities over its whole text. A null text
    counts as empty; null and repeated ids stay as they are."""
    used = np.flatnonzero(np.sum([np.abs(w) for w, _ in models], axis=0)) if models else np.empty(0, dtype=np.int64)
    small = np.array([w[used] for w, _ in models], dtype=np.float32)
    biases = np.array([b for _, b in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        weights = np.zeros((1 << BITS, max(1, len(models))), dtype=np.float32)
        if models:
            weights[used] = small.T
        for batch in batches:
            out = []
            for text in byte_rows(batch.column(1)):
                if not models:
                    out.append(0.0)
                    continue
                z = weights[features(text or b"", slots)].sum(axis=0, dtype=np.float64) + biases
                out.append(float(np.mean(1 / (1 + np.exp(-np.clip(z, -500, 500))))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double")
