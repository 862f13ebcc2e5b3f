"""Quality classification by nearest-neighbour voting over latent-semantic vectors.

Terms are pairs of neighbouring character classes (each ASCII sign is a class of its own; lower case, capitals,
digits, spaces, line ends and other scripts are one class each), words that repeat the word before them, by
length, and words hashed to a fixed number of places, so a term count needs no vocabulary. A bounded
sample of labelled documents gives inverse document frequencies and a truncated singular value decomposition;
its vectors and labels are broadcast. Every document is projected, and exact cosine products with all labelled
vectors, in blocks, give its nearest neighbours, whose labels vote with the weight of their similarity.

Defined results: a text without any pair (null, empty, one character) has no neighbours and scores the share of
label 1 in the sample; labels that are null are not learnt, several labels of a document count as their mean;
without any label every score is 0.5; ties at the last neighbour go to the earlier labelled id; repeated rows
score alike; extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, flat_bytes, mapped, slices, tidy, whole_text, word_hashes

#: Labelled documents that the classifier learns from, at most: those of the smallest hash of their id.
SAMPLE = 4096
RANK = 48
NEIGHBOURS = 15
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[0x80:] = 1
    table[ord("a") : ord("z") + 1] = 2
    table[ord("A") : ord("Z") + 1] = 3
    table[ord("0") : ord("9") + 1] = 4
    signs = [b for b in range(32, 127) if not chr(b).isalnum()]
    table[signs] = np.arange(5, 5 + len(signs))
    table[ord("\n")] = 5 + len(signs)
    return table


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1
PAIRS = N_CLASSES * N_CLASSES
LENGTHS = 16
#: Places that words, A-Z as small letters, are hashed to, and the weight of such a term beside one of a pair.
HASHED = 256
WORD_WEIGHT = 0.5
TERMS = PAIRS + LENGTHS + HASHED
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that part words.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def term_counts(column) -> np.ndarray:
    """Counts of each term in each row of a text column."""
    data, offsets = flat_bytes(column)
    n = len(offsets) - 1
    if len(data) < 2:
        return np.zeros((n, TERMS), np.float32)
    classes = CLASSES[data].astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    pairs = row[:-1] * TERMS + classes[:-1] * N_CLASSES + classes[1:]
    word, of, length = word_hashes(_LOWER[data], offsets, ~BLANK[data])
    again = np.flatnonzero((word[1:] == word[:-1]) & (of[1:] == of[:-1])) + 1
    repeats = of[again] * TERMS + PAIRS + np.minimum(length[again], LENGTHS - 1)
    words = of * TERMS + PAIRS + LENGTHS + (word % np.uint64(HASHED)).astype(np.int64)
    return np.bincount(np.concatenate((pairs[row[:-1] == row[1:]], repeats, words)), minlength=n * TERMS).reshape(n, TERMS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    """Scales the rows to length 1, in place; rows without length stay."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    x /= np.where(norm > 1e-12, norm, 1)
    return x


@dataclass
class Neighbours:
    """Labelled vectors in the latent space; all parts have a size that the sample bound fixes."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(np.log1p(counts) * self.weight) @ self.basis)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        out = np.full(len(counts), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return out
        near = self.project(counts) @ self.vectors.T
        # equal products rank by the position of the labelled row
        near = near.astype(np.float64) - np.arange(near.shape[1]) * 1e-12
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0) ** 8
        total = weight.sum(1)
        voted = (total > 1e-12) & (counts.sum(1) > 0)
        out[voted] = ((weight * self.labels[top]).sum(1)[voted] / total[voted]).clip(0, 1)
        return out


def leading(x: np.ndarray, rank: int, rounds: int = 24, more: int = 16) -> np.ndarray:
    """The leading right singular vectors of x, as columns, by subspace iteration: no matrix of terms by terms is made."""
    width = min(rank + more, *x.shape)
    basis = np.linalg.qr(np.random.default_rng(10).standard_normal((x.shape[1], width)))[0].astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    # within the subspace the exact vectors, in order of their singular values
    turned = np.linalg.svd(x @ basis, full_matrices=False)[2].T
    return (basis @ turned)[:, :rank].astype(np.float32)


def fit(logs: np.ndarray, labels: np.ndarray) -> Neighbours:
    """Fits on log(1 + count) of each term in each labelled document."""
    if not len(labels):
        return Neighbours(np.ones(TERMS, np.float32), np.zeros((TERMS, RANK), np.float32), np.zeros((0, RANK), np.float32), labels, 0.5)
    weight = (np.log((1 + len(logs)) / (1 + np.count_nonzero(logs, axis=0))) + 1).astype(np.float32)
    weight[PAIRS + LENGTHS :] *= WORD_WEIGHT
    x = logs.astype(np.float32)
    x *= weight
    _unit(x)
    basis = leading(x, RANK)
    return Neighbours(weight, basis, _unit(x @ basis), labels, float(labels.mean()))


def sampled(docs: DataFrame, labels: DataFrame, label: str, training: F.Column, size: int, text: str = "text") -> DataFrame:
    """Texts and labels of ``size`` labelled documents at most, those of the smallest hash; one row for each id."""
    pick = F.xxhash64("doc_id", F.lit(10))
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & training).groupBy("doc_id").agg(F.avg(label).alias("_label")).orderBy(pick, "doc_id").limit(size)
    texts = docs.select("doc_id", whole_text(text).alias("_text")).join(F.broadcast(chosen), "doc_id")
    return texts.orderBy(pick, "doc_id", F.xxhash64("_text")).limit(size)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT


def train(docs: DataFrame, marks: DataFrame, label: str = "quality", size: int = SAMPLE) -> Neighbours:
    """Fits on labelled rows outside the held-out fold. The driver gets ``size`` term vectors of half precision at most."""

    def count(batches):
        for batch in batches:
            for a, b in slices(batch, "_text", rows=256):
                part = batch.slice(a, b - a)
                logs = np.log1p(term_counts(part.column("_text"))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("_label"), pa.array([x.tobytes() for x in logs], pa.binary())], ["label", "logs"])

    rows = mapped(sampled(docs, marks, label, ~held_out(), size).select("_label", "_text"), count, "label double, logs binary").toArrow()
    logs = np.empty((rows.num_rows, TERMS), np.float16)
    for i, x in enumerate(rows.column("logs")):
        logs[i] = np.frombuffer(x.as_buffer(), np.float16)
    labels = rows.column("label").to_numpy()
    del rows
    model = fit(logs, labels)
    del logs
    tidy(docs.sparkSession)
    return model


def score_texts(df: DataFrame, model: Neighbours, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the model's score of every whole text; all columns of ``df`` stay (one of this name is replaced)."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in (name, "_text")]

    def run(batches):
        for batch in batches:
            for a, b in slices(batch, "_text", rows=256):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(sent.value.score(term_counts(part.column("_text"))))], [*kept, name])

    own = df.select(*(F.col(f"`{c}`") for c in kept))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields)
    return mapped(df.select(*(F.col(f"`{c}`") for c in kept), whole_text(text).alias("_text")), run, f"{fields}{name} double")


def op10_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_texts(docs.select("doc_id", F.col("text").alias("_of")), model, "_of")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_quality_neighbours": op10_quality_neighbours}
ORACLE_SQL: dict[str, str] = {}
