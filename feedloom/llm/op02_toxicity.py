"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Hash space of the features, a power of two: the weights never exceed 2**BITS pairs of 12 bytes.
BITS = 20
#: Labelled rows that the model is fitted on at most, those of least xxhash64(doc_id).
SAMPLE = 12_000
EPOCHS = 4
ALPHA, BETA, L2 = 1.0, 1.0, 0.1
#: Strengths of the L1 term, of which the one of least log loss on every fourth training row is taken (the rest fits it).
L1 = (1.0, 3.0, 10.0)


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def features(h: np.ndarray) -> np.ndarray:
    """Indices of a text's unigrams, bigrams and one-word skip-grams, given its word hashes."""
    u, shift = common.U, common.U(64 - BITS)
    out = [h >> shift]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            out.append(((h[:-gap] * u(salt) + h[gap:]) * u(0xFF51AFD7ED558CCD)) >> shift)
    return np.concatenate(out).astype(np.int64)


class Ftrl:
    """FTRL-proximal with a rate of its own for each coordinate and L1 sparsity; each feature counts once a text."""

    def __init__(self, size: int, l1: float):
        self.z, self.n, self.bias, self.l1 = np.zeros(size), np.zeros(size), np.zeros(2), l1

    def weight(self, z, n, l1=None):
        l1 = self.l1 if l1 is None else l1
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def step(self, x: np.ndarray, y: int) -> None:
        z, n = self.z[x], self.n[x]
        w, b = self.weight(z, n), float(self.weight(self.bias[0], self.bias[1], 0.0))
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[x] = z + g - sigma * w
        self.n[x] = n + g * g
        sigma = (np.sqrt(self.bias[1] + g * g) - np.sqrt(self.bias[1])) / ALPHA
        self.bias += g - sigma * b, g * g

    def weights(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.weight(self.z, self.n)
        at = np.flatnonzero(w)
        return at, w[at], float(self.weight(self.bias[0], self.bias[1], 0.0))


def run(docs: list[tuple[np.ndarray, int]], l1: float) -> Ftrl:
    model = Ftrl(1 << BITS, l1)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(docs)):
            model.step(*docs[i])
    return model


def loss(model: Ftrl, docs: list[tuple[np.ndarray, int]]) -> float:
    at, w, bias = model.weights()
    table = np.zeros(1 << BITS)
    table[at] = w
    return float(np.mean([np.logaddexp(0, (1 - 2 * y) * (table[x].sum() + bias)) for x, y in docs]))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices, values and bias of the model fitted on labelled (text, y, order); one executor task fits it.

    labelled holds `sample` rows at most (the caller sees to it). The driver gets the sparse weights alone,
    2**BITS at most. Without rows the model is a bias of 0. Held-out rows play no part, in the choice of L1 neither.
    """

    def work(batches):
        import pyarrow as pa

        docs = []
        for batch in batches:
            data, offsets = common.text_buffers(batch.column(0))
            xs = []
            for _, h, at in common.doc_words(data, offsets, letters=True):
                xs += [np.unique(features(h[a:b])).astype(np.int32) for a, b in zip(at[:-1], at[1:])]
            docs += zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), xs)
        docs.sort(key=lambda d: d[0])
        docs = [(x, y) for _, y, x in docs]
        rest, tried = [d for i, d in enumerate(docs) if i % 4], docs[::4]
        best = min(L1, key=lambda l1: loss(run(rest, l1), tried)) if {y for _, y in rest} == {0, 1} else L1[0]
        model = run(docs, best)
        at, w, bias = model.weights()
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int64()), pa.array([*w, bias], pa.float64())], names=["at", "w"])

    rows = common.arrow_map(labelled.select("text", "y", "order").limit(sample).coalesce(1), work, "at long, w double").toPandas()
    bias = rows.loc[rows["at"] < 0, "w"]
    rows = rows[rows["at"] >= 0]
    return rows["at"].to_numpy(np.int64), rows["w"].to_numpy(), float(bias.iloc[0]) if len(bias) else 0.0


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: the probability of label 1 of its whole text.

    Null and empty texts get the bias's probability; repeated rows repeat; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS weights

    def work(batches):
        import pyarrow as pa

        at_, w_, bias = shared.value
        table = np.zeros(1 << BITS, np.float32)
        table[at_] = w_
        used = table != 0
        for batch in batches:
            data, offsets = common.text_buffers(batch.column(1))
            out = np.empty(batch.num_rows)
            for first, h, at in common.doc_words(data, offsets, letters=True):
                for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    x = features(h[a:b])
                    out[first + i] = table[np.unique(x[used[x]])].sum(dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out + bias, -35, 35))))], names=["doc_id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return common.arrow_map(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), work, f"doc_id {kind}, score double")


def training_rows(docs: DataFrame, labels: DataFrame, target: str, sample: int = SAMPLE) -> DataFrame:
    """(text, y, order) of the sample: labelled ids that aren't held out, of least hash, each once; null targets go."""
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(target).cast("int").alias("y"))
        .withColumn("order", F.xxhash64("doc_id"))
        .orderBy("order", "doc_id")
        .limit(sample)
    )
    # at most `sample` slim rows
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y", "order")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, common.read(spark, sf_dir, "labels"), "toxic"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
