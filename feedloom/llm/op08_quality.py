"""Quality classifier: co-training of a text-content view and a page-metadata view."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the views start from at most, those of least xxhash64(doc_id).
SAMPLE = 20_000
ROUNDS = 3
#: A view teaches the other where its calibrated probability is this far from 0 or 1.
CONFIDENT = 0.97
RIDGE = 1.0
#: Documents below a probability of good quality are rejected. It is chosen between these bounds, so that of good labelled rows
#: about this share at most falls below it when scored by models of the other rows.
REJECT, LOSS, FOLDS = (0.3, 0.8), 0.005, 5

MARKS = "!|%*#$&=<>{}[]_\\^~@+"
SOURCES, LANGS = 32, 8
CONTENT = 18 + len(MARKS)
META = 3 + SOURCES + LANGS


def content(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Shape figures of one whole text, given its bytes and its word hashes."""
    n = len(data)
    x = np.zeros(CONTENT)
    x[0] = 1
    if not n:
        return x
    count = np.bincount(data, minlength=256)
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    w = max(len(words), 1)
    x[1] = np.log1p(n) / 10
    x[2] = np.log1p(w) / 10
    x[3] = count[65:91].sum() / max(letters, 1)
    x[4] = letters / n
    x[5] = count[48:58].sum() / n
    x[6] = count[128:].sum() / n
    x[7] = (count[46] + count[44] + count[63] + count[59] + count[58]) / w
    x[8] = min((n - w) / w, 40) / 10
    x[9] = np.log1p(count[10]) / np.log1p(w + 1)
    if len(words):
        _, times = np.unique(words, return_counts=True)
        x[10] = len(times) / w
        x[11] = times.max() / w
        x[12] = (times * times).sum() / (w * w)
        x[13] = np.log(len(times)) / np.log(w + 1)
    if len(words) > 2:
        pairs = words[:-1] * common.U(0x9E3779B97F4A7C15) + words[1:]
        x[14] = len(np.unique(pairs)) / len(pairs)
    at = np.flatnonzero(data == 10)
    line = np.diff(np.concatenate([[-1], at, [n]])) - 1
    x[15] = min(line.mean(), 2000) / 1000
    x[16] = min(line.std(), 2000) / 1000
    x[17] = (count[:32].sum() - count[9] - count[10] - count[13]) / n
    for i, c in enumerate(MARKS):
        x[18 + i] = min(count[ord(c)] / w, 2)
    return x


def meta(lang, source, n_chars) -> np.ndarray:
    """The metadata of one page; nulls are a value like any other."""
    x = np.zeros(META)
    size = np.log1p(max(n_chars or 0, 0)) / 10
    x[0], x[1], x[2] = 1, size, size * size
    x[3 + zlib.crc32(repr(source).encode()) % SOURCES] = 1
    x[3 + SOURCES + zlib.crc32(repr(lang).encode()) % LANGS] = 1
    return x


def views(batch, text: int, lang: int, source: int, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """The matrices of both views for the rows of an Arrow batch, whose columns are given by position."""
    n = batch.num_rows
    a, b = np.empty((n, CONTENT)), np.empty((n, META))
    data, offsets = common.text_buffers(batch.column(text))
    for first, h, at in common.doc_words(data, offsets):
        for i, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
            k = first + i
            a[k] = content(data[offsets[k] : offsets[k + 1]], h[lo:hi])
    memo: dict = {}
    for k, (la, so, ch) in enumerate(zip(batch.column(lang).to_pylist(), batch.column(source).to_pylist(), batch.column(chars).to_pylist())):
        if (key := (la, so)) not in memo:
            memo[key] = meta(la, so, None)
        b[k] = memo[key]
        size = np.log1p(max(ch or 0, 0)) / 10
        b[k, 1], b[k, 2] = size, size * size
    return a, b


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def newton(w, grad, hess):
    """One ridge-damped Newton step, no longer than 5 in any coordinate."""
    step = np.linalg.solve(hess + RIDGE * np.eye(len(w)), grad + RIDGE * w)
    return w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))


def sums(x, y, w):
    p = sigmoid(x @ w)
    return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


def calibrate(score, y) -> tuple[float, float]:
    """Platt scaling with smoothed targets: (slope, offset). Scores that separate the labels get a finite slope, useless ones none."""
    good, bad = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    middle, scale = float(np.mean(score)), max(float(np.std(score)), 1e-9)
    x, v = np.stack([(score - middle) / scale, np.ones(len(score))], 1), np.array([1.0, 0.0])
    bound = np.linalg.inv(x.T @ x / 4 + 0.01 * np.eye(2))  # of the Hessian: steps never overshoot
    for _ in range(200):
        v = v - bound @ (x.T @ (sigmoid(x @ v) - t) + 0.01 * v)
    slope = max(float(v[0]), 0.0) / scale
    return slope, float(v[1]) - slope * middle


def start(xs, y) -> list[np.ndarray]:
    """The weights of each view fitted on labelled rows alone."""
    ws = [np.zeros(x.shape[1]) for x in xs]
    for _ in range(12):
        ws = [newton(w, *sums(x, y, w)) for x, w in zip(xs, ws)]
    return ws


def log_odds(y) -> float:
    return float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))


def combined(xs, ws, cal, prior: float) -> np.ndarray:
    """The probability of good quality by both views: their calibrated log odds, the prior counted once."""
    return sigmoid(sum(c * (x @ w) + d - prior for x, w, (c, d) in zip(xs, ws, cal)) + prior)


def threshold(xs, y) -> float:
    """REJECT's choice by cross-validation over the labelled rows."""
    fold, good = np.arange(len(y)) % FOLDS, []
    for f in range(FOLDS):
        seen, rest = fold != f, (fold == f) & (y == 1)
        if not 0 < y[seen].sum() < seen.sum():
            continue
        part = [x[seen] for x in xs]
        ws = start(part, y[seen])
        cal = [calibrate(x @ w, y[seen]) for x, w in zip(part, ws)]
        good.append(combined([x[rest] for x in xs], ws, cal, log_odds(y[seen])))
    good = np.concatenate(good) if good else np.zeros(0)
    return float(np.clip(np.quantile(good, LOSS), *REJECT)) if len(good) else REJECT[0]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> dict | None:
    """The model: weights and calibration of both views, and the prior log odds. None if one class has no label.

    Labelled rows (at most `sample`) start both views. Then in each round every unlabelled document is scored by
    both; where one view is confident, its label teaches the other. These sums run over all documents in the
    executors; the driver gets gradients and Hessians only, whose size is fixed. A round after which a view tells the
    labelled rows apart much worse than at the start is undone and ends the rounds.
    """
    picked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    picked = picked.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample)

    def figures(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = views(batch, 1, 2, 3, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in a.astype(np.float32)], pa.binary()), pa.array([r.tobytes() for r in b.astype(np.float32)], pa.binary())], names=["doc_id", "a", "b"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = docs.select("doc_id", "text", "lang", "source", "n_chars")
    table = common.cut(common.arrow_map(table, figures, f"doc_id {kind}, a binary, b binary"), "views")
    seen = table.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("y").alias("y"), F.first("order").alias("order")).toPandas()  # `sample` rows at most
    seen = seen.sort_values("order")
    y = seen["y"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return None
    xs = [np.stack([np.frombuffer(v, np.float32) for v in seen[c]]).astype(float) for c in "ab"]
    ws = start(xs, y)
    pool = table.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_anti").select("a", "b")
    scale = lambda: [calibrate(x @ w, y) for x, w in zip(xs, ws)]

    def loss(w, x):
        (c, d), z = calibrate(x @ w, y), x @ w
        return float(np.logaddexp(0, np.where(y == 1, -1, 1) * (c * z + d)).mean())

    bound = [loss(w, x) + 0.1 for w, x in zip(ws, xs)]
    sane = lambda new: all(loss(w, x) <= most for w, x, most in zip(new, xs, bound))
    for _ in range(rounds):
        model = (ws, scale())

        def teach(batches, model=model):
            import pyarrow as pa

            (wa, wb), cal = model
            total = None
            for batch in batches:
                x = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(float) for i in (0, 1)]
                p = [sigmoid(cal[i][0] * (x[i] @ w) + cal[i][1]) for i, w in enumerate((wa, wb))]
                part = []
                for i, w in enumerate((wa, wb)):
                    for label in (0.0, 1.0):
                        sure = (p[1 - i] if label else 1 - p[1 - i]) >= CONFIDENT
                        z = x[i][sure]
                        part += [[sure.sum()], z.T @ (sigmoid(z @ w) - label), (z.T @ z).ravel() / 4]  # the Hessian's upper bound
                part = np.concatenate(part)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

        got = dict(common.arrow_map(pool, teach, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect())  # a few thousand rows, whatever the input
        if not got:
            break
        v, at, new = np.array([got[i] for i in range(len(got))]), 0, []
        for x, w in zip(xs, ws):
            d, old, g, h = len(w), w, 0.0, 0.0
            for label in (0, 1):
                n, here = v[at], float((y == label).sum())
                weight = 0.5 * min(1.0, here / n) if n else 0.0  # the taught of a class never outweigh its labelled rows
                g = g + weight * v[at + 1 : at + 1 + d]
                h = h + weight * v[at + 1 + d : at + 1 + d + d * d].reshape(d, d)
                at += 1 + d + d * d
            for _ in range(4):
                g0, h0 = sums(x, y, w)
                w = newton(w, g0 + g + h @ (w - old), h0 + h)  # the pool's loss by a quadratic that bounds it
            new.append(w)
        if not sane(new):
            break
        ws = new
    return {"w": ws, "cal": scale(), "prior": log_odds(y), "reject": threshold(xs, y)}


def classify(df: DataFrame, model: dict | None) -> DataFrame:
    """df with the columns _score (probability of good quality, by both views) and _keep.

    Both views' calibrated log odds are added, the prior counted once; the threshold is the model's. Without a model
    every row has score 0.5 and is kept. Null and empty texts are judged like any other; repeated rows repeat; an empty table gives no rows;
    columns that df has besides are passed through.
    """
    if model is None:
        return df.withColumn("_score", F.lit(0.5)).withColumn("_keep", F.lit(True))
    shared = df.sparkSession.sparkContext.broadcast(model)  # two short vectors

    names = df.columns
    at = {c: i for i, c in enumerate(names)}
    lacking = [c for c in ("text", "lang", "source", "n_chars") if c not in at]
    if lacking:
        raise ValueError(f"no column {lacking}")
    where = [at[c] for c in ("text", "lang", "source", "n_chars")]

    def work(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            a, b = views(batch, *where)
            # the figures are of single precision in training
            p = combined([x.astype(np.float32).astype(float) for x in (a, b)], m["w"], m["cal"], m["prior"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(p >= m["reject"])], names=[*names, "_score", "_keep"])

    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    return common.arrow_map(df, work, StructType([*df.schema.fields, StructField("_score", DoubleType()), StructField("_keep", BooleanType())]))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    model = train(docs, common.read(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", F.col("_score").alias("score"), F.col("_keep").alias("keep"))
