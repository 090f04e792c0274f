"""Toxicity scores by a linear classifier over character n-grams with naive Bayes features (operator 9).

Features are the hashed byte n-grams (4 and 5 bytes, A-Z in lower case, runs of other ASCII signs as one gap, a gap
before and after the text) that a text holds, each counted once. A feature's value is its naive Bayes log-count ratio
r = ln((toxic texts with it + s) / (all toxic + 2 s)) - ln((others with it + s) / (all others + 2 s)). A logistic
regression on these values, with an L2 penalty, gives the weights.

The model is fitted on at most ``TRAIN`` labelled rows (half of each class, those of the least hashed ids). Whole texts
are read, in training as in scores: executors count the features of the sampled texts, and only those features reach the
driver that at least ``LEAST`` of them hold and whose log-likelihood ratio between the classes is at least ``GAIN``; the
others have no weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .langid import _GAP, held_out

#: Most labelled rows of the training sample.
TRAIN = 3000
DIM_BITS, GRAMS, LEAST, GAIN = 20, (4, 5), 3, 12.0
SMOOTH, PENALTY, STEPS = 0.5, 3e-4, 300


@dataclass
class Model:
    weight: np.ndarray  # r times the regression's weight, by feature
    bias: float


def hashes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature and row of each n-gram of each text."""
    data, offsets = C.text_bytes(array)
    codes = _GAP[data]
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(array), dtype=np.int32), lengths)
    keep = codes != 32
    if len(keep) > 1:
        keep[1:] |= codes[:-1] != 32
        keep[:1] = True
        keep[offsets[:-1][lengths > 0]] = True
    codes, row = codes[keep].astype(np.uint32), row[keep]
    out, rows = [], []
    for n in GRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, dtype=np.uint32)
        for j in range(n):
            h = (h + codes[j : j + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        inside = row[:m] == row[n - 1 :]
        out.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - DIM_BITS))[inside])
        rows.append(row[:m][inside])
    if not out:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(out), np.concatenate(rows)


def distinct(feature: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row.astype(np.int64) << DIM_BITS | feature)
    return key & ((1 << DIM_BITS) - 1), (key >> DIM_BITS).astype(np.int64)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gain(in_toxic, in_all, n1: float, n0: float):
    """Twice the log-likelihood ratio of features' counts in the two classes."""
    share = (n1 + n0) / np.array([[n1], [n0]])
    seen = np.stack([in_toxic, in_all - in_toxic])
    return 2 * (seen * np.log(np.maximum(seen, 1e-9) * share / np.maximum(in_all, 1))).sum(axis=0)


def fit(texts: list[str], toxic: list[int]) -> Model:
    """The model of texts that are at hand."""
    found = []
    for i in range(0, len(texts), 64):
        f, r = distinct(*hashes(pa.array(texts[i : i + 64], pa.string())))
        found += [f[r == k].astype(np.int32) for k in range(min(64, len(texts) - i))]
    y = np.array(toxic, dtype=np.float64)
    every = np.concatenate(found) if found else np.zeros(0, np.int32)
    weight = np.repeat(y, [len(f) for f in found])
    in_all, in_toxic = (np.bincount(every, weights=w, minlength=1 << DIM_BITS) for w in (None, weight))
    used = np.flatnonzero((in_all >= LEAST) & (_gain(in_toxic, in_all, y.sum(), (1 - y).sum()) >= GAIN)) if 0 < y.sum() < len(y) else np.zeros(0, int)
    return fit_features([f[np.isin(f, used)] for f in found], y, used, in_toxic[used], in_all[used])


def fit_features(found: list[np.ndarray], y: np.ndarray, name: np.ndarray, in_toxic: np.ndarray, in_all: np.ndarray) -> Model:
    """The model of texts that hold the features ``found``, of those in ``name`` (ascending), which so many toxic texts
    and so many of all hold. Of one class only, or without rows, every score is that class's share (0.5 without rows).
    """
    dim = 1 << DIM_BITS
    if not len(y) or y.min() == y.max() or not len(name):
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(dim, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    n1, n0 = y.sum(), (1 - y).sum()
    ratio = np.log((in_toxic + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((in_all - in_toxic + SMOOTH) / (n0 + 2 * SMOOTH))
    r = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
    f = np.searchsorted(name, np.concatenate(found)).astype(np.int32)
    value = ratio
    # logistic regression by accelerated gradient steps; classes weigh the same
    cost = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, ahead, b = np.zeros(len(name)), np.zeros(len(name)), 0.0
    # Lipschitz bound of the loss: a power iteration on the weighted design matrix
    v = np.ones(len(name))
    for _ in range(12):
        v /= np.linalg.norm(v) or 1
        v_next = value * np.bincount(f, weights=(cost * np.bincount(r, weights=(v * value)[f], minlength=len(y)))[r], minlength=len(name))
        top = np.linalg.norm(v_next)
        v = v_next
    rate = 1 / (0.25 * top * 1.1 + PENALTY + 1e-9)
    momentum = 1.0
    for _ in range(STEPS):
        z = np.bincount(r, weights=(ahead * value)[f], minlength=len(y)) + b
        g = (_sigmoid(z) - y) * cost
        new = ahead - rate * (value * np.bincount(f, weights=g[r], minlength=len(name)) + PENALTY * ahead)
        b -= 2.0 * g.sum()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    weight = np.zeros(dim, dtype=np.float32)
    weight[name] = w * value
    # the bias that splits the classes best where each weighs the same
    z = np.bincount(r, weights=weight[name][f].astype(np.float64), minlength=len(y))
    order = np.argsort(z)
    miss = np.cumsum(np.where(y[order] == 1, 0.5 / n1, -0.5 / n0))
    k = int(miss.argmin())
    low, high = z[order[k]], z[order[min(k + 1, len(z) - 1)]]
    return Model(weight, float(-(low + high) / 2))


def _counted(batches):
    """How many of a task's texts, and of its toxic ones, hold each feature."""
    total = np.zeros((2, 1 << DIM_BITS), dtype=np.int64)
    for whole in batches:
        for batch in C.slices(whole, "text"):
            f, r = distinct(*hashes(batch.column("text")))
            toxic = np.array(batch.column("toxic").to_pylist(), dtype=np.int64)
            total[0] += np.bincount(f, minlength=total.shape[1])
            total[1] += np.bincount(f, weights=toxic[r], minlength=total.shape[1]).astype(np.int64)
    f = np.flatnonzero(total[0])
    for i in range(0, len(f), 1 << 16):
        some = f[i : i + (1 << 16)]
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[0, some]), pa.array(total[1, some])], names=["feature", "n", "toxic"])


def _held(used: np.ndarray):
    def run(batches):
        for whole in batches:
            for batch in C.slices(whole, "text"):
                f, r = distinct(*hashes(batch.column("text")))
                keep = np.isin(f, used)
                f, r = f[keep].astype(np.int32), r[keep]
                yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array([f[r == k].tobytes() for k in range(len(batch))], pa.binary())], names=["doc_id", "toxic", "features"])

    return run


def train(docs: DataFrame, labels: DataFrame, allowed) -> Model:
    """Fits on the rows of ``labels`` with a label toxic for which the column ``allowed`` of doc_id holds. Labels of one
    doc_id count as the greatest of them, texts of one doc_id as the least of them."""
    known = labels.where(allowed & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    part = lambda c: known.where(c).orderBy(F.xxhash64(F.col("doc_id"), F.lit(9)), "doc_id").limit(TRAIN // 2)
    chosen = part("toxic = 1").union(part("toxic <> 1")).select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = C.Workspace(docs.sparkSession, "toxicity").save(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "sample")  # at most TRAIN rows
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = rows.mapInArrow(C.lean(_counted), "feature long, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= LEAST)
    n1, n0 = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if n1 and n0:
        part_of = lambda seen, total: F.when(seen > 0, seen * F.log(seen * F.lit(float(n1 + n0)) / (F.lit(float(total)) * F.col("n")))).otherwise(0.0)
        counts = counts.where(2 * (part_of(F.col("toxic"), n1) + part_of(F.col("n") - F.col("toxic"), n0)) >= GAIN)
        got = counts.toArrow().sort_by("feature")  # of at most 2 ** DIM_BITS features
        name, in_all, in_toxic = (got.column(c).to_numpy() for c in ("feature", "n", "toxic"))
    else:
        name = in_all = in_toxic = np.zeros(0, np.int64)
    held = rows.mapInArrow(C.lean(_held(name)), "doc_id long, toxic int, features binary").toArrow().sort_by("doc_id")
    return fit_features([np.frombuffer(x, np.int32) for x in held.column("features").to_pylist()], held.column("toxic").to_numpy().astype(np.float64), name, in_toxic, in_all)


def score_texts(array: pa.Array, model: Model) -> np.ndarray:
    f, r = hashes(array)
    keep = model.weight[f] != 0
    f, r = distinct(f[keep], r[keep])
    return _sigmoid(np.bincount(r, weights=model.weight[f].astype(np.float64), minlength=len(array)) + model.bias)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5 up); reads ``text`` alone. Null and empty texts hold no feature
    and have the score of the bias. Every row is scored by itself, so repeated rows have equal scores. Other columns stay,
    but for those named score or predicted."""
    docs = C.without(docs, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole, text):
                s = score_texts(batch.column(text), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(C.lean(run), C.schema_with(docs, "score double, predicted int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(5, 0))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
