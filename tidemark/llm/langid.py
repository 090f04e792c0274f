"""Language identification by nearest centroids (operator 8).

A text is a vector of hashed byte n-grams (2 to 4 bytes, A-Z in lower case, other ASCII signs as one gap), weighted by
(1 + ln tf) * idf and scaled to length 1. Each language's training vectors are clustered by spherical k-means into a
few centroids; a text gets the language of the centroid with the greatest cosine. The score is that cosine. A text is
rejected when its distance, 1 - cosine, is beyond what texts of the language reach; texts without a letter are
undetermined. Since the cosine grows with the number of different n-grams, that reach is a curve over this number: it
is measured on pieces of several lengths of every ``HOLD``-th labelled text, which the centroids have not seen.

The model is fitted on at most ``TRAIN`` labelled texts (those of the least hashed ids, as many for each language as
there are, up to an equal share). Whole texts are read, in training as in predictions; training texts become counts and
a few pieces on the executors, so that no more than ``TRAIN`` rows of bounded size reach the driver.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C

#: Most texts of the training sample.
TRAIN = 2400
#: With 2^15 slots the n-grams of unlearned languages and junk hardly meet learned ones by chance.
DIM_BITS, GRAMS, CENTROIDS, ROUNDS = 15, (2, 3, 4), 4, 12
#: A text is rejected when its cosine is under this quantile of those of pieces with as many n-grams, of its language.
REJECT_QUANTILE, HOLD, PIECES = 0.01, 4, (8, 16, 32, 64, 128, 256, 1024, 4096)
#: A language of fewer texts than LEAST has none to spare: then this share of its least training cosine counts.
LEAST, REJECT_SHARE = 100, 0.25
#: Texts that one vectorised step takes: its dense rows stay within 4 MB an array.
STEP = 16
UNDETERMINED = "und"

_GAP = np.arange(256, dtype=np.uint8)
_GAP[65:91] += 32
_GAP[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass
class Model:
    languages: list[str]
    of: np.ndarray  # language of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    least: list[tuple[np.ndarray, np.ndarray]]  # of each language: logarithms of numbers of n-grams, least cosines there

    def reached(self, of: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The least cosine that stands, for languages and numbers of different n-grams."""
        at = np.log2(np.maximum(grams, 1))
        out = np.zeros(len(of))
        for k, (x, y) in enumerate(self.least):
            out[of == k] = np.interp(at[of == k], x, y)
        return out


def counts(array: pa.Array) -> np.ndarray:
    """Counts of hashed n-grams, a row for each text."""
    data, offsets = C.text_bytes(array)
    rows, dim = len(array), 1 << DIM_BITS
    out = np.zeros((rows, dim), dtype=np.float32)
    codes = _GAP[data].astype(np.uint32)
    flat = out.reshape(-1)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(rows, dtype=np.int64), lengths)
    to_end = np.repeat(offsets[1:], lengths) - np.arange(len(data))
    for n in GRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, dtype=np.uint32)
        for j in range(n):
            h = (h + codes[j : j + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - DIM_BITS)
        inside = to_end[:m] >= n
        flat += np.bincount((row[:m] * dim + h)[inside], minlength=rows * dim).astype(np.float32)
    return out


def vectors(array: pa.Array, idf: np.ndarray | None = None) -> np.ndarray:
    x = np.log1p(counts(array))
    return x if idf is None else scaled(x * idf)


def scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-9)


@dataclass
class Sample:
    """What training keeps of a text: its language, the n-grams it holds with the logarithms of their counts, and a piece
    of each of the lengths PIECES that it has."""

    language: str
    slots: np.ndarray
    values: np.ndarray
    pieces: list[str | None]


def _pieces(text: str) -> list[str | None]:
    """A piece of about each size in bytes, at a place that the text decides, if there is a letter in it."""
    raw = text.encode()
    rng = np.random.Generator(np.random.PCG64(zlib.crc32(raw)))
    found: list[str | None] = []
    for size in PIECES:
        at = int(rng.integers(max(len(raw) - size, 0) + 1))
        piece = raw[at : at + size].decode(errors="ignore") if len(raw) >= size else None
        found.append(piece if _has_letter(piece) else None)
    return found


def samples(texts: pa.Array, languages: list[str]) -> list[Sample]:
    x = np.concatenate([np.log1p(counts(texts.slice(i, STEP))).astype(np.float16) for i in range(0, len(texts), STEP)])
    out = []
    for row, text, language in zip(x, texts.to_pylist(), languages, strict=True):
        slots = np.flatnonzero(row)
        out.append(Sample(language, slots.astype(np.uint16), row[slots], _pieces(text)))
    return out


def _reach(spare: list[Sample], idf: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The curve of least cosines, measured on pieces of texts that the centroids have not seen."""
    x, y = [], []
    for k in range(len(PIECES)):
        pieces = [p for p in (s.pieces[k] for s in spare) if p is not None]
        if len(pieces) < LEAST // HOLD:
            continue
        cosine, grams = [], []
        for i in range(0, len(pieces), STEP):
            v = vectors(pa.array(pieces[i : i + STEP], pa.string()), idf)
            cosine.append((v @ centroids.T).max(axis=1))
            grams.append((v > 0).sum(axis=1))
        x.append(np.median(np.log2(np.maximum(np.concatenate(grams), 1))))
        y.append(np.quantile(np.concatenate(cosine), REJECT_QUANTILE))
    return (np.array(x), np.array(y)) if x else (np.zeros(1), np.zeros(1))


def fit(texts: list[str], languages: list[str]) -> Model:
    return fit_samples(samples(pa.array(texts, pa.string()), languages) if texts else [])


def fit_samples(found: list[Sample]) -> Model:
    """A language with fewer texts than centroids gets a centroid for each of them."""
    names, dim = sorted({s.language for s in found}), 1 << DIM_BITS
    if not names:
        return Model([], np.zeros(0, int), np.ones(dim, np.float32), np.zeros((0, dim), np.float32), [])
    having = np.zeros(dim)
    for s in found:
        having[s.slots] += 1
    idf = (np.log((1 + len(found)) / (1 + having)) + 1).astype(np.float32)
    rng = np.random.Generator(np.random.PCG64(8))
    centroids, of, least = [], [], []
    for k, name in enumerate(names):
        rows = [s for s in found if s.language == name]
        spare = rows[HOLD - 1 :: HOLD] if len(rows) >= LEAST else []
        rows = [s for i, s in enumerate(rows) if not spare or i % HOLD != HOLD - 1]
        own = []
        for x in rows:
            weights = x.values * idf[x.slots]
            own.append(weights / max(float(np.sqrt((weights * weights).sum())), 1e-9))
        c = np.zeros((min(CENTROIDS, len(rows)), dim), np.float32)
        for j, i in enumerate(np.sort(rng.permutation(len(rows))[:CENTROIDS])):
            c[j, rows[i].slots] = own[i]
        for _ in range(ROUNDS):
            cosine = np.stack([c[:, x.slots] @ v for x, v in zip(rows, own, strict=True)])
            at = cosine.argmax(axis=1)
            for j in np.unique(at):
                mine = np.flatnonzero(at == j)
                total = np.bincount(np.concatenate([rows[i].slots for i in mine]), np.concatenate([own[i] for i in mine]), dim)
                c[j] = scaled(total)
        centroids.append(c)
        of += [k] * len(c)
        if spare:
            least.append(_reach(spare, idf, c.astype(np.float32)))
        else:
            least.append((np.zeros(1), np.full(1, cosine.max(axis=1).min() * REJECT_SHARE)))
    return Model(names, np.array(of), idf, np.concatenate(centroids).astype(np.float32), least)


def _sampled(batches):
    for whole in batches:
        for batch in C.slices(whole, "text"):
            for at in range(0, len(batch), STEP):
                part = batch.slice(at, STEP)
                got = samples(part.column("text"), part.column("lang").to_pylist())
                binary = lambda xs: pa.array([x.tobytes() for x in xs], pa.binary())
                order = [hashlib.md5((x or "").encode(), usedforsecurity=False).digest() for x in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(order, pa.binary()), part.column("lang"), binary(s.slots for s in got), binary(s.values for s in got), pa.array([s.pieces for s in got], pa.list_(pa.string()))], names=["doc_id", "digest", "lang", "slots", "weights", "pieces"])


def train(docs: DataFrame, allowed) -> Model:
    """Fits on rows with a non-null lang and text for which the column ``allowed`` of doc_id holds. A doc_id that is
    there more than once counts as its text of the least digest."""
    known = docs.where(allowed & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    ids = known.select("doc_id", "lang", F.xxhash64(F.col("doc_id"), F.lit(8)).alias("h")).distinct()
    names = ids.agg(F.count_distinct("lang")).first()[0]
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))  # a limit for each language, applied before the shuffle
    chosen = ids.withColumn("place", place).where(F.col("place") <= max(1, TRAIN // max(1, names))).select("doc_id").distinct()
    rows = known.where("text is not null").join(F.broadcast(chosen), "doc_id").mapInArrow(C.lean(_sampled), "doc_id long, digest binary, lang string, slots binary, weights binary, pieces array<string>")
    first = F.min(F.struct("digest", "lang", "slots", "weights", "pieces")).alias("r")
    got = rows.groupBy("doc_id").agg(first).select("doc_id", "r.*").toArrow().sort_by("doc_id")  # at most TRAIN rows
    parts = (got.column(c) for c in ("lang", "slots", "weights", "pieces"))
    return fit_samples([Sample(lang.as_py(), np.frombuffer(slots.as_buffer(), np.uint16), np.frombuffer(weights.as_buffer(), np.float16), pieces.as_py()) for lang, slots, weights, pieces in zip(*parts, strict=True)])


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and rejected to ``docs``, under ``names``; reads ``text`` alone.

    A null text and one without a letter are undetermined with score 0, and rejected. Without a learned language all
    are. Of equally near languages the first in order of name stands. Every row is predicted by itself, from its whole
    text, so repeated rows get the same. Other columns stay, but for those that have one of ``names``.
    """
    docs = C.without(docs, *names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size for each language

    def run(batches):
        m = shared.value
        for whole in batches:
            for batch in C.slices(whole, text, C.STEP_BYTES):
                for at in range(0, len(batch), STEP):
                    part = batch.slice(at, STEP)
                    letters = np.array([_has_letter(x) for x in part.column(text).to_pylist()])
                    if len(m.of):
                        v = vectors(part.column(text), m.idf)
                        cosine = v @ m.centroids.T
                        best = cosine.argmax(axis=1)
                        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                        of = m.of[best]
                        rejected = ~letters | (score < m.reached(of, (v > 0).sum(axis=1)))
                        found = [m.languages[k] if ok else UNDETERMINED for k, ok in zip(of, letters, strict=True)]
                    else:
                        score, rejected, found = np.zeros(len(part)), np.ones(len(part), bool), [UNDETERMINED] * len(part)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64()), pa.array(rejected, pa.bool_())], names=[*part.schema.names, *names])

    return docs.mapInArrow(C.lean(run), C.schema_with(docs, "`{}` string, `{}` double, `{}` boolean".format(*names)))


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the doc_id's text leaves this remainder; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = train(docs, ~held_out(4, 2))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")
