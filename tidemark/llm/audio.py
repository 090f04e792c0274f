"""Media columns: chroma fingerprints of audio, and their alignment (operator 7).

A recording is cut into overlapping frames; each frame's spectrum is folded into 12 pitch classes and scaled. Filters
of an integral image over (frames x classes) compare sums of neighbouring rectangles; each gives 2 bits, so 16 filters
make a 32-bit integer for each place in time. Two recordings are aligned by a histogram of the offsets at which they
hold the same integers; at the best offsets the share of different bits is counted, and the least decides.

Media come in a binary column (16-bit mono samples). Searches take a stated query set against all recordings, block by
block; equal fingerprints are one class, of which only one recording is compared.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

RATE, FRAME, HOP = 4000, 1024, 512
CLASSES, FILTERS, SPAN = 12, 16, 8
#: Same integers at one offset that make a candidate, and offsets that are compared.
VOTES, OFFSETS = 3, 2
#: Most different bits of an alignment, and least overlap of the shorter one.
ERROR, OVERLAP = 0.25, 0.5
#: Queries that meet a block of recordings at once.
QUERIES = 512


def _filters() -> list[tuple[int, int, int, int]]:
    """Kind, first class, classes and frames of each filter, by rule: kinds by turns, rectangles of growing size."""
    return [(i % 4, (5 * i) % 9, 2 + 2 * (i % 2), 2 + 2 * (i % 4)) for i in range(FILTERS)]


_bins = np.fft.rfftfreq(FRAME, 1 / RATE)
_class = np.where(_bins > 60, np.round(12 * np.log2(np.maximum(_bins, 1) / 440)).astype(int) % CLASSES, -1)
_fold = np.stack([(_class == k).astype(np.float32) for k in range(CLASSES)], axis=1)
_window = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """A row of 12 for each frame; silent frames are zero. Recordings shorter than a frame have none."""
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES), dtype=np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    out = np.empty((len(frames), CLASSES), dtype=np.float32)
    for at in range(0, len(frames), 512):
        power = np.abs(np.fft.rfft(frames[at : at + 512] * _window, axis=1)) ** 2
        out[at : at + 512] = power.astype(np.float32) @ _fold
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-3, out / np.maximum(norm, 1e-9), 0)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Packed integers, one for each frame with SPAN - 1 frames after it."""
    c = chroma(samples)
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    area = np.zeros((len(c) + 1, CLASSES + 1))
    area[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def total(t0, t1, k0, k1):
        return area[t + t1, k1] - area[t + t0, k1] - area[t + t1, k0] + area[t + t0, k0]

    out = np.zeros(n, dtype=np.uint32)
    for kind, low, height, width in _filters():
        top, half, middle = low + min(height, CLASSES - low), width // 2, low + min(height, CLASSES - low) // 2
        if kind == 0:
            a, b = total(0, width, low, top), total(0, width, 0, low) if low else total(0, width, top, CLASSES)
        elif kind == 1:
            a, b = total(0, width, low, middle), total(0, width, middle, top)
        elif kind == 2:
            a, b = total(0, half, low, top), total(half, width, low, top)
        else:
            a = total(0, half, low, middle) + total(half, width, middle, top)
            b = total(0, half, middle, top) + total(half, width, low, middle)
        x = np.log((1 + a) / (1 + b))
        level = (x > -0.15).astype(np.uint32) + (x > 0) + (x > 0.15)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1)).astype(np.uint32)  # a Gray code: neighbours differ in one bit
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def compare(x: np.ndarray, y: np.ndarray, offset: int) -> float:
    """Share of different bits where y starts at ``offset`` of x; 1 without enough overlap."""
    a, b = max(offset, 0), min(len(x), offset + len(y))
    if b - a < max(1, OVERLAP * min(len(x), len(y))):
        return 1.0
    return float(_bits(x[a:b] ^ y[a - offset : b - offset]).sum()) / (32 * (b - a))


def align(x: np.ndarray, y: np.ndarray) -> tuple[int, float]:
    """Offset and bit error of the best alignment; (0, 1.0) if no offset has enough equal integers."""
    i, j = np.nonzero(x[:, None] == y[None, :])
    offsets, votes = np.unique(i - j, return_counts=True)
    order = np.argsort(-votes, kind="stable")[:OFFSETS]
    best = min(((compare(x, y, int(offsets[k])), int(offsets[k])) for k in order if votes[k] >= min(VOTES, len(x), len(y))), default=(1.0, 0))
    return best[1], best[0]


def fingerprints(media: DataFrame, key: str, samples: str = "samples") -> DataFrame:
    """(key, n_frames, fingerprint binary): null or too short media have an empty fingerprint."""

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole, samples):
                got = [fingerprint(np.frombuffer(x or b"", dtype="<i2")) for x in batch.column(samples).to_pylist()]
                yield pa.record_batch([batch.column(key), pa.array([len(x) for x in got], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in got], pa.binary())], names=[key, "n_frames", "fingerprint"])

    return media.select(F.col(key).cast("long").alias(key), samples).mapInArrow(C.lean(run), f"`{key}` long, n_frames long, fingerprint binary")


def _search(batches):
    """The best recording for each query, of one block of queries and one of recordings."""
    for batch in batches:
        for row in batch.to_pylist():
            queries = [(q["id"], np.frombuffer(q["f"], dtype="<u4")) for q in row["queries"]]
            others = [(r["id"], np.frombuffer(r["f"], dtype="<u4")) for r in row["others"]]
            size = np.array([len(f) for _, f in others])
            values, owner = np.concatenate([f for _, f in others]), np.repeat(np.arange(len(others)), size)
            place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
            order = np.argsort(values, kind="stable")
            ordered = values[order]
            out = []
            for name, x in queries:
                lo, hi = np.searchsorted(ordered, x, "left"), np.searchsorted(ordered, x, "right")
                n = hi - lo
                at = order[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
                shift = np.repeat(np.arange(len(x)), n) - place[at]
                code, votes = np.unique(owner[at].astype(np.int64) << 32 | (shift + (1 << 31)), return_counts=True)
                who, offset = code >> 32, (code & 0xFFFFFFFF) - (1 << 31)
                best = (1.0, None, 0)
                for k in np.lexsort((-votes, who)):
                    other, y = others[who[k]]
                    if other != name and votes[k] >= min(VOTES, len(x), len(y)):
                        best = min(best, (compare(x, y, int(offset[k])), other, int(offset[k])), key=lambda b: (b[0], b[1] is None, b[1] or 0))
                if best[1] is not None and best[0] <= ERROR:
                    out.append((name, best[1], best[2], best[0]))
            if out:
                a, b, c, d = zip(*out, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], names=["class_id", "match_id", "match_offset", "match_error"])


def search(prints: DataFrame, key: str, is_query, name: str = "audio") -> DataFrame:
    """(key, n_frames, fingerprint hex, class_id, match_id, match_offset, match_error), a row for each recording.

    class_id is the least key with the same fingerprint. For rows with ``is_query``, match_id is the class, other than
    their own, whose alignment has the fewest different bits (then the least id), null if none has at most ERROR; the
    others have nulls there. Empty fingerprints have no class and no match; rows with a null key keep nulls.
    """
    ws = C.Workspace(prints.sparkSession, name)
    prints = ws.save(prints, "prints")
    live = prints.where("n_frames > 0").where(F.col(key).isNotNull())
    classes = ws.save(live.groupBy("fingerprint").agg(F.min(key).alias("class_id"), F.max(is_query).alias("asked")), "classes")
    n, asked = classes.agg(F.count("*"), F.sum(F.col("asked").cast("int"))).first()
    blocks = (asked or 0) // QUERIES + 1
    item = F.struct(F.col("class_id").alias("id"), F.col("fingerprint").alias("f"))
    queries = classes.where("asked").select(F.expr(f"pmod(xxhash64(class_id), {blocks})").alias("q"), item.alias("x")).groupBy("q").agg(F.collect_list("x").alias("queries"))
    others = classes.select(F.expr(f"pmod(xxhash64(class_id, 7), {(n or 0) // (4 * QUERIES) + 1})").alias("r"), item.alias("x")).groupBy("r").agg(F.collect_list("x").alias("others"))
    every = others.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("q"), "others")  # each block of recordings meets each block of queries
    found = every.join(queries, "q").select("queries", "others").mapInArrow(C.lean(_search), "class_id long, match_id long, match_offset long, match_error double")
    best = found.groupBy("class_id").agg(F.min(F.struct("match_error", "match_id", "match_offset")).alias("m"))
    best = ws.save(best.select("class_id", "m.match_id", "m.match_offset", "m.match_error"), "best")
    rows = prints.join(classes.select("fingerprint", "class_id"), "fingerprint", "left").join(best, "class_id", "left")
    asked_here = is_query & F.col("class_id").isNotNull()
    return rows.select(key, "n_frames", F.lower(F.hex("fingerprint")).alias("fingerprint"), "class_id", *(F.when(asked_here, F.col(c)).alias(c) for c in ("match_id", "match_offset", "match_error")))


def rendered(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, samples): each vector as a melody, one note of HOP samples for each value: its semitone follows the value."""

    def run(batches):
        t = np.arange(HOP) / RATE
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                out = []
                for v in batch.column(vector).to_pylist():
                    v = np.array([0.0 if x is None else x for x in v or []], dtype=np.float64)
                    v = np.nan_to_num(v, nan=0.0, posinf=1.0, neginf=-1.0)
                    notes = 220 * 2 ** (np.round(np.clip(v, -0.5, 0.5) * 36) / 12)
                    wave = np.sin(2 * np.pi * notes[:, None] * t[None, :]).reshape(-1)
                    out.append((wave * 12000).astype("<i2").tobytes())
                yield pa.record_batch([batch.column(key), pa.array(out, pa.binary())], names=[key, "samples"])

    return vectors.select(F.col(key).cast("long").alias(key), vector).mapInArrow(C.lean(run), f"`{key}` long, samples binary")


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: each vector of ``embeddings`` is rendered as a melody. Queries: ids divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    prints = fingerprints(rendered(vectors, "vec_id", "embedding"), "vec_id")
    return search(prints, "vec_id", F.col("vec_id") % 50 == 0)
