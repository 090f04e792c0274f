"""Document fingerprints by consistent weighted sampling (operator 3).

A document is a weighted set: its pairs of adjacent words (A-Z in lower case), weighted by how often they occur; a
text of one word has that word, and a text without words one mark of its own, so that all such texts are alike.

For each of K samples and each term, r and c are gamma(2, 1) and b is uniform, all drawn from the term. With weight w,
t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r; the term with the least a is the sample, together with its t.
The chance that two documents have the same sample equals the generalised Jaccard similarity of their weighted sets,
the sum of the lesser weights over the sum of the greater. For w = 1, t is 0, so ln c + r (b - 1) is kept for each
term, and other weights take r t from it.

The draws of a term come from a hash of it and of the sample's number, which chooses one of 2 ** TABLE_BITS triples (c,
r, b). Terms themselves are 64-bit hashes, and two that have one triple for a sample are still two terms, whatever the
length of a text: of equal ln a the term of the lesser hash stands. Terms are taken BLOCK at a time, so a text of any length takes
bounded memory. A fingerprint is a string of 4 hexadecimal digits for each sample.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

SAMPLES, TABLE_BITS, BLOCK = 64, 16, 2048
#: Bytes of text of a share of the order of documents.
SHARE = 32 << 20
_U64 = np.uint64


def _gamma(u: np.ndarray) -> np.ndarray:
    """Where a gamma(2, 1) variable exceeds a share ``u`` of its values: (1 + x) exp(-x) = 1 - u, by Newton's method for
    the logarithm of both sides, which is concave."""
    x = np.full(len(u), 1e-3)
    for _ in range(60):
        x = np.maximum(x + (np.log1p(x) - x - np.log1p(-u)) * (1 + x) / x, 1e-9)
    return x


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ln c + r (b - 1); r; b. Evenly spread over the distributions (by an additive sequence in three dimensions), so
    that the table as a whole favours no weight."""
    i = np.arange(1 << TABLE_BITS) + 0.5
    root = 1.2207440846057596  # of x ** 4 = x + 1
    c, r = _gamma(i / root % 1), _gamma(i / root**2 % 1)
    b = i / root**3 % 1
    return (np.log(c) + r * (b - 1)).astype(np.float32), r.astype(np.float32), b.astype(np.float32)


_AT_ONE, _R, _B = _draws()
#: Two numbers for each sample that make its hash of a term.
_SAMPLE = np.random.Generator(np.random.PCG64(978)).integers(0, 2**32, (2, 4096, 1), dtype=np.uint32)
_SAMPLE[1] |= np.uint32(1)
_NONE, _ONE = np.zeros(1, dtype=np.uint64), np.ones(1, dtype=np.int64)


def term_sets(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and weights of all rows' terms, ascending in each row, and the place of each row's first."""
    data, offsets = C.text_bytes(array)
    starts, ends, first = C.words(data, offsets)
    codes = C.word_hashes(data, starts, ends)
    pairs = C.run_hashes(codes, 2)
    terms, weights = [], []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= 2:
            t, w = np.unique(pairs[a : b - 1], return_counts=True)
        else:
            t, w = (C.mix(codes[a:b]) if b > a else _NONE), _ONE
        terms.append(t)
        weights.append(w)
    at = np.cumsum([0, *map(len, terms)])[:-1]
    return np.concatenate(terms), np.concatenate(weights), at


def _slots(terms: np.ndarray, which: np.ndarray, x: np.ndarray | None = None, y: np.ndarray | None = None) -> np.ndarray:
    """The triple of each term for samples with the numbers ``which``; x and y are room to work in."""
    x = np.bitwise_xor((terms >> _U64(32)).astype(np.uint32), which[0], out=x)
    x *= which[1]
    x ^= np.right_shift(x, np.uint32(15), out=y)
    x *= np.uint32(0x85EBCA6B)
    x >>= np.uint32(32 - TABLE_BITS)
    return x


def _levels(weights: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.floor(np.log(weights).astype(np.float32) / _R[of] + _B[of])


def fingerprints(array: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """A row of samples for each text: 16 bits of the term with the least ln a, and of its t."""
    if not len(array):
        return np.zeros((0, samples), np.uint16)
    terms, weights, at = term_sets(array)
    which = _SAMPLE[:, :samples]
    least = np.full((len(at), samples), np.inf, dtype=np.float32)
    best = np.zeros((len(at), samples), dtype=np.int64)
    rooms = [np.empty(samples * BLOCK, kind) for kind in (np.uint32, np.uint32, np.intp, np.float32)]
    every = np.arange(samples)
    for i in range(0, len(terms), BLOCK):
        some = terms[i : i + BLOCK]
        x, y, of, log_a = (r[: samples * len(some)].reshape(samples, len(some)) for r in rooms)
        of[...] = _slots(some, which, x, y)
        _AT_ONE.take(of, out=log_a, mode="clip")
        more = np.flatnonzero(weights[i : i + BLOCK] > 1)
        if len(more):
            log_a[:, more] -= _R[of[:, more]] * _levels(weights[i + more], of[:, more])
        first, stop = np.searchsorted(at, i, side="right") - 1, np.searchsorted(at, i + len(some))
        cuts = [0, *(at[first + 1 : stop] - i), len(some)]
        for d, a, b in zip(range(first, stop), cuts[:-1], cuts[1:], strict=True):
            k = log_a[:, a:b].argmin(axis=1) + a
            value = log_a[every, k]
            less = value < least[d]
            least[d][less] = value[less]
            best[d][less] = k[less] + i
    term, weight = terms[best], weights[best]
    level = np.zeros(best.shape, dtype=np.uint64)
    d, k = np.nonzero(weight > 1)
    level[d, k] = _levels(weight[d, k], _slots(term[d, k], which[:, k, 0])).astype(np.int64).astype(np.uint64)
    return (C.mix(term * _U64(0x100000001B3) + level) >> _U64(48)).astype(np.uint16)


def to_text(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    return float((x == y).mean())


def likeness_column(x, y, samples: int = SAMPLES):
    """The same of two columns of fingerprints."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(samples - 1)), F.lit(0), lambda n, i: n + F.when(F.substring(x, i * 4 + 1, 4) == F.substring(y, i * 4 + 1, 4), 1).otherwise(0))
    return same / F.lit(float(samples))


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """Adds the fingerprint of ``text`` as ``out``; null counts as empty. Other columns stay, but for one that is named
    like ``out``."""
    docs = C.without(docs, out)

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole, text):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(map(to_text, fingerprints(batch.column(text), samples))), pa.string())], names=[*batch.schema.names, out])

    return docs.mapInArrow(C.lean(run), C.schema_with(docs, f"`{out}` string"))


def with_next(docs: DataFrame, shares: int | None = None) -> DataFrame:
    """(share, own, doc_id, text), a partition for each share, sorted, so that each document's next one follows it: each
    share of the order of doc_id (equal ids: of the text) also has the first document of the next share, with own =
    false, and the last share that of the first.

    Shares have about SHARE bytes of text each, however large the table. Only as many bounds as there are shares reach
    the driver. A null doc_id comes first.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if not shares:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shares = max(size // SHARE + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / shares for i in range(1, shares)] or [0.5], 10_000)).first()[0] or []
    cuts = np.unique(np.array(bounds, dtype=np.int64))

    @F.pandas_udf("int")
    def share_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(cuts, ids.fillna(0).to_numpy().astype(np.int64), side="right"))).astype("int32")

    ids = docs.select("doc_id").withColumn("share", share_of("doc_id"))
    firsts = {r.share: r.low for r in ids.groupBy("share").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("low")).collect()}
    order = sorted(firsts)
    ahead = [(order[k - 1], None if firsts[s] == -(2**63) else firsts[s]) for k, s in enumerate(order)]
    look = spark.createDataFrame(ahead or [(0, None)], "share int, low long")  # a row for each share
    rows = docs.withColumn("share", share_of("doc_id")).select("share", F.lit(True).alias("own"), "doc_id", "text")
    extra = docs.join(F.broadcast(look), docs.doc_id.eqNullSafe(look.low)).select("share", F.lit(False).alias("own"), "doc_id", "text")
    return rows.unionByName(extra).repartitionById(len(cuts) + 1, F.col("share")).sortWithinPartitions("share", F.desc("own"), F.asc_nulls_first("doc_id"), "text")


def _pairs(samples: int):
    def run(batches):
        held = None  # share, own, doc_id, text, fingerprint of the row before
        out: list[tuple] = []

        def close(row, following):
            text = row[3]
            n = len(text)
            cut = n // 4
            edited = text[: n - cut] + following[3][:cut]
            out.append((row[2], n, edited, row[4], following[4]))

        def flush():
            edited = pa.array([x[2] for x in out], pa.string())
            new = fingerprints(edited, samples)
            batch = pa.record_batch(
                [
                    pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2].encode()).hexdigest() for x in out], pa.string()),
                    pa.array([to_text(x[3]) for x in out], pa.string()), pa.array(list(map(to_text, new)), pa.string()), pa.array([likeness(x[3], y) for x, y in zip(out, new, strict=True)], pa.float64()), pa.array([likeness(x[3], x[4]) for x in out], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            out.clear()
            return batch

        for whole in batches:
            for batch in C.slices(whole, "text"):
                for row in zip(*(batch.column(c).to_pylist() for c in ("share", "own", "doc_id", "text")), fingerprints(batch.column("text"), samples), strict=True):
                    if held is not None and held[1] and held[0] == row[0]:
                        close(held, row)
                    held = row
                if out:
                    yield flush()

    return run


def edited_likeness(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """For each document its fingerprint and that of its edited text: the last quarter of its characters gives way to
    the first so many of the next document's. One shuffle of the texts. Empty texts equal each other; of one row the
    next document is the row itself. Repeated rows each get a row; other columns are not read.
    """
    return with_next(docs).mapInArrow(C.lean(_pairs(samples)), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(C.documents(spark, sf_dir))
