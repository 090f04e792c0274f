"""Removal of repeated byte strings by suffix sorting (operator 6).

Every byte goes that lies in a string of ``WIDTH`` bytes which also starts anywhere else, in the same text or another.
Strings never cross texts, overlaps count, and all strings are judged on the input.

The suffixes of all texts need not meet in one place. Two equal strings hold the same least hash among their runs of
GRAM bytes; that hash is their key. Texts are cut into stretches of windows with one key, and only keys with more than
one such run can hold a repetition. In the stretches of those keys, runs whose hash is a multiple of SAMPLE are counted
as well: a window that holds one that occurs once is not repeated. Both steps drop only windows that occur once.

What is left is cut by key. Equal pieces are put together: a piece that occurs twice is repeated in full. All pieces of
keys that have several go to the same task, which sorts their suffixes by external induction (``induced_sort``), a batch
of keys at a time; two neighbours in that order whose common prefix reaches WIDTH mark each other's windows, and the
bytes are compared once more. Whether a prefix is that long is read from the text instead of being carried through the
induction, since no other value of it is needed.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import induced_sort

WIDTH, GRAM, SAMPLE = 400, 64, 16
#: Bytes of pieces that are sorted at once, unless one key has more; windows of a text that are hashed at once.
BATCH, STEP = 2 << 20, 1 << 20

_U64 = np.uint64


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the run of GRAM bytes at each place."""
    m = len(data) - GRAM + 1
    h = C.prefix_hash(C._BYTE[data])
    return C.mix((h[GRAM:] - h[:m]) * C.powers(C._BACK, "back", m))


def keys(data: np.ndarray, width: int = WIDTH):
    """(first window, hashes of the runs, key of each window) of one stretch of a text after another."""
    windows = len(data) - width + 1
    for at in range(0, max(windows, 0), STEP):
        g = grams(data[at : min(at + STEP, windows) + width - 1])
        low, size, most = g, 1, width - GRAM + 1
        while size * 2 <= most:
            low = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        n = len(g) - most + 1
        yield at, g, np.minimum(low[:n], low[most - size : most - size + n])


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place, and place after the last, of each run of equal values."""
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, int)
    return at, np.append(at[1:], len(values))


def _rows(batch, text="text"):
    data, offsets = C.text_bytes(batch.column(text))
    for i in range(len(batch)):
        yield i, data[offsets[i] : offsets[i + 1]]


def _places_within(g: np.ndarray, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each i, how many places p with lo[i] <= p < hi[i] have g[p] = wanted[i]."""
    values, of = np.unique(wanted, return_inverse=True)
    at = np.minimum(np.searchsorted(values, g), len(values) - 1)
    places = np.flatnonzero(values[at] == g)
    ordered = np.sort(at[places] * (len(g) + 1) + places)
    return np.searchsorted(ordered, of * (len(g) + 1) + np.minimum(hi, len(g))) - np.searchsorted(ordered, of * (len(g) + 1) + lo)


def _stretches(batches, width: int):
    """A row for each stretch of windows with one key, with the number of runs that have the key's hash."""
    for whole in batches:
        for batch in C.slices(whole, "text"):
            out = []
            for i, data in _rows(batch):
                for base, g, w in keys(data, width):
                    a, e = runs(w)
                    n = _places_within(g, w[a], a, e + width - GRAM)
                    out.append((np.full(len(a), i), w[a], a + base, e + base, np.maximum(n, 1)))
            if out:
                row, key, a, e, n = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.record_batch([pa.array(key.view(np.int64)), batch.column("d").take(pa.array(row)), batch.column("h").take(pa.array(row)), pa.array(a.astype(np.int64)), pa.array(e.astype(np.int64)), pa.array(n)], names=["key", "d", "h", "a", "e", "n"])


def _sampled(batches, width: int):
    """Sampled runs of the stretches of each text."""
    for whole in batches:
        for batch in C.slices(whole, "text"):
            out = []
            for (i, data), spans in zip(_rows(batch), batch.column("spans").to_pylist(), strict=True):
                g = grams(data)
                live = np.zeros(len(g) + 1, dtype=np.int32)
                for s in spans:
                    live[s["a"]] += 1
                    live[min(s["e"] + width - GRAM, len(g))] -= 1
                at = np.flatnonzero((np.cumsum(live[:-1]) > 0) & (g % _U64(SAMPLE) == 0))
                out.append((np.full(len(at), i), g[at], at))
            row, g, at = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.record_batch([pa.array(g.view(np.int64)), batch.column("d").take(pa.array(row)), batch.column("h").take(pa.array(row)), pa.array(at.astype(np.int64))], names=["g", "d", "h", "p"])


def _pieces(batches, width: int):
    """Stretches of windows that may be repeated, cut by key, with their bytes."""
    names = ["key", "digest", "own", "d", "h", "start", "bytes"]
    for whole in batches:
        for batch in C.slices(whole, "text", C.STEP_BYTES // 2):
            out = []
            for (i, data), spans, single in zip(_rows(batch), batch.column("spans").to_pylist(), batch.column("single").to_pylist(), strict=True):
                n = len(data) - width + 1
                live = np.zeros(n + 1, dtype=np.int32)
                for s in spans:
                    live[s["a"]] += 1
                    live[s["e"]] -= 1
                dead = np.zeros(n + 1, dtype=np.int32)
                p = np.array(single or [], dtype=np.int64)
                np.add.at(dead, np.clip(p - (width - GRAM), 0, n), 1)
                np.add.at(dead, np.clip(p + 1, 0, n), -1)
                live = (np.cumsum(live[:-1]) > 0) & (np.cumsum(dead[:-1]) == 0)
                if not live.any():
                    continue
                for base, g, w in keys(data, width):
                    part = live[base : base + len(w)]
                    change = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (part[1:] != part[:-1]))))
                    for a, e in zip(change, np.append(change[1:], len(w)), strict=True):
                        if part[a]:
                            piece = data[base + a : base + e + width - 1].tobytes()
                            own = int((g[a : e + width - GRAM] == w[a]).sum()) > 1
                            out.append((w[a : a + 1].view(np.int64)[0], hashlib.md5(piece, usedforsecurity=False).digest(), own, i, base + a, piece))
            if out:
                key, digest, own, row, start, piece = zip(*out, strict=True)
                row = pa.array(row)
                yield pa.record_batch([pa.array(key, pa.int64()), pa.array(digest, pa.binary()), pa.array(own, pa.bool_()), batch.column("d").take(row), batch.column("h").take(row), pa.array(start, pa.int64()), pa.array(piece, pa.binary())], names=names)


def repeated_windows(pieces: list[bytes], memory: int = induced_sort.MEMORY, width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """For each piece, runs (first, last) of windows that start at another place of these pieces too."""
    size = np.array([len(x) for x in pieces])
    ends = np.cumsum(size + 1) - 1  # places of the marks between pieces
    t = np.ones(int(ends[-1]) + 2, dtype=np.int16)
    data = np.frombuffer(b"\0".join(pieces), dtype=np.uint8)
    t[: len(data)] = data
    t[: len(data)] += 2
    t[ends] = 1
    t[-1] = 0
    room = np.repeat(ends, size + 1) - np.arange(len(t) - 1)  # bytes before the next mark
    room = np.append(room, 0) >= width
    h = C.prefix_hash(C._BYTE[np.clip(t, 0, 255)] + t.astype(np.uint64))
    of = np.zeros(len(t), dtype=np.uint64)
    of[: len(t) - width + 1] = (h[width:] - h[:-width]) * C.powers(C._BACK, "back", len(t) - width + 1)
    windows = np.lib.stride_tricks.sliding_window_view(t, width)
    found = np.zeros(len(t), dtype=bool)
    last = np.zeros(0, dtype=np.int64)
    for order in induced_sort.suffixes(t, 258, memory):
        order = np.concatenate([last, order])
        x, y = order[:-1], order[1:]
        at = np.flatnonzero(room[x] & room[y] & (of[x] == of[y]))
        for k in range(0, len(at), 2048):
            some = at[k : k + 2048]
            some = some[(windows[x[some]] == windows[y[some]]).all(axis=1)]
            found[x[some]] = found[y[some]] = True
        last = order[-1:]
    out = []
    for e, n in zip(ends, size, strict=True):
        mine = found[e - n : e]
        a, b = runs(mine)
        out.append([(int(i), int(j - 1)) for i, j in zip(a, b, strict=True) if mine[i]])
    return out


def _sort(batches, width: int):
    """Repeated windows of pieces that come in the order of their keys; a batch ends where a key does."""

    def done(rows):
        found = repeated_windows([x[2] for x in rows], width=width)
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        return pa.record_batch([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary()), pa.array([[{"lo": a, "hi": b} for a, b in x] for x in found], kind)], names=["key", "digest", "ranges"])

    rows, held, last = [], 0, None
    for whole in batches:
        for batch in C.slices(whole, "bytes"):
            for key, digest, piece in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "bytes")), strict=True):
                if held >= BATCH and key != last:
                    yield done(rows)
                    rows, held = [], 0
                rows.append((key, digest, piece))
                held += len(piece)
                last = key
    if rows:
        yield done(rows)


def _candidates(ws: C.Workspace, docs: DataFrame, width: int) -> DataFrame:
    """Texts (d, h, text, spans) with the stretches whose keys have more than one run."""
    found = ws.save(docs.mapInArrow(C.lean(partial(_stretches, width=width)), "key long, d long, h long, a long, e long, n long"), "stretches")
    several = found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    spans = found.join(several, "key", "left_semi").groupBy("d", "h").agg(F.collect_set(F.struct("a", "e")).alias("spans"))  # of one text
    return ws.save(docs.join(spans, ["d", "h"]), "texts")


def _repeated(ws: C.Workspace, docs: DataFrame, width: int) -> DataFrame:
    """(d, h, spans): runs (a, b) of bytes that go, of each text that has any."""
    texts = _candidates(ws, docs, width)
    C.free_shuffles(ws.spark)
    once = texts.mapInArrow(C.lean(partial(_sampled, width=width)), "g long, d long, h long, p long").groupBy("g").agg(F.count("*").alias("n"), F.min(F.struct("d", "h", "p")).alias("at")).where("n = 1")
    single = ws.save(once.groupBy("at.d", "at.h").agg(F.collect_list("at.p").alias("single")), "single")  # of one text
    C.free_shuffles(ws.spark)
    pieces = ws.save(texts.join(single, ["d", "h"], "left").mapInArrow(C.lean(partial(_pieces, width=width)), "key long, digest binary, own boolean, d long, h long, start long, bytes binary"), "pieces")
    C.free_shuffles(ws.spark)
    distinct = ws.save(pieces.groupBy("key", "digest").agg(F.count("*").alias("n"), F.first("own").alias("own"), F.first("bytes").alias("bytes")), "distinct")
    C.free_shuffles(ws.spark)
    full = distinct.where("n > 1").select("key", "digest", F.array(F.struct(F.lit(0).cast("long").alias("lo"), (F.length("bytes") - width).cast("long").alias("hi"))).alias("ranges"))
    several = distinct.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("own"), F.min("n").alias("least")).where("least = 1 and (n > 1 or own)").select("key")
    found = distinct.join(several, "key", "left_semi").select("key", "digest", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(C.lean(partial(_sort, width=width)), "key long, digest binary, ranges array<struct<lo:long,hi:long>>")
    partly = found.join(distinct.where("n = 1").select("key", "digest"), ["key", "digest"], "left_semi").where("size(ranges) > 0")
    ranges = ws.save(full.unionByName(partly), "ranges")
    C.free_shuffles(ws.spark)
    places = pieces.select("key", "digest", "d", "h", "start").join(ranges, ["key", "digest"]).select("d", "h", "start", F.explode("ranges").alias("r"))
    spans = places.groupBy("d", "h").agg(F.collect_set(F.struct((F.col("start") + F.col("r.lo")).alias("a"), (F.col("start") + F.col("r.hi") + width).alias("b"))).alias("spans"))  # of one text
    spans = ws.save(spans, "spans")
    ws.drop("stretches", "texts", "single", "pieces", "distinct", "ranges")
    return spans


def merged(spans) -> list[tuple[int, int]]:
    """Overlapping and touching runs become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, name: str = "suffixes", as_text: bool = False, width: int = WIDTH) -> DataFrame:
    """``docs`` with kept (binary, the bytes that stay), n_bytes, n_removed and n_spans (longs: maximal removed runs).
    With ``as_text``, kept is a string, without the bytes of characters that a cut went through.

    A null text counts as empty. Rows with the same doc_id and text are separate places of that text, so texts of
    ``width`` bytes or more that are there twice go altogether. Null doc_ids are as good as any. Other columns stay, but
    for those that have the name of a new one: the new one takes their place.
    """
    docs = C.without(docs, "kept", "n_bytes", "n_removed", "n_spans")
    columns = docs.columns
    d, h, cuts = C.free(columns, "d", "h", "spans")
    keyed = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), h: F.xxhash64("text")})
    spans = _repeated(C.Workspace(docs.sparkSession, name), keyed.where("text is not null").select(F.col(d).alias("d"), F.col(h).alias("h"), "text"), width)
    joined = keyed.join(spans.select(F.col("d").alias(d), F.col("h").alias(h), F.col("spans").alias(cuts)), [d, h], "left").select(*columns, cuts)

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole, "text"):
                kept, n, gone, count = [], [], [], []
                for text, spans_ in zip(batch.column("text").to_pylist(), batch.column(cuts).to_pylist(), strict=True):
                    data, cut, at = (text or "").encode(), merged(spans_), 0
                    parts = []
                    for a, b in cut:
                        parts.append(data[at:a])
                        at = b
                    parts.append(data[at:])
                    kept.append(b"".join(parts))
                    n.append(len(data))
                    gone.append(len(data) - len(kept[-1]))
                    count.append(len(cut))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([x.decode(errors="ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64())], names=[*columns, "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(C.lean(run), C.schema_with(docs, f"kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(C.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
