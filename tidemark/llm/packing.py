"""Packing token sequences by concatenating and cutting (operator 4).

Pass one tokenises each document once, adds the end id, and writes ids with the number of tokens that came before them
in their task. Totals by task, one number each, give the tasks' global offsets by a prefix sum; pass two adds them and
cuts every document's ids at multiples of the window. A document that crosses a window gets a boundary record, one
piece for each window it touches. Only the last sequence can be short, so padding is less than one window in all.

Ids come from the ranks of the same byte-level vocabulary through a faster library; tests hold them against the
tokenizer's own file.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

LENGTH, END = 1024, 0
_encodings: dict = {}


def encoder(ranks: str, pattern: str, special: tuple[tuple[str, int], ...]):
    """A function from a text to its ids. The strings of special tokens in a text become their ids."""
    key = (ranks, special)
    if key not in _encodings:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens=dict(special))
    encoding, names = _encodings[key], [name for name, _ in special]

    def encode(text: str) -> list[int]:
        return encoding.encode(text, allowed_special="all") if any(x in text for x in names) else encoding.encode_ordinary(text)

    return encode


def tokenize(docs: DataFrame, ranks: str, pattern: str, special: tuple[tuple[str, int], ...] = (), end: int = END) -> DataFrame:
    """(task, before, doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit numbers with ``end`` after them."""

    def run(batches):
        from pyspark import TaskContext

        task, before, encode = TaskContext.get().partitionId(), 0, encoder(ranks, pattern, special)
        for whole in batches:
            for batch in C.slices(whole, "text"):
                ids = [np.array([*encode(x or ""), end], dtype="<u4") for x in batch.column("text").to_pylist()]
                n = np.array(list(map(len, ids)), dtype=np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.record_batch([pa.array([task] * len(n), pa.int32()), pa.array(starts), batch.column("doc_id"), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())], names=["task", "before", "doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(C.lean(run), "task int, before long, doc_id long, n_tokens long, ids binary")


def pack(tokens: DataFrame, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, crosses, ids) of a written table of
    ``tokenize``. ``crosses``: the document goes on in another sequence. ids is left out unless ``with_ids``.
    """
    totals = {r.task: r.n for r in tokens.groupBy("task").agg(F.sum("n_tokens").alias("n")).collect()}  # a number for each task
    order = sorted(totals)
    base = dict(zip(order, np.concatenate(([0], np.cumsum([totals[k] for k in order])[:-1])).tolist(), strict=True)) if order else {}
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "crosses", *["ids"] * with_ids]
    kinds = [pa.int64()] * 7 + [pa.bool_()] + [pa.binary()] * with_ids

    def run(batches):
        for whole in batches:
            for batch in C.slices(whole, "ids"):
                out: list[list] = [[] for _ in names]
                for task, before, doc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("task", "before", "doc_id", "n_tokens", "ids")), strict=True):
                    at, start = base[task] + before, 0
                    while start < n:
                        sequence, offset = divmod(at + start, length)
                        take = min(length - offset, n - start)
                        piece = ids[4 * start : 4 * (start + take)]
                        for column, value in zip(out, (doc, start, take, zlib.crc32(piece), n, sequence, offset, take < n, piece), strict=False):
                            column.append(value)
                        start += take
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=names)

    return tokens.mapInArrow(C.lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, crosses boolean" + ", ids binary" * with_ids)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = END) -> DataFrame:
    """(sequence_id, n_tokens, ids array<int>): the pieces put together. A sequence is padded to ``length`` unless its
    number of tokens is a power of two. A sequence has at most ``length`` tokens, so its group is bounded.
    """

    def join(key, table):
        table = table.sort_by("offset")
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), dtype="<u4").astype(np.int32)
        n = len(ids)
        full = ids if n & (n - 1) == 0 else np.concatenate([ids, np.full(length - n, pad, dtype=np.int32)])
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "ids": pa.array([full.tolist()], pa.list_(pa.int32()))})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, n_tokens long, ids array<int>")


def public_vocabulary() -> dict:
    import public_tokenizers as P

    return {"ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN, "special": (("<|endoftext|>", 50256),)}


def packed(docs: DataFrame, name: str = "packing", length: int = LENGTH, with_ids: bool = False, **vocabulary) -> DataFrame:
    """All documents in sequences of at most ``length`` tokens. A null text counts as empty and has the end id alone;
    repeated rows are packed as often as they occur; a null doc_id stays null; an empty table has no piece. Both passes
    run here, on small batches; without ids the pieces are a small table, and what they were cut from is dropped.
    """
    ws = C.Workspace(docs.sparkSession, name)
    with C.small_batches(docs.sparkSession):
        tokens = ws.save(tokenize(docs, **(vocabulary or public_vocabulary())), "tokens")
        if with_ids:
            return pack(tokens, length, with_ids)
        pieces = ws.save(pack(tokens, length, with_ids), "pieces")
    ws.drop("tokens")
    return pieces


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(C.documents(spark, sf_dir)).drop("crosses")
