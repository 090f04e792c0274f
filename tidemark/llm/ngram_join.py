"""N-gram Jaccard join by PartEnum signatures (operator 1).

Two documents link when the Jaccard similarity of their sets of 5-word shingles is at least 3/4. The join is exact.

PartEnum. For a band of set sizes, the feature domain is cut into n1 parts, and each of these into n2 = 3. A set's
signatures are its projections on every subset of n2 - k2 = 2 of the 3 smaller parts of each of the n1. Two linked sets of
a and b elements differ in d <= (a + b) / 7 elements. A part without a difference makes the sets share all its 3
signatures, a part with one difference 1 of them. So of all N = 3 n1 signatures they share at least G = 3 n1 - 2 d if d <
n1, and 2 n1 - d otherwise; n1 is PARTS times the greatest d of the band, so G is positive for the largest sets too. In
any order of signatures that depends on their content alone, the first that both sets share has at most N - G others
before it in either set; so a set emits only its first N - G + 1, for the greatest d that it can have. Signatures come in
the order of their rarest element: counts of all shingles of all documents, in a fixed number of hashed slots, put what
many documents share at the end, where it is seldom emitted. The counts steer the order only; any counts give the same
links.

Signatures of no element are not emitted. A set that has no more than N - G others emits its first d + 1 single elements
too: two such sets share one of those. Sets of under 64 elements always emit single elements.

Bands hold sizes 4**j to 4**(j+1) - 1; sets in a band's last quarter, which can link with the next band, emit for both.

Sketches. A sketch has a bit for each of 2 to 4 times as many places as the set has elements: whether an odd number of
elements falls there. Sets differ in at least as many elements as their sketches in bits (the longer one is folded), so
most candidates go without a look at their texts. What is left is verified by counting the intersection.

Groups. Documents with equal sets are linked to the smallest doc_id among them by a key of the set; all but that one of a
frequent set emit no signatures, so a huge group of copies costs a row each. In a bucket of one signature, every document
is checked against the one whose shingles are the most common, which in a group of edited copies is among the least
edited; components follow. After that, only documents outside the component of their bucket's lead meet the others of
buckets with that lead: many of them by sketches, in blocks that are dealt one by one, where no row is made for a pair
unless its sketches are close; few of them as pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C

WIDTH = 5
#: Similarity 3/4, as a fraction of integers.
NUM, DEN = 75, 100
#: Slots of the shingle counts, and the pieces in which tasks hand them over.
SLOT_BITS, PIECES = 20, 64
#: Parts of a band, as a share of the most elements in which its largest sets differ; over 1 / 2.
PARTS = 0.6
#: Counts of tasks that one step adds up.
FAN_IN = 128
#: A set is frequent if it makes up more than one in so many documents.
HOT_SHARE = 20_000
#: Places of the bitmap of ids whose texts are asked for, 4 MB, and 64-bit words of it that one row holds.
ID_BITS, ID_WORDS = 25, 1024
#: Documents whose sketches meet as many others in one step; under a lead with more than FEW, documents meet so.
BLOCK, FEW = 256, 64

_U64 = np.uint64


def _differ(a: int, b: int) -> int:
    """Most elements in which linked sets of a and b elements differ."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def _set_key(h: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    return np.array([C.mix(h).sum(dtype=np.uint64), C.mix(h ^ _U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], dtype=np.uint64).tobytes() + len(h).to_bytes(4, "little")


def _sketch(h: np.ndarray) -> bytes:
    """Parities of a set's elements at 64 * 2**j places, twice to four times as many as there are elements."""
    if not len(h):
        return b""
    places = max(64, 1 << (2 * len(h) - 1).bit_length())
    odd = np.bincount((h & _U64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    """Sketches, a row of words each, at the width of ``words``."""
    while x.shape[-1] > words:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def _may_link(x: np.ndarray, y: np.ndarray, n, m) -> np.ndarray:
    """Whether sets of n and m elements with sketches x and y can be linked, by their sizes and sketches."""
    words = min(x.shape[-1], y.shape[-1])
    differ = np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum(axis=-1, dtype=np.int64)
    return (differ * (DEN + NUM) <= (n + m) * (DEN - NUM)) & (n * DEN >= m * NUM) & (m * DEN >= n * NUM)


def _profile(batches):
    """For each document its set's size, key and sketch; for the task, counts of shingles by slot, in pieces."""
    counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    any_row = False
    for whole in batches:
        for batch in C.slices(whole, "text"):
            n, keys, sketches = [], [], []
            for h in C.shingles(batch.column("text"), WIDTH):
                np.add.at(counts, (h >> _U64(64 - SLOT_BITS)).astype(np.int64), 1)
                n.append(len(h))
                keys.append(_set_key(h))
                sketches.append(_sketch(h))
            any_row = True
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary())], names=["doc_id", "n_shingles", "set_key", "sketch", "piece", "task", "counts"])
    if any_row:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        blobs = [x.astype(np.uint32).tobytes() for x in np.split(counts, PIECES)]
        yield pa.record_batch([pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, pa.binary()), pa.nulls(PIECES, pa.binary()), pa.array(range(PIECES), pa.int32()), pa.array([task] * PIECES, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sketch", "piece", "task", "counts"])


def _add_counts(key, table):
    total = np.zeros((1 << SLOT_BITS) // PIECES, dtype=np.uint64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_buffer(), dtype=np.uint32)
    blob = np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([blob], pa.binary())})


def _subsets(h: np.ndarray, count: np.ndarray, salt: np.ndarray, greatest: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Value, least count and size of each signature with elements, and how many a set emits that differs from others
    of its band in at most d elements; ``greatest``: d of the band's largest sets."""
    n1 = int(PARTS * (greatest + 1)) + 1
    part = (((h >> _U64(32)) * _U64(3 * n1)) >> _U64(32)).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    where = part[at]
    value, rare, size = np.zeros(3 * n1, np.uint64), np.full(3 * n1, 2**32 - 1, np.uint32), np.zeros(3 * n1, np.int64)
    value[where] = C.mix(np.add.reduceat(C.mix(h ^ salt), at) + where.astype(np.uint64))
    rare[where], size[where] = np.minimum.reduceat(count, at), np.diff(np.append(at, len(h)))
    value, rare, size = (x.reshape(n1, 3) for x in (value, rare, size))
    one, two = [0, 0, 1], [1, 2, 2]
    both = size[:, one] + size[:, two]
    tag = np.arange(3 * n1, dtype=np.uint64).reshape(n1, 3)
    values = C.mix(value[:, one] + value[:, two] * _U64(0x9E3779B97F4A7C15) + tag)
    shared = 3 * n1 - 2 * d if d < n1 else 2 * n1 - d
    live = both > 0
    return values[live], np.minimum(rare[:, one], rare[:, two])[live], both[live], 3 * n1 - shared + 1


def _signatures_of(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    s = len(h)
    if not s:
        return h
    band = (s.bit_length() - 1) // 2
    out = []
    for space in (band, band + 1) if DEN * s >= NUM * 4 ** (band + 1) else (band,):
        top = 4 ** (space + 1) - 1
        k = _differ(s, min(s * DEN // NUM, top))
        count = counts[(h >> _U64(64 - SLOT_BITS)).astype(np.int64)]
        salt = C.mix(np.array([space + 1], dtype=np.uint64))
        singles = space < 3
        if not singles:
            value, rare, size, most = _subsets(h, count, salt, _differ(top, top), k)
            out.append(value[np.lexsort((value, -size, rare))[:most]])
            singles = len(value) < most
        if singles:
            value = C.mix(h ^ ~salt)
            out.append(value[np.lexsort((value, count))[: k + 1]])
    return np.concatenate(out)


def _rank(h: np.ndarray, counts: np.ndarray) -> int:
    """Least for the sets whose elements are the most common; the lower 32 bits are the size."""
    common = int(8 * np.log2(1.0 + counts[(h >> _U64(64 - SLOT_BITS)).astype(np.int64)]).mean()) if len(h) else 0
    return (255 - min(common, 255)) << 32 | len(h)


def _signatures(shared):
    """shared: a broadcast of the counts, of fixed size, and of the frequent sets' keys with their smallest ids."""

    def run(batches):
        blob, hot = shared.value
        counts = np.frombuffer(blob, dtype=np.uint32)
        for whole in batches:
            for batch in C.slices(whole, "text"):
                ids = batch.column("doc_id").to_pylist()
                found = list(C.shingles(batch.column("text"), WIDTH))
                sigs = [_signatures_of(h, counts) if len(h) and hot.get(_set_key(h), i) == i else h[:0] for i, h in zip(ids, found, strict=True)]
                n = [len(x) for x in sigs]
                if sum(n):
                    rank = np.array([_rank(h, counts) for h in found], dtype=np.int64)
                    yield pa.record_batch([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(ids, dtype=np.int64), n)), pa.array(np.repeat(rank, n))], names=["sig", "doc", "rank"])

    return run


def _verify(batches):
    """Pairs that link, of pairs with both texts."""
    for whole in batches:
        for batch in C.slices(whole, "text_a", C.STEP_BYTES // 2):
            keep = []
            for i, (x, y) in enumerate(zip(C.shingles(batch.column("text_a"), WIDTH), C.shingles(batch.column("text_b"), WIDTH), strict=True)):
                if len(x) and len(y):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if DEN * both >= NUM * (len(x) + len(y) - both):
                        keep.append(i)
            if keep:
                yield pa.record_batch([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep))], names=["a", "b"])


def _close(batches):
    """Pairs whose sketches can be linked."""
    for batch in batches:
        n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(c).to_pylist()] for c in ("sketch_a", "sketch_b"))
        keep = pa.array([i for i in range(len(batch)) if _may_link(x[i], y[i], n_a[i], n_b[i])], pa.int64())
        yield pa.record_batch([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])


def _close_blocks(batches):
    """Pairs of documents of two blocks, in different components, whose sketches can be linked."""

    def block(docs):
        """Documents by the width of their sketches: ids, components, sizes, sketches."""
        found: dict[int, list] = {}
        for d in docs:
            found.setdefault(len(d["sketch"]), []).append(d)
        return [(np.array([d["doc"] for d in ds]), np.array([d["component"] for d in ds]), np.array([d["size"] for d in ds]), np.stack([np.frombuffer(d["sketch"], np.uint64) for d in ds])) for ds in found.values()]

    for batch in batches:
        for at in range(len(batch)):
            row = batch.slice(at, 1).to_pylist()[0]
            out = []
            for ids_a, of_a, n_a, x in block(row["some"]):
                for ids_b, of_b, n_b, y in block(row["many"]):
                    if max(x.shape[1], y.shape[1]) <= 4 * min(x.shape[1], y.shape[1]):  # sizes are within 4 / 3
                        step = max(1, (1 << 21) // (len(ids_b) * max(x.shape[1], y.shape[1])))
                        for i in range(0, len(ids_a), step):
                            part = slice(i, i + step)
                            ok = _may_link(x[part, None, :], y[None, :, :], n_a[part, None], n_b[None, :]) & (of_a[part, None] != of_b[None, :])
                            p, q = np.nonzero(ok)
                            out.append(np.stack([np.minimum(ids_a[part][p], ids_b[q]), np.maximum(ids_a[part][p], ids_b[q])]))
            if out:
                a, b = np.unique(np.concatenate(out, axis=1), axis=1)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _counts(profile: DataFrame) -> bytes:
    """The counts of all tasks, added up FAN_IN at a time."""
    counts = profile.where("piece is not null").select("piece", "task", "counts")
    tasks = counts.agg(F.max("task")).first()[0]
    while tasks:
        counts = counts.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("piece", "task").applyInArrow(_add_counts, "piece int, task long, counts binary")
        tasks //= FAN_IN
    pieces = {r.piece: bytes(r.counts) for r in counts.collect()}  # PIECES rows
    return b"".join(pieces.get(i, bytes(4 * (1 << SLOT_BITS) // PIECES)) for i in range(PIECES))


def _frequent(sets: DataFrame) -> dict[bytes, int]:
    """Keys of sets that make up more than 1 / HOT_SHARE of all documents, with their smallest ids. There can be no more
    than HOT_SHARE of them."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    return {bytes(r.set_key): r.rep for r in sets.where(F.col("n") >= max(20, total // HOT_SHARE + 1)).select("set_key", "rep").collect()}


def _members(ws: C.Workspace, docs: DataFrame, shared) -> DataFrame:
    """(lead, doc, size, lead_size): the documents of each signature that more than one has, by the lead of its bucket."""
    sigs = docs.where("doc_id is not null").mapInArrow(C.lean(_signatures(shared)), "sig long, doc long, rank long")
    by_sig = Window.partitionBy("sig").orderBy("rank", "doc")
    chained = sigs.withColumns({"lead": F.first("doc").over(by_sig), "lead_rank": F.first("rank").over(by_sig), "then": F.lead("doc").over(by_sig)})
    size_of = lambda rank: F.expr(f"{rank} & 4294967295")
    rows = chained.where("lead <> doc or then <> doc")  # else the document is alone in it
    return ws.save(rows.select("lead", "doc", size_of("rank").alias("size"), size_of("lead_rank").alias("lead_size")).distinct(), "members")


def _linked(ws: C.Workspace, docs: DataFrame, sketches: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that link: by sketches, then by texts."""
    a, b = (sketches.select(F.col("doc").alias(x), F.col("size").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    close = ws.save(pairs.join(a, "a").join(b, "b").mapInArrow(C.lean(_close), "a long, b long").distinct(), f"{name}-close")
    C.free_shuffles(ws.spark)
    return _verified(ws, docs, close, name)


def _bitmap_piece(key, table):
    words = np.zeros(ID_WORDS, dtype=np.int64)
    words[table.column("word").to_numpy() % ID_WORDS] = table.column("bits").to_numpy()
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([words.tobytes()], pa.binary())})


def _maybe_asked(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``docs`` without most rows whose doc_id is not among ``asked``, by a bitmap of hashed ids of fixed size: other rows
    need no shuffle of their texts. Some stay by chance, the more the more ids are asked for; a join sees to those."""
    place = f"shiftrightunsigned(xxhash64(doc_id), {64 - ID_BITS})"
    words = asked.select(F.expr(place).alias("place")).groupBy(F.expr("place div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits"))
    pieces = words.groupBy(F.expr(f"word div {ID_WORDS}").alias("piece")).applyInArrow(_bitmap_piece, "piece long, bits binary")
    whole = bytearray((1 << ID_BITS) // 8)
    for r in pieces.collect():  # 2 ** ID_BITS bits at most
        whole[r.piece * ID_WORDS * 8 : (r.piece + 1) * ID_WORDS * 8] = r.bits
    shared = docs.sparkSession.sparkContext.broadcast(bytes(whole))

    @F.pandas_udf("boolean")
    def known(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((np.frombuffer(shared.value, dtype=np.uint64)[at >> 6] >> (at & 63).astype(np.uint64)) & _U64(1) == 1)

    return docs.where(known(F.expr(place)))


def _verified(ws: C.Workspace, docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of a written table that link, by their texts."""
    asked = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = ws.save(_maybe_asked(docs, asked).join(asked, "doc_id", "left_semi"), f"{name}-texts")
    C.free_shuffles(ws.spark)
    a, b = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    out = ws.save(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(C.lean(_verify), "a long, b long").distinct(), name)
    ws.drop(f"{name}-close", f"{name}-texts")
    return out


def _open_members(ws: C.Workspace, members: DataFrame, components: DataFrame) -> DataFrame:
    """(lead, doc, size, component, apart, n_docs, n_apart): documents under a lead that are not all of one component;
    ``apart``: not in that of the lead."""
    member = members.groupBy("lead", "doc").agg(F.max("size").alias("size")).join(components.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    lead_of = components.select(F.col("id").alias("lead"), F.col("component").alias("lead_component"))
    member = ws.save(member.join(lead_of, "lead", "left").withColumn("apart", F.col("component") != F.coalesce("lead_component", "lead")).drop("lead_component"), "kept")
    size = member.groupBy("lead").agg(F.count("*").alias("n_docs"), F.sum(F.col("apart").cast("int")).alias("n_apart"), F.countDistinct("component").alias("parts"))
    return ws.save(member.join(size.where("n_apart > 0 and parts > 1").drop("parts"), "lead"), "open")


def _other_links(ws: C.Workspace, docs: DataFrame, members: DataFrame, sketches: DataFrame, components: DataFrame) -> DataFrame:
    """Links in a bucket that join different components. Of two documents in different components, one is not in that of
    the lead.

    Under a lead with more than FEW documents, the sketches of those that are apart meet those of all others block by
    block: a block of the former is a key of its own, to which the others are dealt. Under other leads pairs are listed.
    """
    full = _open_members(ws, members, components)
    C.free_shuffles(ws.spark)
    side = lambda d: full.where(F.col("n_docs") <= FEW).select("lead", F.col("doc").alias(d), *[F.col(c).alias(f"{c}_{d}") for c in ("size", "component", "apart")])
    pairs = side("a").join(side("b"), "lead").where("apart_a and a <> b and component_a <> component_b and (not apart_b or a < b)")
    pairs = pairs.where((F.col("size_a") * DEN >= F.col("size_b") * NUM) & (F.col("size_b") * DEN >= F.col("size_a") * NUM))
    pairs = ws.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    few = _linked(ws, docs, sketches, pairs, "few")
    many = full.where(F.col("n_docs") > FEW).join(sketches.select("doc", "sketch"), "doc").withColumn("d", F.struct("doc", "component", "size", "sketch"))
    block = lambda n: F.expr(f"pmod(xxhash64(doc), {n} div {BLOCK} + 1)")
    some = many.where("apart").groupBy("lead", block("n_apart").alias("at")).agg(F.collect_list("d").alias("some"))
    others = many.groupBy("lead", block("n_docs").alias("block")).agg(F.collect_list("d").alias("many"), F.first("n_apart").alias("n_apart"))
    dealt = others.select("lead", "many", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n_apart div {BLOCK}"))).alias("at"))
    close = ws.save(some.join(dealt, ["lead", "at"]).select("some", "many").mapInArrow(C.lean(_close_blocks), "a long, b long").distinct(), "others-close")
    C.free_shuffles(ws.spark)
    return _verified(ws, docs, close, "others").union(few)


def near_duplicates(docs: DataFrame, name: str = "ngram") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text; other columns are not read).

    Null and empty texts, and texts of white space, have no shingles and link with nothing. Rows with the same doc_id
    are one document to links, whatever their texts; each row keeps its own n_shingles. Rows with a null doc_id link
    with nothing and have a null component_id. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = C.Workspace(spark, name)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = ws.save(docs.mapInArrow(C.lean(_profile), "doc_id long, n_shingles long, set_key binary, sketch binary, piece int, task long, counts binary"), "profile")
    rows = profile.where("piece is null").select("doc_id", "n_shingles", "set_key")
    sets = ws.save(rows.where("doc_id is not null and n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "sets")
    same = ws.save(rows.where("doc_id is not null").join(sets.where("n > 1").select("set_key", "rep"), "set_key").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "same")

    members = _members(ws, docs, spark.sparkContext.broadcast((_counts(profile), _frequent(sets))))
    C.free_shuffles(spark)
    sketches = profile.where("doc_id is not null and n_shingles > 0").select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("size"), "sketch")
    sized = (F.col("lead_size") * DEN >= F.col("size") * NUM) & (F.col("size") * DEN >= F.col("lead_size") * NUM)
    stars = members.where(F.col("lead") != F.col("doc")).where(sized).select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct()
    links = _linked(ws, docs, sketches, stars, "stars").union(same)
    components = C.connected_components(ws, links, "first")
    more = _other_links(ws, docs, members, sketches, components)
    if more.limit(1).count():
        components = C.connected_components(ws, links.union(more), "last")
    ws.drop("sets", "members", "stars", "same", "kept", "open", "pairs", "few", "others")
    return rows.join(components.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir))
