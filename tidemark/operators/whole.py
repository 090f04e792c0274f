"""Trials on a graph that a task can hold whole.

Hop by hop, a closure costs a job a hop, and cascades on probabilities of 1 / in-degree take hundreds of hops of a few
rows each. A graph of at most EDGES_IN_TASK edges goes to every task in place of that, and each task walks its share of
the trials to their ends. Larger graphs go hop by hop; draws are the same, and so are the results.
"""

from __future__ import annotations

import ctypes
from contextlib import contextmanager
from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draw import threshold
from ..lineage import cut

#: Most edges of a graph that each task holds, at 12 bytes each (16 if ids of sources take more than 31 bits).
EDGES_IN_TASK = 32_000_000

#: Most live edges of a cascade's trial that a task holds; some 100 bytes each.
LIVE_IN_TASK = 4_000_000

#: Edges of a packed row, or more where one target has more.
PACKED = 1 << 13


class Into:
    """Edges by their targets, with two thresholds each, of lists of the columns that ``packed`` makes, which are emptied
    one by one. A target's edges are in one row."""

    def __init__(self, dst: list, n: list, src: list, t: list, s: list):
        def taken(parts: list):
            out, end = np.empty(sum(map(len, parts)), dtype=np.result_type(np.int32, *parts)), 0
            for k in range(len(parts)):
                out[end : end + len(parts[k])] = parts[k]
                end += len(parts[k])
                parts[k] = None
            give_back()  # before the next column is copied
            return out

        names, many = taken(dst), taken(n).astype(np.int64)
        at = np.argsort(names)
        self.names, self.first, self.n = names[at], (np.cumsum(many) - many)[at], many[at]
        self.src, self.t, self.s = taken(src), taken(t), taken(s)

    def draw(self, prefix: str, ids):
        """The edges into ``ids``: sources, targets, and whether the draws are below the first and the second threshold."""
        ids = np.fromiter(ids, dtype=np.int64)
        k = np.searchsorted(self.names, ids)
        known = k < len(self.names)
        known[known] = self.names[k[known]] == ids[known]
        ids, k = ids[known], k[known]
        n = self.n[k]
        at = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        src, dst = self.src[at].astype(np.int64), np.repeat(ids, n)
        head = f"{prefix}:".encode()
        x = np.fromiter((int.from_bytes(md5(b"%b%d:%d" % (head, a, b)).digest()[:4], "big") >> 4 for a, b in zip(src.tolist(), dst.tolist(), strict=True)), np.int64, len(src))
        return src, dst, x < self.t[at], x < self.s[at]


def thresholds(edges: DataFrame, first: Column, second: Column) -> DataFrame:
    """(src, dst, t, s): below which draws an edge fires, without the edges that never do."""
    return edges.select("src", "dst", threshold(first).alias("t"), threshold(second).alias("s")).where("t > 0 or s > 0")


def give_back() -> None:
    """A worker's free memory to the system: an idle worker lives on for a while beside what runs next."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim is not None:
        trim(0)


#: Columns of packed rows: arrays as bytes, of targets, of how many edges each has, and of the edges' sources and thresholds.
COLUMNS = ["dst", "n", "src", "t", "s"]


def packed(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, t, s) as rows of some PACKED edges, all of a target in one. Sources take 8 bytes each in rows where
    one takes more than 31 bits, else 4 as the thresholds do."""

    def pieces(src, dst, t, s):
        at = np.argsort(dst, kind="stable")
        src, t, s = src[at], t[at], s[at]
        names, first, n = np.unique(dst[at], return_index=True, return_counts=True)
        heads = np.flatnonzero(np.diff(first // PACKED, prepend=-1)).tolist()
        for a, b in zip(heads, [*heads[1:], len(names)], strict=True):
            rows = slice(first[a], first[a] + n[a:b].sum())
            narrow = -(1 << 31) <= src[rows].min() and src[rows].max() < 1 << 31
            yield names[a:b], n[a:b].astype(np.int32), src[rows].astype(np.int32 if narrow else np.int64), t[rows], s[rows]

    def run(batches):
        import pyarrow as pa

        parts = [[batch.column(c).to_numpy() for c in ("src", "dst", "t", "s")] for batch in batches]
        if parts:
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            parts.clear()
            for piece in pieces(*columns):
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in piece], names=COLUMNS)
            columns.clear()
        give_back()

    rows = edges.select("src", "dst", F.col("t").cast("int"), F.col("s").cast("int")).repartition("dst")
    return rows.mapInArrow(run, ", ".join(f"{c} binary" for c in COLUMNS))


def unpacked(batch) -> list:
    """The arrays of each of COLUMNS in a batch of packed rows and others, copied."""
    rows = [[x.as_buffer() for x in batch.column(c).drop_null()] for c in COLUMNS]
    sources = [np.int32 if src.size == t.size else np.int64 for src, t in zip(rows[2], rows[3], strict=True)]
    kinds = [np.int64] * len(sources), [np.int32] * len(sources), sources, [np.int32] * len(sources), [np.int32] * len(sources)
    return [np.concatenate([np.frombuffer(x, dtype=k) for x, k in zip(column, kind, strict=True)]) if column else np.zeros(0, dtype=np.int32) for column, kind in zip(rows, kinds, strict=True)]


@contextmanager
def small_batches(spark: SparkSession):
    """Inside, what runs hands Python so many bytes at most at a time. A batch lies in the memory of both the JVM, which
    doubles it as it grows, and the worker, beside the edges."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "8m")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def walk(trials: DataFrame, edges: DataFrame, of_trial, schema: str, name: str) -> DataFrame:
    """What ``of_trial`` (Into, sketch_id, id) makes of each trial (sketch_id, id), a list of columns or None, as a table by
    ``cut``. ``edges`` (src, dst, t, s) are at most EDGES_IN_TASK, and go packed to as many tasks as the cluster runs at a
    time."""
    tasks = max(1, trials.sparkSession.sparkContext.defaultParallelism)
    parts = F.sequence(F.lit(0), F.lit(tasks - 1))
    none = F.lit(None)
    given = packed(edges).select(F.explode(parts).alias("part"), none.cast("long").alias("sketch_id"), none.cast("long").alias("id"), *COLUMNS)
    asked = trials.select(F.pmod("sketch_id", F.lit(tasks)).cast("int").alias("part"), "sketch_id", "id", *[none.cast("binary").alias(c) for c in COLUMNS])

    def run(batches):
        import pyarrow as pa

        held: list[list] = [[] for _ in COLUMNS]
        wanted: list[tuple[int, int]] = []
        for batch in batches:
            asks = batch.filter(batch.column("sketch_id").is_valid())
            wanted += zip(asks.column("sketch_id").to_pylist(), asks.column("id").to_pylist(), strict=True)
            for to, c in zip(held, unpacked(batch), strict=True):
                to.append(c)
        if not wanted:
            return
        batch = asks = c = None  # arrays in them would stay
        into = Into(*held)
        for sketch_id, start in wanted:
            found = of_trial(into, sketch_id, start)
            if found is None:
                continue
            rows = len(found[0])
            for at in range(0, rows, 1 << 16):
                columns = [c[at : at + (1 << 16)] for c in found]
                yield pa.RecordBatch.from_arrays([pa.array([sketch_id] * len(columns[0]), pa.int64()), *(pa.array(c) for c in columns)], names=names)

    names = [c.split()[0] for c in schema.split(", ")]
    with small_batches(trials.sparkSession):
        return cut(given.union(asked).repartitionById(tasks, F.col("part")).drop("part").mapInArrow(run, schema), name)


def members(salt: int | str):
    """For ``walk``: the ids of a reverse-reachable sketch. Below t a source goes on, below s it is a member."""

    def of_trial(into: Into, sketch_id: int, start: int):
        seen, ends, front = {start}, set(), {start}
        while front:
            src, _, goes, joins = into.draw(f"{salt}:{sketch_id}", front)
            ends.update(src[joins].tolist())
            front = set(src[goes].tolist()) - seen
            seen |= front
        return [np.array(sorted(seen | ends), dtype=np.int64)]

    return of_trial


def touched(salt: int | str, seeds: frozenset[int], most: int):
    """For ``walk``, where t is LIVE and s is LIVE_UPON_BOOST: the edges (src, dst, state) within the budget, of a sketch
    whose nearest seed is at a distance from 1 to ``most``. A sketch that a seed reaches for free ends at that seed."""

    def of_trial(into: Into, sketch_id: int, start: int):
        if start in seeds:
            return None
        reached, front, rows = {start}, {start}, []
        for d in range(most + 1):
            paid: set[int] = set()
            while front:
                if not d and not seeds.isdisjoint(front):
                    return None
                src, dst, live, open_ = into.draw(f"{salt}:{sketch_id}", front - seeds)
                open_ |= live
                rows.append((src[open_], dst[open_], live[open_]))
                paid.update(src[open_ & ~live].tolist())
                front = set(src[live].tolist()) - reached
                reached |= front
            if d < most:
                front = paid - reached
                reached |= front
        if seeds.isdisjoint(reached):
            return None
        src, dst, live = (np.concatenate(c) for c in zip(*rows, strict=True))
        kept = np.isin(src, np.fromiter(reached, dtype=np.int64))
        return [src[kept], dst[kept], np.where(live[kept], "LIVE", "LIVE_UPON_BOOST").astype(object)]

    return of_trial


def critical(salt: int | str, seeds: frozenset[int]):
    """For ``walk``: the ids that alone, if boosted, let the seeds reach the centre. Whether seeds reach the source of an
    edge for free is asked backwards from it, up to the first seed."""

    def of_trial(into: Into, sketch_id: int, start: int):
        prefix = f"{salt}:{sketch_id}"
        if start in seeds:
            return None
        alive, front, doors = {start}, {start}, []
        while front:
            src, dst, live, open_ = into.draw(prefix, front)
            upon = open_ & ~live
            doors += zip(src[upon].tolist(), dst[upon].tolist(), strict=True)
            front = set(src[live].tolist()) - alive
            if not seeds.isdisjoint(front):
                return None
            alive |= front
        lit, dark, found = set(seeds), set(alive), set()
        for source, target in doors:
            seen = front = {source} - dark - lit
            while front and lit.isdisjoint(front):
                src, _, live, _ = into.draw(prefix, front)
                front = set(src[live].tolist()) - seen - dark
                seen = seen | front
            if front:
                lit.add(source)
            else:
                dark |= seen
            if source in lit:
                found.add(target)
        return [np.array(sorted(found), dtype=np.int64)]

    return of_trial


def distances(rows: DataFrame, seeds: frozenset[int], most: int, boosted: frozenset[int] = frozenset()) -> DataFrame:
    """(sketch_id, id, dist_s, dist_r) of rows (sketch_id, centre, src, dst, state), each sketch in one task."""

    def spread(start, edges: dict) -> dict[int, int]:
        dist, front = dict.fromkeys(start, 0), list(start)
        for d in range(most + 1):
            paid: list[int] = []
            while front:
                more = []
                for v in front:
                    for w, free in edges.get(v, ()):
                        if w not in dist:
                            if free:
                                dist[w] = d
                                more.append(w)
                            else:
                                paid.append(w)
                front = more
            if d < most:
                for w in paid:
                    if w not in dist:
                        dist[w] = d + 1
                        front.append(w)
        return dist

    def run(key, table):
        import pyarrow as pa

        centre = table.column("centre")[0].as_py()
        table = table.filter(table.column("src").is_valid())
        out: dict[int, list] = {}
        back: dict[int, list] = {}
        for u, v, live in zip(table.column("src").to_pylist(), table.column("dst").to_pylist(), (s == "LIVE" for s in table.column("state").to_pylist()), strict=True):
            free = live or v in boosted
            out.setdefault(u, []).append((v, free))
            back.setdefault(v, []).append((u, free))
        s, r = spread(seeds & out.keys(), out), spread({centre}, back)
        ids = sorted(s.keys() | r.keys())
        return pa.table({"sketch_id": pa.array([key[0].as_py()] * len(ids), pa.int64()), "id": pa.array(ids, pa.int64()), "dist_s": pa.array([s.get(v) for v in ids], pa.int32()), "dist_r": pa.array([r.get(v) for v in ids], pa.int32())})

    return rows.groupBy("sketch_id").applyInArrow(run, "sketch_id long, id long, dist_s int, dist_r int")


def spread(seeds: list[int]):
    """For the live edges (sim, src, dst, fires) of one trial: (sim, id, plain, boosted) of what edges with the first bit of
    ``fires``, and those with the second, lead to from ``seeds``; the seeds themselves are left out."""

    def run(key, table):
        import pyarrow as pa

        src, dst, fires = (table.column(c).to_numpy() for c in ("src", "dst", "fires"))
        every = np.unique(np.concatenate([src, dst, np.array(seeds, dtype=np.int64)]))
        src, dst, start = (np.searchsorted(every, x) for x in (src, dst, seeds))

        def walked(bit: int):
            mine = (fires & bit) > 0
            at = np.argsort(src[mine], kind="stable")
            head, tail = np.searchsorted(src[mine][at], np.arange(len(every) + 1)), dst[mine][at]
            seen, front = np.zeros(len(every), dtype=bool), start
            seen[front] = True
            while len(front):
                n = head[front + 1] - head[front]
                to = tail[np.repeat(head[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                front = np.unique(to[~seen[to]])
                seen[front] = True
            seen[start] = False
            return seen

        plain = walked(1)
        boosted = walked(2) if (fires != 3).any() else plain
        hit = plain | boosted
        return pa.table({"sim": pa.array(np.full(int(hit.sum()), key[0].as_py(), dtype=np.int64)), "id": pa.array(every[hit]), "plain": pa.array(plain[hit]), "boosted": pa.array(boosted[hit])})

    return run
