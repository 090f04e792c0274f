"""Weakly and strongly connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..lineage import counted, cut, is_empty

#: Most edges of a graph whose strong components one task finds; about 200 bytes each.
IN_ONE_TASK = 1_000_000


def _least_labels(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that is connected, ignoring directions. Labels spread to neighbours and then to the
    label of the label, so long paths take few rounds."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "wcc")
    labels = cut(ids.select("id", F.col("id").alias("component")), "wcc")
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("to"))
        new, changed = counted(step.join(labels.select(F.col("id").alias("to"), F.col("component").alias("then")), "to").select("id", "old", F.least("to", "then").alias("component")), "wcc", "old <> component")
        if not changed:
            return new.select("id", "component")
        labels = new.select("id", "component")


def wcc(g: Graph, skipped: DataFrame | None = None) -> DataFrame:
    """(id, component) of the graph without ``skipped``; component is the least id in it."""
    ids, edges = g.vertices.select("id"), g.edges.select("src", "dst")
    if skipped is not None:
        out = skipped.select("id")
        ids = ids.join(out, "id", "left_anti")
        edges = edges.join(out.withColumnRenamed("id", "src"), "src", "left_anti").join(out.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return _least_labels(ids, edges)


def n_wcc(g: Graph, skipped: DataFrame | None = None) -> int:
    return wcc(g, skipped).select("component").distinct().count()


def _trimmed(ids: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Vertices without an in-edge or an out-edge are components of their own; what is left after a round of that, and
    how many edges."""
    inner = edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    keep = cut(ids.join(inner, "id", "left_semi"), "scc")
    alone = ids.join(inner, "id", "left_anti")
    kept = edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return alone, keep, *counted(kept, "scc")


def _spread(ids: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, colour): the least colour that reaches each vertex along edges; ``start`` is (id, colour)."""
    labels = cut(start, "colour")
    while True:
        near = edges.join(labels.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("near"))
        new, changed = counted(labels.join(near, "id", "left").select("id", F.col("colour").alias("old"), F.least("colour", F.coalesce("near", "colour")).alias("colour")), "colour", "old <> colour")
        labels = new.select("id", "colour")
        if not changed:
            return labels


def _strong(heads: list[int], tails: list[int]) -> dict[int, int]:
    """The least vertex of the strong component of each end of an edge: one walk along edges numbers the vertices by
    when they are left, a second against edges in the reverse of that order gathers components."""
    out: dict[int, list[int]] = {}
    back: dict[int, list[int]] = {}
    for u, v in zip(heads, tails, strict=True):
        out.setdefault(u, []).append(v)
        back.setdefault(v, []).append(u)
    seen, left = set(), []
    for root in out:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(out[root]))]
        while stack:
            node, rest = stack[-1]
            for v in rest:
                if v not in seen:
                    seen.add(v)
                    stack.append((v, iter(out.get(v, ()))))
                    break
            else:
                left.append(node)
                stack.pop()
    found: dict[int, int] = {}
    for root in reversed(left):
        if root in found:
            continue
        found[root], members, at = root, [root], 0
        while at < len(members):
            for u in back.get(members[at], ()):
                if u not in found:
                    found[u] = root
                    members.append(u)
            at += 1
        least = min(members)
        for v in members:
            found[v] = least
    return found


def _strong_in_one_task(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of a graph that is known to have at most IN_ONE_TASK edges."""

    def run(batches):
        import pyarrow as pa

        heads, tails = [], []
        for batch in batches:
            heads += batch.column("src").to_pylist()
            tails += batch.column("dst").to_pylist()
        found = _strong(heads, tails)
        yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["id", "component"])

    found = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).coalesce(1).mapInArrow(run, "id long, component long")
    return cut(ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "scc")


def scc(g: Graph, edge_filter: Column | None = None) -> DataFrame:
    """(id, component): component is the least id in it. ``edge_filter`` keeps the edges for which it holds.

    Colouring: each vertex gets the least id that reaches it; going back from each colour's root within its colour
    gives the root's component; those go, and the rest starts again. Vertices that cannot be in a cycle go first, round
    after round while that takes a tenth of the edges. Once
    no more than IN_ONE_TASK edges are left, their count being known, one task ends the search: long paths, which take
    many rounds, are by then short of work for more than one.
    """
    edges = g.edges.where(edge_filter) if edge_filter is not None else g.edges
    edges, n = counted(edges.select("src", "dst").distinct(), "scc")
    ids, found = g.vertices.select("id"), []
    while True:
        before = None
        while n > IN_ONE_TASK and (before is None or n <= 0.9 * before):
            before = n
            alone, ids, edges, n = _trimmed(ids, edges)
            found.append(cut(alone.select("id", F.col("id").alias("component")), "scc"))
        if n <= IN_ONE_TASK:
            found.append(_strong_in_one_task(ids, edges))
            break
        if is_empty(ids):
            break
        colours = _spread(ids, edges, ids.select("id", F.col("id").alias("colour")))
        of = lambda end: colours.select(F.col("id").alias(end), F.col("colour").alias(f"c_{end}"))
        inner = cut(edges.join(of("src"), "src").join(of("dst"), "dst").where("c_src = c_dst").select("src", "dst"), "scc")
        hit = cut(colours.where("id = colour").select("id"), "scc")
        seen = hit
        while True:
            hit, more = counted(inner.join(hit.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id")).distinct().join(seen, "id", "left_anti"), "scc")
            if not more:
                break
            seen = seen.union(hit)
        found.append(cut(colours.join(seen, "id", "left_semi").select("id", F.col("colour").alias("component")), "scc"))
        seen = cut(seen, "scc")
        ids = cut(ids.join(seen, "id", "left_anti"), "scc")
        edges, n = counted(edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"), "scc")
        if is_empty(ids):
            break
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def n_scc(g: Graph, edge_filter: Column | None = None) -> int:
    return scc(g, edge_filter).select("component").distinct().count()
