"""Ranking baselines: degree, strength, PageRank, rank refinement, and robust strong components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draw import draw, fires
from ..graph import SEED, Graph
from ..lineage import cut
from . import components, sketch
from .ordering import ranked


def _top(rows: DataFrame, value: str, k: int | None, largest: bool = True) -> DataFrame:
    """(ord, id, value) of the k best, the least id of equals; of all, if k is None or not positive."""
    order = [F.desc(value) if largest else F.asc(value), F.asc("id")]
    if k is not None and k > 0:
        rows = rows.orderBy(*order).limit(k)
    return ranked(rows, order, "ord").select((F.col("ord") - 1).alias("ord"), "id", value)


def max_out_degree(g: Graph, k: int | None = None) -> DataFrame:
    degree = g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return _top(g.vertices.select("id").join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree")), "degree", k)


def strength(g: Graph) -> DataFrame:
    total = g.edges.groupBy(F.col("src").alias("id")).agg(F.sum("p").alias("strength"))
    return g.vertices.select("id").join(total, "id", "left").select("id", F.round(F.coalesce("strength", F.lit(0.0)), 9).alias("strength"))


def max_out_strength(g: Graph, k: int | None = None) -> DataFrame:
    return _top(strength(g), "strength", k)


@dataclass(frozen=True)
class PageRankParams:
    damping: float = 0.85
    epsilon: float = 1e-6
    iterations: int = 1000
    transpose: bool = False
    vertex_weights: bool = True
    edge_weights: bool = True


def pagerank(g: Graph, params: PageRankParams = PageRankParams()) -> DataFrame:
    """(id, rank). c is the vertex weight, or 1: PR = d * sum(PR(u) p / L(u)) + (1 - d) c, starting from c, where L is
    the sum of p over u's edges; without edge weights p is 1 and L the number of edges. What vertices without edges
    hold is lost. Stops when the L2-normalised ranks move by less than epsilon.
    """
    n, bad = g.vertices.agg(F.count("*"), F.sum(((F.col("weight") <= 0) | F.isnan("weight") | F.col("weight").isNull() | (F.col("weight") == float("inf"))).cast("int"))).first()
    if params.vertex_weights and bad:
        raise ValueError("vertex weights must be finite and positive")
    edges = (g.reversed() if params.transpose else g).edges
    edges = edges.select("src", "dst", (F.col("p") if params.edge_weights else F.lit(1.0)).alias("w")).where("w > 0")
    total = edges.groupBy("src").agg(F.sum("w").alias("l"))
    edges = cut(edges.join(total, "src").select("src", "dst", (F.col("w") / F.col("l")).alias("share")), "pagerank")
    c = F.col("weight") if params.vertex_weights else F.lit(1.0)
    state = cut(g.vertices.select("id", c.alias("c"), c.alias("rank")), "pagerank")
    for _ in range(params.iterations if n else 0):
        inflow = edges.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("inflow"))
        new = state.withColumnRenamed("rank", "old").join(inflow, "id", "left").select("id", "c", (params.damping * F.coalesce("inflow", F.lit(0.0)) + (1 - params.damping) * F.col("c")).alias("rank"), "old")
        new = cut(new, "pagerank")
        a, b, ab = new.agg(F.sum(F.col("rank") ** 2), F.sum(F.col("old") ** 2), F.sum(F.col("rank") * F.col("old"))).first()
        state = new.select("id", "c", "rank")
        if not a or not b or 2 - 2 * ab / (a * b) ** 0.5 < params.epsilon**2:
            break
    return state.select("id", "rank")


def pagerank_topk(g: Graph, k: int | None = None, params: PageRankParams = PageRankParams(), largest: bool = True) -> DataFrame:
    return _top(pagerank(g, params).withColumn("rank", F.round("rank", 9)), "rank", k, largest)


def _sweep(rank: np.ndarray, head: np.ndarray, source: np.ndarray, p: np.ndarray) -> np.ndarray:
    """One sweep from the lowest rank to the highest. source[head[i] : head[i + 1]]: in-neighbours of the vertex of rank
    i, by ascending id; ranks count from the top."""
    mass = np.ones(len(rank))
    for v in range(len(rank) - 1, -1, -1):
        for k in range(head[v], head[v + 1]):
            u = source[k]
            if u < v:
                moved = p[k] * mass[v]
                mass[u] += moved
                mass[v] -= moved
    return mass


def imrank(g: Graph, k: int | None = None, iterations: int = 100, stop_after: int = 3) -> DataFrame:
    """(ord, id): self-consistent ranking. From the ranking by out-degree, each round passes mass from low ranks up to
    in-neighbours of higher rank, edge by edge in ascending order of source ids, and ranks by the mass kept; it ends
    when the top k stay the same for ``stop_after`` rounds.

    A sweep is sequential by definition. The graph of a round is one group, so it must fit one task.
    """
    order = max_out_degree(g).select("id", "ord")
    k = k if k and k > 0 else g.n()

    def round_of(key, table):
        import pyarrow as pa

        ids, rank = (table.column(c).to_numpy() for c in ("dst_id", "dst_ord"))
        source_id, source, p = (table.column(c).to_numpy(zero_copy_only=False) for c in ("src_id", "src_ord", "p"))
        n = int(rank.max()) + 1
        name = np.zeros(n, dtype=np.int64)
        name[rank] = ids
        real = ~np.isnan(p)
        at = np.lexsort((source_id[real], rank[real]))
        head = np.searchsorted(rank[real][at], np.arange(n + 1))
        mass = _sweep(np.arange(n), head, source[real][at].astype(np.int64), p[real][at])
        new = np.argsort(-np.round(mass, 12), kind="stable")
        return pa.table({"id": name[new], "ord": np.arange(n, dtype=np.int64), "mass": mass[new]})

    same = 0
    for _ in range(iterations):
        dst, src = (order.select(F.col("id").alias(f"{e}_id"), F.col("ord").alias(f"{e}_ord")) for e in ("dst", "src"))
        inner = g.edges.select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), "p").join(src, "src_id")
        rows = dst.join(inner, "dst_id", "left").select(F.lit(0).alias("one"), "dst_id", F.col("dst_ord").cast("long"), F.coalesce("src_id", F.lit(0)).alias("src_id"), F.coalesce("src_ord", F.lit(0)).cast("long").alias("src_ord"), F.coalesce("p", F.lit(float("nan"))).alias("p"))
        new = cut(rows.groupBy("one").applyInArrow(round_of, "id long, ord long, mass double"), "imrank")
        changed = new.where(F.col("ord") < k).join(order.select("id", F.col("ord").alias("before")), "id", "left").where("before is null or before <> ord").limit(1).count()
        order = new.select("id", "ord")
        same = 0 if changed else same + 1
        if same >= stop_after:
            break
    return order.where(F.col("ord") < k)


def robust_groups(g: Graph, r: int, salt: int | str = 1) -> DataFrame:
    """(id, group_id): vertices that are in one strong component in each of r live-edge samples share a group; its id is
    the least vertex in it."""
    if r < 1:
        raise ValueError("at least one sample is needed")
    groups = g.vertices.select("id", F.lit(0).cast("long").alias("group_id"))
    for i in range(r):
        live = g.edges.where(fires("p", f"{salt}s{i}", "src", "dst"))
        part = components.scc(Graph(g.vertices, live.select("src", "dst"), g.model))
        both = groups.join(part, "id")
        names = both.groupBy("group_id", "component").agg(F.min("id").alias("name"))
        groups = cut(both.join(names, ["group_id", "component"]).select("id", F.col("name").alias("group_id")), "robust")
    return groups


def contracted(g: Graph, groups: DataFrame) -> Graph:
    """Groups as vertices: weights add up, parallel edges combine to the probability that at least one fires."""
    of = lambda end: groups.select(F.col("id").alias(end), F.col("group_id").alias(f"g_{end}"))
    edges = g.edges.join(of("src"), "src").join(of("dst"), "dst").where("g_src <> g_dst").groupBy(F.col("g_src").alias("src"), F.col("g_dst").alias("dst")).agg((1 - F.product(1 - F.col("p"))).alias("p"))
    vertices = groups.join(g.vertices, "id").groupBy(F.col("group_id").alias("id")).agg(F.sum("weight").alias("weight"))
    return Graph(vertices, edges.withColumn("p_seed", F.col("p")), SEED)


def robust_scc(g: Graph, k: int, r: int, n_sketches: int, salt: int | str = 1) -> DataFrame:
    """(ord, id): seeds chosen on the graph of robust groups, each expanded to a member drawn at random."""
    groups = cut(robust_groups(g, r, salt), "robust")
    small = contracted(g, groups)
    chosen = sketch.select(sketch.rr_sketches(small, n_sketches, salt=f"{salt}k"), k, small.vertices)
    picked = groups.join(F.broadcast(chosen.select("ord", F.col("id").alias("group_id"))), "group_id")  # k rows
    return picked.groupBy("ord").agg(F.min_by("id", F.struct(draw(f"{salt}m", "id"), "id")).alias("id"))
