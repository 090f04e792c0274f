"""Reverse-reachable sketches and greedy maximum coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draw import RANGE, draw
from ..graph import SEED, Graph
from ..lineage import cut
from . import whole
from .cascade import closure
from .ordering import ranked


def centres(vertices: DataFrame, first: int, last: int, salt: int | str = 1) -> DataFrame:
    """(sketch_id, id) for sketches first to last - 1: vertices by weight, from one draw for each sketch.

    The running sum of weights in the order of ids is cut into as many equal buckets as there are vertices; a vertex is
    filed under each bucket that it touches, so a draw meets the few vertices of one bucket.
    """
    rows = cut(ranked(vertices.where("weight > 0"), [F.col("id")], "rank", "weight", "upto"), "centres")
    n, total = rows.agg(F.count("*"), F.max("upto")).first()
    if not n:
        raise ValueError("no vertex has a positive weight")
    width = total / n
    last_bucket = F.lit(n - 1)
    lo = F.floor((F.col("upto") - F.col("weight")) / width)
    filed = rows.select("id", "upto", (F.col("upto") - F.col("weight")).alias("after"), F.explode(F.sequence(F.least(lo, last_bucket), F.least(F.floor(F.col("upto") / width), last_bucket))).alias("bucket"))
    sketches = vertices.sparkSession.range(first, last).select(F.col("id").alias("sketch_id"))
    drawn = sketches.withColumn("x", draw(salt, "sketch_id") * (total / RANGE)).withColumn("bucket", F.least(F.floor(F.col("x") / width), last_bucket))
    return drawn.join(filed, "bucket").where("x >= after and x < upto").select("sketch_id", "id")


def rr_sketches(g: Graph, n: int, first: int = 0, salt: int | str = 1) -> DataFrame:
    """(sketch_id, id) of sketches first to first + n - 1. An edge of a sketch is decided by one draw: below p its source
    is a member and goes on; below p_seed it is a member. Members do not depend on the order of neighbours. Graphs that a
    task can hold are walked there, larger ones hop by hop.
    """
    start = centres(g.vertices, first, first + n, f"{salt}c")
    second = F.col("p_seed") if g.model == SEED else F.col("p")
    edges = whole.thresholds(g.edges, F.least(F.col("p"), second), second)
    if edges.count() <= whole.EDGES_IN_TASK:
        return whole.walk(start, edges, whole.members(salt), "sketch_id long, id long", "sketches")
    edges = cut(edges, "edges")
    chance = draw(salt, "sketch_id", "src", "dst")

    def back(frontier: DataFrame, limit: str) -> DataFrame:
        return frontier.join(edges, frontier.id == edges.dst).where(chance < F.col(limit)).select("sketch_id", F.col("src").alias("id"))

    inner = cut(closure(start, lambda f: back(f, "t"), ["sketch_id", "id"]), "sketches")
    return cut(inner.union(back(inner, "s")).distinct(), "sketches") if g.model == SEED else inner


def append(g: Graph, members: DataFrame | None, have: int, upto: int, salt: int | str = 1) -> DataFrame:
    """``members`` of sketches 0 to have - 1 with those up to upto - 1: the same rows as in one go."""
    more = rr_sketches(g, upto - have, have, salt)
    return more if members is None else members.union(more)


def sketch_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("sketch_id").agg(F.count("*").alias("size"))


def sketch_stats(members: DataFrame) -> DataFrame:
    """(n_sketches, n_members, average_size, single_ratio)."""
    return sketch_sizes(members).agg(F.count("*").alias("n_sketches"), F.sum("size").alias("n_members"), F.avg("size").alias("average_size"), F.avg((F.col("size") == 1).cast("double")).alias("single_ratio"))


def select(members: DataFrame, k: int, vertices: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """(ord, id, gain): greedy maximum coverage. Each round takes the vertex in the most uncovered sketches, the least id
    of equals, until k (at most as many as there are) are chosen; vertices that cover nothing new come last, by id.

    One row a round reaches the driver; the sketches that it covers are dropped by an anti-join.
    """
    spark = members.sparkSession
    ids = vertices.select("id")
    if skipped is not None:
        ids = ids.join(skipped.select("id"), "id", "left_anti")
        members = members.join(skipped.select("id"), "id", "left_anti")
    k = max(0, min(k, ids.count()))
    members, chosen = cut(members.join(ids, "id", "left_semi"), "cover"), []
    while len(chosen) < k:
        best = members.groupBy("id").agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), "id").limit(1).collect()
        if not best:
            break
        chosen.append((len(chosen), best[0].id, best[0].gain))
        covered = members.where(F.col("id") == best[0].id).select("sketch_id")
        members = members.join(covered, "sketch_id", "left_anti")
        if len(chosen) % 4 == 0:
            members = cut(members, "cover")
    if len(chosen) < k:
        rest = ids.where(~F.col("id").isin([c[1] for c in chosen])) if chosen else ids
        chosen += [(len(chosen) + i, r.id, 0) for i, r in enumerate(rest.orderBy("id").limit(k - len(chosen)).collect())]
    return spark.createDataFrame(chosen, "ord int, id long, gain long")


