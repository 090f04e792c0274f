"""Boost-aware reverse sketches (for choosing vertices to boost when the seeds are fixed).

An attempt draws a centre and decides every edge: LIVE, LIVE_UPON_BOOST or BLOCKED. Distances count the
LIVE_UPON_BOOST edges on a path; an attempt is kept if the nearest seed is at a distance from 1 to k of the centre.
All attempts are rows of one dataset: a distance level is a closure over LIVE edges, and a step over LIVE_UPON_BOOST
edges leads to the next level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draw import draw
from ..graph import Graph
from ..lineage import counted, cut
from . import sketch, whole
from .cascade import closure, edge_state

KEY = ["sketch_id", "id"]

#: Most edges of a sketch whose distances one task finds; about 300 bytes each.
SKETCH_IN_TASK = 500_000


@dataclass(frozen=True)
class BoostSketches:
    """touched: (sketch_id, src, dst, state) within the budget; distances: (sketch_id, id, dist_s, dist_r) of vertices
    that are on a path of at most k from a seed to the centre; critical: (sketch_id, id)."""

    attempts: int
    centres: DataFrame
    touched: DataFrame
    distances: DataFrame
    edges: DataFrame
    critical: DataFrame
    seeds: DataFrame
    k: int

    def n(self) -> int:
        return self.centres.count()

    def success_rate(self) -> float:
        return self.n() / self.attempts if self.attempts else 0.0


def edge_states(g: Graph, attempts: DataFrame, salt: int | str = 1) -> DataFrame:
    """(sketch_id, src, dst, state) of the edges into the rows (sketch_id, id), without the blocked ones."""
    state = edge_state(F.col("p"), F.col("p_boost"), draw(salt, "sketch_id", "src", "dst"))
    return attempts.join(g.edges, attempts.id == g.edges.dst).select("sketch_id", "src", "dst", state.alias("state")).where("state <> 'BLOCKED'")


def levels(start: DataFrame, edges_of, most: int, boosted: DataFrame | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(sketch_id, id, dist) of all vertices within distance ``most`` of ``start``. edges_of: from a frontier (sketch_id,
    id) to rows (sketch_id, next, state, target), where target is the end that could be boosted. Vertices in ``stop``
    are reached but not left."""
    frontier, seen = cut(start.select(*KEY).distinct(), "level"), None

    def outgoing(rows: DataFrame) -> DataFrame:
        if stop is not None:
            rows = rows.join(stop.select("id"), "id", "left_anti")
        out = edges_of(rows)
        if boosted is None:
            return out.withColumn("cost", F.when(F.col("state") == "LIVE", 0).otherwise(1))
        return out.join(boosted.select(F.col("id").alias("target"), F.lit(True).alias("_b")), "target", "left").withColumn("cost", F.when((F.col("state") == "LIVE") | F.col("_b"), 0).otherwise(1))

    for d in range(most + 1):
        def free(rows: DataFrame, before=seen) -> DataFrame:
            out = outgoing(rows).where("cost = 0").select("sketch_id", F.col("next").alias("id"))
            return out if before is None else out.join(before, KEY, "left_anti")

        level = cut(closure(frontier, free, KEY).withColumn("dist", F.lit(d)), "level")
        seen = level if seen is None else seen.union(level)
        if d < most:
            paid = outgoing(level.select(*KEY)).where("cost = 1").select("sketch_id", F.col("next").alias("id")).distinct()
            frontier, n = counted(paid.join(seen, KEY, "left_anti"), "level")
            if not n:
                break
    return seen


def _within(edges: DataFrame, backward: bool):
    """Edges of a stored table, from a frontier."""
    here, there = ("dst", "src") if backward else ("src", "dst")
    rows = edges.select("sketch_id", F.col(here).alias("id"), F.col(there).alias("next"), "state", F.col("dst").alias("target"))
    return lambda frontier: frontier.join(rows, KEY).select("sketch_id", "next", "state", "target")


def boost_sketches(g: Graph, seeds: DataFrame, attempts: int, k: int, first: int = 0, salt: int | str = 1) -> BoostSketches:
    """The sketches that attempts first to first + attempts - 1 give; a sketch's id is its attempt."""
    seeds = cut(seeds.select(F.col("id").cast("long")).distinct(), "boost")
    drawn = cut(sketch.centres(g.vertices, first, first + attempts, f"{salt}c"), "boost")
    start = drawn.join(seeds, "id", "left_anti").select("sketch_id", "id")
    touched = _touched_in_tasks(g, seeds, start, k, salt)
    if touched is None:
        kept, touched = _touched_by_levels(g, seeds, start, k, salt)
    else:
        kept = cut(touched.select("sketch_id").distinct(), "boost")
    centres = cut(start.join(kept, "sketch_id", "left_semi"), "boost")
    both = two_distances(touched, centres, seeds, k)
    distances, edges = compressed(touched, centres, both, k)
    return BoostSketches(attempts, centres, touched, distances, edges, cut(critical_of(touched, both), "boost"), seeds, k)


def _named(ids: DataFrame) -> frozenset[int]:
    """The seeds or the vertices to boost: a given, short list."""
    return frozenset(r.id for r in ids.select("id").collect())


def _states_in_tasks(g: Graph) -> DataFrame | None:
    """Edges with the thresholds of LIVE and LIVE_UPON_BOOST, if a task can hold them."""
    edges = whole.thresholds(g.edges, F.col("p"), F.col("p_boost"))
    return edges if edges.count() <= whole.EDGES_IN_TASK else None


def _touched_in_tasks(g: Graph, seeds: DataFrame, start: DataFrame, k: int, salt: int | str) -> DataFrame | None:
    edges = _states_in_tasks(g)
    if edges is None:
        return None
    return whole.walk(start, edges, whole.touched(salt, _named(seeds), k), "sketch_id long, src long, dst long, state string", "boost")


def _touched_by_levels(g: Graph, seeds: DataFrame, start: DataFrame, k: int, salt: int | str) -> tuple[DataFrame, DataFrame]:
    """The sketches that are kept, and their touched edges, hop by hop."""

    def backward(frontier: DataFrame) -> DataFrame:
        return edge_states(g, frontier, salt).select("sketch_id", F.col("src").alias("next"), "state", F.col("dst").alias("target"))

    to_centre = cut(levels(start, backward, k, stop=seeds), "boost")
    at_seed = to_centre.join(seeds, "id", "left_semi").groupBy("sketch_id").agg(F.min("dist").alias("near"))
    kept = cut(at_seed.where("near > 0").select("sketch_id"), "boost")
    to_centre = cut(to_centre.join(kept, "sketch_id", "left_semi"), "boost")
    inner = to_centre.join(seeds, "id", "left_anti").select(*KEY)
    return kept, cut(edge_states(g, inner, salt).join(to_centre.select("sketch_id", F.col("id").alias("src")), ["sketch_id", "src"], "left_semi").select("sketch_id", "src", "dst", "state"), "boost")


def found_seeds(touched: DataFrame, seeds: DataFrame) -> DataFrame:
    return touched.select("sketch_id", F.col("src").alias("id")).join(seeds, "id", "left_semi").select(*KEY).distinct()


def two_distances(touched: DataFrame, centres: DataFrame, seeds: DataFrame, k: int, boosted: DataFrame | None = None) -> DataFrame:
    """(sketch_id, id, dist_s, dist_r): distances from the seeds and to the centre; beyond k they are null. Sketches
    are taken in one task each, unless the largest has more than SKETCH_IN_TASK edges."""
    largest = touched.groupBy("sketch_id").count().agg(F.max("count")).first()[0] or 0
    if largest <= SKETCH_IN_TASK:
        rows = centres.withColumnRenamed("id", "centre").join(touched, "sketch_id", "left")
        return cut(whole.distances(rows, _named(seeds), k, _named(boosted) if boosted is not None else frozenset()), "boost")
    from_seeds = levels(found_seeds(touched, seeds), _within(touched, False), k, boosted).withColumnRenamed("dist", "dist_s")
    to_centre = levels(centres, _within(touched, True), k, boosted).withColumnRenamed("dist", "dist_r")
    return cut(from_seeds.join(to_centre, KEY, "full"), "boost")


def compressed(touched: DataFrame, centres: DataFrame, d: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Of the distances ``d``, those of the vertices that stay, and the edges (sketch_id, src, dst, state) between them. A vertex stays if
    dist_s > 0 and dist_s + dist_r <= k; what seeds reach for free is the super seed, src null, whose edges are
    LIVE_UPON_BOOST and occur once for each target; vertices that reach the centre for free link straight to it.
    """
    stay = cut(d.where("dist_s > 0 and dist_r is not null and dist_s + dist_r <= " + str(int(k))), "boost")
    name = lambda end, *c: stay.select("sketch_id", F.col("id").alias(end), *c)
    free = d.where("dist_s = 0").select("sketch_id", F.col("id").alias("src"))
    to_stay = touched.join(name("dst"), ["sketch_id", "dst"], "left_semi")
    from_super = to_stay.join(free, ["sketch_id", "src"], "left_semi").select("sketch_id", F.lit(None).cast("long").alias("src"), "dst", F.lit("LIVE_UPON_BOOST").alias("state")).distinct()
    between = to_stay.join(name("src", "dist_r").where("dist_r > 0").drop("dist_r"), ["sketch_id", "src"], "left_semi").select("sketch_id", "src", "dst", "state")
    straight = stay.where("dist_r = 0").select(*KEY).join(centres.withColumnRenamed("id", "centre"), "sketch_id").where("id <> centre").select("sketch_id", F.col("id").alias("src"), F.col("centre").alias("dst"), F.lit("LIVE").alias("state"))
    return stay, cut(from_super.union(between).union(straight).distinct(), "boost")


def critical_of(touched: DataFrame, distances: DataFrame) -> DataFrame:
    """(sketch_id, id): boosting this vertex alone lets the seeds reach the centre; it has an edge from what the seeds
    reach for free, and reaches the centre for free itself."""
    free = distances.where("dist_s = 0").select("sketch_id", F.col("id").alias("src"))
    hit = touched.join(free, ["sketch_id", "src"], "left_semi").select("sketch_id", F.col("dst").alias("id")).distinct()
    return hit.join(distances.where("dist_s = 1 and dist_r = 0"), KEY, "left_semi")


def critical_by_closures(g: Graph, seeds: DataFrame, centres: DataFrame, salt: int | str = 1) -> DataFrame:
    """(sketch_id, id), without distances: v reaches the centre over LIVE edges, an edge into v is LIVE_UPON_BOOST from a
    vertex that a seed reaches over LIVE edges, and no seed reaches the centre so. It does not depend on k."""
    seeds = seeds.select("id").distinct()
    start = centres.join(seeds, "id", "left_anti").select(*KEY)
    edges = _states_in_tasks(g)
    if edges is not None:
        return whole.walk(start, edges, whole.critical(salt, _named(seeds)), "sketch_id long, id long", "boost")
    back = closure(start, lambda f: edge_states(g, f, salt).where("state = 'LIVE'").select("sketch_id", F.col("src").alias("id")), KEY)
    back = cut(back, "boost")
    alive = back.join(back.join(seeds, "id", "left_semi").select("sketch_id").distinct(), "sketch_id", "left_anti")
    state = edge_state(F.col("p"), F.col("p_boost"), draw(salt, "sketch_id", "src", "dst"))

    def forward(f: DataFrame) -> DataFrame:
        return f.join(g.edges, f.id == g.edges.src).where(state == "LIVE").select("sketch_id", F.col("dst").alias("id"))

    sketches = alive.select("sketch_id").distinct()
    lit = closure(_each(sketches, seeds), forward, KEY)
    into = edge_states(g, alive, salt).where("state = 'LIVE_UPON_BOOST'")
    return into.join(lit.select("sketch_id", F.col("id").alias("src")), ["sketch_id", "src"], "left_semi").select("sketch_id", F.col("dst").alias("id")).distinct()


def _each(sketches: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every seed in every sketch; the seeds are a given, short list."""
    ids = [r.id for r in seeds.orderBy("id").collect()]
    return sketches.select("sketch_id", F.explode(F.array(*[F.lit(i) for i in ids])).alias("id")) if ids else sketches.select("sketch_id", F.lit(0).cast("long").alias("id")).limit(0)


def select_critical(s: BoostSketches, k: int, vertices: DataFrame) -> DataFrame:
    """(ord, id, gain): greedy maximum coverage of the critical sets, without the seeds."""
    return cover_critical(s.critical, k, vertices, s.seeds)


def cover_critical(critical: DataFrame, k: int, vertices: DataFrame, seeds: DataFrame) -> DataFrame:
    """The same of critical sets (sketch_id, id) alone."""
    return sketch.select(critical, k, vertices, seeds)


def select(s: BoostSketches, k: int, vertices: DataFrame) -> DataFrame:
    """(ord, id, gain): greedy choice that looks at distances anew after each pick: a vertex gains an uncovered sketch if,
    with the chosen ones boosted, it has an edge from what the seeds reach and reaches the centre, both for free."""
    spark = vertices.sparkSession
    ids = vertices.select("id").join(s.seeds, "id", "left_anti")
    k, chosen = max(0, min(k, ids.count())), []
    centres, touched, gains = s.centres, s.touched, s.critical
    while len(chosen) < k:
        names = [c[1] for c in chosen]
        left = ids.where(~F.col("id").isin(names)) if names else ids
        best = gains.join(left, "id", "left_semi").groupBy("id").agg(F.countDistinct("sketch_id").alias("gain")).orderBy(F.desc("gain"), "id").limit(1).collect()
        if not best:
            rest = left.orderBy("id").limit(k - len(chosen)).collect()
            chosen += [(len(chosen) + i, r.id, 0) for i, r in enumerate(rest)]
            break
        chosen.append((len(chosen), best[0].id, best[0].gain))
        if len(chosen) == k:
            break
        boosted = spark.createDataFrame([(c[1],) for c in chosen], "id long")
        covered = gains.where(F.col("id") == best[0].id).select("sketch_id").distinct()
        centres = cut(centres.join(covered, "sketch_id", "left_anti"), "boost")
        touched = cut(touched.join(centres.select("sketch_id"), "sketch_id", "left_semi"), "boost")
        d = two_distances(touched, centres, s.seeds, s.k, boosted)
        gains = cut(critical_of(touched, d), "boost")
    return spark.createDataFrame(chosen, "ord int, id long, gain long")


def stats(s: BoostSketches) -> DataFrame:
    """(n_sketches, n_vertices, n_edges, success_rate): totals over the compressed sketches."""
    edges = s.edges.count()
    return s.distances.agg(F.lit(s.n()).cast("long").alias("n_sketches"), F.count("*").alias("n_vertices"), F.lit(edges).cast("long").alias("n_edges"), F.lit(s.success_rate()).alias("success_rate"))
