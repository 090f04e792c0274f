"""Cascades over live edges: forward simulation, reverse closures, and analytic activation probabilities.

Every trial decides each edge by one keyed draw, so a trial is a live-edge graph and trials are independent rows of one
dataset. A frontier moves one hop for all trials at once: a join with the edges, a filter on the draw, and the removal
of what was reached before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draw import RANGE, draw
from ..graph import BOOST, SEED, Graph
from ..lineage import counted, cut, is_empty
from . import whole

#: Most draws of a cascade that are made for all edges and trials ahead, which takes one job in place of one a hop.
DRAWS_AHEAD = 1_000_000_000


def closure(start: DataFrame, step, keys: list[str], most: int | None = None) -> DataFrame:
    """All rows of ``keys`` that ``step`` (from a frontier to its successors) reaches from ``start``, which belongs to
    them. At most ``most`` steps."""
    seen = frontier = cut(start.select(*keys).distinct(), "reached")
    hop = 0
    while most is None or hop < most:
        frontier, n = counted(step(frontier).select(*keys).distinct().join(seen, keys, "left_anti"), "frontier")
        if not n:
            break
        seen = seen.union(frontier)
        hop += 1
        if hop % 8 == 0:
            seen = cut(seen, "reached")
    return seen


def reached(g: Graph, seeds: DataFrame, tries: int, boosted: DataFrame | None = None, salt: int | str = 1) -> DataFrame:
    """(sim, id): what each of ``tries`` cascades from ``seeds`` (id) activates, seeds included.

    In the seed model an edge fires with p_seed if its source is a seed; in the boost model with p_boost if its target
    is boosted; otherwise with p.
    """
    if tries <= 0:
        raise ValueError("the number of trials must be positive")
    seeds = seeds.select(F.col("id").cast("long")).distinct()
    edges = g.edges
    if g.model == SEED:
        edges = edges.join(seeds.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").withColumn("_p", F.when(F.col("_s"), F.col("p_seed")).otherwise(F.col("p")))
    elif g.model == BOOST and boosted is not None:
        edges = edges.join(boosted.select(F.col("id").cast("long").alias("dst"), F.lit(True).alias("_b")).distinct(), "dst", "left").withColumn("_p", F.when(F.col("_b"), F.col("p_boost")).otherwise(F.col("p")))
    else:
        edges = edges.withColumn("_p", F.col("p"))
    edges = cut(edges.select("src", "dst", F.floor(F.col("_p") * float(RANGE)).alias("_t")).where("_t > 0"), "edges")

    def step(frontier: DataFrame) -> DataFrame:
        return frontier.join(edges, frontier.id == edges.src).where(draw(salt, "sim", "src", "dst") < F.col("_t")).select("sim", F.col("dst").alias("id"))

    start = seeds.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tries - 1).cast("long"))).alias("sim"), "id")
    m, live = edges.agg(F.count("*"), F.sum("_t") / float(RANGE)).first()
    if _ahead(m, live, tries):
        return _spread(edges.withColumn("_b", F.col("_t")), seeds, start, tries, salt).select("sim", "id")
    return closure(start, step, ["sim", "id"])


def _ahead(m: int, live: float | None, tries: int) -> bool:
    """Whether all draws are made ahead: if there are not too many, and a task can hold the live edges of a trial, of which
    ``live`` are expected."""
    return m * tries <= DRAWS_AHEAD and (live or 0.0) + 6 * (live or 0.0) ** 0.5 <= whole.LIVE_IN_TASK


def _spread(edges: DataFrame, seeds: DataFrame, start: DataFrame, tries: int, salt: int | str) -> DataFrame:
    """(sim, id, plain, boosted): whether the edges (src, dst, _t, _b) that fire below _t and those that fire below _b lead
    from seeds to a vertex. All edges are drawn for all trials, then each trial is walked in one task."""
    trials = edges.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tries - 1).cast("long"))).alias("sim"), "src", "dst", "_t", "_b")
    x = F.element_at(F.transform(F.array(draw(salt, "sim", "src", "dst")), lambda d: F.when(d < F.greatest("_t", "_b"), (d < F.col("_t")).cast("int") + 2 * (d < F.col("_b")).cast("int"))), 1)
    live = trials.select("sim", "src", "dst", x.alias("fires")).where("fires is not null")
    ids = sorted(r.id for r in seeds.collect())  # a given, short list
    return start.select("sim", "id", F.lit(True).alias("plain"), F.lit(True).alias("boosted")).union(live.groupBy("sim").applyInArrow(whole.spread(ids), "sim long, id long, plain boolean, boosted boolean"))


def reached_both(g: Graph, seeds: DataFrame, tries: int, boosted: DataFrame, salt: int | str = 1) -> DataFrame:
    """(sim, id, plain, boosted) of the boost model: whether a cascade activates the vertex without and with ``boosted``.
    The same as ``reached`` twice, from draws that are made once."""
    if tries <= 0:
        raise ValueError("the number of trials must be positive")
    seeds = seeds.select(F.col("id").cast("long")).distinct()
    mark = boosted.select(F.col("id").cast("long").alias("dst"), F.lit(True).alias("_m")).distinct()
    edges = g.edges.join(mark, "dst", "left").withColumn("_p", F.when(F.col("_m"), F.col("p_boost")).otherwise(F.col("p")))
    edges = cut(edges.select("src", "dst", F.floor(F.col("p") * float(RANGE)).alias("_t"), F.floor(F.col("_p") * float(RANGE)).alias("_b")).where("_t > 0 or _b > 0"), "edges")
    m, live = edges.agg(F.count("*"), F.sum(F.greatest("_t", "_b")) / float(RANGE)).first()
    if _ahead(m, live, tries):
        start = seeds.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tries - 1).cast("long"))).alias("sim"), "id")
        return _spread(edges, seeds, start, tries, salt)
    a = reached(g, seeds, tries, salt=salt).withColumn("plain", F.lit(True))
    b = reached(g, seeds, tries, boosted, salt).withColumn("boosted", F.lit(True))
    return a.join(b, ["sim", "id"], "full").select("sim", "id", F.coalesce("plain", F.lit(False)).alias("plain"), F.coalesce("boosted", F.lit(False)).alias("boosted"))


def simulate(g: Graph, seeds: DataFrame, tries: int, boosted: DataFrame | None = None, weighted: bool = True, salt: int | str = 1) -> float:
    """Mean weight that a cascade activates, that of the seeds included; 0 without seeds, whatever ``tries`` is."""
    if is_empty(seeds):
        return 0.0
    rows = reached(g, seeds, tries, boosted, salt)
    if weighted:
        total = rows.groupBy("id").count().join(g.vertices, "id").agg(F.sum(F.col("count") * F.col("weight"))).first()[0]
    else:
        total = rows.count()
    return float(total or 0.0) / tries


def simulate_frequency(g: Graph, seeds: DataFrame, tries: int, boosted: DataFrame | None = None, salt: int | str = 1) -> DataFrame:
    """(id, frequency): the share of trials that activate each vertex; 1 for seeds."""
    hits = reached(g, seeds, tries, boosted, salt).groupBy("id").agg(F.count("*").alias("hits"))
    return g.vertices.select("id").join(hits, "id", "left").select("id", (F.coalesce("hits", F.lit(0)) / float(tries)).alias("frequency"))


def target_reach(g: Graph, seeds: DataFrame, targets: DataFrame, tries: int, salt: int | str = 1) -> float:
    """Share of trials in which the seeds reach any of ``targets``."""
    return reached(g, seeds, tries, salt=salt).join(targets.select("id"), "id", "left_semi").select("sim").distinct().count() / tries


def activation_probability(g: Graph, seeds: DataFrame, rounds: int, tolerance: float = 0.0) -> DataFrame:
    """(id, p_in, p_in_boosted) of the boost model: the probability that an in-neighbour activates a vertex, taking paths
    as independent, after so many rounds of F(v) = 1 - prod(1 - p x), where x is 1 for seeds and F(u) of the round
    before for others. p_in_boosted takes p_boost on the last hop alone. Seeds are 0. Ends early once no value moves by
    more than ``tolerance``.
    """
    seeds = seeds.select(F.col("id").cast("long"), F.lit(True).alias("is_seed")).distinct()
    state = cut(g.vertices.select("id").join(seeds, "id", "left").select("id", F.coalesce("is_seed", F.lit(False)).alias("is_seed"), F.lit(0.0).alias("p_in"), F.lit(0.0).alias("p_in_boosted")), "activation")
    for _ in range(rounds):
        x = F.when(F.col("is_seed"), 1.0).otherwise(F.col("p_in"))
        inflow = g.edges.join(state.select(F.col("id").alias("src"), x.alias("x")).where("x > 0"), "src").groupBy(F.col("dst").alias("id")).agg((1 - F.product(1 - F.col("p") * F.col("x"))).alias("a"), (1 - F.product(1 - F.col("p_boost") * F.col("x"))).alias("b"))
        value = lambda c: F.when(F.col("is_seed"), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
        new = cut(state.withColumnsRenamed({"p_in": "old", "p_in_boosted": "old_b"}).join(inflow, "id", "left").select("id", "is_seed", value("a").alias("p_in"), value("b").alias("p_in_boosted"), "old", "old_b"), "activation")
        moved = new.agg(F.max(F.greatest(F.abs(F.col("p_in") - F.col("old")), F.abs(F.col("p_in_boosted") - F.col("old_b"))))).first()[0]
        state = new.drop("old", "old_b")
        if moved is None or moved <= tolerance:
            break
    return state.select("id", "p_in", "p_in_boosted")


def edge_state(p: Column, p_boost: Column, value: Column) -> Column:
    """LIVE below p, LIVE_UPON_BOOST below p_boost, else BLOCKED, for a draw in [0, RANGE)."""
    return F.when(value < F.floor(p * float(RANGE)), "LIVE").when(value < F.floor(p_boost * float(RANGE)), "LIVE_UPON_BOOST").otherwise("BLOCKED")
