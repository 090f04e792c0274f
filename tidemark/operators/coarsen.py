"""Coarsening of a graph by groups of up to three vertices, and the way back.

Everything about one group is one row (heuristics h_in0.., inner probabilities i01.., weights w0..), and everything
about two groups is one row (cross probabilities c00..), so each rule is one expression in generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prob
from ..functions.draw import draw
from ..graph import BOOST, SEED, Graph
from ..lineage import cut
from . import match as matching
from .cascade import activation_probability, simulate

M = prob.MEMBERS
EDGE_RULES = ("SEPARATE_SIMPLE", "MERGED_SIMPLE", "SEPARATE_PRECISE", "MERGED_PRECISE")
SEED_RULES = ("IGNORED", "AVERAGE", "MAX", "BEST_SEED_INDEX")
BOOST_RULES = ("BEST_BOOSTED_INDEX", "AVERAGE", "MAX", "ALL")
HEURISTICS = ("UNIT", "COUNT", "P", "W", "SEED_P", "SEED_W")
WEIGHT_RULES = ("AVERAGE", "AVERAGE_BY_PATHS", "SUM")
EXPANDING = ("RANDOM", "LOCAL", "SIMULATIVE", "ITERATIVE")


@dataclass(frozen=True)
class CoarseningParams:
    prefer: str = matching.HEM
    undirect: str = matching.P_MAX
    edge_rule: str = "SEPARATE_PRECISE"
    seed_rule: str = "BEST_SEED_INDEX"
    boost_rule: str = "BEST_BOOSTED_INDEX"
    boosted_as: str = "AS_TARGET"
    heuristic: str = "P"
    weight_rule: str = "AVERAGE_BY_PATHS"
    max_distance_from_seed: int = 3
    salt: int | str = 1

    def __post_init__(self):
        for value, known in ((self.edge_rule, EDGE_RULES), (self.seed_rule, SEED_RULES), (self.boost_rule, BOOST_RULES), (self.heuristic, HEURISTICS), (self.weight_rule, WEIGHT_RULES), (self.boosted_as, ("AS_SOURCE", "AS_TARGET"))):
            if value not in known:
                raise ValueError(f"unknown rule {value}")


@dataclass(frozen=True)
class Level:
    """coarse: the coarsened graph; groups: (id, group_id, index_in_group); table: one row for each group."""

    fine: Graph
    coarse: Graph
    groups: DataFrame
    table: DataFrame
    seeds: DataFrame | None = None


def heuristics(g: Graph, groups: DataFrame, rule: str, seeds: DataFrame | None = None, rounds: int = 3) -> DataFrame:
    """(id, h_in, h_out, h_second): sums over neighbours outside the vertex's group: of p (P), p * weight (W) or 1 (COUNT,
    UNIT). h_second is the same over out-edges with p_seed, or over in-edges with p_boost. In the boost model seeds do
    not count as out-neighbours; SEED_P and SEED_W take activation probabilities as in-heuristics.
    """
    second = "p_seed" if g.model == SEED else "p_boost"
    plain = rule.removeprefix("SEED_")
    if plain != rule and g.model == SEED:
        raise ValueError("SEED_P and SEED_W need the boost model")
    value = lambda p: F.col(p) if plain == "P" else F.col(p) * F.col("weight") if plain == "W" else F.lit(1.0)
    of = lambda end: groups.select(F.col("id").alias(end), F.col("group_id").alias(f"g_{end}"))
    apart = g.edges.join(of("src"), "src").join(of("dst"), "dst").where("g_src <> g_dst").select("src", "dst", "p", second)
    weight = lambda end: g.vertices.select(F.col("id").alias(end), "weight")
    into = apart.join(weight("src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(value("p")).alias("h_in"), F.sum(value(second)).alias("h_in_second"))
    away = apart.join(weight("dst"), "dst")
    if seeds is not None and g.model == BOOST:
        away = away.join(seeds.select(F.col("id").alias("dst")), "dst", "left_anti")
    away = away.groupBy(F.col("src").alias("id")).agg(F.sum(value("p")).alias("h_out"), F.sum(value(second)).alias("h_out_second"))
    rows = g.vertices.select("id").join(into, "id", "left").join(away, "id", "left").na.fill(0.0)
    if plain != rule:
        reach = activation_probability(g, seeds, rounds)
        rows = rows.drop("h_in", "h_in_second").join(reach.select("id", F.col("p_in").alias("h_in"), F.col("p_in_boosted").alias("h_in_second")), "id")
    return rows.select("id", "h_in", "h_out", (F.col("h_out_second") if g.model == SEED else F.col("h_in_second")).alias("h_second"))


def group_table(g: Graph, groups: DataFrame, params: CoarseningParams, seeds: DataFrame | None = None) -> DataFrame:
    """One row for each group: size, m0.. (members), w0.., h_in0.., h_out0.., h_second0.., i01.. (inner p), s01.. (inner
    p_seed or p_boost), is_seed, best (index of the member to seed or to boost)."""
    second = "p_seed" if g.model == SEED else "p_boost"
    rows = groups.join(g.vertices, "id").join(heuristics(g, groups, params.heuristic, seeds, params.max_distance_from_seed), "id")
    if seeds is not None:
        rows = rows.join(seeds.select("id", F.lit(1).alias("seed")), "id", "left")
    at = lambda c, j: F.max(F.when(F.col("index_in_group") == j, F.col(c)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    table = rows.groupBy("group_id").agg(F.count("*").cast("int").alias("size"), *[at("id", j).alias(f"m{j}") for j in M], *[zero(at("weight", j)).alias(f"w{j}") for j in M], *[zero(at(f"h_{c}", j)).alias(f"h_{c}{j}") for c in ("in", "out", "second") for j in M], (F.coalesce(F.max("seed"), F.lit(0)) > 0 if seeds is not None else F.lit(False)).alias("is_seed"))
    of = lambda end: groups.select(F.col("id").alias(end), F.col("group_id").alias(f"g_{end}"), F.col("index_in_group").alias(f"j_{end}"))
    inside = g.edges.join(of("src"), "src").join(of("dst"), "dst").where("g_src = g_dst")
    pair = lambda c, a, b: zero(F.max(F.when((F.col("j_src") == a) & (F.col("j_dst") == b), F.col(c))))
    names = [f"{x}{a}{b}" for x in "is" for a in M for b in M if a != b]
    inner = inside.groupBy(F.col("g_src").alias("group_id")).agg(*[pair(c, a, b).alias(f"{x}{a}{b}") for x, c in (("i", "p"), ("s", second)) for a in M for b in M if a != b])
    table = table.join(inner, "group_id", "left").na.fill(0.0, names)
    return table.withColumn("best", F.expr(best_member(g.model, params.boosted_as)))


def best_member(model: str, boosted_as: str = "AS_TARGET") -> str:
    """Index of the member with the greatest estimated gain as SQL text over a group table."""
    gains = []
    for j in M:
        a, b = prob.others(j)
        delta = f"(h_second{j} - h_in{j})"
        if model == SEED:
            gains.append(f"h_second{j} + {prob.reach_within(j, a, 's')} * h_out{a} + {prob.reach_within(j, b, 's')} * h_out{b}")
        elif boosted_as == "AS_SOURCE":
            gains.append(f"{delta} * (h_out{j} + {prob.reach_within(j, a)} * h_out{a} + {prob.reach_within(j, b)} * h_out{b})")
        else:
            more = [f"h_in{x} * ({prob.any_of([f's{x}{j}', f'i{x}{y} * s{y}{j}'])} - {prob.reach_within(x, j)})" for x, y in ((a, b), (b, a))]
            gains.append(f"({delta} + {more[0]} + {more[1]}) * h_out{j}")
    return prob.first_best(gains, "size")


def coarse_weight(params: CoarseningParams, uniform_if_zero: bool = False) -> str:
    """Weight of a group as SQL text over a group table."""
    total = "(w0 + w1 + w2)"
    if params.weight_rule == "SUM":
        return total
    average = f"({total} / size)"
    if params.weight_rule == "AVERAGE":
        return average
    h = prob.normalised([f"h_in{j}" for j in M], params.heuristic == "UNIT")
    if uniform_if_zero:
        h = [f"coalesce({x}, case when size > {j} then 1e0 / size else 0e0 end)" for j, x in enumerate(h)]
    terms = []
    for k in M:
        a, b = prob.others(k)
        terms.append(f"w{k} * " + prob.any_of([h[k], f"{h[a]} * i{a}{k}", f"{h[a]} * i{a}{b} * i{b}{k}", f"{h[b]} * i{b}{k}", f"{h[b]} * i{b}{a} * i{a}{k}"]))
    return f"(case when size = 1 then w0 else coalesce({' + '.join(terms)}, {average}) end)"


def cross_table(g: Graph, groups: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(gu, gv, c00.., x00..): cross probabilities p and p_seed or p_boost of every two groups with an edge; in the boost
    model edges into seeds do not count."""
    second = "p_seed" if g.model == SEED else "p_boost"
    of = lambda end: groups.select(F.col("id").alias(end), F.col("group_id").alias(f"g_{end}"), F.col("index_in_group").alias(f"j_{end}"))
    rows = g.edges.join(of("src"), "src").join(of("dst"), "dst").where("g_src <> g_dst")
    if seeds is not None and g.model == BOOST:
        rows = rows.join(seeds.select(F.col("id").alias("dst")), "dst", "left_anti")
    pick = lambda c, j, i: F.coalesce(F.max(F.when((F.col("j_src") == j) & (F.col("j_dst") == i), F.col(c))), F.lit(0.0))
    return rows.groupBy(F.col("g_src").alias("gu"), F.col("g_dst").alias("gv")).agg(*[pick(c, j, i).alias(f"{x}{j}{i}") for x, c in (("c", "p"), ("x", second)) for j in M for i in M])


def in_heuristics(params: CoarseningParams) -> list[str]:
    """In-heuristics of the source group without what comes back from the target group, before normalising: SQL text over
    a row with the reverse pair's r00.. (null: no such pair) and the target's weights v0..."""
    rule, out = params.heuristic, []
    for j in M:
        back = {"P": [f"r{i}{j}" for i in M], "W": [f"r{i}{j} * v{i}" for i in M]}.get(rule, [f"(case when r{i}{j} < 1e-8 then 0e0 else 1e0 end)" for i in M])
        out.append(f"h_in{j} - coalesce({' + '.join(back)}, 0e0)")
    return out


def coarse_edges(g: Graph, groups: DataFrame, table: DataFrame, params: CoarseningParams, seeds: DataFrame | None = None) -> DataFrame:
    """(src, dst, p, p_seed or p_boost) between groups, for every pair with an edge in either direction."""
    cross = cut(cross_table(g, groups, seeds), "cross")
    every = cross.select("gu", "gv").union(cross.select("gv", "gu")).distinct()
    if seeds is not None and g.model == BOOST:
        every = every.join(table.where("is_seed").select(F.col("group_id").alias("gv")), "gv", "left_anti").select("gu", "gv")
    values = [f"{x}{j}{i}" for x in "cx" for j in M for i in M]
    rows = every.join(cross, ["gu", "gv"], "left").na.fill(0.0, values)
    rows = rows.join(cross.select(F.col("gv").alias("gu"), F.col("gu").alias("gv"), *[F.col(f"c{i}{j}").alias(f"r{i}{j}") for i in M for j in M]), ["gu", "gv"], "left")
    rows = rows.join(table.withColumnRenamed("group_id", "gu"), "gu")
    rows = rows.join(table.select(F.col("group_id").alias("gv"), F.col("size").alias("size_v"), F.col("best").alias("best_v"), *[F.col(f"w{j}").alias(f"v{j}") for j in M]), "gv")
    own = prob.normalised([f"h_in{j}" for j in M], params.heuristic == "UNIT")
    pair = prob.normalised(in_heuristics(params), params.heuristic == "UNIT")
    if g.model == BOOST:
        even = [f"coalesce({x}, case when size > {j} then 1e0 / size else 0e0 end)" for j, x in enumerate(own)]
        fixed = "true" if params.heuristic.startswith("SEED_") else "is_seed"
        pair = [f"(case when {fixed} then {e} else {p} end)" for e, p in zip(even, pair, strict=True)]
    rows = rows.withColumns({f"h{j}": F.expr(pair[j]) for j in M})

    def merged(cross_name: str) -> str:
        # a group that nothing enters passes nothing on; a single member needs no inner paths
        return f"(case when h0 is null then 0e0 when size = 1 then {prob.direct(0, cross_name)} else {prob.merged(params.edge_rule, cross_name)} end)"

    clamp = lambda c, low: F.least(F.greatest(c, low), F.lit(1.0))
    rows = rows.withColumn("p", clamp(F.expr(merged("c")), F.lit(0.0)))
    if g.model == SEED:
        by = [prob.simple_path(j, "x", "c", "s", "i") for j in M]
        if params.seed_rule == "IGNORED":
            second = "p"
        elif params.seed_rule == "AVERAGE":
            second = f"({' + '.join(f'case when size > {j} then {x} else 0e0 end' for j, x in enumerate(by))}) / size"
        elif params.seed_rule == "MAX":
            second = f"greatest({', '.join(f'case when size > {j} then {x} else 0e0 end' for j, x in enumerate(by))})"
        else:
            second = "case best " + " ".join(f"when {j} then {x}" for j, x in enumerate(by)) + " end"
        if params.seed_rule != "IGNORED":
            second = f"case when size = 1 then {prob.direct(0, 'x')} else {second} end"
        name = "p_seed"
    else:
        if params.boost_rule == "ALL":
            second = merged("x")
        else:
            for k in M:
                rows = rows.withColumns({f"b{k}{j}{i}": F.col(f"{'x' if i == k else 'c'}{j}{i}") for j in M for i in M})
            by = [merged(f"b{k}") for k in M]
            if params.boost_rule == "BEST_BOOSTED_INDEX":
                second = "case best_v " + " ".join(f"when {k} then {x}" for k, x in enumerate(by)) + " end"
            elif params.boost_rule == "AVERAGE":
                second = f"({' + '.join(f'case when size_v > {k} then {x} else 0e0 end' for k, x in enumerate(by))}) / size_v"
            else:
                second = f"greatest({', '.join(f'case when size_v > {k} then {x} else 0e0 end' for k, x in enumerate(by))})"
        name = "p_boost"
    return rows.withColumn(name, clamp(F.expr(second), F.col("p"))).select(F.col("gu").alias("src"), F.col("gv").alias("dst"), "p", name)


def coarsen_by_groups(g: Graph, groups: DataFrame, params: CoarseningParams = CoarseningParams(), seeds: DataFrame | None = None) -> Level:
    """``groups``: (id, group_id). In the boost model every seed must be alone in its group (else ValueError)."""
    groups = cut(matching.member_index(groups.select("id", "group_id")), "groups")
    if groups.where("index_in_group > 2").limit(1).count():
        raise ValueError("a group has more than three members")
    mapped = None
    if seeds is not None:
        held = groups.join(seeds.select("id"), "id", "left_semi").select("group_id").distinct()
        if groups.join(held, "group_id", "left_semi").where("index_in_group > 0").limit(1).count():
            raise ValueError("a seed shares its group")
        mapped = held.withColumnRenamed("group_id", "id")
    table = cut(group_table(g, groups, params, seeds), "groups")
    edges = cut(coarse_edges(g, groups, table, params, seeds), "coarse")
    vertices = cut(table.select(F.col("group_id").alias("id"), F.expr(coarse_weight(params, g.model == BOOST)).alias("weight")), "coarse")
    return Level(g, Graph(vertices, edges, g.model), groups, table, mapped)


def coarsen(g: Graph, params: CoarseningParams = CoarseningParams(), seeds: DataFrame | None = None) -> Level:
    """Merges directions, matches, and merges the groups."""
    und = matching.undirect(g.edges, params.undirect)
    return coarsen_by_groups(g, matching.match(g.vertices, und, seeds, params.prefer, params.salt), params, seeds)


def expand(level: Level, chosen: DataFrame, rule: str = "LOCAL", tries: int = 1000, iterations: int = 10, salt: int | str = 1) -> DataFrame:
    """(ord, id): one fine vertex for each chosen group (ord, id). LOCAL takes the member that the group's table names,
    RANDOM a drawn one; SIMULATIVE the member with the best spread of its own; ITERATIVE starts from LOCAL and keeps
    random single swaps that raise the spread. The boost model knows the first two alone (else ValueError)."""
    if rule not in EXPANDING:
        raise ValueError(f"unknown rule {rule}")
    if level.fine.model == BOOST and rule not in ("RANDOM", "LOCAL"):
        raise ValueError(f"{rule} needs the seed model")
    spark = chosen.sparkSession
    rows = cut(chosen.select("ord", F.col("id").alias("group_id")).join(level.table.select("group_id", "size", "best", "m0", "m1", "m2"), "group_id"), "expand")
    member = lambda k: F.when(k == 2, F.col("m2")).when(k == 1, F.col("m1")).otherwise(F.col("m0"))
    if rule == "RANDOM":
        return rows.select("ord", member(draw(salt, "group_id") % F.col("size")).alias("id"))
    local = rows.select("ord", member(F.col("best")).alias("id"))
    if rule == "LOCAL":
        return local
    options = {r.ord: [x for x in (r.m0, r.m1, r.m2) if x is not None] for r in rows.collect()}  # the chosen groups
    spread = lambda ids: simulate(level.fine, spark.createDataFrame([(int(i),) for i in ids], "id long"), tries, salt=salt)
    if rule == "SIMULATIVE":
        best = {o: ids[0] if len(ids) == 1 else max(ids, key=lambda i: (spread([i]), -i)) for o, ids in options.items()}
    else:
        best = {r.ord: r.id for r in local.collect()}
        value = spread(best.values()) if best else 0.0
        free = sorted(o for o, ids in options.items() if len(ids) > 1)
        drawn = spark.range(iterations).select(draw(f"{salt}i", "id").alias("a"), draw(f"{salt}j", "id").alias("b")).collect() if free else []
        for d in drawn:
            o = free[d.a % len(free)]
            rest = [i for i in options[o] if i != best[o]]
            tried = best | {o: rest[d.b % len(rest)]}
            new = spread(tried.values())
            if new > value:
                best, value = tried, new
    return spark.createDataFrame([(int(o), int(i)) for o, i in best.items()], "ord int, id long")
