"""Experiments: seeds for several sketch counts, simulation of prefixes, coarsening level by level, baselines."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draw import draw
from ..graph import BOOST, SEED, Graph
from ..lineage import cut
from ..operators import boost, cascade, coarsen, components, rank, sketch


def _counts(name: str, values) -> tuple[int, ...]:
    out = tuple(sorted(set(int(v) for v in values)))
    if not out or out[0] <= 0:
        raise ValueError(f"{name} must hold positive numbers")
    return out


@dataclass(frozen=True)
class Params:
    n_sketches: tuple[int, ...] = (1000,)
    n_chosen: tuple[int, ...] = (10,)
    tries: int = 10_000
    k_boost: int = 4
    n_seeds: int = 10
    candidate_ratio: float = 0.1
    max_n_wcc: int = 1
    max_tries: int = 10_000
    coarsening_threshold: int = 1000
    skips_first_level: bool = False
    n_fast_expanding_levels: int = 0
    coarsening: dict = field(default_factory=dict)
    expanding_rule: str = "LOCAL"
    expanding_tries: int = 1000
    expanding_iterations: int = 10
    algorithms: tuple[str, ...] = ("max_degree", "max_strength", "pagerank", "imrank", "rr_sketch", "robust_scc")
    coarsening_level: int = 0
    robust_r: int = 16
    salt: int = 1

    def __post_init__(self):
        object.__setattr__(self, "n_sketches", _counts("n_sketches", self.n_sketches))
        object.__setattr__(self, "n_chosen", _counts("n_chosen", self.n_chosen))
        if self.tries <= 0 or not 0 < self.candidate_ratio <= 1 or self.coarsening_threshold < 1:
            raise ValueError("tries, candidate_ratio or coarsening_threshold is out of range")

    @classmethod
    def of(cls, config: str | None = None, **overrides) -> Params:
        """From a JSON text; keyword arguments come on top."""
        values = (json.loads(config) if config else {}) | {k: v for k, v in overrides.items() if v is not None}
        unknown = set(values) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def _timed(f: Callable):
    began = time.monotonic()
    out = f()
    return out, round(time.monotonic() - began, 3)


def _list(chosen: DataFrame) -> list[int]:
    """The chosen vertices in their order; there are at most max(n_chosen)."""
    return [r.id for r in chosen.orderBy("ord").collect()]


def _frame(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(ids)], "ord int, id long")


def seed_candidates(g: Graph, ratio: float) -> DataFrame:
    """The floor(n * ratio) vertices of the greatest out-strength."""
    return rank.max_out_strength(g, max(1, int(g.n() * ratio)))


def generate_seeds(g: Graph, p: Params) -> list[int]:
    """Seeds of a boost experiment: samples of the candidates, until the graph without them has few enough components."""
    candidates = cut(seed_candidates(g, p.candidate_ratio).select("id"), "candidates")
    if candidates.count() < p.n_seeds:
        raise ValueError("there are fewer candidates than seeds")
    for i in range(p.max_tries):
        sample = candidates.orderBy(draw(f"{p.salt}g{i}", "id"), "id").limit(p.n_seeds)
        ids = sorted(r.id for r in sample.collect())  # n_seeds rows
        if components.n_wcc(g, _frame(g.edges.sparkSession, ids)) <= p.max_n_wcc:
            return ids
    raise ValueError(f"no sample in {p.max_tries} leaves at most {p.max_n_wcc} components")


def seeds_by_count(g: Graph, p: Params) -> list[dict]:
    """Seeds for each sketch count; sketches of a greater count are those of the lesser one and more."""
    out, members, have = [], None, 0
    for n in p.n_sketches:
        members, spent = _timed(lambda n=n, members=members, have=have: cut(sketch.append(g, members, have, n, p.salt), "members"))
        have = n
        stats = sketch.sketch_stats(members).first().asDict()
        chosen, selecting = _timed(lambda members=members: _list(sketch.select(members, p.n_chosen[-1], g.vertices)))
        out.append({"n_sketches": n, "selected": chosen, "sketching_seconds": spent, "selecting_seconds": selecting, **stats})
    return out


def boosted_by_count(g: Graph, seeds: list[int], p: Params) -> list[dict]:
    """Vertices to boost for each number of attempts, by both ways of selecting."""
    out, s = [], _frame(g.edges.sparkSession, seeds)
    for n in p.n_sketches:
        made, spent = _timed(lambda n=n: boost.boost_sketches(g, s, n, p.k_boost, salt=p.salt))
        chosen, a = _timed(lambda made=made: _list(boost.select(made, p.n_chosen[-1], g.vertices)))
        critical, b = _timed(lambda made=made: _list(boost.select_critical(made, p.n_chosen[-1], g.vertices)))
        out.append({"n_attempts": n, "success_rate": made.success_rate(), "selected": chosen, "selected_by_critical": critical, "sketching_seconds": spent, "selecting_seconds": a, "selecting_by_critical_seconds": b})
    return out


def prefixes(g: Graph, chosen: list[int], p: Params, seeds: list[int] | None = None, base: float | None = None) -> list[dict]:
    """The objective for the first k of ``chosen``, for each k: the spread of seeds, or what boosting adds to ``base``."""
    spark, out = g.edges.sparkSession, []
    for k in p.n_chosen:
        some = _frame(spark, chosen[:k])
        if seeds is None:
            value, spent = _timed(lambda some=some: cascade.simulate(g, some, p.tries, salt=p.salt))
        else:
            base = boost_base(g, seeds, p) if base is None else base
            value, spent = _timed(lambda some=some, base=base: cascade.simulate(g, _frame(spark, seeds), p.tries, some, salt=p.salt) - base)
        out.append({"n": min(k, len(chosen)), "objective": value, "seconds": spent})
    return out


def boost_base(g: Graph, seeds: list[int], p: Params) -> float:
    return cascade.simulate(g, _frame(g.edges.sparkSession, seeds), p.tries, salt=p.salt)


def levels(g: Graph, p: Params, seeds: list[int] | None = None, most: int | None = None) -> list[coarsen.Level]:
    """Coarsened until at most ``coarsening_threshold`` vertices are left, or ``most`` times; seeds follow every level.
    Empty if the graph is small enough already."""
    out: list[coarsen.Level] = []
    at, n = g, g.n()
    here = _frame(g.edges.sparkSession, seeds) if seeds is not None else None
    while n > p.coarsening_threshold and (most is None or len(out) < most):
        level = coarsen.coarsen(at, coarsen.CoarseningParams(**(p.coarsening | {"salt": f"{p.salt}l{len(out)}"})), here)
        smaller = level.coarse.n()
        if smaller == n:
            break
        out.append(level)
        at, n, here = level.coarse, smaller, level.seeds
    return out


def expanded(stack: list[coarsen.Level], chosen: list[int], p: Params) -> list[int]:
    """Chosen groups of the last level as vertices of the first graph. LOCAL serves the fast levels nearest to it."""
    if not chosen:
        return []
    rows = _frame(stack[0].fine.edges.sparkSession, chosen)
    for i in range(len(stack) - 1, -1, -1):
        rule = "LOCAL" if i < p.n_fast_expanding_levels else p.expanding_rule
        rows = cut(coarsen.expand(stack[i], rows, rule, p.expanding_tries, p.expanding_iterations, f"{p.salt}e{i}"), "expanded")
    return _list(rows)


def graph_info(g: Graph) -> dict:
    return {"n": g.n(), "m": g.m()}


def connectivity_info(g: Graph) -> dict:
    return {"n_wcc": components.n_wcc(g), "n_scc": components.n_scc(g)}


def chosen_info(g: Graph, chosen: list[int]) -> list[dict]:
    """Degrees of the chosen vertices, in their order."""
    rows = _frame(g.edges.sparkSession, chosen).join(g.degrees(), "id").orderBy("ord")
    return [{"id": r.id, "in_degree": r.in_degree, "out_degree": r.out_degree} for r in rows.collect()]


def run_wim(g: Graph, p: Params) -> dict:
    found = seeds_by_count(g, p)
    for f in found:
        f["simulated"] = prefixes(g, f["selected"], p)
    return {"graph": graph_info(g), "sketching": found}


def run_wbim(g: Graph, p: Params, seeds: list[int] | None = None) -> dict:
    seeds = generate_seeds(g, p) if seeds is None else seeds
    base = boost_base(g, seeds, p)
    found = boosted_by_count(g, seeds, p)
    for f in found:
        f["simulated"] = prefixes(g, f["selected"], p, seeds, base)
        f["simulated_by_critical"] = prefixes(g, f["selected_by_critical"], p, seeds, base)
    return {"graph": graph_info(g), "seeds": seeds, "base": base, "sketching": found}


def _run_coarsening(g: Graph, p: Params, seeds: list[int] | None) -> dict:
    if g.n() <= p.coarsening_threshold:
        raise ValueError("the graph is no larger than the coarsening threshold")
    base = None if seeds is None else boost_base(g, seeds, p)
    out = []
    if not p.skips_first_level:
        out.append({"level": 0, **(run_wim(g, p) if seeds is None else run_wbim(g, p, seeds)), "connectivity": connectivity_info(g)})
    stack, spent = _timed(lambda: levels(g, p, seeds))
    for i in range(len(stack)):
        coarse = stack[i].coarse
        found = seeds_by_count(coarse, p) if seeds is None else boosted_by_count(coarse, [r.id for r in stack[i].seeds.orderBy("id").collect()], p)
        for f in found:
            for name in ("selected", "selected_by_critical"):
                if name in f:
                    f[f"{name}_expanded"], f[f"{name}_expanding_seconds"] = _timed(lambda f=f, name=name, i=i: expanded(stack[: i + 1], f[name], p))
                    f[f"{name}_simulated"] = prefixes(g, f[f"{name}_expanded"], p, seeds, base)
        out.append({"level": i + 1, "graph": graph_info(coarse), "sketching": found})
    return {"levels": out, "coarsening_seconds": spent, "seeds": seeds}


def run_wim_coarsening(g: Graph, p: Params) -> dict:
    return _run_coarsening(g, p, None)


def run_wbim_coarsening(g: Graph, p: Params, seeds: list[int] | None = None) -> dict:
    return _run_coarsening(g, p, generate_seeds(g, p) if seeds is None else seeds)


def run_contrast(g: Graph, p: Params) -> dict:
    """Each baseline on the graph, or on its coarsened form, and the spread of what it chooses."""
    stack = levels(g, p, most=p.coarsening_level) if p.coarsening_level else []
    at, k = (stack[-1].coarse if stack else g), p.n_chosen[-1]
    ways = {
        "max_degree": lambda: [rank.max_out_degree(at, k)],
        "max_strength": lambda: [rank.max_out_strength(at, k)],
        "pagerank": lambda: [rank.pagerank_topk(at, k, rank.PageRankParams(transpose=True, iterations=100))],
        "imrank": lambda: [rank.imrank(at, k)],
        "rr_sketch": lambda: [_frame(g.edges.sparkSession, f["selected"]) for f in seeds_by_count(at, p)],
        "robust_scc": lambda: [rank.robust_scc(at, k, p.robust_r, n, p.salt) for n in p.n_sketches],
    }
    out = {}
    for name in p.algorithms:
        if name not in ways:
            raise ValueError(f"unknown algorithm {name}")
        lists, spent = _timed(lambda name=name: [_list(c) for c in ways[name]()])
        out[name] = {"seconds": spent, "lists": []}
        for chosen in lists:
            fine = expanded(stack, chosen, p) if stack else chosen
            out[name]["lists"].append({"selected": fine, "simulated": prefixes(g, fine, p)})
    return {"graph": graph_info(g), "algorithms": out}


RUNS = {"wim": (SEED, run_wim), "wbim": (BOOST, run_wbim), "wim-coarsening": (SEED, run_wim_coarsening), "wbim-coarsening": (BOOST, run_wbim_coarsening), "wim-contrast": (SEED, run_contrast)}


def to_json(result: dict, params: Params) -> str:
    return json.dumps({"params": asdict(params), "result": result}, indent=2)
