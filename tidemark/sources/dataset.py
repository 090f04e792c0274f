"""Building weighted, probabilistic graphs from bare edges."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draw import uniform
from ..graph import BOOST, SEED, Graph
from ..lineage import cut
from ..operators.ordering import ranked


@dataclass(frozen=True)
class DatasetParams:
    model: str = SEED
    mu_min: float = 0.0
    mu_max: float = 1.0
    lambda_in: float = 1.0
    alpha: float = 1.0
    lambda_second: float = 1.0
    alpha_second: float = 1.0
    unweighted_ratio: float = 0.0
    penalized_ratio: float = 0.0
    penalize_factor: float = 1.0
    salt: int = 1

    def __post_init__(self):
        if self.model not in (SEED, BOOST):
            raise ValueError(f"unknown model {self.model}")
        if not 0 <= self.mu_min <= self.mu_max <= 1:
            raise ValueError("0 <= mu_min <= mu_max <= 1 does not hold")
        if min(self.lambda_in, self.lambda_second, self.alpha, self.alpha_second) < 0 or self.lambda_in == self.lambda_second == 0:
            raise ValueError("lambdas and alphas must not be negative, and not both lambdas 0")
        if not (0 <= self.unweighted_ratio <= 1 and 0 <= self.penalized_ratio <= 1 and self.penalize_factor > 0):
            raise ValueError("ratios must lie between 0 and 1, and the penalty factor above 0")

    @classmethod
    def from_json(cls, text: str) -> DatasetParams:
        values = json.loads(text)
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        return cls(**values)


def vertex_table(g: Graph, params: DatasetParams) -> DataFrame:
    """(id, in_degree, out_degree, degree, weight, penalized). In ascending order of (degree, id), the first
    floor((1 - unweighted_ratio) n) vertices get a weight of 1 + Geometric(degree / M), where M is the greatest degree
    among them and vertices of degree M or 0 keep 1; the last floor(penalized_ratio n) are hubs to penalize.
    """
    rows = ranked(g.degrees(), [F.col("degree"), F.col("id")], "rank")
    n = rows.count()
    weighted = int((1 - params.unweighted_ratio) * n)
    hubs = int(params.penalized_ratio * n)
    top = rows.where(F.col("rank") <= weighted).agg(F.max("degree")).first()[0] or 0
    share = F.col("degree") / F.lit(float(max(top, 1)))
    geometric = F.floor(F.log(1 - uniform(params.salt, "id")) / F.log(1 - share))
    weight = F.when((F.col("rank") <= weighted) & (F.col("degree") < top) & (F.col("degree") > 0), 1.0 + geometric).otherwise(F.lit(1.0))
    return rows.select("id", "in_degree", "out_degree", "degree", weight.alias("weight"), (F.col("rank") > n - hubs).alias("penalized"))


def edge_model(in_degree: Column, out_degree: Column, penalized: Column, params: DatasetParams) -> tuple[Column, Column]:
    """p and p_seed or p_boost of an edge, from the in-degree of its target and the out-degree of its source."""
    factor = F.when(penalized, F.lit(float(params.penalize_factor))).otherwise(F.lit(1.0))
    clamp = lambda x: F.least(F.greatest(x, F.lit(float(params.mu_min))), F.lit(float(params.mu_max)))
    base = F.lit(float(params.lambda_in)) / in_degree / factor
    first, second = clamp(base), clamp(base + F.lit(float(params.lambda_second)) / out_degree / factor)
    power = lambda x, a: 1 - F.pow(1 - x, F.lit(float(a))) if a != 1 else x
    return power(first, params.alpha), power(second, params.alpha_second)


def create_dataset(edges: DataFrame, params: DatasetParams) -> Graph:
    """A graph of the given model from (src, dst). Its tables are written, so that loops do not derive them anew each round."""
    bare = Graph.of(cut(edges.select("src", "dst").dropDuplicates(["src", "dst"]), "dataset"))
    table = cut(vertex_table(bare, params), "dataset")
    rows = bare.edges.join(table.select(F.col("id").alias("dst"), "in_degree"), "dst").join(table.select(F.col("id").alias("src"), "out_degree", "penalized"), "src")
    p, second = edge_model(F.col("in_degree"), F.col("out_degree"), F.col("penalized"), params)
    name = "p_seed" if params.model == SEED else "p_boost"
    second = F.greatest(second, p) if params.model == BOOST else second
    return Graph(table.select("id", "weight"), cut(rows.select("src", "dst", p.alias("p"), second.alias(name)), "dataset"), params.model)


def create_dataset_from_json(edges: DataFrame, text: str) -> Graph:
    return create_dataset(edges, DatasetParams.from_json(text))
