"""Graphs as DataFrames: vertices (id, weight) and edges (src, dst, p and p_seed or p_boost)."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED, BOOST, PLAIN = "seed", "boost", "plain"
SECOND = {SEED: "p_seed", BOOST: "p_boost", PLAIN: None}


@dataclass(frozen=True)
class Graph:
    """model: ``seed`` (a seed's edges fire with p_seed), ``boost`` (edges to a boosted vertex fire with p_boost) or
    ``plain`` (p alone)."""

    vertices: DataFrame
    edges: DataFrame
    model: str = PLAIN

    @staticmethod
    def of(edges: DataFrame, model: str = PLAIN, weights: DataFrame | None = None, vertices: DataFrame | None = None) -> Graph:
        """Vertices are the ends of edges and the ids of ``weights`` and ``vertices``; a missing weight is 1."""
        second = SECOND[model]
        edges = edges.where("src <> dst").select(F.col("src").cast("long"), F.col("dst").cast("long"), *[F.col(c).cast("double") for c in (["p"] if "p" in edges.columns else []) + ([second] if second else [])])
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
        for more in (weights, vertices):
            if more is not None:
                ids = ids.union(more.select(F.col("id").cast("long")))
        ids = ids.distinct()
        if weights is not None:
            ids = ids.join(weights.select(F.col("id").cast("long"), F.col("weight").cast("double")), "id", "left")
            return Graph(ids.select("id", F.coalesce("weight", F.lit(1.0)).alias("weight")), edges, model)
        return Graph(ids.withColumn("weight", F.lit(1.0)), edges, model)

    def n(self) -> int:
        return self.vertices.count()

    def m(self) -> int:
        return self.edges.count()

    def degrees(self) -> DataFrame:
        """(id, in_degree, out_degree, degree), of all vertices; both directions are counted before they are joined."""
        ends = self.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(self.edges.select("dst", F.lit(0), F.lit(1)))
        rows = ends.union(self.vertices.select("id", F.lit(0), F.lit(0))).groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
        return rows.withColumn("degree", F.col("in_degree") + F.col("out_degree"))

    def validate(self) -> Graph:
        """Raises ValueError for probabilities out of range or repeated edges."""
        second = SECOND[self.model]
        if "p" in self.edges.columns:
            bad = (F.col("p") < 0) | (F.col("p") > 1) | F.col("p").isNull()
            if second:
                bad |= (F.col(second) < 0) | (F.col(second) > 1) | F.col(second).isNull()
            if self.model == BOOST:
                bad |= F.col("p_boost") < F.col("p")
            if self.edges.where(bad).limit(1).count():
                raise ValueError(f"an edge of the {self.model} model has a probability out of range")
        if self.edges.groupBy("src", "dst").count().where("count > 1").limit(1).count():
            raise ValueError("an edge occurs twice")
        return self

    def reversed(self) -> Graph:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest), self.model)

    def write(self, path: str) -> None:
        """Parquet tables ``vertices`` and ``edges``, and the model in ``model``."""
        self.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        self.vertices.sparkSession.createDataFrame([(json.dumps({"model": self.model}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")

    @staticmethod
    def read(spark: SparkSession, path: str, model: str | None = None) -> Graph:
        """Raises ValueError if the stored model is another than the one asked for, or a column is missing."""
        stored = json.loads(spark.read.text(f"{path}/model").first().value)["model"]
        if model and model != stored:
            raise ValueError(f"{path} holds a {stored} graph, not a {model} graph")
        vertices, edges = spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")
        need = {"src", "dst", *filter(None, [SECOND[stored]])} - set(edges.columns)
        if need:
            raise ValueError(f"{path} has no column {', '.join(sorted(need))}")
        return Graph(vertices, edges, stored)
