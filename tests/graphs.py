"""Sample graphs with known results."""

from tidemark.graph import BOOST, SEED, Graph

A = "0,1,.30 1,2,.31 3,4,.32 4,5,.33 6,7,.34 7,8,.35 0,3,.41 3,6,.44 1,4,.42 4,7,.45 2,5,.43 5,8,.46 4,1,.20 7,4,.21 4,3,.22 5,4,.23 9,0,.40 9,3,.30 9,6,.20 2,0,.10 8,6,.11"
A_LEFT = "0,1,.30 2,3,.32 4,5,.34 0,2,.41 2,4,.44 6,0,.45045045 6,2,.27027027 6,4,.27927927"
C = "1,0,.20 2,0,.21 3,0,.22 4,2,.25 5,2,.26 6,2,.27 7,3,.28 9,3,.29 8,5,.30 10,9,.31 13,9,.32 14,13,.35 11,13,.36 12,11,.37 15,13,.40 16,15,.41 17,1,.90"


def graph(spark, text, model=SEED, weights=None):
    rows = [(int(a), int(b), float(p), min(1.0, 2 * float(p))) for a, b, p in (x.split(",") for x in text.split())]
    edges = spark.createDataFrame(rows, f"src long, dst long, p double, {'p_seed' if model == SEED else 'p_boost'} double")
    w = spark.createDataFrame([(i, float(x)) for i, x in enumerate(weights)], "id long, weight double") if weights else None
    return Graph.of(edges, model, w)


def plain(spark, text, extra=()):
    """Edges "01 12", and further vertices."""
    edges = spark.createDataFrame([(int(x[0]), int(x[1])) for x in text.split()], "src long, dst long")
    return Graph.of(edges, vertices=spark.createDataFrame([(i,) for i in extra], "id long") if extra else None)


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


__all__ = ["A", "A_LEFT", "BOOST", "C", "SEED", "graph", "ids", "plain"]
