"""Matching: groups of one to three vertices that coarsening merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draw import draw
from ..lineage import cut, is_empty
from .ordering import ranked

HEM, LEM = "HEM", "LEM"  # the heaviest or the lightest edge first
P_MAX, P_PRODUCT = "P_MAX", "P_PRODUCT"


def undirect(edges: DataFrame, rule: str = P_MAX) -> DataFrame:
    """(u, v, p) with u < v: two directions become the greater p, or the probability that one of them fires."""
    rows = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "p").groupBy("u", "v")
    if rule == P_MAX:
        return rows.agg(F.max("p").alias("p"))
    if rule == P_PRODUCT:
        return rows.agg((1 - F.product(1 - F.col("p"))).alias("p"))
    raise ValueError(f"unknown rule {rule}")


def _both(und: DataFrame) -> DataFrame:
    return und.select(F.col("u").alias("id"), F.col("v").alias("other"), "p").union(und.select("v", "u", "p"))


def matched_pairs(und: DataFrame, prefer: str = HEM, salt: int | str = 1) -> DataFrame:
    """(id, other) for both ends: in rounds, each free vertex points at its best free neighbour by (p, keyed hash of the
    pair), and two that point at each other are matched, until no two free vertices are neighbours."""
    best = F.when(F.lit(prefer == HEM), F.col("p")).otherwise(-F.col("p"))
    tie = draw(salt, F.least("id", "other"), F.greatest("id", "other"))
    free = cut(_both(und).select("id", "other", best.alias("best"), tie.alias("tie")), "match")
    done = None
    while not is_empty(free):
        point = free.groupBy("id").agg(F.max_by("other", F.struct("best", "tie", F.least("id", "other"), F.greatest("id", "other"))).alias("other"))
        point = cut(point, "match")
        new = cut(point.join(point.select(F.col("other").alias("id"), F.col("id").alias("other")), ["id", "other"]).select("id", "other"), "match")
        done = new if done is None else done.union(new)
        used = new.select("id")
        free = cut(free.join(used, "id", "left_anti").join(used.withColumnRenamed("id", "other"), "other", "left_anti").select("id", "other", "best", "tie"), "match")
    return done if done is not None else und.select(F.col("u").alias("id"), F.col("v").alias("other")).limit(0)


def match(vertices: DataFrame, und: DataFrame, seeds: DataFrame | None = None, prefer: str = HEM, salt: int | str = 1) -> DataFrame:
    """(id, group_id): groups of 1 to 3, numbered by their least member; seeds stay alone.

    Matched pairs come first. A vertex left over takes its best neighbour, which is matched, as pivot; two and two such
    brothers of a pivot make pairs; the odd one out is adopted. Where both ends of a pair would adopt, each goes with
    its own.
    """
    seeds = vertices.select("id").limit(0) if seeds is None else seeds.select("id").distinct()
    open_ = und.join(seeds.withColumnRenamed("id", "u"), "u", "left_anti").join(seeds.withColumnRenamed("id", "v"), "v", "left_anti")
    open_ = cut(open_.select("u", "v", "p"), "match")
    pairs = cut(matched_pairs(open_, prefer, salt), "match")
    single = vertices.select("id").join(pairs, "id", "left_anti").join(seeds, "id", "left_anti")
    best = F.when(F.lit(prefer == HEM), F.col("p")).otherwise(-F.col("p"))
    pivot = _both(open_).join(single, "id", "left_semi").groupBy("id").agg(F.max_by("other", F.struct(best, -F.col("other"))).alias("pivot"))
    w = Window.partitionBy("pivot").orderBy("id")
    brothers = cut(pivot.withColumn("k", F.row_number().over(w)).withColumn("last", F.count("*").over(Window.partitionBy("pivot"))), "match")
    paired = brothers.where("k % 2 = 1 and k < last").select(F.col("id").alias("a"), "pivot", (F.col("k") + 1).alias("k")).join(brothers.select(F.col("id").alias("b"), "pivot", "k"), ["pivot", "k"]).select("a", "b")
    odd = brothers.where("k % 2 = 1 and k = last").select(F.col("id").alias("child"), "pivot")
    # a pair (x, y): x may have adopted c, y may have adopted d
    couples = pairs.where("id < other").join(odd.select(F.col("pivot").alias("id"), F.col("child").alias("c")), "id", "left").join(odd.select(F.col("pivot").alias("other"), F.col("child").alias("d")), "other", "left")
    split = F.col("c").isNotNull() & F.col("d").isNotNull()
    members = couples.select(F.explode(F.when(split, F.array(F.array("id", "c"), F.array("other", "d"))).otherwise(F.array(F.array_compact(F.array("id", "other", "c", "d"))))).alias("g"))
    groups = members.union(paired.select(F.array("a", "b")))
    grouped = groups.select(F.explode("g").alias("id"), F.array_min("g").alias("least"))
    rows = vertices.select("id").join(grouped, "id", "left").select("id", F.coalesce("least", "id").alias("least"))
    return number_groups(rows, "least")


def number_groups(rows: DataFrame, key: str) -> DataFrame:
    """(id, group_id) with groups numbered 0, 1, ... in the order of ``key``."""
    rows = cut(rows, "groups")
    names = ranked(rows.select(key).distinct(), [F.col(key)], "n").select(key, (F.col("n") - 1).alias("group_id"))
    return cut(rows.join(names, key).select("id", "group_id"), "groups")


def member_index(groups: DataFrame) -> DataFrame:
    """Adds index_in_group, 0 to 2 by ascending id."""
    return groups.withColumn("index_in_group", F.row_number().over(Window.partitionBy("group_id").orderBy("id")) - 1)
