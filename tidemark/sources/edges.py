"""Edge lists: text, MatrixMarket, and graphs that the driver's tables imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordering import ranked


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines in the order of the file; numbers grow but can leave gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")


def pairs(lines: DataFrame, skip: int = 0) -> DataFrame:
    """(line, u, v) of numbered lines "u v": the first ``skip`` lines and loops go."""
    if skip:
        lines = lines.join(F.broadcast(lines.orderBy("line").limit(skip).select("line")), "line", "left_anti")
    part = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select("line", part[0].try_cast("long").alias("u"), part[1].try_cast("long").alias("v")).where("u <> v")


def directed_flag(rows: DataFrame) -> DataFrame:
    """(directed): one row, whether pairs (u, v) both ascend and descend."""
    return rows.agg((F.bool_or(F.col("u") < F.col("v")) & F.bool_or(F.col("u") > F.col("v"))).alias("directed"))


def directed(rows: DataFrame, given: bool | None = None) -> bool:
    """Whether a list of pairs (u, v) is directed: not if all ascend or all descend, unless that is given."""
    if given is not None:
        return given
    return bool(directed_flag(rows).first().directed)


def renumbered(rows: DataFrame) -> DataFrame:
    """Distinct (u, v) with ids 1, 2, ... by first appearance; of a line's two, u comes first."""
    seen = rows.select(F.col("u").alias("id"), (F.col("line") * 2).alias("at")).union(rows.select("v", F.col("line") * 2 + 1)).groupBy("id").agg(F.min("at").alias("at"))
    number = ranked(seen, [F.col("at")], "number").select("id", "number")
    out = rows.join(number.select(F.col("id").alias("u"), F.col("number").alias("a")), "u").join(number.select(F.col("id").alias("v"), F.col("number").alias("b")), "v")
    return out.select(F.col("a").alias("u"), F.col("b").alias("v")).dropDuplicates(["u", "v"])


def text_to_matrix_market(spark: SparkSession, source: str, target: str, skip: int = 0, is_directed: bool | None = None) -> None:
    """A text edge list as a MatrixMarket folder: part files that follow each other in the order of their names."""
    rows = pairs(numbered_lines(spark, source), skip)
    kind = "general" if directed(rows, is_directed) else "symmetric"
    edges = renumbered(rows)
    n, m = edges.agg(F.max(F.greatest("u", "v")), F.count("*")).first()
    head = spark.createDataFrame([(0, 0, f"%%MatrixMarket matrix coordinate pattern {kind}"), (0, 1, f"{n or 0} {n or 0} {m}")], "u long, v long, value string")
    body = edges.select("u", "v", F.concat_ws(" ", "u", "v").alias("value"))
    head.union(body).orderBy("u", "v").select("value").write.mode("overwrite").text(target)


def read_matrix_market(spark: SparkSession, path: str, mirror: bool = False) -> DataFrame:
    """(src, dst) with ids from 0, without loops; a symmetric file's edges go one way unless ``mirror``."""
    lines = numbered_lines(spark, path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = lines.orderBy("line").limit(1).select("line")
    part = F.split(F.trim("value"), r"\s+")
    edges = lines.join(F.broadcast(size), "line", "left_anti").select((part[0].try_cast("long") - 1).alias("src"), (part[1].try_cast("long") - 1).alias("dst")).where("src <> dst")
    if mirror:
        edges = edges.union(edges.select(F.col("dst"), F.col("src")))
    return edges.dropDuplicates(["src", "dst"])


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return rows.where("dst is not null and src <> dst").distinct()


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events follow each other on one day, in the order of time and id."""
    w = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"))
    return rows.where("dst is not null and src <> dst").distinct()


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a customer's nation to the nations of the suppliers of its orders."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    pairs_ = read("lineitem").select("l_orderkey", "l_suppkey").join(read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    named = pairs_.join(read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return named.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).where("src <> dst").distinct()
