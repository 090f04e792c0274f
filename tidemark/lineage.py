"""Cutting lineage with tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: a loop's plan stays short, and a lost executor costs
    a read. A folder of this process stands in where the setting is unset, as in tests."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str = "step", where: str | None = None) -> tuple[DataFrame, int]:
    """``cut``, and how many rows were written (for which ``where`` holds); the job that writes counts them."""
    seen = Observation()
    n = F.count(F.lit(1)) if where is None else F.count(F.when(F.expr(where), 1))
    out = cut(df.observe(seen, n.alias("n")), name)
    return out, seen.get["n"]


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0
