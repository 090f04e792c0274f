"""A pipeline over ``documents``: language, repeated lines, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents. Before each, executors give back the memory that the one before left free.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import _common as C
from tidemark.llm import langid, line_dedup, ngram_join, packing, suffix_dedup

ORACLE_SQL = None


def _alone(stage):
    """``stage``, begun on executors whose heaps do not keep the size that earlier stages took."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        C.shrink_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run


@_alone
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects: those without a letter (null and empty texts too), and those far
    from any language. Each row is judged by itself; rows with a null doc_id are, too, but no model learns from them."""
    model = langid.train(docs, ~langid.held_out(4, 2))
    names = tuple(C.free(docs.columns, "lang_pred", "score", "rejected"))
    return langid.predict(docs, model, names=names).where(~F.col(names[2])).select(*_own(docs))


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _recounted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars of the new texts if there is such a column."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*_own(docs))


@_alone
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that match an earlier one, and documents of which only blanks are left by that. Rows with a null
    doc_id or text stay as they are; rows that share a doc_id lose the same places."""
    (gone,) = C.free(docs.columns, "gone_lines")
    out = line_dedup.dedup_lines(docs, "stage2", gone)
    return _recounted(out.where(f"{gone} = 0 or trim(text) <> ''"), docs)


@_alone
def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near duplicates. Of rows that share that id, equal texts
    stay once and different texts all stay. Rows with a null doc_id stay."""
    found = ngram_join.near_duplicates(docs, "stage3")
    key, place = C.free(docs.columns, "of_doc", "place")
    first = found.where("component_id = doc_id").select(F.col("doc_id").alias(key)).distinct()
    one = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text"), "text").orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]))
    kept = docs.join(first, docs.doc_id.cast("long") == F.col(key), "left_semi").withColumn(place, one).where(F.col(place) == 1).select(*_own(docs))
    return kept.unionByName(docs.where("doc_id is null"))


#: Bytes of a passage of 50 words, about, and less than any such passage of the tables.
PASSAGE = 240


@_alone
def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops passages of PASSAGE bytes or more that stand in two places, and documents of which only blanks are left by
    that. Null and empty texts stay; equal texts of that length go altogether, whatever their doc_ids."""
    removed, kept, rest = C.free(docs.columns, "gone_bytes", "kept_text", "rest")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select("doc_id", "text", F.struct(F.lit(0), *(F.col(f"`{c}`") for c in others)).alias(rest))
    out = suffix_dedup.remove_repeats(plain, "stage4", as_text=True, width=PASSAGE)
    out = out.select(*((F.col(f"{rest}.`{c}`") if c in others else F.col(c)).alias(c) for c in docs.columns), F.col("n_removed").alias(removed), F.col("kept").alias(kept))
    out = out.where((F.col(removed) == 0) | (F.trim(kept) != "")).withColumn("text", F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text")))
    return _recounted(out, docs)


@_alone
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; a null text has the end id alone, repeated rows are packed as often as they
    occur, and other columns are not read."""
    return packing.packed(docs, "stage5").drop("crosses")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder."""
    ws = C.Workspace(spark, "pipeline")
    docs = C.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), name)
        if i:
            ws.drop(STAGES[i - 1][0])
    return docs
