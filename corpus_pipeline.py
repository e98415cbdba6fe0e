"""The corpus pipeline: quality rules, near duplicates, repeated passages, source mix, pieces.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.  All but the last
return the columns of `docs`.  Columns other than doc_id, text, source and n_chars pass through untouched,
whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm import chunks, minhash, mixing, pieces, quality
from plumbline.llm.common import table, word_count
from plumbline.llm.queries import piece_model
from plumbline.session import shared_dir

OWN = ("doc_id", "text", "source")
#: Stands for a null id where rows are matched.
NO_ID = -(2**63)


def _veiled(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with its other columns under neutral names, and the way back to the columns it had."""
    names = {c: c if c in OWN else f"_c{i}" for i, c in enumerate(docs.columns)}
    veiled = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return veiled, lambda done: done.select(*[F.col(n).alias(c) for c, n in names.items()])


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the language score; null and empty texts fail."""
    rows, back = _veiled(docs)
    model = quality.fit(rows, table(spark, sf_dir, "labels"))
    return back(quality.judge(rows, model).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8): the one of the smallest id.

    Rows that repeat id and text are one document.  Documents without words have no group and stay, once per
    id; of a group without ids the one with the smallest hash stays.
    """
    rows, back = _veiled(docs)
    found = minhash.near_duplicates(rows.select("doc_id", "text"), shingle=5, percent=80)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    first = found.where("group is not null").groupBy("group").agg(F.min(place).alias("p")).select("p.doc_id", "p.tie")
    alone = found.where("group is null").select("doc_id", "tie").distinct()
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_key")
    kept = first.unionByName(alone).select(key, F.col("tie").alias("_tie"))
    marked = rows.withColumns({"_key": key, "_tie": F.xxhash64("text")})
    chosen = marked.join(kept, ["_key", "_tie"], "left_semi")
    once = F.row_number().over(Window.partitionBy("_key", "_tie").orderBy("source", *[c for c in rows.columns if c not in OWN]))
    return back(chosen.withColumn("_once", once).where("_once = 1"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the passages that stand in an earlier one."""
    rows, back = _veiled(docs)
    return _with_length(back(chunks.dedup_substrings(rows)))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix; a document drawn twice is two rows."""
    rows, back = _veiled(docs)
    sized = rows.withColumns({"_size": word_count(F.col("text")), "_tie": F.xxhash64("text")})
    return back(mixing.mix(sized, size="_size", tie="_tie"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of every document of the mix."""
    coded = pieces.encode(docs.select("doc_id", "source", "text"), piece_model())
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("piece_ids", piece_ids),
]
#: SQL cannot state the forest, the chunks and the pieces; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a Parquet table in the shared folder that the next stage reads."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
