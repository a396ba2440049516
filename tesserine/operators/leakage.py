"""Exclusion of rows that occur in held-out material."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.operators.quality import require_empty


def flag(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: whether the key occurs in the only column of ``keys``; NULL and empty keys never do."""
    c = keys.columns[0]
    known = keys.select(F.col(c).alias("_k")).where("_k IS NOT NULL AND _k <> ''").distinct().withColumn(name, F.lit(True))
    return df.withColumn("_k", key).join(known, "_k", "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_k")


def dual_key_exclusion(df: DataFrame, row_key: Column, row_keys: DataFrame, text_hash: Column, hashes: DataFrame) -> DataFrame:
    """``df`` with ``exclusion_reason``: row key first, then text hash, else NULL.

    Two joins, one for each key: an OR in one join would compare every pair.
    """
    both = flag(flag(df, row_key, row_keys, "_row"), text_hash, hashes, "_hash")
    return both.withColumn("exclusion_reason", F.when(F.col("_row"), "row_key").when(F.col("_hash"), "text_hash")).drop("_row", "_hash")


def clean_splits(train: DataFrame, val: DataFrame, question: Column, held_out: DataFrame, degenerate: Column) -> tuple[DataFrame, DataFrame]:
    """(train, val), each with ``reason`` for rows to drop: degenerate, held-out question, and train questions that a surviving val row asks.

    Val wins a question that both splits ask.
    """
    marked = []
    for df in (train, val):
        seen = flag(df, question, held_out, "_held")
        marked.append(seen.withColumn("reason", F.when(degenerate, "degenerate").when(F.col("_held"), "held_out")).drop("_held"))
    surviving = marked[1].where("reason IS NULL").select(question.alias("q"))
    t = flag(marked[0], question, surviving, "_val")
    return t.withColumn("reason", F.when(F.col("reason").isNull() & F.col("_val"), "val_duplicate").otherwise(F.col("reason"))).drop("_val"), marked[1]


def require_no_leak(df: DataFrame, question: Column, held_out: DataFrame) -> None:
    """Fail if a held-out question survives."""
    require_empty(flag(df, question, held_out, "_held").where("_held"), "a held-out question survives")
