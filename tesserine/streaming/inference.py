"""Resumable processing of rows that arrive over time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tesserine.functions.modeljson import prediction
from tesserine.operators.dedup import first_per_key


def called(df: DataFrame, prompt: str, call: Callable[[str], str], out: str = "raw_response") -> DataFrame:
    """``df`` with the answer of ``call`` to each prompt; a call that raises gives NULL and its message in ``call_error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers, errors = [], []
            for p in pdf[prompt]:
                try:
                    answers.append(call(p))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    answers.append(None)
                    errors.append(str(e))
            yield pdf.assign(**{out: answers, "call_error": errors})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField("call_error", T.StringType())]))


def called_once(df: DataFrame, prompt: str, kind: str, register, cache: DataFrame, call: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``raw_response`` from the cache, new cache entries): each text that the cache lacks is called once, whatever its rows.

    Add the entries to the cache and call again to fill in the rest.
    """
    from tesserine.operators.records import from_cache, job_key

    have = from_cache(df, kind, prompt, register, cache, "raw_response")
    new = have.where(F.col("raw_response").isNull() & F.col(prompt).isNotNull()).select(job_key(F.lit(kind), F.col(prompt), register).alias("key"), F.sha2(prompt, 256).alias("source_sha256"), F.col(prompt).alias("_prompt")).distinct()
    made = called(new, "_prompt", call, "value").where("call_error IS NULL").select("key", "source_sha256", "value")
    return have, made


def parsed(df: DataFrame, raw: str = "raw_response") -> DataFrame:
    """``df`` with the parsed prediction's fields; works on streams and tables alike."""
    return df.withColumn("_p", prediction(F.col(raw))).select("*", "_p.*").drop("_p")


def upsert_sink(stream: DataFrame, key: str, order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the last row of each key in the table at ``path``.

    Each batch, reduced to the last row of each key, goes to a directory of its own
    number, so a batch that is run again after a failure replaces itself; ``latest``
    reads the last row of each key, ``compact`` makes one directory of many.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = first_per_key(batch, [key], [F.desc(order)])
        last.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, path: str, key: str, order: str) -> DataFrame:
    """The last row of each key over all batches; the path may be on any file system that Spark reads."""
    return first_per_key(spark.read.parquet(path), [key], [F.desc("_batch"), F.desc(order)]).drop("_batch", "batch")


def compact(spark, path: str, key: str, order: str, to: str) -> None:
    """Write the last row of each key to another place, as batch 0 of a new table; the old one stays until it is deleted."""
    latest(spark, path, key, order).withColumn("_batch", F.lit(0)).write.parquet(f"{to}/batch=0")


def arrival_counts(stream: DataFrame, time: str, by: str, lateness: str = "3 hours", window: str = "1 hour") -> DataFrame:
    """(window_start, by, n) of rows by event time; rows later than the watermark are left out of a stream, never of a table."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
