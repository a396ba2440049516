"""Bounded samples for fitting models on the driver."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Steps between the hash values that a sample may take.
STEPS = 1 << 31


def bounded_sample(df: DataFrame, columns: list[str], n: int, by: str) -> dict[str, list[Row]]:
    """About ``n`` different rows (``columns``) for each value of ``by``, at most ``n``, in hash order.

    One scan counts the different rows of each value, a second one keeps those
    whose hash falls below the share wanted and drops repeats before they are sent.
    The driver gets some 1.2 ``n`` rows a value, whatever the number of rows,
    repeats or partitions. The same rows give the same sample. ``by`` must have few
    values; rows without it are left out, NULL columns are kept.
    """
    rows = df.where(F.col(by).isNotNull()).select(*columns, F.col(by).alias("_by"), F.xxhash64(*columns).alias("_h"))
    counts = {r["_by"]: r.n for r in rows.groupBy("_by").agg(F.approx_count_distinct("_h").alias("n")).collect()}
    if not counts:
        return {}
    below = F.coalesce(*[F.when(F.col("_by") == k, min(STEPS, int(STEPS * (1.2 * n + 20) / max(c, 1)))) for k, c in counts.items()])
    kept = rows.where(F.pmod("_h", F.lit(STEPS)) < below).distinct().collect()
    out: dict[str, list[Row]] = {k: [] for k in counts}
    for r in sorted(kept, key=lambda r: (r["_h"] % STEPS, r["_h"], repr(r))):
        out[r["_by"]].append(r)
    return {k: v[:n] for k, v in out.items()}


def tagged(frames: list[DataFrame]) -> DataFrame:
    """The union of frames of equal columns with the number of its frame in each row's ``frame``."""
    return functools.reduce(DataFrame.unionByName, (df.withColumn("frame", F.lit(str(k))) for k, df in enumerate(frames)))
