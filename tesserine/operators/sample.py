"""Selection, splits, quotas, replication and order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserine.runtime import stored


def seeded(key: Column, seed: int) -> Column:
    """A reproducible order of rows that looks random: the MD5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def top_n(df: DataFrame, by: list[str], order: list[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def numbered_rows(df: DataFrame, by: str | None, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``: the place, from 1, of each row in its group (or in all), without one task for a group.

    All rows are sorted over the cluster by group and order, numbered inside each
    partition and shifted by what earlier partitions hold of the group; a group may
    hold most of the rows. NULL is a group.
    """
    group = F.lit(0) if by is None else F.col(by)
    rows = df.withColumn("_g", group)
    rows = stored(rows.sort("_g", *order).withColumn("_p", F.spark_partition_id()), "sorted")
    sizes = rows.groupBy("_g", "_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_g").alias("_h"), F.col("_p").alias("_q"), before.alias("_s"))  # a row for each group of each partition
    at = F.row_number().over(Window.partitionBy("_g", "_p").orderBy(*order))
    joined = rows.withColumn("_at", at).join(starts, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_p") == F.col("_q")))
    return joined.withColumn("_at", F.col("_at") + F.col("_s")).drop("_g", "_h", "_p", "_q", "_s").withColumnRenamed("_at", name)


def ranked(df: DataFrame, order: Column, ties: list[str], name: str) -> DataFrame:
    """``df`` with its place from 1 in an order over all rows."""
    return numbered_rows(df, None, [order, *ties], name)


def stratified_split(df: DataFrame, by: str, key: str, share: float, seed: int) -> DataFrame:
    """``df`` with ``split``: ``val`` for the share of each stratum that comes first in seeded order, rounded half to even, else ``train``.

    Strata are counted in one aggregation and numbered piece by piece, so a stratum
    may hold most of the rows.
    """
    n = df.groupBy(F.col(by).alias("_by")).agg(F.bround(F.count("*") * F.lit(share), 0).cast("long").alias("_n"))
    rows = numbered_rows(df, by, [seeded(F.col(key), seed), key], "_r").join(n, F.col(by).eqNullSafe(F.col("_by")))
    return rows.withColumn("split", F.when(F.col("_r") <= F.col("_n"), "val").otherwise("train")).drop("_r", "_n", "_by")


def sample_per_group(df: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """Up to ``n`` rows of each group, the first in seeded order."""
    return top_n(df, [by], [seeded(F.col(key), seed), key], n, "_r").drop("_r")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in a seeded order, by a range-partitioned sort."""
    return df.orderBy(seeded(F.col(key), seed), key)


def oversample(df: DataFrame, condition: Column, times: int) -> DataFrame:
    """Rows that meet the condition ``times`` times over, others once, with ``copy`` from 1; 1 or less changes nothing."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(condition, max(times, 1)).otherwise(1))))


def chunks(df: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """``df`` with ``chunk``: the number, from 0, of its group's piece of ``size`` rows; a group may hold most of the rows."""
    rows = df.withColumn("_by", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
    return numbered_rows(rows, "_by", order, "_r").withColumn("chunk", F.floor((F.col("_r") - 1) / size).cast("long")).drop("_by", "_r")


def row_range(df: DataFrame, pos: str, start: int, end: int) -> DataFrame:
    """Rows at positions from ``start`` up to, but not including, ``end``."""
    return df.where(F.col(pos).between(start, end - 1))


def mixture(parts: list[tuple[str, DataFrame, int | None]], by: str, key: str, seed: int) -> DataFrame:
    """The union of named components, each cut to so many rows per group (None: all), with ``component``."""
    out = None
    for name, df, n in parts:
        one = (df if n is None else sample_per_group(df, by, key, n, seed)).withColumn("component", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


#: Rows of each group and bucket, as a multiple of the target, that the first round of a greedy choice looks at.
FIRST_SLICE = 20


def diverse_selection(df: DataFrame, by: str, key: str, tokens: str, bucket: str, order: list[str], shares: dict[str, float], target: int, most_similar: float = 0.5) -> DataFrame:
    """(by, key, place): up to ``target`` rows of each group, by bucket quotas, no two as similar as ``most_similar``.

    The greedy choice walks the rows of each bucket with a quota in order, then all
    rows for the places left. Rows of equal tokens stand for one. A round looks at
    the first rows of each group and bucket only; groups that could need more are
    done again with ten times as many, until a group is full or used up, so the
    result is that of the whole pool while no task gets a whole group that fills
    early. NULL keys and token lists take no part.
    """
    names = list(shares)
    quotas = [round(share * target) for share in shares.values()]
    kinds = {c: df.schema[c].dataType.simpleString() for c in (by, key)}
    rows = df.where(F.col(key).isNotNull() & F.col(tokens).isNotNull()).select(F.col(by).alias("g"), F.col(key).alias("k"), F.array_sort(F.array_distinct(tokens)).alias("t"), F.col(bucket).alias("b"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    ranks = [F.asc_nulls_last(f"o{i}") for i in range(len(order))] + [F.col("k")]
    # equal sets are as similar as can be; empty ones are like nothing
    same = F.when(F.size("t") > 0, F.sha2(F.to_json("t"), 256)).otherwise(F.sha2(F.concat(F.lit("k"), F.col("k").cast("string")), 256))
    rows = rows.withColumn("s", same).withColumn("n", F.row_number().over(Window.partitionBy("g", "b", "s").orderBy(*ranks))).where("n = 1").drop("n", "s")
    rows = stored(rows, "pool")
    own = F.coalesce(*[F.when(F.col("b") == b, F.lit(i)) for i, b in enumerate(names)], F.lit(None).cast("int"))
    phased = rows.withColumn("phase", F.explode(F.array_compact(F.array(own, F.lit(len(names))))))
    sizes = phased.groupBy("g", "phase").agg(F.count("*").alias("all"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = phase = None
        chosen: list = []
        sets: list[set] = []
        room = 0
        for batch in batches:
            out = []
            groups, keys, phases, lists, cut = (batch.column(c) for c in ("g", "k", "phase", "t", "last"))
            for i, (g, p, last) in enumerate(zip(groups.to_pylist(), phases.to_pylist(), cut.to_pylist())):
                if phase is None or g != group:
                    group, phase, chosen, sets = g, -1, [], []
                if p != phase:
                    phase, room = p, quotas[p] if p < len(quotas) else target - len(chosen)
                if room > 0:
                    k, s = keys[i].as_py(), set(lists[i].as_py())
                    if k not in chosen and not any(len(s & o) >= most_similar * max(len(s | o), 1) for o in sets):
                        chosen.append(k)
                        sets.append(s)
                        room -= 1
                        out.append((g, k, len(chosen)))
                if last and room > 0:  # the slice ends here, the rows do not
                    out.append((g, None, 0))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], groups.type), pa.array(columns[1], keys.type), pa.array(columns[2], pa.int32())], ["g", "k", "place"])

    done, size, open_groups = None, FIRST_SLICE * target, None
    while True:
        pool = phased if open_groups is None else phased.join(open_groups, phased["g"].eqNullSafe(open_groups["og"]), "left_semi")
        slices = pool.withColumn("r", F.row_number().over(Window.partitionBy("g", "phase").orderBy(*ranks))).where(F.col("r") <= size)
        ends = sizes.select(F.col("g").alias("sg"), F.col("phase").alias("sp"), "all")
        marked = slices.join(ends, F.col("g").eqNullSafe(F.col("sg")) & (F.col("phase") == F.col("sp"))).withColumn("last", (F.col("r") == size) & (F.col("all") > size))
        sorted_rows = marked.repartition("g").sortWithinPartitions("g", "phase", "r").select("g", "k", "t", "phase", "last")
        made = stored(sorted_rows.mapInArrow(choose, f"g {kinds[by]}, k {kinds[key]}, place int"), "chosen")
        open_groups = made.where("place = 0").select(F.col("g").alias("og")).distinct()
        part = made.join(open_groups, made["g"].eqNullSafe(open_groups["og"]), "left_anti")
        done = part if done is None else done.unionByName(part)
        if not open_groups.limit(1).count():
            return done.select(F.col("g").alias(by), F.col("k").alias(key), "place")
        size *= 10
