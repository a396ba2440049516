"""Row identities and joins that check their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserine.functions import text as X
from tesserine.operators.quality import require_empty
from tesserine.operators.sample import numbered_rows


def row_id(split: Column, pos: Column, width: int = 4) -> Column:
    """``split-0012``: split and zero-based position."""
    return F.concat(split, F.lit("-"), numbered(pos, width))


def numbered(n: Column, width: int) -> Column:
    """A number with leading zeros up to the width; longer ones stay whole."""
    return F.format_string(f"%0{width}d", n.cast("long"))


def item_id(seed: Column, fallback: Column, style: Column, language: Column) -> Column:
    """Seed (or the fallback), style (or ``canonical``) and language joined by underscores."""
    return F.concat_ws("_", F.coalesce(F.nullif(seed, F.lit("")), fallback), F.coalesce(F.nullif(style, F.lit("")), F.lit("canonical")), language)


def first_filled(columns: list[Column]) -> Column:
    """The first value that is neither NULL nor blank, trimmed."""
    return F.coalesce(*[F.nullif(X.strip(c), F.lit("")) for c in columns])


def required_text(columns: list[Column], what: Column) -> Column:
    """As ``first_filled``; a row without any such value fails the query and is named by ``what``."""
    return F.coalesce(first_filled(columns), F.raise_error(F.concat(F.lit("no text in "), what)))


def group_ids(df: DataFrame, by: str, prefix: str, width: int = 3) -> DataFrame:
    """``df`` with ``group_id``: prefix and the dense rank of ``by``.

    The distinct values alone are numbered, piece by piece, and joined back, so no
    task sees all rows. NULL has no group.
    """
    values = numbered_rows(df.select(by).where(F.col(by).isNotNull()).distinct(), None, [by], "_r")
    return df.join(values.select(by, F.concat(F.lit(prefix), numbered(F.col("_r") - 1, width)).alias("group_id")), by, "left")


def key_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, n): keys on both sides, on the left only and on the right only."""
    a, b = (d.select(key).distinct() for d in (left, right))
    sides = a.withColumn("l", F.lit(True)).join(b.withColumn("r", F.lit(True)), key, "full_outer")
    side = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left_only").otherwise("right_only")
    return sides.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def strict_join(left: DataFrame, right: DataFrame, key: str, equal: list[str] = ()) -> DataFrame:
    """One-to-one join that fails on missing, extra or repeated keys and on differing ``equal`` columns."""
    for d, name in ((left, "left"), (right, "right")):
        require_empty(d.groupBy(key).count().where("count > 1"), f"repeated key on the {name}")
    require_empty(left.select(key).join(right.select(key), key, "left_anti"), "key missing on the right")
    require_empty(right.select(key).join(left.select(key), key, "left_anti"), "key missing on the left")
    out = left.join(right.select(key, *[F.col(c).alias(f"{c}_right") for c in right.columns if c != key]), key)
    for c in equal:
        require_empty(out.where(~F.col(c).eqNullSafe(F.col(f"{c}_right"))).select(key, c), f"{c} differs")
    return out


def left_lookup(df: DataFrame, other: DataFrame, keys: list[str], values: dict[str, str], order: list[Column]) -> DataFrame:
    """``df`` with values of ``other``, the last row of each key by ``order``; the default where there is none."""
    last = other.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").select(*keys, *values)
    return df.join(last, keys, "left").withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in values.items()})


def recover(df: DataFrame, other: DataFrame, key: str, column: str, order: list[Column | str] = ()) -> DataFrame:
    """``df`` with blank values of ``column`` taken from the last row of ``other`` with the key, by ``order`` or else by value."""
    by = [F.col(o) if isinstance(o, str) else o for o in order] or [F.col(column)]
    back = other.where(X.strip(F.coalesce(column, F.lit(""))) != "").groupBy(key).agg(F.max_by(F.col(column), F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*by, F.col(column)])])).alias("_c"))
    return df.join(back, key, "left").withColumn(column, first_filled([F.col(column), F.col("_c")])).drop("_c")


def patch(df: DataFrame, corrections: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` overwritten where ``corrections`` has the key; NULL corrections overwrite too."""
    new = corrections.select(key, F.lit(True).alias("_has"), *[F.col(c).alias(f"_{c}") for c in columns])
    return df.join(new, key, "left").withColumns({c: F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_has", *[f"_{c}" for c in columns])


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``old`` without the keys of ``new``, and the last row of each key of ``new``."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return old.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that ``a`` has more often than ``b``, with how many more."""
    columns = a.columns
    counted = a.withColumn("_d", F.lit(1)).unionByName(b.select(*columns).withColumn("_d", F.lit(-1)))
    return counted.groupBy(*columns).agg(F.sum("_d").alias("more")).where("more > 0")


def first_order_difference(a: DataFrame, b: DataFrame, pos: str, key: str) -> DataFrame:
    """One row at most: the first position at which two sequences differ, ``<missing>`` where one has ended."""
    joined = a.select(pos, F.col(key).alias("left")).join(b.select(pos, F.col(key).alias("right")), pos, "full_outer")
    return joined.where(~F.col("left").eqNullSafe(F.col("right"))).select(pos, F.coalesce("left", F.lit("<missing>")).alias("left"), F.coalesce("right", F.lit("<missing>")).alias("right")).orderBy(pos).limit(1)


def merge_entries(df: DataFrame, name: Column, rank: Column, order: str, payload: list[str]) -> DataFrame:
    """(name, rank, payload, evidences, conflict): rows of one normalised name merged; the first row of the highest rank gives the payload."""
    rows = df.withColumn("_name", F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))).withColumn("_rank", rank)
    best = F.struct(F.col("_rank"), -F.col(order), *[F.col(p) for p in payload])
    merged = rows.groupBy("_name").agg(F.max(best).alias("b"), F.count("*").alias("evidences"), F.count_distinct("_rank").alias("ranks"))
    return merged.select(F.col("_name").alias("name"), F.col("b._rank").alias("rank"), *[F.col(f"b.{p}").alias(p) for p in payload], "evidences", (F.col("ranks") > 1).alias("conflict"))


def evidence_entries(df: DataFrame, name: Column, level: Column, levels: tuple[str, ...], order: str, payload: list[str], action: str, evidence: dict[str, str], prefix: str, width: int = 2) -> DataFrame:
    """(entry_id, name, level, payload, action, evidence, conflict_note): rows of one normalised name merged.

    The payload is that of the first row by ``order``, the action that of the first
    row of the highest level; evidence is kept in order. Where rows disagree the
    note names their levels. Ids number the names in order, from 1.
    """
    ranks = F.create_map(*[F.lit(x) for i, v in enumerate(levels) for x in (v, i)])
    rows = df.withColumn("_name", F.lower(X.squeeze(name))).withColumn("_level", level).where("_name IS NOT NULL AND _level IS NOT NULL")
    first = F.min_by(F.struct(*payload), F.col(order))
    best = F.min_by(F.col(action), F.struct((-F.try_element_at(ranks, F.col("_level"))).alias("r"), F.col(order)))
    told = F.struct(F.col(order).alias("_o"), *[F.col(c).alias(k) for k, c in evidence.items()])
    merged = rows.groupBy("_name").agg(
        first.alias("_first"), best.alias("_action"), F.max_by("_level", F.try_element_at(ranks, F.col("_level"))).alias("level"),
        F.transform(F.array_sort(F.collect_list(told)), lambda x: F.struct(*[x[k].alias(k) for k in evidence])).alias("evidence"), F.array_sort(F.collect_set("_level")).alias("_levels"),
    )
    note = F.when(F.size("_levels") > 1, F.concat(F.lit("levels differ ("), F.array_join("_levels", ", "), F.lit("); the higher one applies")))
    ids = numbered_rows(merged, None, ["_name"], "_n")
    return ids.select(F.concat(F.lit(prefix), numbered(F.col("_n"), width)).alias("entry_id"), F.col("_name").alias("name"), "level", *[F.col(f"_first.{c}").alias(c) for c in payload], F.col("_action").alias(action), "evidence", note.alias("conflict_note"))


def entry_problems(entries: DataFrame, key: str, filled: list[str], level: str, levels: tuple[str, ...], evidence: str) -> DataFrame:
    """(key, problem): entries with a repeated id, a blank cell, an unknown level or no evidence."""
    n = entries.groupBy(key).agg(F.count("*").alias("_n"))
    blank = [(f"blank_{c}", X.strip(F.coalesce(F.col(c), F.lit(""))) == "") for c in filled]
    found = [("repeated", F.col("_n") > 1), *blank, ("level", ~F.coalesce(F.col(level).isin(*levels), F.lit(False))), ("evidence", F.coalesce(F.size(evidence), F.lit(0)) < 1)]
    return entries.join(n, key, "left").select(key, F.explode(F.array_compact(F.array(*[F.when(c, p) for p, c in found]))).alias("problem")).distinct()


def resume(df: DataFrame, earlier: DataFrame | None, key: str, failed: Column | None = None) -> DataFrame:
    """Rows still to do: those whose key no earlier record has, or, with ``failed``, only records that failed. Without earlier output all."""
    if earlier is None:
        return df
    return pending(df, earlier if failed is None else earlier.where(~F.coalesce(failed, F.lit(False))), key)
