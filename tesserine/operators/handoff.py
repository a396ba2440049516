"""Translation handoffs: templates, expectations on what comes back, and mapping it into place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as X
from tesserine.operators import keyed, leakage
from tesserine.operators.quality import require_empty

# Acronyms of the source language and the one that a translation has in their place.
ACRONYMS = ((("PCOS", "PCOD"), "SOPK"), (("PMS",), "SPM"), (("IVF",), "FIV"), (("IUI",), "IIU"))


def is_blank(c: Column) -> Column:
    return X.strip(F.coalesce(c, F.lit(""))) == ""


def template(df: DataFrame, key: str, keep: list[str], targets: list[str]) -> DataFrame:
    """The rows that a translator gets: ``keep`` columns and an empty cell for each target; a repeated key fails."""
    require_empty(df.groupBy(key).count().where("count > 1"), "repeated key")
    return df.select(*keep, *[F.lit("").alias(t) for t in targets])


def expected_rows(train: DataFrame, val: DataFrame, benchmark: DataFrame, pos: str, question: str, keep: list[str]) -> DataFrame:
    """(row_id, split, keep) of the rows that a handoff must have: none whose question the benchmark asks, and no training row that a remaining val row asks too.

    Positions are those of the whole files, from 0, so ids do not shift.
    """
    key = X.question_key(F.col(question))
    held = benchmark.select(X.question_key(F.col(question)))
    rows = {name: leakage.flag(df, key, held, "_held").where(~F.col("_held")).drop("_held") for name, df in (("train", train), ("val", val))}
    rows["train"] = leakage.flag(rows["train"], key, rows["val"].select(key.alias("q")), "_val").where(~F.col("_val")).drop("_val")
    made = [df.select(keyed.row_id(F.lit(name), F.col(pos)).alias("row_id"), F.lit(name).alias("split"), *[F.coalesce(c, F.lit("")).alias(c) for c in keep]) for name, df in rows.items()]
    return made[0].unionByName(made[1])


def require_pristine(df: DataFrame, key: str, targets: list[str]) -> DataFrame:
    """``df`` if no target cell is filled."""
    filled = reduce(lambda a, b: a | b, [~is_blank(F.col(t)) for t in targets])
    require_empty(df.where(filled).select(key), "filled cell in a template")
    return df


def count_problems(df: DataFrame, split: str, expected: dict[str, int]) -> DataFrame:
    """(check, value, found, expected): splits, and all rows together, of another number than expected."""
    want = [("rows", "all", sum(expected.values())), *[("split", k, v) for k, v in expected.items()]]
    wanted = df.sparkSession.createDataFrame(want, "check string, value string, expected long")
    found = df.groupBy(F.col(split).alias("value")).agg(F.count("*").alias("found")).withColumn("check", F.lit("split"))
    total = df.agg(F.count("*").alias("found")).select(F.lit("all").alias("value"), "found", F.lit("rows").alias("check"))
    both = found.unionByName(total).join(wanted, ["check", "value"], "full_outer")
    both = both.withColumns({"found": F.coalesce("found", F.lit(0)), "expected": F.coalesce("expected", F.lit(0))})
    return both.where("found <> expected").select("check", "value", "found", "expected")


def identity_problems(df: DataFrame, expected: DataFrame, key: str, split: str, pattern: str, immutable: list[str]) -> DataFrame:
    """(check, n): repeated keys, keys of another shape, keys that begin with another split, unknown and missing keys, changed immutable cells by column.

    A key that occurs several times is compared once for each row.
    """
    rows = df.select(key, split, *immutable)
    shape = F.rlike(F.coalesce(F.col(key), F.lit("")), F.lit(pattern))
    singles = rows.agg(F.count_if(~shape).alias("key_shape"), F.count_if(shape & ~F.col(key).startswith(F.concat(F.col(split), F.lit("-")))).alias("key_split"))
    repeated = rows.groupBy(key).count().agg(F.count_if(F.col("count") > 1).alias("repeated_key"))
    known = expected.groupBy(key).agg(*[F.min(F.struct(F.col(c))).getField(c).alias(f"_{c}") for c in immutable]).withColumn("_known", F.lit(True))
    met = rows.withColumn("_met", F.lit(True)).join(known, key, "full_outer")
    both = F.col("_met") & F.col("_known")
    compared = met.agg(
        F.count_if(F.col("_known").isNull()).alias("unknown_key"), F.count_if(F.col("_met").isNull()).alias("missing_key"),
        *[F.count_if(both & ~F.coalesce(F.col(c).cast("string"), F.lit("")).eqNullSafe(F.coalesce(F.col(f"_{c}").cast("string"), F.lit("")))).alias(f"changed_{c}") for c in immutable],
    )
    listed = [one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in one.columns])).alias("p")).select("p.check", "p.n") for one in (singles, repeated, compared)]
    return reduce(DataFrame.unionByName, listed).where("n > 0")


def acronym_problems(df: DataFrame, key: str, source: str, target: str, rules=ACRONYMS) -> DataFrame:
    """(key, acronym, missing, kept): cells whose source has an acronym but whose translation lacks the other language's or keeps the source's."""
    s, t = X.without_urls(F.col(source)), X.without_urls(F.col(target))
    found = []
    for sources, wanted in rules:
        named = reduce(lambda a, b: a | b, [X.holds_acronym(s, x) for x in sources])
        missing, kept = ~X.holds_acronym(t, wanted), reduce(lambda a, b: a | b, [X.holds_acronym(t, x) for x in sources])
        found.append(F.when(named & (missing | kept), F.struct(F.lit(wanted).alias("acronym"), missing.alias("missing"), kept.alias("kept"))))
    return df.select(key, F.explode(F.array_compact(F.array(*found))).alias("p")).select(key, "p.*")


def language_signals(df: DataFrame, key: str, cell: str, own: tuple[str, ...], foreign: tuple[str, ...]) -> DataFrame:
    """(key, own, foreign, looks_foreign): words of either list in a cell; it looks foreign with two foreign ones and more of them than own ones. Cells of fewer than three words are left out."""
    w = X.letter_tokens(F.col(cell))
    n = lambda words: F.size(F.filter(w, lambda x: x.isin(*words)))
    return df.where(F.size(w) >= 3).select(key, n(own).alias("own"), n(foreign).alias("foreign")).withColumn("looks_foreign", (F.col("foreign") >= 2) & (F.col("foreign") > F.col("own")))


def corpus_signal(signals: DataFrame) -> DataFrame:
    """(signal): the share of own words among all recognised ones; 0 without any."""
    return signals.agg(signal_share().alias("signal"))


def signal_share() -> Column:
    """The aggregate of ``language_signals`` that ``corpus_signal`` gives."""
    return F.coalesce(F.try_divide(F.sum("own").cast("double"), F.sum(F.col("own") + F.col("foreign"))), F.lit(0.0))


def apply_translation(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """``df`` with each column overwritten by its translated one, trimmed; a blank translation fails the call."""
    blank = reduce(lambda a, b: a | b, [is_blank(F.col(t)) for t in columns.values()])
    require_empty(df.where(blank).select(key), "blank translation")
    return df.withColumns({c: X.strip(F.col(t)) for c, t in columns.items()})


def corrected(before: DataFrame, after: DataFrame, key: str, immutable: list[str], filled: list[str]) -> DataFrame:
    """``after`` if it has the keys of ``before``, the same immutable cells and no blank cell in ``filled``."""
    keyed.strict_join(before, after, key, immutable)
    blank = reduce(lambda a, b: a | b, [is_blank(F.col(c)) for c in filled])
    require_empty(after.where(blank).select(key), "blank cell after a correction")
    return after


def translated_benchmark(gold: DataFrame, handoff: DataFrame, key: str, text: str, translated: str) -> DataFrame:
    """``gold`` with its text replaced by the translation of the same key; missing, blank and unknown keys fail."""
    ready = handoff.where(~is_blank(F.col(translated))).select(key, X.strip(F.col(translated)).alias("_t"))
    return keyed.strict_join(gold, ready, key).drop(text).withColumnRenamed("_t_right", text)


def text_by_register(style: Column, own: tuple[str, ...], formal: Column, everyday: Column) -> Column:
    """The formal text for the styles in ``own``; for others the everyday one where it is filled."""
    return F.when(style.isin(*own), formal).otherwise(F.coalesce(F.nullif(X.strip(everyday), F.lit("")), formal))


def merge_variants(df: DataFrame, variants: DataFrame, keys: list[str], style: str, text: str, canonical: str = "canonical") -> DataFrame:
    """``df`` with the text of other than canonical styles taken from ``variants`` (last value of a key); a missing one fails."""
    last = variants.groupBy(*keys).agg(F.max(text).alias("_t"))
    joined = df.join(last, keys, "left")
    require_empty(joined.where((F.col(style) != canonical) & F.col("_t").isNull()).select(*keys), "variant missing")
    return joined.withColumn(text, F.when(F.col(style) == canonical, F.col(text)).otherwise(F.col("_t"))).drop("_t")


def concatenated(batches: list[DataFrame]) -> DataFrame:
    """The rows of all batches with ``batch``; a batch with another header fails."""
    for df in batches[1:]:
        if df.columns != batches[0].columns:
            raise ValueError(f"columns {df.columns} are not {batches[0].columns}")
    return reduce(DataFrame.unionByName, (df.withColumn("batch", F.lit(k)) for k, df in enumerate(batches)))


def positional_join(left: DataFrame, right: DataFrame, keys: list[str], equal: list[str]) -> DataFrame:
    """Rows of equal (split, position) side by side; ``equal`` columns must agree and no position may lack its partner."""
    a, b = (d.withColumn("_k", F.to_json(F.struct(*keys))) for d in (left, right))
    return keyed.strict_join(a, b.drop(*keys), "_k", equal).drop("_k")
