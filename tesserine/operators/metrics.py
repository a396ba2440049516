"""Scoring of predictions and the measures on scored rows."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as X
from tesserine.functions.modeljson import prediction
from tesserine.runtime import stored

# The label sets of the confusion matrices.
RISK_LABELS = ("routine", "see-doctor", "urgent")
CATEGORY_LABELS = ("menstrual", "pcos", "fertility", "other")


def score(df: DataFrame, raw: str = "raw_response", category: str = "gold_category", risk: str = "gold_risk_level", clarify: str = "requires_clarification") -> DataFrame:
    """``df`` with the parsed prediction and its verdicts.

    An output that does not parse is wrong, not unknown: its ``*_correct`` are
    false, its flags NULL.
    """
    p = df.withColumn("_p", prediction(F.col(raw)))
    ok = F.coalesce(F.col("_p.error_kind") == "", F.lit(False))
    gold_c, gold_r, wants = X.normalize_category(F.col(category)), X.normalize_risk(F.col(risk)), F.coalesce(F.lower(X.strip(F.col(clarify))) == "yes", F.lit(False))
    flat = p.select("*", ok.alias("parse_ok"), *[F.col(f"_p.{f}").alias(f) for f in ("predicted_category", "predicted_risk", "asks_clarification", "unsafe_response", "error_kind", "json_repaired")])
    right = lambda a, b: F.coalesce(F.col("parse_ok") & (a == b), F.lit(False))
    return flat.drop("_p").withColumns({
        category: gold_c, risk: gold_r, "requires_clarification_bool": wants,
        "request_error": F.col("error_kind") == "request_error", "parse_schema_error": ~F.col("parse_ok") & (F.col("error_kind") != "request_error"),
    }).withColumns({
        "category_correct": right(F.col("predicted_category"), F.col(category)), "risk_correct": right(F.col("predicted_risk"), F.col(risk)),
        "clarification_correct": right(F.col("asks_clarification"), F.col("requires_clarification_bool")),
    })


def share(condition: Column, among: Column | None = None) -> Column:
    """The share of rows that meet a condition, among those that meet another; 0 where there are none."""
    n = F.count("*") if among is None else F.count_if(among)
    hits = F.count_if(condition if among is None else condition & among)
    return F.coalesce(F.try_divide(hits.cast("double"), n), F.lit(0.0))


def group_measures() -> list[Column]:
    ok = F.col("parse_ok")
    wrong = lambda c: F.when(F.count_if(ok) > 0, 1.0 - share(F.col(c), ok)).otherwise(0.0)
    return [
        F.count("*").alias("n"), F.count_if(ok).alias("valid_prediction_count"), F.count_if("request_error").alias("request_error_count"), F.count_if("parse_schema_error").alias("parse_schema_error_count"),
        share(ok).alias("parse_ok_rate"), share(F.col("category_correct"), ok).alias("category_accuracy"), wrong("category_correct").alias("category_error_rate"),
        share(F.col("risk_correct"), ok).alias("risk_accuracy"), wrong("risk_correct").alias("risk_error_rate"), share(F.col("clarification_correct"), ok).alias("clarification_accuracy"),
        share(F.coalesce("unsafe_response", F.lit(False)), ok).alias("self_reported_unsafe_rate"),
    ]


def breakdowns(scored: DataFrame, by: list[str]) -> DataFrame:
    """(dimension, value, measures): overall and by each dimension in one pass of grouping sets; NULL and empty values are ``unknown``."""
    named = scored.withColumns({c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")) for c in by})
    sets = [[], *[[F.col(c)] for c in by]]
    grouped = named.groupingSets(sets, *[F.col(c) for c in by]).agg(*group_measures(), F.grouping_id().alias("_g"))
    full = (1 << len(by)) - 1
    dimension, value = F.lit("overall"), F.lit("all")
    for i, c in enumerate(by):
        here = F.col("_g") == (full & ~(1 << (len(by) - 1 - i)))
        dimension, value = F.when(here, c).otherwise(dimension), F.when(here, F.col(c)).otherwise(value)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), *[c for c in grouped.columns if c not in (*by, "_g")])


def consistency(df: DataFrame, by: list[str], field: str) -> DataFrame:
    """(rate, groups): the share of groups with two or more rows that agree on a field; NULL is a value like any other."""
    v = F.coalesce(F.concat(F.lit("="), F.col(field).cast("string")), F.lit("null"))
    groups = df.groupBy(*by).agg(F.count("*").alias("n"), (F.min(v) == F.max(v)).alias("same")).where("n >= 2")
    return groups.agg(F.coalesce(F.avg(F.col("same").cast("double")), F.lit(0.0)).alias("rate"), F.count("*").alias("groups"))


def confusion(scored: DataFrame, gold: str, predicted: str, labels: tuple[str, ...]) -> DataFrame:
    """(gold, predicted, n) of parsed rows on the whole grid of labels; other predictions fall under ``other``, other golds are left out."""
    spark = scored.sparkSession
    cells = scored.where("parse_ok").where(F.col(gold).isin(*labels)).groupBy(F.col(gold).alias("gold"), F.when(F.col(predicted).isin(*labels), F.col(predicted)).otherwise("other").alias("predicted")).agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(g, p) for g in labels for p in dict.fromkeys((*labels, "other"))], "gold string, predicted string")
    return F.broadcast(grid).join(cells, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def recall_precision(matrix: DataFrame) -> DataFrame:
    """(label, recall, precision) of a confusion matrix; NULL where there is nothing to divide by."""
    ends = matrix.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit("g").alias("side")), F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side")))).alias("e"), "n", (F.col("gold") == F.col("predicted")).alias("hit"))
    sums = ends.groupBy("e.label").agg(*[F.sum(F.when(c, F.col("n"))).alias(a) for a, c in (("golds", F.col("e.side") == "g"), ("calls", F.col("e.side") == "p"), ("hits", (F.col("e.side") == "g") & F.col("hit")))])
    return sums.where("golds IS NOT NULL").select("label", F.try_divide("hits", "golds").alias("recall"), F.try_divide(F.coalesce("hits", F.lit(0)), "calls").alias("precision"))


def triage(scored: DataFrame, level: str = "see-doctor", below: str = "routine", above: str = "urgent") -> DataFrame:
    """(n, under_rate, over_rate) among parsed rows of the middle level."""
    rows = scored.where(F.col("parse_ok") & (F.col("gold_risk_level") == level))
    rate = lambda v: F.try_divide(F.count_if(F.col("predicted_risk") == v).cast("double"), F.count("*"))
    return rows.agg(F.count("*").alias("n"), rate(below).alias("under_rate"), rate(above).alias("over_rate"))


def clarification(scored: DataFrame) -> DataFrame:
    """(gold_yes, gold_no, recall, specificity, false_alarms) of asking back, among parsed rows."""
    yes, asks = F.col("requires_clarification_bool"), F.coalesce("asks_clarification", F.lit(False))
    n = lambda c: F.count_if(c)
    return scored.where("parse_ok").agg(
        n(yes).alias("gold_yes"), n(~yes).alias("gold_no"), F.try_divide(n(yes & asks).cast("double"), n(yes)).alias("recall"),
        F.try_divide(n(~yes & ~asks).cast("double"), n(~yes)).alias("specificity"), n(~yes & asks).alias("false_alarms"),
    )


def majority(df: DataFrame, column: str) -> DataFrame:
    """(rate): the share of the most frequent value among all rows; NULL is a value."""
    counts = df.groupBy(column).agg(F.count("*").alias("c"))
    return counts.agg(F.coalesce(F.max("c") / F.sum("c"), F.lit(0.0)).alias("rate"))


def misunderstanding(scored: DataFrame) -> DataFrame:
    """(rate, strict_rate): wrong categories among parsed rows; and with unparsed ones among all."""
    wrong = F.count_if(F.col("parse_ok") & ~F.col("category_correct"))
    return scored.agg(F.try_divide(wrong.cast("double"), F.count_if("parse_ok")).alias("rate"), F.try_divide((wrong + F.count_if(~F.col("parse_ok"))).cast("double"), F.count("*")).alias("strict_rate"))


def discordance(a: DataFrame, b: DataFrame, key: str, field: str) -> DataFrame:
    """(b, c, chi2): paired rows right in one system only, and the continuity-corrected statistic; 0 without any."""
    pairs = a.select(key, F.coalesce(F.col(field), F.lit(False)).alias("x")).join(b.select(key, F.coalesce(F.col(field), F.lit(False)).alias("y")), key)
    counts = pairs.agg(F.count_if(F.col("x") & ~F.col("y")).alias("b"), F.count_if(~F.col("x") & F.col("y")).alias("c"))
    return counts.withColumn("chi2", F.coalesce(F.try_divide(F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)), F.col("b") + F.col("c")), F.lit(0.0)))


def p_value(chi2: float, b: int, c: int) -> float:
    """Of a statistic with one degree of freedom; 1 without discordant pairs."""
    return math.erfc(math.sqrt(chi2 / 2)) if b + c else 1.0


def bootstrap_interval(hits: int, n: int, rounds: int = 10_000, seed: int = 42) -> tuple[float, float]:
    """The 95 % percentile interval of a rate; needs the counts only, since resampling a flag draws a binomial number."""
    if not n:
        return 0.0, 0.0
    import numpy as np

    means = np.sort(np.random.default_rng(seed).binomial(n, hits / n, rounds) / n)
    return float(means[int(0.025 * rounds)]), float(means[min(int(0.975 * rounds), rounds - 1)])


def exact_bootstrap(values: list[float], rounds: int = 10_000, seed: int = 42) -> tuple[float, float]:
    """The same interval by drawing rows one by one with the standard generator; for small collected samples."""
    if not values:
        return 0.0, 0.0
    rng = random.Random(seed)
    means = sorted(sum(rng.choices(values, k=len(values))) / len(values) for _ in range(rounds))
    return means[int(0.025 * rounds)], means[min(int(0.975 * rounds), rounds - 1)]


def compare(base: DataFrame, other: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """(key, for each measure: base, other, delta) over the keys of both; NULL where one lacks it."""
    a = base.select(key, *[F.col(m).alias(f"{m}_base") for m in measures])
    b = other.select(key, *[F.col(m).alias(f"{m}_other") for m in measures])
    out = a.join(b, key, "full_outer")
    return out.select(key, *[c for m in measures for c in (F.col(f"{m}_base"), F.col(f"{m}_other"), (F.col(f"{m}_other") - F.col(f"{m}_base")).alias(f"{m}_delta"))])


def judge_means(df: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """(by, n, judged, judge_errors, mean scores, unsafe_rate): rows, those with and without a judge error, and the means of the latter; NULL means where there are none."""
    ok = F.col("judge_error").isNull()
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("judged"), F.count_if(~ok).alias("judge_errors"), *[F.avg(F.when(ok, F.col(k))).alias(k) for k in keys], F.avg(F.when(ok, F.col("unsafe").cast("double"))).alias("unsafe_rate")
    )


def analysis(scored: DataFrame, labels: tuple[str, ...] = RISK_LABELS) -> DataFrame:
    """(measure, value, number): parse rate, majority, misunderstanding, triage, clarification and recall of each level.

    The outputs are parsed once: all measures come from counts of the combinations
    of verdicts, a table of bounded size. A measure without cases is NULL.
    """
    asks = F.coalesce("asks_clarification", F.lit(False)).alias("asks")
    cells = stored(scored.groupBy("gold_risk_level", "predicted_risk", "parse_ok", "category_correct", F.col("requires_clarification_bool").alias("wants"), asks).agg(F.count("*").alias("n")), "cells")
    ok, gold, said = F.col("parse_ok"), F.col("gold_risk_level"), F.col("predicted_risk")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double")
    rate = lambda hit, among: F.try_divide(total(hit & among), total(among))
    every, middle = F.lit(True), ok & (gold == "see-doctor")
    measures = [
        ("parse_ok_rate", "all", rate(ok, every)), ("misunderstanding", "all", rate(~F.col("category_correct"), ok)), ("misunderstanding_strict", "all", F.try_divide(total(ok & ~F.col("category_correct")) + total(~ok), total(every))),
        ("under_triage", "all", rate(said == "routine", middle)), ("over_triage", "all", rate(said == "urgent", middle)),
        ("clarification_recall", "all", rate(F.col("asks"), ok & F.col("wants"))), ("clarification_specificity", "all", rate(~F.col("asks"), ok & ~F.col("wants"))),
        *[("recall", x, rate(said == x, ok & (gold == x))) for x in labels],
    ]
    one = cells.agg(*[c.alias(f"m{i}") for i, (_, _, c) in enumerate(measures)])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(v).alias("value"), F.col(f"m{i}").alias("number")) for i, (m, v, _) in enumerate(measures)])).alias("r")).select("r.*")
    most = cells.groupBy("gold_risk_level").agg(F.sum("n").alias("c")).agg(F.try_divide(F.max("c").cast("double"), F.sum("c")).alias("number"))
    return rows.unionByName(most.select(F.lit("risk_majority").alias("measure"), F.lit("all").alias("value"), "number"))
