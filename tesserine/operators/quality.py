"""Row filters that keep their reasons, and expectations on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserine.functions import text as X

# Answers that say nothing.
JUNK_ANSWER = r"(?i)^\s*(?:please\s+)?(?:consult|see|visit)\s+(?:a|your)\s+(?:doctor|gynecologist|gp|physician)\.?\s*$"
URL_ONLY = r"^\s*https?://\S+\s*$"


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, NULL if none does; a NULL condition does not hold."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def answer_rules(question: Column, answer: Column, least: int = 20, most: int = 1500) -> list[tuple[str, Column]]:
    a = F.coalesce(answer, F.lit(""))
    return [
        ("answer_length", ~F.length(a).between(least, most)),
        ("junk_answer", F.rlike(a, F.lit(JUNK_ANSWER)) | F.rlike(a, F.lit(URL_ONLY))),
        ("non_english_heuristic", ~X.mostly_ascii(question) | ~X.mostly_ascii(answer)),
    ]


def quality_reasons(df: DataFrame, question: str, answer: str, order: list[str], least: int = 20, most: int = 1500, key_chars: int | None = None) -> DataFrame:
    """``df`` with ``reason``: why a pair is dropped, NULL if it is kept.

    The rules apply in turn: length, empty phrases, script, and last the exact
    repetition of an earlier kept pair (by ``order``). Only surviving pairs are
    compared for repetition, by the hash of their keys, cut to ``key_chars`` if given.
    """
    first = df.withColumn("reason", first_reason(answer_rules(F.col(question), F.col(answer), least, most)))
    key = F.sha2(F.concat(X.dedup_key(F.col(question), key_chars), F.lit("|"), X.dedup_key(F.col(answer), key_chars)), 256)
    # rows dropped already are spread by their own order instead of meeting under one key
    first = first.withColumn("_key", F.when(F.col("reason").isNull(), key).otherwise(F.sha2(F.concat_ws("|", *[F.col(o).cast("string") for o in order]), 224)))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    return first.withColumn("_n", nth).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("_n") > 1), "exact_qa_dup").otherwise(F.col("reason"))).drop("_key", "_n")


def drop_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """(reason, n): dropped rows by reason; kept rows under ``kept``."""
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def audit_log(df: DataFrame, columns: list[str], reason: str = "reason") -> DataFrame:
    """The dropped rows' columns with their reason."""
    return df.where(F.col(reason).isNotNull()).select(*columns, reason)


def stage_yield(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """One row: how many rows pass every stage up to each one, counted in one scan."""
    held, out = F.lit(True), [F.count("*").alias("rows")]
    for name, condition in stages:
        held = held & F.coalesce(condition, F.lit(False))
        out.append(F.count_if(held).alias(name))
    return df.agg(*out)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n): keys that occur more than once; NULL counts as a key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dependency_violations(df: DataFrame, left: str, right: Column) -> DataFrame:
    """(left, values): left values with more than one right value; NULL right values count as none."""
    return df.groupBy(left).agg(F.count_distinct(right).alias("values")).where("values > 1")


def needs_clarification(c: Column, vague: str = r"(?i)\b(?:something|somehow|maybe|not sure|weird|strange|what should i do|is this normal)\b") -> Column:
    """A short, a vague, or a short questioning text."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) < 40, True).when(F.rlike(t, F.lit(vague)), True).when(t.contains("?") & (F.length(t) < 70), True).otherwise(False)


def translation_checks(df: DataFrame, key: str, source: str, target: str, key_pattern: str | None = None) -> DataFrame:
    """(key, severity, check, detail): a row for each violated expectation of a translated cell.

    Blank cells fail ``blank`` only. Checked besides: key shape, digit runs, URLs,
    line breaks, question and exclamation marks (each kind by itself, where the
    source has any), length ratio and unchanged text.
    """
    s, t = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(target), F.lit(""))
    blank = X.strip(t) == ""
    ms, mt = X.mark_counts(s), X.mark_counts(t)
    asked, called = ((ms[k] > 0) & (ms[k] != mt[k]) for k in ("questions", "exclamations"))
    ratio = F.length(X.squeeze(t)) / F.length(X.squeeze(s))
    ls, lt = X.line_counts(s), X.line_counts(t)
    checks = [
        ("error", "blank", blank, F.lit("")),
        ("warning", "digits", ~blank & (X.digit_runs(s) != X.digit_runs(t)), F.concat_ws(" ", X.digit_runs(s))),
        ("error", "urls", ~blank & (X.urls(s) != X.urls(t)), F.concat_ws(" ", X.urls(s))),
        ("error", "lines", ~blank & (ls != lt), F.concat_ws("/", ls["breaks"], lt["breaks"])),
        ("warning", "marks", ~blank & (asked | called), F.concat_ws(" ", *[F.concat_ws("/", ms[k], mt[k]) for k in ("questions", "exclamations")])),
        ("warning", "length_ratio", ~blank & (F.length(X.squeeze(s)) >= 40) & ~ratio.between(0.35, 3.0), F.round(ratio, 2).cast("string")),
        ("error", "unchanged", ~blank & (X.squeeze(F.lower(s)) == X.squeeze(F.lower(t))), F.lit("")),
    ]
    if key_pattern:
        checks.append(("error", "key_shape", ~F.rlike(F.col(key), F.lit(key_pattern)), F.lit(key_pattern)))
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(a).alias("severity"), F.lit(b).alias("check"), d.alias("detail"))) for a, b, c, d in checks]), lambda x: x.isNotNull())
    return df.select(key, F.explode(found).alias("v")).select(key, "v.severity", "v.check", "v.detail")


def require_empty(df: DataFrame, message: str) -> None:
    """Fail unless the table is empty; one row is looked at."""
    if rows := df.limit(1).collect():
        raise ValueError(f"{message}: {rows[0].asDict()}")


def require_columns(df: DataFrame, expected: list[str], exact: bool = True) -> DataFrame:
    """``df`` if it has the expected columns, in order where ``exact``."""
    missing = [c for c in expected if c not in df.columns]
    if missing or exact and df.columns != expected:
        raise ValueError(f"columns {df.columns} are not {expected}")
    return df


def distinct_ratio(df: DataFrame, column: str) -> DataFrame:
    """(ratio): distinct values among the non-NULL ones; 0 without any."""
    return df.agg(F.coalesce(F.try_divide(F.count_distinct(column).cast("double"), F.count(column)), F.lit(0.0)).alias("ratio"))


def totals_or_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the sum of each column, NULL if any row lacks a value."""
    return df.agg(*[F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c) for c in columns])


def word_signal(c: Column, words: tuple[str, ...]) -> Column:
    """The share of a text's words that are in a list; NULL for texts of fewer than three words."""
    w = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}']+)"), F.lit(1))
    known = F.array(*[F.lit(x) for x in words])
    return F.when(F.size(w) >= 3, F.size(F.filter(w, lambda x: F.array_contains(known, x))) / F.size(w))
