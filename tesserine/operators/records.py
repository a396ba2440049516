"""Records of model runs: validation of sets, jobs by content, caches and re-parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as X
from tesserine.functions.modeljson import FLAG_FIELDS, TEXT_FIELDS, prediction
from tesserine.operators.dedup import first_per_key
from tesserine.operators.keyed import item_id, required_text
from tesserine.operators.quality import require_empty


def record_set_problems(df: DataFrame, key: str, group: list[str], expected: int | None = None, several_groups: bool = False) -> DataFrame:
    """(problem, n): what is wrong with a set of records, counted in two aggregations.

    ``blank_key`` rows, ``repeated_key`` keys, ``wrong_count`` (distinct keys, if not
    ``expected``) and ``mixed_groups`` (distinct groups, if more than one). An empty
    table has no problem but a wrong count.
    """
    blank = X.strip(F.coalesce(F.col(key).cast("string"), F.lit(""))) == ""
    keys = df.where(~blank).groupBy(key).agg(F.count("*").alias("c")).agg(F.count("*").alias("keys"), F.count_if(F.col("c") > 1).alias("repeated"))
    rest = df.agg(F.count_if(blank).alias("blank"), F.count_distinct(F.struct(*[F.coalesce(F.col(g).cast("string"), F.lit("")).alias(g) for g in group])).alias("groups"))
    found = [("blank_key", F.col("blank") > 0, F.col("blank"))] + ([] if several_groups else [("mixed_groups", F.col("groups") > 1, F.col("groups"))])
    of_keys = [("repeated_key", F.col("repeated") > 0, F.col("repeated"))] + ([] if expected is None else [("wrong_count", F.col("keys") != expected, F.col("keys"))])
    return _listed(rest, found).unionByName(_listed(keys, of_keys))


def _listed(one: DataFrame, problems: list[tuple[str, Column, Column]]) -> DataFrame:
    """(problem, n) for each problem that a one-row table has."""
    each = [F.when(c, F.struct(F.lit(name).alias("problem"), n.alias("n"))) for name, c, n in problems]
    return one.select(F.explode(F.array_compact(F.array(*each))).alias("p")).select("p.problem", "p.n")


def validate_record_set(df: DataFrame, key: str, group: list[str], expected: int | None = None, several_groups: bool = False) -> DataFrame:
    """``df``; fails if ``record_set_problems`` finds any."""
    require_empty(record_set_problems(df, key, group, expected, several_groups), "bad record set")
    return df


def successful_keys(scored: DataFrame, key: str, ok: str = "parse_ok") -> DataFrame:
    """(key): the keys with at least one record that parsed; blank keys never count."""
    return scored.where(F.col(ok) & (X.strip(F.coalesce(F.col(key), F.lit(""))) != "")).select(key).distinct()


def output_records(df: DataFrame, raw: str, texts: list[str], fallback: Column, model: Column, label: Column, language: Column) -> DataFrame:
    """The record of each answered row: identity, gold labels in their normal form, the raw output and the parsed prediction.

    The parser's fields win over input columns of the same name. A row without
    any text fails the query.
    """
    c = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    p = prediction(F.col(raw))
    return df.select(
        item_id(c("seed_id"), fallback, c("style"), language).alias("item_id"), c("seed_id").alias("seed_id"), F.coalesce(F.nullif(c("style"), F.lit("")), F.lit("canonical")).alias("style"),
        language.alias("language"), label.alias("model_label"), model.alias("model"), required_text([F.col(t) for t in texts], fallback).alias("input_text"),
        X.normalize_category(c("category")).alias("gold_category"), X.normalize_risk(c("gold_risk_level")).alias("gold_risk_level"),
        *[F.coalesce(c(n), F.lit("")).alias(n) for n in ("gold_action", "gold_condition")], F.lower(X.strip(F.coalesce(c("requires_clarification"), F.lit("")))).alias("requires_clarification"),
        F.col(raw).alias("raw_response"), p.alias("_p"),
    ).select("*", "_p.*").drop("_p")


def reparsed(df: DataFrame, raw: str, failed: Column) -> DataFrame:
    """``df`` (with the prediction's columns) where failed rows with a raw output are parsed again.

    A row that still fails stays as it was, as do all others; ``recovered`` says
    which ones changed. Only failed rows reach Python.
    """
    fields = [*TEXT_FIELDS, *FLAG_FIELDS, "error_kind", "error_detail", "json_repaired"]
    again = failed & (X.strip(F.coalesce(F.col(raw), F.lit(""))) != "")
    tried = df.where(again).withColumn("_p", prediction(F.col(raw))).withColumn("recovered", F.col("_p.error_kind") == "")
    tried = tried.withColumns({f: F.when(F.col("recovered"), F.col(f"_p.{f}")).otherwise(F.col(f)) for f in fields if f in df.columns}).drop("_p")
    return df.where(~F.coalesce(again, F.lit(False))).withColumn("recovered", F.lit(False)).unionByName(tried)


def job_key(kind: Column, text: Column, register: Column) -> Column:
    """``kind:digest`` of what makes a job: kind, text and register."""
    return F.concat(kind, F.lit(":"), F.sha2(F.to_json(F.struct(kind.alias("kind"), text.alias("text"), register.alias("style"))), 256))


def jobs(df: DataFrame, pos: str, parts: dict[str, tuple[str, Column]], carry: list[str]) -> DataFrame:
    """(key, kind, text, style, source_sha256, carry, rows): the distinct jobs of rows, each with its first row's values and how many rows need it.

    ``parts`` names for each kind the text column and its register; equal texts of
    one register are one job. NULL texts make none.
    """
    one = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("text"), r.alias("style")) for k, (c, r) in parts.items()]
    each = df.select(pos, *carry, F.explode(F.array(*one)).alias("j")).select(pos, *carry, "j.*").where("text IS NOT NULL")
    keyed = each.withColumn("key", job_key(F.col("kind"), F.col("text"), F.col("style")))
    first = F.min_by(F.struct("kind", "text", "style", *carry), F.col(pos))
    return keyed.groupBy("key").agg(first.alias("f"), F.count("*").alias("rows")).select("key", "f.kind", "f.text", "f.style", F.sha2("f.text", 256).alias("source_sha256"), *[f"f.{c}" for c in carry], "rows")


def from_cache(df: DataFrame, kind: str, text: str, register: Column, cache: DataFrame, out: str) -> DataFrame:
    """``df`` with the cached ``value`` of its job in ``out``; NULL where the cache has none or its source digest is another text's."""
    keyed = df.withColumn("_key", job_key(F.lit(kind), F.col(text), register)).withColumn("_sha", F.sha2(text, 256))
    known = cache.select(F.col("key").alias("_key"), F.col("source_sha256").alias("_of"), F.col("value").alias("_value"))
    return keyed.join(known, "_key", "left").withColumn(out, F.when(F.col("_sha") == F.col("_of"), F.col("_value"))).drop("_key", "_sha", "_of", "_value")


def smoke_subset(found: DataFrame, pos: str, kind: str = "question", others: tuple[str, int] = ("answer", 2)) -> DataFrame:
    """The first job of each style of one kind, and the first few of another kind."""
    a = first_per_key(found.where(F.col("kind") == kind), ["style"], [pos, "key"])
    return a.unionByName(found.where(F.col("kind") == others[0]).orderBy(pos, "key").limit(others[1]))


def response_problems(asked: DataFrame, answered: DataFrame, batch: str, key: str, value: str) -> DataFrame:
    """(batch, problem, n): ids that a batch's answer lacks, that it was not asked for, that it repeats or leaves blank."""
    a = asked.groupBy(batch, key).agg(F.lit(True).alias("_asked"))
    b = answered.groupBy(batch, key).agg(F.count("*").alias("_n"), F.count_if(X.strip(F.coalesce(value, F.lit(""))) == "").alias("_blank"))
    both = a.join(b, [batch, key], "full_outer")
    problems = [("missing", F.col("_n").isNull()), ("unknown", F.col("_asked").isNull()), ("repeated", F.col("_n") > 1), ("blank", F.col("_blank") > 0)]
    named = F.array_compact(F.array(*[F.when(c, n) for n, c in problems]))
    return both.select(batch, F.explode(named).alias("problem")).groupBy(batch, "problem").agg(F.count("*").alias("n"))


def judged_inputs(df: DataFrame, text: str, reply: str, text_chars: int = 2000, reply_chars: int = 4000) -> DataFrame:
    """Rows with a reply that is not blank; ``text`` and ``reply`` cut to what the judge is shown."""
    shown = df.where(X.strip(F.coalesce(F.col(reply), F.lit(""))) != "")
    return shown.withColumns({text: F.substring(text, 1, text_chars), reply: F.substring(reply, 1, reply_chars)})
