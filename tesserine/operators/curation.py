"""Labels, tiers, targets and training mixtures made from rules that the caller gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserine.functions import text as X
from tesserine.operators import rewrite, sample
from tesserine.operators.keyed import numbered


# Markers of the three levels of urgency, in order of precedence.
URGENCY = (
    ("high", ("999", "a&e", "emergency", "urgent gp", "urgent appointment", "immediately", "straight away")),
    ("moderate", ("see a gp", "see your gp", "speak to a gp", "speak to your gp", "gp appointment", "see a doctor", "talk to your doctor", "talk to a doctor", "contact a gp", "medical review")),
)
LEVELS = ("low", "moderate", "high")
# Narrower topics and the category that stands for them.
NARROWER = {"menstruation": "menstrual", "menarche": "menstrual", "menopause": "menstrual", "pms": "menstrual"}


def urgency(c: Column) -> Column:
    """``high``, ``moderate`` or ``low`` by the markers in the text; the highest wins."""
    return X.first_tier(c, list(URGENCY), "low")


def rank_of(level: Column, levels: tuple[str, ...] = LEVELS) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in levels]), level) - 1


def highest(*levels: Column, names: tuple[str, ...] = LEVELS) -> Column:
    """The highest of some levels; NULL ones do not count."""
    ranks = [rank_of(x, names) for x in levels]
    top = ranks[0] if len(ranks) == 1 else F.greatest(*ranks)
    return F.element_at(F.array(*[F.lit(x) for x in names]), (top + 1).cast("int"))


def clamp_category(c: Column, allowed: tuple[str, ...] = ("menstrual", "pcos", "fertility", "other"), narrower: dict[str, str] = NARROWER) -> Column:
    """The normal category if it is allowed, the one its narrower name stands for, else ``other``."""
    name = X.normalize_category(c)
    out = F.when(name.isin(*allowed), name)
    for k, v in narrower.items():
        out = out.when(name == k, v)
    return out.otherwise("other")


def degenerate_rewrite(style: Column, text: Column) -> Column:
    """Whether an ambiguous rewrite has lost its content: it asks about ``something`` and says it is not really sure."""
    t = F.coalesce(text, F.lit(""))
    return (F.lower(X.strip(F.coalesce(style, F.lit("")))) == "ambiguous") & F.rlike(t, F.lit(r"(?i)\bsomething\b")) & F.lower(t).contains("not really sure")


def drop_by_source(df: DataFrame, source: DataFrame, key: str, bad: Column) -> DataFrame:
    """``df`` without the keys that ``source``, the same rows in their first language, shows to be bad."""
    return df.join(source.where(bad).select(key).distinct(), key, "left_anti")


def labelled(df: DataFrame, answer: str, style: str, risk: list[tuple[str, tuple[str, ...]]], default: str = "routine", vague: str = "ambiguous") -> DataFrame:
    """``df`` with ``gold_risk_level``, by the first tier whose markers the answer holds, and ``requires_clarification``, ``yes`` for the vague style."""
    asks = F.lower(X.strip(F.coalesce(style, F.lit("")))) == vague
    return df.withColumns({"gold_risk_level": X.first_tier(F.col(answer), risk, default), "requires_clarification": F.when(asks, "yes").otherwise("no")})


def bucket(c: Column, rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds; a NULL condition does not."""
    out = F.lit(otherwise)
    for name, condition in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def set_number(c: Column) -> Column:
    """A set's number as text: ``1`` for ``1.0``; empty for NULL, blank and ``nan``; other text as it is."""
    t = X.strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.when((t == "") | (F.lower(t) == "nan"), "").otherwise(F.coalesce(t.try_cast("double").cast("long").cast("string"), t))


def with_status(df: DataFrame, key: str, promoted: DataFrame, yes: str, no: str, name: str = "status") -> DataFrame:
    """``df`` with ``name``: whether the key is among the promoted ones."""
    known = promoted.select(key).distinct().withColumn("_yes", F.lit(True))
    return df.join(known, key, "left").withColumn(name, F.when(F.col("_yes"), yes).otherwise(no)).drop("_yes")


def seed_keys(seeds: DataFrame, key: str, order: list[str], answers: DataFrame, answer_key: str, answer: str) -> tuple[DataFrame, DataFrame]:
    """((key), (hash)): the row keys of seeds, and the fingerprints of the answers that their rows have; of a seed the last row by ``order`` counts."""
    last = seeds.groupBy(key).agg(F.max_by(F.col(answer_key), F.struct(*order)).alias(answer_key))
    prints = last.join(answers.select(answer_key, X.fingerprint(F.col(answer)).alias("hash")), answer_key).where(F.col("hash") != X.fingerprint(F.lit("")))
    return last.select(answer_key).distinct(), prints.select("hash").distinct()


def passages(pages: DataFrame, sources: DataFrame, slug: str) -> DataFrame:
    """(condition, source_url, heading, text): the sections of pages (slug, sections) with the condition and URL of their source."""
    return pages.select(slug, F.posexplode("sections").alias("pos", "s")).join(sources.select(slug, "condition", F.col("url").alias("source_url")), slug).select("condition", "source_url", "pos", "s.heading", "s.text")


def tiers(df: DataFrame, text: Column, tables: dict[str, list[tuple[str, float]]], clear: float, borderline: float, gates: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``category``, ``tier``, ``score`` and ``notes``: a row for each category whose patterns do not reject the text, so none to all of them.

    A category's gate, where there is one, must hold for its ``clear`` tier.
    """
    scored = []
    for name, patterns in tables.items():
        s = X.weighted_score(text, patterns)
        clear_enough = (s["score"] >= clear) & (gates or {}).get(name, F.lit(True))
        tier = F.when(clear_enough, "clear").when(s["score"] >= borderline, "borderline")
        scored.append(F.when(tier.isNotNull(), F.struct(F.lit(name).alias("category"), tier.alias("tier"), s["score"].alias("score"), s["notes"].alias("notes"))))
    return df.withColumn("_t", F.explode(F.array_compact(F.array(*scored)))).select("*", "_t.*").drop("_t")


def targets(df: DataFrame, by: str, eligible: Column, steps: list[tuple[int, int]]) -> DataFrame:
    """(by, eligible, target): the target of the first step whose least number of eligible rows a group has; else all it has."""
    n = df.groupBy(by).agg(F.count_if(eligible).alias("eligible"))
    out = reduce(lambda acc, step: F.when(F.col("eligible") >= step[0], step[1]).otherwise(acc), sorted(steps), F.col("eligible"))
    return n.withColumn("target", out.cast("long"))


def exclusive(df: DataFrame, text_key: Column, order: list[tuple[str, str]], by: str, rank: str, wanted: dict[str, int]) -> DataFrame:
    """Up to ``wanted`` rows of each category, none of whose texts an earlier category holds: a text goes to the first of its categories in the given order.

    ``order`` pairs a category with its place. The rows of a category that lost a
    text to an earlier one are topped up by its next ones.
    """
    place = reduce(lambda acc, x: F.when(F.col(by) == x[0], F.lit(x[1])).otherwise(acc), order, F.lit(None).cast("string"))
    keyed = df.withColumn("_key", text_key).withColumn("_place", place).where("_place IS NOT NULL")
    once = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("_place", rank))).where("_n = 1").drop("_n")
    most = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    return once.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(rank, "_key"))).where(F.col("_r") <= F.try_element_at(most, F.col(by))).drop("_key", "_place", "_r")


def seed_ids(df: DataFrame, by: str, order: list[str], prefixes: dict[str, str], width: int = 3) -> DataFrame:
    """``df`` with ``seed_id``: the category's prefix and its rows numbered from 1."""
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv]), F.col(by))
    return sample.numbered_rows(df, by, order, "_n").withColumn("seed_id", F.concat(prefix, F.lit("-"), numbered(F.col("_n"), width))).drop("_n")


def evidence_table(spark, bundle: DataFrame) -> DataFrame:
    """(key, condition, url, pos, heading, text): the sections of an evidence bundle (key, condition, url, sections), one row each."""
    return bundle.select("key", "condition", "url", F.posexplode("sections").alias("pos", "s")).select("key", "condition", "url", "pos", "s.heading", "s.text")


def evidence_actions(evidence: DataFrame, heading: str, chars: int = 200, quote: int = 300) -> DataFrame:
    """(url, key, action, quote): of each page the first section whose heading matches, else the first one, cut; of pages with one URL the first key."""
    hit = F.rlike("heading", F.lit(heading))
    best = F.min_by(F.struct(hit.alias("hit"), X.strip(F.col("text")).alias("t"), "condition"), F.struct((~hit).alias("miss"), "pos"))
    each = evidence.groupBy("url", "key").agg(best.alias("b"))
    first = each.groupBy("url").agg(F.min_by(F.struct("key", "b"), F.col("key")).alias("x")).select("url", "x.key", "x.b")
    action = F.when(F.col("b.hit"), F.substring("b.t", 1, chars)).otherwise(F.concat(F.lit("discuss: "), F.col("b.condition")))
    return first.select("url", "key", action.alias("action"), F.substring("b.t", 1, quote).alias("quote"))


def grounded(df: DataFrame, condition: str, evidence: DataFrame, heading: str) -> DataFrame:
    """``df`` with ``source_url``, ``action``, ``quote`` and ``grounding``: ``grounded``, ``page_missing`` (a URL that no page has) or ``needs_grounding``.

    The condition reads ``name | url``; what stands behind the last bar is the URL.
    """
    url = F.when(F.col(condition).contains("|"), X.strip(F.substring_index(F.col(condition), "|", -1))).otherwise("")
    rows = df.withColumn("source_url", F.coalesce(url, F.lit("")))
    actions = evidence_actions(evidence, heading).select(F.col("url").alias("source_url"), "action", "quote")
    joined = rows.join(actions, "source_url", "left")
    return joined.withColumn("grounding", F.when(F.col("action").isNotNull(), "grounded").when(F.col("source_url") != "", "page_missing").otherwise("needs_grounding"))


def evidence_text(evidence: DataFrame, by: str, separator: str = "\n\n") -> DataFrame:
    """(by, text): the sections of each group's pages, in order, headings before them."""
    part = F.struct("key", "pos", F.concat(F.col("heading"), F.lit("\n"), F.col("text")).alias("t"))
    return evidence.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), separator).alias("text"))


def json_training_record(question: Column, answer: Column, category: Column, risk: Column, ask: Column, clarifying: Column, prompt: str, answer_chars: int | None = None) -> Column:
    """JSON text of a chat whose answer is the eight-field prediction object.

    Where ``ask`` holds the object asks ``clarifying`` instead of answering. The
    response is the whole answer unless ``answer_chars`` cuts it.
    """
    a = X.strip(answer)
    said = a if answer_chars is None else F.substring(a, 1, answer_chars)
    pick = lambda yes, no: F.when(ask, yes).otherwise(no)
    # fixed values: the target of a question too vague to answer
    target = rewrite.json_target({
        "predicted_category": clamp_category(category), "interpreted_symptom": pick(F.lit("The description is too vague to interpret confidently"), X.first_sentence(a)), "predicted_risk": pick(F.lit("see-doctor"), risk),
        "recommended_action": pick(F.lit("Ask for more detail, then advise consulting a clinician"), X.first_sentence(a)), "asks_clarification": ask, "clarifying_question": pick(clarifying, F.lit("")),
        "unsafe_response": F.lit(False), "response_text": pick(clarifying, said),
    })
    turns = [F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("user", rewrite.render(prompt, {"text": X.strip(question)})), ("assistant", target))]
    return F.to_json(F.struct(F.array(*turns).alias("messages")))


def clarification_record(question: Column, reply: Column, register: Column, target: Column, prompt: str) -> Column:
    """JSON text of a chat that asks back: in the ``json`` register the prompt and the target object, else question and reply as they are."""
    user = F.when(register == "json", rewrite.render(prompt, {"text": question})).otherwise(question)
    turns = [F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("user", user), ("assistant", F.when(register == "json", target).otherwise(reply)))]
    return F.to_json(F.struct(F.array(*turns).alias("messages")))


def rewritten_examples(rewrites: DataFrame, train: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """``rewrites`` with ``keep`` columns of their source row. Those whose source is not in ``train`` are left out: no answer of another split comes in."""
    return rewrites.join(train.select(key, *keep), key)


def training_mix(train: DataFrame, val: DataFrame, clarifications: DataFrame, rewrites: DataFrame, key: str, by: str, per_group: int, probe_rows: int, probe_clarifications: int, seed: int) -> dict[str, DataFrame]:
    """``train`` and ``probe`` as (component, key, by).

    Train: every training row as ``chat``, ``per_group`` of each group as ``json``,
    the clarifications that the probe does not hold, and the rewrites of training
    rows. Probe: rows of val and the first clarifications in seeded order, so the
    two never share one.
    """
    ranked = sample.ranked(clarifications.select(key, by), sample.seeded(F.col(key), seed), [key], "_r")
    parts = [
        ("chat", train), ("json", sample.sample_per_group(train, by, key, per_group, seed)),
        ("clarification", ranked.where(F.col("_r") > probe_clarifications)), ("style", rewritten_examples(rewrites.select(key), train, key, [by])),
    ]
    probes = [("triage", val.orderBy(sample.seeded(F.col(key), seed), key).limit(probe_rows)), ("clarification", ranked.where(F.col("_r") <= probe_clarifications))]
    union = lambda named: reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("component"), key, by) for n, df in named))
    return {"train": union(parts), "probe": union(probes)}
