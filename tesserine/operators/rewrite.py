"""Prompts, chat records, style variants and rule-based corrections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as X


def render(template: str, values: dict[str, Column]) -> Column:
    """The template with each ``{name}`` replaced; NULL values become empty."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def chat_record(question: Column, answer: Column, system: str | Column | None = None) -> Column:
    """JSON text of a user and an assistant message, trimmed, after an optional system message."""
    says = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    turns = [says("user", X.strip(question)), says("assistant", X.strip(answer))]
    return F.to_json(F.struct(F.array(*([says("system", system if isinstance(system, Column) else F.lit(system))] if system is not None else []), *turns).alias("messages")))


def json_target(fields: dict[str, Column]) -> Column:
    """JSON text of an object with these fields; NULL fields are kept."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def variants(df: DataFrame, styles: dict[str, Column], style: str = "style", text: str = "text") -> DataFrame:
    """Each row once for every style, with the style's text."""
    return df.withColumn("_v", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), c.alias("t")) for s, c in styles.items()]))).select("*", F.col("_v.s").alias(style), F.col("_v.t").alias(text)).drop("_v")


def prefixed(openers: list[str], pos: Column, c: Column) -> Column:
    """The text after an opener that rotates with the position."""
    return F.concat(F.element_at(F.array(*[F.lit(o) for o in openers]), (pos % len(openers) + 1).cast("int")), c)


def redact_first(c: Column, terms: Column, stand_in: str) -> Column:
    """The text with the first occurrence of its longest term (four letters at least), an article before it included, replaced."""
    longest = F.array_sort(F.filter(terms, lambda t: (F.length(t) >= 4) & F.lower(c).contains(F.lower(t))), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    term = F.get(longest, 0)
    quoted = F.concat(F.lit(r"(?i)(?:\b(?:a|an|the) )?\Q"), F.replace(term, F.lit("\\E"), F.lit("")), F.lit(r"\E"))
    at = F.regexp_instr(c, quoted)
    cut = F.length(F.regexp_substr(c, quoted))
    return F.when(term.isNull() | (at == 0), c).otherwise(F.concat(F.substring(c, 1, at - 1), F.lit(stand_in), F.substring(c, at + cut, F.length(c))))


def redaction_terms(topic: Column, keywords: Column, least: int = 4) -> Column:
    """The topic and the comma-separated keywords of at least so many characters, longest first, then in order."""
    words = F.transform(F.concat(F.array(F.coalesce(topic, F.lit(""))), F.split(F.coalesce(keywords, F.lit("")), ",")), X.strip)
    kept = F.array_distinct(F.filter(words, lambda t: F.length(t) >= least))
    return F.array_sort(kept, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def blurred(c: Column, topic: Column, keywords: Column, stand_in: str, ending: str, least: int = 20, words: int = 25) -> Column:
    """A vague form of a question: its longest redaction term replaced, the first sentence of ``least`` characters or else the first ``words`` words, and an ending.

    The sentence gets a question mark if it has no final mark.
    """
    q = redact_first(X.strip(F.coalesce(c, F.lit(""))), redaction_terms(topic, keywords), stand_in)
    parts = F.transform(F.split(q, r"(?<=[.!?])\s+"), X.strip)
    long = F.get(F.filter(parts, lambda s: F.length(s) >= least), 0)
    each = F.filter(F.split(q, r"(?U)\s+"), lambda w: w != "")
    cut = F.concat(F.array_join(F.slice(each, 1, words), " "), F.when(F.size(each) > words, "...").otherwise(""))
    core = F.coalesce(long, cut)
    return F.concat(F.when(F.rlike(core, F.lit(r"[?.!]$")), core).otherwise(F.concat(core, F.lit("?"))), F.lit(ending))


def claims(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """The labels of the patterns that the text matches, in their order, each once; those inside another one are left out."""
    found = F.array_distinct(F.array_compact(F.array(*[F.when(F.rlike(F.coalesce(c, F.lit("")), F.lit(f"(?i){p}")), label) for p, label in patterns])))
    inside = lambda x: F.exists(found, lambda o: (F.lower(o) != F.lower(x)) & F.lower(o).contains(F.lower(x)))
    return F.filter(found, lambda x: ~inside(x))


def in_words(items: Column, most: int, nothing: str) -> Column:
    """The first items as ``a``, ``a and b`` or ``a, b, and c``; ``nothing`` for none."""
    kept = F.slice(items, 1, most)
    n = F.size(kept)
    many = F.concat(F.array_join(F.slice(kept, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(kept, -1))
    return F.when(n == 0, nothing).when(n == 1, kept[0]).when(n == 2, F.array_join(kept, " and ")).otherwise(many)


def route(c: Column, rules: list[tuple[str, str, str | None]], otherwise: str) -> Column:
    """Struct of the name and the URL of the first rule (pattern, name, URL) that matches, and whether there is no URL to go by."""
    out = F.struct(F.lit(otherwise).alias("name"), F.lit(None).cast("string").alias("url"), F.lit(True).alias("open"))
    for pattern, name, url in reversed(rules):
        out = F.when(F.rlike(F.coalesce(c, F.lit("")), F.lit(f"(?i){pattern}")), F.struct(F.lit(name).alias("name"), F.lit(url).cast("string").alias("url"), F.lit(url is None).alias("open"))).otherwise(out)
    return out


@dataclass(frozen=True)
class Rule:
    """A literal replacement in one column, for some keys or all, with the counts it must have.

    With ``shared`` it reaches all rows that share the value of that column with one of its keys.
    """

    rule_id: str
    column: str
    old: str
    new: str
    keys: tuple[str, ...] = ()
    cells: int | None = None
    replacements: int | None = None
    shared: str | None = None


def apply_rules(df: DataFrame, key: str, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(corrected rows, one row with the cells and replacements of each rule); rules see what earlier ones wrote."""
    out, counts = df, []
    for r in rules:
        hit = F.col(key).isin(*r.keys) if r.keys else F.lit(True)
        if r.shared and r.keys:
            same = df.where(hit & F.col(r.shared).isNotNull()).select(F.col(r.shared).alias(f"_s_{r.rule_id}")).distinct().withColumn(f"_h_{r.rule_id}", F.lit(True))
            out = out.join(same, F.col(r.shared) == F.col(f"_s_{r.rule_id}"), "left")
            hit = hit | F.coalesce(F.col(f"_h_{r.rule_id}"), F.lit(False))
        c = F.coalesce(F.col(r.column), F.lit(""))
        n = F.when(hit, (F.length(c) - F.length(F.replace(c, F.lit(r.old), F.lit("")))) / len(r.old)).otherwise(0).cast("long")
        out = out.withColumn(f"_n_{r.rule_id}", n).withColumn(r.column, F.when(hit, F.replace(F.col(r.column), F.lit(r.old), F.lit(r.new))).otherwise(F.col(r.column)))
        counts += [F.count_if(F.col(f"_n_{r.rule_id}") > 0).alias(f"{r.rule_id}_cells"), F.sum(f"_n_{r.rule_id}").alias(f"{r.rule_id}_replacements")]
    return out.drop(*[f"_{x}_{r.rule_id}" for r in rules for x in "nsh"]), out.agg(*counts)


def require_counts(counts: DataFrame, rules: list[Rule]) -> None:
    """Fail unless every rule changed as many cells and places as it must."""
    row = counts.first().asDict()
    for r in rules:
        for what, want in (("cells", r.cells), ("replacements", r.replacements)):
            if want is not None and (row[f"{r.rule_id}_{what}"] or 0) != want:
                raise ValueError(f"rule {r.rule_id}: {row[f'{r.rule_id}_{what}']} {what}, expected {want}")


def trim_line_ends(c: Column) -> Column:
    """Without blanks before line breaks."""
    return F.regexp_replace(c, r"[ \t]+(?=\r?\n)", "")


def plain_escapes(c: Column) -> Column:
    """Literal no-break-space escapes as spaces, stray escaped quotes as quotes, straight apostrophes between letters as typographic ones."""
    t = F.replace(F.replace(c, F.lit("\\u00a0"), F.lit(" ")), F.lit('\\"'), F.lit('"'))
    return F.regexp_replace(t, r"(?U)(?<=\p{L})'(?=\p{L})", "’")
