"""Registered queries of run records, handoffs and curation, with the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text as X
from tesserine.functions.modeljson import judge_scores
from tesserine.operators import curation, handoff, keyed, leakage, metrics, quality, records, rewrite, sample
from tesserine.plans.catalogue import _MEASURES, _NORM_C, _NORM_R, _SCORED, _SQUEEZE_ALL, _STRIP, query, scored
from tesserine.runtime import new_path, table
from tesserine.sources import files

# --- run records -------------------------------------------------------------


@query("""WITH g AS (SELECT pred_id AS k, count(*) AS c FROM predictions GROUP BY 1), p AS (SELECT count(*) AS keys, count_if(c > 1) AS repeated FROM g), r AS (SELECT count_if(coalesce(trim(pred_id), '') = '') AS blank, count(DISTINCT (model_label, model, language)) AS groups FROM predictions)
SELECT problem, n FROM (SELECT unnest(['blank_key', 'repeated_key', 'wrong_count', 'mixed_groups']) AS problem, unnest([blank, repeated, CASE WHEN keys <> 540 THEN keys ELSE 0 END, CASE WHEN groups > 1 THEN groups ELSE 0 END]) AS n FROM p, r) WHERE n > 0""")
def record_set_problems(spark: SparkSession, d: str) -> DataFrame:
    """What keeps the predictions from being one run over the 540 items."""
    return records.record_set_problems(table(spark, d, "predictions"), "pred_id", ["model_label", "model", "language"], 540)


@query(_SCORED + "SELECT model_label, count(DISTINCT item_id) AS items FROM z WHERE ok AND trim(item_id) <> '' GROUP BY 1")
def successful_items(spark: SparkSession, d: str) -> DataFrame:
    """Items by model that need no further run."""
    rows = scored(spark, d).select("model_label", "item_id", "parse_ok")
    key = F.to_json(F.struct("model_label", "item_id"))
    done = records.successful_keys(rows.where(X.strip("item_id") != "").withColumn("key", key), "key")
    return done.groupBy(F.get_json_object("key", "$.model_label").alias("model_label")).agg(F.count("*").alias("items"))


@query(_SCORED + """SELECT DISTINCT coalesce(nullif(seed_id, ''), pred_id) || '_' || coalesce(nullif(style, ''), 'canonical') || '_' || language AS item_id, gc AS gold_category, gr AS gold_risk_level, coalesce(gold_condition, '') AS gold_condition,
CASE WHEN ok THEN nc END AS predicted_category, CASE WHEN ok THEN nr END AS predicted_risk, CASE WHEN ok THEN asks END AS asks_clarification FROM z""")
def output_records(spark: SparkSession, d: str) -> DataFrame:
    """Records assembled anew from the rows and their raw outputs."""
    rows = table(spark, d, "predictions").withColumnRenamed("gold_category", "category")
    out = records.output_records(rows, "raw_response", ["input_text"], F.col("pred_id"), F.col("model"), F.col("model_label"), F.col("language"))
    return out.select("item_id", "gold_category", "gold_risk_level", "gold_condition", "predicted_category", "predicted_risk", "asks_clarification").distinct()


@query(_SCORED + """SELECT model_label, count_if(NOT json_valid(raw_response) IS TRUE) AS failed, count_if(NOT json_valid(raw_response) IS TRUE AND ok) AS recovered FROM z GROUP BY 1""")
def reparsed_failures(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose raw output is no JSON by itself, and how many of them a second, tolerant parse recovers."""
    rows = table(spark, d, "predictions").select("model_label", "raw_response", F.lit(None).cast("string").alias("predicted_category"), F.lit("malformed_json").alias("error_kind"))
    failed = F.try_parse_json("raw_response").isNull()
    return records.reparsed(rows.withColumn("failed", failed), "raw_response", F.col("failed")).groupBy("model_label").agg(F.count_if("failed").alias("failed"), F.count_if("recovered").alias("recovered"))


_JOBS = """WITH r AS (SELECT DISTINCT row_id, Question, Answer, coalesce(Style, '') AS style FROM filtered), e AS (SELECT row_id, 'question' AS kind, Question AS text, style FROM r UNION ALL SELECT row_id, 'answer', Answer, 'answer' FROM r),
j AS (SELECT kind, text, style, min(row_id) AS first_id, count(*) AS rows FROM e WHERE text IS NOT NULL GROUP BY ALL)"""


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filtered").select("row_id", "Question", "Answer", F.coalesce("Style", F.lit("")).alias("Style")).distinct()
    return records.jobs(rows.withColumn("first_id", F.col("row_id")), "row_id", {"question": ("Question", F.col("Style")), "answer": ("Answer", F.lit("answer"))}, ["first_id"])


@query(_JOBS + " SELECT kind, style, sha256(text) AS source_sha256, first_id, rows FROM j")
def distinct_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Questions by style and answers of any style, each text once."""
    return _jobs(spark, d).select("kind", "style", "source_sha256", "first_id", "rows")


@query(_JOBS + """, q AS (SELECT *, row_number() OVER (PARTITION BY kind, style ORDER BY first_id, text) AS i, row_number() OVER (PARTITION BY kind ORDER BY first_id, text) AS k FROM j)
SELECT kind, style, first_id FROM q WHERE (kind = 'question' AND i = 1) OR (kind = 'answer' AND k <= 2)""")
def smoke_jobs(spark: SparkSession, d: str) -> DataFrame:
    return records.smoke_subset(_jobs(spark, d), "first_id").select("kind", "style", "first_id")


@query("""WITH c AS (SELECT DISTINCT Question FROM filtered WHERE Question IS NOT NULL AND split <> 'train'), r AS (SELECT DISTINCT row_id, split, Question FROM filtered)
SELECT split, count(*) AS rows, count(c.Question) AS cached FROM r LEFT JOIN c ON r.Question = c.Question GROUP BY split""")
def cached_results(spark: SparkSession, d: str) -> DataFrame:
    """Rows by split whose question has a result in the cache of the evaluation splits."""
    rows = table(spark, d, "filtered").select("row_id", "split", "Question").distinct()
    done = records.jobs(rows.where("split <> 'train'"), "row_id", {"question": ("Question", F.lit("plain"))}, []).select("key", "source_sha256", F.lit("done").alias("value"))
    return records.from_cache(rows, "question", "Question", F.lit("plain"), done, "result").groupBy("split").agg(F.count("*").alias("rows"), F.count("result").alias("cached"))


@query("""WITH a AS (SELECT DISTINCT split, row_id FROM filtered), b AS (SELECT split, row_id, count(*) AS n, count_if(coalesce(trim(Answer_translated), '') = '') AS blank FROM translation_handoff GROUP BY ALL),
j AS (SELECT coalesce(a.split, b.split) AS split, unnest([CASE WHEN b.n IS NULL THEN 'missing' END, CASE WHEN a.row_id IS NULL THEN 'unknown' END, CASE WHEN b.n > 1 THEN 'repeated' END, CASE WHEN b.blank > 0 THEN 'blank' END]) AS problem FROM a FULL JOIN b ON a.split = b.split AND a.row_id = b.row_id)
SELECT split, problem, count(*) AS n FROM j WHERE problem IS NOT NULL GROUP BY ALL""")
def response_problems(spark: SparkSession, d: str) -> DataFrame:
    """The handoff as the answer to a request for all rows: missing, unknown, repeated and blank ids."""
    return records.response_problems(table(spark, d, "filtered"), table(spark, d, "translation_handoff"), "split", "row_id", "Answer_translated")


@query(_SCORED + f"""SELECT 'parse_ok_rate' AS measure, 'all' AS value, round(count_if(ok) / count(*), 6) AS number FROM z
UNION ALL SELECT 'risk_majority', 'all', round(max(c) / sum(c), 6) FROM (SELECT gr, count(*) AS c FROM z GROUP BY 1)
UNION ALL SELECT 'misunderstanding', 'all', round(count_if(ok AND NOT cc) / nullif(count_if(ok), 0), 6) FROM z
UNION ALL SELECT 'misunderstanding_strict', 'all', round((count_if(ok AND NOT cc) + count_if(NOT ok)) / count(*), 6) FROM z
UNION ALL SELECT 'under_triage', 'all', round(count_if(nr = 'routine') / count(*), 6) FROM z WHERE ok AND gr = 'see-doctor'
UNION ALL SELECT 'over_triage', 'all', round(count_if(nr = 'urgent') / count(*), 6) FROM z WHERE ok AND gr = 'see-doctor'
UNION ALL SELECT 'clarification_recall', 'all', round(count_if(wants AND asks) / nullif(count_if(wants), 0), 6) FROM z WHERE ok
UNION ALL SELECT 'clarification_specificity', 'all', round(count_if(NOT wants AND NOT asks) / nullif(count_if(NOT wants), 0), 6) FROM z WHERE ok
UNION ALL SELECT 'recall', gr, round(count_if(nr = gr) / count(*), 6) FROM z WHERE ok AND gr IN ('routine', 'see-doctor', 'urgent') GROUP BY gr""")
def analysis_bundle(spark: SparkSession, d: str) -> DataFrame:
    """(measure, value, number): all safety measures of the predictions, parsed once."""
    return metrics.analysis(scored(spark, d)).withColumn("number", F.round("number", 6))


# --- handoffs ----------------------------------------------------------------


@query("""WITH r AS (SELECT DISTINCT * FROM translation_handoff), c AS (SELECT split AS value, count(*) AS found FROM r GROUP BY 1), w AS (SELECT unnest(['train', 'val', 'test']) AS value, unnest([480, 120, 10]) AS expected)
SELECT 'split' AS "check", coalesce(c.value, w.value) AS value, coalesce(found, 0) AS found, coalesce(expected, 0)::BIGINT AS expected FROM c FULL JOIN w ON c.value = w.value WHERE coalesce(found, 0) <> coalesce(expected, 0)
UNION ALL SELECT 'rows', 'all', count(*), 610 FROM r HAVING count(*) <> 610""")
def handoff_counts(spark: SparkSession, d: str) -> DataFrame:
    return handoff.count_problems(table(spark, d, "translation_handoff").distinct(), "split", {"train": 480, "val": 120, "test": 10})


@query(f"""WITH r AS (SELECT row_id, split, coalesce(Question, '') AS q FROM translation_handoff), e AS (SELECT row_id, min(coalesce(Question, '')) AS q FROM filtered WHERE split <> 'test' GROUP BY 1),
s AS (SELECT 'repeated_key' AS "check", (SELECT count(*) FROM (SELECT row_id FROM r GROUP BY 1 HAVING count(*) > 1)) AS n UNION ALL SELECT 'key_shape', (SELECT count(*) FROM r WHERE NOT regexp_matches(row_id, '^(train|val)-[0-9]{{8}}$'))
UNION ALL SELECT 'key_split', (SELECT count(*) FROM r WHERE regexp_matches(row_id, '^(train|val)-[0-9]{{8}}$') AND NOT starts_with(row_id, split || '-')) UNION ALL SELECT 'unknown_key', (SELECT count(*) FROM r WHERE row_id NOT IN (SELECT row_id FROM e))
UNION ALL SELECT 'missing_key', (SELECT count(*) FROM e WHERE row_id NOT IN (SELECT row_id FROM r)) UNION ALL SELECT 'changed_Question', (SELECT count(*) FROM r JOIN e USING (row_id) WHERE r.q <> e.q)) SELECT * FROM s WHERE n > 0""")
def handoff_identity(spark: SparkSession, d: str) -> DataFrame:
    """The handoff against the rows of filtered with the same ids."""
    expected = table(spark, d, "filtered").where("split <> 'test'")
    return handoff.identity_problems(table(spark, d, "translation_handoff"), expected, "row_id", "split", r"^(train|val)-[0-9]{8}$", ["Question"])


_HAS = r"regexp_matches({0}, '(^|[^\p{{L}}\p{{N}}_]){1}([^\p{{L}}\p{{N}}_]|$)')"
_ACRONYM_SQL = " UNION ALL ".join(
    f"SELECT row_id, '{wanted}' AS acronym, NOT {_HAS.format('t', wanted)} AS missing, {' OR '.join(_HAS.format('t', x) for x in sources)} AS kept FROM c WHERE ({' OR '.join(_HAS.format('s', x) for x in sources)})" for sources, wanted in handoff.ACRONYMS
)


@query(f"""WITH c AS (SELECT DISTINCT row_id, coalesce(Question, '') AS s, coalesce(Question_translated, '') AS t FROM translation_handoff WHERE NOT regexp_matches(coalesce(Question, '') || coalesce(Question_translated, ''), 'https?://')), a AS ({_ACRONYM_SQL})
SELECT row_id, acronym, missing, kept FROM a WHERE missing OR kept""")
def acronym_problems(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "translation_handoff").select("row_id", "Question", "Question_translated").distinct()
    rows = rows.where(~F.rlike(F.concat(F.coalesce("Question", F.lit("")), F.coalesce("Question_translated", F.lit(""))), F.lit("https?://")))
    return handoff.acronym_problems(rows, "row_id", "Question", "Question_translated")


_OWN, _FOREIGN = ("le", "la", "les", "des", "et", "un", "une", "vous", "est", "pour", "dans", "votre"), ("the", "and", "of", "to", "your", "is", "for", "with", "you", "in", "that", "if")


@query(rf"""WITH w AS (SELECT row_id, regexp_extract_all(lower(coalesce(Answer_translated, '')), '[a-zà-öø-ÿ'']+') AS w FROM (SELECT DISTINCT row_id, Answer_translated FROM translation_handoff)),
s AS (SELECT row_id, len(list_filter(w, lambda x: list_contains({list(_OWN)}, x))) AS own, len(list_filter(w, lambda x: list_contains({list(_FOREIGN)}, x))) AS alien FROM w WHERE len(w) >= 3)
SELECT count(*) AS cells, count_if(alien >= 2 AND alien > own) AS look_foreign, round(coalesce(sum(own) / nullif(sum(own + alien), 0), 0), 6) AS signal FROM s""")
def language_signals(spark: SparkSession, d: str) -> DataFrame:
    """Translated answers that look untranslated, and the share of French among recognised words."""
    s = handoff.language_signals(table(spark, d, "translation_handoff").select("row_id", "Answer_translated").distinct(), "row_id", "Answer_translated", _OWN, _FOREIGN)
    return s.agg(F.count("*").alias("cells"), F.count_if("looks_foreign").alias("look_foreign"), F.round(handoff.signal_share(), 6).alias("signal"))


@query(f"""SELECT DISTINCT row_id, sha256({_STRIP.format('Question_translated')}) AS question, sha256({_STRIP.format('Answer_translated')}) AS answer FROM translation_handoff WHERE coalesce({_STRIP.format('Question_translated')}, '') <> '' AND coalesce({_STRIP.format('Answer_translated')}, '') <> ''""")
def applied_translations(spark: SparkSession, d: str) -> DataFrame:
    """Translations put in the place of the texts; rows with a blank one are left out before, as they would fail the step."""
    rows = table(spark, d, "translation_handoff").where(~handoff.is_blank(F.col("Question_translated")) & ~handoff.is_blank(F.col("Answer_translated")))
    out = handoff.apply_translation(rows, "row_id", {"Question": "Question_translated", "Answer": "Answer_translated"})
    return out.select("row_id", F.sha2("Question", 256).alias("question"), F.sha2("Answer", 256).alias("answer")).distinct()


@query("SELECT item_key, seed_id, style, style_text AS Question, '' AS Question_translated FROM gold_seeds")
def handoff_template(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gold_seeds").withColumnRenamed("style_text", "Question")
    return handoff.require_pristine(handoff.template(rows, "item_key", ["item_key", "seed_id", "style", "Question"], ["Question_translated"]), "item_key", ["Question_translated"])


@query("SELECT item_key, upper(style_text) AS style_text, gold_risk_level FROM gold_seeds")
def translated_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Gold items with their texts replaced, all labels kept."""
    gold = table(spark, d, "gold_seeds")
    done = gold.select("item_key", F.concat(F.lit(" "), F.upper("style_text")).alias("translated"))
    return handoff.translated_benchmark(gold, done, "item_key", "style_text", "translated").select("item_key", "style_text", "gold_risk_level")


@query("""SELECT g.item_key, CASE WHEN g.style = 'canonical' THEN g.style_text ELSE lower(g.style_text) END AS style_text FROM gold_seeds g""")
def merged_variants(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "gold_seeds").select("item_key", "seed_id", "style", "style_text")
    authored = gold.where("style <> 'canonical'").select("seed_id", "style", F.lower("style_text").alias("style_text"))
    return handoff.merge_variants(gold, authored, ["seed_id", "style"], "style", "style_text").select("item_key", "style_text")


# --- labels, tiers, mixtures -------------------------------------------------


@query("SELECT category, count(*) AS n FROM (SELECT CASE WHEN c IN ('menstrual', 'pcos', 'fertility', 'other') THEN c WHEN c IN ('menstruation', 'menarche', 'menopause', 'pms') THEN 'menstrual' ELSE 'other' END AS category FROM (SELECT " + _NORM_C.format("k") + " AS c FROM (SELECT replace(lower(trim(coalesce(Topic, ''))), '_', '-') AS k FROM filtered))) GROUP BY 1")
def clamped_categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filtered").groupBy(curation.clamp_category(F.col("Topic")).alias("category")).agg(F.count("*").alias("n"))


_URGENCY_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{m}')" for m in markers) + f" THEN '{name}'" for name, markers in curation.URGENCY) + " ELSE 'low' END"


@query(f"SELECT source, ['low', 'moderate', 'high'][max(list_position(['low', 'moderate', 'high'], {_URGENCY_SQL}))] AS highest, count_if({_URGENCY_SQL} = 'high') AS high FROM documents WHERE text IS NOT NULL GROUP BY 1")
def urgency_by_source(spark: SparkSession, d: str) -> DataFrame:
    """The highest urgency of each source's documents."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("source", curation.urgency(F.col("text")).alias("u"))
    top = F.max(curation.rank_of(F.col("u")))
    return rows.groupBy("source").agg(F.element_at(F.array(*[F.lit(x) for x in curation.LEVELS]), (top + 1).cast("int")).alias("highest"), F.count_if(F.col("u") == "high").alias("high"))


_AMBIGUOUS = r"lower(trim(coalesce(style, ''))) = 'ambiguous' AND regexp_matches(coalesce(style_text, ''), '(?i)\bsomething\b')"


@query(rf"""WITH b AS (SELECT DISTINCT seed_id FROM gold_seeds WHERE {_AMBIGUOUS} AND contains(lower(coalesce(style_text, '')), 'not really sure')) SELECT language, count(*) AS kept FROM (SELECT DISTINCT pred_id, seed_id, language FROM predictions) WHERE seed_id NOT IN (SELECT seed_id FROM b) GROUP BY 1""")
def degenerate_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Predictions left in every language once items with an emptied English rewrite are dropped by id."""
    rows = table(spark, d, "predictions").select("pred_id", "seed_id", "language").distinct()
    kept = curation.drop_by_source(rows, table(spark, d, "gold_seeds"), "seed_id", curation.degenerate_rewrite(F.col("style"), F.col("style_text")))
    return kept.groupBy("language").agg(F.count("*").alias("kept"))


_TIER_TABLES = {"cycle": [("(?i)cycle", 2.0), ("(?i)period", 2.0), ("(?i)cramp", 1.0)], "hormone": [("(?i)thyroid", 2.0), ("(?i)progesterone", 2.0), ("(?i)AMH", 1.0)]}
_SCORE = {k: " + ".join(f"CASE WHEN regexp_matches(Question, '{p}') THEN {w} ELSE 0 END" for p, w in t) for k, t in _TIER_TABLES.items()}
_TIERS = "WITH r AS (SELECT DISTINCT row_id, Question, Topic FROM filtered WHERE Question IS NOT NULL), t AS (" + " UNION ALL ".join(f"SELECT row_id, Topic, Question, '{k}' AS category, {v} AS score FROM r" for k, v in _SCORE.items()) + "), f AS (SELECT *, CASE WHEN score >= 3 AND length(Question) >= 400 THEN 'clear' WHEN score >= 2 THEN 'borderline' END AS tier FROM t)"


def _tiered(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filtered").where("Question IS NOT NULL").select("row_id", "Question", "Topic").distinct()
    long = F.length("Question") >= 400
    return curation.tiers(rows, F.col("Question"), _TIER_TABLES, 3, 2, {k: long for k in _TIER_TABLES})


@query(_TIERS + " SELECT category, tier, count(*) AS n, sum(score)::DOUBLE AS score FROM f WHERE tier IS NOT NULL GROUP BY ALL")
def category_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Questions by category and tier; a question may be in several categories or none."""
    return _tiered(spark, d).groupBy("category", "tier").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@query(_TIERS + ", n AS (SELECT category, count_if(tier = 'clear') AS eligible FROM f WHERE tier IS NOT NULL GROUP BY 1) SELECT category, eligible, CASE WHEN eligible >= 600 THEN 60 WHEN eligible >= 400 THEN 40 WHEN eligible >= 80 THEN 25 ELSE eligible END::BIGINT AS target FROM n")
def category_targets(spark: SparkSession, d: str) -> DataFrame:
    return curation.targets(_tiered(spark, d), "category", F.col("tier") == "clear", [(600, 60), (400, 40), (80, 25)])


@query(_TIERS + """, k AS (SELECT *, row_number() OVER (PARTITION BY Question ORDER BY CASE category WHEN 'hormone' THEN '1' ELSE '2' END, row_id) AS n FROM f WHERE tier = 'clear'), o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY row_id, Question) AS r FROM k WHERE n = 1)
SELECT category, row_id FROM o WHERE r <= CASE category WHEN 'hormone' THEN 30 ELSE 40 END""")
def exclusive_selection(spark: SparkSession, d: str) -> DataFrame:
    """Clear questions for two categories, no text in both."""
    rows = _tiered(spark, d).where("tier = 'clear'")
    return curation.exclusive(rows, F.col("Question"), [("hormone", "1"), ("cycle", "2")], "category", "row_id", {"hormone": 30, "cycle": 40}).select("category", "row_id")


@query("""SELECT item_key, CASE category WHEN 'pcos' THEN 'P' WHEN 'fertility' THEN 'F' WHEN 'menstrual' THEN 'M' END || '-' || format('{:03d}', row_number() OVER (PARTITION BY category ORDER BY item_key)) AS seed_id FROM gold_seeds""")
def seed_numbers(spark: SparkSession, d: str) -> DataFrame:
    return curation.seed_ids(table(spark, d, "gold_seeds").drop("seed_id"), "category", ["item_key"], {"pcos": "P", "fertility": "F", "menstrual": "M"}).select("item_key", "seed_id")


@query("""WITH p AS (SELECT category, min(item_key) AS key, 'https://x/' || category AS url FROM gold_seeds WHERE category <> 'pcos' GROUP BY 1), s AS (SELECT p.url, p.key, p.category, row_number() OVER (PARTITION BY p.category ORDER BY g.item_key) AS pos, g.style, trim(g.gold_answer) AS text FROM p JOIN gold_seeds g ON g.category = p.category AND g.gold_risk_level = 'see-doctor'),
a AS (SELECT url, arg_min(substr(text, 1, 200), (CASE WHEN style = 'clinical' THEN 0 ELSE 1000000 END) + pos) AS hit, bool_or(style = 'clinical') AS any_hit, any_value(category) AS category FROM s GROUP BY 1),
r AS (SELECT item_key, CASE WHEN gold_risk_level = 'urgent' THEN '' ELSE 'https://x/' || category END AS u FROM gold_seeds)
SELECT item_key, CASE WHEN a.url IS NOT NULL THEN 'grounded' WHEN u <> '' THEN 'page_missing' ELSE 'needs_grounding' END AS grounding, md5(CASE WHEN any_hit THEN hit ELSE 'discuss: ' || category END) AS action FROM r LEFT JOIN a ON a.url = u""")
def grounded_items(spark: SparkSession, d: str) -> DataFrame:
    """Gold items grounded on pages made of the answers of their category; one category's page is missing."""
    gold = table(spark, d, "gold_seeds")
    sections = gold.where("gold_risk_level = 'see-doctor' AND category <> 'pcos'").groupBy("category").agg(F.array_sort(F.collect_list(F.struct("item_key", F.col("style").alias("heading"), F.col("gold_answer").alias("text")))).alias("s"))
    names = gold.groupBy("category").agg(F.min("item_key").alias("key"))
    bundle = sections.join(names, "category").select("key", F.col("category").alias("condition"), F.concat(F.lit("https://x/"), "category").alias("url"), F.transform("s", lambda x: F.struct(x["heading"].alias("heading"), x["text"].alias("text"))).alias("sections"))
    evidence = curation.evidence_table(spark, bundle)
    rows = gold.select("item_key", F.when(F.col("gold_risk_level") == "urgent", "none").otherwise(F.concat(F.col("category"), F.lit(" | https://x/"), F.col("category"))).alias("condition"))
    return curation.grounded(rows, "condition", evidence, "^clinical$").select("item_key", "grounding", F.md5("action").alias("action"))


_RISK = [("urgent", ("emergency", "immediately", "severe bleeding", "unbearable")), ("see-doctor", ("doctor", "clinician", "gynecologist", "provider", "checkup"))]
_RISK_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(a), '{m}')" for m in ms) + f" THEN '{k}'" for k, ms in _RISK) + " ELSE 'routine' END"


@query(f"""WITH r AS (SELECT DISTINCT row_id, {_STRIP.format('Question')} AS q, {_STRIP.format('Answer')} AS a, coalesce(Style, '') = 'ambiguous' AS ask FROM filtered WHERE Question IS NOT NULL AND Answer IS NOT NULL)
SELECT row_id, CASE WHEN ask THEN 'see-doctor' ELSE {_RISK_SQL} END AS predicted_risk, ask AS asks_clarification, length(CASE WHEN ask THEN 'Please tell more.' ELSE a END) AS response_chars, length('Q: ' || q) AS prompt_chars FROM r""")
def json_targets(spark: SparkSession, d: str) -> DataFrame:
    """Training records with a JSON target, read back."""
    rows = table(spark, d, "filtered").where("Question IS NOT NULL AND Answer IS NOT NULL").select("row_id", "Question", "Answer", "Topic", "Style")
    record = curation.json_training_record(F.col("Question"), F.col("Answer"), F.col("Topic"), X.first_tier(F.col("Answer"), _RISK, "routine"), F.coalesce("Style", F.lit("")) == "ambiguous", F.lit("Please tell more."), "Q: {text}")
    m = F.from_json(record, "messages array<struct<role string, content string>>")["messages"]
    t = F.from_json(m[1]["content"], "predicted_risk string, asks_clarification boolean, response_text string")
    return rows.select("row_id", t["predicted_risk"].alias("predicted_risk"), t["asks_clarification"].alias("asks_clarification"), F.length(t["response_text"]).alias("response_chars"), F.length(m[0]["content"]).alias("prompt_chars")).distinct()


_MIX = """WITH r AS (SELECT DISTINCT row_id AS k, split, coalesce(Topic, '') AS g, coalesce(Style, '') AS style FROM filtered), t AS (SELECT * FROM r WHERE split = 'train'), v AS (SELECT * FROM r WHERE split = 'val'),
j AS (SELECT k, g, row_number() OVER (PARTITION BY g ORDER BY md5('5|' || k), k) AS i FROM t), c AS (SELECT k, g, row_number() OVER (ORDER BY md5('5|' || k), k) AS i FROM t WHERE style = 'ambiguous'), p AS (SELECT k, g, row_number() OVER (ORDER BY md5('5|' || k), k) AS i FROM v)"""


@query(_MIX + """ SELECT part, component, count(*) AS n, min(k) AS first_id FROM (SELECT 'train' AS part, 'chat' AS component, k FROM t UNION ALL SELECT 'train', 'json', k FROM j WHERE i <= 30 UNION ALL SELECT 'train', 'clarification', k FROM c WHERE i > 15
UNION ALL SELECT 'train', 'style', k FROM t WHERE style = 'clinical' UNION ALL SELECT 'probe', 'triage', k FROM p WHERE i <= 75 UNION ALL SELECT 'probe', 'clarification', k FROM c WHERE i <= 15) GROUP BY ALL""")
def training_mix(spark: SparkSession, d: str) -> DataFrame:
    """The components of a training mixture and of the probe kept out of it."""
    rows = table(spark, d, "filtered").select(F.col("row_id").alias("k"), "split", F.coalesce("Topic", F.lit("")).alias("g"), F.coalesce("Style", F.lit("")).alias("style")).distinct()
    train = rows.where("split = 'train'")
    made = curation.training_mix(train, rows.where("split = 'val'"), train.where("style = 'ambiguous'"), rows.where("style = 'clinical'"), "k", "g", 30, 75, 15, 5)
    both = made["train"].withColumn("part", F.lit("train")).unionByName(made["probe"].withColumn("part", F.lit("probe")))
    return both.groupBy("part", "component").agg(F.count("*").alias("n"), F.min("k").alias("first_id"))


# --- functions and operators of their own ------------------------------------


@query(rf"SELECT doc_id, sha1(regexp_replace(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), '[^a-z0-9_ ]', '', 'g')) AS print FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[^\x00-\x7F]|[\x00-\x08\x0B\x0E-\x1F\x7F]')")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint of every document in ASCII, for which both engines have the same classes."""
    ascii_only = table(spark, d, "documents").where(~F.rlike(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x7F]|[\x00-\x08\x0B\x0E-\x1F\x7F]")))
    return ascii_only.select("doc_id", X.fingerprint(F.col("text")).alias("print"))


@query(r"""WITH t AS (SELECT DISTINCT qa_id, list_distinct(regexp_extract_all(lower(coalesce(Question, '')), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(coalesce(Answer, '')), '[a-z0-9]+')) AS a FROM cdc_reproductive_health_qa)
SELECT qa_id, round(CASE WHEN len(list_distinct(list_concat(q, a))) > 0 THEN len(list_intersect(q, a)) / len(list_distinct(list_concat(q, a))) ELSE 0 END, 6) AS similarity FROM t""")
def question_answer_similarity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cdc_reproductive_health_qa").select("qa_id", F.round(X.token_jaccard(X.tokens(F.col("Question")), X.tokens(F.col("Answer"))), 6).alias("similarity")).distinct()


@query("""SELECT DISTINCT row_id, substr(CASE WHEN trim(split_part(trim(Question), '.', 1)) <> '' THEN trim(split_part(trim(Question), '.', 1)) ELSE Question END, 1, 120) AS head FROM filtered WHERE Question IS NOT NULL""")
def first_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filtered").where("Question IS NOT NULL").select("row_id", X.first_sentence(F.col("Question")).alias("head")).distinct()


@query("""SELECT DISTINCT pred_id, coalesce(nullif(seed_id, ''), pred_id) || '_' || coalesce(nullif(style, ''), 'canonical') || '_' || language AS item FROM predictions""")
def item_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").select("pred_id", keyed.item_id(F.col("seed_id"), F.col("pred_id"), F.col("style"), F.col("language")).alias("item")).distinct()


@query("""SELECT doc_id, coalesce(lang, 'none') || '-' || format('{:04d}', row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS row_id FROM documents""")
def row_ids(spark: SparkSession, d: str) -> DataFrame:
    """Language and position of every document; positions of five digits stay whole."""
    rows = sample.numbered_rows(table(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], "n")
    return rows.select("doc_id", keyed.row_id(F.coalesce("lang", F.lit("none")), F.col("n") - 1).alias("row_id"))


@query("""WITH g AS (SELECT seed_id, max(gold_risk_level) AS r, max(gold_condition) AS c FROM gold_seeds GROUP BY 1), p AS (SELECT DISTINCT pred_id, seed_id, gold_risk_level, gold_condition FROM predictions)
SELECT pred_id, CASE WHEN g.seed_id IS NOT NULL THEN g.r ELSE p.gold_risk_level END AS gold_risk_level, CASE WHEN g.seed_id IS NOT NULL THEN g.c ELSE p.gold_condition END AS gold_condition FROM p LEFT JOIN g ON g.seed_id = p.seed_id""")
def patched_gold(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "predictions").select("pred_id", "seed_id", "gold_risk_level", "gold_condition").distinct()
    new = table(spark, d, "gold_seeds").groupBy("seed_id").agg(F.max("gold_risk_level").alias("gold_risk_level"), F.max("gold_condition").alias("gold_condition"))
    return keyed.patch(rows, new, "seed_id", ["gold_risk_level", "gold_condition"]).select("pred_id", "gold_risk_level", "gold_condition")


@query(f"""WITH b AS (SELECT row_id, max_by(Style, struct_pack(a := row_id, b := Style)) AS s FROM filtered WHERE {_STRIP.format("coalesce(Style, '')")} <> '' GROUP BY 1) SELECT DISTINCT t.row_id, {_STRIP.format('b.s')} AS Style FROM translation_handoff t LEFT JOIN b ON b.row_id = t.row_id""")
def recovered_styles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "translation_handoff").select("row_id", F.lit("").alias("Style")).distinct()
    return keyed.recover(rows, table(spark, d, "filtered").select("row_id", "Style"), "row_id", "Style", ["row_id"])


@query("""SELECT place, item_key FROM (SELECT item_key, row_number() OVER (ORDER BY md5('9|' || item_key), item_key) AS place FROM gold_seeds) WHERE place BETWEEN 101 AND 200""")
def shuffled_range(spark: SparkSession, d: str) -> DataFrame:
    """Places 101 to 200 of the items in a seeded order."""
    rows = sample.ranked(table(spark, d, "gold_seeds").select("item_key"), sample.seeded(F.col("item_key"), 9), ["item_key"], "place")
    return sample.row_range(rows, "place", 101, 201).select("place", "item_key")


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY item_key) AS pos, item_key FROM gold_seeds), b AS (SELECT row_number() OVER (ORDER BY seed_id, style) AS pos, item_key FROM gold_seeds WHERE style <> 'ambiguous')
SELECT coalesce(a.pos, b.pos) AS pos, coalesce(a.item_key, '<missing>') AS "left", coalesce(b.item_key, '<missing>') AS "right" FROM a FULL JOIN b ON a.pos = b.pos WHERE a.item_key IS DISTINCT FROM b.item_key ORDER BY 1 LIMIT 1""")
def first_difference(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "gold_seeds")
    a = sample.numbered_rows(gold, None, ["item_key"], "pos")
    b = sample.numbered_rows(gold.where("style <> 'ambiguous'"), None, ["seed_id", "style"], "pos")
    return keyed.first_order_difference(a, b, "pos", "item_key")


@query("""WITH g AS (SELECT item_key, seed_id, style, gold_risk_level FROM gold_seeds), t AS (SELECT item_key, length(style_text) AS n FROM gold_seeds) SELECT g.item_key, g.gold_risk_level, t.n FROM g JOIN t USING (item_key)""")
def strict_pairs(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "gold_seeds")
    return keyed.strict_join(gold.select("item_key", "gold_risk_level"), gold.select("item_key", F.length("style_text").alias("n")), "item_key").select("item_key", "gold_risk_level", F.col("n_right").alias("n"))


@query(rf"""SELECT DISTINCT qa_id, length(regexp_replace(Answer, '[ \t]+(\r?\n)', '\1', 'g')) AS chars FROM cdc_reproductive_health_qa WHERE Answer IS NOT NULL""")
def trimmed_line_ends(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cdc_reproductive_health_qa").where("Answer IS NOT NULL").select("qa_id", F.length(rewrite.trim_line_ends(F.col("Answer"))).alias("chars")).distinct()


_OPENERS = ["First: ", "Then: ", "Last: "]


@query("""SELECT item_key, ['First: ', 'Then: ', 'Last: '][(row_number() OVER (ORDER BY item_key) - 1) % 3 + 1] || style_text AS text FROM gold_seeds""")
def prefixed_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = sample.numbered_rows(table(spark, d, "gold_seeds"), None, ["item_key"], "n")
    return rows.select("item_key", rewrite.prefixed(_OPENERS, F.col("n") - 1, F.col("style_text")).alias("text"))


_JUDGE = ("cultural_sensitivity", "helpfulness", "clarity")
_JUDGED = """WITH j AS (SELECT DISTINCT pred_id, model_label, length(coalesce(raw_response, '')) AS n FROM predictions), s AS (SELECT *, n % 5 + 1 AS a, n % 4 + 1 AS b, CASE WHEN n % 7 = 0 THEN 9 ELSE n % 3 + 1 END AS c FROM j)"""


@query(_JUDGED + """ SELECT model_label, count(*) AS n, count_if(c > 5) AS judge_errors, round(avg(CASE WHEN c <= 5 THEN a END), 6) AS cultural_sensitivity, round(avg(CASE WHEN c <= 5 THEN b END), 6) AS helpfulness, round(avg(CASE WHEN c <= 5 THEN c END), 6) AS clarity FROM s GROUP BY 1""")
def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    """Scores that a judge gave as JSON, one of seven out of range, by model."""
    n = F.length(F.coalesce("raw_response", F.lit("")))
    rows = table(spark, d, "predictions").select("pred_id", "model_label", n.alias("n")).distinct()
    said = F.format_string('{"cultural_sensitivity": %d, "helpfulness": %d, "clarity": %d}', F.col("n") % 5 + 1, F.col("n") % 4 + 1, F.when(F.col("n") % 7 == 0, 9).otherwise(F.col("n") % 3 + 1))
    judged = rows.withColumn("_j", judge_scores(said, _JUDGE)).select("model_label", "_j.*")
    return metrics.judge_means(judged, list(_JUDGE), ["model_label"]).select("model_label", "n", "judge_errors", *[F.round(c, 6).alias(c) for c in _JUDGE])


@query("""WITH n AS (SELECT trim(lower(regexp_replace(Topic, '\\s+', ' ', 'g'))) AS name, qa_id, length(coalesce(Answer, '')) AS len, CASE length(coalesce(Answer, '')) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'moderate' ELSE 'high' END AS level FROM (SELECT DISTINCT qa_id, Topic, Answer FROM cdc_reproductive_health_qa) WHERE Topic IS NOT NULL),
g AS (SELECT name, arg_min(qa_id, qa_id) AS first_id, max(list_position(['low', 'moderate', 'high'], level)) AS top, arg_min(len, (1000 - list_position(['low', 'moderate', 'high'], level))::VARCHAR || qa_id) AS action, count(*) AS evidences, array_to_string(list_sort(list(DISTINCT level)), ', ') AS levels, count(DISTINCT level) AS k FROM n GROUP BY 1)
SELECT 'x-s' || format('{:02d}', row_number() OVER (ORDER BY name)) AS entry_id, name, ['low', 'moderate', 'high'][top] AS level, first_id AS qa_id, action::BIGINT AS action, evidences, CASE WHEN k > 1 THEN 'levels differ (' || levels || '); the higher one applies' END AS conflict_note FROM g""".replace("\\\\", "\\"))
def evidence_entries(spark: SparkSession, d: str) -> DataFrame:
    """Topics as entries with their evidence in order and notes of disagreement."""
    rows = table(spark, d, "cdc_reproductive_health_qa").where("Topic IS NOT NULL").select("qa_id", "Topic", "Answer").distinct()
    n = F.length(F.coalesce("Answer", F.lit("")))
    level = F.element_at(F.array(*[F.lit(x) for x in curation.LEVELS]), (n % 3 + 1).cast("int"))
    out = keyed.evidence_entries(rows.withColumn("action", n.cast("long")), F.col("Topic"), level, curation.LEVELS, "qa_id", ["qa_id"], "action", {"id": "qa_id"}, "x-s")
    return out.select("entry_id", "name", "level", "qa_id", "action", F.size("evidence").cast("long").alias("evidences"), "conflict_note")


_CLAIM_PATTERNS = [(r"cramp|pain", "pain"), (r"period pain", "period pain"), (r"thyroid", "a thyroid check"), (r"progesterone", "progesterone"), (r"ultrasound|scan", "a scan")]


@query("""WITH r AS (SELECT DISTINCT row_id, coalesce(Question, '') AS q FROM filtered), c AS (SELECT row_id, list_filter([CASE WHEN regexp_matches(q, '(?i)cramp|pain') THEN 'pain' END, CASE WHEN regexp_matches(q, '(?i)period pain') THEN 'period pain' END, CASE WHEN regexp_matches(q, '(?i)thyroid') THEN 'a thyroid check' END,
CASE WHEN regexp_matches(q, '(?i)progesterone') THEN 'progesterone' END, CASE WHEN regexp_matches(q, '(?i)ultrasound|scan') THEN 'a scan' END], lambda x: x IS NOT NULL) AS c FROM r), f AS (SELECT row_id, list_slice(list_filter(c, lambda x: NOT (x = 'pain' AND list_contains(c, 'period pain'))), 1, 3) AS c FROM c)
SELECT CASE len(c) WHEN 0 THEN 'nothing named' WHEN 1 THEN c[1] WHEN 2 THEN c[1] || ' and ' || c[2] ELSE c[1] || ', ' || c[2] || ', and ' || c[3] END AS said, count(*) AS n FROM f GROUP BY 1""")
def claim_phrases(spark: SparkSession, d: str) -> DataFrame:
    """What the questions name, in words."""
    rows = table(spark, d, "filtered").select("row_id", "Question").distinct()
    return rows.groupBy(rewrite.in_words(rewrite.claims(F.col("Question"), _CLAIM_PATTERNS), 3, "nothing named").alias("said")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT DISTINCT row_id, lower(coalesce(Question, '')) AS q FROM filtered) SELECT name, url, count(*) AS n FROM (SELECT CASE WHEN contains(q, 'thyroid') THEN 'thyroid' WHEN contains(q, 'fibroid') THEN 'fibroid' ELSE 'none' END AS name, CASE WHEN contains(q, 'thyroid') THEN 'https://x/t' END AS url FROM r) GROUP BY ALL""")
def routed_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filtered").select("row_id", rewrite.route(F.col("Question"), [("thyroid", "thyroid", "https://x/t"), ("fibroid", "fibroid", None)], "none").alias("r"), "Question").distinct()
    return rows.groupBy("r.name", "r.url").agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT DISTINCT row_id, Answer, coalesce(Style, '') AS s FROM filtered), a AS (SELECT coalesce(Answer, '') AS a, s FROM r) SELECT gold_risk_level, requires_clarification, count(*) AS n FROM (SELECT {_RISK_SQL} AS gold_risk_level, CASE WHEN lower(trim(s)) = 'ambiguous' THEN 'yes' ELSE 'no' END AS requires_clarification FROM a) GROUP BY ALL""")
def labelled_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filtered").select("row_id", "Answer", "Style").distinct()
    return curation.labelled(rows, "Answer", "Style", _RISK).groupBy("gold_risk_level", "requires_clarification").agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT DISTINCT row_id, split, Question, row_id AS k FROM filtered WHERE split IN ('train', 'val')), p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS pos, lower({_STRIP.format('Question')}) AS q FROM r), b AS (SELECT DISTINCT lower({_STRIP.format('style_text')}) AS q FROM gold_seeds WHERE style_text <> ''),
v AS (SELECT * FROM p WHERE split = 'val' AND (q IS NULL OR q NOT IN (SELECT q FROM b))) SELECT split || '-' || format('{{:04d}}', pos) AS row_id, split, k FROM v UNION ALL
SELECT 'train-' || format('{{:04d}}', pos), 'train', k FROM p WHERE split = 'train' AND (q IS NULL OR q NOT IN (SELECT q FROM b)) AND (q IS NULL OR q = '' OR q NOT IN (SELECT q FROM v WHERE q IS NOT NULL))""")
def expected_handoff(spark: SparkSession, d: str) -> DataFrame:
    """The rows that a handoff made from filtered must have, with ids by position."""
    rows = table(spark, d, "filtered").where("split IN ('train', 'val')").select("row_id", "split", "Question").distinct().withColumnRenamed("row_id", "k")
    numbered = sample.numbered_rows(rows, "split", ["k"], "n").withColumn("pos", F.col("n") - 1)
    bench = table(spark, d, "gold_seeds").select(F.col("style_text").alias("Question"))
    return handoff.expected_rows(numbered.where("split = 'train'"), numbered.where("split = 'val'"), bench, "pos", "Question", ["k"])


@query("""WITH g AS (SELECT item_key, trim(style_text) AS q, list_sort(list_distinct(list_filter(list_transform(list_prepend(coalesce(topic_raw, ''), string_split(coalesce(keywords, ''), ',')), lambda t: trim(t)), lambda t: length(t) >= 4))) AS t FROM gold_seeds) SELECT item_key, len(t) AS terms FROM g""")
def redaction_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_seeds").select("item_key", F.size(rewrite.redaction_terms(F.col("topic_raw"), F.col("keywords"))).cast("long").alias("terms"))


@query("""WITH p AS (SELECT DISTINCT row_id FROM translation_handoff), r AS (SELECT DISTINCT row_id, split FROM filtered) SELECT split, CASE WHEN row_id IN (SELECT row_id FROM p) THEN 'handed_off' ELSE 'open' END AS status, count(*) AS n FROM r GROUP BY ALL""")
def handoff_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filtered").select("row_id", "split").distinct()
    return curation.with_status(rows, "row_id", table(spark, d, "translation_handoff"), "handed_off", "open").groupBy("split", "status").agg(F.count("*").alias("n"))


# --- files -------------------------------------------------------------------


@query("""SELECT item_key, coalesce(keywords, '') AS keywords, md5(coalesce(style_text, '')) AS text FROM gold_seeds""")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The gold items written as CSV and read again; NULL cells come back empty."""
    path = new_path(spark, "csv")
    columns = ["item_key", "keywords", "style_text"]
    files.write_csv(table(spark, d, "gold_seeds"), path, columns)
    return files.read_csv(spark, path, columns).select("item_key", "keywords", F.md5("style_text").alias("text"))


@query("""SELECT item_key, keywords, md5(style_text) AS text FROM gold_seeds""")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The gold items written as JSON lines, half of them appended, and read strictly."""
    path = new_path(spark, "jsonl")
    gold = table(spark, d, "gold_seeds").select("item_key", "keywords", "style_text")
    early = F.col("item_key") < "m"
    files.write_jsonl(gold.where(early), path)
    files.write_jsonl(gold.where(~early), path, "append")
    return files.read_jsonl(spark, path, gold.schema).select("item_key", "keywords", F.md5("style_text").alias("text"))


@query(f"""WITH r AS (SELECT DISTINCT qa_id, Question, Answer FROM cdc_reproductive_health_qa WHERE Question IS NOT NULL AND Answer IS NOT NULL) SELECT qa_id, md5({_STRIP.format('Question')}) AS asked, md5({_STRIP.format('Answer')}) AS answered FROM r""")
def chat_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Chat records written one a line and read again."""
    path = new_path(spark, "chat")
    rows = table(spark, d, "cdc_reproductive_health_qa").where("Question IS NOT NULL AND Answer IS NOT NULL").select("qa_id", "Question", "Answer").distinct()
    files.write_chat_jsonl(rows.select(rewrite.chat_record(F.col("Question"), F.col("Answer"), F.col("qa_id")).alias("record")), path, "record")
    m = files.read_jsonl(spark, path, "messages array<struct<role string, content string>>").select("messages.content")
    return m.select(F.col("content")[0].alias("qa_id"), F.md5(F.col("content")[1]).alias("asked"), F.md5(F.col("content")[2]).alias("answered"))


@query(r"""SELECT DISTINCT qa_id, md5(replace(regexp_replace(replace(replace(Answer, ' ', ' '), '\"', '"'), '(\p{L})''(\p{L})', '\1’\2', 'g'), chr(0), '')) AS text FROM cdc_reproductive_health_qa WHERE Answer IS NOT NULL AND NOT regexp_matches(Answer, '\p{L}''\p{L}''\p{L}')""")
def plain_escapes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cdc_reproductive_health_qa").where(F.col("Answer").isNotNull() & ~F.rlike("Answer", F.lit(r"\p{L}'\p{L}'\p{L}")))
    return rows.select("qa_id", F.md5(rewrite.plain_escapes(F.col("Answer"))).alias("text")).distinct()
