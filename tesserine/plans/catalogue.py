"""The registered queries of the core and the SQL that each must agree with.

Every query runs over its whole tables. Tables other than documents and
gold_seeds repeat some rows in full; queries that need one row per key take the
distinct rows first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import html as H
from tesserine.functions import text as X
from tesserine.operators import dedup, keyed, leakage, metrics, quality, rewrite, sample
from tesserine.runtime import table
from tesserine.streaming import inference

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_KEY = r"""regexp_replace(trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), '^(hi|hello|dear|hey)\b[\s,]*(doctor|dr)?[\s,]*', '')"""
_CUT_KEY = f"substr({_KEY}, 1, 800)"
_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}\x0B\x85]+|[\s\p{{Z}}\x0B\x85]+$', '', 'g')"
_SQUEEZE_ALL = r"trim(regexp_replace({0}, '[\s\p{{Z}}\x0B\x85]+', ' ', 'g'))"
_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query(rf"SELECT doc_id, length({_CUT_KEY.format('text')}) AS key_chars, md5({_CUT_KEY.format('text')}) AS key_md5 FROM documents")
def clean_text_keys(spark: SparkSession, d: str) -> DataFrame:
    """The short deduplication key of every document."""
    key = X.dedup_key(F.col("text"), X.KEY_CHARS)
    return table(spark, d, "documents").select("doc_id", F.length(key).alias("key_chars"), F.md5(key).alias("key_md5"))


@query(r"""SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x0B]+', ''), '[\s\x0B]+$', '')) AS chars FROM documents""")
def clean_text_lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(X.clean(F.col("text"))).alias("chars"))


_RULES = r"""CASE WHEN NOT length(coalesce(Answer, '')) BETWEEN 20 AND 1500 THEN 'answer_length'
 WHEN regexp_matches(coalesce(Answer, ''), '(?i)^\s*(?:please\s+)?(?:consult|see|visit)\s+(?:a|your)\s+(?:doctor|gynecologist|gp|physician)\.?\s*$') OR regexp_matches(coalesce(Answer, ''), '^\s*https?://\S+\s*$') THEN 'junk_answer'
 WHEN NOT coalesce(length(regexp_replace(Question, '[^\x00-\x7F]', '', 'g')) / nullif(length(Question), 0) > 0.9, false) OR NOT coalesce(length(regexp_replace(Answer, '[^\x00-\x7F]', '', 'g')) / nullif(length(Answer), 0) > 0.9, false) THEN 'non_english_heuristic' END"""
_QUALITY = rf"""WITH d AS (SELECT DISTINCT row_id, Question, Answer FROM filtered), r AS (SELECT *, {_RULES} AS r1, {_KEY.format('Question')} || '|' || {_KEY.format('Answer')} AS k FROM d),
q AS (SELECT *, CASE WHEN r1 IS NULL AND row_number() OVER (PARTITION BY r1 IS NULL, k ORDER BY row_id) > 1 THEN 'exact_qa_dup' ELSE r1 END AS reason FROM r)"""


def _quality(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "filtered").select("row_id", "source_dataset", "Question", "Answer").distinct()
    return quality.quality_reasons(pairs, "Question", "Answer", ["row_id"])


@query(_QUALITY + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM q GROUP BY 1")
def quality_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    return quality.drop_counts(_quality(spark, d))


@query(_QUALITY + " SELECT row_id, reason FROM q WHERE reason IS NOT NULL")
def quality_audit_log(spark: SparkSession, d: str) -> DataFrame:
    return quality.audit_log(_quality(spark, d), ["row_id"])


@query(rf"""SELECT count(*) AS rows, count_if(a) AS answered, count_if(a AND q) AS asked, count_if(a AND q AND t) AS with_topic
FROM (SELECT coalesce(Answer <> '', false) AS a, coalesce(Question <> '', false) AS q, Topic IS NOT NULL AS t FROM filtered)""")
def stage_yield(spark: SparkSession, d: str) -> DataFrame:
    return quality.stage_yield(table(spark, d, "filtered"), [("answered", F.col("Answer") != ""), ("asked", F.col("Question") != ""), ("with_topic", F.col("Topic").isNotNull())])


@query(rf"""WITH k AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY {_KEY.format('text')} ORDER BY doc_id) AS n FROM documents)
SELECT lang, count(*) AS kept, sum(n_chars) AS chars FROM k WHERE n = 1 GROUP BY lang""")
def exact_dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Documents left by language when the first of each deduplication key stays."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.sha2(X.dedup_key(F.col("text")), 256).alias("k"))
    return dedup.first_per_key(docs, ["k"], ["doc_id"]).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_chars").alias("chars"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Exact deduplication of the documents, counted by language."""
    return exact_dedup_first_wins(spark, d)


_PRINT = r"sha1(regexp_replace(trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g')), '[^a-z0-9_ ]', '', 'g'))"


@query(f"""WITH h AS (SELECT DISTINCT lower({_STRIP.format('qa_id')}) AS k FROM filtered WHERE split <> 'train'), t AS (SELECT DISTINCT lower({_STRIP.format('Question')}) AS k FROM filtered WHERE split <> 'train'),
r AS (SELECT DISTINCT row_id, lower({_STRIP.format('qa_id')}) AS rk, lower({_STRIP.format('Question')}) AS qk FROM filtered WHERE split = 'train')
SELECT row_id, CASE WHEN rk IN (SELECT k FROM h WHERE k <> '') THEN 'row_key' WHEN qk IN (SELECT k FROM t WHERE k <> '') THEN 'text_hash' END AS exclusion_reason FROM r""")
def dual_key_exclusion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filtered").select("row_id", "split", X.question_key(F.col("qa_id")).alias("rk"), X.question_key(F.col("Question")).alias("qk")).distinct()
    held = rows.where("split <> 'train'")
    return leakage.dual_key_exclusion(rows.where("split = 'train'"), F.col("rk"), held.select("rk"), F.col("qk"), held.select("qk")).select("row_id", "exclusion_reason")


@query(f"""WITH r AS (SELECT DISTINCT row_id, split, lower({_STRIP.format('Question')}) AS q, length(coalesce(Question, '')) < 60 AS deg FROM translation_handoff), g AS (SELECT DISTINCT lower({_STRIP.format('style_text')}) AS q FROM gold_seeds),
m AS (SELECT *, CASE WHEN deg THEN 'degenerate' WHEN q IN (SELECT q FROM g) THEN 'held_out' END AS reason FROM r), v AS (SELECT DISTINCT q FROM m WHERE split = 'val' AND reason IS NULL AND q <> '')
SELECT split, coalesce(CASE WHEN reason IS NULL AND split = 'train' AND q IN (SELECT q FROM v) THEN 'val_duplicate' ELSE reason END, 'kept') AS reason, count(*) AS n FROM m GROUP BY ALL""")
def split_cleaning(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "translation_handoff").select("row_id", "split", "Question").distinct()
    held = table(spark, d, "gold_seeds").select(X.question_key(F.col("style_text")))
    train, val = leakage.clean_splits(rows.where("split = 'train'"), rows.where("split = 'val'"), X.question_key(F.col("Question")), held, F.length(F.coalesce("Question", F.lit(""))) < 60)
    return train.unionByName(val).groupBy("split", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT Topic, row_id, rank FROM (SELECT Topic, row_id, row_number() OVER (PARTITION BY Topic ORDER BY CASE WHEN source_dataset LIKE 'CYCLE%' THEN 0 ELSE 1 END, row_id) AS rank FROM (SELECT DISTINCT row_id, Topic, source_dataset FROM filtered)) WHERE rank <= 5""")
def top_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filtered").select("row_id", "Topic", "source_dataset").distinct()
    return sample.top_n(rows, ["Topic"], [F.when(F.col("source_dataset").startswith("CYCLE"), 0).otherwise(1), F.col("row_id")], 5).select("Topic", "row_id", "rank")


@query("""WITH r AS (SELECT DISTINCT row_id, Topic FROM filtered), n AS (SELECT *, row_number() OVER (PARTITION BY Topic ORDER BY md5('7|' || row_id), row_id) AS i, count(*) OVER (PARTITION BY Topic) AS c FROM r)
SELECT row_id, CASE WHEN i <= round_even(c * 0.05, 0) THEN 'val' ELSE 'train' END AS split FROM n""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return sample.stratified_split(table(spark, d, "filtered").select("row_id", "Topic").distinct(), "Topic", "row_id", 0.05, 7).select("row_id", "split")


@query("""SELECT Style, copy, count(*) AS n FROM (SELECT Style, unnest(range(1, CASE WHEN Style = 'ambiguous' THEN 4 ELSE 2 END)) AS copy FROM filtered) GROUP BY ALL""")
def oversample_rows(spark: SparkSession, d: str) -> DataFrame:
    return sample.oversample(table(spark, d, "filtered").select("Style"), F.col("Style") == "ambiguous", 3).groupBy("Style", "copy").agg(F.count("*").alias("n"))


@query("""SELECT split, chunk, count(*) AS n, min(row_id) AS first_id FROM (SELECT split, row_id, (row_number() OVER (PARTITION BY split ORDER BY row_id) - 1) // 72 AS chunk FROM (SELECT DISTINCT split, row_id FROM translation_handoff)) GROUP BY ALL""")
def batch_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "translation_handoff").select("split", "row_id").distinct()
    return sample.chunks(rows, ["split"], ["row_id"], 72).groupBy("split", "chunk").agg(F.count("*").alias("n"), F.min("row_id").alias("first_id"))


@query("""SELECT component, count(*) AS n FROM (SELECT 'cdc' AS component, qa_id AS k FROM (SELECT DISTINCT qa_id FROM cdc_reproductive_health_qa)
UNION ALL SELECT 'filtered', row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY Topic ORDER BY md5('3|' || row_id), row_id) AS i FROM (SELECT DISTINCT row_id, Topic FROM filtered)) WHERE i <= 20) GROUP BY 1""")
def data_mixture(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "cdc_reproductive_health_qa").select(F.col("qa_id").alias("k"), "Topic").distinct().dropDuplicates(["k"])
    b = table(spark, d, "filtered").select(F.col("row_id").alias("k"), "Topic").distinct()
    return sample.mixture([("cdc", a, None), ("filtered", b, 20)], "Topic", "k", 3).groupBy("component").agg(F.count("*").alias("n"))


@query("""SELECT item_key, 'item-' || format('{:03d}', dense_rank() OVER (ORDER BY gold_answer) - 1) AS group_id FROM gold_seeds""")
def group_ids(spark: SparkSession, d: str) -> DataFrame:
    return keyed.group_ids(table(spark, d, "gold_seeds"), "gold_answer", "item-").select("item_key", "group_id")


@query("""WITH p AS (SELECT DISTINCT seed_id FROM predictions), g AS (SELECT DISTINCT seed_id FROM gold_seeds)
SELECT CASE WHEN p.seed_id IS NOT NULL AND g.seed_id IS NOT NULL THEN 'both' WHEN p.seed_id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side, count(*) AS n FROM p FULL JOIN g ON p.seed_id = g.seed_id GROUP BY 1""")
def key_report(spark: SparkSession, d: str) -> DataFrame:
    return keyed.key_report(table(spark, d, "predictions"), table(spark, d, "gold_seeds"), "seed_id")


@query("""SELECT p.pred_id, coalesce(g.category, 'missing') AS category, coalesce(g.keywords, '') AS keywords FROM (SELECT DISTINCT pred_id, seed_id, style FROM predictions) p LEFT JOIN gold_seeds g ON g.seed_id = p.seed_id AND g.style = p.style""")
def left_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "predictions").select("pred_id", "seed_id", "style").distinct()
    return keyed.left_lookup(rows, table(spark, d, "gold_seeds"), ["seed_id", "style"], {"category": "missing", "keywords": ""}, [F.col("item_key")]).select("pred_id", "category", "keywords")


@query("""SELECT Answer, count(DISTINCT trim(regexp_replace(Answer_translated, '[ \\n\\t]+', ' ', 'g'))) AS values FROM translation_handoff GROUP BY 1 HAVING count(DISTINCT trim(regexp_replace(Answer_translated, '[ \\n\\t]+', ' ', 'g'))) > 1""".replace("\\\\", "\\"))
def dependency_violations(spark: SparkSession, d: str) -> DataFrame:
    return quality.dependency_violations(table(spark, d, "translation_handoff"), "Answer", F.trim(F.regexp_replace("Answer_translated", r"[ \n\t]+", " ")))


@query("SELECT qa_id, count(*) AS n FROM filtered GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, d, "filtered"), "qa_id")


# URLs without final marks and closers that they do not open, as in ``trim_url``
_URLS = r"""list_transform(regexp_extract_all({0}, 'https?://[^\s<>"'']+'), lambda u: list_concat([substr(u, 1, length(u) - length(regexp_extract(u, '([.,;:!?)\]}}]*)$', 1)))],
 list_filter(list_transform(range(0, length(regexp_extract(u, '([.,;:!?)\]}}]*)$', 1)) + 1), lambda k: substr(u, 1, length(u) - length(regexp_extract(u, '([.,;:!?)\]}}]*)$', 1)) + k)),
 lambda v: (suffix(v, ')') AND length(replace(v, '(', '')) <= length(replace(v, ')', ''))) OR (suffix(v, ']') AND length(replace(v, '[', '')) <= length(replace(v, ']', ''))) OR (suffix(v, '}}') AND length(replace(v, '{{', '')) <= length(replace(v, '}}', '')))))[-1])"""
_SIDES = (
    "WITH c AS (SELECT DISTINCT row_id, coalesce(Answer, '') AS s, coalesce(Answer_translated, '') AS t FROM translation_handoff), x AS (SELECT row_id, s, t"
    + "".join(
        f", {_STRIP.format(c)} = '' AS b_{c}, list_sort(regexp_extract_all(regexp_replace({c}, '\\\\u[0-9a-fA-F]{{4}}', '', 'g'), '\\p{{Nd}}+')) AS d_{c}, list_sort({_URLS.format(c)}) AS u_{c}, string_split({c}, chr(10)) AS l_{c}, {_SQUEEZE_ALL.format(c)} AS q_{c}, {_SQUEEZE_ALL.format(f'lower({c})')} AS f_{c}"
        for c in ("s", "t")
    )
    + " FROM c), y AS (SELECT *"
    + "".join(
        f", len(l_{c}) - 1 AS n_{c}, len(list_filter(list_slice(l_{c}, 2, len(l_{c}) - 1), lambda z: trim(z) = '')) AS e_{c}, list_reduce(list_prepend({c}, u_{c}), lambda acc, u: replace(acc, u, '')) AS w_{c}" for c in ("s", "t")
    )
    + " FROM x), m AS (SELECT *"
    + "".join(f", length(regexp_replace(w_{c}, '[^?؟]', '', 'g')) AS a_{c}, length(regexp_replace(w_{c}, '[^!]', '', 'g')) AS x_{c}" for c in ("s", "t"))
    + """ FROM y), v AS (SELECT row_id, unnest([CASE WHEN b_t THEN 'error blank' END, CASE WHEN NOT b_t AND d_s <> d_t THEN 'warning digits' END, CASE WHEN NOT b_t AND u_s <> u_t THEN 'error urls' END,
 CASE WHEN NOT b_t AND (n_s <> n_t OR e_s <> e_t) THEN 'error lines' END, CASE WHEN NOT b_t AND ((a_s > 0 AND a_s <> a_t) OR (x_s > 0 AND x_s <> x_t)) THEN 'warning marks' END,
 CASE WHEN NOT b_t AND length(q_s) >= 40 AND NOT length(q_t) / length(q_s) BETWEEN 0.35 AND 3.0 THEN 'warning length_ratio' END, CASE WHEN NOT b_t AND f_s = f_t THEN 'error unchanged' END,
 CASE WHEN NOT regexp_matches(row_id, '^(train|val)-[0-9]{8}$') THEN 'error key_shape' END]) AS v FROM m)
"""
)


@query(_SIDES + """SELECT split_part(v, ' ', 2) AS "check", count(*) AS n FROM v WHERE v IS NOT NULL AND v <> 'error key_shape' GROUP BY 1""")
def translation_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "translation_handoff").select("row_id", "Answer", "Answer_translated").distinct()
    return quality.translation_checks(rows, "row_id", "Answer", "Answer_translated").groupBy("check").agg(F.count("*").alias("n"))


@query(_SIDES + """SELECT split_part(v, ' ', 1) AS severity, split_part(v, ' ', 2) AS "check", count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY 1, 2""")
def expectations_report(spark: SparkSession, d: str) -> DataFrame:
    """All checks of the translated answers by severity."""
    rows = table(spark, d, "translation_handoff").select("row_id", "Answer", "Answer_translated").distinct()
    return quality.translation_checks(rows, "row_id", "Answer", "Answer_translated", r"^(train|val)-[0-9]{8}$").groupBy("severity", "check").agg(F.count("*").alias("n"))


@query("""SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL""")
def json_props_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


_NORM_C = """CASE WHEN {0} IN ('menstrual', 'pcos', 'fertility', 'other', 'none') THEN {0} WHEN contains({0}, 'pcos') OR contains({0}, 'pcod') OR contains({0}, 'polycystic') THEN 'pcos'
 WHEN contains({0}, 'fertil') OR contains({0}, 'conceiv') OR contains({0}, 'pregnan') THEN 'fertility' WHEN contains({0}, 'menstrual') OR contains({0}, 'period') OR contains({0}, 'cycle') OR contains({0}, 'bleed') THEN 'menstrual' WHEN {0} = '' THEN 'other' ELSE {0} END"""
_NORM_R = """CASE WHEN {0} IN ('see-doctor', 'see-a-doctor', 'doctor', 'medical-care', 'consult-doctor') THEN 'see-doctor' WHEN contains({0}, 'urgent') OR contains({0}, 'emergency') OR contains({0}, 'immediate') THEN 'urgent'
 WHEN contains({0}, 'routine') OR contains({0}, 'low') THEN 'routine' ELSE {0} END"""


@query("SELECT category, count(*) AS n FROM (SELECT " + _NORM_C.format("k") + " AS category FROM (SELECT replace(lower(trim(coalesce(Topic, ''))), '_', '-') AS k FROM filtered)) GROUP BY 1")
def category_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filtered").groupBy(X.normalize_category(F.col("Topic")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT risk, count(*) AS n FROM (SELECT " + _NORM_R.format("k") + r" AS risk FROM (SELECT regexp_replace(replace(lower(trim(coalesce(o_orderpriority, ''))), '_', '-'), '\s+', '-', 'g') AS k FROM orders)) GROUP BY 1")
def risk_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(X.normalize_risk(F.col("o_orderpriority")).alias("risk")).agg(F.count("*").alias("n"))


_PATTERNS = [("(?i)cramps?", 3.0), ("(?i)ultrasound", 2.0), ("(?i)thyroid", 2.0), ("(?i)walk", 1.0), ("(?i)cycle", 1.0)]


@query("SELECT CASE WHEN s >= 5 THEN 'clear' WHEN s >= 2 THEN 'borderline' ELSE 'reject' END AS tier, count(*) AS n, sum(s) AS score FROM (SELECT " + " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0 END" for p, w in _PATTERNS) + " AS s FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def keyword_tiering(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").where("text IS NOT NULL").select(X.weighted_score(F.col("text"), _PATTERNS)["score"].alias("s"))
    return s.groupBy(F.when(F.col("s") >= 5, "clear").when(F.col("s") >= 2, "borderline").otherwise("reject").alias("tier")).agg(F.count("*").alias("n"), F.sum("s").alias("score"))


@query("""WITH r AS (SELECT DISTINCT qa_id, Topic, length(coalesce(Answer, '')) % 3 AS k FROM cdc_reproductive_health_qa), n AS (SELECT *, lower(trim(regexp_replace(Topic, '\\s+', ' ', 'g'))) AS name FROM r),
b AS (SELECT name, qa_id, k, row_number() OVER (PARTITION BY name ORDER BY k DESC, qa_id) AS i FROM n WHERE name IS NOT NULL)
SELECT b.name, b.k AS rank, b.qa_id, c.evidences, c.conflict FROM b JOIN (SELECT name, count(*) AS evidences, count(DISTINCT k) > 1 AS conflict FROM n GROUP BY name) c ON b.name = c.name WHERE i = 1""".replace("\\\\", "\\"))
def merge_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cdc_reproductive_health_qa").where("Topic IS NOT NULL").select("qa_id", "Topic", "Answer").distinct()
    rows = rows.withColumn("pos", F.substring("qa_id", 5, 20).cast("long"))
    return keyed.merge_entries(rows, F.col("Topic"), F.length(F.coalesce("Answer", F.lit(""))) % 3, "pos", ["qa_id"])


# --- metrics -----------------------------------------------------------------

_SCORED = (
    r"""WITH p0 AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(trim(raw_response), '(?s)```(?:json)?\s*(\{.*?\})\s*```') THEN regexp_extract(trim(raw_response), '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1)
 WHEN strpos(raw_response, '{') > 0 AND length(raw_response) - strpos(reverse(raw_response), '}') + 1 > strpos(raw_response, '{') AND strpos(reverse(raw_response), '}') > 0 THEN substr(raw_response, strpos(raw_response, '{'), length(raw_response) - strpos(reverse(raw_response), '}') + 2 - strpos(raw_response, '{')) ELSE trim(raw_response) END, '[\x00-\x1F]', ' ', 'g') AS cand FROM predictions),
p1 AS (SELECT *, CASE WHEN json_valid(cand) THEN cand WHEN ltrim(cand) LIKE '{%' AND json_valid(cand || '}') THEN cand || '}' WHEN ltrim(cand) LIKE '{%' AND json_valid(cand || '"}') THEN cand || '"}' END AS js FROM p0),
p2 AS (SELECT *, json_extract_string(js, '$.predicted_category') AS pc, json_extract_string(js, '$.predicted_risk') AS pr, lower(json_extract_string(js, '$.asks_clarification')) AS ac, lower(json_extract_string(js, '$.unsafe_response')) AS us,
 coalesce(json_type(js) = 'OBJECT' AND json_type(js, '$.predicted_category') = 'VARCHAR' AND json_type(js, '$.predicted_risk') = 'VARCHAR' AND json_type(js, '$.interpreted_symptom') = 'VARCHAR' AND json_type(js, '$.recommended_action') = 'VARCHAR' AND json_type(js, '$.clarifying_question') = 'VARCHAR' AND json_type(js, '$.response_text') = 'VARCHAR'
 AND json_type(js, '$.asks_clarification') IN ('BOOLEAN', 'VARCHAR', 'UBIGINT') AND json_type(js, '$.unsafe_response') IN ('BOOLEAN', 'VARCHAR', 'UBIGINT'), false) AS shape FROM p1),
p3 AS (SELECT *, """
    + _NORM_C.format("replace(lower(trim(coalesce(pc, ''))), '_', '-')") + " AS nc, " + _NORM_R.format(r"regexp_replace(replace(lower(trim(coalesce(pr, ''))), '_', '-'), '\s+', '-', 'g')") + " AS nr, "
    + _NORM_C.format("replace(lower(trim(coalesce(gold_category, ''))), '_', '-')") + " AS gc, " + _NORM_R.format(r"regexp_replace(replace(lower(trim(coalesce(gold_risk_level, ''))), '_', '-'), '\s+', '-', 'g')")
    + """ AS gr, coalesce(lower(trim(requires_clarification)) = 'yes', false) AS wants, ac IN ('1', 'true', 'yes', 'y') AS asks, us IN ('1', 'true', 'yes', 'y') AS unsafe FROM p2),
s AS (SELECT *, shape AND trim(pc) <> '' AND trim(pr) <> '' AND nc IN ('menstrual', 'pcos', 'fertility', 'other') AND nr IN ('routine', 'see-doctor', 'urgent') AND ac IN ('1', '0', 'true', 'false', 'yes', 'no', 'y', 'n') AND us IN ('1', '0', 'true', 'false', 'yes', 'no', 'y', 'n') AS ok FROM p3),
z AS (SELECT *, ok AND nc = gc AS cc, ok AND nr = gr AS rc, ok AND asks = wants AS qc FROM s)
"""
)
_MEASURES = """count(*) AS n, count_if(ok) AS valid_prediction_count, round(count_if(ok) / count(*), 6) AS parse_ok_rate, round(coalesce(count_if(cc) / nullif(count_if(ok), 0), 0), 6) AS category_accuracy,
round(coalesce(count_if(rc) / nullif(count_if(ok), 0), 0), 6) AS risk_accuracy, round(coalesce(count_if(qc) / nullif(count_if(ok), 0), 0), 6) AS clarification_accuracy"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    return metrics.score(table(spark, d, "predictions"))


@query(_SCORED + f"""SELECT CASE g WHEN 15 THEN 'overall' WHEN 7 THEN 'model_label' WHEN 11 THEN 'language' WHEN 13 THEN 'style' ELSE 'gold_category' END AS dimension,
CASE g WHEN 15 THEN 'all' WHEN 7 THEN model_label WHEN 11 THEN language WHEN 13 THEN style ELSE gc END AS value, * EXCLUDE (g, model_label, language, style, gc) FROM (
SELECT grouping(model_label, language, style, gc) AS g, model_label, language, style, gc, {_MEASURES} FROM z GROUP BY GROUPING SETS ((), (model_label), (language), (style), (gc)))""")
def group_summary(spark: SparkSession, d: str) -> DataFrame:
    """Measures overall and by model, language, style and category, in one pass."""
    out = metrics.breakdowns(scored(spark, d), ["model_label", "language", "style", "gold_category"])
    rates = ("parse_ok_rate", "category_accuracy", "risk_accuracy", "clarification_accuracy")
    return out.select("dimension", "value", "n", "valid_prediction_count", *[F.round(r, 6).alias(r) for r in rates])


@query(_SCORED + """SELECT g.l AS gold, p.l AS predicted, count(z.pred_id) AS n FROM (SELECT unnest(['routine', 'see-doctor', 'urgent']) AS l) g CROSS JOIN (SELECT unnest(['routine', 'see-doctor', 'urgent', 'other']) AS l) p
LEFT JOIN z ON z.ok AND z.gr = g.l AND z.nr = p.l GROUP BY ALL""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(scored(spark, d), "gold_risk_level", "predicted_risk", metrics.RISK_LABELS)


@query(_SCORED + """SELECT gr AS label, round(count_if(nr = gr) / count(*), 6) AS recall, any_value(round(h / nullif(c, 0), 6)) AS precision FROM z JOIN (SELECT nr AS l, count(*) AS c, count_if(nr = gr) AS h FROM z WHERE ok GROUP BY 1) p ON p.l = z.gr WHERE ok GROUP BY gr""")
def recall_precision(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.recall_precision(metrics.confusion(scored(spark, d), "gold_risk_level", "predicted_risk", metrics.RISK_LABELS))
    return out.select("label", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query(_SCORED + "SELECT count(*) AS n, round(count_if(nr = 'routine') / count(*), 6) AS under_rate, round(count_if(nr = 'urgent') / count(*), 6) AS over_rate FROM z WHERE ok AND gr = 'see-doctor'")
def under_over_triage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.triage(scored(spark, d)).select("n", F.round("under_rate", 6).alias("under_rate"), F.round("over_rate", 6).alias("over_rate"))


@query(_SCORED + "SELECT count_if(wants) AS gold_yes, count_if(NOT wants) AS gold_no, round(count_if(wants AND asks) / nullif(count_if(wants), 0), 6) AS recall, round(count_if(NOT wants AND NOT asks) / nullif(count_if(NOT wants), 0), 6) AS specificity, count_if(NOT wants AND asks) AS false_alarms FROM z WHERE ok")
def clarification_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.clarification(scored(spark, d)).withColumns({c: F.round(c, 6) for c in ("recall", "specificity")})


@query(_SCORED + "SELECT round(count_if(ok AND NOT cc) / nullif(count_if(ok), 0), 6) AS rate, round((count_if(ok AND NOT cc) + count_if(NOT ok)) / count(*), 6) AS strict_rate FROM z")
def misunderstanding(spark: SparkSession, d: str) -> DataFrame:
    return metrics.misunderstanding(scored(spark, d)).select(F.round("rate", 6).alias("rate"), F.round("strict_rate", 6).alias("strict_rate"))


@query("SELECT round(max(c) / sum(c), 6) AS rate FROM (SELECT gold_risk_level, count(*) AS c FROM predictions GROUP BY 1)")
def majority_baseline(spark: SparkSession, d: str) -> DataFrame:
    return metrics.majority(table(spark, d, "predictions"), "gold_risk_level").select(F.round("rate", 6).alias("rate"))


@query(_SCORED + """SELECT round(coalesce(avg(same::int), 0), 6) AS rate, count(*) AS groups FROM (SELECT count(*) AS n, min(coalesce('=' || v, 'null')) = max(coalesce('=' || v, 'null')) AS same
FROM (SELECT model_label, seed_id, style, CASE WHEN ok THEN nr END AS v FROM z) GROUP BY model_label, seed_id, style) WHERE n >= 2""")
def consistency_across_languages(spark: SparkSession, d: str) -> DataFrame:
    return metrics.consistency(scored(spark, d), ["model_label", "seed_id", "style"], "predicted_risk").withColumn("rate", F.round("rate", 6))


def _per_item(spark: SparkSession, d: str, label: str) -> DataFrame:
    rows = scored(spark, d).where(F.col("model_label") == label)
    return dedup.first_per_key(rows, ["item_id"], [F.desc("pred_id"), F.desc("loaded_at")])


@query(_SCORED + """, l AS (SELECT item_id, model_label, cc, row_number() OVER (PARTITION BY item_id, model_label ORDER BY pred_id DESC) AS i FROM z), j AS (SELECT a.cc AS x, b.cc AS y FROM l a JOIN l b ON a.item_id = b.item_id AND a.i = 1 AND b.i = 1 AND a.model_label = 'M2_zero_shot' AND b.model_label = 'M3_en')
SELECT b, c, round(coalesce(power(abs(b - c) - 1, 2) / nullif(b + c, 0), 0), 6) AS chi2 FROM (SELECT count_if(x AND NOT y) AS b, count_if(NOT x AND y) AS c FROM j)""")
def mcnemar_pair(spark: SparkSession, d: str) -> DataFrame:
    return metrics.discordance(_per_item(spark, d, "M2_zero_shot"), _per_item(spark, d, "M3_en"), "item_id", "category_correct").withColumn("chi2", F.round("chi2", 6))


@query(_SCORED + """, m AS (SELECT model_label, language, count_if(ok) / count(*) AS r FROM z GROUP BY ALL) SELECT coalesce(a.language, b.language) AS language, round(a.r, 6) AS parse_ok_rate_base, round(b.r, 6) AS parse_ok_rate_other, round(b.r - a.r, 6) AS parse_ok_rate_delta
FROM (SELECT * FROM m WHERE model_label = 'M2_zero_shot') a FULL JOIN (SELECT * FROM m WHERE model_label = 'M3_ml') b ON a.language = b.language""")
def compare_summaries(spark: SparkSession, d: str) -> DataFrame:
    rates = scored(spark, d).groupBy("model_label", "language").agg(*metrics.group_measures())
    out = metrics.compare(rates.where("model_label = 'M2_zero_shot'"), rates.where("model_label = 'M3_ml'"), "language", ["parse_ok_rate"])
    return out.select("language", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query()
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    """(model_label, low, high): 95 % intervals of the parse rate."""
    counts = scored(spark, d).groupBy("model_label").agg(F.count_if("parse_ok").alias("hits"), F.count("*").alias("n"))

    def run(pdf):
        ends = [metrics.bootstrap_interval(int(h), int(n)) for h, n in zip(pdf.hits, pdf.n)]
        return pdf[["model_label"]].assign(low=[e[0] for e in ends], high=[e[1] for e in ends])

    return counts.groupBy("model_label").applyInPandas(run, "model_label string, low double, high double")


@query(_SCORED + "SELECT ok, (js IS NOT NULL AND NOT json_valid(cand)) AND ok AS json_repaired, count(*) AS n FROM z GROUP BY ALL")
def prediction_json_parse(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy(F.col("parse_ok").alias("ok"), "json_repaired").agg(F.count("*").alias("n"))


# --- rewriting, keys, time ---------------------------------------------------

@query("""SELECT item_key, s AS new_style, CASE s WHEN 'plain' THEN style_text WHEN 'polite' THEN 'Could you tell me: ' || style_text ELSE upper(style_text) END AS new_text FROM gold_seeds CROSS JOIN (SELECT unnest(['plain', 'polite', 'loud']) AS s)""")
def style_variants(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("style_text")
    return rewrite.variants(table(spark, d, "gold_seeds").select("item_key", "style_text"), {"plain": c, "polite": F.concat(F.lit("Could you tell me: "), c), "loud": F.upper(c)}, "new_style", "new_text").drop("style_text")


@query("""SELECT DISTINCT qa_id, 'Topic: ' || coalesce(Topic, '') || chr(10) || 'Q: ' || coalesce(Question, '') AS prompt FROM cdc_reproductive_health_qa""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cdc_reproductive_health_qa")
    return rows.select("qa_id", rewrite.render("Topic: {topic}\nQ: {question}", {"topic": F.col("Topic"), "question": F.col("Question")}).alias("prompt")).distinct()


@query(f"""SELECT DISTINCT qa_id, length(Question) + length(Answer) AS chars FROM (SELECT qa_id, {_STRIP.format('Question')} AS Question, {_STRIP.format('Answer')} AS Answer FROM cdc_reproductive_health_qa WHERE Answer IS NOT NULL)""")
def chat_records(spark: SparkSession, d: str) -> DataFrame:
    """Chat records, read back: the characters of both messages."""
    rows = table(spark, d, "cdc_reproductive_health_qa").where("Answer IS NOT NULL")
    chat = rows.select("qa_id", F.from_json(rewrite.chat_record(F.col("Question"), F.col("Answer")), "messages array<struct<role string, content string>>").alias("m"))
    return chat.select("qa_id", F.aggregate(F.col("m.messages"), F.lit(0), lambda a, x: a + F.length(x["content"])).alias("chars")).distinct()


_CORRECTIONS = [rewrite.Rule("r1", "Answer", "doctor", "physician"), rewrite.Rule("r2", "Answer", "physician for", "clinic for")]


@query("""WITH d AS (SELECT DISTINCT row_id, coalesce(Answer, '') AS a FROM translation_handoff), e AS (SELECT a, replace(a, 'doctor', 'physician') AS b FROM d)
SELECT count_if(contains(a, 'doctor')) AS r1_cells, sum((length(a) - length(replace(a, 'doctor', ''))) // 6)::BIGINT AS r1_replacements, count_if(contains(b, 'physician for')) AS r2_cells, sum((length(b) - length(replace(b, 'physician for', ''))) // 13)::BIGINT AS r2_replacements FROM e""")
def correction_counts(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.apply_rules(table(spark, d, "translation_handoff").select("row_id", "Answer").distinct(), "row_id", _CORRECTIONS)[1]


@query("""SELECT DISTINCT f.row_id FROM filtered f WHERE f.Question IS NOT NULL AND NOT EXISTS (SELECT 1 FROM translation_handoff t WHERE t.row_id = f.row_id)""")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "filtered").where("Question IS NOT NULL").select("row_id").distinct()
    return keyed.pending(rows, table(spark, d, "translation_handoff"), "row_id")


@query("""WITH n AS (SELECT DISTINCT row_id, 'new' AS state FROM translation_handoff WHERE split = 'val'), o AS (SELECT DISTINCT row_id, 'old' AS state FROM translation_handoff)
SELECT state, count(*) AS n FROM (SELECT * FROM o WHERE row_id NOT IN (SELECT row_id FROM n) UNION ALL SELECT * FROM n) GROUP BY 1""")
def upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "translation_handoff").select("row_id", "split").distinct()
    old, new = rows.select("row_id", F.lit("old").alias("state")), rows.where("split = 'val'").select("row_id", F.lit("new").alias("state"))
    return keyed.upsert(old, new, "row_id", [F.col("state")]).groupBy("state").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT Topic, count(*) AS c FROM filtered GROUP BY 1), b AS (SELECT Topic, count(*) AS c FROM cdc_reproductive_health_qa GROUP BY 1)
SELECT a.Topic, a.c - coalesce(b.c, 0) AS more FROM a LEFT JOIN b ON a.Topic IS NOT DISTINCT FROM b.Topic WHERE a.c > coalesce(b.c, 0)""")
def multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    return keyed.multiset_difference(table(spark, d, "filtered").select("Topic"), table(spark, d, "cdc_reproductive_health_qa").select("Topic"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def arrival_counts(spark: SparkSession, d: str) -> DataFrame:
    return inference.arrival_counts(table(spark, d, "events"), "ts", "event_type")


@query()
def near_dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    """(qa_id, cluster, keep): fuzzy clusters of answers that start alike or are about as long, and which to keep."""
    rows = table(spark, d, "cdc_reproductive_health_qa").select("qa_id", X.dedup_key(F.col("Answer")).alias("t"), F.length("Answer").alias("n")).where("t <> ''").distinct()
    pairs = dedup.blocked_links(rows, "qa_id", "t", [F.concat(F.lit("p"), F.substring("t", 1, 20)), F.concat(F.lit("len"), F.floor(F.length("t") / 20))])
    return dedup.fuzzy_clusters(rows, "qa_id", "t", pairs, ["n", "qa_id"]).select("qa_id", "cluster", "keep")


@query()
def diverse_selection(spark: SparkSession, d: str) -> DataFrame:
    """(Topic, row_id, place): ten questions of each topic, unlike each other, by source quotas."""
    rows = table(spark, d, "filtered").where("Topic IS NOT NULL AND Question IS NOT NULL").select("row_id", "Topic", "source_dataset", X.tokens(F.col("Question")).alias("tokens"), F.length("Question").alias("n"))
    return sample.diverse_selection(rows, "Topic", "row_id", "tokens", "source_dataset", ["n"], {"AskWard-100k": 0.4, "CYCLE_train": 0.3}, 10)


@query(r"""SELECT trim(coalesce(category, 'none')) AS heading, count(*) AS sections FROM documents WHERE length(trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}\x0B\x1C-\x1F\x85]+', ' ', 'g'))) >= 40 GROUP BY 1""")
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    """(category, sections): sections of pages made from the documents."""
    page = F.concat(F.lit("<html><body><nav>menu</nav><main><h2>"), F.coalesce("category", F.lit("none")), F.lit("</h2><p>"), F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></main></body></html>"))
    return H.page_sections(table(spark, d, "documents").select("doc_id", page.alias("page")), "doc_id", "page").groupBy("heading").agg(F.count("*").alias("sections"))


@query("SELECT round(count(DISTINCT Question) / count(Question), 6) AS ratio FROM filtered")
def distinct_question_ratio(spark: SparkSession, d: str) -> DataFrame:
    return quality.distinct_ratio(table(spark, d, "filtered"), "Question").select(F.round("ratio", 6).alias("ratio"))


@query("SELECT CASE WHEN count(n_chars) = count(*) THEN sum(n_chars) END AS n_chars, sum(doc_id) AS doc_id FROM documents")
def totals_or_null(spark: SparkSession, d: str) -> DataFrame:
    return quality.totals_or_null(table(spark, d, "documents"), ["n_chars", "doc_id"])


_FRENCH = ("le", "la", "les", "de", "des", "et", "un", "une", "vous", "est", "pour", "dans")


@query(rf"""WITH w AS (SELECT regexp_extract_all(lower(coalesce(Answer_translated, '')), '[\p{{L}}'']+') AS w FROM translation_handoff)
SELECT count(*) AS cells, round(avg(len(list_filter(w, lambda x: list_contains({list(_FRENCH)}, x))) / len(w)), 6) AS signal FROM w WHERE len(w) >= 3""")
def french_signal(spark: SparkSession, d: str) -> DataFrame:
    """The mean share of common French words in translated answers of three words or more."""
    s = table(spark, d, "translation_handoff").select(quality.word_signal(F.col("Answer_translated"), _FRENCH).alias("s")).where("s IS NOT NULL")
    return s.agg(F.count("*").alias("cells"), F.round(F.avg("s"), 6).alias("signal"))


@query(r"""SELECT text_kind, count(*) AS n FROM (SELECT CASE WHEN length(trim(coalesce(style_text, ''))) < 40 OR regexp_matches(coalesce(style_text, ''), '(?i)\b(?:something|somehow|maybe|not sure|weird|strange|what should i do|is this normal)\b')
 OR (contains(style_text, '?') AND length(trim(style_text)) < 70) THEN 'ask' ELSE 'answer' END AS text_kind FROM gold_seeds) GROUP BY 1""".replace("\\\\", "\\"))
def needs_clarification(spark: SparkSession, d: str) -> DataFrame:
    ask = quality.needs_clarification(F.col("style_text"))
    return table(spark, d, "gold_seeds").groupBy(F.when(ask, "ask").otherwise("answer").alias("text_kind")).agg(F.count("*").alias("n"))


@query("""SELECT item_id, pred_id FROM (SELECT item_id, pred_id, row_number() OVER (PARTITION BY item_id ORDER BY pred_id DESC) AS n FROM (SELECT DISTINCT item_id, pred_id FROM predictions)) WHERE n = 1""")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_per_key(table(spark, d, "predictions").select("item_id", "pred_id").distinct(), ["item_id"], [F.desc("pred_id")])


@query("""SELECT tier, count(*) AS n FROM (SELECT CASE WHEN contains(lower(text), 'emergency') OR contains(lower(text), 'at once') THEN 'high' WHEN contains(lower(text), 'ask your doctor') THEN 'moderate' ELSE 'low' END AS tier FROM documents WHERE text IS NOT NULL) GROUP BY 1""")
def marker_tiers(spark: SparkSession, d: str) -> DataFrame:
    tier = X.first_tier(F.col("text"), [("high", ("emergency", "at once")), ("moderate", ("ask your doctor",))], "low")
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))
