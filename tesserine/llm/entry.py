"""The queries of the training-data problems, whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import bpe, encoding, langid, neardup, overlap, pairs, phrases, residue, visual
from tesserine.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    texts = (
        table(spark, d, "filtered").select(F.lit("filtered").alias("tbl"), F.col("row_id").alias("id"), F.col("Question").alias("text"))
        .unionByName(table(spark, d, "cdc_reproductive_health_qa").select(F.lit("cdc_reproductive_health_qa").alias("tbl"), F.col("qa_id").alias("id"), F.col("Answer").alias("text")))
    )
    return neardup.near_duplicates(texts, "id", "text", "tbl", similarity=0.6, width=3, min_words=20)


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, id_a, id_b): pairs of one table with at least 20 words each and a similarity of 0.6."""
    return _near(spark, d).pairs().withColumnRenamed("part", "tbl")


@query
def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, id, group, links): the group of each document and its links to different texts."""
    return _near(spark, d).groups().withColumnRenamed("part", "tbl")


def _splits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "filtered")
    return rows.where("split = 'train'"), rows.where("split IN ('val', 'test')")


_LIKE = {"id_col": "row_id", "text_col": "Question", "similarity": 0.6, "width": 3}


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(row_id_a, row_id_b): a train row and a val or test row with the same qa_id or similar Questions."""
    train, evaluation = _splits(spark, d)
    both = overlap.split_overlaps(train, evaluation, **_LIKE).select("train_id", "eval_id").unionByName(overlap.key_overlaps(train, evaluation, "row_id", "qa_id")).distinct()
    return both.select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b"))


@query
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """(split, source_dataset, leaked_rows, by_text, by_key, overlaps, mean_coverage): evaluation rows that overlap with the train split by Question or by qa_id, the pairs by Question, and how much of these Questions the train split covers."""
    train, evaluation = _splits(spark, d)
    rows = evaluation.select(F.col("row_id").alias("eval_id"), "split", "source_dataset").distinct()
    by_text = overlap.overlap_coverage(train, evaluation, **_LIKE)
    by_key = overlap.key_overlaps(train, evaluation, "row_id", "qa_id").select("eval_id", F.lit(True).alias("keyed")).distinct()
    found = rows.join(by_text.join(by_key, "eval_id", "full_outer"), "eval_id")
    return found.groupBy("split", "source_dataset").agg(
        F.count("*").alias("leaked_rows"), F.count("partners").alias("by_text"), F.count("keyed").alias("by_key"), F.coalesce(F.sum("partners"), F.lit(0)).alias("overlaps"), F.round(F.avg("coverage"), 6).alias("mean_coverage")
    )


#: The public vocabulary that problem 7 encodes with.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@query
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ids): the token ids of every document's text; NULL and empty texts have none."""
    return bpe.encode_rows(table(spark, d, "documents"), "doc_id", "text", TOKENIZER)


@query
def p7_token_stats(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, documents and characters by source."""
    sizes = bpe.encode_rows(table(spark, d, "documents"), "doc_id", "text", TOKENIZER).select("doc_id", F.size("ids").alias("n"))
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return docs.join(sizes, "doc_id").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.sum("n_chars").alias("chars"))


def _translated(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, lang, field, text): the translated texts, one row each; a repeated row counts once."""
    rows = table(spark, d, "translation_handoff")
    fields = [F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("Question_translated", "Answer_translated")]
    return rows.select("row_id", "lang", F.explode(F.array(*fields)).alias("f")).select("row_id", "lang", "f.field", "f.text")


def _encoding_model(spark: SparkSession, d: str) -> encoding.EncodingModel:
    rows, docs = table(spark, d, "translation_handoff"), table(spark, d, "documents")
    return encoding.fit([rows.select("Question_translated"), rows.select("Answer_translated"), docs.select("text")])


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, field): the texts damaged by a wrong encoding."""
    return encoding.restore_texts(spark, _translated(spark, d), ["row_id", "field"], "text", _encoding_model(spark, d)).where("damaged").select("row_id", "field").distinct()


@query
def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, field, whole, pairs, restored): every damaged text and what its spans turn back into."""
    out = encoding.restore_texts(spark, _translated(spark, d), ["row_id", "field"], "text", _encoding_model(spark, d)).where("damaged")
    return out.select("row_id", "field", "whole", F.concat_ws(",", "pairs").alias("pairs"), "restored").distinct()


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, field): texts with characters that a plain one could replace without a change of look; damaged texts are left out."""
    damaged = encoding.restore_texts(spark, _translated(spark, d), ["row_id", "field", "text"], "text", _encoding_model(spark, d)).where("NOT damaged")
    return visual.unify(damaged, ["row_id", "field"], "text").where("differ").select("row_id", "field").distinct()


@query
def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """(form, texts): how many translated texts share each consistent form."""
    return visual.unify(_translated(spark, d), ["row_id", "field"], "text").where("form IS NOT NULL").distinct().groupBy("form").agg(F.count("*").alias("texts"))


def _leak_args(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "documents"), "doc_id", "text", table(spark, d, "gold_seeds"), "item_key", ["style_text", "gold_answer"]


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_key): documents with 12 consecutive words of an item's style_text or gold_answer."""
    return phrases.find_phrases(*_leak_args(spark, d), length=12).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_key"))


@query
def p8_proximity(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_key, phrases): documents with the rarest terms of an item's phrases close together."""
    return phrases.near_phrases(*_leak_args(spark, d), length=12, slop=12).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_key"), "phrases")


@query
def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """(item_key, docs): how many documents leak each item."""
    return p8_found(spark, d).groupBy("item_key").agg(F.count("*").alias("docs"))


SQL["p8_found"] = r"""
WITH items AS (SELECT item_key, unnest([style_text, gold_answer]) AS t FROM gold_seeds),
iw AS (SELECT item_key, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM items WHERE t IS NOT NULL),
ip AS (SELECT DISTINCT item_key, array_to_string(w[i:i+11], ' ') AS phrase FROM (SELECT item_key, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dp AS (SELECT doc_id, array_to_string(w[i:i+11], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_key FROM dp JOIN ip USING (phrase)
"""
SQL["p8_leaked_items"] = f"SELECT item_key, count(*) AS docs FROM ({SQL['p8_found']}) GROUP BY item_key"

# ties of the rarest terms go by offset; the other anchors must come near the rarest one
SQL["p8_proximity"] = r"""
WITH items AS (SELECT item_key, unnest([style_text, gold_answer]) AS t FROM gold_seeds),
iw AS (SELECT item_key, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM items WHERE t IS NOT NULL),
ip AS (SELECT DISTINCT item_key, w[i:i+11] AS p FROM (SELECT item_key, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12)),
ph AS (SELECT p, row_number() OVER () AS id FROM (SELECT DISTINCT p FROM ip)),
post AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL)),
n AS (SELECT term, count(*) AS n FROM post GROUP BY 1),
tm AS (SELECT id, unnest(p) AS term, unnest(range(12)) AS o FROM ph),
rk AS (SELECT id, tm.term, o, row_number() OVER (PARTITION BY id ORDER BY coalesce(n.n, 0), o) AS r FROM tm LEFT JOIN n ON n.term = tm.term),
h AS (SELECT doc_id, id, r, pos - o AS s FROM rk JOIN post ON post.term = rk.term WHERE r <= 3),
f AS (SELECT DISTINCT a.doc_id, a.id FROM h a JOIN h b ON a.r = 1 AND b.r = 2 AND a.doc_id = b.doc_id AND a.id = b.id AND abs(a.s - b.s) <= 12 JOIN h c ON c.r = 3 AND a.doc_id = c.doc_id AND a.id = c.id AND abs(a.s - c.s) <= 12)
SELECT doc_id, item_key, count(*) AS phrases FROM f JOIN ph USING (id) JOIN ip ON ip.p = ph.p GROUP BY ALL
"""

_TRIPLES = r"""
texts AS (SELECT DISTINCT * FROM ({source})),
w AS (SELECT tbl, id, grp, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w FROM texts WHERE t IS NOT NULL),
s AS (SELECT DISTINCT tbl, id, grp, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS s FROM (SELECT tbl, id, grp, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= {least})),
n AS (SELECT tbl, id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.tbl, a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.tbl = b.tbl AND a.s = b.s AND a.id < b.id {where} GROUP BY ALL),
p AS (SELECT c.tbl, id_a, id_b FROM c JOIN n na ON na.tbl = c.tbl AND na.id = id_a JOIN n nb ON nb.tbl = c.tbl AND nb.id = id_b WHERE c >= 0.6 * (na.n + nb.n - c) - 1e-9)
"""
SQL["p4_found"] = "WITH " + _TRIPLES.format(
    source="SELECT 'filtered' AS tbl, row_id AS id, 0 AS grp, Question AS t FROM filtered UNION ALL SELECT 'cdc_reproductive_health_qa', qa_id, 0, Answer FROM cdc_reproductive_health_qa", least=20, where=""
) + "SELECT tbl, id_a, id_b FROM p"
_P4_TEXTS = "SELECT 'filtered' AS tbl, row_id AS id, Question AS t FROM filtered UNION ALL SELECT 'cdc_reproductive_health_qa', qa_id, Answer FROM cdc_reproductive_health_qa"
# groups of texts by following links; small data only
SQL["p4_groups"] = "WITH RECURSIVE " + _TRIPLES.format(source=f"SELECT tbl, upper(md5(tbl || chr(31) || t)) AS id, 0 AS grp, t FROM ({_P4_TEXTS}) WHERE t IS NOT NULL", least=20, where="") + f""",
e AS (SELECT id_a AS x, id_b AS y FROM p UNION SELECT id_b, id_a FROM p), reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
cc AS (SELECT x, least(x, min(y)) AS g FROM reach GROUP BY x), l AS (SELECT x, count(*) AS n FROM e GROUP BY x),
m AS (SELECT DISTINCT tbl, id, upper(md5(tbl || chr(31) || t)) AS key FROM ({_P4_TEXTS}) WHERE t IS NOT NULL AND len(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+')) >= 20)
SELECT m.tbl, m.id, coalesce(cc.g, m.key) AS "group", coalesce(l.n, 0) AS links FROM m LEFT JOIN cc ON cc.x = m.key LEFT JOIN l ON l.x = m.key"""
_EVAL = _TRIPLES.format(source="SELECT 'filtered' AS tbl, row_id AS id, (split = 'train')::int AS grp, Question AS t FROM filtered", least=3, where="AND a.grp <> b.grp")
_KEYS = "k AS (SELECT DISTINCT row_id AS id, split = 'train' AS train, lower(trim(qa_id)) AS k FROM filtered WHERE trim(qa_id) <> '')"
SQL["p3_found"] = "WITH " + _EVAL + f""", {_KEYS}
SELECT id_a AS row_id_a, id_b AS row_id_b FROM p
UNION SELECT least(a.id, b.id), greatest(a.id, b.id) FROM k a JOIN k b ON a.k = b.k AND a.train AND NOT b.train"""
SQL["p3_report"] = "WITH " + _EVAL + f""", {_KEYS},
e AS (SELECT DISTINCT row_id, split, source_dataset FROM filtered WHERE split IN ('val', 'test')),
l AS (SELECT row_id AS eid, CASE WHEN id_a = row_id THEN id_b ELSE id_a END AS tid FROM p JOIN e ON row_id IN (id_a, id_b)),
r AS (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE id IN (SELECT eid FROM l)),
m AS (SELECT DISTINCT eid, i + o AS place FROM l JOIN r ON r.id = eid JOIN s ON s.id = tid AND s.s = w[i] || ' ' || w[i+1] || ' ' || w[i+2] CROSS JOIN (SELECT unnest([0, 1, 2]) AS o)),
v AS (SELECT eid, count(*) / any_value(len(w)) AS coverage FROM m JOIN (SELECT DISTINCT id, w FROM w) w ON w.id = eid GROUP BY eid),
t AS (SELECT eid, count(*) AS partners FROM l GROUP BY eid),
y AS (SELECT DISTINCT b.id AS eid FROM k a JOIN k b ON a.k = b.k AND a.train AND NOT b.train)
SELECT split, source_dataset, count(*) AS leaked_rows, count(t.eid) AS by_text, count(y.eid) AS by_key, coalesce(sum(partners), 0)::BIGINT AS overlaps, round(avg(coverage), 6) AS mean_coverage
FROM e LEFT JOIN t ON t.eid = row_id LEFT JOIN y ON y.eid = row_id LEFT JOIN v ON v.eid = row_id WHERE t.eid IS NOT NULL OR y.eid IS NOT NULL GROUP BY split, source_dataset"""


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id): documents that are, or contain, residue of templates and pages."""
    return residue.find_residue(table(spark, d, "documents"), "doc_id", "text").select(F.col("doc").alias("doc_id")).distinct()


@query
def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    """(kind, docs): documents by kind of residue."""
    return residue.find_residue(table(spark, d, "documents"), "doc_id", "text").groupBy("kind").agg(F.count("*").alias("docs"))


@query
def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """(source, kept): documents left by source once those with residue are excluded."""
    docs = table(spark, d, "documents")
    bad = residue.find_residue(docs, "doc_id", "text").select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(bad, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("kept"))


def _language_model(spark: SparkSession, d: str) -> langid.LanguageModel:
    docs, rows, runs = (table(spark, d, t) for t in ("documents", "translation_handoff", "predictions"))
    english = rows.select(F.explode(F.array("Question", "Answer")).alias("text"), F.lit("en").alias("lang"))
    asked = runs.select(F.col("input_text").alias("text"), F.col("language").alias("lang"))
    return langid.fit_table(docs.select("text", "lang").unionByName(english).unionByName(asked), "text", "lang")


def _sound_translations(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    """Translated texts that no wrong encoding damaged; p1_found is defined on these."""
    return encoding.restore_texts(spark, _translated(spark, d), [*keep, "text"], "text", _encoding_model(spark, d)).where("NOT damaged").select(*keep, "text")


_CODE = r"^([A-Za-z]+)(?:[-_].*)?$"


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, field, lang): each language of every text whose label is missing or not its only language."""
    texts = _sound_translations(spark, d, ["row_id", "field", "lang"])
    code = F.lower(F.regexp_extract(F.trim(F.coalesce("lang", F.lit(""))), _CODE, 1))
    texts = texts.select("row_id", "field", F.when(code == "und", "").otherwise(code).alias("code"), "text")
    parts = langid.label_segments(spark, texts, ["row_id", "field", "code"], "text", _language_model(spark, d))
    cases = parts.groupBy("row_id", "field", "code").agg(F.collect_set("lang").alias("langs")).where((F.size("langs") > 1) | (F.col("langs")[0] != F.col("code")))
    return cases.select("row_id", "field", F.explode("langs").alias("lang")).distinct()


@query
def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, field, segment, lang, confidence): the segments of every text with their languages; damaged texts are read as restored."""
    texts = encoding.restore_texts(spark, _translated(spark, d), ["row_id", "field"], "text", _encoding_model(spark, d)).select("row_id", "field", F.col("restored").alias("text"))
    return langid.label_segments(spark, texts, ["row_id", "field"], "text", _language_model(spark, d)).withColumn("confidence", F.round("confidence", 4)).distinct()


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    qa = table(spark, d, "cdc_reproductive_health_qa").select(F.lit("cdc_reproductive_health_qa").alias("tbl"), F.col("qa_id").alias("rec_id"), F.col("Question").alias("question"), F.col("Answer").alias("answer"))
    out = table(spark, d, "predictions").select(F.lit("predictions").alias("tbl"), F.col("pred_id").alias("rec_id"), F.col("input_text").alias("question"), F.col("raw_response").alias("answer"))
    return qa, out


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, rec_id, defect): a row for each defect of each pair."""
    qa, out = _pairs(spark, d)
    model = pairs.fit_tables([qa, out], _language_model(spark, d))
    return pairs.find_defects(spark, qa.unionByName(out), ["tbl", "rec_id"], "question", "answer", model)


@query
def p6_defect_counts(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, defect, pairs): pairs by table and type of defect."""
    return p6_found(spark, d).groupBy("tbl", "defect").agg(F.count("*").alias("pairs"))
