"""Run records, handoffs, curation and the corrected functions on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tesserine.functions import modeljson
from tesserine.functions import text as X
from tesserine.operators import curation, handoff, keyed, metrics, quality, records, sample
from tesserine.sources import files
from tesserine.streaming import inference


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    "text,found",
    [
        ("see https://a.b/c_(d).", ["https://a.b/c_(d)"]), ("(https://a.b/c)", ["https://a.b/c"]), ("https://a.b/[x]]!", ["https://a.b/[x]"]), ("https://a.b/c?q=1, and https://a.a", ["https://a.a", "https://a.b/c?q=1"]),
        ("https://a.b/x).)", ["https://a.b/x"]), ("https://a.b/(x).y.", ["https://a.b/(x).y"]), ("none", []), (None, []), ("https://", []),
    ],
)
def test_urls_keep_the_brackets_they_open(spark, text, found):
    assert one(spark, text, X.urls) == found


def test_marks_are_counted_by_kind(spark):
    df = spark.createDataFrame([("a", "Really?", "Vraiment!"), ("b", "Go! https://x.y/?a=1", "Allez ! https://x.y/?a=1"), ("c", "Why?", "لماذا؟"), ("d", "Plain.", "Quoi ?"), ("e", "See https://x.y/z?", "Voir https://x.y/z")], "k string, s string, t string")
    found = {r.k: r.check for r in quality.translation_checks(df, "k", "s", "t").where("check = 'marks'").collect()}
    assert set(found) == {"a", "e"}


@pytest.mark.parametrize("text,key", [(" What now?\t\n", "what now?"), ("", ""), (None, None), ("  A", "a")])
def test_question_keys_lose_all_white_space_around(spark, text, key):
    assert one(spark, text, X.question_key) == key


@pytest.mark.parametrize("value", ["low x", " See  Doctor ", "URGENT_now", "see a doctor", "follow-up", "", "odd"])
def test_risk_has_one_rule(spark, value):
    assert one(spark, value, X.normalize_risk) == modeljson.risk_name(value)


@pytest.mark.parametrize("value", [" PCOS_x", "infertility", "menstruation", "", "Period pain", "none", " other\t"])
def test_category_has_one_rule(spark, value):
    assert one(spark, value, X.normalize_category) == modeljson.category_name(value)


def test_whole_keys_unless_a_cut_is_asked_for(spark):
    assert len(one(spark, "a" * 2000, X.dedup_key)) == 2000 and len(one(spark, "a" * 2000, lambda c: X.dedup_key(c, X.KEY_CHARS))) == 800


def test_ids_are_never_cut(spark):
    assert one(spark, "12345", lambda c: keyed.row_id(F.lit("train"), c.cast("long"))) == "train-12345"
    assert one(spark, "7", lambda c: keyed.row_id(F.lit("val"), c.cast("long"))) == "val-0007"
    df = spark.range(1200).select(F.format_string("v%05d", "id").alias("v"))
    assert keyed.group_ids(df, "v", "g-").agg(F.count_distinct("group_id")).first()[0] == 1200


def test_rows_are_numbered_in_a_group_of_any_size(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 400, "hot").when(F.col("id") < 450, "cold").alias("g"))
    got = sample.numbered_rows(df.repartition(7), "g", [F.desc("id")], "n").collect()
    assert sorted(r.n for r in got if r.g == "hot") == list(range(1, 401)) and sorted(r.n for r in got if r.g is None) == list(range(1, 51))
    assert all(r.n == 400 - r.id for r in got if r.g == "hot")
    assert sample.numbered_rows(df.limit(0), "g", ["id"], "n").count() == 0


def test_digests_of_files_that_do_not_decode(spark, tmp_path):
    for name, data in (("good", "Âge é".encode()), ("bad", b"\xff\xfe\x00a"), ("nul", b"a\x00b"), ("moji", "Ã©".encode())):
        (tmp_path / f"{name}.txt").write_bytes(data)
    got = {r.path.rsplit("/", 1)[1][:-4]: (r.valid_utf8, r.has_nul, r.damaged) for r in files.file_digests(spark, str(tmp_path)).collect()}
    assert got == {"good": (True, False, False), "bad": (False, None, None), "nul": (True, True, False), "moji": (True, False, True)}


def test_strict_csv_names_its_errors(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes(b"\xef\xbb\xbfa,b\r\n1,\"x\r\ny\"\r\n2\r\n3,4,5\r\n6,\"7\"\"8\"\r\n")
    rows, problems = files.read_strict_csv(str(p), ["a", "b"])
    assert rows == [["1", "x\r\ny"], ["6", '7"8']] and [e.split(":")[0] for e in problems] == ["record 2", "record 3"]
    assert files.read_strict_csv(str(p), ["a", "c"])[1]
    p.write_bytes(b"a,a\n1,2\n")
    assert files.read_strict_csv(str(p), ["a", "a"])[1]
    p.write_bytes(b"\xff")
    assert files.read_strict_csv(str(p), ["a"]) == ([], ["not UTF-8"])
    text = 'a,b\r\n1,"x\r\ny"\r\n"6 ""z""",\r\n'
    assert files.format_csv(files.parse_csv(text)) == text
    for bad in ('a,"b', 'a,b"c"', '"a"b,c'):
        with pytest.raises(ValueError):
            files.parse_csv(bad)


def test_locked_csv(spark, tmp_path):
    import hashlib

    p = tmp_path / "x.csv"
    p.write_text("a,b\n1,2\n")
    lock = {"sha256": hashlib.sha256(p.read_bytes()).hexdigest(), "columns": ["a", "b"], "rows": 1}
    assert files.read_locked_csv(spark, str(p), **lock).collect()[0].b == "2"
    for change in ({"sha256": "0"}, {"columns": ["b", "a"]}, {"rows": 2}):
        with pytest.raises(ValueError):
            files.read_locked_csv(spark, str(p), **(lock | change))


def test_set_numbers_of_two_files(spark, rows, tmp_path):
    for name, sets in (("a", ["1", "2.0", "3", ""]), ("b", ["1.0", "x"])):
        (tmp_path / f"{name}.csv").write_text("Question, Answer ,Topic,Set\n" + "".join(f"q{i},a,t,{s}\n" for i, s in enumerate(sets)))
    got = files.read_sets(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "Set", (1, 2))
    assert rows(got.select("source_row_id", "Set")) == [("a.csv:0", 1), ("a.csv:1", 2), ("b.csv:0", 1)]
    assert "Answer" in got.columns


def test_readers_by_suffix(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": "1"}\n\n{"a": "2"}\n')
    (tmp_path / "x.json").write_text('[{"a": "3"}]')
    (tmp_path / "x.csv").write_text("a\n4\n")
    assert [sorted(r.a for r in files.read_rows(spark, str(tmp_path / n), schema=None).collect()) for n in ("x.jsonl", "x.json", "x.csv")] == [["1", "2"], ["3"], ["4"]]
    with pytest.raises(Exception):
        (tmp_path / "y.jsonl").write_text('{"a": "1"}\n{bad\n')
        files.read_jsonl(spark, str(tmp_path / "y.jsonl"), "a string").collect()
    assert files.first_existing(str(tmp_path / "no"), str(tmp_path / "x.csv")).endswith("x.csv")


def test_provenance(tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("x")
    files.write_provenance(str(tmp_path / "p.json"), [str(source)], {"rows": 3})
    made = json.loads((tmp_path / "p.json").read_text())
    assert made["counts"] == {"rows": 3} and len(made["inputs"][0]["sha256"]) == 64


def record(**change):
    return json.dumps({"predicted_category": "PCOS", "interpreted_symptom": "s", "predicted_risk": "routine", "recommended_action": "a", "asks_clarification": "no", "clarifying_question": "", "unsafe_response": False, "response_text": "r"} | change)


@pytest.mark.parametrize(
    "raw,kind",
    [
        (record(), ""), (record(urgency="urgent"), ""), ("{}", "incomplete_schema"), (record(response_text=1), "incomplete_schema"), (record(predicted_risk=" "), "invalid_enum"), (record(asks_clarification="maybe"), "invalid_boolean"),
        (record(predicted_category="none"), "invalid_enum"), ("[1]", "non_object_json"), ("no json", "malformed_json"), (None, "response_contract_error"), (record()[:-1], ""), (record(predicted_risk="odd")[:-1], "malformed_json"),
    ],
)
def test_prediction_errors(raw, kind):
    assert modeljson.parse(raw)["error_kind"] == kind


def test_former_name_of_the_risk():
    raw = json.loads(record(urgency="urgent"))
    del raw["predicted_risk"]
    assert modeljson.parse(json.dumps(raw))["predicted_risk"] == "urgent"


def test_record_sets(spark, rows):
    df = spark.createDataFrame([("a", "m", "en"), ("a", "m", "en"), (" ", "m", "fr"), (None, "m", None)], "item_id string, model string, language string")
    assert rows(records.record_set_problems(df, "item_id", ["model", "language"], 3)) == [("blank_key", 2), ("mixed_groups", 3), ("repeated_key", 1), ("wrong_count", 1)]
    assert records.record_set_problems(df.limit(1), "item_id", ["model"], 1).count() == 0
    assert rows(records.record_set_problems(df.limit(0), "item_id", ["model"], 1)) == [("wrong_count", 0)]
    with pytest.raises(ValueError):
        records.validate_record_set(df, "item_id", ["model"])


def test_reparsing_touches_failed_rows_only(spark):
    df = spark.createDataFrame([(1, record(), "kept", ""), (2, record(), None, "malformed_json"), (3, "junk", None, "malformed_json"), (4, None, None, "malformed_json"), (5, " ", None, "malformed_json")], "k int, raw string, predicted_category string, error_kind string")
    got = {r.k: (r.predicted_category, r.error_kind, r.recovered) for r in records.reparsed(df, "raw", F.col("error_kind") != "").collect()}
    assert got == {1: ("kept", "", False), 2: ("pcos", "", True), 3: (None, "malformed_json", False), 4: (None, "malformed_json", False), 5: (None, "malformed_json", False)}


def test_jobs_and_cache(spark, rows):
    df = spark.createDataFrame([(0, "q", "a", "plain"), (1, "q", "a", "loud"), (2, "q", None, "plain"), (3, None, "b", "plain")], "pos int, q string, a string, style string")
    found = records.jobs(df, "pos", {"question": ("q", F.col("style")), "answer": ("a", F.lit("answer"))}, ["pos"])
    assert rows(found.select("kind", "text", "style", "pos", "rows")) == [("answer", "a", "answer", 0, 2), ("answer", "b", "answer", 3, 1), ("question", "q", "loud", 1, 1), ("question", "q", "plain", 0, 2)]
    assert found.where("key LIKE kind || ':%' AND length(source_sha256) = 64").count() == 4
    assert sorted(r.pos for r in records.smoke_subset(found, "pos", others=("answer", 1)).collect()) == [0, 0, 1]
    cache = found.where("text = 'a'").select("key", "source_sha256", F.lit("A").alias("value"))
    assert rows(records.from_cache(df, "answer", "a", F.lit("answer"), cache, "out").select("pos", "out")) == [(0, "A"), (1, "A"), (2, None), (3, None)]
    stale = cache.withColumn("source_sha256", F.lit("other"))
    assert records.from_cache(df, "answer", "a", F.lit("answer"), stale, "out").where("out IS NOT NULL").count() == 0


def test_response_ids(spark, rows):
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "batch int, id string")
    answered = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "d", " ")], "batch int, id string, value string")
    assert rows(records.response_problems(asked, answered, "batch", "id", "value")) == [(1, "missing", 1), (1, "repeated", 1), (2, "blank", 1), (2, "missing", 1), (2, "unknown", 1)]


def test_handoff_expectations(spark, rows):
    expected = spark.createDataFrame([("train-0001", "Q1", "A"), ("train-0002", "Q2", "A"), ("val-0001", "Q3", None)], "row_id string, Question string, Answer string")
    got = spark.createDataFrame([("train-0001", "train", "Q1", "A"), ("train-0001", "train", "Q1", "A"), ("val-0001", "train", "changed", ""), ("x", "val", "Q9", None)], "row_id string, split string, Question string, Answer string")
    assert rows(handoff.identity_problems(got, expected, "row_id", "split", r"^(train|val)-\d{4}$", ["Question", "Answer"])) == [("changed_Question", 1), ("key_shape", 1), ("key_split", 1), ("missing_key", 1), ("repeated_key", 1), ("unknown_key", 1)]
    assert rows(handoff.count_problems(got, "split", {"train": 3, "test": 1})) == [("split", "test", 0, 1), ("split", "val", 1, 0)]
    cells = spark.createDataFrame([(1, "PCOS and IVF", "SOPK et FIV"), (2, "PCOD", "PCOS"), (3, "PMS", "SPM PMS"), (4, "none", None), (5, "see https://x/PMS", "voir https://x/PMS")], "k int, s string, t string")
    assert rows(handoff.acronym_problems(cells, "k", "s", "t")) == [(2, "SOPK", True, True), (3, "SPM", False, True)]
    signals = handoff.language_signals(spark.createDataFrame([(1, "the pain and the cramp"), (2, "la douleur est là"), (3, "ok"), (4, None)], "k int, t string"), "k", "t", ("la", "est"), ("the", "and"))
    assert rows(signals) == [(1, 0, 3, True), (2, 2, 0, False)] and handoff.corpus_signal(signals).first()[0] == pytest.approx(2 / 5)
    with pytest.raises(ValueError):
        handoff.apply_translation(cells, "k", {"s": "t"})
    with pytest.raises(ValueError):
        handoff.require_pristine(cells, "k", ["t"])
    with pytest.raises(ValueError):
        handoff.template(spark.createDataFrame([("a",), ("a",)], "k string"), "k", ["k"], ["t"])


def test_benchmarks_and_variants(spark, rows):
    gold = spark.createDataFrame([("a", "canonical", "A", "low"), ("b", "slang", "B", "high")], "k string, style string, text string, risk string")
    done = spark.createDataFrame([("a", " é "), ("b", "ü")], "k string, t string")
    assert rows(handoff.translated_benchmark(gold, done, "k", "text", "t").select("k", "text", "risk")) == [("a", "é", "low"), ("b", "ü", "high")]
    with pytest.raises(ValueError):
        handoff.translated_benchmark(gold, done.withColumn("t", F.lit(" ")), "k", "text", "t")
    assert rows(handoff.merge_variants(gold, spark.createDataFrame([("b", "slang", "BB")], "k string, style string, text string"), ["k", "style"], "style", "text").select("k", "text")) == [("a", "A"), ("b", "BB")]
    with pytest.raises(ValueError):
        handoff.merge_variants(gold, gold.limit(0), ["k", "style"], "style", "text")
    with pytest.raises(ValueError):
        handoff.concatenated([gold, done])
    assert handoff.concatenated([gold, gold]).count() == 4
    same = handoff.positional_join(gold.select("k", "text"), gold.select("k", F.col("text"), "risk"), ["k"], ["text"])
    assert rows(same.select("k", "risk_right")) == [("a", "low"), ("b", "high")]
    with pytest.raises(ValueError):
        handoff.corrected(gold, gold.withColumn("risk", F.lit("x")), "k", ["risk"], ["text"])
    assert one(spark, "slang", lambda c: handoff.text_by_register(c, ("formal",), F.lit("f"), F.lit(" e "))) == "e"


@pytest.mark.parametrize("text,level", [("Call 999 now", "high"), ("Go to A&E", "high"), ("see a GP", "moderate"), ("rest", "low"), ("see a gp straight away", "high"), (None, "low")])
def test_urgency(spark, text, level):
    assert one(spark, text, curation.urgency) == level


def test_levels_categories_and_rewrites(spark, rows):
    assert one(spark, "low", lambda c: curation.highest(c, F.lit("moderate"), F.lit(None).cast("string"))) == "moderate"
    assert [one(spark, x, curation.clamp_category) for x in ("Menstruation", "PMS", "PCOS", "weather", None)] == ["menstrual", "menstrual", "pcos", "other", "other"]
    df = spark.createDataFrame([("a", " Ambiguous", "What is something? I'm not really sure"), ("b", "plain", "something, not really sure"), ("c", "ambiguous", "sometHING else"), ("d", None, None)], "k string, style string, text string")
    assert rows(df.where(curation.degenerate_rewrite(F.col("style"), F.col("text"))).select("k")) == [("a",)]
    assert curation.drop_by_source(df, df, "k", curation.degenerate_rewrite(F.col("style"), F.col("text"))).count() == 3


def test_tiers_fan_out(spark, rows):
    df = spark.createDataFrame([(1, "cycle and thyroid"), (2, "cycle"), (3, "walk"), (4, None)], "k int, t string")
    got = curation.tiers(df, F.col("t"), {"c": [("cycle", 3.0)], "h": [("thyroid", 2.0)]}, 3, 2, {"c": F.col("k") == 1})
    assert rows(got.select("k", "category", "tier")) == [(1, "c", "clear"), (1, "h", "borderline"), (2, "c", "borderline")]
    assert rows(curation.targets(got, "category", F.col("tier") == "clear", [(1, 1), (5, 4)])) == [("c", 1, 1), ("h", 0, 0)]
    both = spark.createDataFrame([("x", 1, "a"), ("y", 2, "a"), ("y", 3, "b"), ("y", 4, "c")], "category string, r int, t string")
    assert rows(curation.exclusive(both, F.col("t"), [("x", "1"), ("y", "2")], "category", "r", {"x": 5, "y": 1})) == [("x", 1, "a"), ("y", 3, "b")]


def test_grounding(spark, rows):
    bundle = spark.createDataFrame([("k1", "Cond", "u1", [("Intro", " about "), ("When to see a GP", "go now")]), ("k2", "Other", "u2", [("Intro", "plain")])], "key string, condition string, url string, sections array<struct<heading string, text string>>")
    evidence = curation.evidence_table(spark, bundle)
    df = spark.createDataFrame([(1, "Cond | u1"), (2, "Other|u2"), (3, "X | u3"), (4, "NEEDS"), (5, None)], "k int, condition string")
    got = curation.grounded(df, "condition", evidence, "(?i)see a gp")
    assert rows(got.select("k", "grounding", "action", "quote")) == [(1, "grounded", "go now", "go now"), (2, "grounded", "discuss: Other", "plain"), (3, "page_missing", None, None), (4, "needs_grounding", None, None), (5, "needs_grounding", None, None)]
    assert rows(curation.evidence_text(evidence, "condition"))[0] == ("Cond", "Intro\n about \n\nWhen to see a GP\ngo now")


def test_training_records(spark):
    df = spark.createDataFrame([("Why?", "  Rest. See a doctor. " + "x" * 900, "pms", False), ("Hm", "A.", None, True)], "q string, a string, t string, ask boolean")
    for cut, n in ((None, 920), (800, 800)):
        made = df.select(curation.json_training_record(F.col("q"), F.col("a"), F.col("t"), F.lit("routine"), F.col("ask"), F.lit("More?"), "P: {text}", cut).alias("r"))
        first, second = (json.loads(json.loads(r.r)["messages"][1]["content"]) for r in made.collect())
        assert len(first["response_text"]) == n and first["predicted_category"] == "menstrual" and first["interpreted_symptom"] == "Rest" and first["asks_clarification"] is False
        assert second["asks_clarification"] is True and second["response_text"] == second["clarifying_question"] == "More?"
    chat = df.select(curation.clarification_record(F.col("q"), F.lit("tell more"), F.when(F.col("ask"), "json").otherwise("chat"), F.lit("{}"), "P: {text}").alias("r")).collect()
    assert [[m["content"] for m in json.loads(r.r)["messages"]] for r in chat] == [["Why?", "tell more"], ["P: Hm", "{}"]]


def test_mix_keeps_val_and_probe_out(spark):
    make = lambda n, p: spark.createDataFrame([(f"{p}{i:03d}", "g") for i in range(n)], "k string, g string")
    train, val, clar = make(40, "t"), make(20, "v"), make(20, "c")
    rewrites = spark.createDataFrame([("t001",), ("v001",)], "k string")
    made = {n: [(r.component, r.k) for r in df.collect()] for n, df in curation.training_mix(train, val, clar, rewrites, "k", "g", 10, 5, 6, 1).items()}
    kinds = lambda rows, c: {k for x, k in rows if x == c}
    assert kinds(made["train"], "style") == {"t001"} and len(kinds(made["train"], "json")) == 10 and len(kinds(made["probe"], "triage")) == 5
    assert len(kinds(made["probe"], "clarification")) == 6 and not kinds(made["probe"], "clarification") & kinds(made["train"], "clarification")
    assert not any(k[0] == "v" for _, k in made["train"])


def test_judge_means(spark):
    df = spark.createDataFrame([("m", 1, True, None), ("m", 3, False, None), ("m", None, None, "bad_h"), ("n", None, None, "bad_h")], "model string, h int, unsafe boolean, judge_error string")
    got = {r.model: (r.n, r.judged, r.judge_errors, r.h, r.unsafe_rate) for r in metrics.judge_means(df, ["h"], ["model"]).collect()}
    assert got == {"m": (3, 2, 1, 2.0, 0.5), "n": (1, 0, 1, None, None)}


def test_sink_keeps_the_last_row_of_each_key(spark, rows, tmp_path):
    for k, data in enumerate(([("a", 1, "x"), ("a", 2, "y")], [("a", 0, "z"), ("b", 1, "w")])):
        spark.createDataFrame(data, "k string, at int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k string, at int, v string").parquet(str(tmp_path / "in"))
        inference.upsert_sink(stream, "k", "at", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert len(spark.read.parquet(str(tmp_path / f"out/batch={k}")).collect()) == (1, 2)[k]
    assert rows(inference.latest(spark, f"file://{tmp_path}/out", "k", "at")) == [("a", 0, "z"), ("b", 1, "w")]
    inference.compact(spark, str(tmp_path / "out"), "k", "at", str(tmp_path / "new"))
    assert rows(inference.latest(spark, str(tmp_path / "new"), "k", "at")) == [("a", 0, "z"), ("b", 1, "w")]


def test_required_text(spark):
    df = spark.createDataFrame([(None, " t ")], "a string, b string")
    assert df.select(keyed.required_text([F.col("a"), F.col("b")], F.lit("row")).alias("x")).first().x == "t"
    with pytest.raises(Exception):
        df.select(keyed.required_text([F.col("a")], F.lit("row"))).collect()


def test_recovery_takes_the_last_filled_value(spark, rows):
    df = spark.createDataFrame([("a", " "), ("b", "own"), ("c", None)], "k string, s string")
    other = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, " "), ("b", 1, "z")], "k string, at int, s string")
    assert rows(keyed.recover(df, other, "k", "s", ["at"])) == [("a", "y"), ("b", "own"), ("c", None)]


def greedy(data, shares, target, most=0.5):
    """The greedy choice over whole pools, for (g, k, tokens, bucket, order) rows."""
    out = []
    for g in {r[0] for r in data}:
        pool = sorted((r for r in data if r[0] == g), key=lambda r: (r[4], r[1]))
        chosen = []

        def walk(rows, room):
            for r in rows:
                s = set(r[2])
                if room > 0 and r[1] not in [c[1] for c in chosen] and not any(len(s & set(c[2])) >= most * max(len(s | set(c[2])), 1) for c in chosen):
                    chosen.append(r)
                    room -= 1

        for b, share in shares.items():
            walk([r for r in pool if r[3] == b], round(share * target))
        walk(pool, target - len(chosen))
        out += [(g, r[1], i + 1) for i, r in enumerate(chosen)]
    return out


@pytest.mark.parametrize("first", [1, 20])
def test_diverse_selection_equals_the_whole_walk(spark, rows, monkeypatch, first):
    import random

    monkeypatch.setattr(sample, "FIRST_SLICE", first)
    r = random.Random(3)
    data = [("copies", i, ["a", "b", "c"], "x", i) for i in range(130)] + [("copies", 200 + i, [f"u{i}", f"v{i}"], "y", 500 + i) for i in range(6)]
    data += [("mixed", 1000 + i, r.choices("abcdefghijkl", k=r.randint(1, 4)), r.choice("xyz"), r.randint(0, 50)) for i in range(150)] + [("few", 3000, ["q"], "x", 1), ("few", 3001, [], "x", 2), ("few", 3002, [], "x", 3)]
    df = spark.createDataFrame(data, "g string, k int, t array<string>, b string, o int")
    for shares, target in (({"x": 0.4, "y": 0.3}, 5), ({"x": 1.0}, 3)):
        assert rows(sample.diverse_selection(df, "g", "k", "t", "b", ["o"], shares, target)) == sorted(greedy(data, shares, target), key=repr)
    assert sample.diverse_selection(df.limit(0), "g", "k", "t", "b", ["o"], {"x": 1.0}, 3).count() == 0


def test_working_tables_are_deleted(spark):
    import os

    from tesserine import runtime

    with runtime.working_tables(spark):
        kept = runtime.stored_path(spark.range(3), "kept")
        assert runtime.stored(spark.range(3), "t").count() == 3 and os.path.exists(kept.removeprefix("file://"))
    assert not os.path.exists(kept.removeprefix("file://"))


def test_entries_keep_order_and_note_conflicts(spark):
    df = spark.createDataFrame([(1, " Heavy  Flow", "low", "rest", "u1"), (2, "heavy flow", "high", "go", "u2"), (3, "HEAVY FLOW", "high", "later", "u3"), (4, "Ache", "low", "wait", "u4"), (5, None, "low", "x", "u5")], "pos int, symptom string, risk string, action string, url string")
    out = {r.name: r for r in keyed.evidence_entries(df, F.col("symptom"), F.col("risk"), curation.LEVELS, "pos", ["symptom"], "action", {"source_url": "url"}, "c-s").collect()}
    assert [out[n].entry_id for n in ("ache", "heavy flow")] == ["c-s01", "c-s02"]
    h = out["heavy flow"]
    assert (h.level, h.action, h.symptom, [e.source_url for e in h.evidence], h.conflict_note) == ("high", "go", " Heavy  Flow", ["u1", "u2", "u3"], "levels differ (high, low); the higher one applies")
    assert out["ache"].conflict_note is None
    entries = spark.createDataFrame([("a", "x", "low", ["e"]), ("a", "x", "low", ["e"]), ("b", " ", "odd", []), ("c", "y", "high", ["e"])], "id string, symptom string, level string, evidence array<string>")
    assert sorted((r.id, r.problem) for r in keyed.entry_problems(entries, "id", ["symptom"], "level", curation.LEVELS, "evidence").collect()) == [("a", "repeated"), ("b", "blank_symptom"), ("b", "evidence"), ("b", "level")]


def test_resuming(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    earlier = spark.createDataFrame([("a", ""), ("b", "malformed")], "k string, error string")
    assert rows(keyed.resume(df, earlier, "k")) == [("c",)] and rows(keyed.resume(df, earlier, "k", F.col("error") != "")) == [("b",), ("c",)] and keyed.resume(df, None, "k").count() == 3


@pytest.mark.parametrize(
    "text,out",
    [
        ("Hello! Does the menstrual cycle hurt after a long run?", "Does something hurt after a long run? End."), ("Short. Tiny.", "Short. Tiny. End."), ("A b. " * 15, "A b. " * 12 + "A... End."), ("word " * 30, " ".join(["word"] * 30) + "? End."), ("Is period pain normal", "Is period pain normal? End."), ("", "? End."), (None, "? End."),
    ],
)
def test_blurred_questions(spark, text, out):
    from tesserine.operators import rewrite

    assert one(spark, text, lambda c: rewrite.blurred(c, F.lit("menstrual cycle"), F.lit("flow, PMS, hurtful"), "something", " End.")) == out


def test_rules_reach_rows_that_share_a_value(spark, rows):
    from tesserine.operators import rewrite

    df = spark.createDataFrame([("a", "A1", "x y"), ("b", "A1", "x"), ("c", "A2", "x"), ("d", None, "x")], "k string, a string, t string")
    out, counts = rewrite.apply_rules(df, "k", [rewrite.Rule("r", "t", "x", "z", ("a",), shared="a"), rewrite.Rule("s", "t", "z", "w", ("b",))])
    assert rows(out.select("k", "t")) == [("a", "z y"), ("b", "w"), ("c", "x"), ("d", "x")] and counts.first().asDict() == {"r_cells": 2, "r_replacements": 2, "s_cells": 1, "s_replacements": 1}


def test_claims_in_words(spark):
    from tesserine.operators import rewrite

    table = [("pain", "pain"), ("period pain", "period pain"), ("scan", "a scan"), ("walk", "a walk"), ("run", "a run")]
    say = lambda t: one(spark, t, lambda c: rewrite.in_words(rewrite.claims(c, table), 3, "none"))
    assert [say(t) for t in ("Period PAIN", "pain and scan", "pain scan walk run", "x", None)] == ["period pain", "pain and a scan", "pain, a scan, and a walk", "none", "none"]


@pytest.mark.parametrize("value,out", [("1.0", "1"), (" 2 ", "2"), ("nan", ""), (None, ""), ("", ""), ("B", "B")])
def test_set_numbers(spark, value, out):
    assert one(spark, value, curation.set_number) == out


def test_seed_keys_and_passages(spark, rows):
    seeds = spark.createDataFrame([("s", 1, "r1"), ("s", 2, "r2"), ("t", 1, "r3")], "id string, at int, row string")
    answers = spark.createDataFrame([("r2", "An answer."), ("r3", " "), ("r1", "Old")], "row string, a string")
    keys, hashes = curation.seed_keys(seeds, "id", ["at"], answers, "row", "a")
    assert rows(keys) == [("r2",), ("r3",)] and hashes.count() == 1
    pages = spark.createDataFrame([("p", [("H", "T"), ("I", "U")]), ("q", [("J", "V")])], "slug string, sections array<struct<heading string, text string>>")
    sources = spark.createDataFrame([("p", "Cond", "u")], "slug string, condition string, url string")
    assert rows(curation.passages(pages, sources, "slug")) == [("Cond", "u", 0, "H", "T"), ("Cond", "u", 1, "I", "U")]


def test_each_text_is_called_once(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "k int, p string")
    empty = spark.createDataFrame([], "key string, source_sha256 string, value string")
    have, new = inference.called_once(df, "p", "q", F.lit("plain"), empty, str.upper)
    assert have.where("raw_response IS NOT NULL").count() == 0 and new.count() == 2
    have, new = inference.called_once(df, "p", "q", F.lit("plain"), new, str.upper)
    assert rows(have.select("k", "raw_response")) == [(1, "A"), (2, "A"), (3, "B"), (4, None)] and new.count() == 0


def test_reports():
    text = files.comparison_report("New vs old", {"Overall": {"accuracy": (0.5, 0.75), "recall": (None, 0.1)}}, "old", "new")
    assert "| accuracy | 0.500 | 0.750 | +0.250 |" in text and "| recall | - | 0.100 | - |" in text
    assert files.shown(0.1234, 1, percent=True) == "12.3%" and files.shown_p(0.0004) == "<0.001" and files.shown_p(0.25) == "0.250" and files.shown_p(None) == "n/a"
    assert "none" in files.counts_report("Counts", {"a": [], "b": [{"k": "x", "n": 1}]})
