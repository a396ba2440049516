"""Record operators on small frames."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tesserine.functions import html, modeljson
from tesserine.functions import text as X
from tesserine.operators import dedup, keyed, leakage, metrics, quality, rewrite, sample
from tesserine.operators.components import connected_components
from tesserine.sources import files
from tesserine.streaming import inference


def good(**changes):
    return {"predicted_category": "pcos", "interpreted_symptom": "x", "predicted_risk": "low", "recommended_action": "y", "asks_clarification": False, "clarifying_question": "", "unsafe_response": False, "response_text": "z"} | changes


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, X.clean(lit(" a \r\n\r\n\r\n\r\nb\t c "))) == "a \n\nb c"
    assert one(spark, X.clean(lit(None))) == ""
    assert one(spark, X.dedup_key(lit("Hello Doctor, my CYCLE!! is 5"))) == "my cycle is 5"
    assert one(spark, X.normalize_category(lit("Polycystic_x"))) == "pcos"
    assert one(spark, X.normalize_category(lit(None))) == "other"
    assert one(spark, X.normalize_risk(lit("follow-up"))) == "routine"
    assert one(spark, X.normalize_risk(lit("See a doctor"))) == "see-doctor"
    assert one(spark, X.mostly_ascii(lit(""))) is False
    assert one(spark, X.truthy(lit("YES "))) is True
    assert one(spark, X.truthy(lit(None))) is False
    assert one(spark, X.first_sentence(lit("One two. Three"))) == "One two"
    assert one(spark, X.digit_runs(lit("b 12 \\u0020 7"))) == ["12", "7"]
    assert one(spark, X.urls(lit("see https://a.b/c). and"))) == ["https://a.b/c"]
    assert one(spark, X.token_jaccard(X.tokens(lit("a b")), X.tokens(lit("b c")))) == pytest.approx(1 / 3)
    assert one(spark, X.weighted_score(lit("a b"), [("a", 2.0), ("c", 5.0), ("b", 1.0)])["score"]) == 3.0


def test_common_subsequence_is_exact():
    import random

    def slow(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(1)
    for _ in range(200):
        x, y = ("".join(r.choice("abc") for _ in range(r.randrange(12))) for _ in "xy")
        assert X.common_subsequence(x, y) == slow(x, y)
    assert X.token_set_ratio("a b c", "c b a") == 100.0
    assert X.token_set_ratio("", "a") == 0.0


@pytest.mark.parametrize(
    "content,kind",
    [
        (json.dumps(good()), ""), ("```json\n" + json.dumps(good()) + "\n```", ""), ("Here: " + json.dumps(good()), ""), (json.dumps(good())[:-1], ""), (json.dumps(good())[:-2], ""),
        ("[1]", "non_object_json"), ("nothing", "malformed_json"), (None, "response_contract_error"), ("{}", "incomplete_schema"), (json.dumps(good(predicted_risk=3)), "incomplete_schema"),
        (json.dumps(good(predicted_category=" ")), "invalid_enum"), (json.dumps(good(predicted_category="none")), "invalid_enum"), (json.dumps(good(asks_clarification="perhaps")), "invalid_boolean"),
        (json.dumps({k: v for k, v in good(urgency="urgent").items() if k != "predicted_risk"}), ""), (json.dumps(good(response_text="a\nb")).replace("\\n", "\n"), ""), ('{"predicted_category": "pc', "malformed_json"),
    ],
)
def test_model_json(content, kind):
    assert modeljson.parse(content)["error_kind"] == kind


def test_repair_is_marked():
    assert modeljson.parse(json.dumps(good())[:-1])["json_repaired"] is True
    assert modeljson.parse(json.dumps(good()))["json_repaired"] is False


def test_html_sections(spark, rows):
    page = "<body><nav><p>no</p></nav><main><h1>A <b>title</b></h1><p>" + "x" * 50 + "</p><div class='share-bar'><p>no</p></div><h2></h2><h2>Short</h2><p>few</p><h3>List</h3><ul><li><p>" + "y" * 45 + "</p></li></ul></main></body>"
    assert [h for h, _ in html.sections(page)] == ["A title", "List"]
    df = spark.createDataFrame([(1, page), (2, None)], "id int, page string")
    assert [r[:3] for r in rows(html.page_sections(df, "id", "page"))] == [(1, 0, "A title"), (1, 1, "List")]


def test_quality_and_first_wins(spark, rows):
    long = "word " * 10
    df = spark.createDataFrame([(1, "q", long), (2, "q", long), (3, "q", "short"), (4, "q", "Please see your doctor" + " " * 4), (5, "q", None), (6, None, long)], "id int, q string, a string")
    got = quality.quality_reasons(df, "q", "a", ["id"])
    assert rows(got.select("id", "reason")) == [(1, None), (2, "exact_qa_dup"), (3, "answer_length"), (4, "junk_answer"), (5, "answer_length"), (6, "non_english_heuristic")]
    assert rows(quality.drop_counts(got.limit(0))) == []


def test_leakage(spark, rows):
    train = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "v"), (5, "h")], "id int, q string")
    val = spark.createDataFrame([(9, "v"), (8, "h")], "id int, q string")
    held = spark.createDataFrame([("h",), (None,)], "q string")
    t, v = leakage.clean_splits(train, val, F.col("q"), held, F.col("q") == "b")
    assert rows(t.select("id", "reason")) == [(1, None), (2, "degenerate"), (3, None), (4, "val_duplicate"), (5, "held_out")]
    assert rows(v.select("id", "reason")) == [(8, "held_out"), (9, None)]
    with pytest.raises(ValueError):
        leakage.require_no_leak(train, F.col("q"), held)


def test_sampling(spark, rows):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "id int, g string")
    s = sample.stratified_split(df, "g", "id", 0.1, 1)
    assert rows(s.groupBy("g", "split").count()) == [("a", "train", 45), ("a", "val", 5), ("b", "train", 45), ("b", "val", 5)]
    assert rows(s) == rows(sample.stratified_split(df.repartition(3), "g", "id", 0.1, 1))
    assert sample.oversample(df, F.col("g") == "a", 3).count() == 200
    assert sample.oversample(df, F.col("g") == "a", 0).count() == 100
    assert rows(sample.chunks(df, ["g"], ["id"], 30).groupBy("g", "chunk").count()) == [("a", 0, 30), ("a", 1, 20), ("b", 0, 30), ("b", 1, 20)]
    d = spark.createDataFrame([("t", i, ["w", str(i // 2)], "x", i) for i in range(6)], "t string, k int, tokens array<string>, b string, o int")
    assert rows(sample.diverse_selection(d, "t", "k", "tokens", "b", ["o"], {"x": 1.0}, 3, 0.9).select("k")) == [(0,), (2,), (4,)]


def test_diverse_selection_walks_the_whole_pool(spark, rows):
    copies = [("t", i, ["same", "short"], "x", 1) for i in range(700)]
    others = [("t", 1000 + i, [f"a{i}", f"b{i}"], "xy"[i % 2], 2 + i) for i in range(12)]
    d = spark.createDataFrame(copies + others + [("u", 5, ["same"], None, None)], "t string, k int, tokens array<string>, b string, o int")
    got = rows(sample.diverse_selection(d, "t", "k", "tokens", "b", ["o"], {"x": 0.5}, 10).select("t", "place", "k"))
    assert got == sorted([("t", 1 + i, k) for i, k in enumerate([0, 1000, 1002, 1004, 1006, 1001, 1003, 1005, 1007, 1008])] + [("u", 1, 5)], key=repr)


def test_keys(spark, rows):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("z", 2)], "k string, v int")
    assert rows(keyed.key_report(a, b, "k")) == [("both", 1), ("left_only", 1), ("right_only", 1)]
    with pytest.raises(ValueError):
        keyed.strict_join(a, b, "k")
    assert keyed.strict_join(a, a, "k", ["v"]).count() == 2
    assert rows(keyed.upsert(a, b, "k", [F.col("v")])) == [("x", 1), ("y", 2), ("z", 2)]
    assert rows(keyed.patch(a, b, "k", ["v"])) == [("x", 1), ("y", 2)]
    assert rows(keyed.multiset_difference(a.unionByName(a), b)) == [("x", 1, 1), ("y", 2, 2)]
    assert rows(keyed.first_order_difference(a.select(F.col("v").alias("p"), "k"), b.select(F.col("v").alias("p"), "k"), "p", "k")) == [(2, "y", "z")]
    assert rows(keyed.group_ids(a, "k", "g-", 2).select("k", "group_id")) == [("x", "g-00"), ("y", "g-01")]
    assert one(spark, keyed.item_id(F.lit(""), F.lit("row-3"), F.lit(None), F.lit("fr"))) == "row-3_canonical_fr"
    m = spark.createDataFrame([(0, " A ", 1, "p"), (1, "a", 3, "q"), (2, "a", 3, "r"), (3, "b", 1, "s")], "o int, n string, r int, p string")
    assert rows(keyed.merge_entries(m, F.col("n"), F.col("r"), "o", ["p"])) == [("a", 3, "q", 3, True), ("b", 1, "s", 1, False)]


def test_components(spark, rows):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (None, 3)], "a int, b int")
    got = dict(rows(connected_components(e)))
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == got[100] == 100 and len(got) == 42
    assert connected_components(e.limit(0)).count() == 0


def test_fuzzy_clusters(spark, rows):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d f"), (3, "a b c d e"), (4, "z"), (5, None)], "k int, t string")
    pairs = dedup.blocked_pairs(df, "k", "t", [F.substring("t", 1, 3)], threshold=80)
    got = rows(dedup.fuzzy_clusters(df, "k", "t", pairs, ["k"]).select("k", "cluster", "keep"))
    assert got == [(1, 1, True), (2, 1, False), (3, 1, False), (4, None, True), (5, None, True)]


def test_blocked_links_connect_what_brute_force_connects(spark, monkeypatch):
    import random

    monkeypatch.setattr(dedup, "SLICE", 8)
    r = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bdkm" for b in "aeo" for c in ("rt", "ling", "s")]
    texts = ["", "dart", "bos"]
    for _ in range(25):
        t = [r.choice(words) for _ in range(r.randrange(4, 30))]
        texts += [" ".join(t), " ".join(["thank", "you", *t[:-1], "now"]), " ".join(w[:-1] + "x" if r.random() < 0.3 else w for w in t)]
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").where("t <> ''")
    blocks = [F.concat(F.lit("p"), F.substring("t", 1, 5)), F.concat(F.lit("len"), F.floor(F.length("t") / 20))]
    links = dedup.blocked_links(df, "k", "t", blocks).collect()

    def parts(pairs):
        top = list(range(len(texts)))
        for a, b in pairs:
            top = [top[a] if x == top[b] else x for x in top]
        return sorted(sorted(i for i, x in enumerate(top) if x == y) for y in set(top))

    near = {(a, b) for a in range(len(texts)) for b in range(a) if texts[a] and texts[b] and (texts[a][:5] == texts[b][:5] or len(texts[a]) // 20 == len(texts[b]) // 20) and X.token_set_ratio(texts[a], texts[b]) >= 88}
    assert all((max(x.a, x.b), min(x.a, x.b)) in near for x in links)
    assert parts((x.a, x.b) for x in links) == parts(near) and any(len(p) > 1 for p in parts(near))


def test_near_dup_clusters_with_edits_near_both_ends(spark, tmp_path):
    from tesserine.plans.catalogue import QUERIES

    body = "regular light exercise may ease the cramps of the first days and a warm pad on the belly helps many women too"
    rows = [(1, f"See {body} at home."), (2, f"So {body} at work."), (3, "Ask the clinic.")]
    spark.createDataFrame(rows, "qa_id int, Answer string").write.parquet(str(tmp_path / "cdc_reproductive_health_qa.parquet"))
    got = QUERIES["near_dup_clusters"](spark, str(tmp_path)).orderBy("qa_id").collect()
    assert [(r.cluster, r.keep) for r in got] == [(1, False), (1, True), (None, True)]


def test_metrics(spark, rows):
    def rec(i, cat="pcos", risk="low", gold_c="pcos", gold_r="routine", want="no", raw=None):
        return (i, "m", "s", "st", "en", gold_c, gold_r, want, raw if raw is not None else json.dumps(good(predicted_category=cat, predicted_risk=risk)))

    data = [rec("1"), rec("2", risk="urgent", gold_r="see-doctor"), rec("3", gold_r="see-doctor"), rec("4", raw="broken"), rec("5", cat="fertility")]
    df = spark.createDataFrame(data, "item_id string, model_label string, seed_id string, style string, language string, gold_category string, gold_risk_level string, requires_clarification string, raw_response string")
    s = metrics.score(df).cache()
    assert rows(s.select("item_id", "parse_ok", "category_correct", "risk_correct"))[3] == ("4", False, False, False)
    assert rows(metrics.triage(s)) == [(2, 0.5, 0.5)]
    cells = {(r.gold, r.predicted): r.n for r in metrics.confusion(s, "gold_risk_level", "predicted_risk", metrics.RISK_LABELS).collect()}
    assert len(cells) == 12 and cells["see-doctor", "urgent"] == 1 and cells["urgent", "other"] == 0
    assert {r.label: r.recall for r in metrics.recall_precision(metrics.confusion(s, "gold_risk_level", "predicted_risk", metrics.RISK_LABELS)).collect()} == {"routine": 1.0, "see-doctor": 0.0, "urgent": None}
    overall = [r for r in metrics.breakdowns(s, ["model_label", "style"]).collect() if r.dimension == "overall"][0]
    assert (overall.n, overall.valid_prediction_count, overall.category_accuracy) == (5, 4, 0.75)
    assert rows(metrics.misunderstanding(s)) == [(0.25, 0.4)]
    b = s.withColumn("category_correct", F.lit(True))
    assert rows(metrics.discordance(b, s, "item_id", "category_correct"))[0][:2] == (2, 0)
    c = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), ("b", None), ("c", "x")], "g string, v string")
    assert rows(metrics.consistency(c, ["g"], "v")) == [(0.5, 2)]
    assert rows(metrics.consistency(c.limit(0), ["g"], "v")) == [(0.0, 0)]
    assert metrics.p_value(0.0, 0, 0) == 1.0
    low, high = metrics.exact_bootstrap([1.0] * 70 + [0.0] * 30, 500)
    assert low < 0.7 < high and metrics.bootstrap_interval(0, 0) == (0.0, 0.0)


def test_rewrite(spark, rows):
    df = spark.createDataFrame([("1", "a cat sat"), ("2", None)], "k string, t string")
    rules = [rewrite.Rule("x", "t", "cat", "dog", cells=1, replacements=1), rewrite.Rule("y", "t", "dog", "cow", keys=("1",))]
    out, counts = rewrite.apply_rules(df, "k", rules)
    assert rows(out) == [("1", "a cow sat"), ("2", None)]
    rewrite.require_counts(counts, rules)
    with pytest.raises(ValueError):
        rewrite.require_counts(counts, [rewrite.Rule("x", "t", "cat", "dog", cells=2)])
    assert one(spark, rewrite.redact_first(F.lit("I fear the Thyroid (a) now"), F.array(F.lit("ear"), F.lit("thyroid")), "it")) == "I fear it (a) now"
    assert one(spark, rewrite.plain_escapes(F.lit("l'eau \\u00a0x"))) == "l’eau  x"
    assert json.loads(one(spark, rewrite.chat_record(F.lit(" q "), F.lit("a"))))["messages"][0] == {"role": "user", "content": "q"}


def test_expectations(spark, rows):
    df = spark.createDataFrame([("train-1", "take 5 mg?", "prenez 6 mg"), ("x", "a", " "), ("train-2", "same", "same")], "k string, s string, t string")
    got = rows(quality.translation_checks(df, "k", "s", "t", r"^train-\d$").select("k", "check"))
    assert got == [("train-1", "digits"), ("train-1", "marks"), ("train-2", "unchanged"), ("x", "blank"), ("x", "key_shape")]


def test_files(spark, rows, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes(files.BOM + b'Question,Answer\n"a ""b""\nc",\nd,e\n')
    assert rows(files.read_csv(spark, str(p), ["Question", "Answer"])) == [('a "b"\nc', ""), ("d", "e")]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(p), ["Other"])
    assert files.add_bom(str(p)) is False
    j = tmp_path / "a.jsonl"
    j.write_text('{"text": "<human>: hi <bot>: yo"}\nbad\n\n{"text": "<human>: x"}\n')
    assert rows(files.conversations(spark, str(j))) == [(0, "hi", "yo"), (3, "x", None)]
    assert files.read_jsonl(spark, str(j), "text string", strict=False).count() >= 2
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    files.write_csv(df, str(tmp_path / "out"), ["v", "k", "new"])
    assert rows(files.read_csv(spark, str(tmp_path / "out"))) == [("", "2", ""), ("a", "1", "")]
    digest = files.file_digests(spark, str(j)).first()
    assert digest.valid_utf8 and not digest.damaged
    files.write_report({"a": 1}, str(tmp_path / "r" / "x.json"))
    assert json.loads((tmp_path / "r" / "x.json").read_text()) == {"a": 1}
    assert files.markdown([{"a": 0.5, "b": None}], ["a", "b"]).splitlines()[-1] == "| 0.500 | - |"
    assert [r.pos for r in files.with_positions(spark.read.text(str(j))).orderBy("pos").collect()] == [0, 1, 2, 3]


def test_streaming(spark, rows, tmp_path):
    source = tmp_path / "in"
    df = spark.createDataFrame([("1", 1, json.dumps(good())), ("1", 2, "bad"), ("2", 1, "bad")], "k string, o int, raw_response string")
    df.write.parquet(str(source))
    stream = inference.parsed(spark.readStream.schema(df.schema).parquet(str(source)))
    q = inference.upsert_sink(stream, "k", "o", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert rows(inference.latest(spark, str(tmp_path / "out"), "k", "o").select("k", "o", "error_kind")) == [("1", 2, "malformed_json"), ("2", 1, "malformed_json")]

    def call(p):
        if p == "1":
            raise RuntimeError("no")
        return p + "!"

    assert rows(inference.called(df.select("k").distinct(), "k", call)) == [("1", None, "no"), ("2", "2!", None)]


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz0123", "éàñ中文字\U0001f600abc", "".join(map(chr, range(0x4E00, 0x4F40)))])
def test_links_connect_what_all_similar_pairs_connect(letters, monkeypatch):
    monkeypatch.setattr(dedup, "LANES", 16)
    monkeypatch.setattr(dedup, "CHUNK", 64)
    r = random.Random(letters)
    words = ["".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(60)]
    texts = list(dict.fromkeys(" ".join("".join(c for c in w if r.random() > p) + r.choice(["", "", letters[0]]) for w in words if r.random() > 0.15) for p in (0, 0.03, 0.1, 0.4) for _ in range(14)))
    similar = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if X.token_set_ratio(texts[i], texts[j]) >= 80]
    half = len(texts) // 2

    def groups(links):
        of = list(range(len(texts)))
        for i, j in links:
            of = [of[i] if g == of[j] else g for g in of]
        return [of.index(g) for g in of]

    assert groups(dedup._links(texts, texts, True, 80.0)) == groups(similar) and similar
    across = [(i, j + half) for i, j in dedup._links(texts[:half], texts[half:], False, 80.0)]
    assert groups(across) == groups([(i, j) for i, j in similar if i < half <= j])
    # every comparison, not only those that connect
    sets = [set(t.split()) for t in texts]
    spelling = {ord(c): k for k, c in enumerate(sorted({" ", *letters}))}
    open_ = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] - sets[j] and sets[j] - sets[i]]
    rests = [(" ".join(sorted(sets[i] & sets[j])), " ".join(sorted(sets[i] - sets[j])), " ".join(sorted(sets[j] - sets[i]))) for i, j in open_]
    for threshold in (50.0, 80.0, 95.0):
        want = [200.0 * X.common_subsequence(f"{both} {x}".strip(), f"{both} {y}".strip()) / len(f"{both} {x}".strip() + f"{both} {y}".strip()) >= threshold for both, x, y in rests]
        assert dedup._rests_alike([(len(b) + 1 if b else 0, x.translate(spelling), y.translate(spelling)) for b, x, y in rests], len(spelling), threshold).tolist() == want
