"""The training-data operators against brute force, round trips and held-out accuracy."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from tesserine.llm import bpe, encoding, langid, neardup, overlap, pairs, phrases, residue, shingles, visual

TOKENIZER = os.environ.get("TESSERINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
WORD = re.compile(r"[^\W_]+")


def sets(text, width=3):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def similarity(a, b, width=3):
    x, y = sets(a, width), sets(b, width)
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choices(vocabulary, k=r.randint(22, 60))) for _ in range(60)]
    texts = list(base)
    for t in base[:40]:
        w = t.split()
        for _ in range(r.randint(1, 4)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[r.choice(vocabulary)], [], [w[k], "new"]])
        texts.append(" ".join(w))
        texts.append(" ".join(w[len(w) // 2 :] + w[: len(w) // 2]))
    texts += [base[0]] * 30 + [base[0].upper().replace(" ", "; "), "", None, "short", "x " * 400, "é " * 30 + "ü"]
    return [(f"k{i:04d}", t) for i, t in enumerate(texts)]


def test_shingles_agree_with_plain_counting():
    texts = ["", None, "a", "Ab-c d_e 12 é", "x " * 5000, "İstanbul ß", "١٢ عمري 5"]
    h = shingles.hash_words(texts)
    doc, _ = h.shingles(3)
    for i, t in enumerate(texts):
        assert h.n_words[i] == len(WORD.findall((t or "").lower()))
        assert (doc == i).sum() == len(sets(t))
    assert shingles.hash_words(["A b", "a  B!"]).text_hash().tolist()[0] == shingles.hash_words(["a b"]).text_hash()[0]


def test_near_duplicates_equal_brute_force(spark, corpus, rows):
    df = spark.createDataFrame([(*r, "t", 1) for r in corpus] + [(*corpus[0], "t", 1), ("other", corpus[0][1], "u", 1), (None, "a b c", "t", 1)], "id string, text string, part string, grp int")
    found = neardup.near_duplicates(df, "id", "text", "part", similarity=0.6, width=3, min_words=20)
    use = [(k, t) for k, t in corpus if t and len(WORD.findall(t.lower())) >= 20]
    want = [("t", a, b) for i, (a, x) in enumerate(use) for b, y in use[i + 1 :] if similarity(x, y) >= 0.6]
    assert rows(found.pairs()) == sorted(want)
    groups = {(r.part, r.id): (r.group, r.links) for r in found.groups().collect()}
    assert len(groups) == len(use) + 1
    for _, a, b in want:
        assert groups["t", a][0] == groups["t", b][0]
    assert groups["u", "other"][0] != groups["t", "k0000"][0]


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id string, text string")
    found = neardup.near_duplicates(df, "id", "text")
    assert found.pairs().count() == 0 and found.groups().count() == 0


def test_near_duplicates_many_tasks(spark, corpus, rows, monkeypatch):
    monkeypatch.setattr(neardup, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(neardup, "PAIRS_AT_A_TIME", 7)
    df = spark.createDataFrame(corpus, "id string, text string")
    use = [(k, t) for k, t in corpus if sets(t, 5)]
    want = [("", a, b) for i, (a, x) in enumerate(use) for b, y in use[i + 1 :] if similarity(x, y, 5) >= 0.8]
    assert rows(neardup.near_duplicates(df, "id", "text").pairs()) == sorted(want)


@pytest.mark.parametrize("hot", [0, 3, 12])
def test_near_duplicates_with_hot_shingles(spark, corpus, rows, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "HOT_TIMES", 0)
    head = " ".join(f"head{i}" for i in range(12))
    texts = [*corpus, *((f"z{i}", f"{head} {t}") for i, t in corpus[::3] if t), *((f"y{i}", f"{head} own{i} words{i % 2}") for i in range(9))]
    use = [(k, t) for k, t in texts if sets(t)]
    want = [("", a, b) for i, (a, x) in enumerate(use) for b, y in use[i + 1 :] if similarity(x, y) >= 0.6]
    got = neardup.near_duplicates(spark.createDataFrame(texts, "id string, text string"), "id", "text", similarity=0.6, width=3)
    assert rows(got.pairs()) == sorted((p, *sorted((a, b))) for p, a, b in want)


def test_groups_of_one_prefix_are_expanded_and_verified(spark, rows, monkeypatch):
    """Texts that share size and rarest shingles but differ in their common ones."""
    from tesserine.llm import shingles

    monkeypatch.setattr(shingles, "TABLE", 4)
    monkeypatch.setattr(neardup, "PAIRS_AT_A_TIME", 3)
    common = [" ".join(f"c{k}{i}" for i in range(6)) for k in range(3)]
    texts = [(f"f{i:03d}", c) for i, c in enumerate(common * 20)]
    rare = [" ".join(f"r{k}{i}" for i in range(16)) for k in range(4)]
    texts += [(f"g{k}{i}", f"{r} {c}") for k, r in enumerate(rare) for i, c in enumerate(common)]
    want = [("", a, b) for i, (a, x) in enumerate(texts) for b, y in texts[i + 1 :] if similarity(x, y) >= 0.5]
    assert any(a[:2] == b[:2] and a[0] == "g" for _, a, b in want)
    only = [t for _, t in texts]
    made = neardup._prefixes([""] * len(only), np.arange(len(only)), only, np.zeros(neardup.COUNTERS, np.uint8), 2, 0.5, 3, 0, 4)
    packed = neardup._packed([made], np.arange(2)).to_pylist()
    found = {(min(a, b), max(a, b)) for row in packed for x, y in neardup._join_bucket(neardup._unpacked([row["body"]], 4), 0.5) for a, b in zip(x.tolist(), y.tolist())}
    assert {(i, j) for i, x in enumerate(only) for j, y in enumerate(only) if i < j and similarity(x, y) >= 0.5} <= found
    got = neardup.near_duplicates(spark.createDataFrame(texts, "id string, text string"), "id", "text", similarity=0.5, width=3)
    assert rows(got.pairs()) == sorted(want)


def covered(evaluation, trainings, width):
    """The share of a text's words in runs that one of the others holds."""
    w, held = WORD.findall(evaluation.lower()), set().union(*(sets(t, width) for t in trainings))
    at = {i + k for i in range(len(w) - width + 1) if tuple(w[i : i + width]) in held for k in range(width)}
    return len(at) / len(w)


@pytest.mark.parametrize("block,width,least", [(8, 3, 0.6), (1 << 17, 3, 0.6), (1 << 17, 5, 0.8), (1 << 17, 1, 0.3)])
def test_overlaps_equal_brute_force(spark, corpus, rows, monkeypatch, block, width, least):
    monkeypatch.setattr(overlap, "BLOCK", block)
    train = [r for i, r in enumerate(corpus) if i % 3]
    held = [r for i, r in enumerate(corpus) if not i % 3]
    frames = [spark.createDataFrame([*x, x[0]], "id string, text string") for x in (train, held)]
    got = overlap.split_overlaps(*frames, "id", "text", similarity=least, width=width)
    want = [(a, b) for a, x in train for b, y in held if x and y and similarity(x, y, width) >= least]
    assert rows(got.select("train_id", "eval_id")) == sorted(want)
    by_id = dict(train)
    for r in overlap.overlap_coverage(*frames, "id", "text", similarity=least, width=width).collect():
        partners = [a for a, b in want if b == r.eval_id]
        assert r.partners == len(partners) and r.coverage == pytest.approx(covered(dict(held)[r.eval_id], [by_id[a] for a in partners], width))
    for x, y in ((frames[0].limit(0), frames[1].limit(0)), (frames[0], frames[1].limit(0)), (frames[0].limit(0), frames[1])):
        assert overlap.split_overlaps(x, y, "id", "text").count() == 0


def test_long_texts_overlap(spark, rows):
    long = " ".join(f"w{i * 7919 % 100_000}" for i in range(30_000))
    t = spark.createDataFrame([("t1", long + " end"), ("t2", "a b c")], "id string, text string")
    e = spark.createDataFrame([("e1", "start " + long), ("e2", "")], "id string, text string")
    assert rows(overlap.split_overlaps(t, e, "id", "text").select("train_id", "eval_id")) == [("t1", "e1")]


def test_key_overlaps(spark, rows):
    t = spark.createDataFrame([("t1", "A:1"), ("t2", " "), ("t3", None)], "id string, k string")
    e = spark.createDataFrame([("e1", " a:1 "), ("e2", ""), ("e3", None)], "id string, k string")
    assert rows(overlap.key_overlaps(t, e, "id", "k")) == [("t1", "e1")]


def test_phrases_equal_brute_force(spark, rows):
    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(f"i{i}", " ".join(r.choices(vocabulary, k=20)), None if i % 3 else "same words for all of the items and one more to make twelve") for i in range(8)]
    docs = []
    for i in range(60):
        w = r.choices(vocabulary, k=30)
        if i % 3 == 0:
            s = items[i % 8][1].split()
            k, n = r.randrange(5), r.choice([11, 12, 15])
            w[10:10] = s[k : k + n]
        docs.append((i, ", ".join(w).upper()))
    docs += [(90, None), (91, ""), (92, "x " * 3000 + items[0][2]), (0, docs[0][1])]
    df, tests = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item string, a string, b string")

    def runs(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = {(d, k) for d, t in docs for k, a, b in items if runs(t) & (runs(a) | runs(b))}
    assert rows(phrases.find_phrases(df, "doc", "text", tests, "item", ["a", "b"])) == sorted(want, key=repr)
    near = {(x.doc, x.item): x.phrases for x in phrases.near_phrases(df, "doc", "text", tests, "item", ["a", "b"]).collect()}
    assert want <= set(near)
    counts = Counter(w for _, t in docs for w in WORD.findall((t or "").lower()))
    for slop in (0, 3, 12):
        near = {(x.doc, x.item): x.phrases for x in phrases.near_phrases(df, "doc", "text", tests, "item", ["a", "b"], slop=slop).collect()}
        assert near == near_by_hand(docs, items, slop, counts)
    assert phrases.find_phrases(df.limit(0), "doc", "text", tests, "item", ["a", "b"]).count() == 0
    assert phrases.find_phrases(df, "doc", "text", tests.limit(0), "item", ["a", "b"]).count() == 0


def near_by_hand(docs, items, slop, counts):
    """Items and their phrases whose three rarest words, ties by place, stand near their places beside the rarest."""
    out = Counter()
    words = {d: WORD.findall((t or "").lower()) for d, t in docs}
    for item, *texts in items:
        for p in {tuple(w[i : i + 12]) for t in texts for w in [WORD.findall((t or "").lower())] for i in range(len(w) - 11)}:
            rare = sorted(range(12), key=lambda k: (counts[p[k]], k))[:3]
            for d, w in words.items():
                at = [[i - k for i, x in enumerate(w) if x == p[k]] for k in rare]
                if any(all(any(abs(s - x) <= slop for x in other) for other in at[1:]) for s in at[0]):
                    out[d, item] += 1
    return dict(out)


def test_index_of_shards(spark, monkeypatch):
    made = phrases.Shard.of(["x y X", "", "y z"])
    assert made.first.tolist() == [0, 3, 3, 5] and len(made.terms) == 3
    x = phrases.hash_words(["x", "q"]).word
    assert made.places[made.starts[made.numbers(x)[0]] : made.starts[made.numbers(x)[0] + 1]].tolist() == [0, 2] and made.numbers(x)[1] == -1
    df = spark.createDataFrame([(i, f"w{i} same w{i}") for i in range(20)] + [(99, None), (98, "")], "d long, t string")
    monkeypatch.setattr(phrases, "DOCS", 3)
    index = phrases.build_index(df, "d", "t")
    assert sorted(d for r in index.select("docs").collect() for d in r.docs) == list(range(20))
    terms = np.sort(phrases.hash_words(["same w3 none"]).word)
    assert sorted(phrases.term_counts(index, terms).tolist()) == [0, 2, 20]


def test_phrases_do_not_cross_documents(spark, rows):
    words = [f"k{i}" for i in range(12)]
    df = spark.createDataFrame([(1, " ".join(words[:6])), (2, " ".join(words[6:])), (3, " ".join(words))], "d long, t string").coalesce(1)
    tests = spark.createDataFrame([("i", " ".join(words))], "item string, t string")
    assert rows(phrases.find_phrases(df, "d", "t", tests, "item", ["t"])) == [(3, "i")]
    assert rows(phrases.near_phrases(df, "d", "t", tests, "item", ["t"], slop=30).select("doc")) == [(1,), (3,)]  # the rarest, by ties the first three


def toy_merges(seed, alphabet="abc", n=25):
    """Merges learnt from random words, and their vocabulary."""
    r = random.Random(seed)
    words = [list("".join(r.choices(alphabet, k=r.randint(1, 12)))) for _ in range(60)]
    merges = []
    for _ in range(n):
        counts = Counter(p for w in words for p in zip(w, w[1:]))
        if not counts:
            break
        a, b = min(counts, key=lambda p: (-counts[p], p))
        merges.append((a, b))
        for w in words:
            i = 0
            while i < len(w) - 1:
                if w[i] == a and w[i + 1] == b:
                    w[i : i + 2] = [a + b]
                i += 1
    symbols = list(bpe.byte_symbols())
    return {s: i for i, s in enumerate(dict.fromkeys(symbols + [a + b for a, b in merges]))}, merges


def slow_bpe(word, merges):
    parts = list(word)
    ranks = {m: i for i, m in reversed(list(enumerate(merges)))}
    while len(parts) > 1:
        best = min(((ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:]))))
        if best[0] == 1 << 30:
            break
        a, b = parts[best[1]], parts[best[1] + 1]
        i, out = 0, []
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (a, b):
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


@pytest.mark.parametrize("seed", range(12))
def test_automaton_equals_merging(seed):
    vocab, merges = toy_merges(seed, "ab" if seed % 2 else "abc")
    automaton = bpe.TokenAutomaton(vocab, merges)
    r = random.Random(seed + 100)
    for _ in range(150):
        word = "".join(r.choices("ab" if seed % 2 else "abc", k=r.randint(1, 30)))
        assert automaton.encode_word(word.encode()) == [vocab[p] for p in slow_bpe(word, merges)]


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file")
def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    texts = ["Hello  world\n\n x", "", None, "عمري 43 سنة", "naïve café ½ Ⅳ 👩🏽‍⚕️", "<|endoftext|>", "I'LL we're", "a" * 5000, "​﻿\x00 月经", " lead", "trail \t "]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)] + [(1, "", 1)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode_rows(df, "doc_id", "text", TOKENIZER).collect()}
    for i, x in enumerate(texts):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else [])
    back = bpe.decode_rows(bpe.encode_rows(df, "doc_id", "text", TOKENIZER), "doc_id", "ids", TOKENIZER)
    assert {r.doc_id: r.text for r in back.collect()} == {i: x or "" for i, x in enumerate(texts)}


@pytest.mark.parametrize(
    "text,plain",
    [
        ("ｎｏｔｅｓ（１）", "notes(1)"), ("été", "été"), ("zero​width﻿ soft­hyphen", "zerowidth softhyphen"), ("5 mg x y　z", "5 mg x y z"), ("ﬁn", "fin"), ("ﻣﻦ", "من"),
        ("mаlаdіe", "maladie"), ("Νous", "Nous"), ("Οn", "On"), ("а", "a"), ("أ", "أ"),
    ],
)
def test_look_alikes(text, plain):
    assert visual.plain_look(text) == plain
    assert visual.plain_look(plain) == plain


@pytest.mark.parametrize("text", ["β-hCG x² ½ … a\nb", "تُشخَّص ًّ", "Ça œuvre æ ß", "π r²", "", "ρ = 0.5", "κ-opioid", "ν", "μg νm", "мама", "L’été — 38,5 °C « oui »", "TNFα"])
def test_plain_texts_stay(text):
    assert visual.plain_look(text) == text


def test_unify(spark, rows):
    df = spark.createDataFrame([(1, "Ｅｔｅ́  X", "a"), (2, "été x", "b"), (3, None, "c"), (4, "", "d"), (5, "ﬁ" * 5000, "e")], "k int, text string, form string")
    got = {r[0]: r[1:] for r in rows(visual.unify(df, ["k"], "text"))}
    assert got[1] == ("eté x", True) and got[2] == ("été x", False) and got[3] == (None, False) and got[4] == ("", False) and got[5] == ("fi" * 5000, True)
    assert visual.unify(df.limit(0), ["k"], "text").count() == 0


CLEAN = [
    "Depuis notre arrivée à Corholm, ma fille de 23 ans a aussi des bouffées de chaleur la nuit.", "Dois-je arrêter ce comprimé si je remarque une perte de cheveux aux tempes ?", "À l'âge de 24 ans, la durée du cycle peut encore varier d'un mois à l'autre.",
    "Est-ce normal d'avoir une fièvre de plus de 38,5 °C au jour 19 du cycle ?", "هل يجب أن أتوقف عن تناول الدواء إذا لاحظت زيادة مفاجئة في الوزن؟", "في عمر 36 سنة قد يختلف طول الدورة بمقدار 2 أيام من شهر إلى آخر.",
    "PÂLEUR, CÔLON et HÂTE figurent dans la liste, section Â.", "Go to the emergency unit at once if you also notice a fever.", "Meistens hilft es, mehr Wasser zu trinken, und die Beschwerden klingen ab.", "También es prudente beber más agua, sobre todo entre los días 5 y 8.",
]


@pytest.fixture(scope="module")
def damage_model():
    r = random.Random(3)
    texts = [" ".join(r.choices(CLEAN, k=3)).replace("24", str(r.randint(10, 60))) for _ in range(600)]
    return encoding.EncodingModel(texts)


@pytest.mark.parametrize("pair", [p for p in encoding.PAIRS if p.name in ("utf-8>latin-1", "utf-8>cp1252", "utf-8>mac_roman", "utf-8>cp437", "utf-8>cp1252*2", "cp1256>cp1252", "cp1252>utf-8", "utf-8>ascii")], ids=lambda p: p.name)
def test_damage_is_found_and_undone(damage_model, pair):
    labeller = encoding.Labeller(damage_model)
    for text in (CLEAN[0], CLEAN[4]):
        try:
            text.encode(pair.true)
        except UnicodeEncodeError:
            continue
        bad = pair.damage(text)
        if bad == text:
            continue
        damaged, whole, back, names = labeller.restore(bad)
        assert damaged
        if not pair.lossy:
            assert whole and back == text
        else:
            assert not whole and back == bad


def test_sound_texts_are_left_alone(spark, damage_model, rows):
    labeller = encoding.Labeller(damage_model)
    for t in [*CLEAN, "3 € … « Know your cycle »", "", "日本語 Ångström", "Wirklich?\nJa."]:
        assert labeller.restore(t)[0] is False, t
    half = CLEAN[2][:30].encode().decode("cp1252", "replace") + CLEAN[2][30:]
    df = spark.createDataFrame([(1, CLEAN[0], "x"), (2, None, "x"), (3, "", "x"), (4, half.replace("�", "\x80"), "x")], "k int, text string, damaged string")
    assert [r[1] for r in rows(encoding.restore_texts(spark, df, ["k"], "text", damage_model).select("k", "damaged"))] == [False, False, False, True]


def test_emissions_are_counted_on_all_sound_texts(spark):
    texts = [f"{CLEAN[i % len(CLEAN)]} {i}" for i in range(4000)] + ["a " * 2000 + "Łódź", "d" * 700 + " Ã©"]
    df = spark.createDataFrame([(t,) for t in [*texts, *texts[:500], "", None]], "t string")
    model = encoding.fit([df])
    whole = encoding.EncodingModel(texts)
    scale = encoding.WEIGHT / len(texts)
    for got, want in zip(model.states, whole.states, strict=True):
        assert (got.three[0] == want.three[0]).all() and np.allclose(got.three[1], want.three[1] * scale) and got.total == pytest.approx(want.total * scale)
    assert whole.states[0].total == sum(len(t) + 1 for t in texts if encoding.looks_sound(t)) == sum(len(t) + 1 for t in texts[:-1])
    assert set("Łódź") <= whole.sound
    assert encoding.fit([df.limit(0)]).states[0].total == 0


def test_damaged_trigrams_equal_those_of_damaged_texts(monkeypatch):
    texts = [*CLEAN, "日本 é\n\nŒx я", "\x00\x01é \U0001f600", "".join(map(chr, range(64))) + "ß", "".join(map(chr, range(64, 128))) + " É", "é" * 300]
    monkeypatch.setattr(encoding, "CHARS", 500)
    texts = [t for t in texts if encoding.looks_sound(t)]
    model = encoding.EncodingModel(texts)
    for state, damage in zip(model.states, [str, *(p.damage for p in encoding.PAIRS)], strict=True):
        bad = [damage(f"\n\n{t}\n") for t in texts]
        want = Counter(t[i : i + 3] for t in bad for i in range(len(t) - 2))
        assert {chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF): n for g, n in zip(state.three[0].tolist(), state.three[1].tolist())} == want


def test_look_alikes_are_sought_in_texts_that_all_sound_texts_speak_for(spark, rows, tmp_path):
    from tesserine.llm import entry

    docs = [f"Document {i} with plain words." for i in range(3)] + ["word " * 200 + "Łódź, Žižkov, Őrség."]
    spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows_ = [("r1", "fr", "Depuis mon arrivée à Łódź.", "plаin"), ("r2", "fr", CLEAN[0], None)]
    spark.createDataFrame(rows_, "row_id string, lang string, Question_translated string, Answer_translated string").write.parquet(str(tmp_path / "translation_handoff.parquet"))
    model = entry._encoding_model(spark, str(tmp_path))
    texts = {*docs, *(t for r in rows_ for t in r[2:] if t)}
    assert model.states[0].total == sum(len(t) + 1 for t in texts if encoding.looks_sound(t)) and set("ŽžŐ") <= model.sound
    assert rows(entry.p5_found(spark, str(tmp_path))) == [("r1", "Answer_translated")]


def test_one_text_among_many_speaks_for_its_letters(spark, rows, tmp_path):
    from tesserine.llm import entry

    many = [f"{CLEAN[i % len(CLEAN)]} {i}" for i in range(3 * encoding.WEIGHT)]
    rare = [f"Elle dit {w}, plаin." for w in ("RIÑÓN", "DÉÇU", "CRÉÉE", "BìÇ", "maÙÚk", "çëk", "öƝêÏn")]
    assert all(r[0] for r in encoding.Labeller(encoding.EncodingModel(many)).restore_all(rare))  # unless they are counted
    spark.createDataFrame([(0, CLEAN[7])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows_ = [(f"r{i}", "fr", t, None) for i, t in enumerate([*rare, *many])]
    spark.createDataFrame(rows_, "row_id string, lang string, Question_translated string, Answer_translated string").write.parquet(str(tmp_path / "translation_handoff.parquet"))
    assert rows(entry.p5_found(spark, str(tmp_path))) == [(f"r{i}", "Question_translated") for i in range(len(rare))]


@pytest.fixture(scope="module")
def languages():
    words = {
        "en": "the pain of a cycle may last for many days and you should ask your doctor if it does not stop when you rest at home with water".split(),
        "fr": "la douleur du cycle peut durer plusieurs jours et il faut demander à votre médecin si elle ne cesse pas quand vous êtes au repos chez vous".split(),
        "es": "el dolor del ciclo puede durar muchos días y usted debe preguntar a su médico si no cesa cuando descansa en casa con más agua".split(),
        "de": "der Schmerz des Zyklus kann viele Tage dauern und Sie sollten Ihre Ärztin fragen wenn er nicht aufhört obwohl Sie sich zu Hause ausruhen".split(),
        "ar": "قد يستمر ألم الدورة أيامًا كثيرة ويجب أن تسألي الطبيبة إذا لم يتوقف عندما ترتاحين في البيت مع المزيد من الماء".split(),
    }
    r = random.Random(4)
    make = lambda k: " ".join(" ".join(r.sample(words[k], 12)).capitalize() + "." for _ in range(3))
    texts = {k: [make(k) for _ in range(120)] for k in words}
    texts["fr"] += [make("en") for _ in range(12)]  # wrong labels
    return langid.fit(texts), make


def test_language_accuracy_and_calibration(languages):
    model, make = languages
    held = [(k, make(k)) for k in langid.LANGUAGES for _ in range(40)]
    p = model.chances([t for _, t in held])
    right = [langid.LANGUAGES[i] == k for i, (k, _) in zip(p.argmax(axis=1), held)]
    assert np.mean(right) >= 0.98
    assert np.allclose(p.sum(axis=1), 1) and (model.weights == 0).mean() > 0.5


def test_segments(spark, languages, rows):
    model, make = languages
    mixed = make("fr") + " " + make("ar")
    assert [x[1] for x in model.segments(mixed)] == ["fr", "ar"]
    assert [x[1] for x in model.segments(make("de") + " (Dr. Know)")] == ["de"]
    df = spark.createDataFrame([(1, mixed, "a"), (2, None, "b"), (3, " ", "c"), (4, "12 ...", "d"), (5, make("en") * 200, "e")], "k int, text string, lang string")
    got = rows(langid.label_segments(spark, df, ["k"], "text", model).select("k", "lang"))
    assert got == [(1, "ar"), (1, "fr"), (5, "en")]
    assert langid.sentences("One (two. three) four. Five « six. seven » eight. Dr. Nine ten.") == ["One (two. three) four.", "Five « six. seven » eight.", "Dr. Nine ten."]


@pytest.mark.parametrize(
    "raw,answer,defect",
    [
        (None, None, "empty"), ("```json\n```", None, "empty"), ("{}", None, "empty"), ('{"response_text": "​"}', None, "empty"), ('{"response_text": null}', None, "empty"), ('Here:\n{"response_text": "yes it is"}', "yes it is", None),
        ('```json\n{"response_text": "a } b"}\n```', "a } b", None), ('{"a": "b", "response_te', '{"a": "b", "response_te', "truncated"), ('{"response_text": "done."', '{"response_text": "done."', "truncated"), ("plain text", "plain text", None),
    ],
)
def test_unwrap(raw, answer, defect):
    assert pairs.unwrap(raw) == (answer, defect)


@pytest.mark.parametrize("text,empty", [(None, True), ("", True), ("  ​", True), ("N/A", True), ("...", True), ("—", True), ("[]", True), ("No.", False), ("nan is a bread", False)])
def test_empty(text, empty):
    assert pairs.is_empty(text) is empty


def test_pair_defects(spark, languages, rows):
    model, make = languages
    r = random.Random(9)
    data = [(f"Question {i} about {make('en').split('.')[0].lower()}?", make("en") + " " + make("en")) for i in range(300)] + [(make(k), make(k) + " " + make(k)) for k in langid.LANGUAGES for _ in range(60)]
    fitted = pairs.fit(data, model)
    held = [(f"Asked {i}: {make('en').split('.')[0].lower()}?", make("en") + " " + make("en")) for i in range(60)]
    checks = {"truncated": 0, "copies_question": 0, "refusal": 0, "other_language": 0, None: 0}
    for q, a in held:
        checks["truncated"] += "truncated" in fitted.defects([(q, a[: r.randint(60, len(a) - 20)].rstrip(" ."))])[0]
        checks["copies_question"] += "copies_question" in fitted.defects([(q, "Answer: " + q.upper())])[0]
        checks["refusal"] += "refusal" in fitted.defects([(q, "Sorry, I can't help with that. Ask a professional.")])[0]
        checks["other_language"] += fitted.defects([(q, make("ar"))])[0] == ["other_language"]
        checks[None] += fitted.defects([(q, a)])[0] == []
    assert all(n >= 54 for k, n in checks.items() if k != "truncated") and checks["truncated"] >= 40, checks
    df = spark.createDataFrame([(1, "q?", None, "x"), (2, None, "", "x"), (3, held[0][0], held[0][1], "x"), (4, held[0][0], '{"response_text": "' + held[0][1], "x")], "k int, q string, a string, defect string")
    assert rows(pairs.find_defects(spark, df.unionByName(df), ["k"], "q", "a", fitted)) == [(1, "empty"), (2, "empty"), (4, "truncated")]
    assert pairs.find_defects(spark, df.limit(0), ["k"], "q", "a", fitted).count() == 0


RESIDUE = [
        ("Some relief comes from {{first_name}} and rest.", "placeholder"), ("at ${city} now", "placeholder"), ("the <%= heading %> dose", "placeholder"), ("Hello %s, your cycle is %d days", "placeholder"), ("ask [INSERT CLINIC NAME HERE] for it", "placeholder"),
        ("use XXXX XXXX daily", "placeholder"), ("__user.age__ years", "placeholder"), ("TODO: add the source", "placeholder"), ("[اسم العيادة هنا]", "placeholder"), ("Lorem ipsum dolor sit amet consectetur", "filler"), ("nisi veniam aute ea exercitation dolore", None),
        ("Sample text goes here.", "filler"), ("Texte d'exemple à remplacer.", "filler"), ("404 - the page you are looking for was not found.", "error_page"), ("Page introuvable.", "error_page"), ("Access denied\nYou do not have permission to view this resource.", "error_page"),
        ("Please enable JavaScript in your browser to view this page.", "script_notice"), ("Ohne JavaScript kann diese Seite nicht angezeigt werden.", "script_notice"), ("يرجى تفعيل جافا سكريبت في المتصفح لعرض هذه الصفحة.", "script_notice"),
        ("The range {{4; 9}} in the chart stands for the days.", None), ("The booking page of Karwick needs JavaScript, so phone us if your browser blocks scripts.", None), ("A placeholder tablet without hormone follows after 5 days.", None),
        ("The draft leaflet still said lorem ipsum, which the team replaced.", None), ("Page 404 of the printed handbook lists rare causes.", None), ("Keep the dose at 500 mg; 56 % do.", None), ("<human>: hi <bot>: yo [1] (SOPK)", None), ("a_b__c___d", None), ("An error of 5 days in the due date is common.", None), ("", None),
]
# sound prose that merely has such words, and pages of which nothing else is known
RESIDUE += [(t, None) for t in ("Forbidden foods: none.", "Error 404 is a song by the band.", "The leaflet says scripts are disabled in older browsers and that is fine.", "The doctor wrote TODO on my chart.", "Forbidden Planet is a film.", "He asked no no no no.", "See [1] and [2, 3].")]
RESIDUE += [("Hold on: %(name)s is next", "placeholder"), ("Bad gateway Come back later.", "error_page"), ("Error 503", "error_page"), ("text text text text", "filler"), ("text\ntext\ntext\ntext", "filler"), ("asdf asdf qwer", "filler")]


def test_residue_wording(spark):
    texts = [t for t, _ in RESIDUE]
    found = {}
    for r in residue.find_residue(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect():
        found.setdefault(r.doc, set()).add(r.kind)
    for i, (text, kind) in enumerate(RESIDUE):
        got = found.get(i, set()) - {"page_template"}
        if text.startswith("nisi"):
            assert got <= {"filler"}
        else:
            assert got == ({kind} if kind else set()), text


def aligned_docs(n=12):
    """Records of a few templates, and some with what their template does not have."""
    r = random.Random(1)
    base = ["Some relief comes from rest and plenty of cold water", "Ask the nurse for a new leaflet before the next visit", "Keep the notes of all your days in one small book", "Most people feel well again after a few quiet weeks"]
    docs = [(i, f"{base[i % 4]}. {base[(i + 1) % 4]}. Day {i}.") for i in range(n)]
    for k, chunk in enumerate(("[clinic motto]", "{{first_name}}", "[city]", "TODO")):
        for i in range(4):
            w = base[i].split()
            at = r.randrange(2, 8)
            docs.append((100 * (k + 1) + i, f"{' '.join([*w[:at], chunk, *w[at:]])}. Day {i + k}."))
    return docs


def test_slots_are_induced_from_aligned_records(spark, rows):
    docs = aligned_docs()
    docs += [(600 + i, f"Put a cross into the box [box mark] at the top of page {i}. Seen {i * i}.") for i in range(6)] + [(700 + i, f"The range {{{{{i}; {i + 3}}}}} in the chart stands for the days {i}.") for i in range(6)]
    docs += [(800, None), (801, ""), (802, " "), (803, "ok " * 5000), (100, dict(docs)[100])]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, kind string")
    want = sorted([(100 + i, "slot_default") for i in range(4)] + [(k + i, "slot_aligned") for k in (200, 300, 400) for i in range(4)])
    assert sorted((d, k) for d, k in rows(residue.find_residue(df, "doc_id", "text")) if d < 800) == want
    # the same verdicts however often a record is copied
    more = df.unionByName(df.where("doc_id IN (100, 600)").crossJoin(spark.range(50)).selectExpr("doc_id + 1000 * (id + 1)", "text", "kind").toDF("doc_id", "text", "kind"))
    assert sorted((d, k) for d, k in rows(residue.find_residue(more, "doc_id", "text")) if d < 800) == want
    assert residue.find_residue(df.limit(0), "doc_id", "text").count() == 0


def test_page_templates_recur_on_pages(spark, rows):
    heads, tails = ["Access denied", "Bad gateway", "Request blocked"], ["Ask the keeper of the site.", "Quote number 7."]
    docs = [(i, f"{heads[i % 3]}\nThe address leads to nothing.\n{tails[i % 2]}\nPlace {i}.") for i in range(12)]
    docs += [(50 + i, f"The address leads to nothing.\nWords of its own {'abcdefgh'[i] * 3}.") for i in range(2)]
    docs += [(100 + i, f"This link in the page of the book names {'abcdefgh'[i] * 3}.\nOne line that many texts have.\n{i} words.") for i in range(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(residue.find_residue(df, "doc_id", "text"))
    assert {d for d, k in got if k == "page_template"} == {*range(12), 50, 51}
    assert {d for d, _ in got} == {*range(12), 50, 51}


@pytest.mark.parametrize("pattern,kind", [("FILLER", "filler"), ("NOTICE_STRONG", "script_notice"), ("NOTICE_MESSAGE", "script_notice"), ("NOTICE_WEAK", "script_notice"), ("ERROR_STRONG", "error_page"), ("ERROR_MESSAGE", "error_page"), ("ERROR_WEAK", "error_page")])
def test_stems_are_implied_by_the_patterns(pattern, kind):
    """Whatever a pattern finds in a text holds a stem of its group."""
    texts = [t for t, _ in RESIDUE] + ["410: The page was removed.", "Whoops, that didn't work", "Vous n'avez pas les droits pour cette rubrique, page absente.", "Zugriff verweigert", "تم رفض الوصول"]
    for t in texts:
        for s in residue.segments(t):
            if getattr(residue, pattern).search(s):
                assert any(x in s.lower() for x in residue.STEMS[kind]), s


def test_wrappers_and_quotes_of_any_length():
    lead = "Of course, here is what I think you asked me for in the message of this morning: "
    assert len(lead.split()) > 12 and pairs.unwrap(lead + '{"response_text": "yes it is"}') == ("yes it is", None)
    assert pairs.unwrap("The set {a; b} and {{1; 2}} stay.") == ("The set {a; b} and {{1; 2}} stay.", None)
    assert pairs.unwrap("Well then: {") == ("Well then: {", "truncated")
    for n in (10, 60, 200):
        assert len(langid.sentences("He said (" + "one. Two. " * n + "end). Next one.")) == 2
    assert langid.sentences("An open (bracket. Ends here. And here.") == ["An open (bracket.", "Ends here.", "And here."]


def test_refusals_of_any_length(languages):
    model, make = languages
    data = [(f"Question {i} about {make('en').split('.')[0].lower()}?", make("en") + " " + make("en")) for i in range(300)]
    fitted = pairs.fit(data, model)
    long = "Sorry, I can't help with that. I must decline to answer. I am unable to answer this. I would rather not comment. Unfortunately, questions of this kind are off limits. I cannot assist with this request. As an AI, I can't provide medical advice. I am not able to discuss this subject."
    assert len(pairs.words(long)) > 40 and "refusal" in fitted.defects([("Why does it hurt?", long)])[0]
    assert "refusal" not in fitted.defects([("Why does it hurt?", "Unfortunately, " + make("en") + " " + make("en"))])[0]


def test_leads_before_a_question():
    assert pairs.lead_in("Is it late?", "You asked: is it LATE") == 2 and pairs.lead_in("Is it late?", "Is it late? Yes.") is None and pairs.lead_in("", "x") is None and pairs.lead_in("Été?", "é t É") == 0


def test_bounded_samples(spark):
    from tesserine.llm.sampling import bounded_sample

    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS t", "CASE WHEN id < 19000 THEN 'a' WHEN id < 19990 THEN 'b' END AS g")
    got = bounded_sample(df, ["t"], 200, "g")
    assert set(got) == {"a", "b"} and all(180 <= len(v) <= 200 for v in got.values()) and all(len({r.t for r in v}) == len(v) for v in got.values())
    again = bounded_sample(df.repartition(13), ["t"], 200, "g")
    assert {k: sorted(r.t for r in v) for k, v in got.items()} == {k: sorted(r.t for r in v) for k, v in again.items()}
    assert bounded_sample(df.limit(0), ["t"], 5, "g") == {} and len(bounded_sample(df.limit(3), ["t"], 50, "g")["a"]) <= 3


def test_most_weights_of_seen_features_are_zero(languages):
    model, make = languages
    seen = np.unique(langid.features([make(k) for k in langid.LANGUAGES for _ in range(200)])[1])
    assert (model.weights[seen] == 0).mean() > 0.5


def test_labelling_side_by_side_is_labelling_one_by_one(damage_model, monkeypatch):
    r = random.Random(2)
    texts = [*CLEAN, "", *[encoding.PAIRS[r.randrange(len(encoding.PAIRS))].damage(t) for t in CLEAN for _ in range(6)], CLEAN[0] * 200]
    whole = encoding.Labeller(damage_model).restore_all(texts)
    monkeypatch.setattr(encoding, "CHARS", 400)
    labeller = encoding.Labeller(damage_model)
    assert [labeller.restore(t) for t in texts] == whole and labeller.restore_all(texts) == whole


def test_segment_borders_of_planted_mixtures(languages):
    model, make = languages
    r = random.Random(6)
    right = 0
    for _ in range(60):
        a, b, c = r.sample(langid.LANGUAGES, 3)
        parts = [(k, make(k)) for k in (a, b, c, a)]
        found = [(lang, text) for text, lang, _ in model.segments(" ".join(t for _, t in parts))]
        right += found == parts
    assert right >= 54, right  # of 60 texts of four parts, every border and language right


def test_restoration_of_planted_damage(damage_model):
    labeller = encoding.Labeller(damage_model)
    whole = found = total = false = 0
    for pair in encoding.PAIRS:
        for text in CLEAN:
            try:
                text.encode(pair.true)
            except UnicodeEncodeError:
                continue
            bad = CLEAN[7] + " " + pair.damage(text) + " " + CLEAN[7]
            if bad == f"{CLEAN[7]} {text} {CLEAN[7]}":
                continue
            total += 1
            damaged, _, back, _ = labeller.restore(bad)
            found += damaged
            whole += pair.lossy or back == f"{CLEAN[7]} {text} {CLEAN[7]}"
    for text in CLEAN:
        false += labeller.restore(text)[0]
    assert total > 60 and found >= 0.95 * total and whole >= 0.9 * total and not false, (total, found, whole, false)


def test_extra_columns_with_clashing_names(spark, rows):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    df = spark.createDataFrame([("a", text, 1, 2, "k", "s", 3), ("b", text + " fourteen", 1, 2, "k", "s", 3), ("c", None, None, None, None, None, None)], "id string, text string, key int, cls int, src string, kind string, h int")
    assert rows(neardup.near_duplicates(df, "id", "text").pairs()) == [("", "a", "b")]
    assert rows(overlap.split_overlaps(df.where("id = 'a'"), df, "id", "text").select("train_id", "eval_id")) == [("a", "a"), ("a", "b")]
    renamed = df.selectExpr("id AS doc", "text", "key AS docs", "cls AS phrase", "src AS terms", "kind AS item", "h AS first")
    tests = spark.createDataFrame([("i", text, "x", "y")], "item string, text string, phrase string, words string")
    assert rows(phrases.find_phrases(renamed, "doc", "text", tests, "item", ["text"])) == [("a", "i"), ("b", "i")]
    assert residue.find_residue(df, "id", "text").count() == 0
    assert rows(residue.find_residue(df.withColumn("text", df["src"]), "id", "text")) == []


def test_ties_and_very_long_texts(spark, rows):
    long = " ".join(f"w{i * 7919 % 5000}" for i in range(60_000))
    df = spark.createDataFrame([("a", long), ("b", long + " tail"), ("c", "same same same same same same"), ("d", "same same same same same same same"), ("e", "")], "id string, text string")
    assert rows(neardup.near_duplicates(df, "id", "text", width=3, similarity=0.8).pairs()) == [("", "a", "b"), ("", "c", "d")]
    found = residue.find_residue(spark.createDataFrame([(1, "word " * 200_000 + "{{first_name}}"), (2, "x " * 5)], "id long, text string"), "id", "text")
    assert {r.kind for r in found.where("doc = 1").collect()} >= {"placeholder"}


def test_many_shards_scan_candidates_only(spark, corpus, rows, monkeypatch):
    """Beyond DIRECT shards a training text meets those shards alone that hold a candidate; results stay whole."""
    joined = []
    monkeypatch.setattr(overlap, "prefix_join", lambda *x: joined.append(neardup.prefix_join(*x)) or joined[-1])
    monkeypatch.setattr(overlap, "BLOCK", 4)
    train, held = corpus[::2] + [("t", corpus[3][1]), ("s", "one two three")], corpus[1::2] + [("s", "One two; three")]
    frames = [spark.createDataFrame(x, "id string, text string") for x in (train, held)]
    got = rows(overlap.split_overlaps(*frames, "id", "text", similarity=0.6, width=3).select("train_id", "eval_id"))
    assert got == sorted((a, b) for a, x in train for b, y in held if x and y and similarity(x, y) >= 0.6)
    assert len(joined) == 1 and 0 < joined[0].count() < len({x for _, x in train}) * len({y for _, y in held}) / 8


def test_ranks_of_prefix_shingles_bound_the_partners():
    """Holders whose ranks rule the similarity out are not compared."""
    n = np.full(64, 80)
    rank = np.arange(64) % 33
    step = rank * neardup._LAST_RANK // neardup._last_rank(n, 0.6)
    reach = neardup._reach(n, step, 0.6)
    assert (reach == np.floor((80 - rank) * (1.6 / 0.6) - 80 + 1e-6)).all()
    for size, r in ((1, 0), (2, 0), (300, 119), (5000, 1234)):
        m = np.array([size])
        low = neardup._reach(m, np.array([r]) * neardup._LAST_RANK // np.maximum(neardup._last_rank(m, 0.6), 1), 0.6)[0]
        assert low >= np.floor((size - r) * (1.6 / 0.6) - size + 1e-6)  # rounding never loses a partner


def test_endings_of_any_length():
    assert pairs.ending("Rest a lot at home." + " " * 200) == ["lot", "at", "home"]
    assert pairs.ending(f"see the page {'x' * 150}") == ["the", "page", "x" * 150] and pairs.ending("one 12") == ["one", "0"] and pairs.ending("") == []
    assert pairs.ending("a " * 90 + "b c" + "." * 117) == ["a", "b", "c"]


def test_segments_of_damaged_texts(spark, monkeypatch):
    """Damaged texts come out too, as restored; p1_found alone is defined without them."""
    from tesserine.llm import entry

    monkeypatch.setattr(entry, "_language_model", lambda *_: None)
    monkeypatch.setattr(entry.langid, "label_segments", lambda spark, df, *_: df.selectExpr("*", "1D AS confidence"))
    d = "/root/testdata/sf0.001"
    damaged = {(r.row_id, r.field): r.restored for r in entry.p2_restored(spark, d).collect()}
    texts = {(r.row_id, r.field): r.text for r in entry.p1_segments(spark, d).collect()}
    assert damaged and all(texts[k] == v for k, v in damaged.items()) and len(texts) == entry._translated(spark, d).select("row_id", "field").distinct().count()
