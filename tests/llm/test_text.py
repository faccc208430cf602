"""Codec, languages, quality and toxicity against the tokenizer library, brute force and held-out labels."""
import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF
from spatialscore.llm import bpe, langid, quality, queries, toxicity
from spatialscore.llm.common import crc_mod, crc_of, table

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(json.load(open(PATH, encoding="utf-8")))
ODD = ["", " ", "<|endoftext|>a <|endoftext|>  b", "a\x1cb\x1f \x85 x᠎  y", "it's we'll I'D", "漢字🙂👩‍👧 ½²٣",
       "x" * 5000, "ab" * 3000 + " " * 70 + "!" * 900, "\x00\x01", "éé", "﻿ hi\xad", "  a\n\n b\t"]


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_as_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(CODEC.encode(text)) == want
    assert CODEC.decode(CODEC.encode(text)) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    assert ids(CODEC.encode(text)) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.decode(CODEC.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=2, max_size=60))
def test_segment_tree_merges_as_a_plain_scan(values):
    codec = bpe.Codec.__new__(bpe.Codec)
    codec.key_of = {a << 32 | b: ((a * 7 + b) % 50) << 32 for a in range(301) for b in range(301) if (a + b) % 3 == 0}
    codec.made = [400 + r for r in range(50)]
    plain = list(values)
    while True:
        ranked = [(codec.key_of.get(a << 32 | b), i) for i, (a, b) in enumerate(zip(plain, plain[1:]))]
        ranked = [x for x in ranked if x[0] is not None]
        if not ranked:
            break
        rank, i = min(ranked)
        plain[i:i + 2] = [codec.made[rank >> 32]]
    assert codec.merge(list(values)) == plain


def test_memory_change_keeps_results(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 2)
    text = "one two three four one two three four five one"
    assert ids(CODEC.encode(text)) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_registered_digests(spark):
    got = {r["doc_id"]: r for r in queries.op1_bpe(spark, SF).collect()}
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        packed = np.array(want, "<u4").tobytes()
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(want), hashlib.sha256(packed).hexdigest())
        assert g["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_encode_and_decode_tables(spark):
    d = spark.createDataFrame([(1, "a b <|endoftext|>", 1), (2, None, 2), (2, "", 3), (None, "ü", 4)], "doc_id long, text string, ids int")
    e = bpe.encode(d, PATH)
    back = sorted((str(r[0]), r[1]) for r in bpe.decode(e, PATH).collect())
    assert back == [("1", "a b <|endoftext|>"), ("2", ""), ("2", ""), ("None", "ü")]
    assert bpe.digests(d.limit(0), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, [50256, 999999]), (2, None)], "doc_id long, ids array<int>"), PATH).where(
        "doc_id = 1").first()["text"] == "<|endoftext|>"


def test_languages_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    got = queries.op3_langid(spark, SF).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: crc_of(i) % 5 == 0 for i in truth}
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_odd_rows(spark):
    train = spark.createDataFrame(
        [(i, t, x, 0) for i, (t, x) in enumerate([("weather forecast tomorrow morning sunshine", "en"), ("Wettervorhersage Sonnenschein Regenschirm übermorgen", "de"), (None, "en"), ("x", None)] * 20)],
        "doc_id long, text string, lang string, score int")
    model = langid.fit(train)
    assert set(model.names) == {"en", "de"}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "Sonnenschein übermorgen"), (4, "Sonnenschein übermorgen"), (5, "sunshine tomorrow forecast " * 9000)],
                                "doc_id long, text string")
    got = sorted((r[0], r[1]["lang"], r[1]["rejected"]) for r in odd.select("doc_id", langid.identify(odd, model)).collect())
    assert got == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "de", False), (4, "de", False), (5, "en", False)]
    none = langid.fit(train.limit(0))
    assert none.names == () and odd.select(langid.identify(odd, none).alias("r")).select("r.lang").distinct().collect()[0][0] == "und"


def test_texts_without_a_letter_have_no_language(spark):
    model = langid.Languages(("en", "de"), (b"the and of", b"der die das"))
    judge = langid.Judge(model)
    assert all(judge(t) == ("und", 0.0, True) for t in ("½ ²", "①②", "Ⅷ", "12 _", "", None))
    assert judge("½ the")[0] == "en"


def test_repeated_words_count(spark):
    """Every piece of a text counts, so the larger part of a mixed text decides, however few its different words are."""
    train = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([
        ("weather forecast tomorrow morning sunshine rain cloud wind storm", "en"), ("Wetter Vorhersage Sonnenschein Regenschirm übermorgen Wolke Sturm", "de")] * 30)], "doc_id long, text string, lang string")
    judge = langid.Judge(langid.fit(train))
    assert judge("weather forecast tomorrow " * 8000 + "Vorhersage Sonnenschein Regenschirm übermorgen")[0] == "en"


def test_one_id_many_times_teaches(spark):
    train = spark.createDataFrame([(1, "weather forecast tomorrow", "en")] * 9000, "doc_id long, text string, lang string")
    assert langid.fit(train, docs_per_language=10).names == ("en",)


def test_null_features_score_as_an_empty_text(spark):
    d = spark.createDataFrame([(1, None), (2, [0.0] * len(quality.FEATURES))], "id long, features array<double>")
    model = quality.fit(d.where("id = 2").select("features", F.lit(1).alias("label")))
    assert [r[0] for r in d.select(quality.score(model, F.col("features"))).collect()] == [1.0, 1.0]


def test_short_documents_stay_and_texts_of_no_language_go(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    judge = langid.Judge(langid.fit(docs))
    short = [(r["lang"], judge(r["text"])) for r in docs.where("length(text) < 60").collect()]
    assert len(short) >= 10 and not any(r[2] for _, r in short)
    assert np.mean([lang == r[0] for lang, r in short]) >= 0.9
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    noise = [" ".join("".join(rng.choice(letters, rng.integers(2, 10))) for _ in range(300)) for _ in range(50)]
    assert all(judge(t)[2] for t in noise)


def held_out_rates(spark, df, label):
    rows = df.join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").collect()
    hit = [r["predicted"] for r in rows if r[label] == 1]
    clear = [1 - r["predicted"] for r in rows if r[label] == 0]
    return np.mean(hit), np.mean(clear)


def test_quality_of_held_out_documents(spark):
    good, bad = held_out_rates(spark, queries.op6_quality(spark, "/root/testdata/sf0.01"), "quality")
    assert good >= 0.97 and bad >= 0.9


def test_toxicity_of_held_out_documents(spark):
    """The small table teaches the English words only, as its other languages have too few marked rows."""
    hit, clear = held_out_rates(spark, queries.op9_toxicity(spark, "/root/testdata/sf0.01"), "toxic")
    assert hit >= 0.55 and clear >= 0.97


def test_discriminant_is_the_gaussian_posterior(spark):
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = [rng.normal(0, 1, (60, d)), rng.normal(1, 2, (90, d))]
    rows = [(y, [float(v) for v in r]) for y in (0, 1) for r in x[y]] + [(None, [0.0] * d), (7, [0.0] * d), (1, None)]
    model = quality.fit(spark.createDataFrame(rows, "label int, features array<double>"), shrinkage=0.2, ridge=0.0)
    cov = [np.cov(v.T, bias=True) for v in x]
    target = np.diag(np.diag((60 * cov[0] + 90 * cov[1]) / 150))
    at, logs = np.concatenate(x), []
    for v, c, n in zip(x, cov, (60, 90)):
        s = 0.8 * c + 0.2 * target
        diff = at - v.mean(0)
        logs.append(np.log(n) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (diff @ np.linalg.inv(s) * diff).sum(1))
    assert np.allclose(model.score(at), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)


def test_quality_of_odd_rows(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 300000), (3, "a" * 300000)], "doc_id long, text string")
    f = d.select("doc_id", quality.features(d.text).alias("features"))
    model = quality.fit(f.select("features", F.lit(1).alias("label")).limit(0))
    assert {r[0] for r in f.select(quality.score(model, F.col("features"))).collect()} == {0.5}
    one = quality.fit(f.select("features", F.lit(1).alias("label")))
    assert {r[0] for r in f.select(quality.score(one, F.col("features"))).collect()} == {1.0}


def test_grammar_weighs_clauses_not_words():
    g = toxicity.Grammar({"blork": 0.8, "zot$": 0.5})
    t = g.total
    direct = t("you are an idiot")
    assert direct == t("you idiot") == t("He is such a total moron") == 1.25 and t("an idiot") == 0.25
    assert t("idiots like you") == pytest.approx(0.25 + 1.25) and t("people, this is so dumb") == 1.25
    assert t("you are not an idiot") == pytest.approx(1.25 * 0.3) and t("not an idiot") == pytest.approx(0.25 * 0.3)
    assert t("blorkian") == pytest.approx(0.8 * 0.25) and t("zot") == 0.125 and t("zotty") == 0 and t(None) == 0 and t("") == 0
    assert t("you blork") == 1.25 * 0.8 and t("blorks like them") == pytest.approx(0.8 * 1.5)
    assert [c for c, _ in g.clauses("fine day, you moron! bye")] == ["you moron"]
    assert [c for c, _ in g.clauses("you moron, they hurt him; fine")] == ["you moron", "they hurt him"]


def test_reported_speech_reaches_quotations():
    t = toxicity.Grammar({}).total
    direct = t("you are an idiot")
    for text in ("She said: you are an idiot", '"You idiot," he said', "he said that you are an idiot", "«You idiot», she wrote", "according to her, you are an idiot"):
        assert t(text) == pytest.approx(0.4 * direct), text
    assert t("I said you are an idiot") == direct and t("they said hello. you idiot") == direct
    assert t("you idiot said hello") == direct


def test_threats_over_several_words():
    t = toxicity.Grammar({}).total
    assert t("kill time") == 0.02 and t("I will kill time") == 0.8
    assert t("I will kill you") == t("going to hurt you") == pytest.approx(1.6) and t("hope you die") == t("they should be burn") == 0.8
    assert t("I will not kill you") == pytest.approx(0.3 * 1.6) and t("she said I will kill you") == pytest.approx(0.4 * 1.6)
    assert t("you, my dear friend of old, attack") == 0.4


def test_composition_is_the_chain_of_transducers():
    g = toxicity.Grammar({})
    rng = np.random.default_rng(3)
    for _ in range(400):
        words = list(rng.choice(["idiot", "kill", "you", "not", "said", "x", "will", "a", ",", "i"], 12))
        symbols = [g.symbol(w)[0] for w in words]
        for t, order in [(g.backward, -1), *((t, 1) for t in g.cascade)]:
            state, out = 0, []
            for s in symbols[::order]:
                state, x = t.step(state, s)
                out.append(x)
            symbols = out[::order]
        assert g.weights(words) == pytest.approx([toxicity.weight(s) for s in symbols])


def test_stems_against_plain_counts(spark):
    """All stems that pass the odds test are kept, the shortest of nested ones, whatever their number."""
    rng = np.random.default_rng(8)
    made = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(900)]
    rows = [(" ".join(rng.choice(made[:500] if y == 0 or k % 3 else made, 8)), y) for k in range(1200) for y in (int(k % 2),)] + [(None, 1), ("", 0), (None, None)]
    d = spark.createDataFrame(rows, "text string, label int").repartition(4)
    count = {}
    for text, y in rows:
        for s in toxicity._stems_of(text) if y is not None else ():
            count.setdefault(s, [0, 0])[y] += 1
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    good = {s for s, (neg, pos) in count.items() if pos >= 3 and ((pos + 0.5) / (n[1] + 1)) / ((neg + 0.5) / (n[0] + 1)) >= 4}
    want = {s: count[s][1] / sum(count[s]) for s in good if not any(s != o and s.startswith(o) for o in good)}
    got = toxicity.learn_stems(d, least_rows=3, least_odds=4.0)
    assert got == want and len(want) > 50


def test_labelled_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None), (8, 1)], "doc_id long, label int")
    got = toxicity.labelled_sample(labels, most=60).groupBy("label").count().collect()
    assert sorted(map(tuple, got)) == [(0, 60), (1, 60)]
    assert toxicity.labelled_sample(labels, most=1000).count() == 400 and toxicity.labelled_sample(labels.limit(0)).count() == 0


def test_stems_and_curve(spark):
    rows = [(f"fine words here {i} badblob{'abc'[i % 3]} x", 1) for i in range(30)] + [(f"fine words here {i} y", 0) for i in range(300)]
    d = spark.createDataFrame(rows + [(None, 1), ("z", None)], "text string, label int")
    stems = toxicity.learn_stems(d)
    assert set(stems) == {"badb"}
    assert toxicity.learn_stems(d.where("label = 0")) == {} and toxicity.learn_stems(d.limit(0)) == {}
    grammar = toxicity.Grammar(stems)
    rows = d.select("label", toxicity.totals(d.text, grammar).alias("total"))
    curve = toxicity.calibrate(rows)
    p = {r[0]: r[1] for r in rows.select("total", curve.probability(F.col("total"))).distinct().collect()}
    assert len(p) == 2 and p[0.0] < 0.3 < p[max(p)]
    flat = toxicity.calibrate(rows.limit(0))
    assert flat.offset < 0 < flat.slope


def test_folds_are_crc(spark):
    got = spark.range(50).select("id", crc_mod("id", 5).alias("m")).collect()
    assert all(r["m"] == crc_of(r["id"]) % 5 for r in got)
