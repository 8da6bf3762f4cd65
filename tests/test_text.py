"""Text functions, stop words, quotes, tolerant parsing."""

import pytest
from pyspark.sql import functions as F

from topicloom.functions import text as X
from topicloom.functions.stopwords import ENGLISH, stop_words
from topicloom.operators import guided


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([(1, "Der Größe_1, a b2 don't"), (2, None), (3, "x"), (4, "one two")], "id long, text string").select("id", X.tokens(F.col("text")).alias("t"))
    got = {r["id"]: (r["t"], r["g"]) for r in df.select("id", "t", X.ngrams(F.col("t"), 1, 3).alias("g")).collect()}
    assert got[1] == (["der", "größe_1", "b2", "don"], ["der", "größe_1", "b2", "don", "der größe_1", "größe_1 b2", "b2 don", "der größe_1 b2", "größe_1 b2 don"])
    assert got[2] == ([], []) and got[3] == ([], []) and got[4][1] == ["one", "two", "one two"]


def test_stop_words():
    assert len(ENGLISH) == 318 and stop_words("English") is ENGLISH and stop_words("multilingual") is None
    assert "der" in stop_words("GERMAN")
    with pytest.warns(UserWarning):
        assert stop_words("klingon") is None


def test_small_expressions(spark):
    row = spark.range(1).select(
        X.snippet(F.lit("abcdef"), 3).alias("a"), X.snippet(F.lit("abc"), 3).alias("b"), X.strip_marker(F.lit(" 3. item ")).alias("c"), X.explode_clean(F.lit("- a | |2) b|c")).alias("d"),
        X.first_sentence(F.lit("One. Two.")).alias("e"), X.simple_label(F.array(*map(F.lit, ["red car", "b", "c", "d"]))).alias("f"), X.label_key(F.lit("The  Big Red Car")).alias("g"),
        X.uniform_from_hash(F.sha2(F.lit("x"), 256)).alias("u"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"], row["f"], row["g"]) == ("abc...", "abc", "item", ["a", "b", "c"], "One.", "Red Car & B & C", "the big red")
    assert 0 <= row["u"] < 1


def test_answers(spark):
    raw = ['{"answers": ["B", "c", "Z"]}', 'ok {"answers": ["C"]} done', "B, then C", None, "garbage"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [r["a"] for r in df.select("i", X.answers(F.col("raw"), n=F.lit(3)).alias("a")).orderBy("i").collect()]
    assert got[0] == ["B", "C", None] and got[1] == ["C", None, None] and got[2] == ["B", "C", None] and got[3] == got[4] == [None] * 3
    assert [guided.parse_letters(r, 3) for r in raw] == got


def test_quotes(spark):
    src = ["The “quick”  brown fox didn't stop.", "Another text"]
    assert X.unverified('He wrote "quick\'s brown" and “brown FOX didn’t stop” at length in this narrative text.', src) == ["quick's brown"]
    assert X.quotes_of('"all of it is quoted here"') == [] and X.quotes_of(None) == []
    df = spark.createDataFrame([("x 'brown fox' and 'blue fox' in a long enough line", src)], "n string, s array<string>")
    assert df.select(X.unverified_quotes(F.col("n"), F.col("s")).alias("u")).first()["u"] == ["blue fox"]


class Fake:
    def __init__(self, *replies):
        self.replies, self.seen = list(replies), []

    def complete(self, prompt):
        self.seen.append(prompt)
        r = self.replies.pop(0) if self.replies else ""
        if isinstance(r, Exception):
            raise r
        return r


T = [{"topic_id": i, "keywords": [f"k{i}", f"m{i}"], "size": 10 * (i + 1), "examples": [f"text {i} says hello there"]} for i in range(3)]


def test_labels_and_merges():
    out = guided.label_topics(Fake('{"label": "Alpha Beta", "description": "d"}', RuntimeError("down"), '{"label": "Alpha Beta"}', '{"label": "Gamma"}'), T)
    assert [o["label"] for o in out] == ["Alpha Beta", "K1 & M1", "Gamma"] and out[1]["description"].startswith("Documents about")
    assert guided.merge_groups(Fake('x {"groups": [[0, 2, 99], [2, 1]]} y'), T) == [[0, 2], [1]]
    assert guided.merge_groups(Fake(ValueError()), T) == [[0], [1], [2]]
    assert guided.parse_groups("[0, 1] and [2]", [0, 1, 2]) == [[0, 1], [2]]
    client = guided.CachedClient(f := Fake(OSError(), "yes"))
    assert client.complete("p") == client.complete("p") == "yes" and len(f.seen) == 2


def test_alignment_and_themes():
    known = [{"global_id": 7, "keywords": ["k0"], "label": None}]
    assert guided.align(Fake('{"matches": [{"new": 0, "global": 7}, {"new": 1, "global": 8}, {"new": 9, "global": 7}]}'), T, known) == [7, None, None]
    assert guided.align(f := Fake(), T, []) == [None] * 3 and not f.seen
    th = guided.themes(Fake('{"themes": [{"title": "One", "topics": [0, 0, 5]}]}', 'It says "text 0 says hello" and "never said this" in the middle of a longer narrative.'), T)
    assert th[0]["topic_ids"] == [0, 1, 2] and th[0]["total_size"] == 60 and th[0]["unverified_quotes"] == ["never said this"]
    assert [t["topic_ids"] for t in guided.themes(Fake("nothing"), T, write=False)] == [[0], [1], [2]]


def test_judgments(spark, tmp_path):
    tr = [{"anchor": i, "positive": i + 1, "negative": i + 2, "anchor_text": f"a{i}", "positive_text": f"p{i}", "negative_text": f"n{i}"} for i in range(10)]
    cache = {}
    rows = guided.judge(Fake('{"answers": ' + str(["B"] * 8).replace("'", '"') + "}", "C"), tr, cache=cache)
    assert len(cache) == 10 and {r["split"] for r in rows} <= {"train", "holdout"}
    assert any(r["swapped"] for r in rows) and not all(r["swapped"] for r in rows)
    for r in rows[:8]:
        assert r["judged_positive"] == (r["negative"] if r["swapped"] else r["positive"])
    assert rows[9]["raw_answer"] is None
    again = guided.judge(f := Fake(), tr, cache=cache)
    assert not f.seen and [r["raw_answer"] for r in again] == [r["raw_answer"] for r in rows]
    guided.write_judgments(spark, rows, f"{tmp_path}/j")
    assert guided.read_judgments(spark, f"{tmp_path}/j") == cache
    assert guided.triplet_budget(100) == 24 and guided.triplet_budget(10**9) == 120


def test_choices_phrases_and_calibration():
    docs = [{"doc_id": 5, "text": "t", "options": [1, 2]}, {"doc_id": 6, "text": "u", "options": [2, 0]}]
    assert guided.reassign_low_confidence(Fake('{"choices": [2, 9]}'), docs, {i: t["keywords"] for i, t in enumerate(T)}) == [(5, 2), (6, 2)]
    assert guided.keyphrases(Fake('{"phrases": [["a", " b "], "x"]}'), docs, 2) == {5: ["a", "b"], 6: []}
    score = {0.5: 0.4, 1.0: 0.8, 2.0: 0.8, 4.0: 0.1}
    assert guided.calibrate(Fake(), lambda r, s: r, lambda p, s: [], lambda r, judged: score.get(r, 0.8 - abs(r - 1.2)), [0.5, 1.0, 2.0, 4.0]) in (1.0, 2.0)
