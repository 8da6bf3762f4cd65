"""Operators do the whole job where a bound used to cut it."""

import numpy as np
import pytest

from topicloom.operators import graph, knn, topics
from topicloom.plans import catalogue
from topicloom.plans import model as M
from topicloom.sources import corpus


class Seen(Exception):
    pass


def test_lexical_views_keep_ten_thousand_terms(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "a text", "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    def tfidf(*a, max_terms=10_000, **b):
        raise Seen(max_terms)

    monkeypatch.setattr(graph, "tfidf", tfidf)
    with pytest.raises(Seen, match="^10000$"):
        catalogue.QUERIES["multiview_fusion"](spark, str(tmp_path))
    assert M.Config().lexical_terms == 10_000


def test_exact_neighbours_stay_exact_beyond_the_switch(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(0).normal(size=(400, 8)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(knn, "EXACT_ROWS", 100)
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -np.inf)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[: catalogue.K]}
    for name in ("knn_exact", "knn_directed_edges"):
        assert {(r["src"], r["dst"]) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()} == want


def test_mmr_considers_every_member(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(2300, 4)) * 0.05 + [3, 1, 0, 0], rng.normal(size=(60, 4)) + [0, 4, 0, 2], rng.normal(size=(30, 4))])
    topic = [0] * 2360 + [-1] * 30
    got = topics.representatives_mmr(spark.createDataFrame([(i, v.tolist(), t) for i, (v, t) in enumerate(zip(x, topic, strict=True))], "doc_id long, v array<double>, topic_id int"), 4).collect()
    for t in (0, -1):
        ids = np.flatnonzero(np.array(topic) == t)
        m = x[ids]
        unit = m / np.linalg.norm(m, axis=1, keepdims=True)
        mean = m.mean(0)
        rel, high, want = unit @ (mean / np.linalg.norm(mean)), np.zeros(len(m)), []
        for _ in range(4):
            score = 0.7 * rel - 0.3 * high
            score[want] = -np.inf
            want.append(int(np.argmax(np.round(score, 9))))
            high = np.maximum(high, unit @ unit[want[-1]])
        assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["topic_id"] == t] == ids[want].tolist()


def test_replies_are_parsed_whole(spark, tmp_path):
    long = "word " * 400
    cases = {
        'Sure: {"answers": ["c", "B", "x"]} done': ["C", "B", None, None],
        long + '{"answers": ["B"]}': ["B", None, None, None],
        long + "so (C), then B.": ["C", "B", None, None],
        '{"other": 1} B': ["B", None, None, None],
        '{"answers": ["B", "C", "B", "C", "B"]}': ["B", "C", "B", "C"],
        '{"answers": [broken B': ["B", None, None, None],
        "": [None] * 4,
        None: [None] * 4,
    }
    rows = [(i, 0, "user", x) for i, x in enumerate([*cases, 'B "quoted" {brace} c'])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in catalogue.QUERIES["json_answers_parse"](spark, str(tmp_path)).collect()}
    assert [got[i]["answers"] for i in range(len(cases))] == list(cases.values())
    assert got[len(cases)]["built"] == ["B", "B", "C", None] and got[7]["built"] == ["B", None, None, None]


def test_quotes_are_checked_over_whole_items(spark, tmp_path, monkeypatch):
    texts = ["few", " ".join(f"word{i}" for i in range(300)), 'It\'s "said" here\nand “there” ' + "x" * 450 + " end", "Größe — " * 90]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalogue.QUERIES["quote_check"](spark, str(tmp_path)).collect()
    assert len(got) == len(texts) and all(r["unverified"] == ["words that nobody wrote"] for r in got)
    monkeypatch.setattr(catalogue.X, "unverified_quotes", lambda n, s: n)
    said = {r["item_id"]: r["unverified"] for r in catalogue.QUERIES["quote_check"](spark, str(tmp_path)).collect()}
    assert all(w in said[1].replace('"', " ").split() for w in texts[1].split()) and said[2].count("x") >= 450


def test_lsa_keeps_every_term(spark):
    common = [" ".join(f"a{j}" for j in range(i * 50, i * 50 + 100)) for i in range(81)]
    texts = [c for c in common for _ in range(3)] + ["zebra yak", "zebra yak wolf", "wolf zebra"]  # rarer than 4,000 others
    v = {r["doc_id"]: np.array(r["v"]) for r in corpus.lsa(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 84).collect()}
    terms = sorted({w for t in texts for w in t.split()})
    at, n = {w: i for i, w in enumerate(terms)}, len(texts)
    x = np.zeros((n, len(terms)))
    for i, t in enumerate(texts):
        for w in t.split():
            x[i, at[w]] = 1
    x *= np.log((1 + n) / (1 + x.sum(0))) + 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, _, comp = np.linalg.svd(x, full_matrices=False)
    want = x @ comp[:84].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = np.stack([v[i] for i in range(n)])
    assert len(terms) > 4000 and np.allclose(np.linalg.norm(got, axis=1), 1)
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-6)
