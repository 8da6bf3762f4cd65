"""The pipeline's stages on a small corpus, each against brute force over its own input."""

import random
from collections import Counter

import pytest

import corpus_pipeline as P
from topicloom.llm import bpe

from .test_operators import WORDS, brute_classes, brute_dedup, brute_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, out = random.Random(9), []
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(20, 90))) for _ in range(150)]
    texts += texts[:12] + [" ".join(w.upper() + "!!" for w in t.split()) for t in texts[20:60]] + [None, ""]
    texts += [t + " more" for t in texts[100:110]]
    out = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(out, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int("!!" not in (t or "")), 0) for i, t, *_ in out if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = docs.collect()
    after = [start]
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert [*docs.columns] == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
        docs = docs.cache()
        after.append(docs.collect())
    good, one, far, mixed = after[1:]
    assert all("!!" not in (r["text"] or "") for r in good) and len(good) >= 165
    keep = {i for i, k, *_ in brute_dedup([(r["doc_id"], r["text"]) for r in good]) if i == k}
    assert {r["doc_id"] for r in one} == keep
    classes = brute_classes([brute_fingerprint(r["text"]) for r in one])
    least = {}
    for r, c in zip(one, classes, strict=True):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert {r["doc_id"] for r in far} == set(least.values())
    n = Counter(r["doc_id"] for r in mixed)
    assert n and set(n.values()) <= {1, 2} and set(n) <= set(least.values())
    last = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    coder = bpe.load(bpe.default_vocabulary())
    text = {r["doc_id"]: r["text"] or "" for r in start}
    assert Counter((r["doc_id"], r["n_tokens"]) for r in last) == Counter((r["doc_id"], len(coder.encode(text[r["doc_id"]]))) for r in mixed)


def test_run_is_the_stages(spark, sf_dir):
    a, b = P.run(spark, sf_dir).collect(), P.run(spark, sf_dir).collect()
    assert a and Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_queries_are_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names) and 4 <= len(P.STAGES) <= 5


def test_stages_keep_clashing_columns_and_nulls(spark):
    rows = [(1, "a b c d e", None, None, None, 0.5, 7), (2, "a b c d e", "en", "s", 9, 0.5, 7), (None, "other words in here", "en", "s", 1, None, None), (None, None, None, None, None, None, None), (3, None, "en", "s", 0, 0.1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA + ", score double, size long")
    for stage in (P.distinct_texts, P.distinct_fingerprints, P.mixed):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() >= 1
    kept = {(r["doc_id"], r["text"]) for r in P.distinct_texts(spark, docs, "").collect()}
    assert (1, "a b c d e") in kept and (2, "a b c d e") not in kept and (None, "other words in here") in kept
