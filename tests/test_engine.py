"""Graphs, communities, topics, metrics, reduced sets, the model and the stream, on planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import community, coreset, graph, guided, keywords, knn, metrics, topics
from topicloom.operators.adapt import LinearAdapter, blend_phrases
from topicloom.plans import model as M
from topicloom.sources import corpus, synthetic
from topicloom.streaming import cumulative as C

BASE = M.Config(n_neighbors=10, n_runs=3, min_size=5)


@pytest.fixture(scope="module")
def blobs(spark):
    texts, x, truth = synthetic.blobs()
    df = corpus.from_lists(spark, texts, x).cache()
    true = spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)], "doc_id long, topic_id int").cache()
    return df, true, x, truth


@pytest.fixture(scope="module")
def fitted(blobs):
    return M.TopicModel(BASE).fit(blobs[0])


def score(a, b):
    return metrics.ari(metrics.contingency(a.select("doc_id", F.col("topic_id").alias("a")).join(b.select("doc_id", F.col("topic_id").alias("b")), "doc_id"))).first()["ari"]


def test_knn_against_brute_force(blobs):
    df, _, x, _ = blobs
    rows = df.select(F.col("doc_id").alias("id"), "v")
    s = np.round(x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)), 9)
    np.fill_diagonal(s, -np.inf)
    want = {(i, j) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:5]}
    assert {(r["src"], r["dst"]) for r in knn.self_knn(rows, 5).collect()} == want
    found = {(r["src"], r["dst"]) for r in knn.inverted(rows, rows, 5).collect()}
    assert len(found & want) >= 0.9 * len(want)


def test_knn_in_many_blocks(blobs, monkeypatch):
    rows = blobs[0].select(F.col("doc_id").alias("id"), "v")
    whole = {tuple(r) for r in knn.exact(rows, rows, 4).collect()}
    monkeypatch.setattr(knn, "BLOCK", 20)
    assert {tuple(r) for r in knn.exact(rows, rows, 4).collect()} == whole
    assert len({tuple(r)[:2] for r in knn.inverted(rows, rows, 4, probes=10**6).collect()} & {w[:2] for w in whole}) == len(whole)


def test_recall_of_the_index(spark):
    x = np.random.default_rng(0).normal(size=(1500, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    q = rows.where("id % 20 = 0")
    pairs = lambda df: {(r["src"], r["dst"]) for r in df.collect()}
    want = pairs(knn.exact(q, rows, 10))
    assert len(pairs(knn.inverted(q, rows, 10)) & want) >= 0.9 * len(want)


def test_numeric_ranges_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    meta = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.round(rng.exponential(size=300), 2))] + [(900, None)], "doc_id long, x double")
    get = lambda: {(r["src"], r["dst"]): round(r["weight"], 6) for r in graph.numeric_edges(meta, "x", 4).collect()}
    whole = get()
    monkeypatch.setattr(graph, "RANGE_ROWS", 60)
    assert get() == whole and whole
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "doc_id long, x double")
    assert graph.numeric_edges(same, "x").count() == 0


def test_fusion_weights(spark):
    e = lambda rows: spark.createDataFrame(rows, "src long, dst long, weight double")
    got = {(r["src"], r["dst"]): r["weight"] for r in graph.fuse(e([(0, 1, 2.0), (1, 2, 1.0)]), e([(0, 1, 1.0), (2, 3, 1.0)]), None, (0.5, 0.3, 0.2)).collect()}
    assert got[0, 1] == pytest.approx(1.1) and got[1, 2] == pytest.approx(0.5 / 0.8 * 0.5) and got[2, 3] == pytest.approx(0.3 / 0.8)
    m = spark.createDataFrame([(0, "a", "x"), (1, "a", "x"), (2, None, "x")], "doc_id long, p string, q string")
    assert {(r["src"], r["dst"]): r["weight"] for r in graph.metadata_edges(m).collect()} == {(0, 1): 2.0, (0, 2): 1.0, (1, 2): 1.0}


CLIQUES = [(a, b, 1.0) for k in (0, 4) for a in range(k, k + 4) for b in range(a + 1, k + 4)]


def test_leiden_null_models():
    s, d, w = (np.array(c) for c in zip(*[*CLIQUES, (3, 4, 3.2)], strict=True))
    assert len(set(community.leiden(8, s, d, w, 0.4))) == 1
    assert (lambda c: c[0] != c[7])(community.leiden(8, s, d, w, 1.0))  # the heavy bridge may stay a part of its own
    assert len(set(community.leiden(8, s, d, np.where(w > 1, 0.5, w), 1.0))) == 2
    split = community.leiden(8, s, d, w, 0.4, node_weight=np.array([1, 1, 1, 5, 3, 3, 3, 1.0]))
    assert len(set(split)) >= 2
    assert community.leiden(3, np.array([], int), np.array([], int), np.array([])).tolist() == [0, 1, 2]


def test_leiden_recovers_planted_parts():
    rng = np.random.default_rng(2)
    truth = np.repeat(np.arange(6), 30)
    pairs = [(i, j) for i in range(180) for j in range(i + 1, 180) if rng.random() < (0.3 if truth[i] == truth[j] else 0.01)]
    s, d = map(np.array, zip(*pairs, strict=True))
    got = community.leiden(180, s, d, np.ones(len(s)), 1.0, 7)
    assert len({*zip(got, truth, strict=True)}) <= 8 and (got == community.leiden(180, s, d, np.ones(len(s)), 1.0, 7)).all()
    assert community.modularity(180, s, d, np.ones(len(s)), got) > 0.6


def test_consensus_and_prune(spark):
    runs = spark.createDataFrame([(r, i, (i // 5 if r or i != 4 else 1)) for r in range(4) for i in range(15)], "run int, doc_id long, community int")
    got = {r["doc_id"]: r["community"] for r in community.consensus(runs).collect()}
    assert len(set(got.values())) == 3 and got[4] == got[0] != got[5]
    lone = spark.createDataFrame([(r, i, i) for r in range(2) for i in range(4)], "run int, doc_id long, community int")
    assert len({r["community"] for r in community.consensus(lone).collect()}) == 4
    labels = spark.createDataFrame([(i, [5, 5, 5, 9, 9, 9, 2, -1][i], 10.0 if i == 6 else 1.0) for i in range(8)], "doc_id long, topic_id int, w double")
    assert {r["doc_id"]: r["topic_id"] for r in community.prune(labels, 3).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: -1, 7: -1}
    assert {r["doc_id"]: r["topic_id"] for r in community.prune(labels, 5, "w").collect()}[6] == 0
    assert community.average_linkage(np.abs(np.subtract.outer([0, 1, 10, 11], [0, 1, 10, 11.0])), 2).tolist() == [0, 0, 1, 1]


def test_resolution_search(spark):
    e = spark.createDataFrame([*CLIQUES, (3, 4, 0.1)], "src long, dst long, weight double")
    nodes = spark.range(8).withColumnRenamed("id", "doc_id")
    r = community.find_resolution(e, nodes, 2, 0.01, 2.0)
    assert community.runs(e, nodes, [42], r).select("community").distinct().count() == 2
    assert 0.1 <= community.find_resolution(e, nodes, None, steps=4) <= 2.0


def test_assignment_metrics(spark):
    rng = np.random.default_rng(0)
    from itertools import permutations

    for n, m in ((3, 3), (2, 4), (4, 2), (1, 1)):
        s = rng.normal(size=(n, m))
        best = max(sum(s[i, j] for i, j in zip(range(n), p, strict=False)) for p in permutations(range(m), n)) if n <= m else max(sum(s[i, j] for j, i in enumerate(p)) for p in permutations(range(n), m))
        assert sum(s[i, j] for i, j in metrics.assignment(s)) == pytest.approx(best)
    rows = spark.createDataFrame([(i, [5, 5, 9, 9, 1, 1, -1][i], [0, 0, 1, 1, 2, 2, 0][i]) for i in range(7)], "doc_id long, a int, b int")
    t = metrics.contingency(rows)
    assert metrics.hungarian_accuracy(t) == 1.0
    same = metrics.contingency(rows.where("a <> -1"))
    assert metrics.ari(same).first()[0] == 1.0 and metrics.nmi(same).first()[0] == pytest.approx(1.0)
    one = metrics.contingency(rows.select("doc_id", F.lit(1).alias("a"), F.lit(1).alias("b")))
    assert metrics.ari(one).first()[0] == 1.0 and metrics.nmi(one).first()[0] == 1.0


def brute_coherence(docs, a, b, w=10):
    wins = []
    for t in docs:
        ts = t.split()
        wins += [set(ts)] if len(ts) <= w else [set(ts[i : i + w]) for i in range(len(ts) - w + 1)]
    n = len(wins)
    fa, fb, fab = (sum(cond(x) for x in wins) for cond in (lambda x: a in x, lambda x: b in x, lambda x: a in x and b in x))
    pa, pb, pab = ((f + 1) / (n + 1) for f in (fa, fb, fab))
    return np.log(pab / (pa * pb)) / (-np.log(pab) + 1e-12), np.log(pab / (pa * pb + 1e-12)), np.log((fab + 1) / fb)


def test_coherence(spark):
    docs = ["aa bb cc", "aa xx " * 8, "bb cc dd ee ff gg hh ii jj kk ll aa bb", "bb"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    kw = spark.createDataFrame([(0, "aa", 1), (0, "bb", 2), (0, "zz", 3), (1, "qq", 1)], "topic_id int, term string, rank int")
    got = {r["topic_id"]: (r["npmi"], r["uci"], r["umass"]) for r in metrics.coherence(df, kw).collect()}
    assert got[0] == pytest.approx(brute_coherence(docs, "aa", "bb")) and got[1] == (0.0, 0.0, 0.0)


def test_cluster_metrics(blobs, spark):
    df, true, x, truth = blobs
    rows = df.select("doc_id", "v").join(true, "doc_id")
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    s = []
    for i, t in enumerate(truth):
        a = d[i][truth == t].sum() / ((truth == t).sum() - 1)
        b = min(d[i][truth == u].mean() for u in set(truth) - {t})
        s.append((b - a) / max(a, b))
    assert metrics.silhouette(rows).first()[0] == pytest.approx(np.mean(s), abs=1e-6)
    assert metrics.silhouette(rows.where("topic_id = 0")).first()[0] == 0.0 and metrics.davies_bouldin(rows.where("topic_id = 0")).first()[0] is None
    assert metrics.davies_bouldin(rows).first()[0] < 1 and metrics.calinski_harabasz(rows).first()[0] > 50


def test_coresets(spark):
    assert coreset.allocate({0: 1000, 1: 1000, 2: 10}, 100) and sum(coreset.allocate({0: 1000, 1: 1000, 2: 10}, 100).values()) <= 100
    assert coreset.allocate({0: 3, 1: 2}, 10) == {0: 3, 1: 2} and coreset.allocate({0: 1000, 1: 10}, 50)[1] >= 5
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, (rng.normal(size=4) + 5 * (i % 3)).tolist(), i % 3 if i % 50 else -1) for i in range(600)], "doc_id long, v array<double>, topic_id int").cache()
    s = coreset.stratified(rows, 60)
    got = s.collect()
    assert len(got) == sum(coreset.allocate({-1: 12, 0: 196, 1: 196, 2: 196}, 60).values()) in (58, 59, 60) and sum(r["weight"] for r in got) == pytest.approx(600) and {tuple(r) for r in coreset.stratified(rows.repartition(7), 60).collect()} == {tuple(r) for r in got}
    for how in ("stratified", "microcluster", "recency"):
        w = coreset.select(rows, 80, how, reserve=5, new_count=20)
        assert w.count() <= 80 and w.select("doc_id").distinct().count() == w.count()
    assert coreset.select(rows, 600).count() == 600
    w = [r["weight"] for r in coreset.sensitivity_weights(rows).collect()]
    assert sum(w) == pytest.approx(1.0)
    flat = coreset.sensitivity_weights(rows.withColumn("v", F.array(F.lit(1.0)))).select("weight").distinct().collect()
    assert [r[0] for r in flat] == [pytest.approx(1 / 600)]


def test_fit_finds_planted_topics(fitted, blobs):
    assert score(blobs[1], fitted.state) >= 0.95
    info = fitted.topic_info().collect()
    assert sum(r["size"] for r in info) == 105 and all(len(r["keywords"]) for r in info if r["topic_id"] != -1)
    assert {w[4] for r in info[:1] for w in r["keywords"] if " " not in w} and info[0]["label"] == f"Topic {info[0]['topic_id']}"
    p = fitted.probabilities().groupBy("doc_id").agg(F.sum("prob").alias("s"))
    assert p.count() == 105 and p.where("abs(s - 1) > 1e-9").isEmpty()
    o = {(r["topic_a"], r["topic_b"]): r["n"] for r in fitted.overlap().collect()}
    assert all(o[a, b] == o[b, a] for a, b in o)
    e = fitted.evaluate().first()
    assert e["n_topics"] == 3 and 0 < e["diversity"] <= 1 and e["stability"] > 0.9


def test_transform_and_changes(fitted, blobs, spark, tmp_path):
    df, true, _, _ = blobs
    t = fitted.transform(df)
    assert score(true, t) >= 0.95 and fitted.transform(df, 2.0).where("topic_id <> -1").isEmpty()
    fitted.save(f"{tmp_path}/m")
    m = M.TopicModel.load(spark, f"{tmp_path}/m")
    assert {tuple(r) for r in m.transform(df).collect()} == {tuple(r) for r in t.collect()} and m.config == fitted.config
    assert m.reduce_topics(2).topic_count() == 2
    m = M.TopicModel.load(spark, f"{tmp_path}/m")
    assert m.merge_topics([[0, 1, 77]]).topic_count() == 2
    nodes, member = m.hierarchy(2)
    assert nodes.where("level = 1 and parent_id is not null").count() >= 1 and member.select("level").distinct().count() == 2
    top = nodes.where("level = 0").first()["node_id"]
    assert M.subtopics(nodes, top, 2).count() <= nodes.count() and M.leaves(nodes).count() >= 1 and M.cut_at(nodes, 0).count() >= 1
    with pytest.raises(IndexError):
        M.cut_at(nodes, 9)
    m.set_labels({0: ("Name", "About")})
    assert "Name" in {r["label"] for r in m.topic_info().collect()}
    with pytest.raises(RuntimeError):
        M.TopicModel().topic_info()


def test_other_ways_to_fit(blobs, spark):
    df, true, _, _ = blobs
    x = df.withColumn("kind", (F.col("doc_id") % 40).cast("string")).withColumn("w", F.lit(2.0))
    m = M.TopicModel(M.Config(n_neighbors=10, n_runs=2, iterations=2, use_lexical=True, reduce_dims=8, graph_type="mutual", representative_method="mmr", soft_method="graph", language="multilingual")).fit(x, ["kind"], "w")
    assert score(true, m.state) > 0.9 and m.representatives().count() >= 3
    assert m.probabilities().groupBy("doc_id").agg(F.sum("prob").alias("s")).where("abs(s - 1) > 1e-9").isEmpty()
    none = M.TopicModel(M.Config(n_neighbors=10, n_runs=2, min_size=1000)).fit(df)
    assert none.topic_count() == 0 and none.transform(df).where("topic_id <> -1").isEmpty()
    with pytest.raises(ValueError):
        M.Config(graph_type="x")
    with pytest.raises(ValueError):
        M.TopicModel().fit(df.limit(0))


def test_outliers_and_divide(fitted, blobs, spark):
    m = M.TopicModel(fitted.config, fitted.state.withColumn("topic_id", F.when(F.col("doc_id") % 10 == 0, -1).otherwise(F.col("topic_id"))), fitted.edges, fitted.partitions)
    keep = m.state
    assert m.reduce_outliers().state.where("topic_id = -1").isEmpty() and score(blobs[1], m.state) > 0.95
    m.state = keep
    assert m.reduce_outliers("neighbors").state.where("topic_id = -1").isEmpty() and score(blobs[1], m.state) > 0.95
    before = m.topic_count()
    assert m.divide_topic(0, 2).topic_count() >= before
    with pytest.raises(KeyError):
        m.divide_topic(99)


def test_stream_keeps_identities(spark, tmp_path):
    data, n = synthetic.stream(4, 3, 90, emerging=3, enters=2, noise_docs=0.0, seed=3), 0
    m = C.CumulativeModel(spark, str(tmp_path), M.Config(n_neighbors=8, n_runs=2, min_size=4), C.StreamConfig(drift=0.2))
    out, ids = [], []
    for texts, x, _ in data:
        df = corpus.from_lists(spark, texts, x).withColumn("doc_id", F.col("doc_id") + n)
        n += len(texts)
        out.append(m.add_batch(df))
        assert m.labels().count() == n and m.labels().select("doc_id").distinct().count() == n  # after every batch
        ids.append({r["global_id"] for r in m.registry().collect()})
    assert out[0].reclustered and out[0].novelty is None and not out[1].reclustered and out[1].novelty < 0.2
    assert out[2].reclustered and out[2].novelty > 0.2 and ids[0] <= ids[2] and len(ids[2]) > len(ids[0])
    truth = spark.createDataFrame([(i, int(t)) for i, t in enumerate(np.concatenate([d[2] for d in data]))], "doc_id long, topic_id int")
    assert m.labels().count() == 270 and score(truth, m.labels()) > 0.8
    assert m.topic_info().agg(F.sum("size")).first()[0] <= 270 and m.representatives(2).count() >= 4
    m.reduce_topics(2)
    assert m.registry().count() == 2 and {r["topic_id"] for r in m.labels().select("topic_id").distinct().collect()} <= {-1, *(r["global_id"] for r in m.registry().collect())}


class Replies:
    def complete(self, prompt):
        return '{"label": "A name", "description": "of it"}' if "name of" in prompt else "{}"


def test_stream_survives_replay_restart_and_failure(spark, tmp_path, monkeypatch):
    data, n, frames = synthetic.stream(4, 4, 60, emerging=0, noise_docs=0.0, seed=5), 0, []
    for texts, x, _ in data:
        frames.append(corpus.from_lists(spark, texts, x).withColumn("doc_id", F.col("doc_id") + n))
        n += len(texts)
    how = (M.Config(n_neighbors=8, n_runs=2, min_size=4), C.StreamConfig(trigger="schedule", every=110))
    m = C.CumulativeModel(spark, str(tmp_path), *how)
    first = m.add_batch(frames[0], 0)
    again = m.add_batch(frames[0], 0)  # a replayed micro-batch
    assert again == first and m.since == 0 and m.accumulator().count() == 60
    with monkeypatch.context() as k:  # a step that fails before its commit
        k.setattr(C.CumulativeModel, "_commit", lambda *a, **b: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            m.add_batch(frames[1], 1)
    m = C.CumulativeModel(spark, str(tmp_path), *how)  # another process
    assert m.epoch == 1 and m.since == 0 and m.model.topic_count() == first.n_topics and m.labels().where("doc_id < 60").count() == 60
    assert not m.add_batch(frames[1], 1).reclustered and m.since == 60 and m.labels().count() == 120
    assert m.add_batch(frames[2], 2).reclustered and m.epoch == 2 and m.labels().count() == 180
    assert m.add_batch(frames[3], 3).n_docs == 60 and m.add_batch(frames[3].limit(0), 4).n_docs == 0
    m = C.CumulativeModel(spark, str(tmp_path), *how)
    assert [r.batch_id for r in m.results] == [0, 1, 2, 3, 4] and len(m.history) == 2 and m.labels().count() == 240 == m.topic_info().agg(F.sum("size")).first()[0] + m.labels().where("topic_id = -1").count()
    e = m.evaluate().first()
    assert e["n_total_docs"] == 240 and e["n_epochs"] == 2 and e["n_global_topics"] == m.registry().count()
    ids = sorted(r["global_id"] for r in m.registry().collect())
    assert m.topic(ids[0])["size"] > 0 and m.topic(10**6) is None and m.document_topics(5, 2).count() == 2 and m.overlap().count() >= len(ids)
    assert m.label(Replies())[0]["label"] == "A name" and m.topic(ids[0])["label"] == "A name" and m.themes(Replies())
    assert m.bigger_picture(2)["nodes"].count() >= 2
    m.merge_topics([ids[:2]])
    m.reduce_outliers(-1.0)
    assert m.registry().count() == len(ids) - 1 and m.labels().count() == 240 and m.labels().where("topic_id = -1").count() == 0


def test_triggers_and_matching():
    c = C.StreamConfig
    assert C.due(c(), False, None, 0) and C.due(c(trigger="manual"), True, 0.9, 999, force=True) and not C.due(c(trigger="manual"), True, 0.9, 999)
    assert C.due(c(), True, 0.3, 10) and not C.due(c(debounce=50), True, 0.3, 10) and C.due(c(trigger="schedule", every=10), True, 0.0, 10)
    assert C.match(np.eye(3), np.eye(3)[[2, 0]], 0.5) == [1, None, 0] and C.match(np.eye(2), np.zeros((0, 2)), 0.5) == [None, None]
    with pytest.raises(ValueError):
        c(strategy="x")


def test_structured_streams(spark, tmp_path):
    ev = spark.createDataFrame([(i, f"2024-01-0{1 + i // 4} 0{i % 4}:00:00", i % 2, "ab"[i % 2], 1.0) for i in range(8)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.unionAll(ev.limit(3)).write.parquet(f"{tmp_path}/ev")
    src = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/ev")
    q = C.windowed(C.deduplicated(src)).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert all(r["n"] == 2 for r in spark.table("w").collect())
    q = C.running_mass(src.select(F.col("user_id").cast("int").alias("topic_id"), F.col("value").alias("weight"))).writeStream.format("memory").queryName("r").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sum(r["n"] for r in spark.table("r").collect()) == 11
    assert C.sessions(ev, "90 minutes").count() > 0


def test_adapter(blobs, spark, tmp_path):
    _, _, x, truth = blobs
    rng = np.random.default_rng(1)
    noisy = x + 0.4 * rng.normal(size=x.shape)
    a = rng.integers(0, len(x), 300)
    p = np.array([rng.choice(np.flatnonzero(truth == truth[i])) for i in a])
    n = np.array([rng.choice(np.flatnonzero(truth != truth[i])) for i in a])
    m = LinearAdapter.fit(noisy[a], noisy[p], noisy[n])
    acc = lambda w: np.mean([(y := noisy @ w) is not None and (c := lambda i, j: y[i] @ y[j] / np.linalg.norm(y[i]) / np.linalg.norm(y[j]))(i, j) > c(i, k) for i, j, k in zip(a, p, n, strict=True)])
    assert acc(m.matrix) > acc(np.eye(32)) and (LinearAdapter.fit(noisy[a], noisy[p], noisy[n], epochs=0).matrix == np.eye(32)).all()
    strong = LinearAdapter.fit(noisy[a], noisy[p], noisy[n], decay=1.0)
    assert np.linalg.norm(strong.matrix - np.eye(32)) < np.linalg.norm(m.matrix - np.eye(32))
    m.save(spark, f"{tmp_path}/a")
    assert np.allclose(LinearAdapter.load(spark, f"{tmp_path}/a").matrix, m.matrix)
    r = m.transform(blobs[0]).first()["v"]
    assert np.linalg.norm(r) == pytest.approx(1.0)
    row = spark.range(1).select(blend_phrases(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("v"), blend_phrases(F.array(F.lit(3.0)), F.lit(None).cast("array<double>")).alias("u")).first()
    assert row["v"] == pytest.approx([0.5**0.5] * 2) and row["u"] == [3.0]


def test_sources_and_sinks(spark, tmp_path, blobs, fitted):
    df, true, _, _ = blobs
    v = corpus.lsa(df, 8)
    rows = v.join(true, "doc_id")
    assert v.count() == 105 and metrics.silhouette(rows).first()[0] > 0.3
    (tmp_path / "a.csv").write_text('id,text,extra\n1,"x | - y",q\n')
    (tmp_path / "b.csv").write_text("id,text\n2,z\n")
    (tmp_path / "c.csv").write_text("other\n3\n")
    u = corpus.union_csv(spark, [str(tmp_path / f) for f in ("a.csv", "b.csv", "c.csv")], ["id", "text"])
    assert u.count() == 2 and {r["source_file"] for r in u.collect()} == {"a.csv", "b.csv"}
    assert {r["text"] for r in corpus.explode_delimited(u, "text").collect()} == {"x", "y", "z"}
    with pytest.raises(ValueError):
        corpus.union_csv(spark, [str(tmp_path / "c.csv")], ["id"])
    info = fitted.topic_info().select("topic_id", "label", "keywords")
    corpus.write_projector(fitted.state.join(info, "topic_id", "left"), f"{tmp_path}/p")
    meta = [r[0].split("\t") for r in spark.read.text(f"{tmp_path}/p/metadata.tsv").collect()]
    assert len(meta) == 105 and all(len(m) == 5 for m in meta) and spark.read.text(f"{tmp_path}/p/vectors.tsv").count() == 105

    class Length:
        def encode(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

    e = corpus.encode(df, Length)
    assert np.linalg.norm(e.first()["v"]) == pytest.approx(1.0)
    assert len(corpus.weighted_stack([(e, 1.0), (e, 0.5)]).first()["v"]) == 4
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError
        return np.ones((len(texts), 2))

    assert corpus.retrying(flaky, sleep=lambda s: None).encode(["a"] * 150).shape == (150, 2) and calls == [100, 100, 50]
    text = corpus.markdown_report("R", [{"theme_id": 1, "title": "T", "total_size": 2, "keywords": ["k"], "narrative": "n", "unverified_quotes": ["q"]}], [{"topic_id": 0, "size": 2, "keywords": ["k"]}])
    corpus.write_text(spark, text, f"{tmp_path}/r")
    assert "“q”" in text and spark.read.text(f"{tmp_path}/r", wholetext=True).first()[0] == text
    with pytest.raises(ValueError):
        corpus.corpus(spark.createDataFrame([], "doc_id long, text string"))


def test_triplets(blobs):
    df, true, _, _ = blobs
    rows = df.select("doc_id", "v")
    near = knn.self_knn(rows.select(F.col("doc_id").alias("id"), "v"), 60)
    lab = true.withColumn("topic_id", F.when(F.col("doc_id") == 3, -1).otherwise(F.col("topic_id")))
    t = guided.nearest_same_different(near, lab)
    got = {r["doc_id"]: r["topic_id"] for r in lab.collect()}
    assert all(got[r["anchor"]] == got[r["positive"]] != got[r["negative"]] and -1 not in (got[r["anchor"]], got[r["negative"]]) for r in t.collect())
    assert metrics.triplet_accuracy(t, rows).first()[0] == 1.0 and metrics.triplet_accuracy(t.limit(0), rows).first()[0] is None
    assert guided.hard_margin(t, 5).count() == 5


def test_calibration_asks_the_client():
    asked = []

    class Judge:
        def complete(self, prompt):
            asked.append(prompt)
            return '{"answers": ["B"]}'

    triplet = lambda p, s: [{"anchor": 1, "positive": 2, "negative": 3, "anchor_text": f"a{s}", "positive_text": "b", "negative_text": "c"}]
    scores = {0.5: 0.2, 1.0: 0.6, 2.0: 0.4}
    seen = []

    def agreement(p, judged):
        seen.append(judged[0]["raw_answer"])
        return scores.get(p[0], 0.5 if p[0] < 1 else 0.9 if abs(p[0] - np.geomspace(0.5, 2, 5)[3]) < 1e-9 else 0.1)

    got = guided.calibrate(Judge(), lambda r, s: (r, s), triplet, agreement, [0.5, 1.0, 2.0])
    assert got == pytest.approx(np.geomspace(0.5, 2, 5)[3]) and len(asked) == 3 and set(seen) == {"B"}


def test_diverse_keywords_and_matches(spark):
    v = {"a": [1.0, 0.0], "b": [0.99, 0.05], "c": [0.6, 0.6], "d": [0.0, 1.0]}
    words = spark.createDataFrame([(0, t, x) for t, x in v.items()], "topic_id int, term string, v array<double>")
    centre = spark.createDataFrame([(0, [1.0, 0.1])], "topic_id int, centroid array<double>")
    got = [r["term"] for r in sorted(keywords.diverse(words, centre, 2).collect(), key=lambda r: r["rank"])]
    unit = {t: np.array(x) / np.linalg.norm(x) for t, x in v.items()}
    c = np.array([1, 0.1]) / np.linalg.norm([1, 0.1])
    first = max(v, key=lambda t: unit[t] @ c)
    assert got == [first, max((t for t in v if t != first), key=lambda t: 0.5 * unit[t] @ c - 0.5 * unit[t] @ unit[first])]
    a = spark.createDataFrame([(0, [1.0, 0.0], ["x", "y"]), (1, [0.0, 1.0], ["z"])], "topic_id int, centroid array<double>, keywords array<string>")
    b = spark.createDataFrame([(7, [0.1, 1.0], ["Z"]), (8, [1.0, 0.1], ["y", "q"])], a.schema)
    assert {(r["topic_a"], r["topic_b"], round(r["jaccard"], 6)) for r in metrics.matched_overlap(a, b).collect()} == {(0, 8, 0.333333), (1, 7, 1.0)}
    assert metrics.matched_overlap(a, b.limit(0)).count() == 0


def test_scores_of_a_good_and_a_blind_representation(blobs, spark):
    df, true, x, truth = blobs
    rows = df.select("doc_id", "v").join(true.withColumnRenamed("topic_id", "truth"), "doc_id")
    assert metrics.downstream_score(rows.withColumn("topic_id", F.col("truth"))) > 0.95
    blind = rows.select("doc_id", F.array(F.lit(0.0)).alias("v"), "truth", F.lit(0).alias("topic_id"))
    assert metrics.downstream_score(blind) < 0.4 and metrics.downstream_score(rows.withColumn("topic_id", F.lit(0)).where("truth = 0")) == 0.0
    whole = df.select("doc_id", "v", F.lit(1.0).alias("weight"))
    assert coreset.cost_ratio(df, whole, 3) == pytest.approx(1.0) and 0.3 < coreset.cost_ratio(df, whole.where("doc_id % 2 = 0"), 3) < 1.5


def test_maps_for_plots(fitted):
    at = fitted.projection(2).collect()
    assert len(at) == 105 and all(len(r["v"]) == 2 for r in at)
    t = fitted.topic_map().collect()
    c = {r["topic_id"]: np.array(r["centroid"]) / np.linalg.norm(r["centroid"]) for r in fitted.centroids().collect()}
    p = {r["topic_id"]: np.array(r["at"]) for r in t}
    for i in c:
        for j in c:  # three topics fit a plane
            assert np.linalg.norm(p[i] - p[j]) == pytest.approx(abs(1 - c[i] @ c[j]), abs=1e-6)


def test_entropy_anchors_are_those_of_a_sort(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.dirichlet(np.ones(3), 400), 2)
    p[100:200] = p[100]  # many ties
    probs = spark.createDataFrame([(i, t, float(x)) for i, row in enumerate(p) for t, x in enumerate(row)], "doc_id long, topic_id int, prob double")
    h = {i: round(float(-sum(np.clip(x, 1e-12, 1) * np.log(np.clip(x, 1e-12, 1)) for x in sorted(row))), 6) for i, row in enumerate(p)}
    for share in (0.5, 0.31, 1.0, 0.0):
        got = {r["doc_id"] for r in topics.entropy_anchors(probs, share).collect()}
        assert got == set(sorted(h, key=lambda i: (-h[i], i))[: int(np.ceil(share * 400))])
