"""Report tables, stratified samples, triplets to ask about, hierarchy tables and delimited files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from topicloom.operators import guided, rollups
from topicloom.plans import model as M
from topicloom.sources import corpus

DAY = dt.datetime(2024, 1, 1)


def timed(spark, days, labels):
    rows = [(DAY + dt.timedelta(days=d), x) for d, x in zip(days, labels, strict=True)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, label string")


def test_time_buckets(spark):
    rows = timed(spark, [0, 0, 3, 31], ["a", "a", "b", None])
    assert rollups.time_unit(rows, "ts") == "day"
    got = {(r["start"], r["label"], r["n"]) for r in rollups.over_time(rows, "ts", "label", 1).collect()}
    assert got == {(DAY, "a", 2), (DAY + dt.timedelta(days=3), "Other", 1), (DAY + dt.timedelta(days=31), "Other", 1)}
    rows = timed(spark, [0, 6, 7, 40], "abab")
    assert rollups.time_unit(rows, "ts") == "week"
    # 2024-01-01 is a Monday: its week ends on Sunday the 7th
    assert {r["start"].day for r in rollups.over_time(rows, "ts", "label").where("n = 1").collect()} >= {7, 14}
    assert rollups.time_unit(timed(spark, [0, 400], "ab"), "ts") == "month"
    empty = rows.limit(0)
    assert rollups.time_unit(empty, "ts") == "day" and rollups.over_time(empty, "ts", "label").isEmpty()


def test_shares_and_leaders(spark):
    rows = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", "b.c"), ("y", "b.c"), ("y", None), (None, "a`")], "g string, l string")
    got = {r["group"]: r.asDict() for r in rollups.share_table(rows, "g", "l").collect()}
    assert got["x"] == {"group": "x", "total": 3, "n_a": 2, "n_b.c": 1, "n_a`": 0, "share_a": 2 / 3, "share_b.c": 1 / 3, "share_a`": 0.0}
    assert got["y"]["total"] == 2 and got["y"]["share_b.c"] == 0.5 and got[None]["n_a`"] == 1
    lead = {r["group"]: r["leaders"] for r in rollups.leading_in_group(rows, "g", "l", 1).collect()}
    assert lead == {"x": "a (2)", "y": "b.c (1)", None: "a` (1)"}
    assert rollups.share_table(rows.limit(0), "g", "l").isEmpty()


def test_stratified_sample(spark):
    assert rollups.quotas({"a": 50, "b": 30, "c": 20}, 11) == {"a": 6, "b": 3, "c": 2}
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 60, "a").when(F.col("id") < 90, "b").alias("by"))
    n = {r["by"]: r["count"] for r in rollups.stratified_sample(rows, "by", 10).groupBy("by").count().collect()}
    assert n == {"a": 6, "b": 3, None: 1}
    one, two = (sorted(r["doc_id"] for r in rollups.stratified_sample(x, "by", 10).collect()) for x in (rows, rows.repartition(5)))
    assert one == two and one != sorted(r["doc_id"] for r in rollups.stratified_sample(rows, "by", 10, seed=7).collect())
    assert rollups.stratified_sample(rows, "by", 500).count() == 100 and rollups.stratified_sample(rows.limit(0), "by", 5).isEmpty()


def test_triplets_to_ask_about(spark):
    labels = spark.range(30).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, -1).otherwise(F.col("id") % 2).cast("int").alias("topic_id"))
    pairs = spark.range(30).select(F.col("id").alias("src")).crossJoin(spark.range(30).select(F.col("id").alias("dst"))).where("src <> dst")
    near = pairs.withColumn("sim", 1 - F.abs(F.col("src") - F.col("dst")) / 100)
    all_of = guided.sample_triplets(near, labels, 100).collect()
    assert len(all_of) == 27 and not {r["anchor"] for r in all_of} & {0, 10, 20}
    assert guided.sample_triplets(near, labels, 5).count() == 5
    hard = guided.sample_triplets(near, labels, 5, "hard", oversample=10).collect()
    least = sorted(round(r["margin"], 9) for r in all_of)[:5]
    assert sorted(round(r["margin"], 9) for r in hard) == least
    probs = labels.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("topic_id"), (0.5 + F.col("doc_id") / 61).alias("prob")), F.struct(F.lit(1).alias("topic_id"), (0.5 - F.col("doc_id") / 61).alias("prob")))).alias("p")).select("doc_id", "p.*")
    unsure = {r["anchor"] for r in guided.sample_triplets(near, labels, 100, "entropy", probs).collect()}
    assert unsure == {d for d in range(1, 16) if d % 10}  # ceil(27 / 2) = 14 documents, ids 1 to 15 but for the outlier
    assert guided.sample_triplets(near, labels.limit(0), 5).isEmpty()
    with pytest.raises(ValueError):
        guided.sample_triplets(near, labels, 5, "other")


class Says:
    def __init__(self, reply):
        self.reply = reply

    def complete(self, prompt):
        return self.reply


def test_theme_written_anew():
    topics = [{"topic_id": i, "size": 10 + i, "keywords": [f"k{i}", "all"], "examples": [f"words of {i} in a row"]} for i in range(3)]
    first = guided.themes(Says(json.dumps({"themes": [{"title": "A", "topics": [0, 1]}, {"title": "B", "topics": [2]}]})), topics, write=False)
    assert [t["topic_ids"] for t in first] == [[0, 1], [2]] and first[0]["narrative"] == "" and first[0]["total_size"] == 21
    again = guided.regenerate_theme(Says('It says "words of 2 in a row" there.'), first, 1, topics, [2, 2, 99])
    assert again[1] == first[1] and again[0]["topic_ids"] == [2] and again[0]["total_size"] == 12 and again[0]["title"] == "A"
    assert again[0]["narrative"].startswith("It says") and again[0]["unverified_quotes"] == []
    with pytest.raises(KeyError):
        guided.regenerate_theme(Says(""), first, 9, topics)
    with pytest.raises(ValueError):
        guided.regenerate_theme(Says(""), first, 1, topics, [99])


def test_node_tables(spark):
    rows = [("L0_0", 0, None), ("L0_1", 0, None), ("L1_0", 1, "L0_0"), ("L1_1", 1, "L0_0"), ("L2_0", 2, "L1_1")]
    nodes = spark.createDataFrame(rows, "node_id string, level int, parent_id string")
    ids = lambda df: {r["node_id"] for r in df.collect()}
    assert ids(M.flatten(nodes, "L0_0")) == {"L0_0", "L1_0", "L1_1", "L2_0"} and ids(M.flatten(nodes)) == {r[0] for r in rows}
    assert ids(M.flatten(nodes, "L9_9")) == set() and M.get_node(nodes, "L2_0")["parent_id"] == "L1_1" and M.get_node(nodes, "no") is None


def test_delimited_files_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c\nd', ["x", "y"]), (2, None, None)], "doc_id long, text string, words array<string>")
    corpus.write_csv(rows, f"{tmp_path}/t")
    got = {r["doc_id"]: (r["text"], r["words"]) for r in corpus.union_csv(spark, [f"{tmp_path}/t"], ["doc_id"]).collect()}
    assert got == {"1": ('a "b", c\nd', "x|y"), "2": (None, None)}


def test_embedding_dim(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "doc_id long, v array<double>")
    assert corpus.embedding_dim(v) == 2 and corpus.embedding_dim(v.limit(0)) is None
    with pytest.raises(ValueError):
        corpus.embedding_dim(v.unionByName(spark.createDataFrame([(3, [1.0])], v.schema)))
