"""Topic keywords: class-based TF-IDF, BM25 specificity, n-gram keyphrases, labels and their collisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.text import label_key, ngrams, simple_description, simple_label, tokens
from topicloom.operators import terms
from topicloom.operators.topics import few
from topicloom.session import cut


def term_counts(docs: DataFrame, stop: frozenset[str] | None = None, most: int = 2, weight: str | None = None) -> DataFrame:
    """doc_id, topic_id, term, tf (times the document's weight).

    Counted row by row; only rows that share their doc_id and topic_id are shuffled and added up.
    """
    extra = [F.col(weight).cast("double").alias("w")] if weight else []
    x = docs.select("doc_id", "topic_id", *extra, tokens(F.col("text"), 2, stop).alias("ts"))
    once, more = terms.split_repeats(x, ["doc_id", "topic_id"])
    out = terms.row_counts(once, most)
    return out if more is None else out.unionAll(terms.row_counts(more, most).groupBy("doc_id", "topic_id", "term").agg(F.sum("tf").alias("tf")))


def document_frequency(docs: DataFrame, stop: frozenset[str] | None = None, most: int = 2) -> DataFrame:
    t = docs.select("doc_id", tokens(F.col("text"), 2, stop).alias("ts")).select("doc_id", F.explode(F.array_distinct(ngrams(F.col("ts"), 1, most))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def top_terms(scored: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("topic_id").orderBy(F.desc(F.round("score", 9)), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def ctfidf(docs: DataFrame, stop: frozenset[str] | None = None, min_df: int = 2, max_df: float = 0.95, most: int = 2, weight: str | None = None) -> DataFrame:
    """topic_id, term, score: topic counts over their sum, times ln(n / (1 + df)); n-grams within documents.

    Each row is a document. Counts by topic and term are partial sums of one pass over the texts; the terms that stay
    are written once, and no task holds a topic.
    """
    extra = [F.col(weight).cast("double").alias("w")] if weight else []
    n = F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))
    per = terms.sums(docs.select("topic_id", *extra, tokens(F.col("text"), 2, stop).alias("ts")), most)
    per = per.groupBy("term", "topic_id").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).withColumn("df", F.sum("df").over(Window.partitionBy("term")))
    per = cut(per.crossJoin(n).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n"))))
    total = per.groupBy(F.col("topic_id").alias("t")).agg(F.sum("tf").alias("total"))
    per = per.join(few(total), F.col("topic_id").eqNullSafe(F.col("t")))
    return per.select("topic_id", "term", (F.col("tf") / (F.col("total") + 1e-10) * F.log(F.col("n") / (1 + F.col("df")))).alias("score"))


def bm25(docs: DataFrame, candidates: DataFrame | None = None, stop: frozenset[str] | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """topic_id, term, score: mean BM25 over the topic's documents against the mean over all, times
    ln(1 + tf in the topic), divided by the topic's best. Words of three characters or more.

    candidates: topic_id, term to score (default: all words of the topic). Documents without the word count
    with score 0 in the means. Negative idf become a quarter of the mean idf.
    """
    t = cut(docs.select("doc_id", "topic_id", tokens(F.col("text"), 3, stop).alias("ts")).withColumn("len", F.size("ts").cast("double")))
    n, mean = t.agg(F.count(F.lit(1)), F.avg("len")).first()
    once, more = terms.split_repeats(t, ["doc_id", "topic_id", "len"])
    per = terms.sums(once, 1, (k1, b, mean or 1.0))
    if more is not None:  # rows that share doc_id, topic and length are one document
        tf = more.select("doc_id", "topic_id", "len", F.explode("ts").alias("term")).groupBy("doc_id", "topic_id", "len", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
        g = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(mean)))
        per = per.unionAll(tf.groupBy("topic_id", "term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).cast("double").alias("df"), F.sum(g).alias("g")))
    per = per.groupBy("term", "topic_id").agg(*(F.sum(c).alias(c) for c in ("tf", "df", "g")))
    whole = Window.partitionBy("term")
    df = F.sum("df").over(whole)
    per = per.withColumn("raw", F.log(F.lit(n) - df + 0.5) - F.log(df + 0.5)).withColumn("all_g", F.sum("g").over(whole)).withColumn("of", F.count(F.lit(1)).over(whole))
    per = cut(per)
    mean_idf = per.agg(F.sum(F.col("raw") / F.col("of")) / F.sum(1 / F.col("of"))).first()[0]  # each term once
    idf = F.when(F.col("raw") < 0, F.lit(0.25 * (mean_idf or 0.0))).otherwise(F.col("raw"))
    size = docs.groupBy("topic_id").agg(F.count(F.lit(1)).alias("size"))
    if candidates is not None:
        per = per.join(candidates.select("topic_id", "term").distinct(), ["topic_id", "term"], "left_semi")
    per = per.join(few(size), "topic_id").withColumn("raw", idf * F.col("g") / F.col("size") / (idf * F.col("all_g") / n + 1e-10) * F.log(1 + F.col("tf")))
    top = per.groupBy(F.col("topic_id").alias("t")).agg(F.max("raw").alias("top"))
    per = per.join(few(top), F.col("topic_id") == F.col("t"))
    return per.select("topic_id", "term", F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(F.col("raw")).alias("score"))


def keyphrases(docs: DataFrame, n: int = 10, most: int = 3, stop: frozenset[str] | None = None) -> DataFrame:
    """Most frequent n-grams of a topic, scaled by the most frequent."""
    x = cut(docs.select("topic_id", tokens(F.col("text"), 2, stop).alias("ts")))
    count = lambda m: terms.sums(x, m).groupBy("term", "topic_id").agg(F.sum("tf").alias("tf"))
    # an n-gram is no more frequent than its words, so words give the scale, and their n-th best bounds what can be among n
    word = cut(count(1))
    top = word.groupBy(F.col("topic_id").alias("t")).agg(F.max("tf").alias("top"))
    scaled = lambda c: c.join(few(top), F.col("topic_id").eqNullSafe(F.col("t"))).select("topic_id", "term", (F.col("tf") / F.col("top")).alias("score"))
    least = top_terms(scaled(word), n).where(F.col("rank") == n).select(F.col("topic_id").alias("l"), F.round("score", 9).alias("least"))
    found = scaled(count(most)).join(few(cut(least)), F.col("topic_id").eqNullSafe(F.col("l")), "left")
    return top_terms(found.where(F.round("score", 9) >= F.coalesce("least", F.lit(0.0))).select("topic_id", "term", "score"), n)


def diverse(candidates: DataFrame, centres: DataFrame, n: int = 10, diversity: float = 0.5) -> DataFrame:
    """topic_id, term, rank: terms nearest a topic's vector and unlike each other (maximal marginal relevance).

    candidates: topic_id, term, v (the term's vector, from any encoder); centres: topic_id, centroid. A topic's
    candidates are a list of keywords, bounded by whoever made it, and are chosen from in one task.
    """
    rows = candidates.select("topic_id", "term", F.col("v").cast("array<double>").alias("v")).join(few(centres.select("topic_id", "centroid")), "topic_id")

    def choose(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("term")
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10)
        x, c = unit(np.stack(t["v"])), unit(np.array([t["centroid"].iloc[0]]))
        near, high, at = np.round(x @ c[0], 9), np.zeros(len(x)), []
        for _ in range(min(n, len(x))):
            score = (1 - diversity) * near - diversity * (high if at else 0.0)
            score[at] = -np.inf
            at.append(int(np.argmax(np.round(score, 9))))
            s = x @ x[at[-1]]
            high = s if len(at) == 1 else np.maximum(high, s)
        return pd.DataFrame({"topic_id": t["topic_id"].iloc[0], "term": t["term"].to_numpy()[at], "rank": np.arange(1, len(at) + 1)})

    return rows.groupBy("topic_id").applyInPandas(choose, "topic_id int, term string, rank int")


def labels(keywords: DataFrame) -> DataFrame:
    """topic_id, label, description from rows topic_id, keywords (array)."""
    return keywords.select("topic_id", simple_label(F.col("keywords")).alias("label"), simple_description(F.col("keywords")).alias("description"))


def collisions(labelled: DataFrame) -> DataFrame:
    """Labels that share their first three lower-cased words."""
    return labelled.groupBy(label_key(F.col("label")).alias("label_key")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("topic_id")).alias("topics")).where("n >= 2")
