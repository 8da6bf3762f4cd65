"""Topic tables: centroids, assignment, probabilities, representatives, reductions, merges, outliers.

Rows: ``doc_id, v array<double>, topic_id`` (-1 is the outlier topic). What is broadcast are centroids (one
row for each topic), and only while their number is below ``MAX_TOPICS``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import vectors as V
from topicloom.session import cut

MAX_TOPICS = 20_000
TEMPERATURE = 5.0
OUTLIER_THRESHOLD = 0.35


def few(topics: DataFrame, bound: int = MAX_TOPICS) -> DataFrame:
    """Broadcast a table of topics after its size was checked; larger ones are joined by shuffle."""
    return F.broadcast(topics) if topics.limit(bound + 1).count() <= bound else topics


def vector_mean(rows: DataFrame, keys: list[str], v: str = "v", weight: Column | None = None) -> DataFrame:
    """Mean vector for each group (weighted), by position; partial sums before the shuffle."""
    w = F.lit(1.0) if weight is None else weight
    each = rows.select(*keys, w.alias("w"), F.posexplode(v).alias("pos", "x"))
    mean = each.groupBy(*keys, "pos").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    return mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def centroids(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """topic_id, centroid of every topic but -1; not scaled to unit length."""
    return vector_mean(rows.where("topic_id <> -1"), ["topic_id"], "v", F.col(weight) if weight else None)


def sizes(rows: DataFrame, weight: str | None = None) -> DataFrame:
    return rows.groupBy("topic_id").agg(F.count(F.lit(1)).alias("size"), (F.sum(weight) if weight else F.count(F.lit(1)).cast("double")).alias("mass"))


def topic_order(topics: DataFrame) -> DataFrame:
    """Outliers last, then by size, then by id."""
    return topics.orderBy((F.col("topic_id") == -1).cast("int"), F.desc("size"), "topic_id")


def similarities(rows: DataFrame, cents: DataFrame) -> DataFrame:
    """doc_id, topic_id, sim for every topic (one pass over the documents; topics are few)."""
    c = cents.select("topic_id", V.l2(F.col("centroid")).alias("c"))
    return rows.select("doc_id", V.l2(F.col("v")).alias("u")).crossJoin(few(c)).select("doc_id", "topic_id", F.round(V.dot(F.col("u"), F.col("c")), 9).alias("sim"))


def assign(rows: DataFrame, cents: DataFrame, threshold: float | None = OUTLIER_THRESHOLD) -> DataFrame:
    """doc_id, topic_id, sim: the nearest centroid (ties to the smaller id), -1 below the threshold.

    Without topics every document is an outlier.
    """
    s = similarities(rows, cents)
    best = s.groupBy("doc_id").agg(F.max(F.struct("sim", (-F.col("topic_id")).alias("neg"))).alias("b")).select("doc_id", (-F.col("b.neg")).cast("int").alias("topic_id"), F.col("b.sim").alias("sim"))
    best = rows.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("topic_id", F.lit(-1)).alias("topic_id"), "sim")
    if threshold is None:
        return best
    return best.withColumn("topic_id", F.when(F.col("sim") < threshold, -1).otherwise(F.col("topic_id")))


def probabilities(rows: DataFrame, cents: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, topic_id, prob: softmax of similarities, outliers included."""
    s = similarities(rows, cents)
    w = Window.partitionBy("doc_id")
    e = s.withColumn("e", F.exp(F.lit(temperature) * (F.col("sim") - F.max("sim").over(w))))
    return e.select("doc_id", "topic_id", (F.col("e") / F.sum("e").over(w)).alias("prob"))


def graph_probabilities(edges: DataFrame, labels: DataFrame, topics: DataFrame) -> DataFrame:
    """doc_id, topic_id, prob: share of neighbour weight by topic; uniform where no neighbour has a topic."""
    both = edges.select("src", "dst", "weight").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    lab = labels.where("topic_id <> -1").select(F.col("doc_id").alias("dst"), "topic_id")
    mass = both.join(lab, "dst").groupBy(F.col("src").alias("doc_id"), "topic_id").agg(F.sum("weight").alias("w"))
    prob = mass.withColumn("total", F.sum("w").over(Window.partitionBy("doc_id"))).where("total > 0").select("doc_id", "topic_id", (F.col("w") / F.col("total")).alias("prob"))
    n = F.broadcast(topics.agg(F.count(F.lit(1)).alias("k")))
    lone = labels.select("doc_id").join(prob.select("doc_id").distinct(), "doc_id", "left_anti")
    flat = lone.crossJoin(few(topics.select("topic_id"))).crossJoin(n).select("doc_id", "topic_id", (F.lit(1.0) / F.col("k")).alias("prob"))
    return prob.unionByName(flat)


def top_topics(probs: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("prob", 9)), "topic_id")
    return probs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def overlap(probs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """topic_a, topic_b, n: documents in which both topics are active; the diagonal counts activations."""
    active = probs.where(F.col("prob") >= threshold)
    a = active.select("doc_id", F.col("topic_id").alias("topic_a"))
    b = active.select("doc_id", F.col("topic_id").alias("topic_b"))
    return a.join(b, "doc_id").groupBy("topic_a", "topic_b").agg(F.count(F.lit(1)).alias("n"))


# ---- representatives ----------------------------------------------------------------------------------


def distances(rows: DataFrame, cents: DataFrame | None = None) -> DataFrame:
    """doc_id, topic_id, dist: Euclidean distance to the topic's mean (of -1 too)."""
    c = vector_mean(rows, ["topic_id"]) if cents is None else cents
    return rows.join(few(c), "topic_id").select("doc_id", "topic_id", F.round(V.euclidean(F.col("v"), F.col("centroid")), 9).alias("dist"))


def representatives(rows: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("topic_id").orderBy("dist", "doc_id")
    return distances(rows).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def representatives_mmr(rows: DataFrame, n: int = 3, balance: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance: balance * relevance - (1 - balance) * similarity to those chosen.

    Every document of a topic is a candidate and counts in its mean. Each of n rounds is one distributed argmax
    (ties to the smaller id); what is joined to the rows are the few already chosen.
    """
    mean = few(cut(vector_mean(rows, ["topic_id"])))
    base = cut(rows.join(mean, "topic_id").select("topic_id", "doc_id", "v", V.cosine(F.col("v"), F.col("centroid")).alias("rel")))
    picked: list[DataFrame] = []
    for r in range(1, max(1, n) + 1):
        left, high = base, F.lit(0.0)
        if picked:
            taken = reduce(DataFrame.unionAll, picked).groupBy("topic_id").agg(F.collect_list("doc_id").alias("ids"), F.collect_list("v").alias("vs"))
            left = base.join(few(taken), "topic_id").where(~F.array_contains("ids", F.col("doc_id")))
            high = F.greatest(high, F.array_max(F.transform("vs", lambda c: V.cosine(F.col("v"), c))))
        score = F.round(F.lit(balance) * F.col("rel") - F.lit(1 - balance) * high, 9)
        first = left.select("topic_id", "doc_id", "v", score.alias("score")).groupBy("topic_id")
        best = first.agg(F.max_by(F.struct("doc_id", "v"), F.struct("score", -F.col("doc_id"))).alias("x"))
        picked.append(cut(best.select("topic_id", "x.doc_id", "x.v", F.lit(r).alias("rank"))))
    return reduce(DataFrame.unionAll, picked).where(F.col("rank") <= n).select("topic_id", "doc_id", "rank")


def representatives_stratified(rows: DataFrame, n: int = 10, shares: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> DataFrame:
    """From three distance bins (nearest first) by shares of n; a bin's shortfall goes to the nearest left."""
    quota = [int(n * s) for s in shares]
    quota[0] += n - sum(quota)
    d = distances(rows)
    w = Window.partitionBy("topic_id").orderBy("dist", "doc_id")
    d = d.withColumn("bin", F.ntile(3).over(w)).withColumn("near", F.row_number().over(w))
    d = d.withColumn("in_bin", F.row_number().over(Window.partitionBy("topic_id", "bin").orderBy("dist", "doc_id")))
    q = F.element_at(F.array(*map(F.lit, quota)), F.col("bin"))
    d = d.withColumn("first", F.col("in_bin") <= q)
    order = Window.partitionBy("topic_id").orderBy(F.desc("first"), "near")
    return d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("topic_id", "doc_id", "dist", "bin", "rank")


# ---- changes of state -----------------------------------------------------------------------------------


def reduce_outliers(rows: DataFrame, cents: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, topic_id: outliers go to the nearest centroid if it is near enough."""
    moved = assign(rows.where("topic_id = -1"), cents, threshold).select("doc_id", F.col("topic_id").alias("new"))
    return rows.select("doc_id", "topic_id").join(moved, "doc_id", "left").select("doc_id", F.coalesce("new", "topic_id").cast("int").alias("topic_id"))


def vote_outliers(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, topic_id of outliers by majority among neighbours (src, dst); ties to the smaller label."""
    votes = neighbours.join(labels.select(F.col("doc_id").alias("dst"), "topic_id"), "dst").where("topic_id <> -1").groupBy("src", "topic_id").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("src").agg(F.max(F.struct("n", (-F.col("topic_id")).alias("neg"))).alias("b"))
    return best.select(F.col("src").alias("doc_id"), (-F.col("b.neg")).cast("int").alias("topic_id"))


def pairwise(cents: DataFrame) -> DataFrame:
    """topic_a, topic_b, sim for a < b, over topics (checked to be few)."""
    c = cents.select("topic_id", V.l2(F.col("centroid")).alias("c"))
    a, b = c.select(F.col("topic_id").alias("topic_a"), F.col("c").alias("ca")), c.select(F.col("topic_id").alias("topic_b"), F.col("c").alias("cb"))
    return a.join(few(b), F.col("topic_a") < F.col("topic_b")).select("topic_a", "topic_b", V.dot(F.col("ca"), F.col("cb")).alias("sim"))


def merge_scores(cents: DataFrame, size: DataFrame, power: float = 0.3) -> DataFrame:
    """Size-aware similarity: sim * (smaller / larger) ** power."""
    s = few(size.select("topic_id", "size"))
    p = pairwise(cents).join(s.withColumnsRenamed({"topic_id": "topic_a", "size": "na"}), "topic_a").join(s.withColumnsRenamed({"topic_id": "topic_b", "size": "nb"}), "topic_b")
    return p.select("topic_a", "topic_b", (F.col("sim") * F.pow(F.least("na", "nb") / F.greatest("na", "nb"), F.lit(power))).alias("score"))


def reduction_map(cents: DataFrame, size: DataFrame, target: int, power: float = 0.3) -> dict[int, int]:
    """Old to new id of merging the best pair (size-aware) until target topics are left; the larger survives."""
    got = cents.join(size.select("topic_id", "size"), "topic_id").limit(MAX_TOPICS + 1).collect()
    if len(got) > MAX_TOPICS:
        raise ValueError("too many topics for the driver")
    got.sort(key=lambda r: r["topic_id"])
    ids, c, n = [r["topic_id"] for r in got], np.array([r["centroid"] for r in got]), np.array([float(r["size"]) for r in got])
    to = {i: i for i in ids}
    alive = list(range(len(ids)))
    while len(alive) > max(1, target):
        x, m = c[alive], n[alive]
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
        s = u @ u.T * (np.minimum(m[:, None], m) / np.maximum(m[:, None], m)) ** power
        s[np.tril_indices(len(alive))] = -np.inf
        i, j = divmod(int(np.argmax(np.round(s, 9))), len(alive))
        keep, gone = (alive[i], alive[j]) if n[alive[i]] >= n[alive[j]] else (alive[j], alive[i])
        c[keep] = (c[keep] * n[keep] + c[gone] * n[gone]) / (n[keep] + n[gone])
        n[keep] += n[gone]
        to = {k: ids[keep] if v == ids[gone] else v for k, v in to.items()}
        alive.remove(gone)
    return to


def relabel(labels: DataFrame, to: dict[int, int]) -> DataFrame:
    if not to:
        return labels
    m = F.broadcast(labels.sparkSession.createDataFrame(list(to.items()), "old int, new int"))
    return labels.join(m, F.col("topic_id") == F.col("old"), "left").withColumn("topic_id", F.coalesce("new", "topic_id")).drop("old", "new")


def merge_map(size: DataFrame, groups: list[list[int]]) -> dict[int, int]:
    """Each group goes to its largest topic; the first of equally large ones."""
    n = {r["topic_id"]: r["size"] for r in size.collect()}
    out = {}
    for g in groups:
        known = [t for t in g if t in n]
        if len(known) > 1:
            top = max(known, key=lambda t: n[t])
            out |= {t: top for t in known}
    return out


def parents(child: DataFrame, parent: DataFrame) -> DataFrame:
    """topic_id of the child level and parent_id by majority of its documents; ties to the smaller id."""
    both = child.select("doc_id", "topic_id").join(parent.select("doc_id", F.col("topic_id").alias("parent_id")), "doc_id").where("topic_id <> -1 and parent_id <> -1")
    n = both.groupBy("topic_id", "parent_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("topic_id").agg(F.max(F.struct("n", (-F.col("parent_id")).alias("neg"))).alias("b")).select("topic_id", (-F.col("b.neg")).cast("int").alias("parent_id"))


def refine(rows: DataFrame, cents: DataFrame, beta: float) -> DataFrame:
    """doc_id, v: blended towards the topic's centroid by beta * sqrt(cos), unit length; outliers only scaled."""
    j = rows.join(few(cents), "topic_id", "left")
    own = F.lit(beta) * F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), V.cosine(F.col("v"), F.col("centroid")))))
    return j.select("doc_id", "topic_id", F.when(F.col("centroid").isNull(), V.l2(F.col("v"))).otherwise(V.blend(F.col("v"), F.col("centroid"), own)).alias("v"))


def blend_schedule(i: int, rounds: int) -> float:
    return 0.3 - 0.2 * i / max(rounds - 1, 1)


def low_margin(probs: DataFrame, margin: float = 0.15, most: int = 200) -> DataFrame:
    """doc_id, margin: the documents whose two best topics are nearest; ascending, at most ``most`` (a top-k)."""
    p = probs.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list("prob"), asc=False), 1, 2).alias("p"))
    m = p.select("doc_id", F.round(F.col("p")[0] - F.coalesce(F.get("p", F.lit(1)), F.lit(0.0)), 9).alias("margin"))
    return m.where(F.col("margin") < margin).orderBy("margin", "doc_id").limit(most)


def entropy_anchors(probs: DataFrame, fraction: float = 0.5) -> DataFrame:
    """doc_id, entropy (six decimals) of the ceil(fraction * n) documents with the highest entropy (ties by id).

    Counts by entropy give the value at which the quota ends, and what is left of it there goes to the smallest ids,
    so nothing but that one value is ordered and nothing is gathered in one task.
    """
    e = cut(probs.groupBy("doc_id").agg(F.round(V.entropy(F.array_sort(F.collect_list("prob"))), 6).alias("entropy")))
    n = int(np.ceil(fraction * e.count()))
    if not n:
        return e.limit(0)
    marks = e.agg(F.percentile_approx("entropy", F.array(*(F.lit(i / 1024) for i in range(1, 1024))), 100_000).alias("m")).first()["m"] or []
    marks = sorted(set(marks), reverse=True)
    at = F.size(F.filter(F.array(*map(F.lit, marks)).cast("array<double>"), lambda m: m > F.col("entropy")))
    ranged = e.withColumn("range", at)
    upto, edge = 0, None
    for r in sorted(ranged.groupBy("range").agg(F.count(F.lit(1)).alias("c")).collect()):  # 1,024 ranges at most
        if upto + r["c"] >= n:
            edge = r["range"]
            break
        upto += r["c"]
    rest = ranged.where(F.col("range") == edge).orderBy(F.desc("entropy"), "doc_id").limit(n - upto)
    return ranged.where(F.col("range") < edge).unionByName(rest).drop("range")
