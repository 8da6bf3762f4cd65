"""Reduced sets of a corpus: weights, seeded samples, stratified samples, micro-clusters, selectors.

A seeded choice uses an exponential race: key ``-ln(u) / w`` ascending, u from a hash of the id, so it does
not depend on partitions and is the same in any engine that has sha256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import vectors as V
from topicloom.functions.text import uniform_from_hash
from topicloom.operators.topics import few, vector_mean


def uniform(key: str = "doc_id", seed: int = 42) -> Column:
    """A number from 0 to 1 that the key and the seed fix."""
    return uniform_from_hash(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256))


def race_key(seed: int, weight: Column, key: str = "doc_id") -> Column:
    return -F.log(F.greatest(uniform(key, seed), F.lit(1e-15))) / weight


def recency_weights(rows: DataFrame, new_count: int, floor: float = 0.25) -> DataFrame:
    """doc_id, weight: a ramp from floor towards 1 over the old rows by arrival (doc_id), 1 for the newest ones.

    Ranks come from counts of ranges of doc_id, not from one global sort.
    """
    n = rows.count()
    old = max(0, n - new_count)
    ranked = dense_rank_by_id(rows)
    step = F.lit(floor) + F.lit(1 - floor) * (F.col("pos") - 1) / F.lit(float(max(old, 1)))
    return ranked.select("doc_id", F.when(F.col("pos") > old, 1.0).otherwise(step).alias("weight"))


def dense_rank_by_id(rows: DataFrame, width: int = 1 << 16) -> DataFrame:
    """doc_id, pos (1-based rank by doc_id): a prefix sum over ranges of ids, then ranks inside a range."""
    r = rows.select("doc_id", F.floor(F.col("doc_id") / width).alias("range"))
    upto = F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    base = r.groupBy("range").agg(F.count(F.lit(1)).alias("c")).select("range", F.coalesce(upto, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("range").orderBy("doc_id"))
    return r.withColumn("own", own).join(base, "range").select("doc_id", (F.col("base") + F.col("own")).alias("pos"))


def sensitivity_weights(rows: DataFrame) -> DataFrame:
    """doc_id, weight: half uniform, half by squared distance to the mean; uniform if all rows are equal."""
    mean = F.broadcast(vector_mean(rows.withColumn("g", F.lit(1)), ["g"]).select("centroid"))
    d = rows.crossJoin(mean).select("doc_id", F.pow(V.euclidean(F.col("v"), F.col("centroid")), F.lit(2.0)).alias("d2"))
    tot = F.broadcast(d.agg(F.sum("d2").alias("total"), F.count(F.lit(1)).alias("n")))
    return d.crossJoin(tot).select("doc_id", F.when(F.col("total") > 0, 0.5 / F.col("n") + 0.5 * F.col("d2") / F.col("total")).otherwise(1.0 / F.col("n")).alias("weight"))


def sample(rows: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """A weighted sample without replacement of rows doc_id, weight; all rows if size is not less than theirs."""
    return rows.withColumn("key", race_key(seed, F.col("weight"))).orderBy("key", "doc_id").limit(size).drop("key")


def allocate(counts: dict[int, int], budget: int, least: int = 5) -> dict[int, int]:
    """Rows for each stratum: a floor, the rest in proportion (rounded, capped), trimmed from the largest."""
    n = sum(counts.values())
    if n <= budget:
        return dict(counts)
    got = {k: min(least, c) for k, c in counts.items()}
    spare = max(0, budget - sum(got.values()))
    left = {k: counts[k] - got[k] for k in counts}
    total = sum(left.values())
    for k in sorted(counts):
        if total:
            got[k] = min(counts[k], got[k] + round(spare * left[k] / total))
    while sum(got.values()) > budget:
        k = max(sorted(got), key=lambda x: got[x])
        got[k] -= 1
    return got


def stratified(rows: DataFrame, budget: int, least: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, topic_id, weight (1 / inclusion probability) of a stratified sample; -1 is a stratum too.

    The allocation is made on the driver over topics; the choice is a race inside each stratum, whose largest
    part is found by a bound on the key before rows are ordered.
    """
    counts = {r["topic_id"]: r["n"] for r in rows.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = allocate(counts, budget, least)
    plan = F.broadcast(rows.sparkSession.createDataFrame([(k, m, counts[k]) for k, m in got.items()] or [(-2, 0, 1)], "topic_id int, m int, n_c long"))
    j = rows.select("doc_id", F.col("topic_id").cast("int").alias("topic_id")).join(plan, "topic_id").withColumn("key", race_key(seed, F.lit(1.0)))
    # keys are standard exponential: those of the m smallest of n lie below about -ln(1 - m / n). The margin is
    # widened until every stratum keeps its m rows, so the choice is that of a full sort whatever the draw.
    margin = 6.0
    while True:
        share = F.least(F.lit(1.0), (F.col("m") + margin * F.sqrt(F.col("m")) + 20) / F.col("n_c"))
        near = j.where((share >= 1.0) | (F.col("key") <= -F.log(1 - share + 1e-300)))
        held = {r["topic_id"]: r["n"] for r in near.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        if all(held.get(k, 0) >= m for k, m in got.items()):
            break
        margin *= 4
    r = F.row_number().over(Window.partitionBy("topic_id").orderBy("key", "doc_id"))
    return near.withColumn("r", r).where("r <= m").select("doc_id", "topic_id", (F.col("n_c") / F.col("m")).alias("weight"))


def micro_clusters(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """doc_id, weight: the document nearest each of k centres, weighted by the centre's members."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = rows.select("doc_id", F.col("v").cast("array<double>").alias("v"), array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(x)
    c = F.broadcast(rows.sparkSession.createDataFrame([(i, [float(a) for a in m]) for i, m in enumerate(model.clusterCenters())], "prediction int, c array<double>"))
    d = model.transform(x).join(c, "prediction").select("prediction", "doc_id", F.round(V.euclidean(F.col("v"), F.col("c")), 9).alias("d"))
    return d.groupBy("prediction").agg(F.min(F.struct("d", "doc_id")).alias("b"), F.count(F.lit(1)).cast("double").alias("weight")).select(F.col("b.doc_id").alias("doc_id"), "weight")


def newest_outliers(rows: DataFrame, n: int) -> DataFrame:
    return rows.where("topic_id = -1").orderBy(F.desc("doc_id")).limit(n)


def select(rows: DataFrame, size: int, method: str = "stratified", reserve: int = 0, new_count: int = 0, seed: int = 42) -> DataFrame:
    """doc_id, weight of a reduced working set: ``stratified`` (with reserved newest outliers at weight 1),
    ``microcluster`` (newest rows plus weighted centres, never over size) or ``recency``."""
    n = rows.count()
    if n <= size:
        return rows.select("doc_id", F.lit(1.0).alias("weight"))
    if method == "recency":
        w = recency_weights(rows, new_count)
        return sample(w, size, seed).select("doc_id", F.lit(1.0).alias("weight"))
    if method == "microcluster":
        recent = rows.orderBy(F.desc("doc_id")).limit(min(new_count, size - 1))
        old = rows.join(recent.select("doc_id"), "doc_id", "left_anti")
        return recent.select("doc_id", F.lit(1.0).alias("weight")).unionByName(micro_clusters(old, max(1, size - min(new_count, size - 1)), seed))
    kept = newest_outliers(rows, reserve) if reserve else None
    rest = rows.join(kept.select("doc_id"), "doc_id", "left_anti") if kept is not None else rows
    out = stratified(rest, size - reserve, seed=seed).select("doc_id", "weight")
    return out.unionByName(kept.select("doc_id", F.lit(1.0).alias("weight"))) if kept is not None else out


def cost_ratio(rows: DataFrame, work: DataFrame, k: int, seed: int = 42) -> float:
    """Weighted distortion of a working set (doc_id, v, weight) over that of all rows, both against k centres
    fitted on the working set; near 1 if it stands for the whole."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = work.select("doc_id", F.col("v").cast("array<double>").alias("v"), F.col("weight").cast("double").alias("weight"))
    model = KMeans(k=k, seed=seed, maxIter=20, weightCol="weight").fit(x.withColumn("features", array_to_vector("v")))
    c = rows.sparkSession.createDataFrame([([float(a) for a in m],) for m in model.clusterCenters()], "c array<double>")
    whole = distortion(rows.select("doc_id", F.col("v").cast("array<double>").alias("v")), c).first()[0]
    part = distortion(x, c, "weight").first()[0]
    return part / whole if whole else 1.0


def distortion(rows: DataFrame, centres: DataFrame, weight: str | None = None) -> DataFrame:
    """Weighted sum of squared distances to the nearest centre (centres: column c; checked to be few)."""
    w = F.col(weight) if weight else F.lit(1.0)
    d = rows.withColumn("w", w).crossJoin(few(centres.select("c"))).groupBy("doc_id", "w").agg(F.min(F.pow(V.euclidean(F.col("v"), F.col("c")), F.lit(2.0))).alias("d2"))
    return d.agg((F.sum(F.col("w") * F.col("d2")) / F.sum("w")).alias("distortion"))
