"""Metrics as DataFrame to DataFrame; one row of results each unless said. Outliers (-1) where noted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions import vectors as V
from topicloom.functions.text import tokens
from topicloom.operators import knn, terms
from topicloom.operators.topics import few, vector_mean
from topicloom.session import bound_batches, cut


def contingency(rows: DataFrame) -> DataFrame:
    """a, b, n from rows doc_id, a, b."""
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def ari(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adjusted Rand index of contingency rows a, b, n (for each group of keys)."""
    keys = keys or []
    t = table.withColumn("n", F.col("n").cast("double"))
    s = t.groupBy(*keys).agg(F.sum(_pairs(F.col("n"))).alias("s"), F.sum("n").alias("total"))
    sides = {}
    for side in ("a", "b"):
        sides[side] = t.groupBy(*keys, side).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(_pairs(F.col("n"))).alias(f"p_{side}"))
    one = lambda x, y: x.join(y, keys) if keys else x.crossJoin(F.broadcast(y))
    j = one(one(s, sides["a"]), sides["b"])
    e = F.col("p_a") * F.col("p_b") / _pairs(F.col("total"))
    d = (F.col("p_a") + F.col("p_b")) / 2 - e
    return j.select(*keys, F.when(d == 0, 1.0).otherwise((F.col("s") - e) / d).alias("ari"))


def nmi(table: DataFrame) -> DataFrame:
    """Normalised mutual information (arithmetic mean of the entropies)."""
    t = table.withColumn("n", F.col("n").cast("double"))
    a = t.groupBy("a").agg(F.sum("n").alias("na"))
    b = t.groupBy("b").agg(F.sum("n").alias("nb"))
    n = F.broadcast(t.agg(F.sum("n").alias("total")))
    mi = t.join(a, "a").join(b, "b").crossJoin(n).agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("total") * F.col("n") / (F.col("na") * F.col("nb")))).alias("mi"))
    h = lambda s, c, o: s.crossJoin(n).agg(F.sum(-F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total"))).alias(o))
    j = mi.crossJoin(F.broadcast(h(a, "na", "ha"))).crossJoin(F.broadcast(h(b, "nb", "hb")))
    mean = (F.col("ha") + F.col("hb")) / 2
    return j.select(F.when(mean == 0, 1.0).when(F.col("mi") <= 0, 0.0).otherwise(F.col("mi") / mean).alias("nmi"))


def stability(partitions: DataFrame) -> DataFrame:
    """Mean ARI over pairs of runs (rows run, doc_id, community); 1.0 for fewer than two runs.

    Runs meet on the document, so the pairs of labels are few per document and are counted before a shuffle.
    """
    p = partitions.select("run", "doc_id", "community")
    q = p.select(F.col("run").alias("run2"), "doc_id", F.col("community").alias("b"))
    t = p.join(q, "doc_id").where("run < run2").groupBy("run", "run2", F.col("community").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    return ari(t, ["run", "run2"]).agg(F.coalesce(F.avg("ari"), F.lit(1.0)).alias("stability"))


def silhouette(rows: DataFrame) -> DataFrame:
    """Exact mean silhouette (Euclidean) of rows doc_id, v, topic_id; 0.0 with fewer than two topics.

    Every row is compared with every topic's rows in blocks; the sums by topic leave each block, not pairs.
    """
    x = rows.where("topic_id <> -1").select(F.col("doc_id").alias("id"), F.col("topic_id").cast("int").alias("t"), F.col("v").cast("array<double>").alias("v"))

    def fold(ids: np.ndarray, p: np.ndarray, own: np.ndarray, blocks) -> pa.Table:
        total, norm = {}, (p * p).sum(1)[:, None]
        for _, r, t in blocks:
            topics, at = np.unique(t, return_inverse=True)
            one = np.zeros((len(r), len(topics)))
            one[np.arange(len(r)), at] = 1
            square = (r * r).sum(1)
            s = np.concatenate([np.sqrt(np.maximum(norm[i : i + 256] + square - 2 * p[i : i + 256] @ r.T, 0)) @ one for i in range(0, len(p), 256)])
            for j, topic in enumerate(topics.tolist()):
                total[topic] = total.get(topic, 0.0) + s[:, j]
        k = len(total)
        return pa.table({"id": np.tile(ids, k), "own": np.tile(own, k), "t": np.repeat(np.array(list(total), np.int32), len(ids)), "s": np.concatenate([np.zeros(0), *total.values()])})

    sums, _ = knn.block_pairs(x, x, x.count(), False, fold, "id long, own int, t int, s double")
    sums = sums.groupBy("id", "own", "t").agg(F.sum("s").alias("s"))
    n = few(x.groupBy("t").agg(F.count(F.lit(1)).alias("n")))
    per = sums.join(n, "t").groupBy("id").agg(
        F.max(F.when(F.col("t") == F.col("own"), F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)))).alias("a"),
        F.min(F.when(F.col("t") != F.col("own"), F.col("s") / F.col("n"))).alias("b"),
    )
    s = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("silhouette"))


def davies_bouldin(rows: DataFrame) -> DataFrame:
    """Mean over topics of the worst (s_i + s_j) / d(c_i, c_j); null with fewer than two topics."""
    x = rows.where("topic_id <> -1")
    c = vector_mean(x, ["topic_id"])
    s = x.join(few(c), "topic_id").groupBy("topic_id").agg(F.avg(V.euclidean(F.col("v"), F.col("centroid"))).alias("s"))
    t = c.join(s, "topic_id")
    u = t.select(F.col("topic_id").alias("t2"), F.col("centroid").alias("c2"), F.col("s").alias("s2"))
    worst = t.join(few(u), F.col("topic_id") != F.col("t2")).groupBy("topic_id").agg(F.max((F.col("s") + F.col("s2")) / V.euclidean(F.col("centroid"), F.col("c2"))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(rows: DataFrame) -> DataFrame:
    x = rows.where("topic_id <> -1")
    c = vector_mean(x, ["topic_id"]).join(x.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n")), "topic_id")
    whole = F.broadcast(vector_mean(x.withColumn("g", F.lit(1)), ["g"]).select(F.col("centroid").alias("m")))
    sq = lambda a, b: F.pow(V.euclidean(a, b), F.lit(2.0))
    between = c.crossJoin(whole).agg(F.sum(F.col("n") * sq(F.col("centroid"), F.col("m"))).alias("b"), F.count(F.lit(1)).alias("t"), F.sum("n").alias("n"))
    inside = x.join(few(c.select("topic_id", "centroid")), "topic_id").agg(F.sum(sq(F.col("v"), F.col("centroid"))).alias("w"))
    j = between.crossJoin(F.broadcast(inside))
    return j.select(F.when((F.col("t") > 1) & (F.col("w") > 0), (F.col("b") / (F.col("t") - 1)) / (F.col("w") / (F.col("n") - F.col("t")))).alias("calinski_harabasz"))


def coherence(docs: DataFrame, keywords: DataFrame, window: int = 10) -> DataFrame:
    """topic_id, npmi, uci, umass from rows topic_id, term (unigrams; others have frequency 0).

    Windows are sets of tokens: one for a short document, else all sliding ones. They are counted row by row, and a task
    sends one sum for each keyword and pair of keywords. Frequencies are those of documents ``docs`` (column text).
    """
    kw = cut(keywords.select("topic_id", F.lower("term").alias("term"), "rank"))
    pairs = kw.select("topic_id", F.col("term").alias("x"), F.col("rank").alias("rx")).join(kw.select("topic_id", F.col("term").alias("y"), F.col("rank").alias("ry")), "topic_id").where("rx < ry")
    pairs = pairs.withColumns({"p": F.least("x", "y"), "q": F.greatest("x", "y")})
    need = pairs.where("p < q").select("p", "q").distinct()
    t = docs.select("doc_id", tokens(F.col("text"), 1).alias("ts"))
    once, more = terms.split_repeats(t, ["doc_id"])
    n = _window_counts(once, kw.select("term").where("term is not null").distinct().toArrow().column("term"), need.toArrow(), window)
    if more is not None:  # rows that share their doc_id share its windows
        n = n.unionAll(_shared_windows(more, kw.select("term").distinct(), window))
    n = cut(n.groupBy("p", "q").agg(F.sum("n").alias("n")))
    total = F.broadcast(n.where("p is null").select(F.col("n").alias("w")))
    f, co = n.where("p is not null and q is null").select(F.col("p").alias("term"), F.col("n").alias("f")), n.where("q is not null").select("p", "q", F.col("n").alias("fab"))
    j = pairs.join(co, ["p", "q"], "left").join(f.select(F.col("term").alias("x"), F.col("f").alias("fa")), "x").join(f.select(F.col("term").alias("y"), F.col("f").alias("fb")), "y").crossJoin(total)
    prob = lambda c: (F.coalesce(F.col(c), F.lit(0.0)) + 1) / (F.col("w") + 1)
    pa_, pb, pab = prob("fa"), prob("fb"), prob("fab")
    scores = j.select(
        "topic_id",
        (F.log(pab / (pa_ * pb)) / (-F.log(pab) + 1e-12)).alias("npmi"),
        F.log(pab / (pa_ * pb + 1e-12)).alias("uci"),
        F.log((F.coalesce("fab", F.lit(0.0)) + 1) / F.col("fb")).alias("umass"),
    )
    found = scores.groupBy("topic_id").agg(F.avg("npmi").alias("npmi"), F.avg("uci").alias("uci"), F.avg("umass").alias("umass"))
    return kw.select("topic_id").distinct().join(found, "topic_id", "left").select("topic_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("npmi", "uci", "umass")))


def _window_counts(rows: DataFrame, words: pa.ChunkedArray, need: pa.Table, window: int) -> DataFrame:
    """p, q, n of rows doc_id, ts: windows with p (q null), with p and q (as needed), and all (both null); sums of a task.

    A word is in the union of its occurrences' runs of windows. Windows with both words are those of each, less the union of both.
    """
    bound_batches(rows.sparkSession)
    words = pa.array(sorted(words.to_pylist()), pa.string())
    code = {w: i for i, w in enumerate(words.to_pylist())}
    left, right = (np.array([code[w] for w in need.column(c).to_pylist()], np.int64) for c in ("p", "q"))
    side, pair = np.concatenate([left, right]), np.tile(np.arange(len(left)), 2)
    pair = pair[np.argsort(side, kind="stable")]  # the pairs of each word
    degree = np.bincount(side, minlength=len(words))
    start = np.cumsum(degree) - degree

    def covered(group: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
        """Windows in the union of runs first to last, by group; rows are sorted by group, and runs ascend in it."""
        before = np.concatenate([[-1], last[:-1]])
        before[np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]] = -1
        return np.bincount(group, np.maximum(0, last - np.maximum(first, before + 1) + 1), n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, f, both = 0, np.zeros(len(words)), np.zeros(len(left))
        for b in batches:
            ts = b.column("ts")
            size = ts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            windows = np.where(size > 0, np.maximum(1, size - window + 1), 0)
            total += int(windows.sum())
            term = pc.fill_null(pc.index_in(ts.flatten().cast(pa.string()), value_set=words), -1).to_numpy()
            at = np.flatnonzero(term >= 0)
            if not len(at):
                continue
            row = np.repeat(np.arange(len(size)), size)[at]
            pos, term = at - (np.cumsum(size) - size)[row], term[at].astype(np.int64)
            base = row * (size.max() + 1)  # windows are numbered through the batch
            first, last = base + np.maximum(0, pos - window + 1), base + np.minimum(pos, windows[row] - 1)
            order = np.argsort(term, kind="stable")
            f += covered(term[order], first[order], last[order], len(words))
            known = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[row]  # no pairs without a doc_id, as in a join
            row, term, first, last = row[known], term[known], first[known], last[known]
            done = np.cumsum(degree[term])
            lo = 0
            while lo < len(row):  # whole rows, about HELD pairs of a keyword and its partner at a time
                hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + terms.HELD, "right")))
                hi = int(np.searchsorted(row, row[hi - 1], "right"))
                t, d = term[lo:hi], degree[term[lo:hi]]
                occ = np.repeat(np.arange(hi - lo), d)
                own = pair[np.arange(len(occ)) - np.repeat(np.cumsum(d) - d, d) + start[t][occ]]
                key = np.sort(own * (hi - lo) + occ)
                own, occ = key // (hi - lo), key % (hi - lo) + lo
                order = np.argsort(t, kind="stable")
                single = covered(t[order], first[lo:hi][order], last[lo:hi][order], len(words))
                both += single[left] + single[right] - covered(own, first[occ], last[occ], len(left))
                lo = hi
        w, c = np.flatnonzero(f), np.flatnonzero(both)
        p = pa.concat_arrays([pa.nulls(1, pa.string()), words.take(pa.array(w)), words.take(pa.array(left[c]))])
        q = pa.concat_arrays([pa.nulls(1 + len(w), pa.string()), words.take(pa.array(right[c]))])
        yield pa.RecordBatch.from_pydict({"p": p, "q": q, "n": np.concatenate([[float(total)], f[w], both[c]])})

    return rows.mapInArrow(count, "p string, q string, n double")


def _shared_windows(rows: DataFrame, words: DataFrame, window: int) -> DataFrame:
    """The counts of ``_window_counts`` where several rows make up a document; rows of windows are joined."""
    t = rows.where(F.size("ts") > 0)
    n_win = F.greatest(F.lit(1), F.size("ts") - F.lit(window) + 1)
    pos = t.select("doc_id", n_win.alias("n_win"), F.posexplode("ts").alias("pos", "term")).join(few(words, 200_000), "term")
    # window s holds positions s .. s + window - 1
    first, last = F.greatest(F.lit(0), F.col("pos") - F.lit(window) + 1), F.least(F.col("pos"), F.col("n_win") - 1)
    win = cut(pos.select("doc_id", "term", F.explode(F.sequence(first, last)).alias("win")).distinct())
    a, b = win.select("doc_id", "win", F.col("term").alias("p")), win.select("doc_id", "win", F.col("term").alias("q"))
    n = F.count(F.lit(1)).cast("double").alias("n")
    none = F.lit(None).cast("string")
    f = win.groupBy(F.col("term").alias("p")).agg(n).select("p", none.alias("q"), "n")
    co = a.join(b, ["doc_id", "win"]).where("p < q").groupBy("p", "q").agg(n)
    return f.unionAll(co).unionAll(t.agg(F.coalesce(F.sum(n_win.cast("double")), F.lit(0.0)).alias("n")).select(none.alias("p"), none.alias("q"), "n"))


def diversity(keywords: DataFrame) -> DataFrame:
    return keywords.agg(F.coalesce(F.countDistinct(F.lower("term")) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("diversity"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two keyword arrays, whatever their case; 1.0 if both are empty."""
    x, y = (F.array_distinct(F.transform(k, F.lower)) for k in (a, b))
    u = F.size(F.array_union(x, y))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / u)


def assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a maximum-score one-to-one assignment (Hungarian, O(n^3)); small matrices."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score).astype(float)
    n, m = cost.shape
    u, v, p, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = p[j0]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            free = ~used[1:]
            better = free & (cur < least[1:])
            least[1:][better], way[1:][better] = cur[better], j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[p[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            p[j0] = p[j1]
            j0 = j1
    out = [(p[j] - 1, j - 1) for j in range(1, m + 1) if p[j]]
    return sorted((b, a) if flip else (a, b) for a, b in out)


def hungarian_accuracy(table: DataFrame) -> float:
    """Share of documents on the best one-to-one match of labels a (without -1) and b; from contingency rows."""
    t = table.where("a <> -1").collect()
    if not t:
        return 0.0
    rows, cols = sorted({r["a"] for r in t}), sorted({r["b"] for r in t})
    m = np.zeros((len(rows), len(cols)))
    for r in t:
        m[rows.index(r["a"]), cols.index(r["b"])] = r["n"]
    return float(sum(m[i, j] for i, j in assignment(m)) / m.sum())


def matched_overlap(a: DataFrame, b: DataFrame, threshold: float = 0.0) -> DataFrame:
    """topic_a, topic_b, jaccard of keywords over the best one-to-one match of two sets of topics by centroid.

    a, b: topic_id, centroid, keywords. Their mean is the mean keyword overlap. Topics are few (``few`` checks them).
    """
    x, y = (sorted(t.select("topic_id", "centroid").collect()) for t in (a, b))
    pairs = []
    if x and y:
        u, v = (np.array([r["centroid"] for r in t], dtype=float) for t in (x, y))
        u, v = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10) for m in (u, v))
        s = u @ v.T
        pairs = [(x[i]["topic_id"], y[j]["topic_id"], float(s[i, j])) for i, j in assignment(s) if s[i, j] >= threshold]
    found = a.sparkSession.createDataFrame(pairs, "topic_a int, topic_b int, sim double")
    side = lambda t, n: few(t.select(F.col("topic_id").alias(f"topic_{n}"), F.col("keywords").alias(f"k{n}")))
    return found.join(side(a, "a"), "topic_a").join(side(b, "b"), "topic_b").select("topic_a", "topic_b", "sim", jaccard(F.col("ka"), F.col("kb")).alias("jaccard"))


def downstream_score(rows: DataFrame, seed: int = 42, folds: int = 5) -> float:
    """Mean macro F1, over folds, of a logistic regression that predicts ``truth`` from v and the one-hot topic.

    The number of folds is bounded by the rarest class; 0.0 with a single class or a class of one row.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n = {r["truth"]: r["n"] for r in rows.groupBy("truth").agg(F.count(F.lit(1)).alias("n")).collect()}  # classes are few
    folds = min(folds, min(n.values(), default=0))
    if len(n) < 2 or folds < 2:
        return 0.0
    ids = sorted(r[0] for r in rows.select("topic_id").distinct().collect())
    names = {t: i for i, t in enumerate(sorted(n))}
    one = F.array(*(F.when(F.col("topic_id") == t, 1.0).otherwise(0.0) for t in ids))
    to = F.create_map(*(c for t, i in names.items() for c in (F.lit(t), F.lit(float(i)))))
    order = Window.partitionBy("truth").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    x = rows.select("doc_id", array_to_vector(F.concat(F.col("v").cast("array<double>"), one)).alias("features"), to[F.col("truth")].alias("label"), (F.row_number().over(order) % folds).alias("fold"))
    scores = []
    for k in range(folds):
        model = LogisticRegression(maxIter=100, regParam=1e-3).fit(x.where(F.col("fold") != k))
        c = contingency(model.transform(x.where(F.col("fold") == k)).select(F.col("label").alias("a"), F.col("prediction").alias("b"))).collect()
        f = []
        for t in map(float, range(len(n))):
            hit, told, real = (sum(r["n"] for r in c if w(r)) for w in (lambda r, t=t: r["a"] == r["b"] == t, lambda r, t=t: r["b"] == t, lambda r, t=t: r["a"] == t))
            f.append(2 * hit / (told + real) if told + real else 0.0)
        scores.append(sum(f) / len(f))
    return sum(scores) / len(scores)


def rare_topic_recall(full: DataFrame, found: DataFrame, n: int, fraction: float = 0.05, cutoff: float = 0.7) -> DataFrame:
    """Share of the full batch's topics below fraction * n documents that have a centroid within the cutoff.

    full: topic_id, size, centroid; found: centroid. Null if there is no rare topic.
    """
    rare = full.where(F.col("size") < fraction * n)
    near = rare.crossJoin(few(found.select(F.col("centroid").alias("c2")))).groupBy("topic_id").agg(F.max(F.round(V.cosine(F.col("centroid"), F.col("c2")), 9)).alias("sim"))
    return rare.select("topic_id").join(near, "topic_id", "left").agg(F.avg(F.coalesce(F.col("sim") >= cutoff, F.lit(False)).cast("double")).alias("recall"))


def triplet_accuracy(triplets: DataFrame, rows: DataFrame) -> DataFrame:
    """Share of (anchor, positive, negative) with cos(a, p) > cos(a, n); null if there is none."""
    v = lambda k: rows.select(F.col("doc_id").alias(k), F.col("v").alias(f"v_{k}"))
    j = triplets.join(v("anchor"), "anchor").join(v("positive"), "positive").join(v("negative"), "negative")
    hit = F.round(V.cosine(F.col("v_anchor"), F.col("v_positive")), 9) > F.round(V.cosine(F.col("v_anchor"), F.col("v_negative")), 9)
    return j.agg(F.avg(hit.cast("double")).alias("accuracy"))


def triplet_agreement(triplets: DataFrame, labels: DataFrame) -> DataFrame:
    """Laplace-smoothed agreement of judged triplets (anchor, b, c, answer B or C or null) with a partition.

    A triplet counts if the partition puts exactly one of b and c with the anchor and the answer was read.
    """
    lab = lambda k: labels.select(F.col("doc_id").alias(k), F.col("topic_id").alias(f"t_{k}"))
    j = triplets.where("answer is not null").join(lab("anchor"), "anchor").join(lab("b"), "b").join(lab("c"), "c").where("t_anchor <> -1")
    with_b, with_c = F.col("t_anchor") == F.col("t_b"), F.col("t_anchor") == F.col("t_c")
    j = j.where(with_b != with_c)
    agree = (with_b & (F.col("answer") == "B")) | (with_c & (F.col("answer") == "C"))
    return j.agg(((F.coalesce(F.sum(agree.cast("long")), F.lit(0)) + 1) / (F.count(F.lit(1)) + 2)).alias("agreement"), F.count(F.lit(1)).alias("counted"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks."""
    out = rows
    for c in (x, y):
        n = out.groupBy(c).agg(F.count(F.lit(1)).alias("c"))
        r = n.withColumn("r", F.sum("c").over(Window.orderBy(c)) - (F.col("c") - 1) / 2).select(c, F.col("r").alias(f"r_{c}"))
        out = out.join(r, c)
    return out.agg(F.corr(f"r_{x}", f"r_{y}").alias("spearman"))


def evaluation_summary(labels: DataFrame, coherences: DataFrame, keywords: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
    base = labels.agg(F.countDistinct(F.when(F.col("topic_id") != -1, F.col("topic_id"))).alias("n_topics"), F.avg((F.col("topic_id") == -1).cast("double")).alias("outlier_ratio"))
    c = coherences.agg(F.avg("npmi").alias("coherence_mean"), F.stddev_pop("npmi").alias("coherence_std"))
    out = base.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(diversity(keywords)))
    return out.crossJoin(F.broadcast(stability(partitions))) if partitions is not None else out.withColumn("stability", F.lit(1.0))
