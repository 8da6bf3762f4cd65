"""The topic model: fit, transform, tables, changes, evaluation, hierarchy, save and load."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import vectors as V
from topicloom.functions.stopwords import stop_words
from topicloom.operators import community, graph, keywords as kw, knn, metrics, topics
from topicloom.session import cut


@dataclass(frozen=True)
class Config:
    """Knobs of a fit; checked once."""

    n_neighbors: int = 15
    knn_backend: str = "auto"
    graph_type: str = "hybrid"
    snn_weight: float = 0.5
    use_lexical: bool = False
    lexical_terms: int = 10_000
    weights: tuple[float, float, float] = (0.5, 0.3, 0.2)
    n_runs: int = 4
    resolution: float = 1.0
    tau: float = 0.5
    min_size: int = 5
    min_fraction: float = 0.0
    iterations: int = 1
    converged: float = 0.95
    reduce_dims: int = 0
    n_topics: int | None = None
    language: str = "english"
    n_keywords: int = 10
    n_representatives: int = 3
    representative_method: str = "centroid"
    outlier_threshold: float = topics.OUTLIER_THRESHOLD
    soft_method: str = "centroid"
    seed: int = 42

    def __post_init__(self) -> None:
        if self.n_neighbors < 1 or self.n_runs < 1 or self.iterations < 1 or self.min_size < 1:
            raise ValueError("n_neighbors, n_runs, iterations and min_size are at least 1")
        if self.graph_type not in ("knn", "mutual", "snn", "hybrid"):
            raise ValueError(f"graph_type {self.graph_type!r}")
        if self.representative_method not in ("centroid", "mmr", "stratified"):
            raise ValueError(f"representative_method {self.representative_method!r}")
        if self.soft_method not in ("centroid", "graph"):
            raise ValueError(f"soft_method {self.soft_method!r}")


def pca(rows: DataFrame, dims: int) -> DataFrame:
    """Rows with v projected on the leading components of the covariance (summed on executors)."""
    import pyarrow as pa

    d = len(rows.select("v").first()["v"])
    dims = min(dims, d)

    def moments(batches):
        s, q, n = np.zeros(d), np.zeros((d, d)), 0
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            s, q, n = s + x.sum(0), q + x.T @ x, n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], names=["n", "s", "q"])

    parts = rows.select(F.col("v").cast("array<double>").alias("v")).mapInArrow(moments, "n long, s array<double>, q array<double>").collect()  # d * d numbers a task
    n = sum(p["n"] for p in parts)
    mean = sum(np.array(p["s"]) for p in parts) / n
    cov = sum(np.array(p["q"]) for p in parts).reshape(d, d) / n - np.outer(mean, mean)
    val, vec = np.linalg.eigh(cov)
    vec = vec[:, np.argsort(val)[::-1][:dims]]
    vec = vec * np.sign(vec[np.abs(vec).argmax(0), np.arange(dims)])

    def project(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
            y = (x - mean) @ vec
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, y.size + 1, dims, dtype=np.int32), pa.array(y.ravel()))], names=["doc_id", "v"])

    return rows.select("doc_id", F.col("v").cast("array<double>").alias("v")).mapInArrow(project, "doc_id long, v array<double>")


@dataclass
class TopicModel:
    """A fitted model is a set of tables; every table is written to the shared folder when it is made.

    state: doc_id, text, v (original), r (refined), topic_id (and weight, metadata columns).
    """

    config: Config = field(default_factory=Config)
    state: DataFrame | None = None
    edges: DataFrame | None = None
    partitions: DataFrame | None = None
    names: dict[int, tuple[str, str]] = field(default_factory=dict)

    # ---- fit ----------------------------------------------------------------------------------------
    def _graph(self, rows: DataFrame, lexical: DataFrame | None, meta: DataFrame | None) -> DataFrame:
        c = self.config
        x = pca(rows, c.reduce_dims) if c.reduce_dims else rows
        near = cut(knn.self_knn(x.select(F.col("doc_id").alias("id"), "v"), c.n_neighbors, backend=c.knn_backend))
        if c.graph_type == "knn":
            e = graph.directed(near).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))
        elif c.graph_type == "mutual":
            e = graph.mutual(near)
        elif c.graph_type == "snn":
            e = graph.snn(near, c.n_neighbors)
        else:
            e = graph.hybrid(graph.mutual(near), graph.snn(near, c.n_neighbors), c.snn_weight)
        return cut(graph.fuse(e, lexical, meta, c.weights) if lexical is not None or meta is not None else e)

    def fit(self, docs: DataFrame, metadata: list[str] | None = None, weight: str | None = None) -> TopicModel:
        """docs: doc_id, text, v and perhaps metadata and weight columns."""
        c = self.config
        if docs.isEmpty():
            raise ValueError("the corpus is empty")
        base = cut(docs.select("doc_id", "text", F.col("v").cast("array<double>").alias("v"), *([F.col(weight).cast("double").alias("weight")] if weight else []), *(metadata or [])))
        least = self._least(base, weight)
        lexical = cut(graph.mutual(graph.lexical_knn(graph.tfidf(base, stop_words(c.language), max_terms=c.lexical_terms), c.n_neighbors))) if c.use_lexical else None
        meta = cut(graph.metadata_edges(base.select("doc_id", *metadata), c.n_neighbors)) if metadata else None
        rows, before = base.select("doc_id", V.l2(F.col("v")).alias("v")), None
        for i in range(c.iterations):
            edges = self._graph(rows, lexical, meta)
            self.partitions = cut(community.runs(edges, base.select("doc_id", *(["weight"] if weight else [])), [c.seed + s for s in range(c.n_runs)], c.resolution, "weight" if weight else None))
            found = community.consensus(self.partitions, c.tau, c.resolution, c.seed).select("doc_id", F.col("community").alias("topic_id"))
            if weight:
                found = found.join(base.select("doc_id", "weight"), "doc_id")
            labels = cut(community.prune(found, least, "weight" if weight else None).select("doc_id", "topic_id"))
            self.edges = edges
            if before is not None and c.iterations > 1:
                t = metrics.contingency(before.select("doc_id", F.col("topic_id").alias("a")).join(labels.select("doc_id", F.col("topic_id").alias("b")), "doc_id"))
                if metrics.ari(t).first()["ari"] >= c.converged:
                    break
            before = labels
            if i + 1 < c.iterations:
                joined = rows.join(labels, "doc_id")
                rows = cut(topics.refine(joined, topics.centroids(joined), topics.blend_schedule(i, c.iterations)).select("doc_id", "v"))
        self.state = cut(base.join(rows.select("doc_id", F.col("v").alias("r")), "doc_id").join(labels, "doc_id"))
        if c.n_topics:
            self._reach(c.n_topics, weight, least)
        return self

    def _least(self, base: DataFrame, weight: str | None) -> float:
        c = self.config
        total = base.agg(F.sum("weight") if weight else F.count(F.lit(1))).first()[0]
        return max(c.min_size, int(c.min_fraction * total))

    def _reach(self, n: int, weight: str | None, least: float) -> None:
        """Look for a resolution that gives n topics; merge what is over."""
        c = self.config
        now = self.topic_count()
        lo, hi = (c.resolution, 10 * c.resolution) if now < n else (0.001, c.resolution)
        if now != n:
            r = community.find_resolution(self.edges, self.state.select("doc_id"), n, lo, hi, seed=c.seed)
            found = community.runs(self.edges, self.state.select("doc_id"), [c.seed], r).select("doc_id", F.col("community").alias("topic_id"))
            if weight:
                found = found.join(self.state.select("doc_id", "weight"), "doc_id")
            self._set(community.prune(found, least, "weight" if weight else None).select("doc_id", "topic_id"))
        if self.topic_count() > n:
            self.reduce_topics(n)

    def _set(self, labels: DataFrame) -> None:
        self.state = cut(self.state.drop("topic_id").join(labels.select("doc_id", F.col("topic_id").cast("int").alias("topic_id")), "doc_id"))

    # ---- tables ---------------------------------------------------------------------------------------
    def _need(self) -> DataFrame:
        if self.state is None:
            raise RuntimeError("the model is not fitted")
        return self.state

    def topic_count(self) -> int:
        return self._need().where("topic_id <> -1").select("topic_id").distinct().count()

    def sizes(self) -> DataFrame:
        return topics.sizes(self._need(), "weight" if "weight" in self.state.columns else None)

    def centroids(self) -> DataFrame:
        """Means of the original vectors; empty if every topic was pruned (then all documents are outliers)."""
        return topics.centroids(self._need(), "weight" if "weight" in self.state.columns else None)

    def keywords(self, n: int | None = None) -> DataFrame:
        s = self._need().select("doc_id", "text", "topic_id")
        return kw.top_terms(kw.ctfidf(s, stop_words(self.config.language)), n or self.config.n_keywords)

    def representatives(self, n: int | None = None) -> DataFrame:
        rows, n = self._need().select("doc_id", "topic_id", F.col("r").alias("v")), n or self.config.n_representatives
        how = {"centroid": topics.representatives, "mmr": topics.representatives_mmr, "stratified": topics.representatives_stratified}
        return how[self.config.representative_method](rows, n)

    def topic_info(self) -> DataFrame:
        """topic_id, size, keywords, keyword_scores, representative_docs, label, description; outliers last."""
        w = self.keywords().groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "score"))).alias("k"))
        r = self.representatives().groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("d"))
        info = self.sizes().join(w, "topic_id", "left").join(r, "topic_id", "left")
        info = info.select("topic_id", "size", F.transform("k", lambda x: x["term"]).alias("keywords"), F.transform("k", lambda x: x["score"]).alias("keyword_scores"), F.transform("d", lambda x: x["doc_id"]).alias("representative_docs"))
        spark = info.sparkSession
        named = spark.createDataFrame([(k, *v) for k, v in self.names.items()] or [(-(10**6), "", "")], "topic_id int, label string, description string")
        info = info.join(F.broadcast(named), "topic_id", "left")
        fallback = F.when(F.col("topic_id") == -1, "Outlier").otherwise(F.concat(F.lit("Topic "), F.col("topic_id").cast("string")))
        return topics.topic_order(info.withColumn("label", F.coalesce("label", fallback)))

    def probabilities(self) -> DataFrame:
        s = self._need()
        if self.config.soft_method == "graph":
            return topics.graph_probabilities(self._edges(), s.select("doc_id", "topic_id"), s.where("topic_id <> -1").select("topic_id").distinct())
        return topics.probabilities(s.select("doc_id", "v"), self.centroids())

    def document_topics(self, doc_id: int, n: int = 3) -> DataFrame:
        return topics.top_topics(self.probabilities().where(F.col("doc_id") == doc_id), n)

    def overlap(self, threshold: float = 0.1) -> DataFrame:
        return topics.overlap(self.probabilities(), threshold)

    def _edges(self) -> DataFrame:
        if self.edges is None:
            raise RuntimeError("this needs the graph, which a loaded model may lack")
        return self.edges

    # ---- new documents ----------------------------------------------------------------------------------
    def transform(self, docs: DataFrame, threshold: float | None = None) -> DataFrame:
        """doc_id, topic_id, sim of documents with vectors."""
        return topics.assign(docs.select("doc_id", F.col("v").cast("array<double>").alias("v")), self.centroids(), self.config.outlier_threshold if threshold is None else threshold)

    def transform_proba(self, docs: DataFrame) -> DataFrame:
        return topics.probabilities(docs.select("doc_id", F.col("v").cast("array<double>").alias("v")), self.centroids())

    def fit_transform(self, docs: DataFrame, **how) -> DataFrame:
        return self.fit(docs, **how).state.select("doc_id", "topic_id")

    # ---- changes ------------------------------------------------------------------------------------------
    def reduce_outliers(self, strategy: str = "embeddings", threshold: float = 0.3) -> TopicModel:
        s = self._need().select("doc_id", "topic_id", F.col("r").alias("v"))
        if strategy == "neighbors":
            x = s.select(F.col("doc_id").alias("id"), "v", "topic_id")
            near = knn.exact(x.where("topic_id = -1"), x.where("topic_id <> -1"), self.config.n_neighbors)
            votes = topics.vote_outliers(near, s.select("doc_id", "topic_id")).withColumnRenamed("topic_id", "new")
            self._set(s.select("doc_id", "topic_id").join(votes, "doc_id", "left").select("doc_id", F.coalesce("new", "topic_id").alias("topic_id")))
        else:
            self._set(topics.reduce_outliers(s, topics.centroids(s), threshold))
        return self

    def reduce_topics(self, n: int) -> TopicModel:
        s = self._need().select("doc_id", "topic_id", F.col("r").alias("v"))
        self._set(topics.relabel(s, topics.reduction_map(topics.centroids(s), topics.sizes(s), n)))
        return self

    def merge_topics(self, groups: list[list[int]]) -> TopicModel:
        s = self._need().select("doc_id", "topic_id")
        self._set(topics.relabel(s, topics.merge_map(topics.sizes(s).where("topic_id <> -1"), groups)))
        return self

    def divide_topic(self, topic: int, n: int = 2) -> TopicModel:
        """Split one topic on its induced graph into about n; new ids follow the largest one in use."""
        s = self._need()
        own = s.where(F.col("topic_id") == topic).select("doc_id")
        if own.isEmpty():
            raise KeyError(topic)
        e = self._edges().join(own.withColumnRenamed("doc_id", "src"), "src", "left_semi").join(own.withColumnRenamed("doc_id", "dst"), "dst", "left_semi").select("src", "dst", "weight")
        r = community.find_resolution(e, own, n, self.config.resolution, 20 * self.config.resolution, seed=self.config.seed)
        found = community.runs(e, own, [self.config.seed], r).select("doc_id", F.col("community").alias("topic_id"))
        parts = community.prune(found, max(2, self.config.min_size // 2)).where("topic_id <> -1").select("doc_id", F.col("topic_id").alias("part"))
        top = s.agg(F.max("topic_id")).first()[0]
        self._set(s.select("doc_id", "topic_id").join(parts, "doc_id", "left").select("doc_id", F.coalesce(F.col("part") + top + 1, F.col("topic_id")).alias("topic_id")))
        return self

    def set_labels(self, labels: dict[int, tuple[str, str]]) -> TopicModel:
        self.names |= labels
        return self

    # ---- evaluation and hierarchy ---------------------------------------------------------------------------
    def evaluate(self, scope: str = "all") -> DataFrame:
        s = self._need()
        words = cut(self.keywords().where("topic_id <> -1").select("topic_id", "term", "rank"))
        docs = s if scope == "all" else s.where("topic_id <> -1")
        return metrics.evaluation_summary(s.select("doc_id", "topic_id"), metrics.coherence(docs, words), words, self.partitions)

    def hierarchy(self, levels: int = 3) -> tuple[DataFrame, DataFrame]:
        """Nodes (node_id, level, topic_id, parent_id, size, resolution, keywords) and membership (level, doc_id, topic_id)."""
        r = self.config.resolution
        grid = [float(x) for x in np.geomspace(r / 4, r * 4, levels)] if levels > 1 else [r]
        texts, stop = self._need().select("doc_id", "text"), stop_words(self.config.language)
        found = cut(community.runs(self._edges(), self._need().select("doc_id"), [self.config.seed], grid))
        member, nodes, above = None, None, None
        for level, res in enumerate(grid):
            own = found.where(F.abs(F.col("resolution") - res) < 1e-12).select("doc_id", F.col("community").alias("topic_id"))
            own = cut(community.prune(own, self.config.min_size).select("doc_id", "topic_id"))
            size = own.where("topic_id <> -1").groupBy("topic_id").agg(F.count(F.lit(1)).alias("size"))
            up = topics.parents(own, above) if above is not None else size.select("topic_id", F.lit(None).cast("int").alias("parent_id"))
            node = size.join(up, "topic_id", "left").select(F.format_string(f"L{level}_%d", "topic_id").alias("node_id"), F.lit(level).alias("level"), "topic_id", F.when(F.col("parent_id").isNotNull(), F.format_string(f"L{level - 1}_%d", "parent_id")).alias("parent_id"), "size", F.lit(res).alias("resolution"))
            terms = kw.top_terms(kw.ctfidf(texts.join(own, "doc_id"), stop), self.config.n_keywords)
            words = terms.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k"))
            node = node.join(words, "topic_id", "left").select(*node.columns, F.transform("k", lambda x: x["term"]).alias("keywords"))
            m = own.select(F.lit(level).alias("level"), "doc_id", "topic_id")
            nodes = node if nodes is None else nodes.unionByName(node)
            member = m if member is None else member.unionByName(m)
            above = own
        return cut(nodes), cut(member)

    def projection(self, dims: int = 2) -> DataFrame:
        """doc_id, topic_id and coordinates (v) of the documents on their leading components, for a plot."""
        s = self._need()
        return pca(s.select("doc_id", "v"), dims).join(s.select("doc_id", "topic_id"), "doc_id")

    def topic_map(self, dims: int = 2) -> DataFrame:
        """topic_id, size, label and coordinates of the topics: classical scaling of their cosine distances."""
        rows = self.centroids().orderBy("topic_id").collect()  # topics are few
        x = np.array([r["centroid"] for r in rows], dtype=float).reshape(len(rows), -1)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
        at = np.zeros((len(rows), dims))
        if len(rows) > 1:
            centre = np.eye(len(rows)) - 1 / len(rows)
            val, vec = np.linalg.eigh(-0.5 * centre @ (1 - x @ x.T) ** 2 @ centre)
            k = min(dims, len(rows))
            top = np.argsort(val)[::-1][:k]
            vec = vec[:, top] * np.sign(vec[:, top][np.abs(vec[:, top]).argmax(0), np.arange(k)])
            at[:, :k] = vec * np.sqrt(np.maximum(val[top], 0))
        out = self._need().sparkSession.createDataFrame([(int(r["topic_id"]), a.tolist()) for r, a in zip(rows, at, strict=True)], "topic_id int, at array<double>")
        return self.topic_info().select("topic_id", "size", "label").join(out, "topic_id")

    # ---- persistence ------------------------------------------------------------------------------------------
    def save(self, path: str) -> None:
        spark = self._need().sparkSession
        self.state.write.mode("overwrite").parquet(f"{path}/state")
        for name in ("edges", "partitions"):
            if getattr(self, name) is not None:
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        manifest = {"version": 1, "config": asdict(self.config), "names": {str(k): v for k, v in self.names.items()}, "tables": [n for n in ("edges", "partitions") if getattr(self, n) is not None]}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicModel:
        m = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
        c = m["config"] | {"weights": tuple(m["config"]["weights"])}
        out = cls(Config(**{k: v for k, v in c.items() if k in Config.__dataclass_fields__}), spark.read.parquet(f"{path}/state"), names={int(k): tuple(v) for k, v in m["names"].items()})
        for n in m["tables"]:
            setattr(out, n, spark.read.parquet(f"{path}/{n}"))
        return out

    def copy(self, **changes) -> TopicModel:
        return TopicModel(replace(self.config, **changes))


# ---- navigation of a node table --------------------------------------------------------------------------------


def children(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("parent_id") == node_id)


def subtopics(nodes: DataFrame, node_id: str, depth: int = 1) -> DataFrame:
    """Descendants down to a depth, by one join for each level (levels are few)."""
    level = children(nodes, node_id)
    out = level
    for _ in range(depth - 1):
        level = nodes.join(level.select(F.col("node_id").alias("up")), F.col("parent_id") == F.col("up"), "left_semi")
        out = out.unionByName(level)
    return out


def flatten(nodes: DataFrame, node_id: str | None = None) -> DataFrame:
    """A node and all below it, or every node."""
    if node_id is None:
        return nodes
    level = nodes.where(F.col("node_id") == node_id)
    out = level
    for _ in range(nodes.agg(F.max("level")).first()[0] or 0):
        level = nodes.join(level.select(F.col("node_id").alias("up")), F.col("parent_id") == F.col("up"), "left_semi")
        out = out.unionByName(level)
    return out


def get_node(nodes: DataFrame, node_id: str) -> dict | None:
    r = nodes.where(F.col("node_id") == node_id).first()
    return r.asDict() if r else None


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("parent_id").alias("up")).where("up is not null").distinct(), F.col("node_id") == F.col("up"), "left_anti")


def cut_at(nodes: DataFrame, depth: int) -> DataFrame:
    if depth < 0 or depth > nodes.agg(F.max("level")).first()[0]:
        raise IndexError(depth)
    return nodes.where(F.col("level") == depth)
