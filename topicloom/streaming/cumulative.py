"""Topics over a stream of batches: cheap assignment, drift, re-clustering, stable identities.

State is written tables below one folder: ``accumulator`` (all documents, one folder a batch), ``registry``
(global topics, one folder an epoch), ``labels`` (a folder an epoch: ``part=base`` for what the epoch began with
and one for each batch since), ``models`` (the fitted model of an epoch) and ``state``, a small file for each
commit. A step writes its tables first and its state last, so a step that failed is done again over the same
folders, a batch that was committed is not counted twice when it is replayed (``foreachBatch`` may replay), and
a restarted process goes on from the last commit.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions import vectors as V
from topicloom.functions.stopwords import stop_words
from topicloom.operators import coreset, keywords as kw, metrics, topics
from topicloom.plans.model import Config, TopicModel
from topicloom.session import cut

REGISTRY = "global_id int, centroid array<double>, mass double, keywords array<string>, label string"


@dataclass(frozen=True)
class StreamConfig:
    strategy: str = "global_refit"
    trigger: str = "drift"
    drift: float = 0.25
    every: int = 500
    debounce: int = 0
    cap: int = 50_000
    coreset_size: int = 5_000
    coreset_method: str = "stratified"
    reserve: float = 0.2
    align: str = "cosine"
    align_threshold: float = 0.6
    align_high: float = 0.85
    registry: str = "replace"
    threshold: float = topics.OUTLIER_THRESHOLD

    def __post_init__(self) -> None:
        for name, allowed in (("strategy", ("global_refit", "coreset", "batch_merge")), ("trigger", ("drift", "schedule", "manual")), ("align", ("off", "identity", "cosine", "llm", "both")), ("registry", ("replace", "accumulate"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {allowed}")


@dataclass
class BatchResult:
    batch_id: int
    n_docs: int
    novelty: float | None
    reclustered: bool
    n_topics: int
    seconds: float = 0.0


def match(new: np.ndarray, known: np.ndarray, threshold: float) -> list[int | None]:
    """For each row of new the row of known of the best one-to-one match at or above a cosine threshold."""
    if not len(new) or not len(known):
        return [None] * len(new)
    u = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10)
    s = u(new) @ u(known).T
    out: list[int | None] = [None] * len(new)
    for i, j in metrics.assignment(s):
        if s[i, j] >= threshold:
            out[i] = j
    return out


def merge_registry(registry: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Mass-weighted running mean of centroids; scaled to unit length only where something was merged.

    registry and arrivals: global_id, centroid, mass.
    """
    both = registry.select("global_id", "centroid", "mass").unionByName(arrivals.select("global_id", "centroid", "mass"))
    mean = topics.vector_mean(both.withColumnRenamed("centroid", "v"), ["global_id"], "v", F.col("mass"))
    tot = both.groupBy("global_id").agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("c"))
    return mean.join(tot, "global_id").select("global_id", F.when(F.col("c") > 1, V.l2(F.col("centroid"))).otherwise(F.col("centroid")).alias("centroid"), "mass")


def due(config: StreamConfig, fitted: bool, novelty: float | None, since: int, force: bool = False) -> bool:
    """Whether to cluster again: always at first; never within the debounce; by drift, schedule or hand."""
    if not fitted or force:
        return True
    if since < config.debounce or config.trigger == "manual":
        return False
    if config.trigger == "schedule":
        return since >= config.every
    return novelty is not None and novelty > config.drift


@dataclass
class CumulativeModel:
    spark: SparkSession
    folder: str
    base: Config = field(default_factory=Config)
    config: StreamConfig = field(default_factory=StreamConfig)
    client: object | None = None
    strategies: dict[str, Callable] = field(default_factory=dict)
    model: TopicModel | None = None
    next_id: int = 0
    since: int = 0
    epoch: int = 0
    local: dict[int, int] = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)
    results: list[BatchResult] = field(default_factory=list)
    commits: int = 0

    def __post_init__(self) -> None:
        self._restore()

    # ---- state ---------------------------------------------------------------------------------------
    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _restore(self) -> None:
        """Take everything from the last commit; a step that did not commit leaves no trace."""
        self.next_id = self.since = self.epoch = self.commits = 0
        self.local, self.history, self.results, model_epoch = {}, [], [], 0
        if self._exists(f"{self.folder}/state"):
            rows = self.spark.read.text(f"{self.folder}/state").collect()  # one short row for each batch
            steps = sorted((json.loads(r["value"]) for r in rows), key=lambda x: x["commit"])
            for x in steps:
                self.next_id, self.since, self.epoch, self.commits = x["next_id"], x["since"], x["epoch"], x["commit"] + 1
                self.local, model_epoch = {int(k): v for k, v in x["local"].items()}, x["model_epoch"]
                self.history += [x["history"]] if x["history"] else []
                self.results += [BatchResult(**x["result"])] if x["result"] else []
        if model_epoch != getattr(self, "_model_epoch", 0):
            self.model = TopicModel.load(self.spark, f"{self.folder}/models/epoch={model_epoch}") if model_epoch else None
        self._model_epoch = model_epoch

    def _commit(self, result: BatchResult | None = None, history: dict | None = None) -> None:
        state = {"commit": self.commits, "epoch": self.epoch, "since": self.since, "next_id": self.next_id, "model_epoch": self._model_epoch, "local": self.local, "history": history, "result": asdict(result) if result else None}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/state/commit={self.commits}")
        self.commits += 1
        self.history += [history] if history else []
        self.results += [result] if result else []

    # ---- tables --------------------------------------------------------------------------------------
    def accumulator(self) -> DataFrame:
        """The documents of every batch, that of a batch under way included."""
        return self.spark.read.parquet(f"{self.folder}/accumulator")

    def registry(self) -> DataFrame:
        if not self.epoch:
            return self.spark.createDataFrame([], REGISTRY)
        return self.spark.read.schema(REGISTRY).parquet(f"{self.folder}/registry/epoch={self.epoch}")

    def labels(self) -> DataFrame:
        """doc_id, topic_id (global) of every document so far."""
        if not self.epoch:
            return self.spark.createDataFrame([], "doc_id long, topic_id int")
        return self.spark.read.parquet(f"{self.folder}/labels/epoch={self.epoch}").select("doc_id", "topic_id")

    def _centroids(self) -> DataFrame:
        return self.registry().select(F.col("global_id").alias("topic_id"), "centroid")

    def _labelled(self) -> DataFrame:
        return self.accumulator().select("doc_id", "text", "v").join(self.labels(), "doc_id")

    # ---- batches ---------------------------------------------------------------------------------------
    def add_batch(self, docs: DataFrame, batch_id: int | None = None, force: bool = False) -> BatchResult:
        """docs: doc_id, text, v (and metadata). Assign, append, re-cluster if due.

        A batch that was committed under the same id gives its recorded result and changes nothing.
        """
        self._restore()
        batch_id = max((r.batch_id for r in self.results), default=-1) + 1 if batch_id is None else batch_id
        done = next((r for r in self.results if r.batch_id == batch_id), None)
        if done:
            return done
        began = time.monotonic()
        docs = docs.withColumn("v", F.col("v").cast("array<double>"))
        docs.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{self.folder}/accumulator/batch={batch_id}")
        docs = self.spark.read.parquet(f"{self.folder}/accumulator/batch={batch_id}").drop("batch_id")
        n = docs.count()
        if not n:
            out = BatchResult(batch_id, 0, None, False, self.registry().count())
            self._commit(out)
            return out
        novelty, history = None, None
        if self.epoch:
            part = f"{self.folder}/labels/epoch={self.epoch}/part=batch-{batch_id}"
            topics.assign(docs, self._centroids(), self.config.threshold).select("doc_id", "topic_id").write.mode("overwrite").parquet(part)
            novelty = self.spark.read.parquet(part).agg(F.avg((F.col("topic_id") == -1).cast("double"))).first()[0]
        self.since += n
        again = due(self.config, bool(self.epoch), novelty, self.since, force)
        if again:
            history = self._recluster(docs, novelty)
        out = BatchResult(batch_id, n, novelty, again, self.registry().count(), time.monotonic() - began)
        self._commit(out, history)
        return out

    def recluster(self) -> None:
        self._restore()
        self._commit(history=self._recluster(None, None))

    def _next_epoch(self, labels: DataFrame, registry: list) -> None:
        """Write the tables of a new epoch; it counts from the commit on."""
        labels.select("doc_id", F.col("topic_id").cast("int").alias("topic_id")).write.mode("overwrite").parquet(f"{self.folder}/labels/epoch={self.epoch + 1}/part=base")
        self.spark.createDataFrame(registry, REGISTRY).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/registry/epoch={self.epoch + 1}")
        self.epoch += 1

    def _working_set(self, batch: DataFrame | None) -> tuple[DataFrame, bool]:
        """doc_id, text, v (and weight), and whether it is the whole accumulator."""
        acc = self.accumulator().select("doc_id", "text", "v")
        how = self.config.strategy
        if how in self.strategies:
            return self.strategies[how](self, acc, batch)
        if how == "batch_merge" and batch is not None:
            return batch.select("doc_id", "text", "v"), acc.count() == batch.count()
        n = acc.count()
        if how == "global_refit" and n <= self.config.cap or n <= self.config.coreset_size:
            return acc, True
        known = self.labels()
        rows = acc.select("doc_id", "v").join(known, "doc_id", "left").withColumn("topic_id", F.coalesce("topic_id", F.lit(-1)))
        size = self.config.cap if how == "global_refit" else self.config.coreset_size
        chosen = coreset.select(rows, size, self.config.coreset_method, int(self.config.reserve * size), min(self.since, size // 2))
        return acc.join(chosen, "doc_id"), False

    def _recluster(self, batch: DataFrame | None, novelty: float | None) -> dict:
        """Cluster the working set, align its topics with the registry, write the next epoch; returns its history."""
        work, whole = self._working_set(batch)
        work = cut(work)
        model = TopicModel(self.base).fit(work, weight="weight" if "weight" in work.columns else None)
        words = model.keywords().groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
        new = model.centroids().join(model.sizes().select("topic_id", "mass"), "topic_id").join(words, "topic_id", "left").orderBy("topic_id").collect()  # topics are few
        known = self.registry().orderBy("global_id").collect()
        to = self._align(new, known)
        arrivals = [(to[i], [float(x) for x in r["centroid"]], float(r["mass"]), list(r["keywords"] or []), None) for i, r in enumerate(new)]
        if self.config.registry == "accumulate" or self.config.strategy == "batch_merge":
            rows = self._accumulated(known, arrivals)
        else:
            labels = {k["global_id"]: k["label"] for k in known}
            rows = [(g, c, m, k, labels.get(g)) for g, c, m, k, _ in self._one_each(arrivals)]
        self.local = {r["topic_id"]: to[i] for i, r in enumerate(new)}
        if whole:
            lab = self._to_global(model.state.select("doc_id", "topic_id"), self.local)
        else:
            cents = self.spark.createDataFrame([(g, c) for g, c, *_ in rows], "topic_id int, centroid array<double>")
            lab = topics.assign(self.accumulator(), cents, self.config.threshold)
        self._next_epoch(lab, rows)
        model.save(f"{self.folder}/models/epoch={self.epoch}")
        self.model, self._model_epoch = model, self.epoch
        self.since = 0
        return {"epoch": self.epoch, "n_docs": self.accumulator().count(), "n_work": work.count(), "n_topics": len(rows), "novelty": novelty, "new": sum(g is None for g in self._matched)}

    def _to_global(self, labels: DataFrame, local: dict[int, int]) -> DataFrame:
        """Local to global ids; one that is missing is an outlier."""
        m = topics.few(self.spark.createDataFrame(list(local.items()), "topic_id int, g int"))
        return labels.join(m, "topic_id", "left").select("doc_id", F.coalesce("g", F.lit(-1)).alias("topic_id"))

    def _align(self, new: list, known: list) -> list[int]:
        c = self.config
        got: list[int | None] = [None] * len(new)
        if known and c.align == "identity":
            ids = {k["global_id"] for k in known}
            got = [r["topic_id"] if r["topic_id"] in ids else None for r in new]
        elif known and c.align in ("cosine", "both", "llm"):
            a, b = np.array([r["centroid"] for r in new]).reshape(len(new), -1), np.array([k["centroid"] for k in known])
            at = match(a, b, c.align_high if c.align == "both" else c.align_threshold) if c.align != "llm" or self.client is None else [None] * len(new)
            got = [known[j]["global_id"] if j is not None else None for j in at]
            if c.align in ("llm", "both") and self.client is not None:
                from topicloom.operators.guided import align

                rest = [i for i, g in enumerate(got) if g is None]
                said = align(self.client, [{"keywords": list(new[i]["keywords"] or [])} for i in rest], [k.asDict() for k in known])
                for i, g in zip(rest, said, strict=True):
                    got[i] = g
        self._matched = got
        out = []
        for g in got:  # the mapping is total: what matches nothing gets a fresh id
            if g is None:
                g, self.next_id = self.next_id, self.next_id + 1
            out.append(g)
        return out

    def _one_each(self, arrivals: list) -> list:
        """Several new topics of one global id become their mass-weighted mean."""
        by: dict[int, list] = {}
        for a in arrivals:
            by.setdefault(a[0], []).append(a)
        out = []
        for g, rows in sorted(by.items()):
            m = sum(r[2] for r in rows)
            c = sum(np.array(r[1]) * r[2] for r in rows) / m
            if len(rows) > 1:
                c = c / max(np.linalg.norm(c), 1e-10)
            out.append((g, [float(x) for x in c], m, rows[0][3], None))
        return out

    def _accumulated(self, known: list, arrivals: list) -> list:
        old = self.spark.createDataFrame([(k["global_id"], list(k["centroid"]), k["mass"]) for k in known], "global_id int, centroid array<double>, mass double")
        new = self.spark.createDataFrame([(g, c, m) for g, c, m, _, _ in self._one_each(arrivals)], "global_id int, centroid array<double>, mass double")
        words = {k["global_id"]: list(k["keywords"] or []) for k in known} | {g: k for g, _, _, k, _ in arrivals}
        labels = {k["global_id"]: k["label"] for k in known}
        return [(r["global_id"], list(r["centroid"]), r["mass"], words.get(r["global_id"], []), labels.get(r["global_id"])) for r in merge_registry(old, new).collect()]

    # ---- what the model and the registry say ---------------------------------------------------------------
    def transform(self, docs: DataFrame) -> DataFrame:
        return topics.assign(docs, self._centroids(), self.config.threshold)

    def transform_proba(self, docs: DataFrame) -> DataFrame:
        """doc_id, topic_id (global), prob of documents with vectors."""
        return topics.probabilities(docs.select("doc_id", F.col("v").cast("array<double>").alias("v")), self._centroids())

    def topic_info(self) -> DataFrame:
        """The registry with current sizes; outliers are no row."""
        size = self.labels().groupBy("topic_id").agg(F.count(F.lit(1)).alias("size"))
        return self.registry().join(size.withColumnRenamed("topic_id", "global_id"), "global_id", "left").select("global_id", F.coalesce("size", F.lit(0)).alias("size"), "mass", "keywords", F.coalesce("label", F.concat(F.lit("Topic "), F.col("global_id").cast("string"))).alias("label"))

    def topic(self, global_id: int) -> dict | None:
        """One topic of the registry, or None."""
        row = self.topic_info().where(F.col("global_id") == global_id).first()
        return row.asDict() if row else None

    def representatives(self, n: int = 3, global_id: int | None = None) -> DataFrame:
        rows = self._labelled().where("topic_id <> -1")
        return topics.representatives(rows if global_id is None else rows.where(F.col("topic_id") == global_id), n)

    def keywords(self, n: int = 10) -> DataFrame:
        return kw.top_terms(kw.ctfidf(self._labelled().select("doc_id", "text", "topic_id"), stop_words(self.base.language)), n)

    def document_topics(self, doc_id: int, n: int = 3) -> DataFrame:
        """The n likeliest topics of one document, with probabilities."""
        return topics.top_topics(self.transform_proba(self.accumulator().where(F.col("doc_id") == doc_id)), n)

    def overlap(self, threshold: float = 0.1) -> DataFrame:
        return topics.overlap(self.transform_proba(self.accumulator()), threshold)

    def evaluate(self) -> DataFrame:
        """One row: the summary of all documents by global topic, and the bookkeeping of the stream."""
        rows = self._labelled().select("doc_id", "text", "topic_id")
        words = cut(self.keywords(self.base.n_keywords).where("topic_id <> -1").select("topic_id", "term", "rank"))
        out = metrics.evaluation_summary(rows.select("doc_id", "topic_id"), metrics.coherence(rows, words), words, self.model.partitions if self.model else None)
        return out.withColumns({"n_total_docs": F.lit(rows.count()), "n_epochs": F.lit(self.epoch), "n_global_topics": F.lit(self.registry().count())})

    def bigger_picture(self, levels: int = 3, client: object | None = None) -> dict:
        """The hierarchy (nodes, members) of the current model, and themes if a client is given."""
        if self.model is None:
            raise RuntimeError("no batch was added yet")
        nodes, members = self.model.hierarchy(levels)
        if client is not None:
            self.label(client)
        return {"nodes": nodes, "members": members, "themes": self.themes(client) if client is not None else None}

    def _described(self, examples: int = 5) -> list[dict]:
        """Topics as the guided operators take them; topics are few, and so are their examples."""
        shown: dict[int, list[str]] = {}
        for r in self.representatives(examples).join(self.accumulator().select("doc_id", "text"), "doc_id").orderBy("topic_id", "rank").collect():
            shown.setdefault(r["topic_id"], []).append(r["text"])
        return [{"topic_id": r["global_id"], "size": r["size"], "label": r["label"], "keywords": list(r["keywords"] or []), "examples": shown.get(r["global_id"], [])} for r in self.topic_info().orderBy("global_id").collect()]

    def label(self, client: object, style: str = "short") -> list[dict]:
        """Labels of all topics, kept in the registry."""
        from topicloom.operators.guided import label_topics

        named = label_topics(client, self._described(), style)
        self.set_labels({d["topic_id"]: d["label"] for d in named})
        return named

    def themes(self, client: object) -> list[dict]:
        from topicloom.operators.guided import themes

        return themes(client, self._described())

    # ---- changes; each is an epoch of its own, so labels and registry change together ---------------------
    def set_labels(self, labels: dict[int, str]) -> None:
        self._restore()
        rows = [(r["global_id"], list(r["centroid"]), r["mass"], list(r["keywords"] or []), labels.get(r["global_id"], r["label"])) for r in self.registry().collect()]
        self._next_epoch(self.labels(), rows)
        self._commit()

    def _remap(self, to: dict[int, int]) -> None:
        known = self.registry().collect()
        labels = {k["global_id"]: k["label"] for k in known}
        words = {k["global_id"]: list(k["keywords"] or []) for k in known}
        rows = self._one_each([(to.get(k["global_id"], k["global_id"]), list(k["centroid"]), k["mass"], list(k["keywords"] or []), None) for k in known])
        self.local = {k: to.get(g, g) for k, g in self.local.items()}
        self._next_epoch(topics.relabel(self.labels(), to), [(g, c, m, words.get(g, k), labels.get(g)) for g, c, m, k, _ in rows])
        self._commit()

    def reduce_topics(self, n: int) -> None:
        """Merge registry topics until n are left."""
        self._restore()
        size = self.labels().groupBy("topic_id").agg(F.count(F.lit(1)).alias("size"))
        self._remap(topics.reduction_map(self._centroids(), size, n))

    def merge_topics(self, groups: list[list[int]]) -> None:
        """Each group of global ids becomes its largest topic."""
        self._restore()
        size = self.labels().where("topic_id <> -1").groupBy("topic_id").agg(F.count(F.lit(1)).alias("size"))
        self._remap(topics.merge_map(size, groups))

    def guided_merge(self, client: object, instruction: str = "") -> list[list[int]]:
        from topicloom.operators.guided import merge_groups

        groups = merge_groups(client, self._described(), instruction)
        self.merge_topics(groups)
        return groups

    def reduce_outliers(self, threshold: float = 0.3) -> None:
        """Outliers whose nearest registered topic is near enough join it."""
        self._restore()
        new = topics.reduce_outliers(self._labelled().select("doc_id", "v", "topic_id"), self._centroids(), threshold)
        known = self.registry().collect()
        self._next_epoch(new, [(k["global_id"], list(k["centroid"]), k["mass"], list(k["keywords"] or []), k["label"]) for k in known])
        self._commit()

    def epochs(self) -> DataFrame:
        return self.spark.createDataFrame([json.loads(json.dumps(h)) | {"novelty": h["novelty"] if h["novelty"] is not None else float("nan")} for h in self.history]) if self.history else self.spark.createDataFrame([], "epoch long")

    def stream(self, source: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Run add_batch over the micro-batches of a streaming DataFrame doc_id, text, v."""

        def each(df: DataFrame, batch_id: int) -> None:
            self.add_batch(df, batch_id)

        return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def compare_strategies(spark: SparkSession, batches: list[DataFrame], folder: str, base: Config, configs: dict[str, StreamConfig], truth: DataFrame | None = None) -> DataFrame:
    """One row a strategy: topics, re-clusterings, mean novelty, ARI against a fit of everything and against truth."""
    union = batches[0]
    for b in batches[1:]:
        union = union.unionByName(b)
    full = TopicModel(base).fit(union)
    ref = full.state.select("doc_id", F.col("topic_id").alias("a"))
    out = []
    for name, c in configs.items():
        m = CumulativeModel(spark, f"{folder}/{name}", base, c)
        for b in batches:
            m.add_batch(b)
        mine = m.labels().select("doc_id", F.col("topic_id").alias("b"))
        score = metrics.ari(metrics.contingency(ref.join(mine, "doc_id"))).first()["ari"]
        own = None
        if truth is not None:
            own = metrics.ari(metrics.contingency(truth.select("doc_id", F.col("topic_id").alias("a")).join(mine, "doc_id"))).first()["ari"]
        nov = [r.novelty for r in m.results if r.novelty is not None]
        rare = metrics.rare_topic_recall(full.centroids().join(full.sizes(), "topic_id"), m.registry(), union.count()).first()["recall"]
        out.append((name, m.registry().count(), sum(r.reclustered for r in m.results), float(np.mean(nov)) if nov else None, score, own, rare))
    return spark.createDataFrame(out, "strategy string, n_topics long, reclusters int, mean_novelty double, ari_full double, ari_truth double, rare_recall double")


# ---- event-time operators on an event stream (an extension) ---------------------------------------------------


def _timed(events: DataFrame, late: str) -> DataFrame:
    """ts as an instant with a watermark; one that is there already stays, as a second is not allowed."""
    ts = events.schema["ts"]
    if "spark.watermarkDelayMs" in (ts.metadata or {}):
        return events
    timed = events if isinstance(ts.dataType, T.TimestampType) else events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late)


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling (or sliding) event-time window and type, with a watermark for late rows.

    Works on batch and streaming frames; ``ts`` is cast to an instant first, as watermarks need.
    """
    e = _timed(events, late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    e = _timed(events, late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    e = _timed(events, late)
    return e.dropDuplicatesWithinWatermark([key]) if events.isStreaming else e.dropDuplicates([key])


MASS = T.StructType([T.StructField("topic_id", T.IntegerType()), T.StructField("mass", T.DoubleType()), T.StructField("n", T.LongType())])


def running_mass(labelled: DataFrame) -> DataFrame:
    """Running mass and count of each topic over a stream of rows topic_id, weight (custom keyed state)."""
    import pandas as pd

    def step(key, frames, state):
        mass, n = state.get if state.exists else (0.0, 0)
        for f in frames:
            mass, n = mass + float(f["weight"].sum()), n + len(f)
        state.update((mass, n))
        yield pd.DataFrame({"topic_id": [key[0]], "mass": [mass], "n": [n]})

    return labelled.groupBy("topic_id").applyInPandasWithState(step, MASS, "mass double, n long", "update", "NoTimeout")
