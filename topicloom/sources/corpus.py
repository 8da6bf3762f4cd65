"""Sources and sinks: corpora, encoders, delimited files, projector and report files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions import vectors as V
from topicloom.functions.text import explode_clean, snippet
from topicloom.session import cut

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def corpus(df: DataFrame, text: str = "text", key: str | None = "doc_id") -> DataFrame:
    """doc_id, text and whatever else is there; the schema is checked once. An empty corpus is refused."""
    if text not in df.columns or key and key not in df.columns:
        raise ValueError(f"columns {key} and {text} are needed; there are {df.columns}")
    if df.isEmpty():
        raise ValueError("the corpus is empty")
    rest = [c for c in df.columns if c not in (text, key)]
    ident = F.col(key).cast("long") if key else F.monotonically_increasing_id()
    return df.select(ident.alias("doc_id"), F.col(text).cast("string").alias("text"), *rest)


def from_lists(spark: SparkSession, texts: Sequence[str], vectors: np.ndarray | None = None, weights: Sequence[float] | None = None) -> DataFrame:
    """In-memory source; lengths must agree."""
    if not len(texts):
        raise ValueError("the corpus is empty")
    for name, other in (("vectors", vectors), ("weights", weights)):
        if other is not None and len(other) != len(texts):
            raise ValueError(f"{len(other)} {name} for {len(texts)} texts")
    cols = {"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(list(texts), pa.string())}
    if vectors is not None:
        cols["v"] = pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float64()))
    if weights is not None:
        cols["weight"] = pa.array(list(map(float, weights)), pa.float64())
    return spark.createDataFrame(pa.table(cols))


def encode(docs: DataFrame, encoder: Callable[[], object], prefix: str = "", normalise: bool = True) -> DataFrame:
    """doc_id, v through an encoder made once per worker: an object with ``encode(list[str]) -> array``.

    Local models and remote services plug in here; nothing is called on the driver.
    """

    def run(batches):
        model = encoder()
        for b in batches:
            texts = [prefix + (t or "") for t in b.column(1).to_pylist()]
            x = np.asarray(model.encode(texts), dtype=np.float64).reshape(len(texts), -1) if texts else np.zeros((0, 1))
            if normalise:
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "v"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, v array<double>")


def embedding_dim(rows: DataFrame, v: str = "v") -> int | None:
    """Length of the vectors; None without any, ValueError if they differ."""
    r = rows.where(F.col(v).isNotNull()).agg(F.min(F.size(v)).alias("a"), F.max(F.size(v)).alias("b")).first()
    if r["a"] != r["b"]:
        raise ValueError(f"vectors of {r['a']} to {r['b']} numbers")
    return r["a"]


def retrying(call: Callable[[list[str]], np.ndarray], batch: int = 100, attempts: int = 3, sleep: Callable[[float], None] | None = None):
    """An encoder over a remote call: batches of at most 100 texts, retried after 1, 2, 4 ... seconds."""
    import time

    class Remote:
        def encode(self, texts: list[str]) -> np.ndarray:
            out = []
            for lo in range(0, len(texts), batch):
                for i in range(attempts):
                    try:
                        out.append(np.asarray(call(texts[lo : lo + batch])))
                        break
                    except Exception:
                        if i + 1 == attempts:
                            raise
                        (sleep or time.sleep)(2.0**i)
            return np.concatenate(out) if out else np.zeros((0, 1))

    return Remote()


def weighted_stack(frames: Sequence[tuple[DataFrame, float]]) -> DataFrame:
    """doc_id, v: vectors of several encoders side by side, weighted, unit length."""
    out = None
    for i, (f, _) in enumerate(frames):
        e = f.select("doc_id", F.col("v").alias(f"v{i}"))
        out = e if out is None else out.join(e, "doc_id")
    return out.select("doc_id", V.hstack(*((F.col(f"v{i}"), w) for i, (_, w) in enumerate(frames))).alias("v"))


def lsa(docs: DataFrame, dim: int = 50, seed: int = 42, rounds: int = 6) -> DataFrame:
    """doc_id, v: TF-IDF over every term of two documents or more, truncated SVD, unit rows.

    Randomised subspace iteration: each round multiplies a block (terms x (dim + 10), on the driver and sent to
    the executors) by the Gram matrix, row by row, which is never built. The sign of each component is fixed so
    that its largest entry is positive. Documents without a term are zero vectors.
    """
    from topicloom.operators.graph import tfidf

    spark = docs.sparkSession
    m = cut(tfidf(docs, None, 2, 1.0, None, 1).select("doc_id", "term", F.round("tfidf", 12).alias("w")))
    terms = [r["term"] for r in m.select("term").distinct().orderBy("term").collect()]
    if not terms:
        return docs.select("doc_id", F.array(F.lit(0.0)).alias("v"))
    index = spark.createDataFrame(list(enumerate(terms)), "i int, term string")
    rows = cut(m.join(index, "term").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("x")))
    n = len(terms)
    d = max(2, min(dim, n - 1)) if n > 2 else n
    arrays = rows.select(F.col("x.i").alias("i"), F.col("x.w").alias("w")).rdd

    def times_gram(q: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(q)

        def part(it):
            y = np.zeros_like(sent.value)
            for row in it:
                i, w = np.array(row["i"]), np.array(row["w"])
                y[i] += np.outer(w, w @ sent.value[i])
            yield y

        out = arrays.mapPartitions(part).treeReduce(np.add)
        sent.unpersist()
        return out

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, min(n, d + 10))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(times_gram(q))[0]
    small = q.T @ times_gram(q)
    val, vec = np.linalg.eigh((small + small.T) / 2)
    vec = q @ vec[:, np.argsort(val)[::-1][:d]]
    vec = vec * np.sign(vec[np.abs(vec).argmax(0), np.arange(vec.shape[1])])
    sent_vec = spark.sparkContext.broadcast(vec)

    def project(batches):
        vec = sent_vec.value
        for b in batches:
            out = np.zeros((b.num_rows, vec.shape[1]))
            for k, row in enumerate(b.column(1).to_pylist()):
                for e in row or []:
                    out[k] += e["w"] * vec[e["i"]]
            out = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-10)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), pa.array(out.ravel()))], names=["doc_id", "v"])

    return docs.select("doc_id").join(rows, "doc_id", "left").select("doc_id", "x").mapInArrow(project, "doc_id long, v array<double>")


def union_csv(spark: SparkSession, paths: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Union of delimited files by name with a provenance column; files without a required column are skipped."""
    out = None
    for p in paths:
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(p)
        if set(required) <= set(df.columns):
            df = df.withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no file has the columns {list(required)}")
    return out


def explode_delimited(df: DataFrame, column: str, by: str = "|") -> DataFrame:
    """One row for each cleaned part of a delimited column; the other columns stay aligned."""
    return df.withColumn(column, F.explode(explode_clean(F.col(column), by)))


# ---- sinks ----------------------------------------------------------------------------------------------


def write_projector(rows: DataFrame, path: str, chars: int = 150) -> None:
    """vectors and metadata as tab-separated text, one line a document in the order of doc_id.

    rows: doc_id, v, text, topic_id, label, keywords.
    """
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]+", " ")
    name = F.when(F.col("topic_id") == -1, "Outlier").otherwise(F.coalesce("label", F.col("topic_id").cast("string")))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.select(F.array_join(F.transform("v", lambda x: x.cast("string")), "\t").alias("value")).write.mode("overwrite").text(f"{path}/vectors.tsv")
    ordered.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.col("topic_id").cast("string"), clean(name), clean(F.array_join(F.slice("keywords", 1, 5), ", ")), clean(snippet(F.col("text"), chars))).alias("value")).write.mode("overwrite").text(f"{path}/metadata.tsv")


def write_csv(rows: DataFrame, path: str) -> None:
    """Quoted delimited files with a header, that union_csv reads back; arrays become text with "|" between items."""
    cols = [F.array_join(F.col(f"`{f.name}`").cast("array<string>"), "|").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in rows.schema]
    rows.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def markdown_report(title: str, themes: Sequence[dict], topics: Sequence[dict]) -> str:
    out = [f"# {title}", "", f"{len(topics)} topics in {len(themes)} themes.", ""]
    for t in themes:
        out += [f"## {t['theme_id']}. {t['title']}", "", f"*{t['total_size']} documents; {', '.join(t['keywords'][:10])}*", "", t["narrative"], ""]
        if t["unverified_quotes"]:
            out += ["> Not found in the sources: " + "; ".join(f"“{q}”" for q in t["unverified_quotes"]), ""]
    out += ["## Appendix: topics", "", "| topic | size | keywords |", "|---|---|---|"]
    out += [f"| {t['topic_id']} | {t['size']} | {', '.join(t['keywords'][:8])} |" for t in topics]
    return "\n".join(out) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text through Spark's writer, so that any store it knows will do; it ends with a line end."""
    spark.createDataFrame([(text.removesuffix("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
