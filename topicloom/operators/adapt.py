"""Adapting vectors to judged triplets: a linear map fitted on the driver (bounded: at most ``MAX_TRIPLETS``),
applied in Arrow batches; blending with phrase vectors."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import vectors as V

MAX_TRIPLETS = 10_000


@dataclass
class LinearAdapter:
    matrix: np.ndarray

    @classmethod
    def identity(cls, dim: int) -> LinearAdapter:
        return cls(np.eye(dim))

    @classmethod
    def fit(cls, anchor: np.ndarray, positive: np.ndarray, negative: np.ndarray, epochs: int = 50, rate: float = 0.05, margin: float = 0.1, decay: float = 1e-3, batch: int = 256, seed: int = 42) -> LinearAdapter:
        """Gradient descent on the hinge ``margin - cos(a, p) + cos(a, n)`` plus decay towards the identity."""
        if len(anchor) > MAX_TRIPLETS:
            raise ValueError(f"more than {MAX_TRIPLETS} triplets")
        d = anchor.shape[1]
        w, eye, rng = np.eye(d), np.eye(d), np.random.default_rng(seed)
        unit = lambda m: (m / (n := np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10)), n)
        for _ in range(epochs):
            order = rng.permutation(len(anchor))
            for lo in range(0, len(order), batch):
                i = order[lo : lo + batch]
                (a, na), (p, np_), (n, nn) = (unit(x[i] @ w) for x in (anchor, positive, negative))
                cp, cn = (a * p).sum(1, keepdims=True), (a * n).sum(1, keepdims=True)
                on = (margin - cp + cn > 0).astype(float) / max(len(i), 1)
                ga = on * (-(p - cp * a) + (n - cn * a)) / na
                gp, gn = on * -(a - cp * p) / np_, on * (a - cn * n) / nn
                w = w - rate * (anchor[i].T @ ga + positive[i].T @ gp + negative[i].T @ gn + 2 * decay * (w - eye))
        return cls(w)

    def transform(self, rows: DataFrame) -> DataFrame:
        """doc_id, v mapped and scaled to unit length."""
        w = self.matrix

        def run(batches):
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                y = x @ w if b.num_rows else np.zeros((0, w.shape[1]))
                y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-10)
                lists = pa.ListArray.from_arrays(np.arange(0, y.size + 1, w.shape[1], dtype=np.int32), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "v"])

        return rows.select("doc_id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "doc_id long, v array<double>")

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(json.dumps({"kind": "linear", "dim": len(self.matrix)}), self.matrix.ravel().tolist())], "manifest string, matrix array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> LinearAdapter:
        r = spark.read.parquet(path).first()
        return cls(np.array(r["matrix"]).reshape(json.loads(r["manifest"])["dim"], -1))


def blend_phrases(doc: Column, phrases: Column, weight: float = 0.5) -> Column:
    """(1 - weight) doc + weight phrases, unit length; a document without phrases is untouched."""
    return F.when(phrases.isNull(), doc).otherwise(V.blend(doc, phrases, F.lit(weight)))
