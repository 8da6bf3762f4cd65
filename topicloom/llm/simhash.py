"""SimHash near-duplicates with pivot distance tables.

Fingerprints: 64 bits over word shingles; a bit is set if it is set in over half of the shingles' XXH64.
Links: two fingerprints that differ in at most ``bits`` bits. Equal fingerprints are collapsed first, so a
group of copies is one vertex. Candidate pairs meet in cells: with b blocks of bits and at most r differing
bits, some b - r blocks agree, so each choice of b - r blocks is one table and its bits are the cell's key
(exact, nothing is missed). A cell of more than ``CELL`` members is split into block pairs, which bounds
every task. Inside a cell the distances of each fingerprint to fixed reference fingerprints (the pivots) are
tabulated; a pair whose distances to any pivot differ by more than r is discarded (the triangle inequality)
and the survivors are verified bit by bit. A cell emits a star for each linked group, never all pairs.

Defined results: a null or empty text has fingerprint 0 and links like any other; repeated rows get the same
class; a class whose documents all lack a doc_id has a null component_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from topicloom.llm.common import bound_batches, cut
from topicloom.llm.components import components

#: Members that a cell compares among themselves; larger ones are split into pairs of blocks.
CELL = 1024
#: Rows that a task holds while it waits for a cell's end.
HOLD = 1 << 16
SEED = 42
N_PIVOTS = 16
PIVOTS = np.random.default_rng(7).integers(0, 1 << 64, N_PIVOTS, dtype=np.uint64)
STEP = 1 << 14


def fingerprint(text: str, shingle: int = 4) -> int:
    """SimHash of one text as an unsigned 64-bit integer; words by ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    stops = ends[k - 1 :].tolist()
    n, ones = len(starts), np.zeros(64, dtype=np.int64)
    for lo in range(0, n, STEP):
        h = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[lo : lo + STEP], stops[lo : lo + STEP], strict=True)], dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; a narrow map."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _layout(n: int, bits: int) -> tuple[list[tuple[int, int]], int]:
    """Blocks (offset, width) and how many must agree, so that a cell holds few random fingerprints."""
    for blocks in range(bits + 1, min(2 * bits, 8) + 1):
        agree = blocks - bits
        width = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
        if n >> sum(sorted(width)[:agree]) <= 4 and agree > 1:
            break
    offset = np.concatenate([[0], np.cumsum(width)[:-1]]).tolist()
    return list(zip(offset, width, strict=True)), agree


def _keys(fp: Column, n: int, bits: int) -> Column:
    blocks, agree = _layout(n, bits)
    out = []
    for t, chosen in enumerate(combinations(blocks, agree)):
        key = F.lit(t).cast("long")
        for offset, width in chosen:
            key = key * F.lit(1 << width) + F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out.append(key)
    return F.array(*out)


class _Forest:
    """Union-find over the rows at hand."""

    def __init__(self, n: int):
        self.top = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in np.unique(np.stack([self.top[a], self.top[b]], 1), axis=0).tolist():
            while self.top[x] != x:
                x = self.top[x]
            while self.top[y] != y:
                y = self.top[y]
            if x != y:
                self.top[max(x, y)] = min(x, y)
        while (up := self.top[self.top]) is not None and (up != self.top).any():
            self.top = up


def linked(cell: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (fingerprints) of the linked groups within each run of equal cells."""
    n = len(fp)
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    forest, at = _Forest(n), np.arange(n)
    for step in range(1, n):
        at = at[at + step < n]
        at = at[cell[at] == cell[at + step]]
        if not len(at):
            break
        for lo in range(0, len(at), HOLD):
            a = at[lo : lo + HOLD]
            a = a[forest.top[a] != forest.top[a + step]]
            for p in range(0, N_PIVOTS, 4):  # a few coordinates at a time: most pairs go early
                a = a[(np.abs(table[a, p : p + 4] - table[a + step, p : p + 4]) <= bits).all(axis=1)]
            a = a[np.bitwise_count(fp[a] ^ fp[a + step]) <= bits]
            if len(a):
                forest.join(a, a + step)
    held = np.flatnonzero(forest.top != np.arange(n))
    return fp[forest.top[held]], fp[held]


def links(fps: DataFrame, n: int, bits: int = 4) -> DataFrame:
    """Edges u, v that connect just the distinct fingerprints ``fps`` (column fp) at ``bits`` or fewer.

    n: their number, which sets the layout alone. One shuffle of (key, fp), one partial count.
    """
    keys = fps.select("fp", F.explode(_keys(F.col("fp"), n, bits)).alias("k"))
    large = cut(keys.groupBy("k").count().where(F.col("count") > CELL).select(F.col("k").alias("lk"), F.ceil(F.col("count") / CELL).cast("int").alias("nb")))
    few = large.count() <= 100_000
    rows = keys.join(F.broadcast(large) if few else large, F.col("k") == F.col("lk"), "left").select("k", "fp", F.coalesce("nb", F.lit(1)).alias("nb"))
    own = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    cells = rows.withColumn("own", own).select(
        "k",
        "fp",
        F.explode(F.when(F.col("nb") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.least(j, F.col("own")).cast("long") * F.lit(1 << 31) + F.greatest(j, F.col("own")).cast("long")))).alias("cell"),
    )
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, "k", "cell").sortWithinPartitions("k", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.concatenate([[True], (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 2] != rows[:-1, 2])])
            cell = np.cumsum(new)
            some = np.isin(cell, np.flatnonzero(np.bincount(cell) > 1))
            if some.any():
                u, v = linked(cell[some], np.ascontiguousarray(rows[some, 1]).view(np.uint64), bits)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1))
            size += len(held[-1])
            if size >= HOLD:
                rows = np.concatenate(held)
                last = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 2] != rows[-1, 2]))
                if len(last):  # the last cell may go on
                    yield from out(rows[: last[-1] + 1])
                    held = [rows[last[-1] + 1 :]]
                    size = len(held[0])
        if size:
            yield from out(np.concatenate(held))

    return dealt.select("k", "fp", "cell").mapInArrow(run, "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row."""
    rows = cut(fingerprints(docs, shingle))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    n = fps.count()
    tops = components(cut(links(fps.select("fp"), n, bits)))
    named = cut(fps.join(tops.select(F.col("v").alias("fp"), "top"), "fp", "left").select("fp", "least_id", F.coalesce("top", "fp").alias("top")))
    least = named.groupBy("top").agg(F.min("least_id").alias("component_id"))
    classes = cut(named.join(least, "top").select(F.col("fp").alias("cfp"), "component_id"))
    return rows.join(classes, F.col("fp") == F.col("cfp")).select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
