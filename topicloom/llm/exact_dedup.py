"""Exact duplicates: static binary-fuse filters over an immutable snapshot screen incoming digests.

The snapshot is a table of digests (one row for each distinct text), split into buckets by the leading bits
of the digest; each bucket has a static filter of about 9 bits a key. Incoming rows are first grouped among
themselves by digest (a partial aggregate, so a text that fills a third of the batch is one row after the map
side). Their digests are screened by the bucket's filter: a negative is certainly new. Positives join the
exact bucket by digest, and the texts of such pairs are compared byte by byte before the groups merge.

Defined results: a null text counts as empty; white space of ``[\\x20\\x09-\\x0D]`` is ignored; ties in length
go to the smallest doc_id, a null doc_id comes last; repeated rows of the staying doc_id are all kept (they
are one document); an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import cut, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
#: Keys that one filter holds on average; more keys make more buckets.
BUCKET_KEYS = 100_000
#: Pairs whose ids are broadcast to fetch their texts; beyond that the texts are shuffled.
BROADCAST_PAIRS = 200_000


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE, "")


# ---- the filter -------------------------------------------------------------------------------------


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x ^ np.uint64(seed)
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(33))


@dataclass
class BinaryFuse:
    """Three-wise binary fuse filter with 8-bit fingerprints: no false negatives, about 0.4 % false positives."""

    seed: int
    segment: int
    segments: int
    slots: np.ndarray

    def _places(self, keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        h = _mix(keys, self.seed)
        first = ((h >> np.uint64(32)) * np.uint64(self.segments) >> np.uint64(32)).astype(np.int64) * self.segment
        low = np.uint64(self.segment - 1)
        places = [first + i * self.segment + ((h >> np.uint64(12 * i)) & low).astype(np.int64) for i in range(3)]
        return places, ((h ^ (h >> np.uint64(40))) & np.uint64(255)).astype(np.uint8)

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], dtype=np.uint64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.slots):
            return np.zeros(len(keys), dtype=bool)
        (a, b, c), tag = self._places(keys)
        return self.slots[a] ^ self.slots[b] ^ self.slots[c] == tag

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        if not n:
            return cls(0, 1, 0, np.zeros(0, dtype=np.uint8))
        segment = 1 << max(2, min(12, int(np.log(n) / np.log(3.33) + 2.25)))
        for seed in range(1, 1000):
            grow = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) * (1 + seed // 20 * 0.1)  # larger only if many seeds fail
            segments = max(1, int(np.ceil(n * grow / segment)) - 2)
            f = cls(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1, segment, segments, np.zeros((segments + 2) * segment, dtype=np.uint8))
            if f._fill(keys):
                return f
        raise ValueError("no seed gives a filter")

    def _fill(self, keys: np.ndarray) -> bool:
        """Peel the keys that are alone in a slot, round by round; then assign in the reverse order."""
        places, tag = self._places(keys)
        where = np.stack(places, 1)
        size, index = len(self.slots), np.arange(len(keys))
        count, mixed = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for i in range(3):
            np.add.at(count, where[:, i], 1)
            np.bitwise_xor.at(mixed, where[:, i], index)
        rounds, done = [], 0
        alone = np.flatnonzero(count == 1)
        while len(alone):
            key, at = np.unique(mixed[alone], return_index=True)
            rounds.append((key, alone[at]))
            done += len(key)
            for i in range(3):
                np.subtract.at(count, where[key, i], 1)
                np.bitwise_xor.at(mixed, where[key, i], key)
            near = np.unique(where[key].ravel())
            alone = near[count[near] == 1]
        if done < len(keys):
            return False
        for key, slot in reversed(rounds):
            self.slots[slot] = 0
            a, b, c = (self.slots[where[key, i]] for i in range(3))
            self.slots[slot] = tag[key] ^ a ^ b ^ c
        return True

    def dump(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], dtype=np.uint64).tobytes() + self.slots.tobytes()

    @classmethod
    def load(cls, data: bytes) -> BinaryFuse:
        seed, segment, segments = np.frombuffer(data[:24], dtype=np.uint64).tolist()
        return cls(seed, segment, segments, np.frombuffer(data[24:], dtype=np.uint8))


def _numbers(sha: pa.Array) -> np.ndarray:
    """The 64 bits of a hex digest that follow those of the bucket."""
    return np.array([int(s[16:32], 16) for s in sha.to_pylist()], dtype=np.uint64)


# ---- snapshot and screen ----------------------------------------------------------------------------


def _bucket(n: int) -> Column:
    """By the first 32 bits of the digest: even, whatever the texts."""
    return F.pmod(F.conv(F.substring("sha", 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def digested(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, sha (of the normalised text) and n_cp (code points of the original)."""
    return docs.select("doc_id", F.sha2(normalised(text).cast("binary"), 256).alias("sha"), F.length(text_or_empty(text)).cast("long").alias("n_cp"))


def grouped(rows: DataFrame) -> DataFrame:
    """sha, keep_id and n_cp of the row that stays, and n (rows)."""
    best = F.min(F.struct((-F.col("n_cp")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c")))
    return rows.groupBy("sha").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).select("sha", F.col("best.c").alias("keep_id"), (-F.col("best.a")).alias("n_cp"), "n")


def filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """bucket and filter (binary) of a snapshot's digests (sha)."""

    def build(t: pa.Table) -> pa.Table:
        f = BinaryFuse.build(_numbers(t.column("sha").combine_chunks()))
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "filter": pa.array([f.dump()], pa.binary())})

    return snapshot.select("sha", _bucket(buckets).alias("bucket")).groupBy("bucket").applyInArrow(build, "bucket int, filter binary")


def screen(incoming: DataFrame, snapshot_filters: DataFrame, buckets: int) -> DataFrame:
    """The digests (sha, distinct) that the snapshot may hold."""

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(["sha"]).slice(0, 0)
        f = BinaryFuse.load(right.column("filter")[0].as_py())
        return left.select(["sha"]).filter(pa.array(f.contains(_numbers(left.column("sha").combine_chunks()))))

    return incoming.select("sha", _bucket(buckets).alias("bucket")).groupBy("bucket").cogroup(snapshot_filters.groupBy("bucket")).applyInArrow(look, "sha string")


def same_bytes(docs: DataFrame, pairs: DataFrame, text: str = "text") -> DataFrame:
    """Of pairs (sha, old_id, new_id): the sha of those whose normalised texts are the same bytes."""
    n = pairs.count()
    wanted = pairs.select("sha", F.explode(F.array("old_id", "new_id")).alias("wid"))
    found = docs.select(F.col("doc_id").alias("did"), normalised(text).alias("body")).join(F.broadcast(wanted) if n <= BROADCAST_PAIRS else wanted, F.col("did").eqNullSafe(F.col("wid")))
    found = found.where(F.sha2(F.col("body").cast("binary"), 256) == F.col("sha"))
    return found.groupBy("sha").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a = b").select("sha")


def dedup(docs: DataFrame, text: str = "text", split: Column | None = None) -> DataFrame:
    """doc_id, sha, keep_id, n (group size) and kept of every row.

    split: true for the rows of the snapshot; by default those of the lower half of the doc_id range.
    """
    rows = cut(digested(docs, text))
    if split is None:
        lo, hi, _ = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
        split = F.col("doc_id") < F.lit(((lo or 0) + (hi or 0) + 1) // 2)
    old_side = F.coalesce(split, F.lit(False))
    old, new = cut(grouped(rows.where(old_side))), cut(grouped(rows.where(~old_side)))
    buckets = max(64, 1 << (old.count() // BUCKET_KEYS).bit_length())
    maybe = screen(new, filters(old, buckets), buckets)
    o = old.select("sha", F.col("keep_id").alias("old_id"), F.col("n_cp").alias("old_cp"), F.col("n").alias("old_n"))
    pairs = cut(maybe.join(o, "sha").join(new.select("sha", F.col("keep_id").alias("new_id"), F.col("n_cp").alias("new_cp"), F.col("n").alias("new_n")), "sha"))
    equal = same_bytes(docs, pairs, text)
    first = (F.col("old_cp") > F.col("new_cp")) | ((F.col("old_cp") == F.col("new_cp")) & (F.col("new_id").isNull() | (F.col("old_id") <= F.col("new_id"))))
    merged = cut(pairs.join(equal, "sha", "left_semi").select("sha", F.when(first, F.col("old_id")).otherwise(F.col("new_id")).alias("m_id"), (F.col("old_n") + F.col("new_n")).alias("m_n")))
    sides = old.select("sha", "keep_id", "n", F.lit(True).alias("side")).union(new.select("sha", "keep_id", "n", F.lit(False).alias("side")))
    groups = cut(sides.join(merged, "sha", "left").select(F.col("sha").alias("g_sha"), F.col("side").alias("g_side"), F.coalesce("m_id", "keep_id").alias("keep_id"), F.coalesce("m_n", "n").alias("n")))
    out = rows.withColumn("side", old_side).join(groups, (F.col("sha") == F.col("g_sha")) & (F.col("side") == F.col("g_side")))
    return out.select("doc_id", "sha", "keep_id", "n", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
