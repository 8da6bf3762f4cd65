"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Token capacity flows from
the patterns to the sources' quotas: a pattern has one layer of capacity for each allowed repetition, and a
later layer costs more for each token (convex), so documents repeat only where a quota needs it. The flow is
solved on the driver over patterns and sources, whose number is a property of the taxonomy and is checked.
Whole documents are then selected in the order of a seeded hash: a histogram over hash ranges finds where a
pattern's flow ends, only that range is ordered, and the gap that is left is filled with documents that fit.
The gap is smaller than the document at the edge, so what is weighed for it is at most one row for each size
below that.

Defined results: null or empty texts have size 0 and take 0; a null source is a source of its own, last in
order; a null membership is that of the null source, an empty one belongs to no source, has target 0 and takes 0;
repeated rows, and rows that share a doc_id or have none, are documents of their own, taken one by one; an empty
table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import cut, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2
#: Patterns and sources that the driver may hold.
MAX_PATTERNS = 100_000
#: Rows of ids that are broadcast; beyond that they are joined by shuffle.
BROADCAST_IDS = 500_000
#: Ranges of the seeded hash; a source's flow ends inside one of them.
RANGES_BITS = 12
SEED = 20_240_229


def targets(sizes: list[float], weights: list[float], total: float, repeats: float = REPEATS) -> list[float]:
    """Shares of total by weight; none above repeats times its size, the excess reshared until none is."""
    out, left = [0.0] * len(sizes), set(range(len(sizes)))
    while left:
        rest, w = total - sum(out[i] for i in range(len(sizes)) if i not in left), sum(weights[i] for i in left)
        share = {i: rest * weights[i] / w for i in left}
        over = {i for i in left if share[i] > repeats * sizes[i]}
        if not over:
            for i, x in share.items():
                out[i] = x
            return out
        for i in over:
            out[i] = float(repeats * sizes[i])
        left -= over
    return out


def min_cost_flow(supply: list[int], allowed: list[list[int]], quota: list[int], repeats: int = REPEATS) -> list[int]:
    """Tokens that each pattern sends: as much of the quotas as possible, at the least repetition cost.

    supply: tokens of one pass over a pattern; allowed: its sources; layer c of a pattern costs 2c + 1 a token.
    The cost of a path from the source of the flow is that of the layer it leaves through, since nothing but
    layers costs. Successive shortest paths therefore open one layer after the other, and all paths of a layer
    are a maximum flow, found by blocking flows over levels (a few passes over the arcs each).
    """
    n = len(supply)
    free = [0] * n  # what a pattern may still send
    sent: list[dict[int, int]] = [dict.fromkeys(a, 0) for a in allowed]
    into: list[list[int]] = [[] for _ in quota]
    for p, a in enumerate(allowed):
        for q in sent[p]:
            into[q].append(p)
    left = list(quota)
    for _ in range(repeats):
        for p, x in enumerate(supply):
            free[p] += x
        while _augment(free, sent, into, left):
            pass
    return [sum(s.values()) for s in sent]


def _augment(free: list[int], sent: list[dict[int, int]], into: list[list[int]], left: list[int]) -> int:
    """One blocking flow along shortest paths from patterns that may send to sources that may take; what it adds.

    A path goes from a pattern to a source, and back from a source to a pattern that sends to it already.
    """
    level_p, level_q = [-1] * len(free), [-1] * len(left)
    at = [p for p, x in enumerate(free) if x and sent[p]]
    for p in at:
        level_p[p] = 0
    depth, found = 0, False
    while at and not found:
        sources = []
        for p in at:
            for q in sent[p]:
                if level_q[q] < 0:
                    level_q[q] = depth + 1
                    sources.append(q)
                    found |= left[q] > 0
        at = []
        if not found:
            for q in sources:
                for p in into[q]:
                    if level_p[p] < 0 and sent[p][q]:
                        level_p[p] = depth + 2
                        at.append(p)
        depth += 2
    if not found:
        return 0
    arcs_p, arcs_q = [iter(s) for s in sent], [iter(x) for x in into]
    now_p, now_q = [next(i, None) for i in arcs_p], [next(i, None) for i in arcs_q]
    total = 0
    for start in range(len(free)):
        while level_p[start] == 0 and free[start]:
            path, p = [], start  # (pattern, source) steps, then back to the next pattern
            while True:
                while (q := now_p[p]) is not None and level_q[q] != level_p[p] + 1:
                    now_p[p] = next(arcs_p[p], None)
                if q is None:  # a dead end: step back and drop the arc that led here
                    if not path:
                        break
                    p, q = path.pop()
                    now_q[q] = next(arcs_q[q], None)
                if left[q]:
                    path.append((p, q))
                    break
                while (o := now_q[q]) is not None and not (level_p[o] == level_q[q] + 1 and sent[o][q]):
                    now_q[q] = next(arcs_q[q], None)
                if o is None:
                    now_p[p] = next(arcs_p[p], None)
                    continue
                path.append((p, q))
                p = o
            if not path:
                break
            back = [(path[i + 1][0], path[i][1]) for i in range(len(path) - 1)]
            push = min([free[start], left[path[-1][1]], *(sent[o][q] for o, q in back)])
            free[start] -= push
            left[path[-1][1]] -= push
            for p, q in path:
                sent[p][q] += push
            for o, q in back:
                sent[o][q] -= push
            total += push
    return total


def sized(docs: DataFrame, text: str = "text", sources: Column | None = None) -> DataFrame:
    """doc_id, key (the membership pattern), members (array of its sources) and size (words)."""
    sources = F.array("source") if sources is None else sources
    members = F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string")))))
    rows = docs.select("doc_id", members.alias("members"), F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"))
    return rows.withColumn("key", F.to_json(F.struct("members")))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (a written table with columns part and at) with nth: 0, 1, ... among those that share a doc_id (null
    is a value like any other), and 0 for all others.

    Counts by doc_id and part give each part its first number, so rows of one doc_id are numbered part by part
    and never gathered. Rows of one doc_id are numbered by size first within a part.
    """
    shared = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("doc_id").alias("s_id"))
    shared = cut(shared)
    n = shared.count()
    if not n:
        return rows.withColumn("nth", F.lit(0).cast("long")).drop("part", "at")
    same = F.col("doc_id").eqNullSafe(F.col("s_id"))
    small = F.broadcast(shared) if n <= BROADCAST_IDS else shared
    lone = rows.join(small, same, "left_anti").withColumn("nth", F.lit(0).cast("long"))
    many = rows.join(small, same, "left_semi")
    # rows of one doc_id, pattern and size are alike, so which of them gets which number does not show
    kind = ["doc_id", "key", "size"]
    per = many.groupBy(*kind, "part").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("doc_id").orderBy("key", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = cut(per.select(*(F.col(k).alias(f"f_{k}") for k in kind), F.col("part").alias("f_part"), F.coalesce(F.sum("c").over(order), F.lit(0)).alias("first")))
    own = F.row_number().over(Window.partitionBy(*kind, "part").orderBy("at")) - 1
    on = (F.col("part") == F.col("f_part")) & (F.col("size") == F.col("f_size")) & (F.col("key") == F.col("f_key")) & F.col("doc_id").eqNullSafe(F.col("f_doc_id"))
    many = many.withColumn("own", own).join(first, on).withColumn("nth", F.col("first") + F.col("own"))
    return lone.drop("part", "at").unionByName(many.select(*lone.drop("part", "at").columns))


def mix(docs: DataFrame, text: str = "text", sources: Column | None = None, weights: Callable[[int], float] | None = None, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, members, size, source_size and target (of the pattern's first source) and taken.

    sources: array column of memberships (default: the column source). weights: weight of the i-th source by
    code point (default 5, 2, 1, repeating).
    """
    spark, weigh = docs.sparkSession, weights or (lambda i: WEIGHTS[i % len(WEIGHTS)])
    rows = cut(sized(docs, text, sources).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    rows = cut(numbered(rows).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "nth"), 1)))
    patterns = rows.groupBy("key").agg(F.first("members").alias("members"), F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ValueError("too many membership patterns for the flow on the driver; use coarser sources")
    patterns.sort(key=lambda r: r["key"])
    total_of: dict[str | None, int] = {}
    for r in patterns:
        for x in r["members"]:
            total_of[x] = total_of.get(x, 0) + r["size"]
    names = sorted(total_of, key=lambda x: (x is None, x or ""))
    number = {x: i for i, x in enumerate(names)}
    sizes = [total_of[x] for x in names]
    goal = targets(sizes, [weigh(i) for i in range(len(names))], share * sum(r["size"] for r in patterns), repeats)
    flow = min_cost_flow([r["size"] for r in patterns], [[number[x] for x in r["members"]] for r in patterns], [round(g) for g in goal], repeats)
    of = lambda r, values: values[number[r["members"][0]]] if r["members"] else 0
    plan = [(r["key"], of(r, sizes), float(of(r, goal)), f // max(r["size"], 1), f % max(r["size"], 1)) for r, f in zip(patterns, flow, strict=True)]
    quota = F.broadcast(spark.createDataFrame(plan, "qkey string, source_size long, target double, passes long, rest long"))  # at most MAX_PATTERNS rows
    rows = rows.join(quota, F.col("key") == F.col("qkey")).drop("qkey")

    shift = 63 - RANGES_BITS
    rows = rows.withColumn("range", F.shiftrightunsigned("h", shift).cast("int"))
    sums = rows.groupBy("key", "range", "rest").agg(F.sum("size").alias("in_range"))
    upto = F.sum("in_range").over(Window.partitionBy("key").orderBy("range"))  # 2^RANGES_BITS rows a pattern
    last = sums.withColumn("upto", upto).where("upto > rest").groupBy("key").agg(F.min(F.struct("range", (F.col("upto") - F.col("in_range")).alias("before"))).alias("x"))
    last = cut(last.select(F.col("key").alias("lkey"), F.col("x.range").alias("last"), F.col("x.before").alias("before")))
    rows = rows.join(F.broadcast(last), F.col("key") == F.col("lkey"), "left").drop("lkey")

    own = F.struct("h", "doc_id", "size", "nth")  # unlike for any two rows of a pattern
    edge = rows.where("range = last").withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("key", "range").orderBy("h", "doc_id", "size", "nth").rowsBetween(Window.unboundedPreceding, 0)))
    stop = edge.where("upto <= rest").groupBy("key").agg(F.max("upto").alias("sum"), F.max(own).alias("z"))
    stop = cut(last.join(stop, F.col("lkey") == F.col("key"), "left").select(F.col("lkey").alias("skey"), F.coalesce("sum", "before").alias("sum"), "z"))
    rows = rows.join(F.broadcast(stop), F.col("key") == F.col("skey"), "left").drop("skey")
    rows = rows.withColumn("chosen", F.coalesce((F.col("range") < F.col("last")) | ((F.col("range") == F.col("last")) & (own <= F.col("z"))), F.lit(False)))

    # the gap: for each size that fits, the first document by hash; the largest that fit are taken in turn
    gap = F.col("rest") - F.coalesce("sum", F.lit(0))
    fits = rows.where(~F.col("chosen") & (F.col("size") > 0)).withColumn("gap", gap).where("size <= gap")
    fits = fits.groupBy("key", "size", "gap").agg(F.min(own).alias("x"))

    def fill(t: pd.DataFrame) -> pd.DataFrame:
        left, got = int(t["gap"].iloc[0]), []
        for r in t.sort_values("size", ascending=False).itertuples():
            if r.size_ <= left:
                left -= r.size_
                got.append((r.key, r.size_))
        return pd.DataFrame(got, columns=["gkey", "gsize"])

    fits = cut(fits)
    got = fits.select("key", F.col("size").alias("size_"), F.col("size").alias("size"), "gap").groupBy("key").applyInPandas(fill, "gkey string, gsize long")
    picks = cut(fits.join(got, (F.col("key") == F.col("gkey")) & (F.col("size") == F.col("gsize"))).select(F.col("key").alias("fkey"), F.col("x").alias("fx"), F.col("x.h").alias("fh")))
    small = picks.count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(picks) if small else picks, (F.col("key") == F.col("fkey")) & (F.col("h") == F.col("fh")) & own.eqNullSafe(F.col("fx")), "left")
    taken = F.col("size") * (F.col("passes") + (F.col("chosen") | F.col("fh").isNotNull()).cast("long"))
    return rows.select("doc_id", "members", "size", "source_size", "target", taken.alias("taken"))
