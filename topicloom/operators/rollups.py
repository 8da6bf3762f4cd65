"""Report tables over labelled rows: counts over time, group by label shares, leading labels, stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators.coreset import uniform
from topicloom.operators.topics import few

#: Longest spans (days) that are still shown by day and by week.
BY_DAY, BY_WEEK = 31, 365
#: Labels that a share table can hold as columns.
MAX_COLUMNS = 1_000


def time_unit(rows: DataFrame, when: str) -> str:
    """day, week or month, by the whole days between the first and the last time (no times: day)."""
    r = rows.agg(F.min(when).alias("a"), F.max(when).alias("b")).first()
    span = (r["b"] - r["a"]).days if r["a"] is not None else 0
    return "day" if span <= BY_DAY else "week" if span <= BY_WEEK else "month"


def leading(rows: DataFrame, label: str, most: int) -> DataFrame:
    """The ``most`` commonest labels (ties by label), as the column ``top``; null labels do not lead."""
    n = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), label).limit(most).select(F.col(label).alias("top"))


def over_time(rows: DataFrame, when: str, label: str, most: int = 10, unit: str | None = None) -> DataFrame:
    """start, label, n: rows for each time bucket and label; labels beyond the commonest ``most`` count as Other.

    The unit follows the span unless it is given. A week is named by the Sunday that ends it. Rows without a time
    are left out; rows without a label count as Other.
    """
    unit = unit or time_unit(rows, when)
    start = F.date_trunc(unit, F.col(when))
    if unit == "week":
        start = start + F.expr("INTERVAL 6 DAYS")
    top = leading(rows, label, most)
    j = rows.where(F.col(when).isNotNull()).select(start.alias("start"), F.col(label).alias("label"))
    j = j.groupBy("start", "label").agg(F.count(F.lit(1)).alias("n")).join(few(top, most), F.col("label") == F.col("top"), "left")
    return j.groupBy("start", F.coalesce("top", F.lit("Other")).alias("label")).agg(F.sum("n").alias("n"))


def share_table(rows: DataFrame, group: str, label: str) -> DataFrame:
    """group, total, and for each label (commonest first) n_<label> and share_<label> of the group's rows.

    A label that a group lacks has 0. Rows without a label count in total alone. More than ``MAX_COLUMNS`` labels
    are refused, as they would be columns.
    """
    n = rows.groupBy(F.col(group).alias("group"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    found = n.where("label is not null").groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(MAX_COLUMNS + 1).collect()
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} labels")
    cells = [(str(r["label"]), F.coalesce(F.sum(F.when(F.col("label") == r["label"], F.col("n"))), F.lit(0))) for r in found]
    wide = n.groupBy("group").agg(F.sum("n").alias("total"), *(c.alias(f"n_{x}") for x, c in cells))
    at = [(x, wide[f"`n_{x.replace('`', '``')}`"]) for x, _ in cells]
    return wide.select("group", "total", *(c for _, c in at), *((c / F.col("total")).alias(f"share_{x}") for x, c in at))


def leading_in_group(rows: DataFrame, group: str, label: str, n: int = 3, sep: str = "; ") -> DataFrame:
    """group, leaders: the n commonest labels of each group with their counts, as "a (5); b (3)" (ties by label)."""
    c = rows.where(F.col(label).isNotNull()).groupBy(F.col(group).alias("group"), F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "label"))).where(F.col("r") <= n)
    text = F.transform(F.array_sort(F.collect_list(F.struct("r", "label", "n"))), lambda x: F.format_string("%s (%d)", x["label"], x["n"]))
    return c.groupBy("group").agg(F.array_join(text, sep).alias("leaders"))


def quotas(sizes: dict, n: int) -> dict:
    """n shared among strata in proportion to size: whole parts, then one each to the largest remainders (ties by key)."""
    total = sum(sizes.values())
    if n >= total:
        return dict(sizes)
    out = {k: n * v // total for k, v in sizes.items()}
    by_rest = sorted(sizes, key=lambda k: (-(n * sizes[k] % total), str(k)))
    for k in by_rest[: n - sum(out.values())]:
        out[k] += 1
    return out


def stratified_sample(rows: DataFrame, by: str, n: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """n rows with the strata in proportion; all rows if there are no more than n.

    In a stratum the rows with the smallest seeded hashes of their key are taken (ties by key). No map task sends
    more than n rows of a stratum, as the first bound is a constant; strata are counted on the driver and
    refused beyond ``MAX_COLUMNS``. Null is a stratum of its own.
    """
    found = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).limit(MAX_COLUMNS + 1).collect()
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} strata")
    quota = quotas({r[by]: r["n"] for r in found}, n)
    if not quota or n >= sum(r["n"] for r in found):
        return rows
    table = rows.sparkSession.createDataFrame(list(quota.items()), rows.select(by).schema.add("s__q", "long"))
    order = Window.partitionBy(by).orderBy(uniform(key, seed), key)
    r = rows.withColumn("s__r", F.row_number().over(order)).where(F.col("s__r") <= n)
    q = table.withColumnRenamed(by, "s__by")
    return r.join(F.broadcast(q), r[by].eqNullSafe(F.col("s__by"))).where("s__r <= s__q").select(*rows.columns)
