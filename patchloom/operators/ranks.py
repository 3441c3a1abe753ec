"""Ranks, random rows and quantiles over all tasks: counts by bucket first, so that no window, sort or state takes a whole group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchloom.session import scratch_dir

#: Leading digits of a digest that name a bucket: 65,536 of them.
DIGITS = 4
#: Of the sketch that brackets quantiles.
ACCURACY = 10_000
#: Values of a bracket that are few enough to be sorted by themselves.
FEW = 10_000


def ranked(df: DataFrame, by: list[str], digest: Column, ties: list[str], weight: Column | None = None) -> DataFrame:
    """df with r_ (rank from 1 within by, in order of digest and ties), n_ (rows of by) and before_ (weight of the rows before).

    digest is a random hexadecimal string. A window holds the rows of one bucket of a group, or a group's buckets. Nulls
    in by are a group of their own.
    """
    weight = F.lit(1) if weight is None else weight
    placed = df.withColumns({"digest_": digest, "weight_": weight}).withColumn("bucket_", F.substring("digest_", 1, DIGITS))
    sums = placed.groupBy(*by, "bucket_").agg(F.count("*").alias("rows_"), F.sum("weight_").alias("sum_"))
    group = Window.partitionBy(*by)
    above = group.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        *[F.col(c).alias(f"{c}_of") for c in by], F.col("bucket_").alias("its_"), F.sum("rows_").over(group).alias("n_"),
        F.coalesce(F.sum("rows_").over(above), F.lit(0)).alias("base_rows_"), F.coalesce(F.sum("sum_").over(above), F.lit(0)).alias("base_sum_"),
    )
    own = Window.partitionBy(*by, "bucket_").orderBy("digest_", *ties)
    rows = placed.withColumns({"r_": F.row_number().over(own), "before_": F.coalesce(F.sum("weight_").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    same = F.col("bucket_") == F.col("its_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    found = rows.join(bases, same)
    return found.withColumns({"r_": F.col("r_") + F.col("base_rows_"), "before_": F.col("before_") + F.col("base_sum_")}).select(*df.columns, "r_", "n_", "before_")


def least_rows(df: DataFrame, n: int, digest: Column, ties: list[str], last: bool = False) -> DataFrame:
    """n rows of the least (or last) digest, equal ones in order of ties: whole buckets, and a sorted limit within one bucket."""
    bucket = F.substring(digest, 1, DIGITS)
    counts = sorted(((r.b, r.n) for r in df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=last)
    if n <= 0:
        return df.limit(0)
    for name, size in counts:
        if n <= size:
            order = [c.desc() if last else c for c in (digest, *map(F.col, ties))]
            return df.filter(bucket > name if last else bucket < name).unionByName(df.filter(bucket == name).orderBy(*order).limit(n))
        n -= size
    return df


def running(df: DataFrame, by: list[str], order: list[str | Column], values: dict[str, Column]) -> DataFrame:
    """df with a column for each of values: its sum over the rows before, in order within by, and 0 for the first row.

    For any order, ranked() being for random digests alone. Rows are dealt out by ranges of by and order and written, so that
    both passes see the same ranges: sums within a range, and below them the sums of the group's earlier ranges. A range
    has at most one group that began before it, so these bases are no more than the ranges, and no window takes a whole
    group. Rows equal in by and order share a range. Nulls in by are a group of their own.
    """
    names = [f"value{i}_" for i in range(len(values))]
    dealt = df.withColumns(dict(zip(names, values.values(), strict=True))).repartitionByRange(*by, *order)
    path = scratch_dir(df.sparkSession, "ranges")
    dealt.withColumn("range_", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)

    group = Window.partitionBy(*by)
    above = group.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "range_").agg(*[F.sum(c).alias(c) for c in names])
    bases = sums.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("range_").alias("its_"), *[F.sum(c).over(above).alias(f"base_{c}") for c in names], F.row_number().over(group.orderBy("range_")).alias("nth_"))
    own = Window.partitionBy(*by, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("range_") == F.col("its_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    summed = rows.withColumns({c: F.coalesce(F.sum(c).over(own), F.lit(0)) for c in names}).join(F.broadcast(bases.filter("nth_ > 1")), same, "left")
    return summed.select(*df.columns, *[(F.col(c) + F.coalesce(f"base_{c}", F.lit(0))).alias(name) for name, c in zip(values, names, strict=True)])


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact interpolated quantiles of a column's values that are neither null nor NaN; infinities count as values.

    A sketch brackets all wanted ranks at once, and one more pass counts what lies below and within each bracket, until a
    bracket has one value or few enough to be sorted: two passes for some thousandth part of the rows each.
    """
    value = F.col(column).cast("double")
    rows = df.filter(value.isNotNull() & ~F.isnan(value)).select(value.alias("v"))
    n = rows.count()
    if not n:
        return [None for _ in shares]
    position = {share: share * (n - 1) for share in shares}
    wanted = sorted({f(p) for p in position.values() for f in (math.floor, math.ceil)})
    inside = lambda low, high: F.col("v").between(F.lit(low), F.lit(high))
    brackets = {rank: (-math.inf, math.inf, 0, n) for rank in wanted}  # ends, rows below, rows within
    margin, accuracy = 4.0, ACCURACY
    while open_ := [r for r, (low, high, _, m) in brackets.items() if low < high and m > FEW]:
        asked = []
        for rank in open_:
            low, high, below, m = brackets[rank]
            place, room = (rank - below + 0.5) / m, margin / accuracy
            asked.append(F.percentile_approx(F.when(inside(low, high), F.col("v")), [max(0.0, place - room), min(1.0, place + room)], accuracy))
        ends = rows.agg(*[a.alias(f"q{i}") for i, a in enumerate(asked)]).first()
        counted = rows.agg(*[F.count_if(F.col("v") < e[0]) for e in ends], *[F.count_if(inside(e[0], e[1])) for e in ends]).first()
        for i, rank in enumerate(open_):
            below, m = counted[i], counted[len(open_) + i]
            if not below <= rank < below + m:
                margin *= 2  # the sketch was further off than it should be
            elif m < brackets[rank][3]:
                brackets[rank] = (*ends[i], below, m)
            elif ends[i][0] < ends[i][1]:
                accuracy *= 4
            else:
                brackets[rank] = (*ends[i], below, m)
    left = [r for r, (low, high, _, _) in brackets.items() if low < high]
    held = rows.agg(*[F.sort_array(F.collect_list(F.when(inside(*brackets[r][:2]), F.col("v")))).alias(f"q{i}") for i, r in enumerate(left)]).first() if left else []
    at = {r: held[left.index(r)][r - below] if r in left else low for r, (low, _, below, _) in brackets.items()}

    out: list[float | None] = []
    for share in shares:
        p = position[share]
        lower, upper = math.floor(p), math.ceil(p)
        out.append(at[lower] if at[lower] == at[upper] else (upper - p) * at[lower] + (p - lower) * at[upper])
    return out
