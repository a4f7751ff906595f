"""Row numbers, sessions and stretches of activity in groups of any size, without one task per group.

A window over a group puts all its rows in one task. Here rows are numbered inside (group, bucket), where a bucket is
a bounded slice of the order; the buckets' sizes, one row each, are summed up per group and added as offsets. The
numbers are exactly those of row_number over the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def row_numbers(df: DataFrame, group: list[str], order: list[str], bucket: Column, out: str = "rn") -> DataFrame:
    """Adds `out`, 1-based, over `group` ordered by `order`. `bucket` must rise with the order: rows of a smaller
    bucket come first."""
    g = [f"__g{i}" for i in range(len(group))]
    # null group keys number among themselves
    keyed = df.withColumns({k: F.struct(F.col(c)) for k, c in zip(g, group)} | {"__bucket": bucket})
    sizes = keyed.groupBy(*g, "__bucket").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*g).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*g, F.col("__bucket").alias("__b2"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(W.partitionBy(*g, "__bucket").orderBy(*order))
    numbered = keyed.withColumn("__inside", inside)
    match = [numbered[k] == offsets[k] for k in g] + [numbered["__bucket"].eqNullSafe(offsets["__b2"])]
    joined = numbered.join(offsets.select(*[F.col(k) for k in g], "__b2", "__offset"), match)
    return joined.select(*[numbered[c] for c in df.columns], (F.col("__inside") + F.col("__offset")).alias(out))


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int, tie: str, bucket_seconds: int = 3600, out: str = "session") -> DataFrame:
    """Adds `out`: the number of the session of each key; a session ends where nothing follows within the gap.

    Gaps inside an hour come from a window over (key, hour); the first row of an hour takes the last time of the
    key's previous hour with rows, from a table with one row for each key and hour. Rows without a time are sessions of
    their own."""
    at = F.unix_micros(F.col(ts))
    base = df.withColumn("__hour", F.coalesce(F.floor(at / (bucket_seconds * 1_000_000)), F.lit(-(1 << 60)))).withColumn("__k", F.struct(F.col(key)))
    hours = base.groupBy("__k", "__hour").agg(F.max(ts).alias("__last"))
    by_hour = W.partitionBy("__k").orderBy("__hour")
    hours = hours.select("__k", "__hour", F.lag("__last").over(by_hour).alias("__before"))
    inside = W.partitionBy("__k", "__hour").orderBy(ts, tie)
    rows = base.join(hours, ["__k", "__hour"]).withColumn("__prev", F.coalesce(F.lag(ts).over(inside), F.col("__before")))
    opens = (F.col("__prev").isNull() | F.col(ts).isNull() | (F.unix_micros(F.col(ts)) - F.unix_micros("__prev") >= gap_seconds * 1_000_000)).cast("int")
    rows = rows.withColumn("__open", opens)
    counts = rows.groupBy("__k", "__hour").agg(F.sum("__open").alias("__opened"))
    counts = counts.select("__k", "__hour", F.coalesce(F.sum("__opened").over(by_hour.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    local = F.sum("__open").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("__local", local).join(counts, ["__k", "__hour"]).select(*df.columns, (F.col("__local") + F.col("__offset")).alias(out))


def stretches(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, bucket, stretch): time is cut into buckets of the gap's length; neighbouring buckets with rows of a key are
    one stretch. Between two stretches lies an empty bucket, so more than the gap. Rows without a time share a bucket.

    Coarser than `sessions`, but one aggregation and a window over one row per key and bucket are all it takes, and
    any superset of the rows will do."""
    buckets = df.select(F.col(key).alias(key), bucket_of(F.col(ts), gap_seconds).alias("bucket")).distinct()
    place = F.row_number().over(W.partitionBy(key).orderBy("bucket"))
    return buckets.select(key, "bucket", (F.col("bucket") - place).alias("stretch"))


def bucket_of(ts: Column, seconds: int) -> Column:
    return F.coalesce(F.floor(F.unix_micros(ts) / (seconds * 1_000_000)), F.lit(-(1 << 60)))
