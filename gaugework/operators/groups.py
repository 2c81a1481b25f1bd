"""Group operators that stay parallel when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugework.session import cut_lineage, keep_table

#: Parts that keys are counted in before single keys are.
PARTS = 1 << 14


def unnest(df: DataFrame, array: Column, name: str, *keep: Column | str, at: str | None = None) -> DataFrame:
    """One row per array element, beside the columns in ``keep``.

    The outer generator keeps the optimizer from testing the array's size first: that
    test would be pushed down and work the whole array out a second time.
    """
    made = F.posexplode_outer(array).alias(at, name) if at else F.explode_outer(array).alias(name)
    return df.select(*keep, made).filter(F.col(name).isNotNull())


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with ``columns`` worked out once before the steps that follow.

    Otherwise the optimizer puts a column's whole expression wherever a later step names it;
    a long text expression is then run many times over, in code too large to be compiled.
    """
    kept = [c for c in df.columns if c not in columns]
    made = df.select(*kept, F.explode_outer(F.array(F.struct(*columns))).alias("_settled"))
    return made.select(*[F.col("_settled")[c].alias(c) if c in columns else F.col(c) for c in df.columns])


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows of each group.

    A filter on row_number is planned as a group limit on both sides of the
    shuffle, so every task sends at most ``k`` rows of a group.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1)


def firsts_per_group(
    df: DataFrame, keys: Sequence[str], **picks: tuple[Column, Sequence[Column], Sequence[Column]]
) -> DataFrame:
    """First row of each group by several orders at once: the rows are moved once for all of them.

    A pick is a condition, ascending order columns (nulls first) and the fields to keep; it
    becomes a struct column, null where no row of the group meets the condition.  Rows equal
    in the order are told apart by their fields.  Every task sends one row of a group.
    """
    return df.groupBy(*keys).agg(*[
        F.min(F.when(condition, F.struct(*order, *fields))).alias(name)
        for name, (condition, order, fields) in picks.items()
    ])


def long_groups(df: DataFrame, key: str, most: int) -> DataFrame | None:
    """Keys with more than ``most`` rows, or None where there are none.

    Keys are counted in ``PARTS`` parts first: a part with no more rows has no such key, so
    that as a rule no key is counted by itself and next to nothing is moved.
    """
    part = F.pmod(F.hash(key), F.lit(PARTS)).alias("_part")
    many = lambda counts: counts.filter(F.col("_n") > most)
    rows = F.count(F.lit(1)).alias("_n")
    parts = [r["_part"] for r in many(df.groupBy(part).agg(rows)).select("_part").collect()]
    if not parts:
        return None
    among = df.sparkSession.createDataFrame([(p,) for p in parts], "_part int")
    keys = df.select(key, part).join(F.broadcast(among), "_part", "left_semi")
    found = keep_table(many(keys.filter(F.col(key).isNotNull()).groupBy(key).agg(rows)).select(key), "long-groups")
    return found if found.limit(1).count() else None


def newest_first(at: Column) -> Column:
    """Ascending order column that puts the newest first, nulls before all."""
    return -F.unix_micros(at.cast("timestamp"))


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Add aggregates of each row's group.

    Pre-aggregated before the shuffle and joined back, in place of a window over
    the whole group; the join is broadcast or skew-split by the runtime sizes.
    """
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(totals, list(keys), "left")


def with_rank(
    df: DataFrame, keys: Sequence[str], value: str, rank: str = "rank",
    percent: str | None = None, descending: Column | None = None,
) -> DataFrame:
    """SQL ``rank`` (and ``percent_rank``) of ``value`` in groups of any size.

    Equal values are counted first; the distinct values are range partitioned and
    frozen in a checkpoint, so that a slice keeps its number.  A rank is then the
    rows in earlier slices plus the rows before it in its own slice.
    """
    sign = F.lit(1.0) if descending is None else F.when(descending, F.lit(-1.0)).otherwise(F.lit(1.0))
    keyed = df.withColumn("_sort", F.col(value) * sign)
    counts = keyed.groupBy(*keys, "_sort").agg(F.count(F.lit(1)).alias("_n"))
    sliced = cut_lineage(
        counts.repartitionByRange(*[F.col(k) for k in keys], F.col("_sort")).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_rows"))
    over_slices = W.partitionBy(*keys).orderBy("_slice")
    offsets = per_slice.select(
        *keys, "_slice",
        (F.sum("_rows").over(over_slices) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(W.partitionBy(*keys)).alias("_total"),
    )
    inside = W.partitionBy(*keys, "_slice").orderBy("_sort")
    ranks = (
        sliced.withColumn("_inside", F.sum("_n").over(inside) - F.col("_n"))
        .join(offsets, [*keys, "_slice"])
        .select(*keys, "_sort", "_total", (F.col("_before") + F.col("_inside") + 1).alias(rank))
    )
    out = keyed.join(ranks, [*keys, "_sort"], "left")
    if percent:
        span = F.col("_total") - 1
        out = out.withColumn(
            percent, F.when(span > 0, (F.col(rank) - 1) / span).otherwise(F.lit(0.0))
        )
    return out.drop("_sort", "_total")


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: str) -> DataFrame:
    """Rows before each row of its group, for groups of any size; ``order`` tells all rows apart.

    Rows are range partitioned by group and order and frozen in a stored table, so that a
    slice keeps its number.  A position is then the rows of the group in earlier slices
    plus the rows before it in its own.  Give narrow rows: they are sorted and moved.
    Rows with a null key belong to no group and are left out.
    """
    sliced = keep_table(
        df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = F.sum("_rows").over(W.partitionBy(*keys).orderBy("_slice")) - F.col("_rows")
    offsets = per_slice.select(*keys, "_slice", earlier.alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order)) - 1
    return (
        sliced.withColumn("_inside", inside)
        .join(offsets, [*keys, "_slice"])
        .withColumn(position, F.col("_before") + F.col("_inside"))
        .drop("_slice", "_inside", "_before")
    )


def with_offsets(
    counts: DataFrame, keys: Sequence[str], order: str, n: str, offset: str, block: int = 1024
) -> DataFrame:
    """Rows before each (group, order): a two-level prefix sum over per-page counts.

    ``order`` is an integer; windows cover one block of it, then one row per block.
    """
    blocked = counts.withColumn("_block", F.floor(F.coalesce(F.col(order), F.lit(-1)) / block))
    inside = W.partitionBy(*keys, "_block").orderBy(F.col(order).asc_nulls_first())
    local = blocked.withColumn("_local", F.sum(n).over(inside) - F.col(n))
    blocks = blocked.groupBy(*keys, "_block").agg(F.sum(n).alias("_size"))
    over_blocks = W.partitionBy(*keys).orderBy("_block")
    starts = blocks.select(
        *keys, "_block", (F.sum("_size").over(over_blocks) - F.col("_size")).alias("_start")
    )
    return (
        local.join(starts, [*keys, "_block"])
        .withColumn(offset, F.col("_start") + F.col("_local"))
        .drop("_block", "_local", "_start")
    )
