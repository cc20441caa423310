"""Order-dependent columns over whole tables or large groups: range partitions instead of one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Written


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with _part, the number of the range that they fall into; written, so that all readers see the same ranges."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges").df


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Global ranks from 1: range partitions, counted, then ranked apart."""
    cut = in_ranges(df, order)
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return cut.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(name, (F.col("_within") + F.col("_before")).cast("bigint")).drop("_part", "_within", "_before")


def ranked_within(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Ranks from 1 within each group, and _n, the group's size; a group may be as large as the table."""
    cut = Written(ranked(df, [*map(F.col, groups), *order], "_at"), "ranked")
    per = cut.df.groupBy(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups))).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).hint("rebalance")  # so that the join can split a large group
    joined = cut.df.join(per, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)])
    return joined.select(*df.columns, (F.col("_at") - F.col("_first") + 1).alias(name), "_n")


def accumulated(df: DataFrame, group: str, order: list[Column], how, columns: list[str], names: list[str]) -> DataFrame:
    """Running sums, maxima ... (how) of the columns within each group in the given order, however large the group is.

    Rows of equal order count each for itself, in no stated order; aggregate first where that matters.
    """
    cut = in_ranges(df, [F.col(group), *order])
    own = cut.groupBy("_part", group).agg(*(how(c).alias(f"_own_{c}") for c in columns))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the group
    carried = own.select("_part", group, *(how(f"_own_{c}").over(earlier).alias(f"_carry_{c}") for c in columns))
    running = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumns({f"_in_{c}": how(c).over(running) for c in columns})
    both = inside.join(carried, ["_part", group])

    def total(c: str) -> Column:
        a, b = F.col(f"_in_{c}"), F.col(f"_carry_{c}")
        return F.greatest(a, b) if how is F.max else F.least(a, b) if how is F.min else a + F.coalesce(b, F.lit(0))

    return both.select(*df.columns, *(total(c).alias(n) for c, n in zip(columns, names, strict=True)))
