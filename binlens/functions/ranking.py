"""Positions within groups without a one-task window.

``row_number() over (partition by label order by k)`` sends a whole class to one task; with two
classes that is half of the data in one sort. ``group_position`` computes the same number with
a range-partitioned sort: rows are spread over many partitions by (group, order key), each task
numbers its own rows, and a small per-(partition, group) count table supplies the offsets.
The count table has at most (partitions + groups) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binlens.session import cut_lineage


def group_position(df: DataFrame, group_cols: list[str], order_cols: list, name: str = "pos",
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row inside its group, ordered by ``order_cols``.

    ``order_cols`` must make the order total (end with a unique key) so a recomputed partition
    numbers its rows identically after an executor loss.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    groups = [F.col(c) for c in group_cols]
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = (df.repartitionByRange(n, *groups, *order)
             .sortWithinPartitions(*groups, *order)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_mid", F.monotonically_increasing_id()))
    # The two branches below (counts and numbering) must see the same range bounds, but each range
    # exchange samples its own. A reliable checkpoint fixes one partitioning for both, for good.
    keyed = cut_lineage(keyed)
    stats = keyed.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    out = (keyed.join(stats.select("_pid", *group_cols, "_first", "_off"), ["_pid", *group_cols])
           .withColumn(name, F.col("_mid") - F.col("_first") + F.col("_off") + 1)
           .drop("_pid", "_mid", "_first", "_off"))
    return out


def running_sums(df: DataFrame, group_cols: list[str], order_cols: list, sum_cols: list[str], prefix: str = "cum_",
                 num_partitions: int | None = None) -> DataFrame:
    """Add ``<prefix><c>`` = sum of ``c`` over the rows of the same group up to and including
    this row in ``order_cols`` order (which must be total within a group).

    Same plan as ``group_position``: a range-partitioned sort spreads every group over many
    tasks; each task sums its own rows (a window over (partition, group), so no window holds
    more than one partition's share), and a per-(partition, group) total table - at most
    partitions x groups rows - supplies the offsets. No global window over the rows.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    groups = [F.col(c) for c in group_cols]
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.repartitionByRange(n, *groups, *order).withColumn("_pid", F.spark_partition_id())
    keyed = cut_lineage(keyed)      # one partitioning for both branches
    inner = Window.partitionBy("_pid", *group_cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.select("*", *[F.sum(c).over(inner).alias(f"_l_{c}") for c in sum_cols])
    tot = keyed.groupBy("_pid", *group_cols).agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_pid", *group_cols, *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                                            for c in sum_cols])
    out = local.join(off, ["_pid", *group_cols])
    return out.select(*df.columns, *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"{prefix}{c}") for c in sum_cols])


def md5_key(id_col: str) -> Column:
    """Engine-independent pseudo-random order key: md5 of the id's text form."""
    return F.md5(F.col(id_col).cast("string"))


def stratified_folds(df: DataFrame, id_col: str, label_col: str, k: int, name: str = "fold") -> DataFrame:
    """fold = (position within class by md5(id) - 1) % k; class counts per fold differ by <= 1."""
    pos = group_position(df.withColumn("_h", md5_key(id_col)), [label_col], ["_h", id_col], name="_pos")
    return pos.withColumn(name, ((F.col("_pos") - 1) % k).cast("int")).drop("_h", "_pos")


def stratified_holdout(df: DataFrame, id_col: str, label_col: str, test_every: int = 5,
                       name: str = "split") -> DataFrame:
    """Deterministic per-class split: every ``test_every``-th row by md5(id) goes to ``test``."""
    f = stratified_folds(df, id_col, label_col, test_every, name="_f")
    return f.withColumn(name, F.when(F.col("_f") == 0, F.lit("test")).otherwise(F.lit("train"))).drop("_f")
