"""Mutual information of continuous columns with a class, by nearest neighbours (C14).

A value's ball reaches to its k-th nearest neighbour of the same class; the fewer values of other classes lie
inside it, the more the column tells. The estimate is

    psi(N) + mean psi(k) - mean psi(class size) - mean psi(values inside the ball)

Equal values of a class are one weighted cell, so a value that a third of the rows share is one row. Cells
take positions from a range-partitioned sort and meet their neighbours in blocks of positions that overlap
by k cells; the values inside a ball are the difference of two running sums. No class and no column meets
in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binlens.functions.ranking import group_position, running_sums

#: Cells of one column and class that are compared in one window.
BLOCK = 65_536


def digamma(n: Column) -> Column:
    """Digamma of a positive number: eight steps of its recurrence, then the asymptotic series (error under 1e-11)."""
    n = n.cast("double")
    x = n + 8
    below = reduce(lambda a, b: a + b, [1.0 / (n + i) for i in range(8)])
    y = 1.0 / (x * x)
    return F.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240))) - below


def _value_cells(long_df: DataFrame, n_y: Column, classes: list, feature: str, label: str) -> DataFrame:
    """(feature, label, value, c): rows of each class at each value, implied zeros included."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    value = F.when(finite, F.col("value")).otherwise(F.raise_error(F.lit("mutual information: null or non-finite value")))
    entries = long_df.withColumn("value", F.col("value").cast("double")).select(feature, label, value.alias("value"))
    cells = entries.where("value <> 0").groupBy(feature, label, "value").agg(F.count(F.lit(1)).alias("c"))
    grid = cells.select(feature).distinct().select(feature, F.explode(F.array(*map(F.lit, classes))).alias(label))
    filled = cells.groupBy(feature, label).agg(F.sum("c").alias("c_nz"))
    zeros = (grid.join(filled, [feature, label], "left")
             .select(feature, label, F.lit(0.0).alias("value"), (n_y[F.col(label)] - F.coalesce("c_nz", F.lit(0))).alias("c"))
             .where("c > 0"))
    return cells.unionByName(zeros)


def _balls(cells: DataFrame, k: Column, most: int, feature: str, label: str, block: int) -> DataFrame:
    """Every cell with its ball: radius ``r`` (distance of the k-th neighbour in its class) and its ends ``lo`` and ``hi``."""
    block = max(block, most)        # a halo must not reach past the next block
    placed = group_position(cells, [feature, label], ["value"], name="_pos")
    at = F.col("_pos") - 1
    own, off = F.floor(at / block).cast("long"), at % block
    homes = F.filter(F.array(own, F.when(off < most, own - 1), F.when(off >= block - most, own + 1)), lambda h: h.isNotNull())
    near = placed.withColumn("_own", own).withColumn("_home", F.explode(homes))
    w = Window.partitionBy(feature, label, "_home").orderBy("_pos")
    cell = F.struct("value", "c")

    def neighbour(there: Column, up: bool) -> Column:
        gap = (there["value"] - F.col("value")) if up else (F.col("value") - there["value"])
        return F.when(there.isNotNull(), F.struct(gap.alias("d"), F.lit(up).alias("up"), there["value"].alias("b"), there["c"].alias("c")))

    mine = F.when(F.col("c") > 1, F.struct(F.lit(0.0).alias("d"), F.lit(False).alias("up"), F.col("value").alias("b"), (F.col("c") - 1).alias("c")))
    sides = [neighbour(step(cell, j).over(w), up) for j in range(1, most + 1) for step, up in ((F.lag, False), (F.lead, True))]
    found = near.withColumn("_n", F.array_sort(F.filter(F.array(mine, *sides), lambda x: x.isNotNull()))).where("_own = _home")
    reach = F.aggregate("_n", F.struct(k.cast("long").alias("left"), F.lit(0.0).alias("r")),
                        lambda s, x: F.when(s["left"] > 0, F.struct((s["left"] - x["c"]).alias("left"), x["d"].alias("r"))).otherwise(s))
    out = found.withColumn("r", reach["r"])

    def end(up: bool) -> Column:    # a neighbour that marks an end is used itself, free of rounding
        marks = F.filter("_n", lambda x: (x["up"] == up) & (x["d"] == F.col("r")))
        return F.coalesce(F.get(marks, F.lit(0))["b"], F.col("value") + F.col("r") if up else F.col("value") - F.col("r"))

    return out.select(feature, label, "value", "c", "r", end(False).alias("lo"), end(True).alias("hi"))


def mutual_information_knn(long_df: DataFrame, labels: DataFrame, neighbours: int = 3, feature: str = "feature",
                           id_col: str = "id", label: str = "label", block: int = BLOCK) -> DataFrame:
    """(feature, mi): nearest-neighbour mutual information, natural log, at least 0.

    ``long_df`` holds the non-zero cells ``(id, feature, value)``, and the label where it was carried along (then
    nothing is joined); ``labels`` one row ``(id, label)`` for every id, whose missing cells are zeros. A ball takes
    ``neighbours`` of the class, or all others of a smaller class, and holds the values strictly nearer than the last of
    them; where that one is at distance 0, all equal values (no noise is added to break ties). Rows without a label
    and classes of one row are left out; without any class left, every ``mi`` is 0. A feature without a non-zero cell
    has no row. Null, NaN and infinite values are an error. Only class sizes reach the driver.
    """
    lab = labels.select(id_col, label).where(F.col(label).isNotNull())
    sizes = {r[label]: int(r["n"]) for r in lab.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where("n > 1").collect()}
    rows = long_df if label in long_df.columns else long_df.join(lab, id_col)
    if not sizes:
        return long_df.select(feature).distinct().select(feature, F.lit(0.0).alias("mi"))
    classes, total = sorted(sizes), sum(sizes.values())
    n_y = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(sizes[c]))])
    size = n_y[F.col(label)]
    k = F.least(F.lit(neighbours), size - 1)
    cells = _value_cells(rows.where(F.col(label).isin(classes)), n_y, classes, feature, label)
    balls = _balls(cells, k, neighbours, feature, label, block)

    # kind orders a ball's ends around equal values: 0 before them (not counted), 1 the values, 2 after them (counted)
    tie = F.col("r") == 0
    ends = F.array(F.struct(F.col("hi").alias("at"), F.when(tie, 2).otherwise(0).alias("kind"), F.lit(1).alias("sign")),
                   F.struct(F.col("lo").alias("at"), F.when(tie, 0).otherwise(2).alias("kind"), F.lit(-1).alias("sign")))
    asked = balls.select(feature, label, "value", F.col("c").alias("n"), F.inline(ends)).withColumn("c", F.lit(0).cast("long"))
    there = cells.groupBy(feature, F.col("value").alias("at")).agg(F.sum("c").alias("c")).withColumn("kind", F.lit(1))
    summed = running_sums(asked.unionByName(there, allowMissingColumns=True), [feature], ["at", "kind"], ["c"])
    inside = (summed.where("kind <> 1").groupBy(feature, label, "value")
              .agg(F.max("n").alias("n"), F.sum(F.col("sign") * F.col("cum_c")).alias("m")))
    term = F.col("n") * (digamma(k) - digamma(size) - digamma(F.col("m")))
    mi = F.sum(term) / F.lit(float(total)) + digamma(F.lit(total))
    return inside.groupBy(feature).agg(F.greatest(mi, F.lit(0.0)).alias("mi"))
