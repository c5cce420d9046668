"""Exact quantiles of many groups by distributed order statistics.

One range sort by (group, value) puts every group's values in order over many
partitions.  Counts by group and partition tell in which partition, and at
which place there, the two neighbours of each quantile are; only those rows
are read again.  No aggregation buffer holds a group's values.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmon.operators.joins import join_small
from driftmon.sources.scratch import written


def ordered_values(df: DataFrame, keys, value: str) -> DataFrame:
    """keys, v, at: the values in the order of (keys, v); ``at`` grows by one within a partition (a written table).

    No key may be called ``v`` or ``at``.
    """
    keys = list(keys)
    narrow = df.select(*keys, F.col(value).cast("double").alias("v"))
    ranged = narrow.repartitionByRange(*keys, "v").sortWithinPartitions(*keys, "v")
    return written(ranged.withColumn("at", F.monotonically_increasing_id()), "ordered")


def _same(a: DataFrame, b: DataFrame, keys):
    return functools.reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"_{k}"]) for k in keys), F.lit(True))


def quantiles_of(ordered: DataFrame, keys, names: dict[str, float]) -> DataFrame:
    """keys and one column for each quantile of ``names``, interpolated linearly between its two neighbours.

    ``ordered`` is a result of :func:`ordered_values`.  Null values are left
    out; a group of nulls alone has no row.
    """
    own, keys = list(keys), [f"_key{i}" for i in range(len(list(keys)))]
    ordered = ordered.select(*(F.col(k).alias(x) for k, x in zip(own, keys, strict=True)), "v", "at")
    runs = ordered.where("v is not null").groupBy(*keys, F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("k"))
    # one narrow row for each group and partition that holds some of it
    runs = written(runs, "runs")
    so_far = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(*keys)
    placed = runs.withColumn("before", F.coalesce(F.sum("k").over(so_far), F.lit(0))).withColumn("n", F.sum("k").over(all_of))
    place = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("n") - 1)).alias("h")) for name, q in names.items()))
    wanted = placed.select("*", F.explode(place).alias("q")).select("*", F.floor("q.h").alias("low"))
    wanted = wanted.select("*", F.explode(F.array(F.col("low"), F.least(F.col("low") + 1, F.col("n") - 1))).alias("rank"))
    # an upper neighbour beside the lower one counts with the fraction between them
    share = F.when(F.col("rank") == F.col("low"), 1 - (F.col("q.h") - F.col("low"))).otherwise(F.col("q.h") - F.col("low"))
    here = wanted.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("k")))
    here = here.select(*keys, F.col("q.name").alias("name"), (F.col("first") + F.col("rank") - F.col("before")).alias("at"), share.alias("share"))
    # both neighbours are one row at whole places: its shares are then 1 and 1
    here = here.groupBy(*keys, "name", "at").agg(F.least(F.lit(1.0), F.sum("share")).alias("share"))
    values = here.join(ordered.select("at", "v"), "at")
    part = F.when(F.col("share") > 0, F.col("share") * F.col("v"))
    found = values.groupBy(*keys).agg(*(F.sum(F.when(F.col("name") == name, part)).alias(name) for name in names))
    return found.select(*(F.col(x).alias(k) for k, x in zip(own, keys, strict=True)), *names)


def with_quantiles(stats: DataFrame, ordered: DataFrame, keys, names: dict[str, float]) -> DataFrame:
    """``stats`` (one row for each group) with the quantile columns; groups without values have nulls."""
    keys = list(keys)
    found = quantiles_of(ordered, keys, names)
    renamed = found.select(*(F.col(k).alias(f"_{k}") for k in keys), *names)
    return stats.join(renamed, _same(stats, renamed, keys), "left").drop(*(f"_{k}" for k in keys))


def rank_rows(df: DataFrame, keys, order, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: each row's place from 1 in its group by ``order`` (column names), without a task that holds a group.

    One range sort by (keys, order), then the counts of the groups' parts in
    earlier partitions.  Rows equal in ``order`` take places of their own.  Null
    keys are a group.  No column may be called ``_at``, ``_part``, ``_first``, ``_k`` or ``_start``.
    """
    keys, order = list(keys), list(order)
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))
    runs = written(rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_k")), "runs")
    so_far = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_k").over(so_far), F.lit(0)) - F.col("_first") + 1
    placed = join_small(rows, runs.select(*keys, "_part", start.alias("_start")), [*keys, "_part"])
    return placed.withColumn(name, F.col("_at") + F.col("_start")).drop("_at", "_part", "_start")


def ranked_values(ordered: DataFrame, keys) -> DataFrame:
    """keys, v, i, n, mean, m2: every value with its place from 1, and its group's size, mean and squared deviations.

    ``ordered`` is a result of :func:`ordered_values`; null and NaN values are
    left out.  Places come from counts by group and partition (one narrow row
    each), so no group's rows meet in one task.  No key may be called like one
    of the new columns.
    """
    keys = list(keys)
    values = ordered.where("v is not null and not isnan(v)").withColumn("_part", F.shiftright("at", 33))
    runs = written(values.groupBy(*keys, "_part").agg(F.min("at").alias("_first"), F.count("*").alias("_k"), F.avg("v").alias("_part_mean"),
                                                     F.var_pop("v").alias("_part_var")), "runs")
    so_far = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(*keys)
    runs = runs.withColumns({"_before": F.coalesce(F.sum("_k").over(so_far), F.lit(0)), "n": F.sum("_k").over(all_of)})
    runs = runs.withColumn("mean", F.sum(F.col("_k") * F.col("_part_mean")).over(all_of) / F.col("n"))
    spread = F.col("_k") * (F.col("_part_var") + F.pow(F.col("_part_mean") - F.col("mean"), 2))
    runs = runs.withColumn("m2", F.sum(spread).over(all_of)).drop("_k", "_part_mean", "_part_var")
    placed = join_small(values, runs, [*keys, "_part"])
    return placed.select(*keys, "v", (F.col("at") - F.col("_first") + F.col("_before") + 1).alias("i"), "n", "mean", "m2")
