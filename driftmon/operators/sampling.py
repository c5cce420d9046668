"""Deterministic per-class sampling and stratified splits.

Rows are ordered inside each group by ``md5(id ':' seed)`` (ties by id, then by
a hash of the whole row), so a sample depends only on the data and the seed,
never on partitioning, and an SQL engine with ``md5`` reproduces it.  Rows
without an id are ordered by the hash of their content.

Selecting "the first ``q`` rows of each group in that order" must not rank a
whole group in one task (one class may hold a third of all rows).  The hash
is uniform, so the ``q``-th smallest value sits near the fraction ``q/N``.
``select_first`` therefore writes the rows with their hash once, and from there:

1. counts each group (partial aggregate),
2. puts a narrow bracket ``[lo, hi)`` of hash fractions around ``q/N``
   (6 standard deviations plus a margin),
3. counts the rows below and inside the bracket and checks that the ``q``-th
   row falls inside; a group failing the check (many rows that repeat an id;
   else about once in 1e9) gets a full bracket, so the result is always exact,
4. ranks only the bracket rows (about ``12 sqrt(q)`` per group) in a window;
   if a group got a full bracket, by one range sort over all tasks instead.

Rows below the bracket are selected, rows above it are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmon.operators.joins import join_small
from driftmon.operators.quantiles import rank_rows
from driftmon.sources.scratch import written

_SCALE = float(1 << 60)  # 15 hex digits of the md5


def _content_hash(df: DataFrame) -> Column:
    """A hash of the whole row (maps have no hash and are left out)."""
    columns = [F.col(f"`{f.name}`") for f in df.schema if not f.dataType.simpleString().startswith("map<")]
    return F.xxhash64(*columns)


def hash_order(df: DataFrame, id_col: str | None, seed: int) -> tuple[Column, Column]:
    """(md5 text, its first 60 bits as a fraction in [0, 1)) of ``id ':' seed``.

    A row without an id, or any row where ``id_col`` is None, is placed by its content.
    """
    name = _content_hash(df).cast("string")
    if id_col:
        name = F.coalesce(F.col(id_col).cast("string"), name)
    h = F.md5(F.concat(name, F.lit(f":{seed}")))
    u = F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint").cast("double") / F.lit(_SCALE)
    return h, u


def select_first(df: DataFrame, groups, quotas, id_col: str | None, seed: int = 42,
                 flag: str = "_selected") -> DataFrame:
    """Add boolean ``flag``: row is among the first ``quota`` of its group in hash order.

    ``quotas`` holds one row per group with columns ``groups`` + ``quota``
    (groups missing from it select nothing), or is a function that makes it
    from the class sizes (``groups`` + ``n_class``).  A null class is a class of its own.
    The rows are written once, so what ``df`` takes to compute is done once.
    """
    groups = list(groups)
    h, u = hash_order(df, id_col, seed)
    # rows that repeat an id are told apart by their content, so only equal rows tie
    placed = df.withColumns({"_h": h, "_u": u, "_content": _content_hash(df)})
    base = written(placed, "sample-rows")  # the counts below scan only the columns they need
    sizes = written(base.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")), "sample-sizes")
    if callable(quotas):
        quotas = quotas(sizes.withColumnRenamed("_n", "n_class"))
    q = F.least(F.col("quota").cast("double"), F.col("_n").cast("double"))
    p = q / F.col("_n")
    spread = (F.lit(6.0) * F.sqrt(F.col("_n") * p * (F.lit(1.0) - p)) + F.lit(24.0)) / F.col("_n")
    nothing, everything = q <= 0, q >= F.col("_n")
    bounds = (
        join_small(sizes, quotas.select(*groups, "quota"), groups, "left")
        .withColumn("quota", F.coalesce(F.col("quota").cast("bigint"), F.lit(0)))
        .withColumn("_lo", F.when(nothing, -1.0).when(everything, 2.0).otherwise(F.greatest(F.lit(0.0), p - spread)))
        .withColumn("_hi", F.when(nothing, -1.0).when(everything, 2.0).otherwise(F.least(F.lit(2.0), p + spread)))
    )
    tagged = join_small(base, bounds.select(*groups, "quota", "_lo", "_hi"), groups, "inner")
    zone_counts = tagged.groupBy(*groups).agg(
        F.count_if(F.col("_u") < F.col("_lo")).alias("_below"),
        F.count_if((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).alias("_inside"),
    )
    checked = (
        join_small(bounds, zone_counts, groups, "left")
        .withColumn("_ok", (F.col("_below") <= F.col("quota"))
                    & (F.col("_below") + F.col("_inside") >= F.least(F.col("quota"), F.col("_n"))))
        .select(*groups, "quota",
                F.when(F.col("_ok"), F.col("_lo")).otherwise(F.lit(0.0)).alias("_lo"),
                F.when(F.col("_ok"), F.col("_hi")).otherwise(F.lit(2.0)).alias("_hi"),
                F.when(F.col("_ok"), F.col("_below")).otherwise(F.lit(0)).alias("_below"), "_ok")
    )
    checked = written(checked, "sample-bounds")  # one row a group; the plan below starts from files
    missed = checked.where(~F.col("_ok")).limit(1).count() > 0
    checked = checked.drop("_ok")
    final = join_small(base, checked, groups, "inner")
    inside = (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))
    outside = final.where(~inside).withColumn(flag, F.col("_u") < F.col("_lo"))
    order = ["_h", *([id_col] if id_col else []), "_content"]
    inner = final.where(inside)
    if missed:
        inner = rank_rows(inner, groups, order, "_rank")
    else:
        inner = inner.withColumn("_rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    bracket = inner.withColumn(flag, F.col("_below") + F.col("_rank") <= F.col("quota"))
    cols = [*df.columns, flag]
    return outside.select(*cols).unionByName(bracket.select(*cols))


def _keyed(df: DataFrame, keys):
    """Give key-less calls a constant key so every plan below is keyed."""
    keys = list(keys)
    if keys:
        return df, keys, lambda out: out
    return df.withColumn("_key", F.lit(0)), ["_key"], lambda out: out.drop("_key")


def sample_per_class(df: DataFrame, label_col: str = "label", id_col: str | None = "id", n: int = 50,
                     seed: int = 42, keys=()) -> DataFrame:
    """Each class cut to ``min(its size, n)`` rows ("random" strategy)."""
    df, keys, done = _keyed(df, keys)

    def quotas(sizes):
        return sizes.withColumn("quota", F.least(F.col("n_class"), F.lit(n)))

    return done(select_first(df, [*keys, label_col], quotas, id_col, seed).where("_selected").drop("_selected"))


def sample_balanced(df: DataFrame, label_col: str = "label", id_col: str | None = "id", n: int = 50,
                    seed: int = 42, keys=()) -> DataFrame:
    """Every class cut to ``min(smallest class, n)`` rows."""
    df, keys, done = _keyed(df, keys)
    smallest = F.min("n_class").over(Window.partitionBy(*keys))

    def quotas(sizes):
        return sizes.withColumn("quota", F.least(smallest, F.lit(n)))

    return done(select_first(df, [*keys, label_col], quotas, id_col, seed).where("_selected").drop("_selected"))


def largest_remainder_quotas(sizes: DataFrame, keys, label_col: str, total: Column) -> DataFrame:
    """Split ``total`` rows of each key over its classes in proportion to class size.

    ``floor(total * n_c / N)`` each, then one more for the classes with the
    largest remainders (ties by class name) until the total is reached.
    Works on the class-size table (keys x classes rows).
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    t = sizes.withColumn("_N", F.sum("n_class").over(w)).withColumn("_k", F.count(F.lit(1)).over(w))
    t = t.withColumn("_total", total.cast("bigint"))
    t = t.withColumn("_base", F.expr("(_total * n_class) div _N").cast("bigint"))
    t = t.withColumn("_rem", F.col("_total") * F.col("n_class") - F.col("_base") * F.col("_N"))
    t = t.withColumn("_deficit", F.col("_total") - F.sum("_base").over(w))
    order = Window.partitionBy(*keys).orderBy(F.col("_rem").desc(), F.col(label_col))
    t = t.withColumn("_r", F.row_number().over(order))
    return t.withColumn("quota", F.col("_base") + F.when(F.col("_r") <= F.col("_deficit"), 1).otherwise(0))


def sample_stratified(df: DataFrame, label_col: str = "label", id_col: str | None = "id", n: int = 50,
                      seed: int = 42, keys=()) -> DataFrame:
    """``n x classes`` rows in total (at most all rows), keeping class shares."""
    df, keys, done = _keyed(df, keys)
    w = Window.partitionBy(*keys)
    total = F.least(F.sum("n_class").over(w), F.count(F.lit(1)).over(w) * F.lit(n))

    def quotas(sizes):
        return largest_remainder_quotas(sizes, keys, label_col, total)

    return done(select_first(df, [*keys, label_col], quotas, id_col, seed).where("_selected").drop("_selected"))


def train_validation_split(df: DataFrame, label_col: str = "label", id_col: str | None = "id",
                           split_size: float = 0.3, seed: int = 42, keys=()) -> DataFrame:
    """Add ``split`` = ``validation`` for ``ceil(split_size x N)`` rows per key, by class share."""
    df, keys, done = _keyed(df, keys)
    w = Window.partitionBy(*keys)
    total = F.ceil(F.lit(float(split_size)) * F.sum("n_class").over(w))

    def quotas(sizes):
        return largest_remainder_quotas(sizes, keys, label_col, total)

    flagged = select_first(df, [*keys, label_col], quotas, id_col, seed, flag="_val")
    return done(flagged.withColumn("split", F.when(F.col("_val"), "validation").otherwise("train")).drop("_val"))


def sample_training_data(df: DataFrame, strategy: str = "balanced", **kw) -> DataFrame:
    """Dispatch by strategy name; an unknown strategy is an error."""
    fns = {"random": sample_per_class, "balanced": sample_balanced, "stratified": sample_stratified}
    if strategy not in fns:
        raise ValueError(f"no sampling called {strategy!r}; known: {', '.join(fns)}")
    return fns[strategy](df, **kw)
