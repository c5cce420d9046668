"""Cosine similarity between test windows and the training text.

Per test vector ``t`` the reference takes the mean or the max of
``cos(t, x)`` over all training vectors ``x``, then summarises per window.

* **mean**: ``mean_x cos(t, x) = u(t) . c`` with ``c`` the mean of the unit
  training vectors.  One aggregation builds ``c`` per key (partial sums, so a
  hot key is combined map-side), a size-checked broadcast ships one row per
  key, and the test side is a single narrow pass: O(N + M), no pair product.
* **max**: no such identity.  Training vectors that take at most
  ``broadcast_bytes`` are packed into blocks of alike vectors and shipped once
  to every executor; the test side is then one narrow pass that keeps a
  running maximum and skips the blocks whose centroid and radius show that
  they cannot raise it (:mod:`driftmon.operators.vector_blocks`).  Beyond that
  size training vectors are hashed into blocks of at most ``block_rows`` and
  test vectors into chunks of ``chunk_rows``; each (key, block, chunk) cell is
  one ``cogroup`` task doing a dense matrix product in NumPy, emitting one
  partial max per test vector.  Pairs are never materialised as rows, and no
  task holds more than one block and one chunk, however large a key is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmon.operators.joins import join_small
from driftmon.operators.quantiles import ordered_values, with_quantiles
from driftmon.operators.vector_blocks import max_by_blocks, training_bytes

MODES = ("mean", "max")
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
#: Training vectors are shipped to every executor only up to this many bytes.
BLOCK_BROADCAST_BYTES = 64 << 20


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def unit_vector(col) -> Column:
    """``v / |v|`` as ``array<double>``; a zero vector stays zero (its cosine is 0)."""
    v = _c(col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    # the norm is bound to a name, or every element would compute it again
    return F.get(F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(
        F.transform(v, lambda x: x * 0.0))), 0)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def train_centroid(train: DataFrame, keys=("project",), vec_col: str = "embedding") -> DataFrame:
    """Per key: mean of the unit training vectors (``centroid``) and ``n_train``."""
    keys = list(keys)
    u = train.select(*keys, array_to_vector(unit_vector(vec_col)).alias("_u"))
    agg = u.groupBy(*keys).agg(Summarizer.mean(F.col("_u")).alias("_c"), F.count(F.lit(1)).alias("n_train"))
    return agg.select(*keys, vector_to_array("_c").alias("centroid"), "n_train")


def _keyed_pair(test: DataFrame, train: DataFrame, keys):
    """Key-less calls get one constant key on both sides."""
    keys = list(keys)
    if keys:
        return test, train, keys, lambda out: out
    return test.withColumn("_key", F.lit(0)), train.withColumn("_key", F.lit(0)), ["_key"], lambda out: out.drop("_key")


def mean_similarity_per_row(test: DataFrame, train: DataFrame, keys=("project",),
                            vec_col: str = "embedding") -> DataFrame:
    """Each test row with ``sim`` = mean cosine to the key's training vectors."""
    test, train, keys, done = _keyed_pair(test, train, keys)
    cent = train_centroid(train, keys, vec_col)
    joined = join_small(test, cent.select(*keys, "centroid"), keys, "left")  # no training vectors: null, not gone
    return done(joined.withColumn("sim", dot(unit_vector(vec_col), F.col("centroid"))).drop("centroid"))


def _max_block(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    cols = list(left.columns[:-2])  # keys..., id (then chunk vectors, tag)
    if left.empty or right.empty:
        return pd.DataFrame({c: [] for c in [*cols, "block_max"]})
    a = np.stack(left["_u"].to_numpy())
    b = np.stack(right["_u"].to_numpy())
    best = np.full(a.shape[0], -np.inf)
    step = 1024
    for i in range(0, b.shape[0], step):
        best = np.maximum(best, (a @ b[i:i + step].T).max(axis=1))
    out = left[cols].copy()
    out["block_max"] = best
    return out


def max_similarity_per_row(test: DataFrame, train: DataFrame, keys=("project",), id_col: str = "vec_id",
                           train_id_col: str = "vec_id", vec_col: str = "embedding",
                           block_rows: int = 2048, chunk_rows: int = 2048,
                           broadcast_bytes: int = BLOCK_BROADCAST_BYTES) -> DataFrame:
    """Each test row with ``sim`` = max cosine to the key's training vectors (exact).

    A zero vector has cosine 0 with everything.  ``sim`` is null for a key
    without training vectors and for a null or empty vector or one with a null,
    NaN or infinite element; such training vectors count for nothing, as do
    those of another length.  The size of the training side is measured first.
    """
    test, train, keys, done = _keyed_pair(test, train, keys)
    if training_bytes(train, vec_col) <= broadcast_bytes:
        return done(max_by_blocks(test, train, keys, vec_col, min(block_rows, 512)))
    return done(_max_by_cells(test, train, keys, id_col, train_id_col, vec_col, block_rows, chunk_rows))


def _whole(vec_col: str) -> Column:
    """Neither null nor empty, and every element a finite number."""
    v = F.col(vec_col).cast("array<double>")
    return (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def _max_by_cells(test: DataFrame, train: DataFrame, keys, id_col: str, train_id_col: str, vec_col: str,
                  block_rows: int, chunk_rows: int) -> DataFrame:
    """Max cosine for a training side of any size: blocks x chunks, one cell a task."""
    # rows that repeat an id are told apart by their vector
    test = test.withColumn("_vec_hash", F.xxhash64(vec_col))
    id_cols = [id_col, "_vec_hash"]
    # fresh aliases: train and test often come from one source (self-join lineage)
    tr = train.where(_whole(vec_col)).select(*[F.col(k).alias(k) for k in keys], F.size(vec_col).alias("_dim"),
                                             F.col(train_id_col).alias("_tid"), unit_vector(vec_col).alias("_u"))
    te = test.where(_whole(vec_col)).select(*[F.col(k).alias(k) for k in [*keys, *id_cols]],
                                            F.size(vec_col).alias("_dim"), unit_vector(vec_col).alias("_u"))
    ids, keys = [*keys, *id_cols], [*keys, "_dim"]  # vectors of different lengths never meet
    n_tr = tr.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ntr"))
    n_te = te.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nte"))
    grid = join_small(n_tr, n_te, keys, "inner").select(
        *keys,
        F.greatest(F.lit(1), F.ceil(F.col("_ntr") / block_rows)).cast("int").alias("_nb"),
        F.greatest(F.lit(1), F.ceil(F.col("_nte") / chunk_rows)).cast("int").alias("_nc"),
    )
    tr_cells = (
        join_small(tr, grid, keys, "inner")
        .withColumn("_block", F.pmod(F.xxhash64("_tid", "_u"), F.col("_nb")).cast("int"))
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)))
        .select(*keys, "_block", "_chunk", "_u")
    )
    te_cells = (
        join_small(te, grid, keys, "inner")
        .withColumn("_chunk", F.pmod(F.xxhash64(*id_cols), F.col("_nc")).cast("int"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        .select(*keys, *id_cols, "_block", "_chunk", "_u")
    )
    cell = [*keys, "_block", "_chunk"]
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in te.select(*keys, *id_cols).schema)
    partial = (
        te_cells.select(*keys, *id_cols, "_u", *cell[len(keys):]).groupBy(*cell)
        .cogroup(tr_cells.groupBy(*cell))
        .applyInPandas(lambda k, l, r: _max_block(k, l[[*keys, *id_cols, "_u", "_block"]], r),
                       f"{key_schema}, block_max double")
    )
    best = partial.groupBy(*ids).agg(F.max("block_max").alias("sim"))
    fresh = best.select(*[F.col(c).alias(c if c == "sim" else f"_best_{c}") for c in best.columns])
    same = F.lit(True)
    for c in ids:
        same = same & test[c].eqNullSafe(fresh[f"_best_{c}"])
    return test.join(fresh, same, "left").drop(*[f"_best_{c}" for c in ids], "_vec_hash")


def similarity_per_row(test: DataFrame, train: DataFrame, mode: str = "mean", keys=("project",),
                       id_col: str = "vec_id", vec_col: str = "embedding", **kw) -> DataFrame:
    if mode == "mean":
        return mean_similarity_per_row(test, train, keys, vec_col)
    if mode == "max":
        return max_similarity_per_row(test, train, keys, id_col, id_col, vec_col, **kw)
    raise ValueError(f"no similarity called {mode!r}; known: {', '.join(MODES)}")


#: Names of the quantiles in a distribution.
QUANTILE_NAMES = dict(zip(("dist_p10", "dist_p25", "dist_median", "dist_p75", "dist_p90"), QUANTILES, strict=True))


def _spread_columns(sim: str) -> list[Column]:
    s = F.col(sim)
    return [F.avg(s).alias("dist_mean"), F.stddev_pop(s).alias("dist_std"), F.min(s).alias("dist_min"), F.max(s).alias("dist_max")]


def summarise(per_row: DataFrame, group, include_distribution: bool = True, exact: bool = True, accuracy: int = 100000) -> DataFrame:
    """``num_samples``, ``similarity`` (+ ``dist_*``) per group of the per-row similarities.

    ``dist_*`` is mean, population std, min, p10, p25, median, p75, p90, max.
    ``exact`` quantiles are interpolated between order statistics of one range
    sort (:mod:`driftmon.operators.quantiles`); otherwise ``percentile_approx``
    with bounded memory.
    """
    group = list(group)
    cols = [F.count(F.lit(1)).alias("num_samples"), F.avg("sim").alias("similarity")]
    order = [*group, "num_samples", "similarity", "dist_mean", "dist_std", "dist_min", *QUANTILE_NAMES, "dist_max"]
    if not include_distribution:
        return per_row.groupBy(*group).agg(*cols)
    if not exact:
        approx = F.percentile_approx("sim", F.array(*[F.lit(q) for q in QUANTILES]), accuracy)
        cols += [*_spread_columns("sim"), *[F.get(approx, i).alias(n) for i, n in enumerate(QUANTILE_NAMES)]]
        return per_row.groupBy(*group).agg(*cols).select(*order)
    ordered = ordered_values(per_row, group, "sim")
    stats = ordered.withColumnRenamed("v", "sim").groupBy(*group).agg(*cols, *_spread_columns("sim"))
    return with_quantiles(stats, ordered, group, QUANTILE_NAMES).select(*order)


def _needed(test: DataFrame, group, id_col: str, vec_col: str) -> DataFrame:
    """The columns a summary reads; the Arrow pass over the test side carries no others."""
    return test.select(*dict.fromkeys([*group, id_col, vec_col]))


def average_similarity(test: DataFrame, train: DataFrame, mode: str = "mean", keys=("project",),
                       id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per key: mean over test vectors of their mean (or max) cosine to training."""
    rows = similarity_per_row(_needed(test, keys, id_col, vec_col), train, mode, keys, id_col, vec_col)
    return summarise(rows, list(keys), include_distribution=False)


def similarity_distribution(test: DataFrame, train: DataFrame, mode: str = "max", keys=("project",),
                            id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = True) -> DataFrame:
    rows = similarity_per_row(_needed(test, keys, id_col, vec_col), train, mode, keys, id_col, vec_col)
    return summarise(rows, list(keys), include_distribution=True, exact=exact).drop("similarity")


def similarity_by_period(test: DataFrame, train: DataFrame, mode: str = "mean", keys=("project",),
                         period_col: str = "period", id_col: str = "vec_id", vec_col: str = "embedding",
                         include_distribution: bool = True, exact: bool = True) -> DataFrame:
    """One row per (keys, test window): the per-window loop becomes one groupBy."""
    test = _needed(test, [*keys, period_col], id_col, vec_col)
    rows = similarity_per_row(test, train, mode, keys, id_col, vec_col)
    return summarise(rows, [*keys, period_col], include_distribution, exact)
