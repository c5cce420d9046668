"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source starts with the same expected number of copies.
The whole part is taken; the fractional parts are rounded together: two
documents are paired and words are moved at random from one to the other,
keeping both expectations, until one of them is integral.  Because words move,
not counts, the source's total stays what it was.  Small groups of documents
do this independently and hand on a few unfinished documents each; those are
paired again, group by group, in a tree.  At the root the last one goes to the
nearer side and the root's few documents make up for what that missed.  The
groups and the random numbers come from hashes of the rows, so a rerun agrees
whatever the partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmon.llm.common import as_struct, from_struct, materialise, number_rows, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
#: Documents that one group of the tree rounds, at every level.
FAN_IN = 64
_TINY = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """One row per source: source, source_size, n_docs, target.

    Sources in code-point order, null last, take the weights in turn and share
    the words of all sources; a target stops at ``most_copies`` times its
    source's size and the excess is shared again by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    per = number_rows(per, order, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    per = materialise(per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most_copies)), "shares")
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    # The targets are min(cap, level * weight).  A source that reaches its cap
    # stays there, so the level only rises; each round fixes at least one more.
    level, fixed = 0.0, -1
    while True:
        at_cap = F.col("cap") <= level * F.col("weight")
        row = per.agg(
            F.sum(F.when(at_cap, F.col("cap")).otherwise(0.0)).alias("held"),
            F.sum(F.when(at_cap, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(at_cap.cast("int")).alias("n"),
        ).first()
        if row["n"] == fixed or not row["open"]:
            break
        fixed = row["n"]
        level = (total - row["held"]) / row["open"]
    return per.select(
        "source", "source_size", "n_docs", F.least("cap", F.lit(level) * F.col("weight")).alias("target")
    )


def pivot(size: np.ndarray, frac: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Round ``frac`` in the given order; returns the fractions and the place left unfinished (-1: none).

    All but at most one of the results are 0 or 1, and the sum of
    ``size * frac`` is unchanged.
    """
    f = frac.copy()
    carry = -1
    for j in range(len(f)):
        if size[j] <= 0 or f[j] <= _TINY or f[j] >= 1 - _TINY:
            f[j] = 1.0 if f[j] >= 1 - _TINY else 0.0
            continue
        if carry < 0:
            carry = j
            continue
        c = carry
        out = min(size[c] * f[c], size[j] * (1 - f[j]))
        back = min(size[j] * f[j], size[c] * (1 - f[c]))
        if u[j] * (out + back) < back:
            f[c], f[j] = f[c] - out / size[c], f[j] + out / size[j]
        else:
            f[c], f[j] = f[c] + back / size[c], f[j] - back / size[j]
        open_ = []
        for k in (c, j):
            if f[k] <= _TINY:
                f[k] = 0.0
            elif f[k] >= 1 - _TINY:
                f[k] = 1.0
            else:
                open_.append(k)
        carry = open_[0] if open_ else -1
    return f, carry


def settle(size: np.ndarray, frac: np.ndarray, f: np.ndarray, carry: int) -> np.ndarray:
    """End at the root of the tree: round the last document to the nearer side, then turn the one
    or two roundings that bring the source nearest to its target, as long as that helps."""
    f = f.copy()
    if carry >= 0:
        f[carry] = float(f[carry] >= 0.5)
    free = np.flatnonzero((size > 0) & (frac > _TINY) & (frac < 1 - _TINY))
    miss = float(np.sum(size * (f - frac)))
    while len(free):
        turn = size[free] * (1 - 2 * f[free])
        both = turn[:, None] + turn[None, :]
        np.fill_diagonal(both, turn)
        left = np.abs(miss + both)
        i, j = np.unravel_index(np.argmin(left), left.shape)
        if left[i, j] >= abs(miss) - _TINY:
            break
        miss += both[i, j]
        for k in {int(i), int(j)}:
            f[free[k]] = 1 - f[free[k]]
    return f


def _round_group(table: pa.Table) -> pa.Table:
    size = table["size"].to_numpy().astype(np.float64)
    order = np.lexsort((table["row"].to_numpy(), table["u"].to_numpy(), -size))
    table, size = table.take(pa.array(order)), size[order]
    frac, u = table["frac"].to_numpy(), table["u"].to_numpy()
    if table["groups"][0].as_py() <= 1:
        f, carry = pivot(size, frac, u)
        f = settle(size, frac, f, carry)
    else:  # some documents of all sizes go up as they are, to make up misses at the root
        open_ = np.flatnonzero((size > 0) & (frac > _TINY) & (frac < 1 - _TINY))
        up = open_[[len(open_) * k // 16 for k in (1, 2, 4, 8, 12)] + [-1]] if len(open_) > 16 else open_[:0]
        rest = np.setdiff1d(np.arange(len(size)), up)
        f = frac.copy()
        f[rest], _ = pivot(size[rest], frac[rest], u[rest])
    return table.set_column(table.schema.get_field_index("frac"), "frac", pa.array(f, pa.float64()))


def mix_sources(docs: DataFrame, weights=WEIGHTS, most_copies: int = MOST_COPIES, fan_in: int = FAN_IN,
                seed: int = 17) -> DataFrame:
    """Whole copies of each document such that every source comes near its target.

    Input: ``doc_id, text, source``; other columns are ignored.  Output, one
    row per input row: ``doc_id, size, source_size, target, taken, copies``;
    ``size`` counts words, ``taken`` is ``copies * size``.  Null or empty text
    has size 0 and is never copied; a null source is a source of its own.
    Repeated rows are rounded one by one.  An empty table gives an empty result.
    """
    sizes = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("_text"))
    sizes = materialise(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes")
    targets = materialise(source_targets(sizes, weights, most_copies).withColumnRenamed("source", "_source")
                          .withColumn("sid", F.xxhash64("_source")), "targets")
    chance = F.xxhash64(F.lit(seed), "doc_id", "_text")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    docs_ = sizes.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(
        "row", "doc_id", "sid", "size", "source_size", "target",
        F.least(F.floor(rate + _TINY), F.lit(most_copies)).cast("long").alias("whole"),
        rate.alias("rate"),
        F.pmod(chance, F.ceil(F.col("n_docs") / fan_in)).cast("long").alias("group"),
        (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "doc_id", "_text"), 11) / float(1 << 53)).alias("u"),
        F.ceil(F.col("n_docs") / fan_in).cast("long").alias("groups"),
    )
    docs_ = docs_.withColumn("frac", F.when(F.col("size") > 0, F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))).otherwise(0.0))
    docs_ = docs_.drop("rate")
    level = materialise(docs_.groupBy("sid", "group").applyInArrow(_round_group, docs_.schema), "mix-0")
    result, settled, n = level, None, 0
    unfinished = (F.col("frac") > 0) & (F.col("frac") < 1)
    rest = level.where(unfinished)
    while not rest.isEmpty():
        n += 1
        up = rest.withColumn("group", F.floor(F.col("group") / fan_in).cast("long")).withColumn(
            "groups", F.ceil(F.col("groups") / fan_in).cast("long"))
        level = materialise(up.groupBy("sid", "group").applyInArrow(_round_group, up.schema), f"mix-{n}")
        done = level.where(~unfinished).select("row", F.col("frac").alias("settled"))
        settled = done if settled is None else settled.unionByName(done)
        rest = level.where(unfinished)
    if settled is not None:
        result = result.join(settled, "row", "left").withColumn("frac", F.coalesce("settled", "frac"))
    copies = (F.col("whole") + F.col("frac").cast("long")).alias("copies")
    return result.select("doc_id", "size", "source_size", "target", copies).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def repeat_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, with its own columns, whatever their names.

    Rows are matched by id and size; of rows equal in both, as many get copies
    as the mix says, whichever they are.
    """
    mixed = mix_sources(docs, **kw).select(F.col("doc_id").alias("mix_id"), F.col("size").alias("mix_size"), "copies")
    nth = Window.partitionBy("mix_id", "mix_size").orderBy(F.col("copies").desc())
    mixed = materialise(mixed.withColumn("mix_nth", F.row_number().over(nth)).where("copies > 0"), "copies")
    whole, row, of = as_struct(docs, id=F.col("doc_id"), size=word_count("text"))
    own = F.row_number().over(Window.partitionBy(of["id"], of["size"]).orderBy(of["id"]))
    same = F.col(of["id"]).eqNullSafe(F.col("mix_id")) & (F.col(of["size"]) == F.col("mix_size")) & (F.col("own_nth") == F.col("mix_nth"))
    taken = whole.withColumn("own_nth", own).join(mixed, same)
    return from_struct(taken.select(row, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), row, docs.columns)
