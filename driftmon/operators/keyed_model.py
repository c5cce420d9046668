"""One linear text classifier per key, all of them fitted in one job.

Every key has a block of the feature space of its own: the hashed words of a
row (present or not, unit length) and a constant are shifted to the block of
the row's key.  In that space one multinomial logistic regression is the
separate fits side by side, because no row touches another key's block.  Its
gradient is summed by key inside Spark ML's tree aggregation, so a key with a
third of the rows is spread over all tasks like any other.

A key's loss is the mean over its rows, and each key has a regularisation of
its own: with row weights ``1 / (rows_k * reg_k)`` and the joint parameter ``1 /
sum of weights`` the joint minimum is every key's minimum of ``mean loss +
reg_k / 2 * |w_k|^2``.  The same serves for validation: each candidate
regularisation is one more key (:func:`fit_validated`).

A model lives on the driver and travels with the scoring tasks, so its size is
bounded: keys are fitted in groups whose coefficients take at most
``model_bytes``, however many keys there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from driftmon.functions.labels_index import label_dictionary
from driftmon.operators.joins import join_small
from driftmon.operators.model import TOKEN_PATTERN
from driftmon.operators.report import classification_report
from driftmon.operators.sampling import train_validation_split
from driftmon.sources.scratch import written

MODEL_BYTES = 64 << 20
REGULARISATION = 0.01


@dataclass
class KeyedClassifier:
    """Coefficients of each group of keys: ``key text -> (classes seen, matrix classes x features)``."""

    keys: list
    labels: list
    num_features: int
    groups: list


def key_text(keys) -> Column:
    """The key columns as one string; a null key is a key like any other."""
    return F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(k) for k in keys]))


def word_buckets(text_col: str, num_features: int) -> Column:
    """The sorted buckets of the distinct lower-cased words of a text (null: none)."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), TOKEN_PATTERN), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(num_features)).cast("int"))))


def _sparse(buckets: Column, block: Column, width: int, size: int) -> Column:
    """The fields of a sparse vector: unit-length words and the constant, in the block's place."""
    n = F.size(buckets)
    at = F.concat(buckets, F.array(F.lit(width - 1)))
    ones = F.concat(F.transform(buckets, lambda _: F.lit(1.0) / F.sqrt(n.cast("double"))), F.array(F.lit(1.0)))
    return F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                    F.transform(at, lambda i: i + block * width).alias("indices"), ones.alias("values"))


def fit_keyed(train: DataFrame, keys=("project",), text_col: str = "text", label_col: str = "label",
              reg: float | str = REGULARISATION, num_features: int = 1 << 12, max_iter: int = 100,
              model_bytes: int = MODEL_BYTES) -> KeyedClassifier:
    """Fit every key's classifier; ``reg`` is a number above 0 or a column that is constant within a key.

    Rows without a label teach nothing.  A key predicts only classes that its
    own rows have.  An empty training table gives a model that knows no key.
    """
    keys = list(keys)
    spark = train.sparkSession
    reg = F.col(reg) if isinstance(reg, str) else F.lit(float(reg))
    rows = written(train.where(F.col(label_col).isNotNull()).select(
        key_text(keys).alias("_key"), F.col(label_col).cast("string").alias("_class"),
        reg.cast("double").alias("_reg"), word_buckets(text_col, num_features).alias("_words")), "keyed-train")
    seen = rows.groupBy("_key", "_class").agg(F.count(F.lit(1)).alias("n"), F.max("_reg").alias("reg")).collect()
    labels = sorted({r["_class"] for r in seen})
    of_key: dict = {}
    for r in seen:
        entry = of_key.setdefault(r["_key"], {"n": 0, "reg": r["reg"], "classes": set()})
        entry["n"] += r["n"]
        entry["classes"].add(labels.index(r["_class"]))
    if any(not e["reg"] or e["reg"] <= 0 for e in of_key.values()):
        raise ValueError("reg must be above 0 for every key")
    width = num_features + 1
    each = max(1, model_bytes // (8 * width * max(1, len(labels))))
    names = sorted(of_key)
    ids = label_dictionary(rows, "_class", labels) if labels else None
    groups = []
    for at in range(0, len(names), each):
        part = names[at:at + each]
        if len(labels) == 1:
            groups.append({k: ([0], np.zeros((1, width))) for k in part})
            continue
        table = spark.createDataFrame(
            [(k, b, 1.0 / (of_key[k]["n"] * of_key[k]["reg"])) for b, k in enumerate(part)],
            "_key string, _block int, _weight double")
        size = len(part) * width
        crossed = join_small(join_small(rows, table, "_key", "inner"), ids, "_class", "inner").select(
            F.col("label_id").cast("double").alias("label"), F.col("_weight").alias("weight"),
            _sparse(F.col("_words"), F.col("_block"), width, size).alias("features"))
        # One row without features for each class: its loss is a constant, so no
        # coefficient changes, but the solver sees all classes and no constant column.
        total = sum(1.0 / of_key[k]["reg"] for k in part)
        blank = spark.range(len(labels)).select(
            F.col("id").cast("double").alias("label"), F.lit(total / len(labels)).alias("weight"),
            F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                     F.array().cast("array<int>").alias("indices"),
                     F.array().cast("array<double>").alias("values")).alias("features"))
        points = crossed.unionByName(blank)
        vectors = StructType([f if f.name != "features" else StructField("features", VectorUDT()) for f in points.schema])
        fit = LogisticRegression(weightCol="weight", family="multinomial", fitIntercept=False, standardization=False,
                                 regParam=1.0 / (2.0 * total), maxIter=max_iter, tol=1e-9,
                                 ).fit(written(points, "keyed-points", vectors))
        matrix = fit.coefficientMatrix.toArray()
        groups.append({k: (sorted(of_key[k]["classes"]), matrix[:, b * width:(b + 1) * width])
                       for b, k in enumerate(part)})
    return KeyedClassifier(keys, labels, num_features, groups)


def _predictions(shipped, labels, key_col: str, words_col: str, out_names):
    names = np.array([*labels, None], dtype=object)

    def run(batches):
        for batch in batches:
            found = np.full(batch.num_rows, len(labels))
            known = batch.column(key_col).dictionary_encode()
            code = known.indices.to_numpy(zero_copy_only=False)
            words = batch.column(words_col)
            offsets, flat = words.offsets.to_numpy(), words.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(offsets)
            for c, key in enumerate(known.dictionary.to_pylist()):
                if key not in shipped.value:
                    continue
                classes, matrix = shipped.value[key]
                rows = np.flatnonzero(code == c)
                n = lengths[rows]
                owner = np.repeat(np.arange(rows.size), n)
                at = np.arange(owner.size) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[rows], n)
                bucket = flat[at]
                margins = np.stack([
                    np.bincount(owner, matrix[k][bucket], rows.size) / np.sqrt(np.maximum(n, 1)) + matrix[k][-1]
                    for k in classes])
                found[rows] = np.array(classes)[margins.argmax(axis=0)]
            out = pa.array(names[found], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in out_names), out], [*out_names, "y_pred"])

    return run


def score_keyed(model: KeyedClassifier, df: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Every row with ``y_pred`` from its key's model (null for a key without one); the label becomes ``y_true``.

    A narrow pass per group of keys.
    """
    if label_col in df.columns and label_col != "y_true":
        df = df.drop("y_true").withColumnRenamed(label_col, "y_true")
    df = df.drop("y_pred")
    key_col, words_col = "_key", "_words"
    while {key_col, words_col} & set(df.columns):
        key_col, words_col = key_col + "_", words_col + "_"
    schema = StructType([*df.schema.fields, StructField("y_pred", StringType())])
    sc = df.sparkSession.sparkContext
    keyed = df.withColumns({key_col: key_text(model.keys), words_col: word_buckets(text_col, model.num_features)})
    parts = []
    for group in model.groups:
        mine = keyed if len(model.groups) == 1 else keyed.where(F.col(key_col).isin(list(group)))
        parts.append(mine.mapInArrow(_predictions(sc.broadcast(group), model.labels, key_col, words_col, df.columns), schema))
    if len(model.groups) == 1:
        return parts[0]
    known = [k for group in model.groups for k in group]
    rest = keyed.where(~F.col(key_col).isin(known)) if known else keyed
    return reduce(DataFrame.unionByName, parts + [rest.select(*df.columns, F.lit(None).cast("string").alias("y_pred"))])


def fit_validated(train: DataFrame, keys=("project",), text_col: str = "text", label_col: str = "label",
                  id_col: str = "id", candidates=(1.0, 0.1, 0.01, 0.001), split_size: float = 0.3, seed: int = 42,
                  num_features: int = 1 << 12, max_iter: int = 100, model_bytes: int = MODEL_BYTES):
    """Choose each key's regularisation on its validation rows, then fit on all its rows.

    Returns ``(model, curve)``; the curve has ``keys, reg, n_validation,
    accuracy, f1_macro, chosen``.  Highest macro F1 wins, ties by the larger
    ``reg``.  All candidates of all keys are fitted together.  A key without
    validation rows takes the largest candidate and has no curve.
    """
    keys = list(keys)
    labelled = train.where(F.col(label_col).isNotNull())
    rows = written(train_validation_split(labelled, label_col, id_col, split_size, seed, keys), "validated-rows")
    grid = sorted({float(c) for c in candidates}, reverse=True)
    tried = rows.withColumn("reg", F.explode(F.array(*[F.lit(c) for c in grid])))
    by_reg = [*keys, "reg"]
    model = fit_keyed(tried.where("split = 'train'"), by_reg, text_col, label_col, "reg", num_features, max_iter, model_bytes)
    scored = score_keyed(model, tried.where("split = 'validation'"), text_col, label_col)
    report = classification_report(scored.select(*by_reg, "y_true", "y_pred"), by_reg)
    is_macro = F.col("class") == "macro avg"
    curve = report.groupBy(*by_reg).agg(
        F.max(F.when(is_macro, F.col("support"))).alias("n_validation"),
        F.max(F.when(F.col("class") == "accuracy", F.col("f1_score"))).alias("accuracy"),
        F.max(F.when(is_macro, F.col("f1_score"))).alias("f1_macro"))
    curve = written(curve, "validation-curve")  # a row for each key and candidate
    best = curve.groupBy(*keys).agg(F.max(F.struct("f1_macro", "reg")).getField("reg").alias("_best"))
    whole = join_small(rows, best, keys, "left").withColumn("_best", F.coalesce("_best", F.lit(grid[0])))
    final = fit_keyed(whole, keys, text_col, label_col, "_best", num_features, max_iter, model_bytes)
    chosen = join_small(curve, best, keys, "left").withColumn("chosen", F.col("reg") == F.col("_best")).drop("_best")
    return final, chosen
