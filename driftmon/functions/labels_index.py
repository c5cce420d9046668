"""Label dictionary: sorted class names <-> ids 0..k-1 (a small dimension table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmon.operators.joins import join_small


def label_dictionary(df: DataFrame, label_col: str = "label", labels=None) -> DataFrame:
    """(label, label_id) with ids in alphabetical order of the labels.

    With ``labels`` given, the set comes from the caller; otherwise it is the
    distinct labels of the data (an empty configured set never yields NaN ids).
    """
    spark = df.sparkSession
    if labels:
        names = sorted(set(labels))
        return spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{label_col} string, label_id int")
    distinct = df.select(label_col).where(F.col(label_col).isNotNull()).distinct()
    # distinct labels are a handful of rows; one ordered window over them is fine
    return distinct.withColumn("label_id", (F.dense_rank().over(Window.orderBy(label_col)) - 1).cast("int"))


def index_labels(df: DataFrame, dictionary: DataFrame, label_col: str = "label") -> DataFrame:
    """Add ``label_id``; a label missing from the dictionary is an error, a null label has a null id.

    Rows of other classes are left out beforehand by ``filter_label_set``.
    """
    joined = join_small(df, dictionary, label_col, "left")
    lost = F.raise_error(F.concat(F.lit("label without an id: "), F.col(label_col)))
    return joined.withColumn("label_id", F.when(F.col("label_id").isNull() & F.col(label_col).isNotNull(), lost.cast("int"))
                             .otherwise(F.col("label_id")))


def unindex_labels(df: DataFrame, dictionary: DataFrame, id_col: str = "label_id",
                   out_col: str = "label") -> DataFrame:
    """Id -> label; an id missing from the dictionary is an error."""
    d = dictionary.select(F.col("label_id").alias(id_col), F.col(dictionary.columns[0]).alias(out_col))
    joined = join_small(df, d, id_col, "left")
    return joined.withColumn(
        out_col,
        F.when(F.col(out_col).isNull() & F.col(id_col).isNotNull(),
               F.raise_error(F.concat(F.lit("unknown label id "), F.col(id_col).cast("string"))))
        .otherwise(F.col(out_col)),
    )
