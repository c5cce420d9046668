"""Dynamic time warping between the similarity and the quality series of each key.

Both series are rescaled (min-max and z-score, constant -> 0) and aligned
with FastDTW (radius 1, cost |a - b|), or exact DTW on request.  One key is
one ``applyInPandas`` group: a series has one point per window, and Spark
runs the many keys in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from driftmon.functions import numeric as K

SCALINGS = {"minmax": K.minmax, "zscore": K.zscore}


def dtw_align(df: DataFrame, x: str, y: str, keys=("project",), order_col: str = "period",
              radius: int = 1, exact: bool = False) -> DataFrame:
    """Per key and scaling: distance, path (list of (i, j)) and the scaled series."""
    keys = list(keys)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col)
        rows = []
        for name, scale in SCALINGS.items():
            a, b = scale(pdf[x].to_numpy(float)), scale(pdf[y].to_numpy(float))
            dist, path = K.dtw_exact(a, b) if exact else K.fastdtw(a, b, radius)
            row = {k: pdf[k].iloc[0] for k in keys}
            row.update(normalization=name, distance=float(dist),
                       path=[{"i": int(i), "j": int(j)} for i, j in path],
                       x_scaled=[float(v) for v in a], y_scaled=[float(v) for v in b])
            rows.append(row)
        return pd.DataFrame(rows)

    schema = (f"{key_schema}, normalization string, distance double, path array<struct<i:int,j:int>>, "
              "x_scaled array<double>, y_scaled array<double>")
    return df.select(*keys, order_col, x, y).where(f"`{x}` IS NOT NULL AND `{y}` IS NOT NULL") \
        .groupBy(*keys).applyInPandas(run, schema)
