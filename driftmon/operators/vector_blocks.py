"""Packed blocks of training vectors and the running maximum over them.

Training vectors of a key are brought to unit length, repeated ones are
dropped, and the rest are sorted by the signs of a few random projections, so
that vectors that point the same way come to lie together.  Runs of them become
blocks: one dense matrix each, with its centroid ``c`` and the radius
``r = max |x - c|``.

For a unit test vector ``t`` every ``x`` of a block has
``t . x = t . c + t . (x - c) <= t . c + r`` (Cauchy-Schwarz).  A test batch
meets the blocks of its key from the most promising on, and a block is
multiplied only with the rows whose bound is above their best so far.  The sort
decides only how much work is saved, never the result.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

PROJECTIONS = 16
BLOCK_BYTES = 4 << 20  # no block is larger, however long its vectors
SLICE_ROWS = 2048  # test rows multiplied at a time
SLACK = 1e-9  # rounding of the bound

_UNIT_SCHEMA = "_key string, _dim int, _code int, _unit binary"
_BLOCK_SCHEMA = "_key string, _dim int, _block binary, _centroid binary, _radius double"


def _fresh(name: str, taken) -> str:
    while name in taken:
        name += "_"
    return name


def _key_text(keys):
    """The key columns as one string; a null key is a key like any other."""
    return F.to_json(F.struct(*[F.col(k) for k in keys]))


def training_bytes(train: DataFrame, vec_col: str) -> int:
    """Bytes of all vectors as doubles."""
    return train.agg(F.sum(F.greatest(F.size(vec_col), F.lit(0)).cast("bigint") * 8)).first()[0] or 0


def unit_matrices(column: pa.Array):
    """Per vector length ``(row numbers, unit vectors)``.

    Null and empty vectors and those with a null, NaN or infinite element are
    left out; a zero vector stays zero.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        m = values[offsets[rows][:, None] + np.arange(dim)]
        whole = np.isfinite(m).all(axis=1)
        rows, m = rows[whole], m[whole]
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        yield int(dim), rows, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _unit_rows(batches):
    for batch in batches:
        keys = batch.column(0)
        for dim, rows, unit in unit_matrices(batch.column(1)):
            planes = np.random.default_rng(dim).standard_normal((dim, PROJECTIONS))
            code = ((unit @ planes > 0) << np.arange(PROJECTIONS)).sum(axis=1)
            yield pa.record_batch({
                "_key": keys.take(pa.array(rows)),
                "_dim": pa.array(np.full(rows.size, dim, dtype=np.int32)),
                "_code": pa.array(code.astype(np.int32)),
                "_unit": pa.array([u.tobytes() for u in unit], pa.binary()),
            })


def _packed(key, dim: int, units: list[bytes]):
    m = np.frombuffer(b"".join(units)).reshape(-1, dim)
    centroid = m.mean(axis=0)
    radius = float(np.sqrt(((m - centroid) ** 2).sum(axis=1)).max())
    return pa.record_batch({
        "_key": pa.array([key], pa.string()), "_dim": pa.array([dim], pa.int32()),
        "_block": pa.array([m.tobytes()], pa.binary()), "_centroid": pa.array([centroid.tobytes()], pa.binary()),
        "_radius": pa.array([radius], pa.float64()),
    })


def _pack(block_rows: int):
    def run(batches):
        head, units = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                full = units and (len(units) >= block_rows or (len(units) + 1) * len(row[2]) > BLOCK_BYTES)
                if units and (row[:2] != head or full):
                    yield _packed(*head, units)
                    units = []
                head = row[:2]
                units.append(row[2])
        if units:
            yield _packed(*head, units)

    return run


def training_blocks(train: DataFrame, keys, vec_col: str, block_rows: int) -> DataFrame:
    """Blocks of the training vectors: key text, length, matrix, centroid, radius."""
    units = train.select(_key_text(keys).alias("_key"), F.col(vec_col).cast("array<double>").alias("_v")) \
        .mapInArrow(_unit_rows, _UNIT_SCHEMA).distinct()
    order = ["_key", "_dim", "_code", "_unit"]
    return units.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack(block_rows), _BLOCK_SCHEMA)


def _best(unit: np.ndarray, blocks, centroids: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Largest product of each row with any row of any block."""
    bound = unit @ centroids.T + radii + SLACK
    best = np.full(unit.shape[0], -np.inf)
    for b in np.argsort(-bound.mean(axis=0)):
        open_rows = np.flatnonzero(bound[:, b] > best)
        if open_rows.size:
            best[open_rows] = np.maximum(best[open_rows], (unit[open_rows] @ blocks[b].T).max(axis=1))
    return best


def _running_max(shipped, key_col: str, vec_col: str, out_names):
    def run(batches):
        by_key = defaultdict(list)
        for key, dim, block, centroid, radius in shipped.value:
            by_key[key, dim].append((np.frombuffer(block).reshape(-1, dim), np.frombuffer(centroid), radius))
        ready = {k: ([b for b, _, _ in v], np.stack([c for _, c, _ in v]), np.array([r for _, _, r in v]))
                 for k, v in by_key.items()}
        for batch in batches:
            sim = np.full(batch.num_rows, np.nan)
            known = batch.column(key_col).dictionary_encode()
            names, code = known.dictionary.to_pylist(), known.indices.to_numpy(zero_copy_only=False)
            for dim, rows, unit in unit_matrices(batch.column(vec_col)):
                for k in np.unique(code[rows]):
                    found = ready.get((names[int(k)], dim))
                    mine = np.flatnonzero(code[rows] == k) if found else ()
                    for at in range(0, len(mine), SLICE_ROWS):
                        part = mine[at:at + SLICE_ROWS]
                        sim[rows[part]] = _best(unit[part], *found)
            out = pa.array(sim, mask=np.isnan(sim))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in out_names), out], [*out_names, "sim"])

    return run


def max_by_blocks(test: DataFrame, train: DataFrame, keys, vec_col: str, block_rows: int) -> DataFrame:
    """``test`` with ``sim``, in one narrow pass; the caller has checked the size of ``train``.

    A column ``sim`` of the input is replaced.
    """
    test = test.drop("sim")
    blocks = [tuple(r) for r in training_blocks(train, keys, vec_col, block_rows).collect()]
    blocks = [(k, d, bytes(b), bytes(c), r) for k, d, b, c, r in blocks]
    shipped = test.sparkSession.sparkContext.broadcast(blocks)
    key_col, unit_col = _fresh("_key", test.columns), _fresh("_v", test.columns)
    carried = test.withColumns({key_col: _key_text(keys), unit_col: F.col(vec_col).cast("array<double>")})
    schema = StructType([*test.schema.fields, StructField("sim", DoubleType())])
    return carried.mapInArrow(_running_max(shipped, key_col, unit_col, test.columns), schema)
