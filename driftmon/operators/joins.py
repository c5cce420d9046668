"""Join helpers with an explicit size check before any broadcast."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when its values take at most this many bytes as
# text (measured on the already-reduced side); beyond it the join shuffles.
DEFAULT_BROADCAST_BYTES = 32 << 20


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Join ``big`` with a side expected to be small, broadcasting it only if it is.

    ``small`` is persisted (memory and disk, so a lost executor recomputes it
    from lineage) and measured; otherwise a normal shuffle join is planned and
    AQE may still convert it at run time.  Null keys match null keys.
    """
    on = [on] if isinstance(on, str) else list(on)
    small = small.persist(StorageLevel.MEMORY_AND_DISK)
    size = small.agg(F.sum(F.octet_length(F.to_json(F.struct(*small.columns))))).first()[0] or 0
    right = small.withColumnsRenamed({c: f"_right_{c}" for c in on})
    right = F.broadcast(right) if size <= max_bytes else right
    same = F.lit(True)
    for c in on:
        same = same & big[c].eqNullSafe(right[f"_right_{c}"])
    return big.join(right, same, how).drop(*[f"_right_{c}" for c in on])
