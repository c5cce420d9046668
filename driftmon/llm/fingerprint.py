"""Document fingerprints: threshold-scaled sketches of character shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash space.
Whether a hash is kept depends on the hash alone, so sketches of parts merge by
union and containment is estimated without bias between texts of very
different length.  Short texts keep a larger fixed fraction; as the fractions
are nested, two sketches compare at the smaller of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmon.llm.common import range_splits
from driftmon.llm.words import slices

#: Code points of a shingle, and of the finer one that only short texts keep.
SHINGLE, FINE = 16, 3
#: Texts under FINE_BELOW code points keep fine shingles, from COARSE_FROM on the others.
FINE_BELOW, COARSE_FROM = 64, 32
#: Bits dropped: the fractions kept are 1/64, 1/8 and 1, the first that leaves ENOUGH distinct hashes.
LEVELS = (6, 3, 0)
ENOUGH = 32
_BASE = 0x9E3779B97F4A7C15
_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _windows(points: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of ``width`` values, built from hashes of shorter windows."""
    h, base, have = points.astype(np.uint64) + np.uint64(1), np.uint64(_BASE), 1
    out, out_len = None, 0
    while have <= width:
        if width & have:
            if out is None:
                out = h
            else:
                n = len(points) - out_len - have + 1
                out = out[:n] * base + h[out_len : out_len + n]
            out_len += have
        if have * 2 <= width:
            n = len(points) - 2 * have + 1
            if n > 0:
                h = h[:n] * base + h[have : have + n]
            else:
                h = h[:0]
            base = np.uint64(int(base) ** 2 % (1 << 64))
        have *= 2
    return out


def _sketch(points: np.ndarray, width: int) -> tuple[int, np.ndarray]:
    """Bits dropped, and the sorted hashes kept, of a text that has code points."""
    width = min(width, len(points))
    h = _mix(_windows(points, width) ^ np.uint64(width))
    for drop in LEVELS:
        kept = np.unique(h[h < np.uint64(1 << (64 - drop))] if drop else h)
        if len(kept) >= ENOUGH:
            break
    return drop, kept


def fingerprint(text: str) -> tuple:
    """The sketches of a text: (fine, coarse), each None or (bits dropped, sorted hashes)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    fine = _sketch(points, FINE) if 0 < n < FINE_BELOW else None
    return fine, _sketch(points, SHINGLE) if n >= COARSE_FROM else None


def to_string(mark: tuple) -> str:
    """``f<level>:<hashes>`` and ``c<level>:<hashes>``, 16 hex digits each; empty for an empty text."""
    return ";".join(
        f"{kind}{s[0]}:{s[1].astype('>u8').tobytes().hex()}" for kind, s in zip("fc", mark, strict=True) if s is not None
    )


def from_string(text: str) -> tuple:
    found = {}
    for part in filter(None, text.split(";")):
        head, _, body = part.partition(":")
        found[head[0]] = (int(head[1:]), np.frombuffer(bytes.fromhex(body), ">u8").astype(np.uint64))
    return found.get("f"), found.get("c")


def containment(a: tuple, b: tuple) -> float:
    """Estimated share of the smaller text's shingles that the other has; 1 for two empty texts."""
    if a == (None, None) or b == (None, None):
        return float(a == b)
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            continue
        drop = max(x[0], y[0])
        u, v = x[1], y[1]
        if drop:
            limit = np.uint64(1 << (64 - drop))
            u, v = u[: np.searchsorted(u, limit)], v[: np.searchsorted(v, limit)]
        if not len(u) or not len(v):
            return float(not len(u) and not len(v) and np.array_equal(x[1], y[1]))
        return len(np.intersect1d(u, v, assume_unique=True)) / min(len(u), len(v))
    return 0.0


def merge(a: tuple, b: tuple) -> tuple:
    """The sketch of two parts together, at the smaller of their fractions."""
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(x or y)
            continue
        drop = max(x[0], y[0])
        h = np.union1d(x[1], y[1])
        out.append((drop, h[h < np.uint64(1 << (64 - drop))] if drop else h))
    return tuple(out)


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row; null text counts as empty, which has an empty fingerprint."""

    @F.pandas_udf("string")
    def marks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: to_string(fingerprint(t)))

    return docs.select("doc_id", marks(F.coalesce("text", F.lit(""))).alias("fingerprint"))


def compare_with_next(docs: DataFrame, rows_each: int = 500) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last ``floor(n/4)`` code points replaced by the
    first as many of the next document in ascending ``doc_id`` (after the last
    comes the first).  Input: ``doc_id`` and ``text``; other columns are
    ignored.  Output, one row per input row: ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Texts move once, to ranges of ids; the first row of a range also goes, as a
    guest, to the range before it, so each row meets its next one.  Null text
    counts as empty.  Rows with the same id follow each other by text, rows
    without an id come last; where no row has an id, the last one's next text
    is empty.  An empty table gives an empty result.
    """
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    splits = np.array(range_splits(some, "doc_id", rows_each), np.int64)
    first = some.agg(F.min("doc_id")).first()[0]
    last = len(splits)

    @F.pandas_udf("array<long>")
    def places(ids: pd.Series) -> pd.Series:
        # 4 * range + kind; kind 0: the row's own place, 1: guest from the next range, 2: the very first row
        out = []
        for i in ids:
            if pd.isna(i):
                out.append([4 * last])
                continue
            i = int(i)
            r = int(np.searchsorted(splits, i, "right"))
            own = [4 * r]
            if r and splits[r - 1] == i:
                own.append(4 * (r - 1) + 1)
            if i == first:
                own.append(4 * last + 2)
            out.append(own)
        return pd.Series(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (place, doc_id, text, mark) still waiting for its next row
        for batch in batches:
            for part in slices(batch, 2, 2_000_000):
                out = []
                for place, doc, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    mark = fingerprint(text)
                    if held is not None and held[0] % 4 == 0:
                        same = held[0] // 4 == place // 4
                        out.append(_compared(held, text if same else "", mark if same else (None, None)))
                    held = (place, doc, text, mark)
                yield _arrow(out)
        if held is not None and held[0] % 4 == 0:
            yield _arrow([_compared(held, "", (None, None))])

    dealt = some.withColumn("place", F.explode(places("doc_id"))).select("place", "doc_id", "text")
    ranged = dealt.repartition(F.shiftright("place", 2)).sortWithinPartitions(
        "place", F.col("doc_id").asc_nulls_last(), "text"
    )
    return ranged.mapInArrow(run, _OUT)


def edited_text(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compared(held: tuple, following: str, next_mark: tuple) -> tuple:
    _, doc, text, mark = held
    edited = edited_text(text, following)
    edited_mark = fingerprint(edited)
    return (
        doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), to_string(mark), to_string(edited_mark),
        containment(mark, edited_mark), containment(mark, next_mark),
    )


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    names = [c.split()[0] for c in _OUT.split(", ")]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)
