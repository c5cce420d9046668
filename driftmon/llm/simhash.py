"""SimHash near-duplicates through segment popcounts.

A 64-bit fingerprint becomes a vector of bit counts, one for each two-bit
segment.  The Manhattan distance of two vectors is never more than the number
of bits in which the fingerprints differ.  Of two fingerprints that differ in
at most four bits, one half (16 segments) differs in at most two, so the two
are at most two apart on that half's grid of counts: some grid point is within
one of both.  Every distinct fingerprint is sent to the grid points within one
of it, on both halves; fingerprints that meet at a point are verified on all
bits.  Points that many share are searched for a spanning forest of their
links, not for all pairs, and dense ones are split into blocks that meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmon.llm.common import materialise
from driftmon.llm.components import connected_components
from driftmon.llm.words import slices

#: Words of a shingle, the seed of its hash, and the bits in which linked fingerprints may differ.
WORDS, SEED, REACH = 4, 42, 4
#: Two-bit segments of a half; a grid point has itself and two neighbours in each segment around it.
SEGMENTS = 16
AROUND = 2 * SEGMENTS + 1
#: Fingerprints at a grid point that are searched together, at most.
MOST = 20_000
#: Points with up to so many fingerprints are compared pair by pair, many points at once.
FEW = 6
_POPCOUNT = np.array([0, 1, 1, 2], np.int64)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text: a bit is set if it is set in over half of the shingles' hashes."""
    own = text.lower().split()  # of bytes: A-Z alone, and white space of ASCII
    if not own:
        return 0
    line = b" ".join(own)
    size = np.fromiter(map(len, own), np.int64, len(own))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    k = min(words, len(own))
    begin, end = begin[: len(own) - k + 1].tolist(), end[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(begin), 65_536):
        h = np.array([digest(line[a:b], seed) for a, b in zip(begin[at : at + 65_536], end[at : at + 65_536], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begin), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and bits (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4_000_000):
                texts = pc.fill_null(part.column(1), b"").to_pylist()
                bits = np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)
                yield pa.record_batch([part.column(0), pa.array(bits)], names=["doc_id", "bits"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    return some.mapInArrow(run, "doc_id long, bits long")


def grid_points(bits: np.ndarray, half: int) -> np.ndarray:
    """The grid point of each fingerprint's half: 16 bit counts of two binary digits, above them the half."""
    own = (bits.view(np.uint64) >> np.uint64(32 * half)).astype(np.int64) & 0xFFFFFFFF
    point = np.zeros(len(bits), np.int64)
    for k in range(SEGMENTS):
        point |= _POPCOUNT[(own >> (2 * k)) & 3] << (2 * k)
    return point | half << 32


def around(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid points within one of each point, and the place of the point that each belongs to."""
    found, of = [points], [np.arange(len(points))]
    for k in range(SEGMENTS):
        count = (points >> (2 * k)) & 3
        for some, step in ((count < 2, 1 << (2 * k)), (count > 0, -(1 << (2 * k)))):
            found.append(points[some] + step)
            of.append(np.flatnonzero(some))
    return np.concatenate(found), np.concatenate(of)


def spread(distinct: DataFrame) -> DataFrame:
    """point, bits: every fingerprint at the grid points within one of its own, on both halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                bits = batch.column(0).slice(at, 2_000).to_numpy()
                for half in (0, 1):
                    point, of = around(grid_points(bits, half))
                    yield pa.record_batch([pa.array(point), pa.array(bits[of])], names=["point", "bits"])

    return distinct.select("bits").mapInArrow(run, "point long, bits long")


def dense_points(distinct: DataFrame, most: int) -> DataFrame:
    """point, blocks of the grid points where more than ``most`` fingerprints may meet.

    Such a point has a neighbour, or is one, that is the own point of many;
    those of few add ``most`` together at the most.
    """
    least = max(1, most // AROUND)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.concatenate([grid_points(batch.column(0).to_numpy(), half) for half in (0, 1)])
            point, n = np.unique(points, return_counts=True)
            yield pa.record_batch([pa.array(point), pa.array(n)], names=["point", "n"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            point, of = around(batch.column(0).to_numpy())
            yield pa.record_batch([pa.array(point), pa.array(batch.column(1).to_numpy()[of])], names=["point", "n"])

    counts = distinct.select("bits").mapInArrow(own, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    many = counts.where(F.col("n") >= least).mapInArrow(near, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))
    blocks = F.ceil((F.col("n") + most) / most).cast("int")
    return many.select("point", blocks.alias("blocks"))


def _span(bits: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of one point's fingerprints, found breadth first among those not reached yet."""
    rest = np.unique(bits)
    while len(rest) > 1:
        queue, rest = rest[:1], rest[1:]
        while len(queue) and len(rest):
            some, queue = queue[:64], queue[64:]
            near = np.bitwise_count(some[:, None] ^ rest[None, :]) <= reach
            hit = near.any(0)
            if hit.any():
                yield some[near[:, hit].argmax(0)], rest[hit]
                queue = np.concatenate([queue, rest[hit]])
                rest = rest[~hit]


def links(distinct: DataFrame, reach: int = REACH, most: int = MOST) -> DataFrame:
    """a, b: links between distinct fingerprints ``bits`` that make the components of all links of at most ``reach`` (4) bits."""
    if not 0 <= reach <= 4:
        raise ValueError("the grid finds fingerprints that differ in at most 4 bits")
    dense = materialise(dense_points(distinct, most), "dense")
    placed = spread(distinct).join(dense, "point", "left")
    block = F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    meet = F.transform(other, lambda o: F.least(block, o) * F.col("blocks") + F.greatest(block, o))
    placed = placed.select("point", "bits", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(meet)).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if pairs:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs, strict=True))
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.record_batch([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["a", "b"])

        held, size = [], 0
        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(3)])
            size += batch.num_rows
            if size >= 200_000:
                found, held = _search(held, reach, last=False)
                size = len(held[0][0])
                yield from give(found)
        if held:
            yield from give(_search(held, reach, last=True)[0])

    found = placed.repartition("point", "cell").sortWithinPartitions("point", "cell").mapInArrow(run, "a long, b long")
    return found.distinct()


def _search(held: list, reach: int, last: bool) -> tuple[list, list]:
    """Links of the cells that are whole in ``held`` (point, bits, cell; sorted), and what is left for the next time."""
    point, bits, cell = (np.concatenate(x) for x in zip(*held, strict=True))
    new = np.concatenate([[True], (np.diff(point) != 0) | (np.diff(cell) != 0)])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(point)]])
    left = [[point[:0], bits[:0], cell[:0]]]
    if not last:
        left = [[x[begin[-1] :] for x in (point, bits, cell)]]
        begin, end = begin[:-1], end[:-1]
    bits = bits.view(np.uint64)
    found = []
    size = end - begin
    few = (size > 1) & (size <= FEW)
    for step in range(1, FEW):
        for at in range(FEW - step):
            a = begin[few & (size > at + step)] + at
            near = np.bitwise_count(bits[a] ^ bits[a + step]) <= reach
            if near.any():
                found.append((bits[a[near]], bits[a[near] + step]))
    for a, b in zip(begin[size > FEW].tolist(), end[size > FEW].tolist(), strict=True):
        found += _span(bits[a:b], reach)
    return found, left


def simhash_components(docs: DataFrame, words: int = WORDS, reach: int = REACH, most: int = MOST) -> DataFrame:
    """Which documents hang together by fingerprints that differ in at most ``reach`` bits (4 at most).

    Input: ``doc_id`` and ``text``; other columns are ignored.  Words are runs
    of non-white-space, lower-cased in A-Z; shingles of ``words`` words, repeats
    included, joined by a space (fewer words: the whole sequence).  Output, one
    row per input row: ``doc_id, fingerprint`` (16 hex digits), ``component_id``
    (the least ``doc_id`` reachable, itself included).  Null and empty texts
    have the fingerprint zero, which links like any other.  Repeated rows have
    equal fingerprints; rows without an id take part and have the component's
    least id, null if no row has one.  An empty table gives an empty result.
    """
    rows = materialise(fingerprints(docs, words), "fingerprints")
    distinct = materialise(rows.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct")
    labels = connected_components(links(distinct, reach, most)).select(F.col("node").alias("bits"), "label")
    of = distinct.join(labels, "bits", "left").withColumn("label", F.coalesce("label", "bits"))
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    of = materialise(of.join(least, "label").select("bits", "component_id"), "of-fingerprint")
    return rows.join(of, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
