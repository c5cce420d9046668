"""Spelling variant grouping with k-d trees over letter-count vectors.

Words one edit apart have letter-count vectors at an L1 distance of two at
most.  For each word length a k-d tree cuts the vectors into boxes; a word
visits the boxes within two of its vector among words as long as itself, and
within one among words one letter longer.  Each box is one cell of work: a
finer tree over its words, searched by box pruning, and the letter order of
what it finds is verified.  The trees' cuts come from a bounded sample; they
decide where work is done, not what is found.  A box that no cut can make
smaller (words with the same letters) is split into blocks that meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmon.llm.common import materialise, number_rows
from driftmon.llm.conversation_repair import CRC_TABLE, crc_sql
from driftmon.llm.kd_tree import KdTree, codes_of, edit_pairs, points_of

#: Words of the sample that the cuts are made from, about; and words that a box should hold.
SAMPLE, BOX = 100_000, 4_096
#: A box with more points or visits than this is worked in several cells.
MOST_POINTS, MOST_VISITS = 16_384, 500_000
#: Points in a leaf of the finer tree of a cell.
LEAF = 48
#: Visits that a cell searches at a time.
AT_ONCE = 65_536

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's runs of letters, after A-Z are lower-cased: a fixed value.
RUN = "[a-zÀ-ÿ]+"


def word_counts(docs: DataFrame, every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """word, n: how often each run of letters occurs in all texts, some of them misspelt on purpose.

    A run whose ``crc32(<doc_id>:<run>)`` is a multiple of ``every`` loses one
    letter.  Words of at least ``shortest`` code points and ``least``
    occurrences.  A null text has no runs, a null id counts as empty.
    """
    lower = F.translate("text", UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
                       F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    size = F.char_length("run")
    runs = runs.where(size >= shortest).withColumn("h", F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8")))
    place = (F.col("h") % size).cast("int")
    short = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, size))
    words = runs.select(F.when(F.col("h") % every == 0, short).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least)


_CODED = "id long, word string, length int, code long"


def _coded(vocabulary: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, size = codes_of(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(size.astype(np.int32)), pa.array(code.view(np.int64))],
                                  names=["id", "word", "length", "code"])

    return vocabulary.select(F.col("position").alias("id"), "word").mapInArrow(run, _CODED)


def box_trees(coded: DataFrame, total: int, sample: int = SAMPLE, box: int = BOX) -> dict[int, KdTree]:
    """A tree of boxes for each word length that needs more than one, from a sample chosen by hash."""
    each = max(1, -(-total // sample))
    rows = coded.where(F.pmod(F.xxhash64("word"), F.lit(each)) == 0).select("length", "code").toPandas()
    trees = {}
    for length, own in rows.groupby("length")["code"]:
        if len(own) * each > box:
            trees[int(length)] = KdTree(own.to_numpy().view(np.uint64), max(8, box // each), tight=False)
    return trees


_VISIT = "length int, box int, kind int, id long, code long, word string"


def visits(coded: DataFrame, trees) -> DataFrame:
    """Each word at its own box (kind 0) and at the boxes where words one edit away may be.

    Kind 1: longer-numbered boxes of its own length; kind 2: boxes of words one letter longer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy()
            code = batch.column(3).to_numpy().view(np.uint64)
            for length in np.unique(size).tolist():
                own = np.flatnonzero(size == length)
                codes = code[own]
                tree, longer = trees.value.get(length), trees.value.get(length + 1)
                home = tree.leaf_of(codes) if tree else np.zeros(len(own), np.int64)
                found = [(length, home, 0, np.arange(len(own)))]
                if tree:
                    for leaf, some in tree.near(codes, 2):
                        some = some[home[some] < leaf]
                        found.append((length, np.full(len(some), leaf), 1, some))
                if longer:
                    found += [(length + 1, np.full(len(some), leaf), 2, some) for leaf, some in longer.near(codes, 1)]
                else:
                    found.append((length + 1, np.zeros(len(own), np.int64), 2, np.arange(len(own))))
                group, rows = [], 0
                for k, f in enumerate(found):
                    group.append(f)
                    rows += len(f[3])
                    if rows >= 50_000 or k == len(found) - 1:
                        at = own[np.concatenate([f[3] for f in group])]
                        n = [len(f[3]) for f in group]
                        part = batch.take(pa.array(at))
                        yield pa.record_batch(
                            [pa.array(np.repeat([f[0] for f in group], n).astype(np.int32)), pa.array(np.concatenate([f[1] for f in group]).astype(np.int32)),
                             pa.array(np.repeat([f[2] for f in group], n).astype(np.int32)), part.column(0), part.column(3), part.column(1)],
                            names=["length", "box", "kind", "id", "code", "word"])
                        group, rows = [], 0

    return coded.mapInArrow(run, _VISIT)


def cells(visited: DataFrame, most_points: int, most_visits: int) -> DataFrame:
    """The visits with their cell (block, part): large boxes are split, every two of their words still meet once."""
    points, others = (F.sum((F.col("kind") == 0).cast("long")), F.sum((F.col("kind") != 0).cast("long")))
    sizes = visited.groupBy("length", "box").agg(points.alias("points"), others.alias("others")).where("points > 0")
    sizes = materialise(sizes.select("length", "box", F.ceil(F.col("points") / most_points).cast("int").alias("blocks"),
                                     F.greatest(F.lit(1), F.ceil((F.col("others") + F.col("points")) / most_visits)).cast("int").alias("parts")), "boxes")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    part = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("parts")).cast("int")

    def cell(block: Column, in_part: Column, kind: Column) -> Column:
        return F.struct(block.cast("int").alias("block"), in_part.cast("int").alias("part"), kind.cast("int").alias("kind"))

    as_point = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: cell(F.col("own"), p, F.lit(0)))
    earlier = F.when(F.col("own") > 0, F.sequence(F.lit(0), F.col("own") - 1)).otherwise(F.array().cast("array<int>"))
    as_query = F.transform(earlier, lambda b: cell(b, F.col("in_part"), F.lit(1)))
    visit = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: cell(b, F.col("in_part"), F.col("kind")))
    placed = visited.join(sizes, ["length", "box"]).withColumn("own", own).withColumn("in_part", part)
    at = F.explode(F.when(F.col("kind") == 0, F.concat(as_point, as_query)).otherwise(visit))
    return placed.select("length", "box", at.alias("at"), "id", "code", "word").select(
        "length", "box", "at.block", "at.part", "at.kind", "id", "code", "word")


_FOUND = "id long, n_near long, best long"


def search_cells(placed: DataFrame) -> DataFrame:
    """id, n_near, best: for each word of a cell how many words there are one edit away, and the least of their ids.

    A cell's points come first and make its tree; its visits then stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(5)], 1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if tuple(keys[a, :4]) != key:
                    if cell is not None:
                        yield from cell.close()
                    key, cell = tuple(keys[a, :4]), Cell(int(keys[a, 0]), int(keys[a, 3]) == 0)
                part = batch.slice(a, b - a)
                yield from cell.add(int(keys[a, 4]), part.column(5).to_numpy(), part.column(6).to_numpy().view(np.uint64), part.column(7).to_pylist())
        if cell is not None:
            yield from cell.close()

    by = ["length", "box", "block", "part"]
    return placed.repartition(*by).sortWithinPartitions(*by, "kind").mapInArrow(run, _FOUND)


_NONE = np.iinfo(np.int64).max


class Cell:
    """The points of one cell, and what is found near them."""

    def __init__(self, length: int, within: bool):
        self.length, self.within = length, within
        self.kind, self.waiting, self.rows = 0, [], 0
        self.tree = None

    def add(self, kind: int, ids: np.ndarray, codes: np.ndarray, words: list[str]) -> Iterator[pa.RecordBatch]:
        if kind != self.kind:
            yield from self._work()
            self.kind = kind
        self.waiting.append((ids, codes, points_of(words)[0].reshape(len(words), -1)))
        self.rows += len(ids)
        if kind and self.rows >= AT_ONCE:
            yield from self._work()

    def close(self) -> Iterator[pa.RecordBatch]:
        yield from self._work()
        if self.tree is not None:
            yield from self._give(self.ids, self.n, self.best)

    def _give(self, ids, n, best) -> Iterator[pa.RecordBatch]:
        some = n > 0
        if some.any():
            yield pa.record_batch([pa.array(ids[some]), pa.array(n[some]), pa.array(best[some])], names=["id", "n_near", "best"])

    def _work(self) -> Iterator[pa.RecordBatch]:
        if not self.waiting:
            return
        ids, codes, letters = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.rows = [], 0
        n, best = np.zeros(len(ids), np.int64), np.full(len(ids), _NONE)
        if self.kind == 0:
            self.ids, self.codes, self.letters, self.n, self.best = ids, codes, letters, n, best
            self.tree = KdTree(codes, LEAF, tight=True)
            if not self.within:
                return
        if self.tree is None:
            return
        for q, p in edit_pairs(self.tree, self.codes, self.letters, codes, letters, 1 if self.kind == 2 else 2):
            if self.kind == 0:
                once = q < p
                q, p = q[once], p[once]
            n += np.bincount(q, minlength=len(n))
            np.minimum.at(best, q, self.ids[p])
            self.n += np.bincount(p, minlength=len(self.n))
            np.minimum.at(self.best, p, ids[q])
        if self.kind:
            yield from self._give(ids, n, best)


def group_variants(words: DataFrame, sample: int = SAMPLE, box: int = BOX, most_points: int = MOST_POINTS, most_visits: int = MOST_VISITS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words (word, n)``.

    Words are near when one inserted, deleted or replaced code point turns one
    into the other; ``n_near`` counts them.  ``form`` is the near word of the
    largest ``n`` (ties: the smallest by code point) if its ``n`` is at least
    twice the word's, else null, and ``form_n`` its ``n``; ``root`` is where
    the forms lead.  Words are distinct, not null; other columns are ignored,
    an empty table gives an empty result.
    """
    vocabulary = number_rows(words.select("word", F.col("n").cast("long").alias("n")), [F.col("n").desc(), F.col("word")], "vocabulary")
    coded = _coded(vocabulary)
    trees = words.sparkSession.sparkContext.broadcast(box_trees(coded, vocabulary.count(), sample, box))
    visited = materialise(visits(coded, trees), "visits")
    found = search_cells(cells(visited, most_points, most_visits)).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    each = vocabulary.select(F.col("position").alias("id"), "word", "n")
    near = each.join(found, "id", "left")
    form = each.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    chosen = near.join(form, "best", "left")
    fits = F.col("form_n") >= 2 * F.col("n")
    chosen = materialise(chosen.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("up"),
                                       F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")), "forms")
    roots = root_of(chosen.where("up is not null").select("id", "up"))
    named = roots.join(each.select(F.col("id").alias("up"), F.col("word").alias("root")), "up").select("id", "root")
    return chosen.join(named, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def root_of(edges: DataFrame) -> DataFrame:
    """id, up: the last id that ``edges (id, up)`` lead to; each round doubles the way.

    A form occurs at least twice as often as its word, so ways are short.
    """
    edges = materialise(edges, "up-0")
    n = 0
    while True:
        n += 1
        hop = edges.select(F.col("id").alias("up"), F.col("up").alias("far"))
        jumped = edges.join(hop, "up", "left").select("id", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("moved"))
        jumped = materialise(jumped, f"up-{n}")
        edges = jumped.select("id", "up")
        if jumped.where("moved").isEmpty():
            return edges


def spelling_variants(docs: DataFrame) -> DataFrame:
    """:func:`group_variants` of the words of all texts (:func:`word_counts`)."""
    return group_variants(word_counts(docs))


OP12_SQL = f"""
WITH RECURSIVE t AS ({CRC_TABLE}),
r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
), g AS (
  SELECT doc, run, count(*) AS k, hex(encode(doc || ':' || run)) AS octets FROM r WHERE length(run) >= 5 GROUP BY doc, run
), h AS (
  SELECT run, k, {crc_sql("list_transform(range(0, length(octets) // 2), lambda i: ('0x' || octets[2 * i + 1:2 * i + 2])::BIGINT)")} AS h FROM g, t
), w AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h
), v AS (
  SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), i AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v
), p AS (
  SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS holed FROM i
), d AS (
  SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS short FROM i
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM p a JOIN p b ON a.holed = b.holed AND a.word <> b.word
  UNION ALL
  SELECT d.word, v.word, v.n FROM d JOIN v ON d.short = v.word
  UNION ALL
  SELECT v.word, d.word, d.n FROM d JOIN v ON d.short = v.word
), best AS (
  SELECT word, count(*) AS n_near, list_min(list({{'m': -other_n, 'w': other}})) AS b FROM near GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * v.n THEN b.w END AS form, CASE WHEN -b.m >= 2 * v.n THEN -b.m END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word
), up(word, root) AS (
  SELECT word, word FROM f WHERE form IS NULL
  UNION ALL
  SELECT f.word, up.root FROM up JOIN f ON f.form = up.word
)
SELECT f.word, f.form, up.root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM f JOIN up ON up.word = f.word
"""
