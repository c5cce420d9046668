"""Document quality by co-training two views.

The content view sees the words (their shapes, endings, repetition), the
metadata view sees what is known without reading them (language, source,
length, layout and character classes).  Each starts from the labelled sample.
In every round each view labels all documents of the corpus that it is sure
of and that it has not handed over before, and hands them to the other view.
Documents with equal views count once.  The views learn from what they are
handed by Newton steps whose sums are made in Spark.  Both are then calibrated
on held back labels, and a last logistic step combines them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmon.llm.common import materialise, without
from driftmon.llm.words import slices, split_words

#: Labelled documents that the views are fitted on, at most; one in five is held back for calibration.
FIT_ROWS = 8_000
ROUNDS = 3
#: How sure a view must be to hand a document over.
SURE = 0.97
#: Weight of a pseudo-label; those of a kind weigh together at most this share of the given labels of the kind.
PSEUDO = 0.3
#: Bytes of text whose features are made at a time.
SLICE = 2_500_000
#: Partial sums of a Newton step that reach the driver, at most (0.4 MB each).
PARTIALS = 256
SHAPES, ENDINGS, HASHED = 256, 128, 64
_CONTENT = SHAPES + ENDINGS + 8
_META = 2 * HASHED + 16


def _buckets(words: pa.Array, width: int) -> np.ndarray:
    """A bucket for each string, the same in every process."""
    coded = words.dictionary_encode()
    own = np.fromiter((zlib.crc32(w.encode()) % width for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    return own[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(own) else np.zeros(0, np.int64)


def _shape(words: pa.Array) -> pa.Array:
    """``Word!!`` becomes ``Aa!``: classes of letters and digits, runs as one."""
    out = words
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{L}+", "l"), (r"\p{N}+", "9")):
        out = pc.replace_substring_regex(out, pattern, sign)
    return pc.utf8_slice_codeunits(out, 0, 6)


def content_features(texts: pa.Array) -> np.ndarray:
    """Shares of word shapes and word endings, and how much a text repeats itself."""
    words, at, ends = split_words(texts)
    rows = len(ends)
    out = np.zeros((rows, _CONTENT), np.float32)
    if not len(words):
        return out
    begin = np.concatenate([[0], ends[:-1]])
    n = ends - begin
    d = np.repeat(np.arange(rows), n)
    for buckets, width, base in (
        (_buckets(_shape(words), SHAPES), SHAPES, 0),
        (_buckets(pc.utf8_slice_codeunits(words, -2, 1 << 30), ENDINGS), ENDINGS, SHAPES),
    ):
        out[:, base : base + width] = np.bincount(d * width + buckets[at], minlength=rows * width).reshape(rows, width)
    out[:, : SHAPES + ENDINGS] /= np.maximum(n, 1)[:, None]
    np.sqrt(out, out=out)  # shares of rare kinds count too
    pair, times = np.unique(d * len(words) + at, return_counts=True)
    dd = pair // len(words)
    distinct = np.bincount(dd, minlength=rows)
    most = np.zeros(rows)
    np.maximum.at(most, dd, times)
    same = np.bincount(d[1:], (at[1:] == at[:-1]) & (d[1:] == d[:-1]), rows)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)[at]
    some = np.maximum(n, 1)
    extra = [distinct / some, most / some, same / some, np.bincount(d, size, rows) / some / 10,
             np.bincount(d, size <= 2, rows) / some, np.bincount(d, size >= 15, rows) / some, np.log1p(n) / 10, n == 0]
    out[:, SHAPES + ENDINGS :] = np.stack(extra, 1)
    return out


def meta_features(texts: pa.Array, lang: pa.Array, source: pa.Array) -> np.ndarray:
    """Language and source (hashed), length, layout and the shares of character classes."""
    rows = len(texts)
    out = np.zeros((rows, _META), np.float32)
    if not rows:
        return out
    for k, column in enumerate((lang, source)):
        at = _buckets(pc.fill_null(column.cast(pa.large_string()), "\0none"), HASHED)
        out[np.arange(rows), k * HASHED + at] = 1
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    num = lambda a: a.to_numpy(zero_copy_only=False).astype(np.float64)
    chars, size = num(pc.utf8_length(texts)), num(pc.binary_length(texts))
    lines = num(pc.count_substring(texts, "\n")) + 1
    some = np.maximum(size, 1)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + rows + 1]
    share = []
    full = np.flatnonzero(np.diff(ends))  # reduceat has no empty runs
    for group in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b".,;:?", b"!", b"|", b"#$%&*", b"\"'()[]{}<>/=_+-"):
        table = np.zeros(256, np.uint8)
        table[list(group)] = 1
        hit = np.zeros(rows, np.int64)
        if len(full):
            hit[full] = np.add.reduceat(table[raw[: ends[-1]]], ends[:-1][full], dtype=np.int64)
        share.append(hit / some)
    rest = [np.log1p(chars) / 10, np.log1p(lines) / 5, np.log1p(chars / lines) / 10, (size - chars) / some, lines == 1,
            size == 0, chars < 50, chars > 20_000]
    out[:, 2 * HASHED :] = np.stack([*np.sqrt(share), *rest], 1)
    return out


def view_features(docs: DataFrame) -> DataFrame:
    """doc_id, both views of each document as packed half-precision numbers, and a digest of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                # own buffers that start at 0, as the views read them raw
                texts = pa.concat_arrays([pc.fill_null(part.column(1).cast(pa.large_string()), "")])
                views = [content_features(texts), meta_features(texts, part.column(2), part.column(3))]
                packed = [[r.tobytes() for r in v.astype("<f2")] for v in views]
                marks = [hashlib.blake2b(c + m, digest_size=16).digest() for c, m in zip(*packed, strict=True)]
                yield pa.record_batch([part.column(0), *(pa.array(c, pa.binary()) for c in (*packed, marks))],
                                      names=["doc_id", "content", "meta", "mark"])
        pa.default_memory_pool().release_unused()  # the worker lives on through later stages

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string"), F.col("source").cast("string"))
    return some.mapInArrow(run, "doc_id long, content binary, meta binary, mark binary")


def _unpack(column) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<f2") for b in column]).astype(np.float64) if len(column) else np.zeros((0, 0))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), x.dtype)])


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss at ``w``; ``x`` has the constant."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (weight * (p - y)), (x * (weight * p * (1 - p)).astype(x.dtype)[:, None]).T @ x


def _step(gradient: np.ndarray, curvature: np.ndarray, w: np.ndarray, l2: float) -> np.ndarray:
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-3
    return np.linalg.solve(curvature + np.diag(ridge), gradient + ridge * w)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the constant."""
    x = _with_one(x)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        step = _step(*_sums(x, y, weight, w), w, l2)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def score_views(features: DataFrame, models) -> DataFrame:
    """doc_id and the margin of each view; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                margin = [_margin(_unpack(part.column(k + 1).to_pylist()), w) for k, w in enumerate(models.value)]
                yield pa.record_batch([part.column(0), *map(pa.array, margin)], names=["doc_id", "content_margin", "meta_margin"])

    return features.select("doc_id", "content", "meta").mapInArrow(run, "doc_id long, content_margin double, meta_margin double")


def unlabelled_vectors(features: DataFrame, given: DataFrame) -> DataFrame:
    """content, meta: every distinct pair of views that no document with a given label has."""
    labelled = features.select("doc_id", "mark").join(given, "doc_id", "left_semi").select("mark").distinct()
    each = features.groupBy("mark").agg(F.first("content").alias("content"), F.first("meta").alias("meta"))
    return each.join(labelled, "mark", "left_anti").select("content", "meta")


def _matrix(column: pa.Array) -> np.ndarray:
    """Packed rows of equal length as one matrix."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<f2").reshape(len(column), -1).astype(np.float32)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            yield [_matrix(part.column(k)) for k in (0, 1)]


def handed(views: list[np.ndarray], rounds: list, taker: int) -> np.ndarray:
    """The label that the other view hands over with each document, 0 or 1, or -1 if it was never sure.

    ``rounds`` has both views' models of each round so far; a document is
    handed over once, in the first round that the giver is sure of it.
    """
    sure = np.log(SURE / (1 - SURE))
    label = np.full(len(views[0]), -1)
    for models in rounds:
        m = _margin(views[1 - taker], models[1 - taker])
        label = np.where((label < 0) & (np.abs(m) >= sure), m > 0, label)
    return label


def count_handed(vectors: DataFrame, rounds: list) -> np.ndarray:
    """How many documents are handed over, by taker and label."""
    models = vectors.sparkSession.sparkContext.broadcast(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 2), np.int64)
        for views in _slices(batches):
            for k in (0, 1):
                label = handed(views, models.value, k)
                n[k] += np.bincount(label[label >= 0], minlength=2)
        yield pa.record_batch([pa.array([0, 0, 1, 1], pa.int32()), pa.array([0, 1, 0, 1], pa.int32()), pa.array(n.ravel())],
                              names=["taker", "label", "n"])

    rows = vectors.mapInArrow(run, "taker int, label int, n long").groupBy("taker", "label").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((2, 2), np.int64)
    for r in rows:
        out[r["taker"], r["label"]] = r["n"]
    return out


def sums_of_handed(vectors: DataFrame, rounds: list, weights: np.ndarray, at: list) -> list:
    """Gradient and curvature of each view at ``at`` over all documents handed to it; views that are None are left out.

    ``weights`` holds the weight of a document by taker and label.  A task
    sends its sums alone, the curvature as the upper triangle.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((rounds, weights, at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, weights, at = shared.value
        total = [None if w is None else [np.zeros(len(w)), np.zeros((len(w), len(w)))] for w in at]
        for views in _slices(batches):
            for k, w in enumerate(at):
                if w is None:
                    continue
                label = handed(views, rounds, k)
                some = label >= 0
                if some.any():
                    for t, x in zip(total[k], _sums(_with_one(views[k][some]), label[some], weights[k][label[some]], w), strict=True):
                        t += x
        for k, t in enumerate(total):
            if t is not None:
                upper = t[1][np.triu_indices(len(t[0]))].astype("<f4").tobytes()
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([t[0].tobytes()], pa.binary()), pa.array([upper], pa.binary())],
                                      names=["taker", "gradient", "curvature"])

    out = [None if w is None else [np.zeros(len(w)), np.zeros((len(w), len(w)))] for w in at]
    for r in vectors.coalesce(PARTIALS).mapInArrow(run, "taker int, gradient binary, curvature binary").collect():
        t = out[r["taker"]]
        t[0] += np.frombuffer(r["gradient"])
        t[1][np.triu_indices(len(t[0]))] += np.frombuffer(r["curvature"], "<f4")
    for t in out:
        if t is not None:
            t[1] += np.triu(t[1], 1).T
    return out


def fit_with_handed(known: list, vectors: DataFrame, rounds: list) -> list:
    """Both views' models, learned from the given labels and from every document handed over so far."""
    n = count_handed(vectors, rounds)
    given = np.array([[np.sum(y == kind) for kind in (0, 1)] for _, y in known])
    weights = PSEUDO * np.minimum(1, given / np.maximum(n, 1))
    models = [w.copy() for w in rounds[-1]]
    going = [bool(n[k].any()) for k in (0, 1)]
    for _ in range(30):
        if not any(going):
            break
        sums = sums_of_handed(vectors, rounds, weights, [w if g else None for w, g in zip(models, going, strict=True)])
        for k, (x, y) in enumerate(known):
            if going[k]:
                own = _sums(_with_one(x), y, np.ones(len(y)), models[k])
                step = _step(sums[k][0] + own[0], sums[k][1] + own[1], models[k], 1.0)
                models[k] = models[k] - step
                going[k] = np.abs(step).max() >= 1e-4
    return models


def score_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Quality of every document: doc_id, content_score, meta_score, score, accepted.

    Input: ``doc_id, text, lang, source`` and labels with ``doc_id, quality``;
    other columns are ignored.  At most ``fit_rows`` labelled documents,
    chosen by hash, are learned from; pseudo-labels are sought among all
    unlabelled documents, and all that are found are learned from, equal ones
    once.  ``accepted`` means that the combined, calibrated
    probability of good quality is at least 0.5.  Null text counts as empty,
    null language and source are values of their own, rows without an id are
    scored too.  A document with several labels has the lowest; null labels
    are left out.  Repeated rows score alike.  Without labels of both kinds
    every document is accepted with score 1.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    features = materialise(view_features(docs), "views")
    given = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    given = materialise(given, "given")
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = features.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).toPandas()
    if sample["label"].nunique() < 2:
        one = F.lit(1.0)
        return features.select("doc_id", one.alias("content_score"), one.alias("meta_score"), one.alias("score"), F.lit(True).alias("accepted"))
    sample = sample.sort_values("doc_id")
    views = [_unpack(sample["content"]), _unpack(sample["meta"])]
    y = (sample["label"].to_numpy() > 0).astype(float)
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in sample["doc_id"]])
    known = [(v[~held], y[~held]) for v in views]
    vectors = materialise(unlabelled_vectors(features, given), "vectors")
    final = [fit(x, t, np.ones(len(t))) for x, t in known]
    given_over: list = []
    for _ in range(rounds):
        given_over.append(final)
        final = fit_with_handed(known, vectors, given_over)
    calibrated = []
    ones = np.ones(held.sum())
    for v, w in zip(views, final, strict=True):
        calibrated.append(fit(_margin(v[held], w)[:, None], y[held], ones, l2=1e-2))
    logits = [_margin(_margin(v[held], w)[:, None], c) for v, w, c in zip(views, final, calibrated, strict=True)]
    together = fit(np.stack(logits, 1), y[held], ones, l2=1e-2)
    scored = score_views(features, sc.broadcast(final))
    lit = lambda x: F.lit(float(x))
    z = [lit(c[0]) * F.col(m) + lit(c[1]) for c, m in zip(calibrated, ("content_margin", "meta_margin"), strict=True)]
    both = lit(together[0]) * z[0] + lit(together[1]) * z[1] + lit(together[2])
    chance = lambda x: 1 / (1 + F.exp(-x))
    return scored.select("doc_id", chance(z[0]).alias("content_score"), chance(z[1]).alias("meta_score"),
                         chance(both).alias("score"), (chance(both) >= 0.5).alias("accepted"))


def keep_good(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` whose document is accepted, with all their columns, whatever their names; rows without an id stay."""
    bad = score_quality(docs, labels, **kw).where("not accepted and doc_id is not null")
    return without(docs, materialise(bad.select(F.col("doc_id").alias("gone")).distinct(), "rejected"))
