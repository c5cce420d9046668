"""Toxicity by noisy-channel deobfuscation.

A writer who hides a word swaps letters for digits or signs, spreads it out or
repeats letters.  Tokens that look so are read as a lattice of the characters
they may stand for; a Viterbi pass under a character 4-gram model, counted over
the whole corpus, gives the likeliest reading.  The score is learned on the
restored words: a lexicon of words and word beginnings that labelled toxic
documents have and others do not, and a logistic curve over a document's
strongest evidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmon.llm.common import materialise
from driftmon.llm.words import slices, split_words

#: Signs and the letters they may stand for: fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
    "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
_WILD = "*#%"
#: Log costs of a lattice edge: reading a sign as a letter, a wildcard, dropping a separator, a sign, a repeated letter.
COST_LEET, COST_WILD, COST_DROP, COST_DROP_SIGN, COST_REPEAT = -0.5, -2.0, -0.2, -4.0, -0.7
#: What a word may carry at its ends without being disguised.
_ENDS = r"""^["'(\[{<«„“¿¡.,;:?!*&%#|\-]+|(?:[.,;:?!*&%#|"')\]}>»”…\-]|\${3,})+$"""
_LATIN = "^[a-zà-öø-ÿ]+$"
_THRICE = re.compile(r"(\w)\1\1")
#: Single characters in a row that may be one spread-out word.
SPREAD = 4

SYMBOLS = 28  # 0: edge of a word, 1-26: a-z, 27: any other letter
#: Labelled documents that the score is fitted on, at most.
FIT_ROWS = 20_000
_EDGE = 0


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def _symbols_of_bytes() -> np.ndarray:
    table = np.full(256, 27, np.int64)
    table[ord(" ")] = _EDGE
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[0x80:0xC0] = -1  # the rest of a letter outside ASCII
    return table


def clean_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words without what hangs at their ends, and which of them are plain Latin letters."""
    low = pc.replace_substring_regex(pc.utf8_lower(words), _ENDS, "")
    return low, pc.match_substring_regex(low, _LATIN).to_numpy(zero_copy_only=False)


# --- the character model ---------------------------------------------------


def character_counts(docs: DataFrame) -> DataFrame:
    """code, n: how often each character 4-gram occurs in the plain words of all texts.

    Each task sends its distinct 4-grams, of which an alphabet of 28 symbols
    allows a bounded number.
    """
    table = _symbols_of_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                words, at, _ = split_words(part.column(0))
                if not len(words):
                    continue
                low, plain = clean_words(words)
                n = np.bincount(at, minlength=len(words))[plain]
                line = "   ".join(low.filter(pa.array(plain)).to_pylist())
                s = table[np.frombuffer(f"   {line}   ".encode(), np.uint8)]
                s = s[s >= 0]
                start = np.concatenate([[False], (s[1:] != _EDGE) & (s[:-1] == _EDGE)])
                word = np.maximum(np.cumsum(start) - 1, 0)
                code = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
                if len(n):
                    # the word a 4-gram tells of: that of its last letter, or the one that just ended
                    total += np.bincount(code, n[word[3:]], SYMBOLS**4).astype(np.int64)
        code = np.flatnonzero(total)
        yield pa.record_batch([pa.array(code, pa.int32()), pa.array(total[code], pa.int64())], names=["code", "n"])

    counts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "code int, n long")
    return counts.groupBy("code").agg(F.sum("n").alias("n"))


def log_model(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log probability of a symbol after three others, backing off to shorter contexts."""
    count = np.zeros(SYMBOLS**4)
    count[code] = n
    count = count.reshape((SYMBOLS,) * 4)
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in (3, 2, 1, 0):
        c = count.sum(axis=tuple(range(order))) if order else count
        p = (c + 2.0 * p) / (c.sum(axis=-1, keepdims=True) + 2.0)
    return np.log(p).astype(np.float32)


class Restorer:
    """Viterbi readings of disguised tokens."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known: dict[str, tuple[str, ...]] = {}

    def options(self, c: str, again: bool) -> list[tuple[str, float]]:
        """What a character may stand for: a letter, '' (dropped) or ' ' (edge of a word), and at what cost."""
        if c.isalpha():
            return [(c, 0.0), *([("", COST_REPEAT)] if again else [])]
        out = [(x, COST_WILD if c in _WILD else COST_LEET) for x in LEET.get(c, "")]
        if c == " ":
            return [("", COST_DROP), (" ", 0.0)]
        return [*out, ("", COST_DROP_SIGN if out and c not in _WILD else COST_DROP), *([] if out else [(" ", 0.0)])]

    def decode(self, token: str) -> str:
        """The likeliest reading; words are parted by a space.

        The state is the last three symbols, so the search is exact and its
        cost is linear in the token's length.
        """
        model = self.model
        # a letter may be dropped where it repeats the one before in a run of three or more
        again = [any(token[i - k : i - k + 3] == c * 3 for k in (1, 2)) and token[i - 1 : i] == c for i, c in enumerate(token)]
        paths: dict[tuple[int, int, int], tuple[float, tuple]] = {(0, 0, 0): (0.0, ())}
        for c, repeats in zip(token, again, strict=True):
            choice = self.options(c, repeats)
            nxt: dict[tuple[int, int, int], tuple[float, tuple]] = {}
            for ctx, (score, path) in paths.items():
                for letter, cost in choice:
                    if letter == "":
                        to, s, way = ctx, score + cost, path
                    elif letter == " ":
                        if ctx[2] == _EDGE:
                            continue
                        to, s, way = (0, 0, 0), score + cost + float(model[ctx + (_EDGE,)]), (path, " ")
                    else:
                        k = _symbol(letter)
                        to, s, way = (ctx[1], ctx[2], k), score + cost + float(model[ctx + (k,)]), (path, letter)
                    if to not in nxt or s > nxt[to][0]:
                        nxt[to] = (s, way)
            paths = nxt or paths
        best = max(paths.items(), key=lambda kv: kv[1][0] + (float(model[kv[0] + (_EDGE,)]) if kv[0][2] else 0.0))[1][1]
        letters = []
        while best:
            best, letter = best
            letters.append(letter)
        return "".join(reversed(letters)).strip()

    def words(self, token: str) -> tuple[str, ...]:
        """The words a disguised token is read as; with repeated letters, also without any repetition."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            text = self.decode(token)
            once = re.sub(r"(\w)\1+", r"\1", text) if _THRICE.search(token) else ""
            found = self.known[token] = tuple(dict.fromkeys([*text.split(), *once.split()]))
        return found


def restored_pairs(texts: pa.Array, restorer: Restorer) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct restored words, and the (document, word) pairs that occur, each once."""
    words, at, ends = split_words(texts)
    docs = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    if not len(words):
        return words, docs, at
    low, plain = clean_words(words)
    thrice = plain & pc.match_substring_regex(low, r"aaa|bbb|ccc|ddd|eee|fff|ggg|hhh|iii|jjj|kkk|lll|mmm|nnn|ooo|ppp|qqq|rrr|sss|ttt|uuu|vvv|www|xxx|yyy|zzz").to_numpy(zero_copy_only=False)
    letter = pc.match_substring_regex(low, r"[a-zà-öø-ÿ]").to_numpy(zero_copy_only=False)
    odd = (letter & ~plain) | thrice
    base = low.to_pylist()
    vocabulary = list(base)
    more_doc, more_word = [], []
    place: dict[str, int] = {}

    def add(doc: np.ndarray, found: tuple[str, ...]) -> None:
        for w in found:
            k = place.get(w)
            if k is None:
                k = place[w] = len(vocabulary)
                vocabulary.append(w)
            more_doc.append(doc)
            more_word.append(np.full(len(doc), k))

    pair = np.unique(docs * len(words) + at)
    d, w = pair // len(words), pair % len(words)
    hit = odd[w]
    if hit.any():
        order = np.argsort(w[hit], kind="stable")
        dw, ww = d[hit][order], w[hit][order]
        cuts = np.flatnonzero(np.diff(ww)) + 1
        for group, word in zip(np.split(dw, cuts), ww[np.concatenate([[0], cuts])], strict=True):
            add(group, restorer.words(base[word]))
    # runs of single characters
    raw = pc.utf8_lower(words)
    single = (pc.utf8_length(raw).to_numpy(zero_copy_only=False) == 1)[at]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])) | np.concatenate([[0], np.diff(docs) != 0, [0]]))
    edge = np.concatenate([[0], edge, [len(at)]])
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if b - a >= SPREAD and single[a]:
            token = " ".join(raw.take(pa.array(at[a:b])).to_pylist())
            add(docs[a : a + 1], restorer.words(token))
    if more_doc:
        d, w = np.concatenate([d, *more_doc]), np.concatenate([w, *more_word])
    coded = pa.array(vocabulary, pa.large_string()).dictionary_encode()
    w = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[w]
    pair = np.unique(d * len(coded.dictionary) + w)
    return coded.dictionary, pair // len(coded.dictionary), pair % len(coded.dictionary)


#: Lengths of word beginnings that count as evidence, besides the whole word.
BEGINNINGS = (3, 4, 5, 6, 7, 8)


def features(words: pa.Array) -> list[pa.Array]:
    """For each word its features: itself, and its beginnings (null where there is none)."""
    n = pc.utf8_length(words)
    whole, head, colon, none = (pa.scalar(x, pa.large_string()) for x in ("w", "b", ":", None))
    out = [pc.if_else(pc.greater_equal(n, 3), pc.binary_join_element_wise(whole, words, colon), none)]
    for k in BEGINNINGS:
        start = pc.binary_join_element_wise(head, pc.utf8_slice_codeunits(words, 0, k), colon)
        out.append(pc.if_else(pc.greater(n, k), start, none))
    return out


# --- learning ---------------------------------------------------------------


#: Toxic labelled documents that a feature of the lexicon is in, at least.
LEAST_TOXIC = 3
#: Least lift, in nats, of a feature in the lexicon.
LEAST_LIFT = 1.0
#: What the curve is fitted on: a document's three strongest words and the log of all its weights.
MARKS = ("first", "second", "third", "total")


def lower_bound(hits: np.ndarray, n: np.ndarray, z: float = 2.6) -> np.ndarray:
    """Wilson's lower bound of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def evidence(sample: DataFrame, model) -> DataFrame:
    """feature, fold, toxic, n: in how many labelled documents of each fold a feature occurs.

    ``sample`` has ``text, label, fold``; at most FIT_ROWS rows by contract.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        for batch in batches:
            for part in slices(batch, 0):
                words, d, w = restored_pairs(part.column(0), restorer)
                if not len(words):
                    continue
                label, fold = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
                for kind in features(words):
                    coded = kind.dictionary_encode()
                    f = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[w]
                    pair = np.unique((d * (len(coded.dictionary) + 1) + f)[f >= 0])
                    dd, ff = pair // (len(coded.dictionary) + 1), pair % (len(coded.dictionary) + 1)
                    for k in (0, 1):
                        own = fold[dd] == k
                        n = np.bincount(ff[own], minlength=len(coded.dictionary))
                        t = np.bincount(ff[own], label[dd][own], len(coded.dictionary)).astype(np.int64)
                        some = np.flatnonzero(n)
                        yield pa.record_batch(
                            [coded.dictionary.take(pa.array(some)).cast(pa.string()), pa.array(np.full(len(some), k), pa.int32()),
                             pa.array(t[some], pa.int64()), pa.array(n[some].astype(np.int64), pa.int64())],
                            names=["feature", "fold", "toxic", "n"])

    found = sample.select("text", "label", "fold").mapInArrow(run, "feature string, fold int, toxic long, n long")
    return found.groupBy("feature", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def frequent(counts: DataFrame) -> DataFrame:
    """Both folds' rows of each feature that LEAST_TOXIC toxic documents of the two folds together have."""
    each = counts.groupBy("feature").agg(F.collect_list(F.struct("fold", "toxic", "n")).alias("folds"), F.sum("toxic").alias("toxic"))
    return each.where(F.col("toxic") >= LEAST_TOXIC).select("feature", F.inline("folds"))


def lexicon_of(counts, prior: float) -> dict[str, float]:
    """How far the log odds of toxicity, at the lower bound of its share, lie above the prior's; large ones only."""
    counts = counts[counts["toxic"] >= LEAST_TOXIC]
    if not len(counts) or not 0 < prior < 1:
        return {}
    low = lower_bound(counts["toxic"].to_numpy(float), counts["n"].to_numpy(float))
    low = np.clip(low, 1e-6, 1 - 1e-6)
    lift = np.log(low / (1 - low)) - math.log(prior / (1 - prior))
    keep = lift >= LEAST_LIFT
    return dict(zip(counts["feature"][keep], lift[keep], strict=True))


def weigh(docs: DataFrame, lexicon, model, extra: list[str]) -> DataFrame:
    """MARKS of each document, from its distinct restored words; narrow, one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        names, weights = lexicon.value
        known, weight = pa.array(names, pa.large_string()), np.append(weights, 0.0)
        for batch in batches:
            for part in slices(batch, 0):
                words, d, w = restored_pairs(part.column(0), restorer)
                marks = np.zeros((part.num_rows, len(MARKS)))
                if len(words):
                    best = np.zeros(len(words))
                    for kind in features(words):
                        at = pc.fill_null(pc.index_in(kind, value_set=known), -1).to_numpy(zero_copy_only=False)
                        best = np.maximum(best, weight[at])
                    some = best[w] > 0
                    d, x = d[some], best[w[some]]
                    order = np.lexsort((-x, d))
                    d, x = d[order], x[order]
                    rank = np.arange(len(d)) - np.searchsorted(d, d)
                    for k in range(3):
                        marks[d[rank == k], k] = x[rank == k]
                    marks[:, 3] = np.log1p(np.bincount(d, x, part.num_rows))
                yield pa.record_batch([*part.columns[1:], *map(pa.array, marks.T.copy())], names=[*extra, *MARKS])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in extra), *(f"{c} double" for c in MARKS)])
    return docs.select("text", *extra).mapInArrow(run, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + l2 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted and the evidence (MARKS).

    Input: ``doc_id, text`` and labels with ``doc_id, toxic``; other columns
    are ignored.  Labels are learned only from documents whose
    ``crc32(doc_id as text) mod 5`` is not 0, and from at most ``fit_rows`` of
    them, chosen by hash; the character model counts all texts.  Null and empty
    texts have no evidence and get the score of a document without any; a null
    id is not held out.  A document with several labels counts as toxic if one
    says so, null labels are left out.  Without labels, or with labels of one
    kind only, every score is about the share of toxic labels.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    some = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bucket = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)), F.lit(1)).cast("int")
    grams = character_counts(some).toPandas()
    model = sc.broadcast(log_model(grams["code"].to_numpy(), grams["n"].to_numpy()))

    chosen = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = chosen.where(bucket != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    chosen = materialise(chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")), "chosen")
    sample = materialise(some.join(F.broadcast(chosen), "doc_id").select("text", "label", "fold"), "sample")
    counts = frequent(evidence(sample, model)).toPandas()
    seen = sample.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("t")).toPandas()
    prior = float(seen["t"].sum() / max(1, seen["n"].sum())) if len(seen) else 0.0

    def shared(part) -> object:
        found = lexicon_of(part.groupby("feature", as_index=False)[["toxic", "n"]].sum(), prior)
        names = sorted(found)
        return sc.broadcast((names, np.array([found[f] for f in names], float)))

    # Weights for the curve come from the other fold's lexicon, so they are as good as on new documents.
    x, y = [], []
    if 0 < prior < 1:
        for fold in (0, 1):
            other = shared(counts[counts["fold"] == 1 - fold])
            own = weigh(sample.where(F.col("fold") == fold), other, model, ["label"]).toPandas()
            x.append(own[list(MARKS)].to_numpy())
            y.append(own["label"].to_numpy(float))
    if x:
        curve = fit_logistic(np.vstack(x), np.concatenate(y))
    else:
        curve = np.array([0.0] * len(MARKS) + [math.log((prior + 1e-3) / (1 - prior + 1e-3))])
    lexicon = shared(counts)
    weighed = weigh(some.withColumn("held_out", bucket == 0), lexicon, model, ["doc_id", "held_out"])
    z = sum((F.lit(float(c)) * F.col(m) for c, m in zip(curve, MARKS, strict=False)), F.lit(float(curve[-1])))
    score = 1 / (1 + F.exp(-z))
    return weighed.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), *MARKS)
