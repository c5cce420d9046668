"""N-gram Jaccard join by rare-first prefix filtering.

Documents with the same set of word n-grams are one class.  A class posts only
its prefix: so many of its rarest n-grams that two sets alike enough must share
one of them.  Rarity is told by a sketch of fixed size, which counts a class
once a task: it sets apart what is common in the corpus, at every size of it.
Classes that meet on a prefix n-gram pass a length filter, a positional filter
and a suffix filter (the parities of their n-grams in fixed parts of the hash
space: every odd one out is an n-gram that the sets do not share) before a pair
is verified on the whole sets, made again from the two texts.

Only components are asked for, so pairs inside a known component need no check.
First every class meets one leader that most of its lists propose; what that
links is one component, and lists that still hold several propose other leaders.
Then every pair of classes that share a list and not a component, and that pass
all filters, is verified, so no link between components is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmon.llm.common import materialise, without
from driftmon.llm.components import connected_components
from driftmon.llm.words import slices, split_words

#: Defaults of near-duplicate work; (80, 100) is a similarity of 0.8.
WORDS, ALIKE = 5, (80, 100)
#: Counters of the frequency sketch (a broadcast of one byte each).
COUNTERS = 1 << 21
#: Counters, or bits of a filter, in one part on the way to the driver.
PART = 1 << 18
#: Classes that a task remembers as counted, at most; it forgets them all beyond.
REMEMBERED = 200_000
#: Parts of the hash space whose parities the suffix filter compares, and their 64-bit words; a pair's second look has
#: two parts for each n-gram, up to a bound.
PARTS, MOST_PARTS = 512, 1 << 20
_ROW = PARTS // 64
#: Rounds of leaders before all remaining pairs are checked, and leaders that a list proposes in a round.
ROUNDS, LEADERS = 2, 4
#: Postings of one list that are looked at together, at most; longer lists are split into blocks that meet each other.
LONGEST = 4_096
#: Members that a leader meets in one task, about.
MEMBERS = 1_000
#: Bits of the filter that finds texts again for each class, and their bounds (a broadcast).
BITS, FEWEST_BITS, MOST_BITS = 16, 1 << 20, 1 << 27
#: Bytes of text that are cut into words at a time.
SLICE = 3_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word n-grams in a row, and where each text's end.

    A text with fewer words has its whole sequence as one; without words none.
    """
    distinct, at, ends = split_words(texts)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, pc.ascii_lower(distinct).to_pylist()), np.uint64, len(distinct))
    w = own[at]
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    n = ends - begin
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    h = np.zeros(len(w), np.uint64)
    if len(w) >= words:
        full = w[: len(w) - words + 1].copy()
        for k in range(1, words):
            full = full * _BASE + w[k : len(w) - words + 1 + k]
        h[: len(full)] = full + np.uint64(words)
    for d in np.flatnonzero((n > 0) & (n < words)):
        short = 0
        for x in w[begin[d] : ends[d]].tolist():
            short = (short * int(_BASE) + x) % (1 << 64)
        h[begin[d]] = (short + int(n[d])) % (1 << 64)
    upto = np.cumsum(count)
    pick = np.repeat(begin - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)
    return _mix(h[pick]), upto


def _distinct(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each text's distinct n-grams, sorted."""
    h, upto = ngram_hashes(texts, words)
    begin = 0
    for end in upto.tolist():
        one = np.sort(h[begin:end])
        if len(one) > 1:
            one = one[np.concatenate([[True], one[1:] != one[:-1]])]
        yield one
        begin = end


def _set_key(one: np.ndarray) -> bytes:
    return hashlib.blake2b(one.tobytes(), digest_size=16).digest()


def prefix_length(n: int, alike: tuple[int, int]) -> int:
    num, den = alike
    return n - -(-num * n // den) + 1 if n else 0


def class_features(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, set_key of each document; and rows of chunk, part: how many classes have the n-grams of each counter.

    One pass makes both.  A task counts a class once, however many copies it sees.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(COUNTERS, np.uint32), set()
        names = ["doc_id", "n", "set_key", "chunk", "part"]
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                n, key, new = [], [], []
                for one in _distinct(part.column(1), words):
                    n.append(len(one))
                    key.append(_set_key(one))
                    if key[-1] not in seen:
                        seen.add(key[-1])
                        new.append(one)
                if new:
                    total += np.bincount((np.concatenate(new) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
                if len(seen) > REMEMBERED:
                    seen.clear()
                none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), *none], names=names)
        parts = [zlib.compress(total[k : k + PART].tobytes(), 1) for k in range(0, COUNTERS, PART) if total[k : k + PART].any()]
        chunks = [k // PART for k in range(0, COUNTERS, PART) if total[k : k + PART].any()]
        none = (pa.nulls(len(parts), k) for k in (pa.int64(), pa.int64(), pa.binary()))
        yield pa.record_batch([*none, pa.array(chunks, pa.int32()), pa.array(parts, pa.binary())], names=names)
        pa.default_memory_pool().release_unused()  # the worker lives on through later stages

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, set_key binary, chunk int, part binary")


def levels(features: DataFrame) -> bytes:
    """The sketch's counters in quarter powers of two, one byte each."""

    def add(parts: Iterator[bytes]) -> bytes:
        total = np.zeros(PART, np.int64)
        for p in parts:
            total += np.frombuffer(p, np.uint32)
        return np.minimum(np.floor(4 * np.log2(total + 1)), 255).astype(np.uint8).tobytes()

    return _together(features.where("chunk is not null").select("chunk", "part"), add, COUNTERS // PART)


def _power(wanted: int, fewest: int, most: int) -> int:
    n = fewest
    while n < min(wanted, most):
        n *= 2
    return n


def _slot(doc_id: int | None, bits: int) -> int:
    return 0 if doc_id is None else xxhash.xxh3_64_intdigest(doc_id.to_bytes(8, "little", signed=True)) % bits


def _together(parts: DataFrame, add, size: int) -> bytes:
    """One array from ``parts (chunk, part)``: the parts of a chunk are added in Spark, the driver lays chunks in a row."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = add(zlib.decompress(x.as_py()) for batch in batches for x in batch.column("part"))
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([done], pa.binary())], names=["chunk", "part"])

    found = parts.groupBy("chunk").applyInArrow(run, "chunk int, part binary").collect()
    chunks = {r["chunk"]: bytes(r["part"]) for r in found}
    one = len(next(iter(chunks.values()))) if chunks else 0
    return b"".join(chunks.get(k, bytes(one)) for k in range(size)) if one else b""


def id_filter(ids: DataFrame, n: int) -> tuple[int, bytes]:
    """A filter of bounded size on ``doc_id``: its bits, and how many they are."""
    bits = _power(n * BITS, FEWEST_BITS, MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            own[[_slot(d, bits) for d in batch.column(0).to_pylist()]] = True
        for k in range(0, bits, PART):
            if own[k : k + PART].any():
                part = zlib.compress(np.packbits(own[k : k + PART], bitorder="little").tobytes(), 1)
                yield pa.record_batch([pa.array([k // PART], pa.int32()), pa.array([part], pa.binary())], names=["chunk", "part"])

    def add(parts: Iterator[bytes]) -> bytes:
        total = np.zeros(PART // 8, np.uint8)
        for p in parts:
            total |= np.frombuffer(p, np.uint8)
        return total.tobytes()

    return bits, _together(ids.select("doc_id").mapInArrow(run, "chunk int, part binary"), add, bits // PART)


def _chosen(batch: pa.RecordBatch, wanted: tuple[int, bytes]) -> pa.RecordBatch:
    """The rows of ``batch`` (doc_id, text) whose id passes the filter."""
    bits, own = wanted[0], np.frombuffer(wanted[1], np.uint8)
    if not len(own):
        return batch.slice(0, 0)
    slot = np.array([_slot(d, bits) for d in batch.column(0).to_pylist()], np.int64)
    return batch.filter(pa.array((own[slot >> 3] >> (slot & 7)) & 1 == 1, pa.bool_()))


def _parities(one: np.ndarray) -> np.ndarray:
    """0 or 1 for each part of the hash space: whether it has an odd number of the n-grams."""
    parts = _power(2 * len(one), PARTS, MOST_PARTS)
    return (np.bincount((one & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1).astype(np.uint8)


def _folded(odd: np.ndarray, parts: int) -> np.ndarray:
    """The same parities in fewer parts."""
    return np.bitwise_xor.reduce(odd.reshape(-1, parts), axis=0)


def looked_at(pairs: DataFrame, about: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that the suffix filter still lets through with as many parts as the sets are long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_numpy() for k in (2, 3))
            most = na + nb - 2 * _needed(na, nb, alike)
            ok = []
            for x, y, apart in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most.tolist(), strict=True):
                one, two = (np.unpackbits(np.frombuffer(v, np.uint8)) for v in (x, y))
                parts = min(len(one), len(two))
                ok.append(int((_folded(one, parts) ^ _folded(two, parts)).sum()) <= apart)
            some = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.record_batch([some.column(0), some.column(1)], names=["a", "b"])

    sides = [about.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("wide").alias(f"wide{k}")) for k in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "widea", "wideb")
    return both.mapInArrow(run, "a long, b long")


def class_prefixes(docs: DataFrame, wanted, level, words: int, alike: tuple[int, int]) -> DataFrame:
    """set_key, doc_id, prefix (rarest first), parity, wide (the same in more parts) of the documents that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(level.value, np.uint8)
        for batch in batches:
            for part in slices(_chosen(batch, wanted.value), 1, SLICE):
                key, prefix, parity, wide = [], [], [], []
                for one in _distinct(part.column(1), words):
                    rare = own[(one & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    order = np.argsort(rare, kind="stable")[: prefix_length(len(one), alike)]
                    key.append(_set_key(one))
                    prefix.append(one[order].view(np.int64))
                    odd = _parities(one)
                    wide.append(np.packbits(odd).tobytes())
                    parity.append(np.packbits(_folded(odd, PARTS)).tobytes())
                yield pa.record_batch([pa.array(key, pa.binary()), part.column(0), pa.array(prefix, pa.list_(pa.int64())), pa.array(parity, pa.binary()),
                                       pa.array(wide, pa.binary())], names=["set_key", "doc_id", "prefix", "parity", "wide"])
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, "set_key binary, doc_id long, prefix array<long>, parity binary, wide binary")


def shared_postings(prefixes: DataFrame) -> DataFrame:
    """token, rep, n, pos of the prefix n-grams that were posted more than once; one shuffle of narrow rows."""
    posted = prefixes.select("rep", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "rep", "n", F.col("pos").cast("long").alias("pos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, long = 0, None  # long: the token of a list too long to hold, whose postings go straight on
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 100_000:
                continue
            table = pa.Table.from_batches(held)
            token = table.column(0).to_numpy()
            until = int(np.searchsorted(token, token[-1]))
            yield from _shared(table.slice(0, until), token[:until], long)
            long = token[-1] if until == 0 or token[-1] == long else None
            rest = table.slice(until)
            if long is not None or rest.num_rows >= 100_000:
                long = token[-1]
                yield from rest.to_batches()
                rest = rest.slice(rest.num_rows)
            held, rows = rest.to_batches(), rest.num_rows
        if rows:
            table = pa.Table.from_batches(held)
            yield from _shared(table, table.column(0).to_numpy(), long)

    return posted.repartition("token").sortWithinPartitions("token").mapInArrow(run, "token long, rep long, n long, pos long")


def _shared(table: pa.Table, token: np.ndarray, long) -> list[pa.RecordBatch]:
    if not len(token):
        return []
    same = token[1:] == token[:-1]
    keep = np.concatenate([[token[0] == long], same]) | np.concatenate([same, [False]])
    return table.filter(pa.array(keep)).to_batches()


def class_texts(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """rep, text of each of ``classes (rep, set_key, doc_id)``.

    The texts are found again by a filter of bounded size on the ids; what it
    lets through by chance falls out in the join.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(id_filter(classes, classes.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(_chosen(batch, wanted.value), 1, SLICE):
                key = [_set_key(one) for one in _distinct(part.column(1), words)]
                yield pa.record_batch([pa.array(key, pa.binary()), part.column(0), part.column(1).cast(pa.string())], names=["set_key", "doc_id", "text"])

    found = docs.select("doc_id", "text").mapInArrow(run, "set_key binary, doc_id long, text string")
    same = (F.col("set_key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id"))
    named = classes.select("rep", F.col("set_key").alias("own_key"), F.col("doc_id").alias("own_id"))
    return found.join(named, same).dropDuplicates(["rep"]).select("rep", "text")


def _needed(na: np.ndarray, nb: np.ndarray, alike: tuple[int, int]) -> np.ndarray:
    num, den = alike
    return -(-num * (na + nb) // (num + den))


def _could_link(rows: dict, a: np.ndarray, b: np.ndarray, alike: tuple[int, int]) -> np.ndarray:
    """Which postings at ``a`` and ``b`` are of different components and pass the length, positional and suffix filters."""
    num, den = alike
    n, pos = rows["n"], rows["pos"]
    na, nb = n[a], n[b]
    ok = (rows["label"][a] != rows["label"][b]) & (den * np.minimum(na, nb) >= num * np.maximum(na, nb))
    need = _needed(na, nb, alike)
    ok &= np.minimum(pos[a], pos[b]) + np.minimum(na - pos[a], nb - pos[b]) >= need
    some = np.flatnonzero(ok)
    for k in range(0, len(some), 20_000):
        at = some[k : k + 20_000]
        apart = np.bitwise_count(rows["parity"][a[at]] ^ rows["parity"][b[at]]).sum(1, dtype=np.int64)
        ok[at] = apart <= na[at] + nb[at] - 2 * need[at]
    return ok


def _proposals(rows: dict, begin: np.ndarray, size: np.ndarray, alike: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of (leader, member): a list's first posting leads, those that may link with it follow, the rest go on."""
    left = np.arange(int(size.sum()))
    of = np.repeat(np.arange(len(size)), size)
    for _ in range(LEADERS):
        first = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
        leader = left[first][np.cumsum(first) - 1] if len(of) else left
        member = ~first
        ok = np.zeros(len(left), bool)
        ok[member] = _could_link(rows, leader[member], left[member], alike)
        yield leader[ok], left[ok]
        rest = member & ~ok
        left, of = left[rest], of[rest]
        if not len(left):
            return


def _all_pairs(rows: dict, begin: np.ndarray, size: np.ndarray, alike: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of a list that may link."""
    end = np.repeat(begin + size, size)
    at = np.arange(len(end))
    step = 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            return
        ok = _could_link(rows, at, at + step, alike)
        if ok.any():
            yield at[ok], at[ok] + step
        step += 1


def meetings(lists: DataFrame, alike: tuple[int, int], leaders: int | None) -> DataFrame:
    """a, b, k: classes of different components that pass all filters on ``k`` of the lists they share.

    ``lists`` has token, rep, n, pos, label, parity, central.  With ``leaders``
    (the round's number) a list proposes a few leaders, and each member goes to
    the first it may link with; else all pairs.  All lists have the same order:
    the most central classes first, in later rounds by hash.
    """
    sizes = lists.groupBy("token").agg(F.ceil(F.count("*") / LONGEST).cast("int").alias("blocks")).where("blocks > 1")
    sizes = materialise(sizes, "long-lists")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(block, o) * F.col("blocks") + F.greatest(block, o))
    cell = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(meet)).alias("cell")
    turn = F.xxhash64(F.lit(leaders or 0), "rep")
    if not leaders:
        turn = F.shiftleft(-F.col("central"), 40) + turn.bitwiseAND(F.lit((1 << 40) - 1))
    placed = lists.join(sizes, "token", "left").select("token", cell, "rep", "n", "pos", "label", "parity", turn.alias("turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 100_000:
                found, rest = _meet(held, False)
                yield from found
                held, rows = [rest], rest.num_rows
        if held:
            yield from _meet(held, True)[0]

    def _meet(held: list[pa.RecordBatch], last: bool) -> tuple[list[pa.RecordBatch], pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        batch = table.to_batches()[0] if table.num_rows else held[0]
        col = {name: batch.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(batch.schema.names) if name != "parity"}
        new = np.concatenate([[True], (np.diff(col["token"]) != 0) | (np.diff(col["cell"]) != 0)])[: batch.num_rows]
        begin = np.flatnonzero(new)
        until = batch.num_rows if last or not len(begin) else int(begin[-1])
        begin = begin if last else begin[:-1]
        if not len(begin):
            return [], batch.slice(until)
        own = {name: c[:until] for name, c in col.items()}
        parity = batch.column(batch.schema.get_field_index("parity")).slice(0, until)
        own["parity"] = np.frombuffer(b"".join(parity.to_pylist()), np.uint64).reshape(-1, _ROW)
        size = np.diff(np.append(begin, until))
        find = _all_pairs if leaders is None else _proposals
        pairs = [(own["rep"][a], own["rep"][b]) for a, b in find(own, begin, size, alike) if len(a)]
        if not pairs:
            return [], batch.slice(until)
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if leaders is None:
            a, b = np.minimum(a, b), np.maximum(a, b)
        pair, k = np.unique(np.stack([a, b], 1), axis=0, return_counts=True)
        return [pa.record_batch([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(k)], names=["a", "b", "k"])], batch.slice(until)

    found = placed.repartition("token", "cell").sortWithinPartitions("token", "cell", "turn", "rep").mapInArrow(run, "a long, b long, k long")
    return found.groupBy("a", "b").agg(F.sum("k").alias("k"))


def verified(pairs: DataFrame, texts: DataFrame, words: int, alike: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that are alike, on the whole sets of their ``texts (rep, text)``.

    A leader's text goes once to each task that verifies some of its pairs.
    """
    num, den = alike
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    dealt = pairs.select("a", "b").join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    members = dealt.join(texts.withColumnRenamed("rep", "b"), "b").select("a", "part", F.lit(1).alias("kind"), "b", "text")
    heads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts.withColumnRenamed("rep", "a"), "a")
    heads = heads.select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            for some in slices(batch, 4, SLICE):
                a, b = [], []
                for one, x, kind, y in zip(_distinct(some.column(4), words), *(some.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                    if kind == 0:
                        own = one
                        continue
                    both = np.sort(np.concatenate([own, one]), kind="stable")
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    if den * shared >= num * (len(own) + len(one) - shared):
                        a.append(x)
                        b.append(y)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = heads.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    return dealt.mapInArrow(run, "a long, b long")


def class_links(docs: DataFrame, features: DataFrame, reps: DataFrame, words: int, alike: tuple[int, int]) -> DataFrame | None:
    """Component labels ``node, label`` of the classes that are linked with another; None if there are none."""
    sc = docs.sparkSession.sparkContext
    n = reps.count()
    if not n:
        return None
    wanted, level = sc.broadcast(id_filter(reps, n)), sc.broadcast(levels(features))
    same = (F.col("set_key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id"))
    named = reps.select("rep", "n", F.col("set_key").alias("own_key"), F.col("doc_id").alias("own_id"))
    prefixes = class_prefixes(docs, wanted, level, words, alike).join(named, same)
    prefixes = materialise(prefixes.select("rep", "n", "prefix", "parity", "wide"), "prefixes")
    live = materialise(shared_postings(prefixes), "lists")
    # a class of whose prefix much is shared is likely to be what others were copied from
    central = live.groupBy("rep").agg(F.count("*").alias("k"))
    about = prefixes.dropDuplicates(["rep"]).join(central, "rep").select("rep", "n", "parity", "wide", F.floor(F.lit(1000) * F.col("k") / F.size("prefix")).cast("long").alias("central"))
    about = materialise(about, "about")
    lists = live.withColumn("label", F.col("rep"))
    links = labels = None
    for turn in (*range(ROUNDS), None):
        met = meetings(lists.join(about.select("rep", "parity", "central"), "rep"), alike, turn)
        if turn is not None:  # one leader for each class, the one that most of its lists propose
            met = met.groupBy("b").agg(F.max(F.struct("k", F.xxhash64("a").alias("rank"), "a")).alias("best")).select("best.a", "b")
        pairs = materialise(looked_at(met.select("a", "b"), about, alike), "pairs")
        if not pairs.isEmpty():
            some = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
            texts = materialise(class_texts(docs, materialise(reps.join(some, "rep", "left_semi"), "met"), words), "texts")
            new = materialise(verified(pairs, texts, words, alike), "links")
            links = new if links is None else links.unionByName(new)
            labels = materialise(connected_components(links), "components")
            if turn is not None:
                of = labels.select(F.col("node").alias("rep"), F.col("label").alias("now"))
                own = lists.join(of, "rep", "left").withColumn("label", F.coalesce("now", "rep")).drop("now")
                mixed = own.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
                lists = materialise(own.join(mixed, "token", "left_semi"), "lists")
    return labels


def jaccard_components(docs: DataFrame, words: int = WORDS, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """Which documents hang together by links of like n-gram sets.

    Input: ``doc_id`` and ``text``; other columns are ignored.  Words are runs
    of non-white-space, lower-cased in A-Z; a document's set has its distinct
    n-grams of ``words`` words, a shorter document's its whole sequence.  Two
    documents link when the intersection is at least ``alike[0] / alike[1]`` of
    the union.  Output, one row per input row: ``doc_id, n_shingles,
    component_id`` (the least ``doc_id`` reachable).  Null and empty texts have
    empty sets and link with nothing, their ``component_id`` is their own id.
    Repeated rows link with each other; rows without an id take part and have
    the component's least id, null if no row has one.  An empty table gives an
    empty result.
    """
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = materialise(class_features(some, words).withColumn("row", F.monotonically_increasing_id()), "features")
    features = made.where("chunk is null")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    reps = features.where("n > 0").groupBy("set_key", "n").agg(best.alias("best"))
    reps = materialise(reps.select("set_key", "n", F.col("best.row").alias("rep"), F.col("best.doc_id").alias("doc_id")), "classes")
    labels = class_links(some, made, reps, words, alike)
    reps = reps.withColumnRenamed("doc_id", "least")
    if labels is not None:
        reps = reps.join(labels, F.col("rep") == F.col("node"), "left").withColumn("rep", F.coalesce("label", "rep"))
    least = materialise(reps.groupBy("rep").agg(F.min("least").alias("component_id")), "least")
    of = materialise(reps.select("set_key", "rep").join(least, "rep").select("set_key", "component_id"), "of-class")
    rows = features.select("doc_id", F.col("n").alias("n_shingles"), "set_key")
    joined = rows.join(of, "set_key", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, alike: tuple[int, int] = ALIKE) -> DataFrame:
    """The rows of ``docs`` with the least ``doc_id`` of their component, with all their columns, whatever their names.

    Rows without an id stay; of an id that occurs in several rows, all or none do.
    """
    gone = jaccard_components(docs, words, alike).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return without(docs, materialise(gone, "near-copies"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g
  FROM w
), c AS (
  SELECT list_sort(g) AS g, min(doc_id) AS rep, len(list_sort(g)) AS n FROM s WHERE len(g) > 0 GROUP BY list_sort(g)
), p AS (
  SELECT rep, n, unnest(g) AS t FROM c
), f AS (
  SELECT t FROM p GROUP BY t HAVING count(*) > 1
), j AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM p a JOIN p b ON a.t = b.t AND a.rep < b.rep SEMI JOIN f ON a.t = f.t
  GROUP BY a.rep, b.rep, a.n, b.n
), e AS (
  SELECT a, b FROM j WHERE 100 * k >= 85 * (na + nb - k)
), d AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(x, y) AS (
  SELECT rep, rep FROM c
  UNION
  SELECT r.x, d.b FROM r JOIN d ON r.y = d.a
), m AS (
  SELECT x, min(y) AS component_id FROM r GROUP BY x
)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON list_sort(s.g) = c.g AND len(s.g) > 0 LEFT JOIN m ON m.x = c.rep
"""
