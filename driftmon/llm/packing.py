"""Best-fit packing of tokenised documents into sequences of a fixed length.

Tokenising is one narrow pass over the texts that leaves a few numbers per
piece.  The pieces are dealt by hash over bounded groups, and each group is a
stream in hash order, packed online: a fixed number of open sequences, kept in
a bitset keyed by free space, so the best fit is the lowest set bit at or above
the piece's length.  When too many are open the fullest closes first.  The
stream is read through a look-ahead of a fixed number of pieces, the longest of
them first, which saves about one sequence in a hundred.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmon.llm.common import materialise, parts_for
from driftmon.llm.words import slices, split_words

SEQUENCE = 2048
#: Id that ends every document.
END = 0
#: Sequences that one group holds open.
OPEN = 512
#: Pieces that are read ahead.
AHEAD = 1024
#: Pieces that one group packs, about.
GROUP = 65536
#: Punctuation that the tokenizer always parts from letters before it.
_MARKS = ".,!*&%$#|?;:"
_LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_HEAD = "^[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: Bytes of distinct units, with their ids, that a worker remembers, about; and what one takes besides its letters and ids.
_CACHE, _EACH = 64_000_000, 200
#: Bytes of text that are cut into ids at a time.
SLICE = 4_000_000
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
])


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a byte as a printable letter: itself, or the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts, looked up word by word.

    The tokenizer drops white space and never joins across it, so a text's ids
    are its words' ids in a row.  A word of Latin letters and trailing marks is
    two tokens of the pre-tokenizer, so it is looked up as lower-cased letters,
    straight from the BPE model, and marks; every other word goes through the
    whole tokenizer.  The Python loop runs over distinct units of a batch only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def units(self, distinct: pa.Array, make) -> list[bytes]:
        known, out = self.known, []
        if self.held > _CACHE:
            known.clear()
            self.held = 0
        for key in distinct.to_pylist():
            ids = known.get(key)
            if ids is None:
                ids = known[key] = make(key)
                self.held += _EACH + len(key) + len(ids)
            out.append(ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids end."""
        words, at, ends = split_words(texts)
        core = pc.utf8_rtrim(words, characters=_MARKS)
        plain = pc.match_substring_regex(core, _LATIN)
        marked = pc.and_(plain, pc.not_equal(pc.binary_length(core), pc.binary_length(words)))
        head = pc.if_else(plain, pc.utf8_lower(core), "").dictionary_encode()
        tail = pc.if_else(marked, pc.replace_substring_regex(words, _HEAD, ""), pc.if_else(plain, "", words)).dictionary_encode()
        per = self.units(head.dictionary, self._letters) + self.units(tail.dictionary, self._whole)
        flat = np.frombuffer(b"".join(per), "<u4")
        size = np.fromiter(map(len, per), np.int64, len(per)) // 4
        begin = np.cumsum(size) - size
        unit = np.empty((len(at), 2), np.int64)
        unit[:, 0] = head.indices.to_numpy()[at]
        unit[:, 1] = tail.indices.to_numpy()[at] + len(head.dictionary)
        unit = unit.reshape(-1)
        n = size[unit]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[unit] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, upto[2 * ends]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process; its word cache outlives the task."""
    return _TOKENIZERS.setdefault(path, None) or _TOKENIZERS.__setitem__(path, WordTokenizer(path)) or _TOKENIZERS[path]


def token_pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A document is its text's ids, then ``END``; null text counts as empty.
    Only longer ones are cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                ids, ends = own.encode(part.column(1))
                ids = np.insert(ids, ends, END).astype("<u4")
                ends = ends + np.arange(1, len(ends) + 1)
                rows, begin, doc_ids = [], 0, part.column(0).to_pylist()
                view = memoryview(ids.tobytes())
                for doc, end in zip(doc_ids, ends.tolist(), strict=True):
                    for k, a in enumerate(range(begin, end, sequence)):
                        b = min(a + sequence, end)
                        rows.append((doc, k, a - begin, b - a, zlib.crc32(view[4 * a : 4 * b])))
                    begin = end
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)
        pa.default_memory_pool().release_unused()  # the worker lives on through later stages

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: list[int], sequence: int = SEQUENCE, open_most: int = OPEN) -> tuple[list[int], list[int], int]:
    """The bin and the offset of each piece, packed online in the given order, and how many bins were closed unfilled."""
    free_bits, by_free, n_open, bins, closed = 0, {}, 0, 0, 0
    where, offset = [], []
    for length in lengths:
        fits = free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            same = by_free[free]
            b = same.pop()
            if not same:
                free_bits &= ~(1 << free)
        else:
            if n_open >= open_most:  # the fullest closes
                fullest = (free_bits & -free_bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    free_bits &= ~(1 << fullest)
                n_open -= 1
                closed += 1
            b, free = bins, sequence
            bins += 1
            n_open += 1
        where.append(b)
        offset.append(sequence - free)
        left = free - length
        if left:
            by_free.setdefault(left, []).append(b)
            free_bits |= 1 << left
        else:
            n_open -= 1
    return where, offset, closed


def read_ahead(pieces: pa.Table, ahead: int = AHEAD) -> pa.Table:
    """The stream of ``pieces`` (by ``dealt``), each run of ``ahead`` of them with the longest first."""
    stream = pieces.sort_by([("dealt", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
    runs = stream.append_column("run", pa.array(np.arange(len(stream)) // ahead))
    return runs.sort_by([("run", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]).drop_columns(["run"])


def pack_documents(docs: DataFrame, path: str, sequence: int = SEQUENCE, open_most: int = OPEN, ahead: int = AHEAD,
                   group: int = GROUP) -> DataFrame:
    """Every piece of every document, with its sequence and its place there.

    Input: ``doc_id`` and ``text``; other columns are ignored.  Output, one row
    per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``.  A null or empty text is one piece of one id.  Repeated rows are
    packed one by one.  An empty table gives an empty result.
    """
    pieces = materialise(token_pieces(docs, path, sequence), "pieces")
    groups = parts_for(pieces.count(), group)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = read_ahead(table, ahead)
        where, offset, _ = best_fit(table["length"].to_pylist(), sequence, open_most)
        ids = pa.array(np.array(where, np.int64) + (key[0].as_py() << 32), pa.int64())
        return table.drop_columns(["group", "dealt"]).append_column("sequence_id", ids).append_column("offset", pa.array(offset, pa.int64()))

    dealt = pieces.withColumn("dealt", F.xxhash64("doc_id", "piece", "ids_crc32"))
    dealt = dealt.withColumn("group", F.pmod("dealt", F.lit(groups)).cast("long"))
    return dealt.groupBy("group").applyInArrow(
        pack, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
