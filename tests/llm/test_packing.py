import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from driftmon.llm.packing import WordTokenizer, best_fit, pack_documents, read_ahead, token_pieces
from driftmon.llm.queries import word_bpe_path

from .conftest import MESSY

ODD = ["don't we'll it's--ok <|endoftext|>x áb  z\x0b\x0cq İstanbul ÇA \x1c1 2.0   é Straße!!! 'S", "", None, "a" * 3000,
       "it's,the (the) x1y2 ... ;; 日本語 naïve b ǅ Ωσς.", "A*B&C|D#E$F%G", "ﬁ Å K", "﻿zero", "ẍy"]


def test_ids_equal_the_tokenizer():
    own, real = WordTokenizer(word_bpe_path()), Tokenizer.from_file(word_bpe_path())
    ids, ends = own.encode(pa.array(ODD))
    begin = 0
    for text, end in zip(ODD, ends.tolist(), strict=True):
        assert ids[begin:end].tolist() == real.encode(text or "", add_special_tokens=False).ids, text
        begin = end


def check_packing(rows, out):
    real = Tokenizer.from_file(word_bpe_path())
    want = []
    for i, t, *_ in rows:
        ids = np.array([*real.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want.append((i, k, a, len(part), zlib.crc32(part.tobytes())))
    assert sorted(want, key=repr) == sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=repr)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_messy_and_empty(messy, no_docs):
    out = pack_documents(messy, word_bpe_path()).collect()
    check_packing(MESSY, out)
    assert pack_documents(no_docs, word_bpe_path()).count() == 0


def test_whole_table_is_packed_tightly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = pack_documents(docs, word_bpe_path()).collect()
    used = check_packing([(r.doc_id, r.text) for r in docs.collect()], out)
    assert used <= 1.05 * sum(r.length for r in out) / 2048 + 1


def test_best_fit_bounds_open_bins():
    random.seed(4)
    lengths = [random.randrange(1, 2049) for _ in range(3000)]
    for limit in (1, 16, 512):
        where, offset, _ = best_fit(lengths, 2048, limit)
        full, last = {}, {}
        for k, (b, o, n) in enumerate(zip(where, offset, lengths, strict=True)):
            assert full.get(b, 0) == o and o + n <= 2048
            full[b] = o + n
            last[b] = k
        for k in range(len(where)):
            # bins that still get pieces later, and have some, are open
            assert k % 100 or sum(1 for b in last if last[b] > k and b in where[: k + 1]) <= limit


def test_stream_of_documents_closes_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.piece, r.length) for r in token_pieces(docs, word_bpe_path()).collect()]
    rng = np.random.default_rng(3)
    table = pa.table({"doc_id": [d for d, _, _ in rows], "piece": [p for _, p, _ in rows], "length": [n for _, _, n in rows],
                      "dealt": rng.integers(-(1 << 62), 1 << 62, len(rows))})
    least = sum(n for _, _, n in rows) / 2048
    for ahead, most, slack in ((1, 16, 1.08), (64, 32, 1.08), (256, 64, 1.06)):
        stream = read_ahead(table, ahead)
        assert sorted(zip(*(stream[c].to_pylist() for c in ("doc_id", "piece", "length")))) == sorted(rows)
        place = {d: k for k, d in enumerate(sorted(table["dealt"].to_pylist()))}
        # a piece leaves its place by less than the look-ahead
        assert all(abs(place[d] - k) < ahead for k, d in enumerate(stream["dealt"].to_pylist()))
        where, _, closed = best_fit(stream["length"].to_pylist(), 2048, most)
        assert closed > 0
        assert max(where) + 1 <= slack * least + 1
