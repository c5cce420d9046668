import hashlib
import random

import numpy as np

from driftmon.llm.fingerprint import (
    compare_with_next,
    containment,
    edited_text,
    fingerprint,
    from_string,
    merge,
    sketch_documents,
    to_string,
)

from .conftest import MESSY, make_docs


def text(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t, *_) in enumerate(rows):
        edited = edited_text(t or "", rows[(k + 1) % len(rows)][1] or "")
        out.append((i, len(t or ""), hashlib.sha256(edited.encode()).hexdigest(), to_string(fingerprint(t or "")),
                    to_string(fingerprint(edited))))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in df.collect()], key=repr)


def test_next_documents_over_many_ranges(spark):
    rows = [(i * 7 % 1009, text(i % 40, i)) for i in range(400)]
    for each in (10, 10_000):
        out = compare_with_next(make_docs(spark, rows), rows_each=each)
        assert got(out) == brute(rows)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out.collect())


def test_messy_single_and_empty(spark, messy, no_docs):
    assert got(compare_with_next(messy)) == brute(MESSY)
    one = make_docs(spark, [(3, "one text alone here")])
    assert got(compare_with_next(one)) == brute([(3, "one text alone here")])
    assert compare_with_next(no_docs).count() == 0
    marks = {r.doc_id: r.fingerprint for r in sketch_documents(messy).collect()}
    assert marks[1] == marks[8] and marks[3] == marks[4] == ""


def test_likeness_follows_containment():
    for n in (10, 100, 3000):
        a, b = text(n, 1), text(n, 2)
        near = containment(fingerprint(a), fingerprint(edited_text(a, b)))
        assert 0.55 <= near <= 0.95, (n, near)
        assert containment(fingerprint(a), fingerprint(b)) < 0.3
        assert containment(fingerprint(a), fingerprint(a)) == 1
    part, whole = text(400, 5), text(400, 5) + " " + text(20_000, 6)
    assert containment(fingerprint(part), fingerprint(whole)) > 0.9


def test_sketches_merge_and_read_back():
    a, b = text(800, 8), text(900, 9)
    both = merge(fingerprint(a), fingerprint(b))
    drop = both[1][0]
    limit = np.uint64(1 << (64 - drop))
    for x in (a, b):
        h = fingerprint(x)[1][1]
        assert np.isin(h[h < limit], both[1][1]).all()
    assert to_string(from_string(to_string(both))) == to_string(both)
