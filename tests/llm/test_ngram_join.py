import random
import re

import pyarrow as pa
import pytest

from driftmon.llm import ngram_join
from driftmon.llm.components import connected_components
from driftmon.llm.ngram_join import drop_near_duplicates, jaccard_components, ngram_hashes

from .conftest import MESSY, make_docs


def sets(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, num, den):
    rows = list(rows)
    own = [sets(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(own):
        for j in range(i):
            b = own[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted([(r[0], len(own[i]), least.get(find(i)) if own[i] else r[0]) for i, r in enumerate(rows)], key=repr)


def got(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()], key=repr)


def corpus(seed, n_bases=12, copies=14, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = rng.choices(vocabulary, k=25)
    rows = []
    for _ in range(n_bases):
        base = rng.choices(vocabulary, k=rng.randrange(6, words))
        if rng.random() < 0.5:
            base = shared + base
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in w))
    return [(i * 13 % 10_007, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("rounds", [4, 1])
def test_components_equal_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    rows = corpus(rounds + 1)
    assert got(jaccard_components(make_docs(spark, rows), 4, (85, 100))) == brute(rows, 4, 85, 100)


def test_a_drifting_group(spark):
    """One text edited step by step: neighbours are alike, the ends are not."""
    rng = random.Random(9)
    words = [f"a{i}" for i in range(120)]
    rows = []
    for i in range(160):
        words[rng.randrange(len(words))] = f"n{i}"
        rows.append((i, " ".join(words)))
    want = brute(rows, 5, 80, 100)
    assert got(jaccard_components(make_docs(spark, rows))) == want
    assert len({c for *_, c in want}) < 40


def test_messy_and_empty(spark, messy, no_docs):
    assert got(jaccard_components(messy, 4, (85, 100))) == brute(MESSY, 4, 85, 100)
    assert jaccard_components(no_docs).count() == 0
    kept = drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 10, 11] or len(kept.collect()) >= 7


def test_hashes_tell_short_sequences_apart():
    h, ends = ngram_hashes(pa.array(["a", "a a", "a a a", "a a a a", "a a a a a", None]), 4)
    assert ends.tolist() == [1, 2, 3, 4, 6, 6] and len(set(h.tolist())) == 4


def test_connected_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    out = {r.node: r.label for r in connected_components(links).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert connected_components(links.limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """2,000 near copies of one text, whose lists are split into blocks; many pairs of copies are below the limit."""
    monkeypatch.setattr(ngram_join, "LONGEST", 300)
    monkeypatch.setattr(ngram_join, "MEMBERS", 100)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(90)]
    rows = [(0, " ".join(base))]
    for i in range(1, 2000):
        w = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(300)}"
        rows.append((i, " ".join(w)))
    want = brute(rows, 4, 85, 100)
    assert 50 < len({c for *_, c in want}) < 1500
    assert got(jaccard_components(make_docs(spark, rows), 4, (85, 100))) == want


def test_clashing_names_of_any_kind(spark, messy):
    odd = messy.selectExpr("*", "1 as gone", "2 as _gone_id", "3 as _row", "4 as rep", "5 as `a.b`")
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == drop_near_duplicates(messy).count()
