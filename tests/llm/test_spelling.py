import random
import re
import zlib

import numpy as np
import pytest

from driftmon.llm.kd_tree import KdTree, codes_of, edit_pairs, one_edit, points_of
from driftmon.llm.spelling import group_variants, spelling_variants, word_counts

from .conftest import MESSY, make_docs


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    words = sorted(counts)
    near = {w: [] for w in words}
    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    for i, a in enumerate(words):
        for b in by[len(a)] + by.get(len(a) + 1, []):
            if (len(b) > len(a) or b > a) and distance_one(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def vocabulary(seed, n=900, letters="abcdé"):
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        w = "".join(rng.choices(letters, k=rng.randrange(5, 9)))
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(w))
            kind = rng.randrange(3)
            x = w[:i] + w[i + 1:] if kind == 0 and len(w) > 5 else w[:i] + rng.choice(letters) + w[i + (kind == 1):]
            out[x] = rng.choice([3, 4, 7, 20, 20, 300])
        out[w] = rng.choice([3, 8, 50, 1000])
    return out


@pytest.mark.parametrize("sizes", [(100_000, 4096, 16_384, 500_000), (200, 40, 16_384, 500_000), (300, 60, 12, 70)])
def test_groups_equal_brute_force(spark, sizes):
    """Also with many small boxes, and with boxes that are split into blocks and parts."""
    counts = vocabulary(len(sizes))
    words = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n long, code string, id int").repartition(5)
    assert got(group_variants(words, *sizes)) == brute(counts)


def test_words_of_the_same_letters(spark):
    """No cut parts anagrams; blocks do."""
    rng = random.Random(4)
    words = set()
    while len(words) < 400:
        w = list("aabbccd")
        rng.shuffle(w)
        words.add("".join(w))
    counts = {w: 3 for w in words} | {w[:3] + "e" + w[4:]: 9 for w in list(words)[:100]} | {w + "a": 6 for w in list(words)[:50]}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(group_variants(df, 1000, 10, 30, 90)) == brute(counts)


def expected_counts(rows):
    n = {}
    for r in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        for run in re.findall("[a-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                n[run] = n.get(run, 0) + 1
    return {w: k for w, k in n.items() if k >= 3}


def test_counts_and_query_on_documents(spark):
    rng = random.Random(1)
    words = [w.capitalize() if rng.random() < 0.2 else w for w in vocabulary(7, 150)]
    rows = [(i, "-".join(rng.choices(words, k=80)) + " ÀÉtude Étude!") for i in range(60)]
    docs = make_docs(spark, rows)
    want = expected_counts(rows)
    assert {r.word: r.n for r in word_counts(docs).collect()} == want
    assert got(spelling_variants(docs)) == brute(want)


def test_messy_and_empty(spark, messy, no_docs):
    assert got(spelling_variants(messy)) == brute(expected_counts(MESSY))
    assert spelling_variants(no_docs).count() == 0
    assert spelling_variants(make_docs(spark, [(1, None), (2, ""), (3, "ab " * 9)])).count() == 0


def test_very_long_words(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh", k=30_000))
    counts = {long: 10, long[:20_000] + long[20_001:]: 3, long[:-1] + "z": 4, long[::-1]: 3}
    assert got(group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_boxes_never_lose_a_word_one_edit_away():
    rng = random.Random(6)
    for length in (5, 9):
        a = ["".join(rng.choices("abcdeféß", k=length)) for _ in range(300)]
        codes, _ = codes_of(a)
        tree = KdTree(codes, 12, tight=True)
        letters = points_of(a)[0].reshape(len(a), -1)
        for other, reach in ((a, 2), (["".join(rng.choices("abcdeféß", k=length - 1)) for _ in range(300)], 1)):
            c, _ = codes_of(other)
            found = {(q, p) for x, y in edit_pairs(tree, codes, letters, c, points_of(other)[0].reshape(len(other), -1), reach) for q, p in zip(x, y)}
            assert found == {(q, p) for q, w in enumerate(other) for p, x in enumerate(a) if distance_one(w, x)}
        region = KdTree(codes[:50], 4, tight=False)
        home = region.leaf_of(codes)
        own = {(leaf, i) for leaf, some in region.near(codes, 0) for i in some}
        assert all((home[i], i) in own for i in range(len(a)))


def test_one_edit():
    a, b = (np.array([[ord(c) for c in w] for w in x]) for x in (["abab", "abab", "abab"], ["aabab", "ababb", "babba"]))
    assert one_edit(a, b).tolist() == [True, True, False]
