import random
import re

import numpy as np
import pytest
import xxhash

from driftmon.llm import simhash
from driftmon.llm.components import connected_components
from driftmon.llm.simhash import around, fingerprint, grid_points, links, simhash_components

from .conftest import MESSY, make_docs


def plain(text, k=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(bits, reach=4):
    """Least member of every fingerprint's component, all pairs compared."""
    bits = sorted(set(bits))
    root = {b: b for b in bits}

    def find(b):
        while root[b] != b:
            b = root[b]
        return b

    for i, a in enumerate(bits):
        for b in bits[:i]:
            if (a ^ b).bit_count() <= reach:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {b: find(b) for b in bits}


def brute(rows):
    own = [plain(r[1]) for r in rows]
    root, least = components(own), {}
    for r, b in zip(rows, own):
        if r[0] is not None:
            least[root[b]] = min(least.get(root[b], r[0]), r[0])
    return sorted([(r[0], f"{b:016x}", least.get(root[b])) for r, b in zip(rows, own)], key=repr)


def got(df):
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted(map(tuple, df.collect()), key=repr)


def crowd(seed, centres, each, flips):
    """Fingerprints around centres, at up to ``flips`` bits, and a chain of steps of four bits."""
    rng = random.Random(seed)
    out = {0, 1 << 63, (1 << 64) - 1}
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, each)):
            x = centre
            for b in rng.sample(range(64), rng.randrange(flips + 1)):
                x ^= 1 << b
            out.add(x)
    x = rng.getrandbits(64)
    for _ in range(30):
        for b in rng.sample(range(64), rng.choice([4, 4, 5])):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("shape", "most"), [((1, 40, 20, 3), 20_000), ((2, 2, 700, 6), 20_000), ((3, 2, 300, 5), 40), ((4, 500, 2, 0), 33)])
def test_links_equal_all_pairs(spark, shape, most):
    bits = crowd(*shape)
    df = spark.createDataFrame([(int(np.uint64(b).view(np.int64)),) for b in bits], "bits long").repartition(4)
    signed = {int(np.uint64(b).view(np.int64)): b for b in bits}
    found = [(signed[r.a], signed[r.b]) for r in links(df, most=most).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    assert len(found) <= 60 * len(bits)
    label = {signed[r.node]: signed[r.label] for r in connected_components(links(df, most=most)).collect()}
    want = components(bits)
    groups = lambda of: sorted(sorted(b for b in bits if of.get(b, b) == x) for x in {of.get(b, b) for b in bits})
    assert groups(label) == groups(want)


def test_a_point_is_within_one_of_both():
    """Of two fingerprints at most four bits apart, some half has a grid point in common."""
    rng = random.Random(3)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randrange(5)):
            b ^= 1 << k
        meet = False
        for half in (0, 1):
            x, y = (set(around(grid_points(np.array([v], np.uint64).view(np.int64), half))[0].tolist()) for v in (a, b))
            assert len(x) <= simhash.AROUND
            meet |= bool(x & y)
        assert meet


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "ÉTÉ", "naïve"]
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 12, 90, 400]))
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((" " if rng.random() < 0.8 else "\n\t").join(x.upper() if rng.random() < 0.1 else x for x in w))
    return [(i * 17 % 1009, t) for i, t in enumerate(rows)]


def test_documents_equal_brute_force(spark):
    rows = corpus(1)
    want = brute(rows)
    assert len({c for *_, c in want}) < len(rows) - 20
    assert got(simhash_components(make_docs(spark, rows))) == want


def test_messy_and_empty(spark, messy, no_docs):
    assert got(simhash_components(messy)) == brute(MESSY)
    assert simhash_components(no_docs).count() == 0
    assert got(simhash_components(make_docs(spark, [(4, None), (2, " \n"), (None, "")]))) == sorted(
        [(4, "0" * 16, 2), (2, "0" * 16, 2), (None, "0" * 16, 2)], key=repr)


def test_fingerprint_of_a_very_long_text_and_of_few_words():
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    for text in (long, "a", "a b", "a b c", "A b c d", "x y z x y z x y z", ""):
        assert fingerprint(text.encode()) == plain(text)
