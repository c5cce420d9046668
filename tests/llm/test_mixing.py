import random

import numpy as np

from driftmon.llm.mixing import mix_sources, pivot, repeat_documents

from .conftest import MESSY, make_docs


def targets(sizes):
    """Sources with their target, by sharing the excess again and again."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        share = (total - sum(out.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > 3 * sizes[s]}
        if not over:
            out |= {s: weight[s] * share for s in open_}
            break
        out |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return out


def test_targets_and_words(spark):
    random.seed(3)
    rows = [(i, " ".join("w" * random.randrange(1, 4) for _ in range(int(random.lognormvariate(3, 1.2)))),
             random.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(1500)]
    rows += [(5000 + i, "x y", "tiny") for i in range(3)]
    docs = make_docs(spark, rows)
    out = mix_sources(docs).collect()
    assert len(out) == len(rows)
    source, size = {r[0]: r[2] for r in rows}, {r[0]: len(r[1].split()) for r in rows}
    sums = {}
    for r in out:
        assert r["size"] == size[r.doc_id] and r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        sums.setdefault(source[r.doc_id], [0, r.source_size, r.target])[0] += r.taken
    want = targets({s: sum(size[i] for i in source if source[i] == s) for s in sums})
    for s, (taken, whole, target) in sums.items():
        assert whole == sum(size[i] for i in source if source[i] == s)
        assert abs(target - want[s]) < 1e-6 * max(1, target)
        assert abs(taken - target) <= max(3, 0.002 * target)
    again = mix_sources(docs.repartition(11)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


def test_pivot_keeps_the_sum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        size = np.sort(rng.integers(0, 50, rng.integers(1, 40)))[::-1].astype(float)
        frac = np.full(len(size), rng.random())
        frac[size == 0] = 0
        f, carry = pivot(size, frac, rng.random(len(size)))
        assert abs(size @ f - size @ frac) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(f) if i != carry)


def test_expectation_of_a_document():
    rng = np.random.default_rng(2)
    size = np.array([9.0, 5, 4, 2])
    mean = np.zeros(4)
    for _ in range(4000):
        f, carry = pivot(size, np.full(4, 0.4), rng.random(4))
        mean += f
    assert np.allclose(mean / 4000, 0.4, atol=0.04)


def test_messy_and_empty(spark, messy, no_docs):
    out = mix_sources(messy).collect()
    assert len(out) == len(MESSY)
    assert all(r.taken == 0 for r in out if r["size"] == 0)
    assert mix_sources(no_docs).count() == 0
    assert repeat_documents(no_docs).count() == 0


def test_repeated_rows_of_the_mix(spark, messy):
    out = repeat_documents(messy)
    assert out.columns == messy.columns
    assert out.count() == sum(r.copies for r in mix_sources(messy).collect())
