import numpy as np
import pyarrow as pa

from driftmon.llm import quality as Q

from .conftest import MESSY


def test_views():
    texts = pa.array(["good words in a row here.", "", "BAD!! BAD!! BAD!!", None, "a | b | c"], pa.large_string())
    content = Q.content_features(texts)
    meta = Q.meta_features(texts, pa.array(["en"] * 5), pa.array(["s", None, "s", "t", "s"]))
    assert content.shape == (5, Q._CONTENT) and meta.shape == (5, Q._META)
    assert np.array_equal(content[1], content[3]) and np.isfinite(content).all() and np.isfinite(meta).all()
    one = Q.meta_features(pa.array(["BAD!! BAD!! BAD!!"], pa.large_string()), pa.array(["en"]), pa.array(["s"]))
    assert np.allclose(meta[2], one[0])


def test_fit_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    y = (x[:, 0] > 0).astype(float)
    w = Q.fit(x, y, np.ones(500))
    assert ((Q._margin(x, w) > 0) == (y > 0)).mean() > 0.97


def test_accuracy_and_reruns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = Q.score_quality(docs, labels, fit_rows=1500).join(labels, "doc_id").toPandas()
    good = out["quality"] == 1
    assert (out["accepted"] == good).mean() > 0.97
    assert out[good]["accepted"].mean() > 0.99


def test_messy_rows_and_no_labels(spark, messy, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = Q.score_quality(messy, none).collect()
    assert len(out) == len(MESSY) and all(r.accepted and r.score == 1 for r in out)
    assert Q.keep_good(messy, none).columns == messy.columns
    some = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (6, 1), (7, 1), (7, None), (None, 0), (10, 1), (11, 1)], "doc_id long, quality int")
    out = Q.score_quality(messy, some).collect()
    assert len(out) == len(MESSY) and all(0 <= r.score <= 1 and r.accepted == (r.score >= 0.5) for r in out)
    assert Q.score_quality(no_docs, some).count() == 0


def endings(rng, kind, n, share):
    """``n`` words of equal shape; ``share`` of them end the way of their kind."""
    own = np.array(["ing", "ose"] if kind else ["uzz", "yqq"])
    return " ".join("".join(rng.choice(list("abcde"), 3)) + (rng.choice(own) if rng.random() < share else "ada") for _ in range(n))


def test_copies_of_the_surest_text_do_not_crowd_out_others(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):  # source a: the length tells a little about the label, the endings all
        kind = i % 2
        rows.append((i, endings(rng, kind, int(rng.integers(40, 60)) + 8 * kind, 0.7), "en", "a"))
        labels.append((i, kind))
    for i in range(400):  # sources of one kind each, known by their endings alone
        kind = i % 2
        rows.append((1000 + i, endings(rng, kind, int(rng.integers(45, 65)), 0.7), "en", ("bad", "good")[kind]))
    for kind in (0, 1):  # the surest texts, more often than any other
        text = endings(rng, kind, 50, 1.0)
        rows += [(2000 + 1000 * kind + i, text, "en", ("copied-bad", "copied-good")[kind]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    out = Q.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    score = out.join(docs.select("doc_id", "source"), "doc_id").toPandas().groupby("source")["meta_score"]
    assert score.max()["bad"] < score.min()["good"]


def test_each_distinct_document_is_handed_over_once(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abcdefg"), int(rng.integers(2, 9)))) for _ in range(30)) for _ in range(901)]
    rows = [(i, texts[i], "en", "s") for i in range(900)]
    rows += [(5000 + i, *rows[i % 3][1:]) for i in range(700)] + [(None, *rows[700][1:]), (None, texts[900], "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    features = Q.view_features(docs)
    given = spark.createDataFrame([(5000, 0), (8, 1)], "doc_id long, label int")
    vectors = Q.unlabelled_vectors(features, given).cache()
    local = vectors.toPandas()
    assert len(local) == 900 - 2 + 1 and not local.duplicated().any()  # 5000 is a copy of 0
    views = [Q._unpack(local["content"]), Q._unpack(local["meta"])]
    sides = [rng.normal(size=v.shape[1] + 1) * 9 for v in views]
    rounds = [sides, [w * 2 for w in sides], [-w * 2 for w in sides]]
    n = Q.count_handed(vectors, rounds)
    weights, at = rng.random((2, 2)), [rng.normal(size=len(w)) / 20 for w in sides]
    sums = Q.sums_of_handed(vectors, rounds, weights, at)
    for taker in (0, 1):
        label = []
        for row in views[1 - taker]:
            found = [float(row @ w[1 - taker][:-1] + w[1 - taker][-1]) for w in rounds]
            label.append(next((int(m > 0) for m in found if abs(m) >= np.log(0.97 / 0.03)), -1))
        label = np.array(label)
        assert n[taker].tolist() == [(label == 0).sum(), (label == 1).sum()] and n[taker].sum() > Q.PSEUDO * 400
        some = label >= 0
        exact = Q._sums(Q._with_one(views[taker][some]), label[some], weights[taker][label[some]], at[taker])
        assert all(np.allclose(a, b, rtol=1e-3, atol=1e-2) for a, b in zip(sums[taker], exact))
