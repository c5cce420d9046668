import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftmon.llm import toxicity as T

from .conftest import MESSY

DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([("the stupid idiot is a worthless loser and a moron " * 30,)], "text string")
    grams = T.character_counts(docs.select("text").unionByName(extra)).toPandas()
    return T.log_model(grams["code"].to_numpy(), grams["n"].to_numpy())


def test_model_is_a_distribution_and_counts_all(spark, model):
    assert np.allclose(np.exp(model).sum(-1), 1, atol=1e-4)
    docs = spark.createDataFrame([("ab, AB ab!",), (None,), ("",), ("x1",)], "text string")
    found = {r.code: r.n for r in T.character_counts(docs).collect()}
    code = 0
    for s in (0, 0, 1, 2):
        code = code * T.SYMBOLS + s
    assert found[code] == 3


def test_restoring(model):
    r = T.Restorer(model)
    for token, word in (("1d10t", "idiot"), ("stup1d", "stupid"), ("$tupid", "stupid"), ("l0ser", "loser"), ("stuuuupid", "stupid"),
                        ("s t u p i d", "stupid"), ("m0r0n", "moron"), ("w0rthl3ss", "worthless"), ("st-up-id", "stupid"), ("l.o.s.e.r", "loser")):
        assert word in r.words(token), (token, r.words(token))


def test_viterbi_finds_the_best_reading(model):
    """Against all readings of short tokens."""
    r = T.Restorer(model)

    def score(token):
        best = []

        def go(i, ctx, total, text):
            if i == len(token):
                best.append((total + (float(model[ctx + (0,)]) if ctx[2] else 0.0), text))
                return
            again = any(token[i - k : i - k + 3] == token[i] * 3 for k in (1, 2)) and token[i - 1 : i] == token[i]
            for letter, cost in r.options(token[i], again):
                if letter == "":
                    go(i + 1, ctx, total + cost, text)
                elif letter == " ":
                    if ctx[2]:
                        go(i + 1, (0, 0, 0), total + cost + float(model[ctx + (0,)]), text + " ")
                else:
                    k = T._symbol(letter)
                    go(i + 1, (ctx[1], ctx[2], k), total + cost + float(model[ctx + (k,)]), text + letter)

        go(0, (0, 0, 0), 0.0, "")
        return max(best)[1].strip()

    for token in ("1d10t", "a$$", "sc*m", "t-h e", "$t0p", "aaab", "8@6"):
        assert r.decode(token) == score(token)


def test_pairs_hold_plain_and_restored_words(model):
    texts = pa.array(["You STUPID!! l0ser", None, "s t u p i d thing", "a b", ""])
    words, d, w = T.restored_pairs(texts, T.Restorer(model))
    found = {(int(a), words[int(b)].as_py()) for a, b in zip(d, w, strict=True)}
    assert {(0, "you"), (0, "stupid"), (0, "loser"), (2, "stupid"), (2, "thing"), (3, "a")} <= found
    assert not {x for x in found if x[0] in (1, 4)}


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    out = T.score_toxicity(docs, labels)
    rows = out.join(labels, "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows["doc_id"], rows["held_out"], strict=True))
    held = rows[rows["held_out"]]
    assert ((held["score"] >= 0.5) == (held["predicted"] == 1)).all() and held["score"].between(0, 1).all()
    assert (held["predicted"] == held["toxic"]).mean() > 0.96


def test_messy_rows_and_no_labels(spark, messy, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, None), (None, 1), (10, 0), (10, 0)], "doc_id long, toxic int")
    for labels in (none, some):
        out = T.score_toxicity(messy, labels).collect()
        assert len(out) == len(MESSY) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert T.score_toxicity(no_docs, none).count() == 0


def test_evidence_counts_over_both_folds(spark):
    fold = F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("fold")
    ids = [(r.id, r.fold) for r in spark.range(300).select("id", fold).collect() if zlib.crc32(str(r.id).encode()) % 5]
    of = [[i for i, k in ids if k == fold] for fold in (0, 1)]
    toxic = {i: "zorgle" for i in (*of[0][:2], of[1][0])} | {i: "blimp" for i in of[0][2:5]}
    clean = {i: "blimp" for i in of[1][10:30]} | {i: "river" for i in (*of[0][30:45], *of[1][30:45])}
    rows = [(i, f"quiet garden {w}") for i, w in (toxic | clean).items()] + [(1000, "some zorgle here"), (1001, "some blimp here")]
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in toxic | clean], "doc_id long, toxic int")
    first = {r.doc_id: r["first"] for r in T.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert first[1000] > 0  # three toxic documents of three, two in one fold and one in the other
    assert first[1001] == 0  # three toxic in one fold, twenty others in the other
