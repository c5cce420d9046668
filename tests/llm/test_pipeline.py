import re

import corpus_pipeline as P
from driftmon.llm.common import materialise
from driftmon.llm.mixing import mix_sources
from driftmon.llm.quality import score_quality

from .test_ngram_join import brute

DIR = "/root/testdata/sf0.001"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(P.STAGES):
        after = materialise(stage(spark, before, DIR), name)
        old, new = ({r.doc_id: r.text for r in d.collect()} for d in (before, after)) if k < 4 else ({}, {})
        if k < 4:
            assert after.columns == columns
        if name == "quality":
            accepted = {r.doc_id for r in score_quality(before, labels).where("accepted").collect()}
            assert set(new) == accepted
        elif name == "exact_dedup":
            groups = {}
            for i, t in old.items():
                groups.setdefault(norm(t), []).append((-len(t or ""), i))
            assert set(new) == {min(g)[1] for g in groups.values()} and after.count() == len(groups)
        elif name == "ngram_join":
            assert set(new) == {c for *_, c in brute(sorted(old.items()), 5, 80, 100)}
        elif name == "source_mix":
            copies = {r.doc_id: r.copies for r in mix_sources(before).collect() if r.copies}
            times = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
            assert times == copies
        else:
            assert after.where("piece = 0").count() == before.count()
        before = after


def test_run_on_an_empty_table(spark, tmp_path):
    empty = str(tmp_path)
    for t in ("documents", "labels"):
        spark.read.parquet(f"{DIR}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert P.run(spark, empty).count() == 0


def test_stages_keep_columns_of_any_name(spark, messy):
    from driftmon.llm import exact_dedup, mixing, ngram_join, quality

    names = ["_sha", "_nth", "_keep_id", "_mix_id", "_copies", "_copy", "_gone_id", "_bad_id", "keep_id", "nth", "mix_id", "copies", "gone", "own_nth", "row", "a.b"]
    odd = messy.selectExpr(*(f"`{c}`" for c in messy.columns if c not in names), *(f"{k} as `{c}`" for k, c in enumerate(names)))
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, quality int")
    for out in (quality.keep_good(odd, labels), exact_dedup.drop_exact_duplicates(odd), ngram_join.drop_near_duplicates(odd), mixing.repeat_documents(odd)):
        assert out.columns == odd.columns
        assert all([r[c] for c in names] == list(range(len(names))) for r in out.collect())
