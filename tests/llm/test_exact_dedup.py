import hashlib
import random

from pyspark.sql import functions as F

from driftmon.llm.exact_dedup import drop_exact_duplicates, exact_groups

from .conftest import MESSY, make_docs


def norm(t):
    return (t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append((i, t or ""))
    out = []
    for n, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), hashlib.sha256(n.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()], key=repr)


def test_messy_rows(messy):
    out = exact_groups(messy)
    assert got(out) == brute(MESSY)
    kept = out.where("kept").groupBy("text_sha256").count().collect()
    assert all(r["count"] == 1 for r in kept) and len(kept) == len({norm(t) for _, t, *_ in MESSY})


def test_names_survive_clashing_hashes_and_many_blocks(spark):
    random.seed(5)
    parts = ["ab", "ba", "abc", "é", "ab ", "\tba"]
    rows = [(i, "".join(random.choices(parts, k=random.randrange(12)))) for i in range(150)]
    out = exact_groups(make_docs(spark, rows), block_chars=3, block_hash=lambda c: F.length(c).cast("long"))
    assert got(out) == brute(rows)


def test_empty_table(no_docs):
    assert exact_groups(no_docs).count() == 0


def test_kept_rows_keep_all_columns(messy):
    out = drop_exact_duplicates(messy)
    assert out.columns == messy.columns
    texts = [norm(r.text) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({norm(t) for _, t, *_ in MESSY})
