"""Exact duplicates by deterministic block naming, with DataFrame functions only.

A normalised text is cut into fixed-size blocks.  The distinct blocks are
sorted and numbered, so a block's integer name is its place in that order;
then adjacent pairs of names are sorted and numbered in the same way, level by
level, until each document has one name.  Names are positions of distinct
values, never hashes, so two documents share one exactly when their texts are
equal.

Only one shuffle moves text (the distinct blocks, combined on the map side).
Everything after it joins on an 8-byte hash of the block; the few hashes that
two different blocks share, if any, are resolved on the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmon.llm.common import WHITE, as_struct, from_struct, materialise

BLOCK_CHARS = 2048
#: Stands for "no right neighbour" in a pair; never a name.
NONE = -1


def normalised(text: Column | str) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _occurrences(docs: DataFrame, block_chars: int, block_hash) -> DataFrame:
    """One row per block of each document; what describes the document rides on its first block."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").alias("doc"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
        normalised("text").alias("norm"),
    )
    cut = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    )
    blocks = rows.withColumn("sha", F.sha2("norm", 256)).withColumn("cut", cut)
    out = blocks.select(
        "row", "doc", "chars", "sha", F.size("cut").alias("n"), F.posexplode("cut").alias("idx", "block")
    )
    return out.withColumn("h", block_hash(F.col("block"))).withColumn("at", F.monotonically_increasing_id())


def _numbered(distinct: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct rows in sorted order, each with its integer name; written, so names are fixed once."""
    return materialise(distinct.orderBy(*by).withColumn("name", F.monotonically_increasing_id()), name)


def name_documents(docs: DataFrame, block_chars: int = BLOCK_CHARS, block_hash=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: row, doc, chars, sha, level, name.

    Rows have equal (level, name) exactly when their normalised texts are equal.
    """
    occ = _occurrences(docs, block_chars, block_hash)
    distinct = occ.groupBy("h", "block").agg(F.min("at").alias("first"))
    names = _numbered(distinct.select("h", "first"), ["h", "first"], "block-names")

    narrow = occ.drop("block", "at")
    clash = names.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    single = names.join(clash, "h", "left_anti").select("h", "name")
    cur = narrow.join(single, "h")
    if not clash.isEmpty():
        texts = distinct.join(clash, "h", "left_semi").join(names, ["h", "first"]).select("h", "block", "name")
        apart = occ.join(clash, "h", "left_semi").join(materialise(texts, "clashes"), ["h", "block"])
        cur = cur.unionByName(apart.drop("block", "at"))
    cur = materialise(cur.drop("h"), "level-0")

    about = cur.where("idx = 0").select("row", "doc", "chars", "sha")
    done = cur.where("n = 1").select("row", F.lit(0).alias("level"), "name")
    cur, level = cur.where("n > 1").select("row", "idx", "n", "name"), 0
    while not cur.isEmpty():
        level += 1
        even = F.col("idx") % 2 == 0
        pairs = cur.groupBy("row", F.floor(F.col("idx") / 2).cast("int").alias("idx")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NONE)).alias("b"),
            F.ceil(F.max("n") / 2).cast("int").alias("n"),
        )
        pairs = materialise(pairs, f"pairs-{level}")
        names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], f"pair-names-{level}")
        cur = materialise(pairs.join(names, ["a", "b"]).drop("a", "b"), f"level-{level}")
        done = done.unionByName(cur.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        cur = cur.where("n > 1")
    return about.join(done, "row")


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS, block_hash=F.xxhash64) -> DataFrame:
    """Groups of rows whose texts are equal after deleting all white space.

    Input: ``doc_id`` and ``text``; other columns are ignored, whatever their
    names.  Output, one row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``.  The row with the most code points in its original text
    stays, then the smallest ``doc_id`` (null last).  Null text counts as
    empty, and all empty texts are one group.  Of repeated rows (equal id and
    text) exactly one is ``kept``.  An empty table gives an empty result.
    """
    named = materialise(name_documents(docs.select("doc_id", "text"), block_chars, block_hash), "identities")
    best = F.min(F.struct(-F.col("chars"), F.col("doc").isNull().alias("no_id"), F.col("doc"), F.col("row")))
    groups = named.groupBy("level", "name").agg(F.count("*").alias("group_size"), best.alias("best"))
    groups = materialise(
        groups.select("level", "name", "group_size", F.col("best.doc").alias("keep_id"), F.col("best.row").alias("keep_row")),
        "groups",
    )
    return named.join(groups, ["level", "name"]).select(
        F.col("doc").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; one row for each kept ``doc_id``.

    Rows without a ``doc_id`` are told apart by their text: the one that stays
    is found among them by its digest.
    """
    keep = exact_groups(docs, block_chars).where("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha"))
    keep = materialise(keep, "kept")
    whole, row, of = as_struct(docs, id=F.col("doc_id"), sha=F.sha2(normalised("text"), 256), size=F.length("text"))
    stay = whole.join(keep, F.col(of["id"]).eqNullSafe(F.col("keep_id")) & (F.col(of["sha"]) == F.col("keep_sha")), "left_semi")
    order = Window.partitionBy(of["id"], of["sha"]).orderBy(F.col(of["size"]).desc_nulls_last())
    return from_struct(stay.withColumn("nth", F.row_number().over(order)).where("nth = 1"), row, docs.columns)


OP8_SQL = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm,
         length(coalesce(text, '')) AS chars
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
