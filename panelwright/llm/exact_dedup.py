"""Exact duplicates: 128-bit content hash, smallest id stays, bytes compared inside groups.

Columns and SQL functions only. Texts are equal when they are the same after
each run of ASCII white space became one space; a null text is empty.

Plan. One aggregation on (md5, text) combines copies in the map tasks, so a
group holding a third of the rows leaves each task as one row, and grouping by
the text itself is the comparison of bytes. Its classes (small rows) are
written out and joined back by the hash alone, which adaptive execution can
split. A hash with several classes is a collision; only documents with such a
hash are joined by their text.

Edge cases: null text equals the empty text; rows that repeat a doc_id and a
text share the decision of that document; rows without doc_id count in
group_size and are kept only if no row of their group has an id; an empty
table gives an empty result; further columns of the input do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import read, stage
from panelwright.llm.registry import query

RUN_OF_WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUN_OF_WHITE, " ")


def decisions(docs: DataFrame, hash_of=F.md5) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``hash_of`` maps the normalised text to the grouping hash; tests pass a
    weak one to provoke collisions.
    """
    text = docs.select("doc_id", normalised(F.col("text")).alias("_text"))
    hashed = text.select("doc_id", "_text", hash_of(F.col("_text")).alias("_hash"))
    classes = stage(
        hashed.groupBy("_hash", "_text")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("_hash", "keep_id", "group_size", F.sha2("_text", 256).alias("text_sha256")),
        "exact-classes",
    )
    per_hash = stage(
        classes.groupBy("_hash").agg(
            F.count("*").alias("_classes"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"), F.min("text_sha256").alias("text_sha256")
        ),
        "exact-hashes",
    )
    small = hashed.select("doc_id", "_hash")
    single = small.join(per_hash.where("_classes = 1"), "_hash").select("doc_id", "keep_id", "group_size", "text_sha256")
    collided = per_hash.where("_classes > 1").select("_hash")
    if collided.isEmpty():  # no need to read the texts again
        return _with_kept(single)
    apart = (
        hashed.join(collided, "_hash", "left_semi").withColumn("text_sha256", F.sha2("_text", 256))
        .join(classes.join(collided, "_hash", "left_semi"), ["_hash", "text_sha256"])
        .select("doc_id", "keep_id", "group_size", "text_sha256")
    )
    return _with_kept(single.unionByName(apart))


def _with_kept(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they came."""
    kept = decisions(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    same = docs["doc_id"].eqNullSafe(kept["_id"]) & (F.sha2(normalised(docs["text"]), 256) == kept["_sha"])
    return docs.join(kept, same, "left_semi")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


@query("op6_exact_dedup", SQL)
def op6_exact_dedup(spark, sf_dir):
    return decisions(read(spark, sf_dir, "documents"))
