"""Exact deduplication by skew-safe combining, on built-in functions only.

Three combining stages, each grouping by digest and by the full normalised text, so that two
texts can only ever meet if they are the same string:

1. local: each map task folds its own rows to one per text (the partial aggregate);
2. salted: the folded rows of a text meet in ``salts`` separate places;
3. global: the at most ``salts`` winners of a text meet in one place.

A text held by a third of all rows therefore sends a row per map task to the second stage
and at most ``salts`` rows to the third. The groups, now one narrow row per distinct text,
go back to the documents over the digest; only if two different texts should ever share a
digest (none known) does that last join compare the whole texts as well.

Defined cases: a null text is the empty text; a null doc_id never wins against another and
keeps nothing away; rows repeated with the same doc_id and text are all reported as kept,
since nothing tells them apart; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_SQL, columns, cut, fresh


def _normal(docs: DataFrame) -> DataFrame:
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE_SQL, " ")
    return columns(docs, "doc_id", "text").select("doc_id", norm.alias("norm")).withColumn("digest", F.sha2(F.col("norm").cast("binary"), 256))


def groups(docs: DataFrame, salts: int = 16) -> DataFrame:
    """(digest, norm, keep_id, group_size) per distinct normalised text."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")
    salted = _normal(docs).groupBy("digest", "norm", salt).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = groups(docs, salts)
    each = cut(found.select("digest", "keep_id", "group_size", F.lit(0).alias("other")))
    shared = each.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    rows = _normal(docs)
    if shared.isEmpty():
        joined = rows.select("doc_id", "digest").join(each.drop("other"), "digest")
    else:
        joined = rows.join(found, ["digest", "norm"]).drop("norm")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The documents that stay, whole rows; of rows repeated with one doc_id and text, one."""
    key, won, digest = fresh("id"), fresh("won"), fresh("digest")
    winners = groups(docs, salts).select(F.col("keep_id").alias(key), F.col("digest").alias(won))
    norm = F.regexp_replace(F.coalesce(docs["text"].cast("string"), F.lit("")), SPACE_SQL, " ")
    rows = docs.withColumn(digest, F.sha2(norm.cast("binary"), 256))
    kept = rows.join(winners, rows["doc_id"].eqNullSafe(winners[key]) & (rows[digest] == winners[won]), "left_semi")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", digest])
    return kept.drop(digest)
