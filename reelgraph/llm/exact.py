"""Exact deduplication, in built-in expressions only.

Documents are grouped by a 128-bit hash of their normalised text. Hashes, length and number of every row are a small
table; sizes of groups and the row that stays are aggregates over it, combined before they are shuffled. Where a hash is
shared, the texts themselves are compared: grouped by (hash, text), which keeps one copy for each task before anything
moves, so a text that a third of all rows have costs no more than any other. Texts that collide in the hash are told
apart by a second digest, and the comparison proves that each group holds one text only.

A group of more than a HOT-th of all rows meets its rows by a broadcast: there are less than HOT of them. The rows of
all other groups are joined by hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import shared_dir, stored

#: Characters that don't count: blank and \t \n \v \f \r.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Groups of more than this part of all rows are hot; shared hashes that are broadcast at most (16 bytes each).
HOT, SHARED = 1000, 1 << 18


def normalised(text: Column) -> Column:
    for x in BLANKS:
        text = F.replace(text, F.lit(x), F.lit(""))
    return text


def md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = md5, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, carried) of every row.

    Texts are equal when they are identical without BLANKS; a null text is empty. Of equal texts the row of the
    longest original text (code points) stays, then the least doc_id, a null one last; of rows that repeat both, one
    stays. keep_id: doc_id of the row that stays. carry: columns to hand on, in the struct carried (null without any).
    An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    work = shared_dir(spark, "exact")
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    carried = F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]) if carry else F.lit(None).cast("string")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("text"), carried.alias("carried"))
    text = text.select("doc_id", F.length("text").alias("n"), normalised(F.col("text")).alias("norm"), "carried")
    text = text.withColumn("hash", digest(F.col("norm")))
    second = F.unhex(F.sha2("norm", 256))
    # The number of a row is made once and written: a task that runs again can't change it.
    rows = stored(text.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n", "hash", second.alias("second"), "carried"), f"{work}/rows")
    key = ["hash", "second"]
    first = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = stored(rows.groupBy(*key).agg(F.count("*").alias("size"), F.min(first).alias("first")), f"{work}/groups")
    _compare(text.select("hash", "norm"), groups)

    total = rows.count()
    group = groups.select(*key, "size", F.struct("size", "first").alias("group"))
    hot = group.where(F.col("size") * HOT > total).drop("size")  # less than HOT rows
    rest = rows.join(F.broadcast(hot.drop("group")), key, "left_anti").join(group.where(F.col("size") * HOT <= total).drop("size"), key)
    out = rows.join(F.broadcast(hot), key).unionByName(rest)
    stays = F.col("group.first")
    return out.select("doc_id", stays["doc_id"].alias("keep_id"), F.col("group.size").alias("group_size"), (F.col("row") == stays["row"]).alias("kept"), F.lower(F.hex("second")).alias("text_sha256"), "carried")


def _compare(texts: DataFrame, groups: DataFrame) -> None:
    """Compare the texts (hash, norm) of groups with several rows byte by byte; ValueError if a group has two.

    Up to SHARED such groups their hashes are broadcast, so no other text moves; beyond, each different text moves once.
    """
    several = groups.where("size > 1").select("hash").distinct()
    if several.count() <= SHARED:
        texts = texts.join(F.broadcast(several), "hash", "left_semi")
    each = texts.groupBy("hash", "norm").agg(F.count("*").alias("copies")).select("hash", F.sha2("norm", 256).alias("second"))
    if not each.groupBy("hash", "second").agg(F.count("*").alias("texts")).where("texts > 1").isEmpty():
        raise ValueError("different texts share both digests")
