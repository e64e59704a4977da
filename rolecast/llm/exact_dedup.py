"""Exact duplicates by progressive refinement: equal lengths, then equal beginnings, then equal digests.

A first scan keeps a length and a hash of the beginning of every text, 12 bytes a row. Groups of one row are settled
there, level by level; the second scan digests whole texts of the rows that are left. No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut, join_hot

#: The characters that equality overlooks.
BLANKS = " \t\n\x0b\f\r"
#: Up to so many (length, beginning) groups of 12 bytes are sent to all executors; more are met by a shuffle of narrow rows.
BROADCAST_GROUPS = 1_000_000


def normalised(text: Column) -> Column:
    """The text without ``BLANKS``, byte by byte; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def open_groups(docs: DataFrame, text_col: str = "text", head_chars: int = 64) -> DataFrame:
    """(size, head) of all groups of two rows or more that agree in the normalised length and in the hash of the beginning.

    The hash is taken into account for lengths that occur twice, so a text of a length of its own is settled by the first level.
    """
    text = normalised(F.col(f"`{text_col}`"))
    rows = cut(docs.select(F.length(text).alias("size"), F.xxhash64(F.substring(text, 1, head_chars)).alias("head")))
    sizes = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    left = join_hot(rows, sizes, "size", "n", rows.count())
    return left.groupBy("size", "head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("size", "head")


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", head_chars: int = 64, digest_all: bool = False, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of docs: who stays of the rows with the same text.

    Texts are the same when they are identical without blanks (SHA-256 and length stand for identity); the row with the
    most code points before that stays, of several the one of the least id, null last. Null texts count as empty ones and
    are all one group. Of repeated rows with one id exactly one is kept, whichever; keep_id is the same for all. Other
    columns of docs are ignored whatever their names. ``text_sha256`` is null for rows that the lengths and beginnings
    have settled, as their whole text isn't read for it, unless ``digest_all``.
    """
    text = normalised(F.col("text"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    groups = cut(open_groups(docs, text_col, head_chars))
    few = groups.count() <= broadcast_groups
    keyed = rows.select("id", "text", F.length(text).alias("size"), F.xxhash64(F.substring(text, 1, head_chars)).alias("head"))
    marked = keyed.join(F.broadcast(groups.withColumn("open", F.lit(True))), ["size", "head"], "left") if few else keyed.withColumn("open", F.lit(True))
    wanted = F.lit(True) if digest_all else F.coalesce(F.col("open"), F.lit(False))
    found = cut(
        marked.select("id", F.coalesce("open", F.lit(False)).alias("open"), "size", "head", F.length("text").alias("n_chars"), F.when(wanted, F.sha2(text, 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    )
    if not few:
        counted = found.groupBy("size", "head").agg(F.count(F.lit(1)).alias("n")).select(F.struct("size", "head").alias("key"), "n")
        met = join_hot(found.withColumn("key", F.struct("size", "head")), counted.withColumn("copies", F.col("n")), "key", "n", found.count())
        found = cut(met.withColumn("open", F.col("copies") > 1).withColumn("digest", F.when(F.lit(digest_all) | F.col("open"), F.col("digest"))).drop("key", "copies"))
    shared = found.filter("open")
    order = F.struct((-F.col("n_chars")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"), F.col("row").alias("d"))
    kept = cut(shared.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("first")).select("digest", "group_size", F.col("group_size").alias("n"), F.col("first.c").alias("keep_id"), F.col("first.d").alias("keep_row")))
    joined = join_hot(shared, kept, "digest", "n", shared.count())
    out = lambda df, keep, n, is_kept: df.select(F.col("id").alias(id_col), keep.alias("keep_id"), n.cast("long").alias("group_size"), is_kept.alias("kept"), F.col("digest").alias("text_sha256"))
    return out(joined, F.col("keep_id"), F.col("group_size"), F.col("row") == F.col("keep_row")).unionByName(out(found.filter("not open"), F.col("id"), F.lit(1), F.lit(True)))
