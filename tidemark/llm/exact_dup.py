"""Exact duplicates through an extendible-hash index on shared files.

Every row gives an entry (64-bit key, SHA-256, row number), written once to the shared folder. Entries of equal key and digest
are one link; the links of one key are its chain. The directory has a slot for each value of the leading `DEPTH` bits of a key.
It starts with one bucket and doubles: a bucket of more than `CAPACITY` links splits by the next bit, so that its local depth is
the least at which no bucket is overfull. A bucket is a range of keys; its owner task sorts the bucket's links by key and writes
them to the index pages.

Chains of one row are done. The texts of the others are read again and compared byte by byte: rows are grouped by key and whole
text, which takes copies together in the task that reads them, so that a text crosses the shuffle once for each such task,
however many copies it has. Which rows to read again is told by a bitmap over keys of `BITS` bits at most (8 MB, broadcast);
a bit set by another key costs a needless comparison and no more. Groups of more than a `HEAVY`th of all rows, of which there
are fewer than `HEAVY`, come back to their rows by broadcast, the others by a shuffle join, so no key has more than that share
in one task.

All of it is DataFrame functions. A null text counts as empty. Of equal texts the row of the largest doc_id stays, a null one
counting least; of rows with one doc_id and one text a single one stays. keep_id is null if no row of the group has an id.
Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import dropped, only, stored

#: Leading bits of a key that the directory tells apart (at most 2^DEPTH slots), links of a bucket before it splits.
DEPTH, CAPACITY = 14, 1 << 16
#: Bits of the bitmap of keys to compare; the share of all rows beyond which a group is sent to its rows.
BITS, HEAVY = 1 << 26, 1000


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def entries(docs: DataFrame) -> DataFrame:
    """A stored row for each of docs: doc_id, key, sha, row (a number of its own)."""
    whole = F.coalesce("text", F.lit("")).cast("binary")
    each = only(docs, "doc_id", "text").select("doc_id", _key(F.col("text")).alias("key"), F.unhex(F.sha2(whole, 256)).alias("sha"))
    return stored(each.withColumn("row", F.monotonically_increasing_id()))


def directory(links: DataFrame, capacity: int = CAPACITY, depth: int = DEPTH) -> DataFrame:
    """slot, local_depth, bucket of every slot that has links. A bucket is numbered 2^local_depth + its leading bits."""
    fill = links.groupBy("slot").agg(F.count("*").alias("n"))  # at most 2^depth rows from here on
    each = fill.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    prefix = F.expr(f"shiftrightunsigned(slot, {depth} - d)")
    each = each.withColumn("prefix", prefix)
    total = each.groupBy("d", "prefix").agg(F.sum("n").alias("total"))  # less than 2^(depth + 1) rows
    full = each.join(F.broadcast(total), ["d", "prefix"])
    local = full.where((F.col("total") <= capacity) | (F.col("d") == depth)).groupBy("slot").agg(F.min("d").alias("local_depth"))
    return local.withColumn("bucket", F.expr(f"shiftrightunsigned(slot, {depth} - local_depth) + shiftleft(1, local_depth)"))


def index(each: DataFrame, capacity: int = CAPACITY, depth: int = DEPTH) -> DataFrame:
    """The index pages, stored: bucket, key, sha, n, top (doc_id and row of the row that stays)."""
    links = each.groupBy("key", "sha").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("top"))
    links = links.withColumn("slot", F.shiftrightunsigned("key", 64 - depth).cast("int"))
    owned = links.join(F.broadcast(directory(links, capacity, depth)), "slot")  # at most 2^depth slots
    return stored(owned.select("bucket", "key", "sha", "n", "top").repartition("bucket").sortWithinPartitions("bucket", "key", "sha"))


def _suspects(docs: DataFrame, pages: DataFrame, bits: int) -> DataFrame:
    """doc_id, key, text of the rows whose key may be that of a chain of several rows."""
    place = F.pmod("key", F.lit(bits))
    marked = pages.where("n > 1").select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("page"))
    maps = marked.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))  # 4 KB for each 32,768 bits
    rows = only(docs, "doc_id", "text").select("doc_id", _key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substr("map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place) == maps["page"])
    return met.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select("doc_id", "key", "text")


def compared(docs: DataFrame, pages: DataFrame, bits: int = BITS) -> DataFrame:
    """key, sha, group_size, keep_id, keep_row of each group of two or more equal texts, whose bytes were compared."""
    same = _suspects(docs, pages, bits).groupBy("key", "text").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    groups = same.where("group_size > 1").select("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "group_size", "keep_id")
    return groups.join(pages.where("n > 1").select("key", "sha", F.col("top.row").alias("keep_row")), ["key", "sha"])


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, depth: int = DEPTH, bits: int = BITS, heavy: int = HEAVY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, sha of each row of docs."""
    each = entries(docs)
    pages = index(each, capacity, depth)
    groups = stored(compared(docs, pages, bits))
    dropped(pages)
    hot = F.col("group_size") * heavy > F.lit(each.count())
    known = each.join(F.broadcast(groups.where(hot)), ["key", "sha"], "left")  # fewer than `heavy` groups
    rest = known.where("group_size is null").drop("group_size", "keep_id", "keep_row").join(groups.where(~hot), ["key", "sha"], "left")
    alone = F.col("group_size").isNull()
    return known.where("group_size is not null").unionByName(rest).select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "sha",
    )
