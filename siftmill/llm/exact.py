"""Exact dedup by an extendible-hash index in shared files; DataFrame functions only.

Every text has a key of 64 bits.  The index holds one entry for each different text: its key, how many rows have it and which
of them stays.  A directory deals the entries to buckets by the leading bits of their keys: it starts with one bucket and is
doubled, splitting what holds more than ``capacity`` entries, until nothing does.  A bucket is a range of keys, the tasks
that own ranges write the entries in order of key, and the entries of texts that differ but share a key are chained there.

Bytes are compared wherever a key repeats: texts of repeated keys meet by grouping on the text itself, of which every task
sends one copy.  A bitmap of bounded size keeps the texts of other keys where they are; what it lets through for nothing
changes no result.  Rows look their entry up by key, and in a chain by the SHA-256 of their text too.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Leading bits of a key that the directory may use: it has at most 2 ** MOST_BITS rows of two numbers.
MOST_BITS = 20
#: Bitmaps of the filter, each of BLOCK_BITS bits (4 KB): at most 16 MB are broadcast, whatever the table.
MOST_BLOCKS, BLOCK_BITS = 4096, 32768


def directory(entries: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """The directory over entries (key): for each value of the first ``bits`` bits of a key that occurs, its bucket (the
    bucket's first such value) and the bits that its bucket uses; and ``bits``.

    Only the counts of at most 2 ** MOST_BITS prefixes are looked at when a bucket splits.  Keys that agree in all these bits
    stay in one bucket."""
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, entries.count()) / capacity))) + 3)
    counts = materialise(entries.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("prefix")).agg(F.count("*").alias("n")), "prefixes")
    buckets = counts.select("prefix", "n", F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("depth"))
    for depth in range(bits):
        full = buckets.where(F.col("depth") == depth).groupBy("bucket").agg(F.sum("n").alias("held")).where(F.col("held") > capacity).select("bucket", F.lit(True).alias("full"))
        if full.isEmpty():
            break
        size = 1 << (bits - depth - 1)  # prefixes of one half
        half = F.col("prefix") - F.pmod(F.col("prefix"), F.lit(size))
        split = F.col("full").isNotNull() & (F.col("depth") == depth)
        buckets = buckets.join(full, "bucket", "left").select("prefix", "n", F.when(split, half).otherwise(F.col("bucket")).alias("bucket"), F.when(split, depth + 1).otherwise(F.col("depth")).alias("depth"))
        buckets = materialise(buckets, "directory")
    return buckets.select("prefix", "bucket", "depth"), bits


def _among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is among ``keys``, and some of others, by a broadcast bitmap: about 16 bits a key, at most MOST_BLOCKS blocks."""
    blocks = min(MOST_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, 16 * keys.count()) / BLOCK_BITS))))
    block, bit = F.pmod(F.shiftright("key", 15), F.lit(blocks)), F.col("key").bitwiseAND(BLOCK_BITS - 1)
    maps = keys.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(bit).alias("bitmap"))
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("block", block).join(F.broadcast(maps), "block").where(F.getbit(byte, bit.bitwiseAND(7)) == 1).drop("block", "bitmap")


def build_index(docs: DataFrame, capacity: int = 1 << 20, key: Callable[[str], Column] = F.xxhash64, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows (id, row, key, sha: one per document) and the index (bucket, depth, key, chain, sha, n, stays).

    ``sha`` is null in entries that have their key to themselves.  ``stays`` is the row of the largest id (null ids are the
    smallest); of repeated rows it is one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", key("text").cast("long"))
    light = source.select("id", "key", F.unhex(F.sha2("text", 256)).alias("sha"))
    rows = materialise(light.withColumn("row", F.monotonically_increasing_id()), "rows")
    of_group = [F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("stays")]
    keys = materialise(rows.groupBy("key").agg(*of_group), "keys")

    repeated = keys.where("n > 1").select("key")
    texts = _among(source, repeated).groupBy("key", "text").agg(F.count("*").alias("n"))
    clashes = materialise(texts.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key"), "clashes")
    entries = keys.join(clashes, "key", "left_anti").select("key", F.lit(None).cast("binary").alias("sha"), "n", "stays")
    if not clashes.isEmpty():
        chained = rows.join(clashes, "key", "left_semi").groupBy("key", "sha").agg(*of_group)
        entries = entries.union(chained.select(*entries.columns))
    entries = materialise(entries, "entries")

    buckets, bits = directory(entries, capacity)
    placed = entries.withColumn("prefix", F.shiftrightunsigned("key", 64 - bits)).join(F.broadcast(buckets), "prefix").drop("prefix")
    index = placed.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "sha")
    return rows, materialise(index, "index")


def exact_copies(docs: DataFrame, capacity: int = 1 << 20, key: Callable[[str], Column] = F.xxhash64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their bytes are; a null text is an empty one.  Of equal texts the row with the largest id stays, and
    of repeated rows exactly one; a null id stays only where all ids of its group are null (keep_id is then null).  Empty
    texts are one group.  Other columns are ignored; an empty table gives no rows."""
    rows, index = build_index(docs, capacity, key, id_col, text_col)
    entry = index.select(F.col("key").alias("own"), F.col("sha").alias("of"), "n", "stays")
    met = rows.join(entry, (F.col("key") == F.col("own")) & (F.col("of").isNull() | (F.col("of") == F.col("sha"))))
    kept = F.col("row") == F.col("stays.row")
    return met.select(F.col("id").alias(id_col), F.col("stays.id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
