"""Shards of documents by extendible hashing.

A document's key is hashed to bits. The directory is indexed by a prefix of these bits, and a
bucket is a prefix: it holds all documents whose hash starts with it. A bucket over the byte limit
is split on its next bit, and only such buckets are; all others keep their prefix. So shards
differ in depth, and no document moves when another bucket splits.

The directory is built from a histogram of bytes by prefix. A round adds up the open prefixes at a
few depths at once and closes the ones that fit; only rows of prefixes that are still too large go
on to the next round. Nothing of the size of the corpus is held on the driver.

Rows with equal keys cannot be told apart by the hash of the key. After its 64 bits come those of
the hash of a row number that was written with the staged keys, so a key that owns a third of all
rows is split like any other. A single document larger than the limit is a shard of its own, with
``oversized`` true: documents are never cut.

Defined cases: a null text has no bytes, a null key is a key. An empty table gives no shards.
Other columns are not read by the directory and stay with their rows when ``write_shards`` writes
shards, which has a folder of its own for each; a column that has the name of the folders keeps it.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from contentloom.llm.texts import bits_of
from contentloom.session import remove_stages, stage, staged

BITS = 128


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """Staged ``id``, ``bytes`` of the text, the two halves of the hash, and ``row`` if it is given."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("bytes"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
    )
    given = [] if row is None else ["row"]
    return stage(rows.select("id", "bytes", F.xxhash64("id").alias("high"), F.xxhash64("row").alias("low"), *given), "keys")


def hash_bits() -> Column:
    return F.concat(bits_of(F.col("high")), bits_of(F.col("low")))


def directory(keys: DataFrame, limit: int, step: int = 5) -> DataFrame:
    """``prefix``, ``depth``, ``docs``, ``bytes`` and ``oversized`` of each shard."""
    total = keys.agg(F.sum("bytes").alias("bytes")).first()["bytes"] or 0
    low, high = 0, max(1, math.ceil(math.log2(max(total, 1) / limit)) + 2)
    rows, shards = keys, None
    while True:
        cells = rows.groupBy(F.substring(hash_bits(), 1, high).alias("cell")).agg(
            F.count("*").alias("docs"), F.sum("bytes").alias("bytes")
        )
        cells = stage(cells, "cells")
        depths = F.sequence(F.lit(low), F.lit(high))
        at_depths = cells.select("*", F.explode(depths).alias("depth")).withColumn("prefix", F.expr("left(cell, depth)"))
        sums = at_depths.groupBy("depth", "prefix").agg(F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes"))
        fits = (F.col("bytes") <= limit) | (F.col("docs") == 1) | (F.col("depth") == BITS)
        fitting = sums.where(fits)
        # The bucket of a cell is its shortest prefix that fits.
        shortest = at_depths.join(fitting.select("depth", "prefix"), ["depth", "prefix"]).groupBy("cell").agg(
            F.min("depth").alias("depth")
        )
        prefixes = shortest.select(F.expr("left(cell, depth)").alias("prefix"), "depth").distinct()
        closed = stage(fitting.join(prefixes, ["prefix", "depth"]), "shards")
        shards = closed if shards is None else shards.unionByName(closed)
        open_cells = stage(cells.join(shortest, "cell", "left_anti").select("cell"), "open-cells")
        if high == BITS or open_cells.isEmpty():
            break
        rows = stage(
            rows.withColumn("cell", F.substring(hash_bits(), 1, high)).join(open_cells, "cell", "left_semi").drop("cell"),
            "open-keys",
        )
        low, high = high + 1, min(high + step, BITS)
    return shards.select(
        "prefix", F.col("depth").cast("int").alias("depth"), "docs", "bytes", (F.col("bytes") > limit).alias("oversized")
    )


def assign(keys: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows of ``keys`` with their shard. Every row has exactly one: it is met at each depth that
    occurs, and one of these prefixes is a shard."""
    depths = [r.depth for r in shards.select("depth").distinct().orderBy("depth").collect()]  # at most 129
    tried = keys.withColumn("bits", hash_bits()).withColumn(
        "depth", F.explode(F.array(*(F.lit(d) for d in depths)) if depths else F.array().cast("array<int>"))
    )
    tried = tried.withColumn("prefix", F.expr("left(bits, depth)")).drop("bits")
    return tried.join(shards, ["prefix", "depth"])


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``bytes``, and ``prefix``, ``depth`` and size of the shard of every row."""
    keys = keyed(docs, id_col, text_col)
    shards = stage(directory(keys, limit), "directory")
    return assign(keys, shards).select(
        "id",
        keys["bytes"].alias("doc_bytes"),
        F.col("prefix").alias("shard"),
        "depth",
        shards["docs"].alias("shard_docs"),
        shards["bytes"].alias("shard_bytes"),
        "oversized",
    )


def write_shards(
    docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", folder_col: str = "shard"
) -> DataFrame:
    """Write all columns of all rows as Parquet, one file for each shard, in a folder
    ``shard=b<prefix>`` of its own (``b`` keeps prefixes text, and names that of the only shard).
    Returns ``prefix``, ``depth``, ``docs``, ``bytes`` and ``oversized`` of each shard.

    Rows are numbered in a written copy, so a task that is repeated finds the same numbers. Narrow rows
    find their shard; texts move twice, to their shard's name and to their shard. A task writes one
    shard after the other and holds a batch of rows of one. Files of an earlier call are replaced.
    An empty table writes no shard.
    """
    there = set(staged())
    while folder_col.lower() in (c.lower() for c in docs.columns):
        folder_col += "_"
    numbered = stage(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    keys = keyed(numbered, f"doc.`{id_col}`", f"doc.`{text_col}`", F.col("row"))
    shards = stage(directory(keys, limit), "directory")
    names = assign(keys, shards).select("row", F.concat(F.lit("b"), "prefix").alias("name"))
    placed = numbered.join(names, "row").select("doc", "name")
    # As many tasks as hold a few shards each.
    tasks = min(max(shards.count(), 1), 20_000)
    rows = placed.repartition(tasks, "name").select("doc.*", F.col("name").alias(folder_col))
    rows.write.mode("overwrite").partitionBy(folder_col).parquet(path)
    remove_stages(docs.sparkSession, [p for p in staged() if p not in there and "/directory-" not in p])
    return shards
