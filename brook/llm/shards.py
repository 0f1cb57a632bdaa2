"""Sharding by vector bin packing: groups of equal texts are placed so that
bytes, words and rows come out even over the shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from brook.llm.common import id_key, ready, scratch, text_key
from brook.llm.quality import SPACES

# Fixed value: bytes that frame a stored text.
FRAME = 8
# Buckets per shard that small groups are hashed into, the share
# of a shard (1/n) that makes a group large, and rows that one task numbers.
BUCKETS = 512
LARGE = 8
NUMBERED = 200_000


def place(items: np.ndarray, n_shards: int) -> np.ndarray:
    """A shard for each item (rows of bytes, words, rows).

    Largest first; each goes where the dot product of its vector with the
    residual capacity is highest.  All dimensions are shares of their totals,
    bytes weigh most because their evenness is the law kept."""
    totals = np.maximum(items.sum(axis=0), 1)
    shares = items / totals * np.array([8.0, 1.0, 1.0])
    residual = np.tile(np.array([8.0, 1.0, 1.0]) / n_shards, (n_shards, 1))
    where = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -items[:, 0])):
        where[i] = s = int(np.argmax(residual @ shares[i]))
        residual[s] -= shares[i]
    return where


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, size, text_crc32, shard, slot`` for every row of ``docs``.

    Law ``bytes``: shard sizes are near equal.  ``size`` is the UTF-8 length
    plus 8; ``slot`` counts from 0 without gaps within a shard.

    Rows with equal texts form a group and share a shard, unless the group
    alone exceeds an eighth of a shard in bytes, words or rows: then it is cut
    into parts of at most that much by a hash of the id and a number that each
    row gets and keeps in a written table (rows may share an id), because a
    group of a third of all rows fits no shard.  Small groups are hashed into
    ``n_shards * 512`` buckets, whose vectors are packed together with the
    parts of large groups.  What the packing sees is bounded by
    ``n_shards * (512 + 3 * 8 + ...)`` rows whatever the input, so it runs on
    the driver, and its answer is broadcast.

    Null texts have size 8 and the checksum of no bytes.  Null ids are placed
    like any other; repeated rows are separate rows with separate slots (which
    of two equal rows gets which slot is arbitrary).  Other columns are not
    read.  An empty table gives an empty result."""
    spark = ready(docs)
    body = F.coalesce(F.col(text_col), F.lit(""))
    # Words are counted by their first characters: white space becomes a
    # blank, a blank run has one end.
    spaced = F.concat(F.lit(" "), F.translate(body, SPACES, " " * len(SPACES)))
    n_words = F.regexp_count(spaced, F.lit(" [^ ]")).cast("long")
    rows = scratch(docs.select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("text_hash"),
                               (F.octet_length(body) + FRAME).cast("long").alias("size"),
                               F.crc32(body.cast("binary")).alias("text_crc32"), n_words.alias("n_words"),
                               F.monotonically_increasing_id().alias("row")), "shard-rows")
    dims = ["size", "n_words", "n_rows"]
    groups = scratch(rows.groupBy("text_hash").agg(F.sum("size").alias("size"), F.sum("n_words").alias("n_words"),
                                                   F.count("*").alias("n_rows")), "shard-groups")
    total = groups.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in dims]).first()
    limit = {d: max(1.0, total[d] / (n_shards * LARGE)) for d in dims}
    n_parts = F.ceil(F.greatest(*[F.col(d) / F.lit(limit[d]) for d in dims])).cast("long")
    # At most n_shards * LARGE groups pass the limit of each dimension.
    large = groups.withColumn("n_parts", n_parts).where("n_parts > 1").select("text_hash", "n_parts")
    large = {r["text_hash"]: r["n_parts"] for r in large.collect()}
    buckets = n_shards * BUCKETS
    parts = spark.createDataFrame(sorted(large.items()), "text_hash long, n_parts long")
    # An item is a bucket of small groups (-1) or a part of a large group.
    part = F.when(F.col("n_parts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc", "row"), F.col("n_parts")))
    item = F.when(F.col("n_parts").isNull(), F.pmod("text_hash", F.lit(buckets))).otherwise(F.col("text_hash"))
    tagged = scratch(rows.join(F.broadcast(parts), "text_hash", "left").select(
        "doc", "text_hash", "size", "text_crc32", "n_words", "row", item.alias("item"), part.cast("long").alias("part")),
        "shard-tagged")
    # A large item's rows are numbered by several tasks.
    lane = F.pmod(F.xxhash64("doc", "row", F.lit(1)), F.lit(max(1, -(-int(total["n_rows"]) // (n_shards * NUMBERED)))))
    tagged = tagged.withColumn("lane", lane)
    # Bounded: buckets and parts, times the lanes of an item.
    sums = tagged.groupBy("item", "part", "lane").agg(F.sum("size").alias("size"), F.sum("n_words").alias("n_words"),
                                                      F.count("*").alias("n_rows"))
    items = sums.groupBy("item", "part").agg(*[F.sum(d).alias(d) for d in dims])
    listed = sorted((r["item"], r["part"], r["size"], r["n_words"], r["n_rows"]) for r in items.collect())
    where = place(np.array([x[2:] for x in listed], float).reshape(-1, 3), n_shards)
    placed = spark.createDataFrame([(x[0], x[1], int(s)) for x, s in zip(listed, where, strict=True)],
                                   "item long, part long, shard int")
    before = Window.partitionBy("shard").orderBy("item", "part", "lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.join(F.broadcast(placed), ["item", "part"]).select(
        "item", "part", "lane", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("offset"))
    numbered = F.row_number().over(Window.partitionBy("item", "part", "lane").orderBy(id_key("doc"), "text_hash", "row"))
    return (tagged.withColumn("rn", numbered).join(offsets, ["item", "part", "lane"])
            .select("doc", "size", "text_crc32", "shard", (F.col("offset") + F.col("rn") - 1).cast("long").alias("slot")))
