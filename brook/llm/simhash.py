"""Near duplicates by SimHash: fingerprints over word shingles and an exact,
tiled search for all fingerprints within a bit radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brook.llm.common import NO_ID, components, id_key, partitions_for, ready, scratch, spare, text_key
from brook.llm.links import roots

# Fixed value: fingerprints per tile (256 KB); tile pairs stay near 500 KB.
TILE = 32_768
# Fixed value: rows of a tile compared with the other tile at once (16 MB).
STRIP = 64
# Fixed value: shingles counted at once, so very long texts stay bounded.
COUNTED = 32_768


def fingerprint(text: bytes | None, words_per_shingle: int = 4) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit number.

    A-Z are lower-cased, words are what lies between ASCII white space, a
    shingle is ``words_per_shingle`` words joined by one space (a shorter text
    is one shingle), hashed by XXH64 with seed 42.  A bit is set if it is set
    in over half of the hashes, repeats included.  No words or no text: 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_per_shingle, len(words))
    pairs = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)
    n = len(words) - k + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[s:e], 42) for s, e in pairs), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, COUNTED):
        part = hashes[i:i + COUNTED].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words_per_shingle: int = 4) -> DataFrame:
    """``doc, text_hash, fp`` of every row of ``docs`` (see ``fingerprint``)."""
    ready(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t, words_per_shingle) for t in b.column("t").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("text_hash"), fp], ["doc", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("text_hash"),
                       F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc long, text_hash long, fp long")


def _spanning(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the fingerprints of a tile, or between two tiles."""
    own = b is None
    every = (a if own else np.concatenate([a, b])).view(np.uint64)  # bitwise_count takes signed numbers' magnitude
    a, other = every[:len(a)], every[0 if own else len(a):]
    shift, p = (0 if own else len(a)), np.arange(len(every))
    for i in range(0, len(a), STRIP):
        near = np.bitwise_count(a[i:i + STRIP, None] ^ other[None, i if own else 0:]) <= radius
        x, y = np.nonzero(near)
        if len(x):
            p = roots(len(every), x + i, y + (i if own else shift), p)
    linked = np.flatnonzero(p != np.arange(len(p)))
    return every[linked].view(np.int64), every[p[linked]].view(np.int64)


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints (distinct ``fp`` longs)
    within ``radius`` bits of each other: every pair that the radius joins is
    connected by the links, and no link is longer than a chain of such pairs.

    Tiled and exact.  A tile holds fingerprints of one population count; two
    tiles whose counts differ by more than the radius are never paired.  What
    a pair of tiles finds leaves its task as a spanning forest."""
    spark = ready(fps)
    sized = fps.withColumn("pop", F.bit_count("fp"))
    # At most 65 rows, one for each population count.
    tiles_of = {r["pop"]: -(-r["n"] // TILE) for r in sized.groupBy("pop").agg(F.count("*").alias("n")).collect()}
    if not tiles_of:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    parts = F.element_at(F.create_map(*[F.lit(int(x)) for kv in tiles_of.items() for x in kv]), F.col("pop"))
    tiles = scratch(sized.groupBy("pop", F.pmod(F.xxhash64("fp"), parts).alias("part"))
                    .agg(F.collect_list("fp").alias("fps")), "simhash-tiles")
    left = tiles.select("pop", "part", "fps", F.explode(F.sequence("pop", F.col("pop") + radius)).alias("pop2"))
    right = tiles.select(F.col("pop").alias("pop2"), F.col("part").alias("part2"), F.col("fps").alias("fps2"))
    pairs = left.join(right, "pop2").where("pop2 > pop OR part2 >= part").select(
        "fps", F.when(~((F.col("pop") == F.col("pop2")) & (F.col("part") == F.col("part2"))),
                      F.col("fps2")).alias("fps2"))
    n_pairs = sum(n * (sum(tiles_of.get(p + d, 0) for d in range(1, radius + 1)) + (n + 1) / 2)
                  for p, n in tiles_of.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.column("fps")[i].values.to_numpy(zero_copy_only=False)
                two = batch.column("fps2")[i]
                two = two.values.to_numpy(zero_copy_only=False) if two.is_valid else None
                a, b = _spanning(one, two, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # Sixteen tile pairs are about 8 MB: one small task each.
    spread = max(partitions_for(spark), int(n_pairs) // 16)
    return pairs.repartition(spread).mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   words_per_shingle: int = 4, radius: int = 4) -> DataFrame:
    """Near-duplicate groups of ``docs``: ``doc, text_hash, fp, group_fp,
    component_id`` for every row.

    Two documents are linked if their fingerprints differ in at most
    ``radius`` bits; ``component_id`` is the smallest document id reachable
    over links, itself included, ``group_fp`` a fingerprint that names the
    group.  Equal fingerprints are one node, so copies never form pairs.

    Null or empty texts and texts without words have fingerprint 0 and are
    linked with each other.  A null id takes part in its group but is never
    its smallest id; a group of null ids only has a null ``component_id``.
    Repeated rows are rows of the same group.  Other columns are not read, so
    their names cannot clash.  An empty table gives an empty result."""
    rows = scratch(fingerprints(docs, id_col, text_col, words_per_shingle), "simhash-rows")
    nodes = scratch(rows.groupBy("fp").agg(F.min("doc").alias("first")), "simhash-nodes")
    found = components(links(nodes.select("fp"), radius))
    grouped = scratch(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
                      .select("fp", "first", F.coalesce("component", "fp").alias("group_fp")), "simhash-groups")
    first = grouped.groupBy("group_fp").agg(F.min("first").alias("component_id"))
    named = grouped.select("fp", "group_fp").join(first, "group_fp")
    return rows.join(named, "fp").select("doc", "text_hash", "fp", "group_fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         words_per_shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with
    the smallest id (a null id last; ties: the smallest text hash).  Repeated
    rows of the document that stays are one row."""
    groups = simhash_groups(docs, id_col, text_col, words_per_shingle, radius)
    order = F.struct(F.coalesce("doc", F.lit(NO_ID)).alias("id"), F.col("text_hash").alias("hash"))
    doc, text = spare(docs, "_doc", "_text")
    best = groups.groupBy("group_fp").agg(F.min(order).alias("k")).select(F.col("k.id").alias(doc), F.col("k.hash").alias(text))
    keyed = docs.withColumns({doc: id_key(id_col), text: text_key(text_col)})
    return keyed.join(best, [doc, text], "left_semi").dropDuplicates([doc, text]).drop(doc, text)
