"""SentencePiece encoding and decoding through a distinct-chunk table.

A chunk is a marked word: a run of spaces and what follows up to the next
space.  Where no piece holds the whitespace marker after another character,
pieces cannot cross chunks, and a text's ids are its chunks' ids in order.  So
the texts are read in blocks, each block sends its distinct chunks to the
bucket of their hash, a bucket segments each distinct chunk once, and the ids
go back to the blocks, where each text looks its chunks up by position."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brook.llm.arrays import Ragged, taken
from brook.llm.common import partitions_for, ready, text_key

# The marker that SentencePiece puts for a space, characters of
# text in a block, and chunks that a bucket's task remembers at most.
MARK = "▁"
BLOCK = 24_000_000
REMEMBERED = 500_000
CHUNK = re.compile(" +[^ ]*")


# What blocks and buckets send each other.
LISTS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("chunks", pa.binary())])
FOUND = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("check", pa.int64()), ("n", pa.int64()),
                   ("size", pa.int64()), ("ids", pa.binary()), ("odd", pa.list_(pa.string()))])
TEXTS = pa.schema([("block", pa.int64()), ("rows", pa.binary())])


def load_model(path: str) -> bytes:
    """The model file, after a check that chunks can be segmented alone: no
    piece holds the marker after another character, the normaliser changes
    nothing, a space is put before the text, and no piece is user-defined."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        model = f.read()
    proto = sentencepiece_model_pb2.ModelProto.FromString(model)
    norm = proto.normalizer_spec
    plain = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces \
        and norm.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
    if not plain or any(MARK in p.piece.lstrip(MARK) or p.type == p.USER_DEFINED for p in proto.pieces):
        raise ValueError(f"{path}: its pieces can cross whitespace markers; chunks cannot be segmented alone")
    return model


def chunks_of(text: str | None) -> list[str]:
    """The chunks of a text, the space that the model puts first included."""
    return CHUNK.findall(" " + text.replace(MARK, " ")) if text else []


class Segmenter:
    """Ids and decoded text of single chunks."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.mark = self.sp.piece_to_id(MARK)

    def ids(self, chunks: list[str]) -> list[list[int]]:
        # The model puts a space first, so the chunk's own first one is left off.
        out = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        return [x if len(c) > 1 else [self.mark] for x, c in zip(out, chunks, strict=True)]

    def text(self, ids: list[int]) -> str:
        return " " + self.sp.decode(ids)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _zip(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _unzip(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, bool]]:
    """Batches with the number of their block, and if the block ends there."""
    at, n, size = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        size += b.column("t").nbytes
        ends = size >= BLOCK
        yield at << 32 | n, b, ends
        if ends:
            n, size = n + 1, 0


def _bucketed(distinct: set[str], n_buckets: int) -> dict[int, list[str]]:
    """Chunks by the bucket of their hash, sorted.  Chunks of spaces alone are
    left out (a block segments them itself), so a bucket's list is told apart
    again by the chunk pattern."""
    out: dict[int, list[str]] = {}
    for c in sorted(distinct):
        if c[-1] != " ":
            out.setdefault(zlib.crc32(c.encode()) % n_buckets, []).append(c)
    return out


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, text_hash, ids array<int>, decoded string`` of every row of
    ``docs``: the ids of the whole text as the model of ``model_path`` encodes
    it, without begin or end ids, and what the model decodes from them.

    A block's distinct chunks travel as one compressed list per bucket, its
    texts as compressed batches.  A bucket remembers the chunks it has
    segmented (up to a bound, after which it segments again).  Blocks are runs
    of rows of an input partition; should a re-run read them in another order,
    a list's checksum differs and the block segments those chunks itself, so
    the result does not depend on it.

    Null and empty texts give no ids and an empty text.  Very long texts are
    blocks of their own.  Repeated rows are encoded row by row; null ids are
    carried through; other columns are not read.  An empty table gives an
    empty result."""
    spark = ready(docs)
    model = load_model(model_path)
    n_buckets = partitions_for(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("text_hash"),
                       F.col(text_col).alias("t"))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            for bucket, chunks in _bucketed(distinct, n_buckets).items():
                data = "".join(chunks).encode()
                yield pa.RecordBatch.from_pydict(
                    {"bucket": [bucket], "block": [block], "size": [len(data)], "chunks": [_zip(data)]}, LISTS)

        distinct: set[str] = set()
        block = None
        for block, b, ends in _blocks(batches):
            for t in b.column("t"):
                distinct.update(chunks_of(t.as_py()))
            if ends:
                yield from out()
                distinct = set()
        if distinct:
            yield from out()

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Segmenter(model)
        known: dict[str, int] = {}
        table, odd = Ragged(), {}
        for b in batches:
            for bucket, block, size, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "size", "chunks")),
                                                 strict=True):
                raw = _unzip(data, size)
                chunks = CHUNK.findall(raw.decode())
                if len(known) > REMEMBERED:
                    known, table, odd = {}, Ragged(), {}
                new = [c for c in chunks if c not in known]
                ids = one.ids(new)
                known.update(zip(new, range(table.n, table.n + len(new)), strict=True))
                for c, x in zip(new, ids, strict=True):
                    if (text := one.text(x)) != c:
                        odd[c] = text
                table.add(ids)
                at = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
                sizes = (table.ends[at + 1] - table.ends[at]).astype(np.int32)
                flat = table.take(at).astype(np.int32)
                body = sizes.tobytes() + flat.tobytes()
                yield pa.RecordBatch.from_pydict(
                    {"bucket": [bucket], "block": [block], "check": [zlib.crc32(raw)], "n": [len(chunks)],
                     "size": [len(body)], "ids": [_zip(body)], "odd": [[x for c in chunks if c in odd for x in (c, odd[c])]]}, FOUND)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b, _ in _blocks(batches):
            yield pa.RecordBatch.from_pydict({"block": [block], "rows": [_packed(b)]}, TEXTS)

    def join(packed: pa.Table, found: pa.Table) -> pa.Table:
        distinct: set[str] = set()
        for data in packed.column("rows"):
            for t in _unpacked(data.as_py()).column("t"):
                distinct.update(chunks_of(t.as_py()))
        own = _bucketed(distinct, n_buckets)
        known: dict[str, int] = {}
        sizes, flats, odd = [], [], {}
        for i in range(found.num_rows):
            bucket, check, n, size, data, pairs = (found.column(c)[i].as_py() for c in
                                                   ("bucket", "check", "n", "size", "ids", "odd"))
            chunks = own.get(bucket, [])
            if len(chunks) != n or zlib.crc32("".join(chunks).encode()) != check:
                continue
            body = np.frombuffer(_unzip(data, size), np.int32)
            known.update(zip(chunks, range(len(known), len(known) + n), strict=True))
            sizes.append(body[:n])
            flats.append(body[n:])
            odd.update(zip(pairs[::2], pairs[1::2], strict=True))
        rest = [c for c in distinct if c not in known]
        if rest:
            one = Segmenter(model)
            ids = one.ids(rest)
            known.update(zip(rest, range(len(known), len(known) + len(rest)), strict=True))
            sizes.append(np.fromiter(map(len, ids), np.int32, len(ids)))
            flats.append(np.fromiter((x for y in ids for x in y), np.int32))
            odd.update((c, t) for c, x in zip(rest, ids, strict=True) if (t := one.text(x)) != c)
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int32)]), dtype=np.int64)])
        flat = np.concatenate([*flats, np.zeros(0, np.int32)])
        out = []
        for data in packed.column("rows"):
            table = _unpacked(data.as_py())
            lengths, ids, decoded = [], [], []
            for t in table.column("t"):
                chunks = chunks_of(t.as_py())
                got = taken(ends, flat, np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks)))
                lengths.append(len(got))
                ids.append(got)
                # The text of the first chunk begins with the space that was put first.
                decoded.append("".join([odd.get(c, c) for c in chunks] if odd else chunks)[1:])
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
            lists_ = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
            out.append(pa.table({"doc": table.column("doc"), "text_hash": table.column("text_hash"),
                                 "ids": lists_, "decoded": pa.array(decoded, pa.string())}))
        schema = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("ids", pa.list_(pa.int32())),
                            ("decoded", pa.string())])
        return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()

    sent = rows.mapInArrow(lists, "bucket long, block long, size long, chunks binary")
    back = (sent.repartition(n_buckets, "bucket")
            .mapInArrow(segment, "bucket long, block long, check long, n long, size long, ids binary, odd array<string>"))
    packed = rows.mapInArrow(texts, "block long, rows binary")
    return packed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        join, "doc long, text_hash long, ids array<int>, decoded string")


def decode(ids: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``ids`` with ``text_col``: what the model decodes from each list of ids
    (any lists, not only those of ``encode``).  A null list gives a null text,
    an empty one an empty text."""
    ready(ids)
    model = load_model(model_path)

    @F.pandas_udf("string")
    def text(x):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        return x.map(lambda v: None if v is None else sp.decode([int(i) for i in v]))

    return ids.withColumn(text_col, text(ids_col))
