"""Token ids in files of directly addressable codes.

A shard stores its ids as chunks: level 0 holds the lowest ``widths[0]`` bits of every id, level 1 the next bits of
those ids that do not fit, and so on.  Each level but the last has a bitmap that says which of its ids continue, and a
directory with the number of set bits before each block of 512, so that the place of any id on the next level is one
directory entry plus a popcount.  Any id, and any range of ids, can thus be read without decoding what precedes it.

Layout of a shard (little endian): ``b"DAC1"``, u8 number of levels, u8 width per level, u64 number of ids, then for
each level u64 number of its ids, the bit-packed chunks, and, except on the last level, the bitmap and the directory
(u64 per block).  Shards are rows of a Parquet table (``part``, ``seq``, ids and ends of its documents, payload), which
any store that Spark writes to can hold; Spark's commit protocol keeps only whole task outputs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, text_of
from .tokens import word_bpe

BLOCK = 512
WIDTHS = (8, 8, 16)
#: A shard is closed when it holds so many ids; one document never spans shards.
SHARD_IDS = 1 << 18


def _pack(values: np.ndarray, width: int) -> bytes:
    if width in (8, 16):
        return values.astype(f"<u{width // 8}").tobytes()
    bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & 1).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def _unpack(raw: np.ndarray, width: int, start: int, end: int) -> np.ndarray:
    """Chunks ``start`` to ``end`` of a packed level; touches only their bytes."""
    if width in (8, 16):
        return raw[start * width // 8 : end * width // 8].view(f"<u{width // 8}").astype(np.uint64)
    low, high = start * width, end * width
    bits = np.unpackbits(raw[low // 8 : -(-high // 8)], bitorder="little")[low % 8 :][: high - low]
    return (bits.reshape(-1, width).astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def build(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The bytes of one shard.  The widths must add up to the bits of the largest id."""
    rest = ids.astype(np.uint64)
    if len(rest) and int(rest.max()) >> sum(widths):
        raise ValueError(f"an id needs more than the {sum(widths)} bits of the levels")
    out = [b"DAC1", bytes([len(widths), *widths]), np.uint64(len(rest)).tobytes()]
    for level, width in enumerate(widths):
        out += [np.uint64(len(rest)).tobytes(), _pack(rest & np.uint64((1 << width) - 1), width)]
        rest = rest >> np.uint64(width)
        if level + 1 < len(widths):
            more = rest > 0
            blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
            out += [np.packbits(more, bitorder="little").tobytes(), (np.cumsum(blocks) - blocks).astype("<u8").tobytes()]
            rest = rest[more]
    return b"".join(out)


class Shard:
    """Random access to the ids of one shard's bytes."""

    def __init__(self, payload: bytes):
        raw = np.frombuffer(payload, np.uint8)
        if payload[:4] != b"DAC1":
            raise ValueError("not a token shard")
        n, at = payload[4], 5
        self.widths, at = tuple(payload[at : at + n]), at + n
        self.n_ids, at = int.from_bytes(payload[at : at + 8], "little"), at + 8
        self.levels = []
        for level, width in enumerate(self.widths):
            count, at = int.from_bytes(payload[at : at + 8], "little"), at + 8
            chunks, at = raw[at : (at := at + -(-count * width // 8))], at
            bitmap = directory = None
            if level + 1 < n:
                bitmap = raw[at : (at := at + -(-count // 8))]
                directory = raw[at : (at := at + 8 * -(-count // BLOCK))]
            self.levels.append((chunks, bitmap, directory))

    def _rank(self, level: int, i: int) -> int:
        """Set bits before position ``i`` of a level's bitmap: a directory entry and at most one block's popcount."""
        _, bitmap, directory = self.levels[level]
        block = min(i // BLOCK, len(directory) // 8 - 1)
        if block < 0:
            return 0
        before = int(directory[8 * block : 8 * block + 8].view("<u8")[0])
        return before + int(np.unpackbits(bitmap[block * BLOCK // 8 : -(-i // 8)], bitorder="little")[: i - block * BLOCK].sum())

    def range(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive) as unsigned 32-bit integers."""
        out = np.zeros(end - start, np.uint64)
        place, shift = np.arange(end - start), 0
        for level, width in enumerate(self.widths):
            if end <= start:
                break
            chunks, bitmap, _ = self.levels[level]
            out[place] |= _unpack(chunks, width, start, end) << np.uint64(shift)
            shift += width
            if bitmap is not None:
                more = np.unpackbits(bitmap[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :][: end - start].astype(bool)
                place, start, end = place[more], self._rank(level, start), self._rank(level, end)
        return out.astype("<u4")

    def __getitem__(self, i: int) -> int:
        return int(self.range(i, i + 1)[0])


def write_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 1, widths: tuple[int, ...] = WIDTHS) -> None:
    """Encodes every document, appends ``end_id``, and writes shards in ascending order of ``id_col``.

    Null texts count as empty, null ids come first, rows with equal ids stay apart and are ordered by their texts'
    hashes; other columns are ignored.  One range shuffle of the texts is all that moves.
    """
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        encoder, schema, part, seq = word_bpe(tokenizer), to_arrow_schema(out), TaskContext.get().partitionId(), 0
        ids, chunks, ends, size = [], [], [], 0
        last = np.array([end_id], "<u4")

        def shard():
            values = [[part], [seq], [ids], [ends], [build(np.concatenate(chunks), widths)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("t")):
                got = encoder.encode(text.as_py())
                if size and size + len(got) + 1 > SHARD_IDS:
                    yield shard()
                    seq, ids, chunks, ends, size = seq + 1, [], [], [], 0
                chunks += [got, last]
                size += len(got) + 1
                ids.append(i)
                ends.append(size)
        if ids:
            yield shard()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    ordered = base.repartitionByRange(n, "id").sortWithinPartitions("id", F.xxhash64("t")).select("id", "t")
    ordered.mapInArrow(shards, out).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, *, id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """One row per document of the files: ``id_col``, ``start`` (ids of all before it), ``n_tokens``, ``ids_crc32`` and,
    if asked for, ``ids``.  Running totals go over one row per written part, then over the shards of each part."""
    files = spark.read.parquet(path)
    sizes = files.select("part", "seq", F.element_at("ends", -1).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seqs = sizes.select("part", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("seq_start"))
    # a row per shard of 2^18 ids: about a millionth of the ids' bytes
    starts = seqs.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("base"))
    kind = files.schema["doc_ids"].dataType.elementType
    out = T.StructType([T.StructField(id_col, kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), *([T.StructField("ids", T.ArrayType(T.LongType()))] if ids else [])])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for b in batches:
            for keys, ends, payload, base in zip(b.column("doc_ids"), b.column("ends"), b.column("payload"), b.column("base").to_pylist()):
                shard, ends = Shard(payload.as_py()), np.array(ends.as_py(), np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                got = [shard.range(x, y) for x, y in zip(begins.tolist(), ends.tolist())]
                columns = [keys.values, pa.array(begins + base), pa.array(ends - begins), pa.array([zlib.crc32(x) for x in got], pa.int64())]
                if ids:
                    columns.append(pa.array([x.astype(np.int64) for x in got], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return files.join(starts, ["part", "seq"]).select("doc_ids", "ends", "payload", "base").mapInArrow(documents, out)


def token_store(docs: DataFrame, **options) -> DataFrame:
    """Writes the documents' ids to new files in the shared folder and returns what is read back from them."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path, ids=False)
