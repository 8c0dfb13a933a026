"""Best-fit packing of tokenised documents after a dominance reduction.

The number of sequences depends on the documents' lengths alone, of which there are at most ``capacity`` different
ones.  So one pass counts pieces by length (and by salt, see below); the driver plans on these counts, whose size the
capacity bounds whatever the size of the corpus; and each piece finds its place from its rank among the pieces of its
length.  The plan first fixes what dominance in the sense of Martello and Toth allows (see :func:`reduce`), then packs
the remainder best-fit decreasing, on whole groups of equal bins.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_tree import encode_tree
from .common import text_of, written
from .tokens import byte_bpe

CAPACITY = 1024
#: Ranks are counted within a length and one of so many salts, so that no length, however common, is one task.
SALTS = 256

Pattern = tuple[int, ...]


def reduce(counts: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Takes from ``counts`` (pieces by length) the sets that some best packing holds; returns them with their numbers.

    A set dominates another if the other's members can be split into groups that fit, one each, into the places of its
    own members.  For an item ``j`` a set that dominates every feasible set with ``j`` can be fixed: exchanging items
    turns any packing into one that has it.  Checked here are: nothing else fits; the largest item that fits is an exact
    fit, or no two fit; no two fit better than the largest one; and, where no three fit, a largest item plus the
    largest beside it covering each feasible pair.  Taking items away only removes alternatives, so a set is fixed as
    often as its items last.
    """
    fixed: list[tuple[Pattern, int]] = []

    def left(x: int, j: int) -> int:
        return counts[x] - (x == j)

    def take(*items: int) -> None:
        need = {x: items.count(x) for x in items}
        n = min(counts[x] // k for x, k in need.items())
        for x, k in need.items():
            counts[x] -= n * k
        fixed.append((items, n))

    for j in range(capacity, 0, -1):
        while counts[j]:
            room = capacity - j
            sizes = [x for x in range(1, room + 1) if left(x, j) > 0]
            if not sizes:
                fixed.append(((j,), counts[j]))
                counts[j] = 0
                break
            a = sizes[-1]
            least: list[int] = []
            for x in sizes:
                least += [x] * min(3 - len(least), left(x, j))
                if len(least) == 3:
                    break
            if a == room or len(least) < 2 or least[0] + least[1] > room:
                take(j, a)
                continue
            if len(least) == 3 and sum(least) <= room:
                break
            # at most two items fit beside j
            pairs = []
            for y in sizes:
                k = bisect_right(sizes, room - y) - 1
                while k >= 0 and sizes[k] == y and left(y, j) < 2:
                    k -= 1
                if k >= 0 and sizes[k] >= y:
                    pairs.append((sizes[k], y))
            if all(x + y <= a for x, y in pairs):
                take(j, a)
                continue
            beside = [x for x in sizes if x + a <= room and (x != a or left(a, j) > 1)]
            if beside and all(y <= beside[-1] or x + y <= a for x, y in pairs):
                take(j, a, beside[-1])
                continue
            break
    return fixed


def best_fit(counts: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts; equal bins are handled as one group, so the work does not depend on the counts."""
    by_room: list[list[list]] = [[] for _ in range(capacity + 1)]
    for x in range(capacity, 0, -1):
        todo = counts[x]
        while todo:
            room = next((r for r in range(x, capacity + 1) if by_room[r]), None)
            pattern, n = by_room[room].pop() if room is not None else ((), todo)
            room = capacity if room is None else room
            each = min(room // x, todo)
            used = min(n, todo // each)
            by_room[room - each * x].append([pattern + (x,) * each, used])
            if n > used and pattern:
                by_room[room].append([pattern, n - used])
            todo -= each * used
    return [(tuple(p), n) for groups in by_room for p, n in groups]


def plan(counts: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of lengths and how many sequences have each."""
    counts = list(counts)
    return [x for x in [*reduce(counts, capacity), *best_fit(counts, capacity)] if x[1]]


def places(patterns: list[tuple[Pattern, int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, in order of rank: first rank, sequence of that rank, and offset, of each run of equal places."""
    found: dict[int, list] = {}
    rank, sequence = [0] * (capacity + 1), 0
    for pattern, n in patterns:
        offset = 0
        for x in pattern:
            found.setdefault(x, []).append((rank[x], sequence, offset))
            rank[x] += n
            offset += x
        sequence += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in found.items()}


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    Only documents longer than ``capacity`` (with their end id) are cut; their first piece takes what is over.  Null
    texts count as empty, repeated ids stay separate rows and other columns are ignored.
    """
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        encoder, schema = byte_bpe(tokenizer), to_arrow_schema(out)
        for b in batches:
            rows: list[tuple] = []
            for i, text in zip(b.column("id").to_pylist(), b.column("t")):
                ids = np.append(encode_tree(encoder, text.as_py()), end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                ends = [min(first, len(ids)), *range(first + capacity, len(ids) + 1, capacity)]
                start = 0
                for k, end in enumerate(ends):
                    rows.append((i, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start = end
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).mapInArrow(cut, out).withColumnRenamed("id", id_col)


def place(cut: DataFrame, *, id_col: str = "doc_id", capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a stable table of pieces (it is read twice)."""
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    # at most capacity * salts rows, whatever the size of the corpus
    counted = salted.groupBy("length", "salt").count().collect()
    counts, before = np.zeros((capacity + 1, salts), np.int64), None
    for r in counted:
        counts[r["length"], r["salt"]] = r["count"]
    before = np.cumsum(counts, axis=1) - counts
    table = places(plan(counts.sum(axis=1).tolist(), capacity), capacity)
    within = Window.partitionBy("length", "salt").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1)
    kept = len(cut.columns)
    out = T.StructType([*cut.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False) + before[length, b.column("salt").to_numpy(zero_copy_only=False)]
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = length == x
                first, base, off = table[int(x)]
                k = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = base[k] + rank[at] - first[k], off[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(sequence), pa.array(offset)], names=out.names)

    return ranked.mapInArrow(look_up, out)


def pack(docs: DataFrame, *, id_col: str = "doc_id", capacity: int = CAPACITY, salts: int = SALTS, **options) -> DataFrame:
    """Cuts, counts and places all documents.  The pieces (a few numbers each) are written once, between the passes."""
    return place(written(pieces(docs, id_col=id_col, capacity=capacity, **options), "pieces"), id_col=id_col, capacity=capacity, salts=salts)
