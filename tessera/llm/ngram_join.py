"""Exact Jaccard self-join of documents on sets of word shingles.

Words are what stands between ASCII white space, with A-Z in small letters; a document's set holds the 64-bit hashes of
its distinct shingles, all bits of which are compared (so results are exact up to collisions, at about n*n/2**64 for a
pair with n shingles each).

1. Equal sets are one node.  Shingles that recur within blocks of the corpus are counted over all documents; they only
   decide an order, rare before common, by hash among the uncounted.
2. Each node sends the first shingles of its order, as many as an intersection of the asked size cannot all miss, to
   tiles: one per shingle, ordered by set size so that only bands of compatible sizes meet.  A row stays in its tile only
   if sizes and positions leave it a partner there.  A tile of a very common shingle is split into parts.
3. Rows that stay get the hashed bitmap of their set.  Bits that one bitmap lacks count shingles outside the
   intersection; this bound is applied before a pair leaves its tile.  Each node proposes one partner, the smallest
   centre that it passes the bound with in any of its tiles; these pairs are checked by exact intersection of sorted
   arrays, and links give provisional components.
4. Nodes that share a tile and pass the bounds, but are in different components, propose again, one partner each, and then
   all such pairs are checked.  A group of near copies is one component by then, so its pairs are never made; yet no
   link between components is lost.  Within a tile only rows outside its most frequent component look for partners, and
   in a split tile only these are sent to every part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, text_of, trim, written
from .components import components

WORDS, PERCENT = 5, 75
#: A shingle is common from so many documents; at most MOST_COMMON of them are told apart, by their counts.
COMMON, MOST_COMMON = 24, 1 << 20
#: Shingles counted at a time within a task; those seen three times in a block take part in the counts.
BLOCK = 1 << 21
#: A tile of about so many rows is one part; those of more common shingles are split.
PART = 50_000
#: Tiles of up to so many rows are worked at many at a time, all pairs of each; larger ones by themselves.
NEAR = 16
#: Bits of the shortest bitmap and of the longest; larger sets are folded to that.
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 13
#: Bits of the filter of nodes that need their sets; its size does not depend on the corpus.
FILTER_BITS = 26
_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


#: Words are hashed by polynomials over random bytes' values, many at a time; longer ones one by one.
_LONG, _SPAN = 1 << 16, 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes, powers of an odd base and of its inverse, all modulo 2 ** 64."""
    values = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 5) for b in range(256)], np.uint64)
    base, n = 0x9FB21C651E98DF25, _SPAN + _LONG + 1
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, np.uint64(x))
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return values, *out


def words_of(raw: bytes) -> np.ndarray:
    """Hashes of the words of a text in UTF-8, in order."""
    points = np.frombuffer(raw.lower(), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[points], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    values, powers, inverse = _powers()
    long = ends - starts > _LONG
    for k in np.flatnonzero(long).tolist():
        out[k] = xxhash.xxh3_64_intdigest(points[starts[k] : ends[k]].tobytes(), 7)
    short = np.flatnonzero(~long)
    at = 0
    while at < len(short):
        low = starts[short[at]]
        end = int(np.searchsorted(starts[short], low + _SPAN, "left"))
        own = short[at:end]
        sums = np.zeros(int(ends[own[-1]] - low) + 1, np.uint64)
        if len(sums) <= len(powers):
            np.cumsum(values[points[low : ends[own[-1]]]] * powers[: len(sums) - 1], out=sums[1:], dtype=np.uint64)
            x, y = starts[own] - low, ends[own] - low
            out[own] = (sums[y] - sums[x]) * inverse[x]
        else:  # long words lie between: one by one
            for k in own.tolist():
                piece = values[points[starts[k] : ends[k]]]
                out[k] = (piece * powers[: len(piece)]).sum(dtype=np.uint64)
        at = end
    return (out ^ (out >> np.uint64(31))) * _MIX


def shingles(text: str | bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; one for the whole of a shorter text, none without words."""
    h = words_of(text if isinstance(text, bytes) else text.encode("utf-8", "replace"))
    if not len(h):
        return h
    width = min(words, len(h))
    n = len(h) - width + 1
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * _ODD
    return np.unique(out ^ (out >> np.uint64(32)))


def node_of(values: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).astype(np.int64))


def reach(n: int, percent: int) -> int:
    """How many shingles of a set's order a similar set must share one of."""
    return n - -(-percent * n // 100) + 1


def bitmap(values: np.ndarray) -> np.ndarray:
    """Hashed bits of a set: LEAST_BITS, or two and more per shingle of a larger set, but at most MOST_BITS."""
    bits = np.zeros(min(MOST_BITS, max(LEAST_BITS, 2 << int(len(values) - 1).bit_length())), np.uint8)
    bits[(values % np.uint64(len(bits))).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def folded(x: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (of words, the last axis) at a smaller width."""
    while x.shape[-1] > width:
        half = x.shape[-1] // 2
        x = x[..., :half] | x[..., half:]
    return x


def bound(x: np.ndarray, nx: int, y: np.ndarray, ny: np.ndarray | int) -> np.ndarray:
    """Upper bounds of the intersections of one set with others, from bitmaps as 64-bit words (``y``: one per row)."""
    width = min(x.shape[-1], y.shape[-1])
    x, y = folded(x, width), folded(y, width)
    return np.minimum(nx - np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64), ny - np.bitwise_count(y & ~x).sum(axis=-1, dtype=np.int64))


def similar(i, nx, ny, percent: int):
    return (100 + percent) * i >= percent * (nx + ny)


# ---------------------------------------------------------------- Spark


def _texts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple]:
    for b in batches:
        for i, t in zip(b.column("id").to_pylist(), b.column("t")):
            yield i, shingles(t.as_buffer().to_pybytes(), words)


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted common shingles, the rank of each by its count, and the counts.  At most MOST_COMMON reach the driver."""

    def blocks(batches):
        held, size, seen = [], 0, set()

        def counted():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            at = n > 2
            return pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(n[at])], names=["key", "n"])

        for _, values in _texts(batches, words):
            node = node_of(values)
            if len(values) and node not in seen:
                seen.add(node)
                held.append(values)
                size += len(values)
            if size > BLOCK:
                yield counted()
                held, size, seen = [], 0, set()
        if held:
            yield counted()
        del held, seen
        trim()

    counts = texts.mapInArrow(blocks, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    got = counts.orderBy(F.desc("n"), "key").limit(MOST_COMMON).toArrow()
    keys, n = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.int32)
    rank[np.lexsort((keys, n))] = np.arange(1, len(keys) + 1)
    return keys[order], rank[order], n[order]


def _first(values: np.ndarray, common: np.ndarray, rank: np.ndarray, count: np.ndarray, percent: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that a set sends to tiles, in order, and into how many parts each tile is split."""
    r, parts = np.zeros(len(values), np.int32), np.ones(len(values), np.int32)
    if len(common):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = common[at] == values
        r[hit] = rank[at[hit]]
        parts[hit] = 1 + count[at[hit]] // part
    order = np.lexsort((values, r))[: reach(len(values), percent)]
    return values[order], parts[order]


def nodes(texts: DataFrame, words: int, percent: int, part: int) -> DataFrame:
    """``id``, ``n``, ``node`` of every row; ``first``, ``parts`` and ``bits`` on one row per node and task."""
    spark = texts.sparkSession
    common = spark.sparkContext.broadcast(common_shingles(texts, words))  # at most 21 MB

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(texts.schema["id"].dataType)
    names = ["id", "n", "node", "first", "parts", "bits"]
    kinds = (kind, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())

    def sets(batches):
        seen, rows = set(), []
        for i, values in _texts(batches, words):
            node, rest = (node_of(values) if len(values) else None), (None, None, None)
            if node is not None and node not in seen:
                seen.add(node)
                first, parts = _first(values, *common.value, percent, part)
                rest = first.view(np.int64), parts, bitmap(values).tobytes()
            rows.append((i, len(values), node, *rest))
            if len(rows) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    out = T.StructType([texts.schema["id"], *T.StructType.fromDDL("n long, node long, first array<long>, parts array<int>, bits binary")])
    made = written(texts.mapInArrow(sets, out), "nodes")
    common.destroy()
    return made


def _whole(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of many rows at a time; a run of equal keys (the first column) is never split."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        columns = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(columns[0]):
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1], "left")) if held == [] or columns[0][0] != columns[0][-1] else 0
        if held and columns[0][0] == columns[0][-1] == held[0][0][0]:
            held.append(columns)
            continue
        if last or held:
            yield [np.concatenate(c) for c in zip(*held, [c[:last] for c in columns])]
        held = [[c[last:] for c in columns]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _emit(columns: Iterable[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names=names)


def _needed(nx, ny, percent: int):
    """The least intersection of two similar sets."""
    return -(-percent * (nx + ny) // (100 + percent))


def narrowed(key, n, node, pos, parts, percent: int) -> np.ndarray:
    """Which rows of whole tiles stay (sorted by key, size, node): those of split tiles, of tiles with more than NEAR rows,
    and those that sizes and positions leave a partner."""
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
    key, n, pos, parts = (c[fresh] for c in (key, n, pos, parts))
    at = _starts(key)
    size = np.repeat(np.diff(at, append=len(key)), np.diff(at, append=len(key)))
    stay = (parts > 1) | (size > NEAR)
    left = n - pos
    for gap in range(1, NEAR):
        if gap >= len(key):
            break
        ok = (key[gap:] == key[:-gap]) & (n[gap:] * percent <= n[:-gap] * 100) & (np.minimum(left[gap:], left[:-gap]) >= _needed(n[gap:], n[:-gap], percent))
        stay[gap:] |= ok
        stay[:-gap] |= ok
    out = np.zeros(len(fresh), bool)
    out[np.flatnonzero(fresh)[stay]] = True
    return out


def tiles(made: DataFrame, percent: int) -> DataFrame:
    """``key``, ``part``, ``parts``, ``n``, ``node``, ``pos`` and ``bits`` of the rows that stay in their tiles."""
    each = made.where("first IS NOT NULL").select("n", "node", F.posexplode(F.arrays_zip("first", "parts")).alias("pos", "e"))
    rows = each.select(F.col("e.first").alias("key"), F.expr("cast(pmod(node, e.parts) AS int)").alias("part"), F.col("e.parts").alias("parts"), "n", "node", "pos")
    names = ["key", "part", "parts", "n", "node", "pos"]

    def stay(batches):
        # parts of a tile follow each other; rows of split tiles stay in any case
        for key, part, parts, n, node, pos in _whole(batches, names):
            keep = narrowed(key, n, node, pos, parts, percent)
            if keep.any():
                yield _emit((c[keep] for c in (key, part, parts, n, node, pos)), names)

    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part", "n", "node")
    kept = written(dealt.select(*names).mapInArrow(stay, ", ".join(f"{c} long" for c in names)), "tiles")
    bits = made.where("bits IS NOT NULL").groupBy("node").agg(F.first("bits").alias("bits"))
    out = written(kept.join(bits, "node").select(*names, "bits"), "tiles")
    discard(kept)
    return out


class _Tile:
    """Bitmaps of a tile's rows, sorted by set size, in one table per length."""

    def __init__(self, n: np.ndarray, left: np.ndarray, node: np.ndarray, bits: list[bytes], percent: int):
        self.n, self.left, self.node, self.percent = n, left, node, percent
        length = np.array([len(b) for b in bits])
        at = _starts(length).tolist()
        self.tables = [(low, high, np.frombuffer(b"".join(bits[low:high]), np.uint64).reshape(high - low, -1)) for low, high in zip(at, [*at[1:], len(bits)])]

    def row(self, k: int) -> np.ndarray:
        return next(table[k - low] for low, high, table in self.tables if low <= k < high)

    def passing(self, k: int, j: np.ndarray) -> np.ndarray:
        """Those of the rows ``j`` (in order) that may be similar to row ``k``, by size, position and bitmap."""
        need = _needed(self.n[k], self.n[j], self.percent)
        small, large = np.minimum(self.n[k], self.n[j]), np.maximum(self.n[k], self.n[j])
        j = j[(self.percent * large <= 100 * small) & (np.minimum(self.left[k], self.left[j]) >= need) & (self.node[j] != self.node[k])]
        out, x = [], self.row(k)
        for low, high, table in self.tables:
            own = j[np.searchsorted(j, low) : np.searchsorted(j, high)]
            if len(own):
                i = bound(x, int(self.n[k]), table[own - low], self.n[own])
                out.append(own[similar(i, self.n[k], self.n[own], self.percent)])
        return np.concatenate(out) if out else j[:0]


def _small(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tiles begin, and how many rows each has."""
    at = _starts(key)
    return at, np.diff(at, append=len(key))


def near_pairs(own: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs (i before j) of rows in tiles of at most NEAR rows that pass all bounds.

    Rows are sorted by tile and set size."""
    n, node, left, tile = own["n"], own["node"], own["n"] - own["pos"], own["tile"]
    at, size = _small(tile)
    small = np.repeat(size <= NEAR, size)
    parts = []
    for gap in range(1, min(NEAR, len(n))):
        i = np.flatnonzero(small[:-gap] & (tile[gap:] == tile[:-gap]))
        j = i + gap
        parts.append(i[(percent * n[j] <= 100 * n[i]) & (np.minimum(left[i], left[j]) >= _needed(n[i], n[j], percent)) & (node[i] != node[j])])
        if not len(i):
            break
    i = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    j = i + np.repeat(np.arange(1, len(parts) + 1), [len(p) for p in parts])
    bits = own["bits"].tolist()
    length = np.array([len(b) for b in bits], np.int64) // 8
    words, begin = np.frombuffer(b"".join(bits), np.uint64), np.cumsum(length) - length
    good = np.zeros(len(i), bool)
    for lx, ly in {*zip(length[i].tolist(), length[j].tolist())}:
        pairs = np.flatnonzero((length[i] == lx) & (length[j] == ly))
        for chunk in np.array_split(pairs, 1 + len(pairs) * ly // 1_000_000):
            x = words[begin[i[chunk]][:, None] + np.arange(lx)]
            y = folded(words[begin[j[chunk]][:, None] + np.arange(ly)], lx)
            nx, ny = n[i[chunk]], n[j[chunk]]
            most = np.minimum(nx - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), ny - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
            good[chunk] = similar(most, nx, ny, percent)
    return i[good], j[good]


def _tiles(batches: Iterator[pa.RecordBatch], names: list[str], percent: int) -> Iterator[tuple]:
    """Columns of many whole tiles (or parts; ``tile`` is the first column), the passing pairs of the small ones, and the
    large ones one by one: columns and bitmaps."""
    for columns in _whole(batches, names):
        every = dict(zip(names, columns))
        at, size = _small(columns[0])

        def large():
            for k in np.flatnonzero(size > NEAR).tolist():
                own = {c: v[at[k] : at[k] + size[k]] for c, v in every.items()}
                yield own, _Tile(own["n"], own["n"] - own["pos"], own["node"], own["bits"].tolist(), percent)

        yield every, near_pairs(every, percent), large()


def _dealt(rows: DataFrame, *more: str) -> tuple[DataFrame, list[str]]:
    """Rows by tile and part, sorted by size; ``tile`` is a hash of both, which stay behind."""
    names = ["tile", "n", "node", "pos", "bits", *more]
    keyed = rows.withColumn("tile", F.xxhash64("key", "part")).select(*names)
    return keyed.repartition("tile").sortWithinPartitions("tile", "n", "node"), names


def picked(rows: DataFrame, percent: int) -> DataFrame:
    """``node``, ``partner``: for every node that passes the bounds with any other in a tile, the smallest centre, or itself.

    In a tile of many rows the first is a centre; rows that pass with it are its own, and the first of the others is the
    next centre.  A centre without rows of its own looks among all rows of the tile.  All rows of split tiles are
    included."""

    def chosen(batches):
        for every, (i, j), large in _tiles(batches, names, percent):
            n, node = every["n"], every["node"]
            held = [(node[j], n[i], node[i]), (node[i], n[i], node[i])]
            for own, tile in large:
                n, node = own["n"], own["node"]
                free, rest = np.arange(len(node)), np.arange(len(node))
                while len(free):
                    centre, free = int(free[0]), free[1:]
                    got = tile.passing(centre, free)
                    if len(got):
                        held.append((node[got], np.full(len(got), n[centre]), np.full(len(got), node[centre])))
                        held.append((node[[centre]], n[[centre]], node[[centre]]))
                        free = np.setdiff1d(free, got, assume_unique=True)
                    elif len(got := tile.passing(centre, rest)):
                        held.append((node[[centre]], n[got[:1]], node[got[:1]]))
            node, n, partner = (np.concatenate(c) for c in zip(*held))
            if len(node):
                order = np.lexsort((partner, n, node))
                first = order[_starts(node[order])]
                yield _emit((node[first], n[first], partner[first]), ["node", "n", "partner"])

    dealt, names = _dealt(rows)
    own = dealt.mapInArrow(chosen, "node long, n long, partner long")
    split = rows.where("parts > 1").select("node", "n", F.col("node").alias("partner"))
    every = own.unionByName(split).groupBy("node").agg(F.min(F.struct("n", "partner")).alias("p"))
    return every.select("node", F.col("p.partner").alias("partner"))


def labelled(rows: DataFrame, wanted: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of wanted nodes in tiles that hold two components or more, with ``label`` and ``own``.

    Rows outside the most frequent component of a split tile are sent to each of its parts; ``own`` marks the part that
    they belong to."""
    known = wanted.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    with_label = written(rows.join(known, "node"), "tiles")
    split = with_label.where("parts > 1")
    one = with_label.where("parts = 1")
    mixed = one.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
    plain = one.join(mixed, "key", "left_semi").withColumn("own", F.lit(1).cast("long"))
    major = split.groupBy("key", "label").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("major"), F.count("*").alias("labels"))
    spread = split.join(major.where("labels > 1").select("key", "major"), "key")
    target = F.when(F.col("label") == F.col("major"), F.array("part")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    spread = spread.withColumn("to", F.explode(target)).withColumn("own", (F.col("to") == F.col("part")).cast("long")).withColumn("part", F.col("to"))
    columns = [*rows.columns, "label", "own"]
    return plain.select(*columns).unionByName(spread.select(*columns))


def across(rows: DataFrame, percent: int, *, once: bool) -> DataFrame:
    """``a``, ``b``: pairs of one tile in different components that pass the bounds; ``once``: one per node and batch."""

    def paired(batches):
        for every, (i, j), large in _tiles(batches, names, percent):
            node, label, home = every["node"], every["label"], every["own"] > 0
            apart = (label[i] != label[j]) & (home[i] | home[j])
            held = [(node[i[apart]], node[j[apart]])]
            for own, tile in large:
                node, label, home = own["node"], own["label"], own["own"] > 0
                kinds, at, many = np.unique(label, return_inverse=True, return_counts=True)
                minor, rest = at != int(many.argmax()), np.arange(len(node))
                for k in np.flatnonzero(minor).tolist():
                    # a pair of two rows outside the most frequent component is made by the first of them
                    got = tile.passing(k, rest[(label != label[k]) & (~minor | (rest > k)) & (home | home[k])])
                    if len(got):
                        got = got[int(node[k]) % len(got) :][:1] if once else got
                        held.append((np.full(len(got), node[k]), node[got]))
            x, y = (np.concatenate(c) for c in zip(*held))
            if len(x):
                x, y = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                first = _starts(x) if once else slice(None)
                yield _emit((x[first], y[first]), ["a", "b"])

    dealt, names = _dealt(rows, "label", "own")
    return dealt.mapInArrow(paired, "a long, b long").distinct()


class _Filter:
    """A filter of nodes of fixed size, 2 ** FILTER_BITS bits: what it lets through by chance does no harm."""

    def __init__(self, wanted: DataFrame):
        place = F.shiftrightunsigned("node", 64 - FILTER_BITS)
        marked = wanted.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
        got = marked.toArrow()
        filled = np.zeros(1 << (FILTER_BITS - 6), np.int64)
        filled[got.column("word").to_numpy()] = got.column("bits").to_numpy()
        self.shared = wanted.sparkSession.sparkContext.broadcast(filled.view(np.uint64))  # 8 MB, always

    def has(self, node: np.ndarray) -> np.ndarray:
        at = node.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
        return (self.shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def sets_of(texts: DataFrame, stars: DataFrame, words: int) -> DataFrame:
    """``node``, ``values``, ``partner`` of the nodes of ``stars``, made anew from the texts."""
    marks = _Filter(stars.select("node"))

    def made(batches):
        rows, seen = [], set()
        for _, values in _texts(batches, words):
            if not len(values):
                continue
            node = node_of(values)
            if node in seen or not marks.has(np.array([node]))[0]:
                continue
            seen.add(node)
            rows.append((node, values.tobytes()))
            if len(rows) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))], names=["node", "values"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))], names=["node", "values"])

    each = texts.mapInArrow(made, "node long, values binary").groupBy("node").agg(F.first("values").alias("values"))
    sets = written(each.join(stars.hint("merge"), "node").select("node", "values", "partner"), "sets")
    marks.shared.destroy()
    return sets


def _similar(both: DataFrame, percent: int) -> DataFrame:
    """The links among rows of ``a``, ``b`` and their sets ``x``, ``y``, by the intersection of the sorted arrays."""

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return written(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links")


def _asked(sets: DataFrame, nodes: DataFrame) -> tuple:
    """The sets that are asked for (and few others), and the filter to destroy when they have been used."""
    marks = _Filter(nodes)

    def kept(batches):
        for b in batches:
            yield b.filter(pa.array(marks.has(b.column("node").to_numpy())))

    return marks.shared, sets.select("node", "values").mapInArrow(kept, "node long, values binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar.  Only sets that a pair asks for are sent, by merge joins: AQE splits a set that very
    many pairs ask for."""
    pairs = written(pairs, "pairs")
    (am, left), (bm, right) = (_asked(sets, pairs.select(F.col(c).alias("node"))) for c in "ab")
    left, right = left.select(F.col("node").alias("a"), F.col("values").alias("x")), right.select(F.col("node").alias("b"), F.col("values").alias("y"))
    links = _similar(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b"), percent)
    am.destroy()
    bm.destroy()
    discard(pairs)
    return links


def stars_of(sets: DataFrame, percent: int) -> DataFrame:
    """The links between nodes and the partners that they picked: each set is sent once, to its partner's."""
    members = sets.where("node <> partner").select(F.col("partner").alias("a"), F.col("node").alias("b"), F.col("values").alias("y"))
    marks, centres = _asked(sets, members.select(F.col("a").alias("node")))
    links = _similar(members.join(centres.select(F.col("node").alias("a"), F.col("values").alias("x")).hint("merge"), "a"), percent)
    marks.destroy()
    return links


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """Membership (``id``, ``n``, ``node``) of every row, and ``node``, ``label`` of every node that is linked with others:
    the components of all links between similar nodes.  ``part``: rows of a tile's part, about."""
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    made = nodes(texts, words, percent, part)
    rows, members = tiles(made, percent), written(made.select("id", "n", "node"), "members")
    discard(made)  # first shingles and bitmaps
    stars = written(picked(rows, percent), "stars")
    sets = sets_of(texts, stars, words)
    labels, apart = components(stars_of(sets, percent)), rows
    for once in (True, False):
        before, table = apart, written(labelled(apart, stars.select("node"), labels), "tiles")
        discard(before)
        links = verified(across(table, percent, once=once), sets, percent)
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links))
        apart = table.where("own = 1").select(*rows.columns)
    for table in (apart, stars, sets):
        discard(table)
    return members, labels


def first_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (null ids last), then the smallest hash of the text.

    Documents without words are components of their own.  Rows that repeat both id and text count as one."""
    mark = fresh(docs, "hash")
    hashed = docs.withColumn(mark, F.xxhash64(text_of(text_col)))
    # the row's id and hash travel as its id
    members, labels = join(hashed.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(mark).alias("h")).alias("id"), text_of(text_col).alias("text")), id_col="id", text_col="text", **options)
    least = members.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("own"))
    labelled = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    chosen = labelled.groupBy("label").agg(F.min("own").alias("id")).select("id.id", "id.h")
    empty = members.where("node IS NULL").select("id.id", "id.h")
    d, c = hashed.alias("d"), chosen.unionByName(empty).alias("c")
    kept = d.join(c, F.col(f"d.{id_col}").eqNullSafe(F.col("c.id")) & (F.col(f"d.{mark}") == F.col("c.h")), "left_semi")
    return kept.dropDuplicates([id_col, mark]).drop(mark)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` (the smallest id reachable by links) of every row.

    Null texts count as empty; empty texts are linked with nothing.  Null ids are never smallest: a component of rows
    without any id has a null.  Rows that repeat an id are documents of their own.  Other columns are ignored.
    """
    members, labels = join(docs, id_col=id_col, text_col=text_col, words=words, percent=percent)
    least = members.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("own"))
    labelled = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.groupBy("label").agg(F.min("own").alias("smallest"))
    component = labelled.join(smallest, "label").select("node", "smallest")
    return members.join(component, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("smallest")).alias("component_id"))
