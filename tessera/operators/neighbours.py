"""Nearest-neighbour graphs among the rows of one group, and what is read off them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import closest, correlation_distance, manhattan

__all__ = ["correlation_distance", "graph", "majority", "manhattan", "nearest"]

#: A group has this many blocks where these have rows between the two bounds, at about, and no more components than the last;
#: two blocks are what a task holds.
BLOCKS, BLOCK_ROWS, BLOCK_MOST, BLOCK_COMPONENTS = 8, 2048, 1 << 14, 1 << 22


def _matrix(vectors: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which of their components are there; missing ones are zero."""
    ends, flat = vectors.offsets.to_numpy() - vectors.offsets[0].as_py(), vectors.flatten()
    has = np.arange(width) < np.diff(ends)[:, None]
    values = np.zeros(has.shape)
    values[has] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    has[has] = flat.is_valid().to_numpy(zero_copy_only=False)
    return values, has


def nearest(df: DataFrame, k: int, *, group: str, row: str, vector: str, distance=manhattan) -> DataFrame:
    """``group``, ``src``, ``dst``, ``distance``, ``rank``: the ``k`` nearest other rows of each row's group; ties go to
    the smaller row.  Groups are the molecules over one region; a group is compared with itself, never with others.

    A group's rows are dealt into blocks, and each pair of blocks is one piece of work, which hands on only the ``k`` best
    of each of its rows: pairs of rows are never rows of a table.  All pairs of a group are compared, so the work grows with the
    square of its size; rough values leave few pairs to compute exactly (:func:`closest`).  ``distance`` is a kernel over
    two blocks.  Components that one of two vectors lacks do not count for them; rows without components, a group or a
    name take no part.  Distances that are not a number come after all others, and null ones (no common component) last."""
    spark, kind = df.sparkSession, df.schema[row].dataType
    values = F.col(vector)
    if df.schema[vector].dataType.elementType not in (T.FloatType(), T.DoubleType()):
        values = values.cast("array<double>")
    v = df.select(group, F.col(row).alias("__row"), values.alias("__v")).where(F.col(group).isNotNull() & F.col("__row").isNotNull() & (F.size("__v") > 0))
    size = F.greatest(F.lit(BLOCK_ROWS), F.least(F.lit(BLOCK_MOST), F.ceil(F.count("*") / BLOCKS)))
    blocks = F.greatest(F.ceil(F.count("*") / size), F.ceil(F.sum(F.size("__v")) / BLOCK_COMPONENTS))
    dealt = v.join(v.groupBy(group).agg(blocks.alias("__blocks")), group).withColumn("__block", F.expr("pmod(xxhash64(__row), __blocks)"))
    packed = dealt.groupBy(group, "__block", "__blocks").agg(F.collect_list(F.struct("__row", "__v")).alias("__rows"))
    other = packed.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    pairs = other.select(group, F.least("__block", "__other").alias("__i"), F.greatest("__block", "__other").alias("__j"), "__rows")
    names = [group, "src", "dst", "distance"]

    def near(pair: pa.Table) -> pa.Table:
        rows = [x.values for c in pair.column("__rows").chunks for x in c]
        rows = [x.take(pc.sort_indices(pc.struct_field(x, "__row"))) for x in rows]
        ids, vectors = ([pc.struct_field(x, c) for x in rows] for c in ("__row", "__v"))
        width = max(pc.max(pc.list_value_length(x)).as_py() for x in vectors)
        (x, has_x), (y, has_y) = (_matrix(vectors[at], width) for at in (0, -1))
        alone = pair.column("__i")[0] == pair.column("__j")[0]
        if not alone and len(rows) == 1:  # the other block is empty
            return pa.table({c: pa.array([], t) for c, t in zip(names, (pair.schema.field(group).type, ids[0].type, ids[0].type, pa.float64()))})
        found = closest(distance, x, y, has_x, has_y, pc.rank(ids[0], tiebreaker="dense").to_numpy() if alone else None, k)
        src, dst = (pa.concat_arrays([ids[-1 if f[0] == at else 0].take(pa.array(f[2 - at])) for f in found]) for at in (1, 0))
        value = pa.array(np.concatenate([f[3] for f in found]), pa.float64(), mask=np.concatenate([f[4] for f in found]))
        return pa.table({group: pa.repeat(pair.column(group)[0], len(src)), "src": src, "dst": dst, "distance": value})

    out = T.StructType([df.schema[group], T.StructField("src", kind), T.StructField("dst", kind), T.StructField("distance", T.DoubleType())])
    keys = [group, "__i", "__j"]
    # by number, as a few bytes are much work here
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    d = pairs.repartition(tasks, *keys).groupBy(*keys).applyInArrow(near, out)
    w = Window.partitionBy(group, "src").orderBy(F.col("distance").asc_nulls_last(), "dst")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def graph(nearest_rows: DataFrame, *, group: str) -> DataFrame:
    """Undirected edges (src < dst) of a neighbour table with weights ``exp(-distance / sigma)``, sigma being the mean
    distance of the group's neighbours."""
    sigma = nearest_rows.groupBy(group).agg(F.avg("distance").alias("__s"))
    edges = nearest_rows.select(group, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "distance").groupBy(group, "src", "dst").agg(F.min("distance").alias("distance"))
    return edges.join(sigma, group).select(group, "src", "dst", "distance", F.exp(-F.col("distance") / F.col("__s")).alias("weight"))


def majority(neighbours: DataFrame, labels: DataFrame, *, row: str = "src", label: str = "label") -> DataFrame:
    """``row``, ``label``: the most common label among a row's neighbours; ties go to the label of the nearest of them."""
    # dealt by row once: votes and their order need no further exchange
    named = neighbours.join(labels.select(F.col(row).alias("dst"), label), "dst").repartition(row)
    votes = named.groupBy(row, label).agg(F.count("*").alias("__n"), F.min("rank").alias("__r"))
    w = Window.partitionBy(row).orderBy(F.desc("__n"), "__r")
    return votes.withColumn("__k", F.row_number().over(w)).where("__k = 1").select(row, label)
