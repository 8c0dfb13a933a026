"""Byte-level BPE encoding by tree concatenation, and decoding.

A text longer than ``leaf_chars`` becomes leaves of that many code points, cut wherever they end.  Leaves are rows of
their own, so that executors encode the parts of one long text in parallel.  Neighbouring encodings are then joined
pairwise, level by level: a window around the join is encoded again, and grows until, on either side, it agrees with
what that side has.  Agreement is a proof, not a guess.  It needs one of

* a place where the pre-tokenizer always cuts (before white space, or between a letter, a digit and a punctuation
  mark), at which nothing on the other side can change the encoding; or
* inside one run of a single character class, a token that the window and the side share with both its ends: BPE of
  one pre-token is the only sequence in which all neighbours are stable, and every pair of neighbours of the joined
  sequence stands in one of the three encodings.

If neither exists, the window ends up as the whole of both sides, which is exact as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .tokens import ByteBPE, byte_bpe

LEAF_CHARS = 16_384
_SPACE = set(" \t\n\r\v\f")


def _kind(c: str) -> str:
    """Class of an ASCII character for certain pre-token boundaries; ``""`` for any other character."""
    if not c.isascii():
        return ""
    return "L" if c.isalpha() else "N" if c.isdigit() else "S" if c in _SPACE else "P" if c.isprintable() else ""


def _certain(a: str, b: str) -> bool:
    """Whether a pre-token always ends between ``a`` and ``b``.  An apostrophe can hold on to the letters after it."""
    x, y = _kind(a), _kind(b)
    return bool(x and y) and x != "S" and x != y and a != "'"


def _run(text: str, at: int, low: int, high: int) -> bool:
    """Whether ``text[low:high]`` around ``at`` is one run of ASCII letters, digits or punctuation (no apostrophe)."""
    kinds = {_kind(c) for c in text[low:high]}
    return len(kinds) == 1 and kinds <= {"L", "N", "P"} and "'" not in text[low:high]


def _ends(encoder: ByteBPE, ids: np.ndarray) -> np.ndarray:
    """Byte offsets at which the tokens end, with 0 in front."""
    return np.concatenate([[0], np.cumsum(encoder.length_of[ids])])


def join(encoder: ByteBPE, left: np.ndarray, right: np.ndarray, window: int = 16) -> np.ndarray:
    """Ids of the concatenated text from the ids of its two parts.  ``window``: tokens taken from each side at first."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    special = [s.encode() for s in encoder.special]
    while True:
        whole = window >= len(left) and window >= len(right)
        i, j = max(0, len(left) - window), min(len(right), window)
        head, tail = encoder.to_bytes(left[i:]), encoder.to_bytes(right[:j])
        raw = head + tail
        try:
            text = raw.decode()
        except UnicodeDecodeError:  # the window begins or ends inside a character
            window += 1
            continue
        ids = np.array(encoder.encode(text), np.int64)
        if whole:
            return ids
        if not any(s in raw for s in special):
            p = (0, 0) if i == 0 else _left_agreement(encoder, left[i:], ids, raw, len(head))
            q = (len(right), len(ids)) if j == len(right) else _right_agreement(encoder, right[:j], ids, raw, len(head))
            if p and q and p[1] <= q[1]:
                return np.concatenate([left[: i + p[0]], ids[p[1] : q[1]], right[q[0] :]])
        window *= 2


def _left_agreement(encoder, side, ids, raw, cut):
    """Numbers of tokens of ``side`` and of the window up to a place at which both are right, the last one, or None."""
    a, b = _ends(encoder, side), _ends(encoder, ids)
    shared = [int(x) for x in np.intersect1d(a, b) if 0 < x < cut]
    for x in reversed(shared):
        if _certain(chr(raw[x - 1]), chr(raw[x])) if raw[x - 1] < 128 and raw[x] < 128 else False:
            return int(np.searchsorted(a, x)), int(np.searchsorted(b, x))
    for x in reversed(shared):  # a shared token that begins at x, with one run from before x to past the cut
        n, m = int(np.searchsorted(a, x)), int(np.searchsorted(b, x))
        if n < len(side) and m < len(ids) and side[n] == ids[m] and a[n + 1] <= cut:
            run = raw[a[n - 1] : cut + 1].decode("latin-1")
            if _run(run, 0, 0, len(run)):
                return n, m
    return None


def _right_agreement(encoder, side, ids, raw, cut):
    """As :func:`_left_agreement` for the right side: numbers of tokens of ``side`` and of the window before the place."""
    a, b = _ends(encoder, side) + cut, _ends(encoder, ids)
    shared = [int(x) for x in np.intersect1d(a, b) if cut < x < len(raw)]
    for x in shared:
        if _certain(chr(raw[x - 1]), chr(raw[x])) if raw[x - 1] < 128 and raw[x] < 128 else False:
            return int(np.searchsorted(a, x)), int(np.searchsorted(b, x))
    for x in shared:  # a shared token that ends at x, with one run from before the cut to past x
        n, m = int(np.searchsorted(a, x)), int(np.searchsorted(b, x))
        if 0 < n < len(side) and m and side[n - 1] == ids[m - 1] and a[n - 1] >= cut:
            run = raw[cut - 1 : a[n + 1]].decode("latin-1")
            if _run(run, 0, 0, len(run)):
                return n, m
    return None


def concatenate(encoder: ByteBPE, parts: list[np.ndarray]) -> np.ndarray:
    """Joins the encodings of neighbouring leaves as a balanced tree."""
    while len(parts) > 1:
        parts = [join(encoder, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def encode_tree(encoder: ByteBPE, text: str, leaf_chars: int = LEAF_CHARS) -> np.ndarray:
    """Encodes one text by halves within one process; the reference for tests and the path for single texts."""
    leaves = [text[k : k + leaf_chars] for k in range(0, len(text), leaf_chars)] or [""]
    return concatenate(encoder, [np.array(encoder.encode(x), np.int64) for x in leaves])


# ---------------------------------------------------------------- Spark

Finish = Callable[[ByteBPE, np.ndarray], dict]


def ids_column(encoder: ByteBPE, ids: np.ndarray) -> dict:
    return {"ids": ids.astype(np.int32)}


def _rows(columns: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in columns], f.type) for f in schema], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def encode(docs: DataFrame, finish: Finish, finished: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """One row per document: ``id_col`` and what ``finish`` makes of its ids (columns as in the DDL ``finished``).

    Null texts count as empty; repeated ids stay separate rows; other columns are ignored, whatever their names.
    Short texts are encoded where they are read.  Only longer ones are cut, dealt out by leaf, and gathered again as
    ids, a document at a time.
    """
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL(finished)])
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"), F.monotonically_increasing_id().alias("row"))
    is_long = F.length("t") > leaf_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, schema = byte_bpe(tokenizer), _arrow(out)
        for b in batches:
            texts, ids = b.column("t"), b.column("id").to_pylist()
            for k in range(0, b.num_rows, 1000):
                yield _rows([{"id": i} | finish(encoder, np.array(encoder.encode(t), np.int64)) for i, t in zip(ids[k : k + 1000], texts[k : k + 1000].to_pylist())], schema)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer)
        for b in batches:
            ids = [np.array(encoder.encode(t), "<u4").tobytes() for t in b.column("leaf").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), b.column("k"), pa.array(ids, pa.binary())], names=["id", "row", "k", "ids"])

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, schema = byte_bpe(tokenizer), _arrow(out)
        row, key, parts = None, None, []

        def done():
            return _rows([{"id": key} | finish(encoder, concatenate(encoder, parts))], schema)

        for b in batches:
            for i, r, raw in zip(b.column("id").to_pylist(), b.column("row").to_pylist(), b.column("ids").to_pylist()):
                if r != row:
                    if parts:
                        yield done()
                    row, key, parts = r, i, []
                parts.append(np.frombuffer(raw, "<u4").astype(np.int64))
        if parts:
            yield done()

    short = base.where(~is_long).select("id", "t").mapInArrow(whole, out)
    cuts = F.sequence(F.lit(0), F.floor((F.length("t") - 1) / leaf_chars).cast("int"))
    cut = base.where(is_long).select("id", "row", "t", F.posexplode(cuts).alias("k", "n")).select("id", "row", "k", F.expr(f"substring(t, k * {leaf_chars} + 1, {leaf_chars})").alias("leaf"))
    types = T.StructType([out[0], T.StructField("row", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    coded = cut.repartition(F.col("row"), F.col("k")).mapInArrow(leaves, types)
    long = coded.repartition(F.col("row")).sortWithinPartitions("row", "k").select("id", "row", "ids").mapInArrow(tree, out)
    return short.unionByName(long).withColumnRenamed("id", id_col)


def encode_ids(docs: DataFrame, **options) -> DataFrame:
    """``doc_id`` and ``ids array<int>`` of every document."""
    return encode(docs, ids_column, "ids array<int>", **options)


def decode_ids(coded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``id_col`` and ``text`` of every row of ids; null ids give the empty text."""
    out = T.StructType([T.StructField("id", coded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def back(batches):
        encoder = byte_bpe(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([encoder.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], names=["id", "text"])

    return coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(back, out).withColumnRenamed("id", id_col)


_DECIMAL: list[str] = []


def digests(encoder: ByteBPE, ids: np.ndarray) -> dict:
    """Number of ids, digest of the decimal ids and digest of the text that they decode to."""
    if not _DECIMAL:
        _DECIMAL.extend(map(str, range(len(encoder.bytes_of))))
    ids = ids.tolist()
    return {
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(",".join(map(_DECIMAL.__getitem__, ids)).encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(encoder.decode(ids).encode()).hexdigest(),
    }


def bpe_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Encodes and decodes every document and returns the digests of both."""
    return encode(docs, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", **options)
