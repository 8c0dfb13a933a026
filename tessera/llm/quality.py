r"""Quality by the perplexity of an n-gram model with interpolated modified Kneser-Ney smoothing.

The model is over code points, whatever their script, of order 5.  All trusted text is counted.  Counts, continuation
counts, discounts and probabilities of all orders are tables, sharded by n-gram and joined by Spark; the driver only
sees the counts of counts.  A document's perplexity is per character.  It is rejected when its perplexity exceeds a
quantile, times a margin, of those trusted documents of its language that the model has not seen: one in ten.

Documents are dealt into blocks.  A block asks for each of its different n-grams once; the probabilities, with those of
shorter n-grams where the whole one is unknown, are joined by n-gram and come back to the block ahead of its documents,
which are then scored one after the other.  So neither the model nor a block's documents are ever held as a whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, text_of, trim, written

ORDER = 5
#: Stands in front of a text; it and the null character count as blanks inside one.
BOUNDARY = "\x02"
#: A document is scored as if it began with so many characters of the trusted text's mean, so that a few unlikely
#: letters do not condemn a very short text.
PRIOR = 50
#: What no history knows is spread over all code points.
CODE_POINTS = 0x110000
#: Characters looked at a time, and different n-grams held before they are handed on.
SPAN, HELD = 1 << 20, 1 << 20
#: Characters of a block, about, and how many blocks there are at most.  A block's n-grams are held, its texts are not.
BLOCK_CHARS, MOST_BLOCKS = 1 << 26, 50_000
_BASE = np.uint64(0x9FB21C651E98DF25)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts with boundaries in front of each, and where each text ends."""
    pad = BOUNDARY * (ORDER - 1)
    clean = [pad + t.replace(BOUNDARY, " ").replace("\0", " ") for t in texts]
    return np.frombuffer("".join(clean).encode("utf-32-le", "replace"), "<u4"), np.cumsum([len(t) for t in clean])


def _keys(points: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that begin at each place but the last ones."""
    n = max(0, len(points) - ORDER + 1)
    out, wide = np.zeros(n, np.uint64), points.astype(np.uint64) + np.uint64(1)
    for k in range(ORDER):
        out += wide[k : k + n]
        out *= _BASE
        out ^= out >> np.uint64(29)
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each character, and the number of them in each text."""
    points, ends = _points(texts)
    n = ends - np.concatenate([[0], ends[:-1]]) - (ORDER - 1)
    return _keys(points)[points[ORDER - 1 :] != ord(BOUNDARY)], n


class _Alphabet:
    """Numbers of 12 bits for the characters met so far, so that an n-gram is one 64-bit number that can be read back."""

    def __init__(self):
        self.code = np.zeros(CODE_POINTS, np.uint16)
        self.letters = np.zeros(1, np.uint32)
        self.add(np.array([ord(BOUNDARY)], np.uint32))

    def add(self, new: np.ndarray) -> None:
        self.code[new] = np.arange(len(self.letters), len(self.letters) + len(new))
        self.letters = np.concatenate([self.letters, new])

    def codes(self, points: np.ndarray) -> np.ndarray | None:
        """The numbers of code points; None if there is no room for new ones."""
        new = np.unique(points[self.code[points] == 0])
        if len(self.letters) + len(new) > 1 << 12:
            return None
        self.add(new)
        return self.code[points].astype(np.uint64)

    def windows(self, keys: np.ndarray) -> np.ndarray:
        shifts = np.arange(12 * (ORDER - 1), -1, -12, dtype=np.uint64)
        return self.letters[(keys[:, None] >> shifts & np.uint64(0xFFF)).astype(np.int64)]


def _pieces(texts: Iterator[str]) -> Iterator[list[str]]:
    """Texts in lists of SPAN characters, about."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > SPAN:
            yield held
            held, size = [], 0
    if held:
        yield held


def _runs(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, in order, and how often they occur."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(at, append=len(keys)) if counts is None else np.add.reduceat(counts, at) if len(at) else counts


def _counted(texts: Iterator[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different n-grams (rows of code points) that end at each character and their counts, added up over as many texts as
    HELD different n-grams allow."""
    alphabet, keys, counts = _Alphabet(), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for piece in _pieces(texts):
        points, _ = _points(piece)
        codes = alphabet.codes(points)
        if codes is None:  # room for new letters
            if len(keys):
                yield alphabet.windows(keys), counts
            alphabet, keys, counts = _Alphabet(), keys[:0], counts[:0]
            codes = alphabet.codes(points)
        if codes is None:  # a piece with more letters than there are numbers
            ends = np.flatnonzero(points[ORDER - 1 :] != ord(BOUNDARY))
            windows = np.lib.stride_tricks.sliding_window_view(points, ORDER)[ends]
            windows, n = np.unique(windows, axis=0, return_counts=True)
            yield windows, n
            continue
        n = max(0, len(codes) - ORDER + 1)
        made = np.zeros(n, np.uint64)
        for k in range(ORDER):
            made <<= np.uint64(12)
            made |= codes[k : k + n]
        new, of_new = _runs(made[codes[ORDER - 1 :] != 1])
        keys, counts = _runs(np.concatenate([keys, new]), np.concatenate([counts, of_new]))
        if len(keys) > HELD:
            yield alphabet.windows(keys), counts
            keys, counts = keys[:0], counts[:0]
    if len(keys):
        yield alphabet.windows(keys), counts


def _strings(windows: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(windows, "<u4").view(f"<U{ORDER}").ravel(), pa.string())


def language(column: str) -> Column:
    """A language code of two or three letters, else ``other``: at most 18,253 values."""
    code = F.lower(F.col(column))
    return F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise("other")


# ---------------------------------------------------------------- the model


def count_grams(texts: DataFrame) -> DataFrame:
    """``gram``, ``n`` over all of a table of compressed texts ``z``: counted in each task, then added up by shards.

    Texts are loosened where they are counted: a second Python worker beside each task would hold memory of its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for windows, counts in _counted(_text(z, press) for b in batches for z in b.column("z")):
            for low in range(0, len(counts), 100_000):
                yield pa.RecordBatch.from_arrays([_strings(windows[low : low + 100_000]), pa.array(counts[low : low + 100_000])], names=["gram", "n"])
        trim()

    return texts.select("z").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """The discounts of counts 1, 2 and more, from how many n-grams have the counts 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return tuple(min(k, max(0.05, k - (k + 1) * y * b / a)) if a and b else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


class Model:
    """For each order, tables of probabilities by n-gram (``gram``, ``p``) and of the share that a history leaves to the
    next lower order (``h``, ``g``); ``unknown``: the probability of a character that was never seen."""

    def __init__(self, spark: SparkSession):
        self.spark, self.p, self.g, self.unknown, self.mean = spark, {}, {}, 1.0, 0.0

    def drop(self) -> None:
        for table in (*self.p.values(), *self.g.values()):
            discard(table)


def train(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of all texts whose id is among ``trusted`` (one column of ids)."""
    texts = _squeezed(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")), "id")
    texts = texts.join(trusted.toDF("id").hint("merge"), "id", "left_semi")
    counts = {ORDER: written(count_grams(texts), "grams")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different characters stand in front
        counts[k] = written(counts[k + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")), "grams")
    out = Model(docs.sparkSession)
    of_counts = None
    for k, table in counts.items():
        row = table.agg(F.lit(k).alias("k"), *(F.count(F.when(F.col("n") == c, 1)).alias(f"n{c}") for c in (1, 2, 3, 4)))
        of_counts = row if of_counts is None else of_counts.unionByName(row)
    seen = {r["k"]: r for r in of_counts.collect()}  # one row per order
    lower = F.lit(1 / CODE_POINTS)
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(*(seen[k][f"n{c}"] for c in (1, 2, 3, 4)))
        d = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = counts[k].withColumn("d", d).withColumn("h", F.expr(f"substring(gram, 1, {k - 1})"))
        out.g[k] = written(rows.groupBy("h").agg(F.sum("n").cast("double").alias("all"), (F.sum("d") / F.sum("n")).alias("g")), "share")
        rows = rows.join(out.g[k], "h")
        if k > 1:
            rows = rows.withColumn("s", F.expr("substring(gram, 2)")).join(out.p[k - 1].select(F.col("gram").alias("s"), F.col("p").alias("q")), "s")
            lower = F.col("q")
        out.p[k] = written(rows.select("gram", "n", ((F.col("n") - F.col("d")) / F.col("all") + F.col("g") * lower).alias("p")), "likely")
        discard(counts[k])
    first = out.g[1].first()
    out.unknown = (first["g"] if first else 1.0) / CODE_POINTS
    if first:
        out.mean = out.p[ORDER].agg(F.sum(F.col("n") * F.log("p")) / F.sum("n")).first()[0]
    return out


def _resolved(m: Model, grams: DataFrame) -> DataFrame:
    """``gram``, ``log_p`` of different n-grams: from the highest order that knows them, times the shares left to it."""
    rows, chain = grams, F.lit(m.unknown)
    for k in range(1, ORDER + 1):
        own = F.col("gram") if k == ORDER else F.expr(f"substring(gram, {ORDER - k + 1})")
        rows = rows.withColumn(f"gram{k}", own).withColumn(f"h{k}", F.expr(f"substring(gram, {ORDER - k + 1}, {k - 1})"))
    for k in range(1, ORDER + 1):
        rows = rows.join(m.p[k].select(F.col("gram").alias(f"gram{k}"), F.col("p").alias(f"p{k}")), f"gram{k}", "left")
        if k > 1:
            rows = rows.join(m.g[k].select(F.col("h").alias(f"h{k}"), F.col("g").alias(f"g{k}")), f"h{k}", "left")
            chain = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"g{k}"), F.lit(1.0)) * chain)
        else:
            chain = F.coalesce(F.col("p1"), chain)
    return rows.select("gram", F.log(chain).alias("log_p"))


# ---------------------------------------------------------------- documents


def _squeezed(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``z``: the texts ``t`` compressed, as less is shuffled then (null where the text is)."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [None if not t.is_valid else press.compress(t.as_buffer().to_pybytes()) for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(z, pa.binary())], names=[*keys, "z"])
        b = z = None
        trim()

    return rows.select(*keys, "t").mapInArrow(squeeze, T.StructType([*(rows.schema[k] for k in keys), T.StructField("z", T.BinaryType())]))


def _text(z: pa.Scalar, press: zstandard.ZstdDecompressor) -> str:
    return press.decompress(z.as_py()).decode("utf-8", "replace") if z.is_valid else ""


def with_perplexity(docs: DataFrame, m: Model, *, id_col: str = "doc_id", text_col: str = "text", into: str = "perplexity", drop_text: bool = False) -> DataFrame:
    """``docs`` with a column of perplexities, null for null and empty texts.  Replaces a column of that name.

    A block has about BLOCK_CHARS characters, or more where there would be over MOST_BLOCKS of them.  Rows are dealt by id and text together, so that many
    copies of a text or many rows without an id do not meet in one block; the rows of a block need not fit in memory."""
    size = docs.agg(F.sum(F.length(F.col(text_col)).cast("long"))).first()[0] or 0
    n = min(MOST_BLOCKS, 1 + size // BLOCK_CHARS)
    kept = [c for c in docs.columns if c not in (into, text_col)]
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(n)).cast("int")
    rest = F.struct(F.lit(0).alias("-"), *(F.col(f"`{c}`") for c in kept))  # never empty
    blocked = docs.select(place.alias("block"), rest.alias("d"), F.col(text_col).alias("t"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        rows = ((own, z) for b in batches for own, z in zip(b.column("block").to_pylist(), b.column("z")))
        for block, own in itertools.groupby(rows, key=lambda r: r[0]):
            for windows, _ in _counted(_text(z, press) for _, z in own):
                for low in range(0, len(windows), 100_000):
                    some = _strings(windows[low : low + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int32()), some], names=["block", "gram"])
        trim()

    squeezed = _squeezed(blocked, "block", "d")
    wanted = squeezed.select("block", "z").repartitionById(n, "block").sortWithinPartitions("block").mapInArrow(ask, "block int, gram string")
    wanted = written(wanted, "asked")
    grams = written(_resolved(m, wanted.select("gram").distinct()), "answers")
    answers = wanted.join(grams, "gram").select("block", "gram", "log_p")

    out = T.StructType([squeezed.schema["d"], T.StructField("t", T.StringType()), T.StructField("p", T.DoubleType())])
    mean = m.mean

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, block, keys, logs, parts = zstandard.ZstdDecompressor(), None, None, None, []
        for b in batches:
            for low in range(0, b.num_rows, 1000):
                some = b.slice(low, 1000)
                of_block = some.column("block").to_numpy()
                for own in dict.fromkeys(of_block.tolist()):
                    rows = some.filter(pa.array(of_block == own))
                    if own != block:
                        block, parts, keys = own, [], None
                    answer = rows.filter(rows.column("gram").is_valid())
                    if answer.num_rows:
                        points = np.frombuffer("".join(answer.column("gram").to_pylist()).encode("utf-32-le"), "<u4")
                        parts.append((_keys(points)[::ORDER], answer.column("log_p").to_numpy()))
                    rows = rows.filter(rows.column("gram").is_null())
                    if not rows.num_rows:
                        continue
                    if keys is None:
                        keys, logs = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0))
                        order = np.argsort(keys)
                        keys, logs, parts = keys[order], logs[order], []
                    texts = [_text(z, press) for z in rows.column("z")]
                    values = []
                    for piece in _pieces(iter(texts)):
                        k, size = _grams(piece)
                        sums = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(keys, k)])]) if len(k) else np.zeros(1)
                        ends = np.cumsum(size)
                        total = sums[ends] - sums[ends - size]
                        values += [float(v) if c else None for v, c in zip(np.exp(-(total + PRIOR * mean) / (size + PRIOR)), size)]
                    t = pa.nulls(len(texts), pa.string()) if drop_text else pa.array([x if z.is_valid else None for x, z in zip(texts, rows.column("z"))], pa.string())
                    yield pa.RecordBatch.from_arrays([rows.column("d"), t, pa.array(values, pa.float64())], names=["d", "t", "p"])
        keys = logs = parts = None
        trim()

    first = answers.select("block", "gram", "log_p", F.lit(None).cast(squeezed.schema["d"].dataType).alias("d"), F.lit(None).cast("binary").alias("z"))
    then = squeezed.select("block", F.lit(None).cast("string").alias("gram"), F.lit(None).cast("double").alias("log_p"), "d", "z")
    dealt = first.unionByName(then).repartitionById(n, "block").sortWithinPartitions("block", F.col("gram").isNull())
    scored = written(dealt.mapInArrow(score, out), "scored")
    discard(wanted)
    discard(grams)
    columns = [F.col("t").alias(c) if c == text_col else F.col(f"d.`{c}`").alias(c) for c in docs.columns if c != into and not (drop_text and c == text_col)]
    return scored.select(*columns, F.col("p").alias(into))


def thresholds(scored: DataFrame, *, quantile: float, margin: float, least: int) -> DataFrame:
    """``language``, ``threshold`` from trusted documents' perplexities.

    ``*`` has the quantile of all of them, for languages with fewer than ``least``."""
    level = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    every = scored.where("perplexity IS NOT NULL").cube("language").agg(level.alias("q"), F.count("*").alias("n"), F.grouping("language").alias("g"))
    return every.where((F.col("g") == 1) | (F.col("n") >= least)).select(F.when(F.col("g") == 1, "*").otherwise(F.col("language")).alias("language"), (F.col("q") * margin).alias("threshold"))


def calibrates(doc_id: Column) -> Column:
    """Whether a trusted document sets thresholds, and the model is trained without it."""
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(10)) == 0


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quality_col: str = "quality", train_rows=None, quantile: float = 0.99, margin: float = 1.1, least: int = 30, into: tuple[str, str, str] = ("perplexity", "threshold", "good"), drop_text: bool = False) -> DataFrame:
    """``docs`` with a perplexity, the threshold that it is held against and whether the document is good.

    Trusted are the documents that ``labels`` calls good (label 1; ``train_rows``, a condition on the id, can hold some
    out).  Ids that are null or labelled both ways are not trusted.  Null and empty texts have no perplexity and are not
    good; without any trusted text to set thresholds every other document is good.  Repeated rows are judged each by itself.  Columns of
    ``docs`` that have the names of the new ones (``into``) are replaced; all others stay.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(quality_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    trusted = rows.groupBy("id").agg(F.min("y").alias("y")).where("y = 1").select("id")
    if train_rows is not None:
        trusted = trusted.where(train_rows(F.col("id")))
    perplexity, threshold, verdict = into
    fitted = train(docs, trusted.where(~calibrates(F.col("id"))), id_col=id_col, text_col=text_col)
    scored = with_perplexity(docs.drop(threshold, verdict), fitted, id_col=id_col, text_col=text_col, into=perplexity, drop_text=drop_text)
    fitted.drop()
    lean = scored.select(F.col(id_col).alias("id"), language(lang_col).alias("language"), F.col(perplexity).alias("perplexity"))
    limits = {r["language"]: r["threshold"] for r in thresholds(lean.join(trusted.where(calibrates(F.col("id"))), "id", "left_semi"), quantile=quantile, margin=margin, least=least).collect()}
    general = limits.pop("*", None)
    limit = F.lit(general).cast("double")
    if limits:  # at most 18,253 languages
        chosen = F.create_map(*(F.lit(x) for pair in sorted(limits.items()) for x in pair))
        limit = F.coalesce(F.element_at(chosen, language(lang_col)), limit)
    good = F.col(perplexity).isNotNull() & F.coalesce(F.col(perplexity) <= F.col(threshold), F.lit(True))
    return scored.withColumn(threshold, limit).withColumn(verdict, good)
