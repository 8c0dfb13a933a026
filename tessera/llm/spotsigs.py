"""Document fingerprints from spot signatures, by Spark expressions only.

Each occurrence of a common word (an anchor) starts a chain of the next two content words, anchors between them
skipped.  The distinct hashes of a text's chains are its signature set.  Sets are compared by Jaccard likeness; sets
whose sizes alone keep them below a threshold (they are of distant length partitions) are never intersected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in a is that it for was on as with by be this are from at "
    "der die das und ist von den mit auf im ein eine nicht zu für sich dem des "
    "le la les de et un une est que dans pour au du en par sur qui "
    "el los las y una del por con se es no su"
).split()
_ANCHOR = "(?:" + "|".join(sorted(set(ANCHORS), key=lambda w: (-len(w), w))) + ")"
#: A mark, then (looked at only) the next two words, with at most one mark between, as runs of marks are one by then.
_CHAIN = r"#(?=( [^ #]++(?: #)? [^ #]++) )"


def signatures(text: str) -> Column:
    """The sorted distinct chain hashes of a column that is not null.

    A text with words but without a chain has one signature, its words as a whole; a text without words has none."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    marked = F.regexp_replace(F.regexp_replace(plain, rf"(?<= ){_ANCHOR}(?= )", "#"), r"#(?: +#)++", "#")
    chains = F.regexp_extract_all(F.regexp_replace(marked, " {2,}", " "), F.lit(_CHAIN), F.lit(1))
    hashes = F.transform(chains, lambda c: F.hash(F.replace(c, F.lit(" #"))))
    whole = F.trim(plain)
    return F.when(F.size(chains) > 0, F.array_sort(F.array_distinct(hashes))).when(whole != "", F.array(F.hash(whole))).otherwise(F.array().cast("array<int>"))


def fingerprint(sigs: Column) -> Column:
    """The set as text: eight hexadecimal digits per signature, in order."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def partition_of(sigs: Column, threshold: float = 0.75) -> Column:
    """Length partition of a set: sets with a likeness of ``threshold`` or more are at most one partition apart."""
    return F.when(F.size(sigs) == 0, -1).otherwise(F.floor(F.log(F.size(sigs).cast("double")) / F.log(F.lit(1 / threshold)))).cast("int")


def likeness(x: Column, y: Column, *, threshold: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 1 for two empty ones; 0 where the sizes rule out ``threshold``."""
    small, large = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    shared = F.size(F.array_intersect(x, y))
    return F.when(large == 0, 1.0).when((small == 0) | (small < large * threshold), 0.0).otherwise(shared / (F.size(x) + F.size(y) - shared))


def following(rows: DataFrame) -> DataFrame:
    """``id``, ``h``, ``nid``, ``nh``: for each distinct (id, hash of the text) the next one in order, the last followed
    by the first.  Ranges are ordered by themselves; only one row per range is ordered on its own."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a range is one partition of an exchange whose number of partitions is given, so its id is stable
    ranged = rows.select("id", "h").distinct().repartitionByRange(n, "id", "h").select("id", "h", F.spark_partition_id().alias("part"))
    inside = Window.partitionBy("part").orderBy("id", "h")
    one = F.struct("id", "h")
    led = ranged.select("id", "h", "part", F.lead(one).over(inside).alias("next"))
    firsts = ranged.groupBy("part").agg(F.min(one).alias("first"))
    over = Window.orderBy("part")  # as many rows as ranges
    turn = firsts.select("part", F.coalesce(F.lead("first").over(over), F.first("first").over(over)).alias("after"))
    return led.join(F.broadcast(turn), "part").select("id", "h", F.coalesce("next", "after").alias("next")).select("id", "h", F.col("next.id").alias("nid"), F.col("next.h").alias("nh"))


def compare_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the beginning of the next document replaces the last
    quarter, and the likeness of its fingerprint to the edited text's and to the next document's.

    Null texts count as empty.  Rows with one id are ordered by their texts' hashes; equal rows are one place in the
    order and have equal results; null ids come first.  Other columns are ignored.  Each text moves once, and a
    quarter of it once more.
    """
    keyed = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).select("id", F.xxhash64("t").alias("h"), "t", signatures("t").alias("s"))
    order = following(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("h")))
    lengths = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("h"), F.floor(F.length(text_of(text_col)) / 4).cast("int").alias("q")).distinct().alias("l")
    o = order.alias("o")
    order = o.join(lengths, F.col("o.id").eqNullSafe(F.col("l.id")) & (F.col("o.h") == F.col("l.h"))).select("o.id", "o.h", "o.nid", "o.nh", "l.q").alias("o")
    k = keyed.alias("k")
    heads = k.join(order, F.col("k.id").eqNullSafe(F.col("o.nid")) & (F.col("k.h") == F.col("o.nh"))).select("o.id", "o.h", F.expr("substring(k.t, 1, o.q)").alias("head"), F.col("k.s").alias("ns"))
    heads = heads.dropDuplicates(["id", "h"]).alias("n")
    both = k.join(heads, F.col("k.id").eqNullSafe(F.col("n.id")) & (F.col("k.h") == F.col("n.h"))).select("k.id", "k.t", "k.s", "n.head", "n.ns")
    cut = both.withColumn("n", F.length("t")).withColumn("e", F.expr("concat(substring(t, 1, n - cast(floor(n / 4) AS int)), head)"))
    done = cut.select("id", "n", "s", "ns", F.sha2(F.encode("e", "UTF-8"), 256).alias("edited_sha256"), signatures("e").alias("es"))
    return done.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        fingerprint(F.col("s")).alias("fingerprint"),
        fingerprint(F.col("es")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("es")).alias("near_edited"),
        likeness(F.col("s"), F.col("ns")).alias("near_next"),
        partition_of(F.col("s")).alias("length_partition"),
    )
