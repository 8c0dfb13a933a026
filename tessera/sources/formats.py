"""Readers and writers of the text formats.

Text is read with a fixed schema, checked, and meant to be written once as Parquet partitioned by chromosome and sorted by
position, so that region scans prune files and row groups."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTERVAL = "chrom string, lo long, hi long"
_BED12 = f"{_INTERVAL}, read string, score double, strand string, thick_lo long, thick_hi long, rgb string, block_count int, sizes string, starts string"
#: Leading columns of each positional format.
FORMATS = {
    "bed4": f"{_INTERVAL}, read string",
    "bed6": f"{_INTERVAL}, read string, score double, strand string",
    "bed12": _BED12,
    "bed13": f"{_BED12}, scores string",
    "bed15": f"{_BED12}, scores string, edges_left string, edges_right string",
    "legacy_bed10": f"{_INTERVAL}, read string, thick_lo long, thick_hi long, rgb string, block_count int, starts string, sizes string",
    "segments": f"{_INTERVAL}, read string, score double, strand string, thick_lo long, thick_hi long, rgb string, element_score double, tag string",
    "ctss": f"{_INTERVAL}, name string, n long, strand string",
    "chromatin_states": f"{_INTERVAL}, state string",
    "gtf": "chrom string, source string, feature string, lo1 long, hi long, score string, strand string, frame string, attributes string",
    "vcf": "chrom string, pos1 long, id string, ref string, alt string, qual string, filter string, info string, format string, sample string",
}
#: Chromosomes that analyses keep.
CHROMOSOMES = "^chr([1-9]|1[0-9]|2[0-2]|X|Y)$"


def read(spark: SparkSession, path: str | list[str], kind: str, *, skip: str = "#") -> DataFrame:
    """Rows of a tab-separated file of a known format.

    A line with fewer columns than the format, or with a value that does not fit its type, is an error that names the
    line; an empty file gives no rows.  Lines that begin with ``skip`` are passed over; further columns are ignored."""
    schema = T.StructType.fromDDL(FORMATS[kind])
    lines = spark.read.text(path).where(~F.col("value").startswith(skip) & (F.trim("value") != ""))
    parts = F.split("value", "\t", -1)
    width = len(schema)
    checked = lines.select(F.when(F.size(parts) >= width, parts).otherwise(F.raise_error(F.concat(F.lit(f"{kind} has {width} columns, this line has "), F.size(parts).cast("string"), F.lit(": "), F.substring("value", 1, 200)))).alias("p"))
    return checked.select(*(F.col("p")[k].cast(f.dataType).alias(f.name) for k, f in enumerate(schema)))


def region(df: DataFrame, chrom, lo: int, hi: int) -> DataFrame:
    """Rows that overlap a region; the plain comparisons are pushed down to the files."""
    return df.where((F.col("chrom") == chrom) & (F.col("lo") < hi) & (F.col("hi") > lo))


def check_intervals(df: DataFrame) -> DataFrame:
    """``df``, failing on intervals that are null, negative or not ordered."""
    fine = F.coalesce((F.col("lo") >= 0) & (F.col("hi") > F.col("lo")), F.lit(False))
    return df.withColumn("lo", F.when(fine, F.col("lo")).otherwise(F.raise_error(F.lit("intervals must have 0 <= lo < hi"))))


def attribute(name: str, column: str = "attributes") -> Column:
    """One attribute of a GTF line; null where there is none."""
    got = F.regexp_extract(column, f'{name} "([^"]*)"', 1)
    return F.when(got != "", got)


def transcription_starts(gtf: DataFrame, *, feature: str = "transcript", flank: int = 10) -> DataFrame:
    """0-based start sites of a GTF's features with their windows, on the usual chromosomes."""
    site = F.when(F.col("strand") == "-", F.col("hi") - 1).otherwise(F.col("lo1") - 1)
    rows = gtf.where((F.col("feature") == feature) & F.col("chrom").rlike(CHROMOSOMES)).withColumn("tss", site)
    return rows.select("chrom", "tss", F.greatest(F.col("tss") - flank, F.lit(0)).alias("lo"), (F.col("tss") + flank + 1).alias("hi"), "strand", F.regexp_replace(attribute("gene_id"), r"\.[0-9]+$", "").alias("gene_id"), attribute("transcript_id").alias("transcript_id"), attribute("gene_name").alias("name"))


def phased_variants(vcf: DataFrame, *, block: str | None = None) -> DataFrame:
    """Variants with a phased heterozygous genotype: ``pos`` (0-based), alleles of both haplotypes and the phase set."""
    keys, values = F.split("format", ":"), F.split("sample", ":")
    field = lambda name: F.try_element_at(values, F.array_position(keys, name).cast("int"))
    rows = vcf.where(F.array_contains(keys, "GT")).withColumn("gt", field("GT")).withColumn("ps", F.when(F.array_contains(keys, "PS"), field("PS")))
    rows = rows.where(F.col("gt").rlike(r"^[0-9]+\|[0-9]+$"))
    alleles = F.concat(F.array("ref"), F.split("alt", ","))
    side = lambda k: F.element_at(alleles, F.split("gt", r"\|")[k].cast("int") + 1)
    out = rows.select("chrom", (F.col("pos1") - 1).alias("pos"), "id", side(0).alias("hap1"), side(1).alias("hap2"), "ps").where("hap1 <> hap2")
    return out if block is None else out.where(F.col("ps") == block)


def signature(options: dict) -> str:
    """A fingerprint of options: the hash of their JSON with sorted keys."""
    return hashlib.sha256(json.dumps(options, sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, options: dict, make) -> DataFrame:
    """The table that ``make()`` gives, from ``folder`` if it was written there under the same options.

    Parquet's commit marker says whether a write was complete; half a write is written again."""
    path = f"{folder.rstrip('/')}/{signature(options)}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_intervals(df: DataFrame, path: str) -> None:
    """Parquet by chromosome, each file sorted, so that region scans read few row groups."""
    df.repartitionByRange("chrom", "lo").sortWithinPartitions("chrom", "lo", "hi").write.partitionBy("chrom").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header; appears only when complete."""
    df.write.option("sep", "\t").option("header", True).csv(path)


def manifest(df: DataFrame, *, name: str, rows: int) -> DataFrame:
    """A sample sheet of exactly ``rows`` unique names without path characters; anything else is an error."""
    names = [r[0] for r in df.select(name).limit(rows + 1).collect()]
    if len(names) != rows or len(set(names)) != rows or any(not n or "/" in n or n in (".", "..") for n in names):
        raise ValueError(f"expected {rows} unique plain sample names, got {names[:5]} and so on, {len(names)} in all")
    return df
