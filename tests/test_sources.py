import pytest

from tessera.operators import blocks as B
from tessera.sources import formats as S
from tessera.streaming import ingest


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_bed_rows_widths_and_empty_files(spark, tmp_path):
    path = put(tmp_path, "a.bed", "# note\nchr1\t5\t105\tr1\t0\t+\t5\t105\t0,0,0\t4\t1,10,20,1,\t0,10,40,99,\textra\n")
    rows = S.read(spark, path, "bed12")
    assert [(r.lo, r.hi) for r in B.expand(rows).collect()] == [(15, 25), (45, 65)]
    with pytest.raises(Exception, match="bed13 has 13 columns, this line has 12|bed15 has 15"):
        S.read(spark, path, "bed15").collect()
    assert S.read(spark, put(tmp_path, "e.bed", ""), "bed6").count() == 0
    bad = S.read(spark, put(tmp_path, "b.bed", "chr1\t9\t3\tr\n"), "bed4")
    with pytest.raises(Exception, match="0 <= lo < hi"):
        S.check_intervals(bad).collect()


def test_gtf_and_vcf(spark, tmp_path):
    gtf = put(tmp_path, "a.gtf", 'chr1\tX\ttranscript\t11\t50\t.\t-\t.\tgene_id "G1.4"; transcript_id "T1"; gene_name "n";\nchrM\tX\ttranscript\t1\t9\t.\t+\t.\tgene_id "G2";\nchr2\tX\ttranscript\t3\t9\t.\t+\t.\tgene_id "G3.1"; transcript_id "T3";\n')
    got = {r.gene_id: (r.tss, r.lo, r.hi, r.name) for r in S.transcription_starts(S.read(spark, gtf, "gtf")).collect()}
    assert got == {"G1": (49, 39, 60, "n"), "G3": (2, 0, 13, None)}
    vcf = put(tmp_path, "a.vcf", "##x\n#CHROM\nchr1\t10\ta\tA\tG,T\t.\tPASS\t.\tGT:PS\t0|2:7\nchr1\t11\tb\tA\tC\t.\tPASS\t.\tGT:PS\t0/1:7\nchr1\t12\tc\tA\tC\t.\tPASS\t.\tGT\t1|0\nchr1\t13\td\tA\tC\t.\tPASS\t.\tGT\t1|1\n")
    rows = [(r.pos, r.hap1, r.hap2, r.ps) for r in S.phased_variants(S.read(spark, vcf, "vcf")).orderBy("pos").collect()]
    assert rows == [(9, "A", "T", "7"), (11, "C", "A", None)]


def test_cache_is_made_once_per_signature(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for options in ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 2}):
        assert S.cached(spark, str(tmp_path), options, make).count() == 3
    assert len(made) == 2


def test_written_intervals_prune(spark, tmp_path):
    df = spark.range(1000).selectExpr("concat('chr', id % 3) AS chrom", "id * 10 AS lo", "id * 10 + 50 AS hi")
    S.write_intervals(df, str(tmp_path / "t"))
    part = S.region(spark.read.parquet(str(tmp_path / "t")), "chr1", 100, 200)
    plan = part._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan and "GreaterThan(hi,100)" in plan
    assert part.count() == df.where("chrom = 'chr1' AND lo < 200 AND hi > 100").count()


def test_manifest(spark):
    good = spark.createDataFrame([("a",), ("b",)], "name string")
    assert S.manifest(good, name="name", rows=2) is good
    for rows in ([("a",), ("a",)], [("a",)], [("a",), ("x/y",)], [("a",), ("b",), ("c",)]):
        with pytest.raises(ValueError):
            S.manifest(spark.createDataFrame(rows, "name string"), name="name", rows=2)


def test_stream_drops_repeats_and_writes_once(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{k % 5}:00", "s", k % 7) for k in range(20)]
    spark.createDataFrame(rows, "ts string, sample string, read int").selectExpr("cast(ts AS timestamp) AS ts", "sample", "read").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, sample string, read int").parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.to_parquet(ingest.unique_reads(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.read for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(7))
