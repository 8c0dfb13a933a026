"""Queries over the supplied tables: each applies an operator to a projection, next to its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bases of a chromosome: as many more as there are more reads, so that what stands in one place does not grow with the tables.
SPAN = "(SELECT 100000 * greatest(1, CAST(floor(count(*) / 6000.0) AS BIGINT)) FROM orders)"
#: Projections of the supplied tables onto reads, elements, regions and so on, in SQL that both engines read alike.
VIEWS: dict[str, str] = {
    "reads": f"SELECT o_orderkey AS read, o_custkey % 4 AS sample, o_orderkey % 5 AS chrom, (o_orderkey * 7919) % {SPAN} AS lo, (o_orderkey * 7919) % {SPAN} + 1000 + o_custkey % 3000 AS hi, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '+' END AS strand, o_custkey AS donor FROM orders",
    "elements": "SELECT l_orderkey AS read, r.sample AS sample, r.chrom AS chrom, l_linenumber AS el, r.lo + (l_linenumber * 617 + l_partkey) % 3000 AS lo, r.lo + (l_linenumber * 617 + l_partkey) % 3000 + 50 + CAST(l_quantity AS BIGINT) * 10 AS hi, l_partkey % 100 AS score FROM lineitem l JOIN reads r ON l.l_orderkey = r.read",
    "regions": f"SELECT p_partkey AS region, p_partkey % 5 AS chrom, (p_partkey * 104729) % {SPAN} AS lo, (p_partkey * 104729) % {SPAN} + 100 + p_size * 10 AS hi, p_size % 4 AS kind FROM part",
    "genes": f"SELECT s_suppkey AS gene, s_suppkey % 5 AS chrom, (s_suppkey * 15485863) % {SPAN} AS tss, CASE WHEN s_suppkey % 2 = 0 THEN '-' ELSE '+' END AS strand, greatest((s_suppkey * 15485863) % {SPAN} - 10000, 0) AS lo, (s_suppkey * 15485863) % {SPAN} + 10001 AS hi, s_name AS name, s_nationkey AS nation FROM supplier",
    "calls": "SELECT l_orderkey AS read, r.sample AS sample, r.chrom AS chrom, r.lo + (l_partkey * 37 + l_linenumber * 101) % 1000 AS pos, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS called FROM lineitem l JOIN reads r ON l.l_orderkey = r.read",
    "beds": f"SELECT o_orderkey AS read, o_orderkey % 5 AS chrom, (o_orderkey * 7919) % {SPAN} AS lo, (o_orderkey * 7919) % {SPAN} + 400 AS hi, 4 AS block_count, concat('1,', CAST(10 + o_orderkey % 50 AS VARCHAR(9)), ',', CAST(20 + o_custkey % 90 AS VARCHAR(9)), ',1,') AS sizes, concat('0,', CAST(5 + o_custkey % 60 AS VARCHAR(9)), ',', CAST(150 + o_orderkey % 40 AS VARCHAR(9)), ',399,') AS starts, concat('0,', CAST(o_orderkey % 256 AS VARCHAR(9)), ',', CAST(o_custkey % 256 AS VARCHAR(9)), ',0') AS scores FROM orders",
    "tables": "SELECT l_suppkey AS pair, l_linenumber AS sample, count(*) AS n, sum(CASE WHEN l_quantity <= 30 AND l_discount <= 0.06 THEN 1 ELSE 0 END) AS neither, sum(CASE WHEN l_quantity > 30 AND l_discount <= 0.06 THEN 1 ELSE 0 END) AS first, sum(CASE WHEN l_quantity <= 30 AND l_discount > 0.06 THEN 1 ELSE 0 END) AS second, sum(CASE WHEN l_quantity > 30 AND l_discount > 0.06 THEN 1 ELSE 0 END) AS joint FROM lineitem GROUP BY l_suppkey, l_linenumber",
    "clusters": "SELECT o_orderkey AS read, o_custkey % 4 AS sample, o_orderkey % 5 AS chrom, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey * 31 + o_custkey) % 7 END AS cluster, o_custkey % 50 AS gene, o_totalprice AS value FROM orders",
    "tags": "SELECT s.s_nationkey AS gene, s.s_suppkey * 13 % 97 AS pos, s.s_suppkey % 9 + 1 AS n FROM supplier s",
    "states": "SELECT p_partkey % 5 AS chrom, CAST(floor(p_partkey / 5) AS BIGINT) * 250 AS lo, CAST(floor(p_partkey / 5) AS BIGINT) * 250 + 100 + p_size * 3 AS hi, p_brand AS state FROM part",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _named(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def _needed(sql: str) -> list[str]:
    """Views that a text uses, those that they use first."""
    out: list[str] = []
    for n in _named(sql, VIEWS):
        out += [x for x in [*_needed(VIEWS[n]), n] if x not in out]
    return out


class Tables:
    """The supplied tables and the projections of one data directory, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self._dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        return self.sql(VIEWS[name])

    def sql(self, text: str) -> DataFrame:
        text = text.replace("VARCHAR(9)", "STRING")
        used = [n for n in (*VIEWS, *TABLES) if re.search(rf"(FROM|JOIN) {n}\b", text)]
        return self.spark.sql(re.sub(r"(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], text), **{n: getattr(self, n) for n in used})


def query(name: str, sql: str | None = None):
    """Registers a function of :class:`Tables` as a query, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is there twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            needed = _needed(sql)
            ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
            body = sql.strip()
            if needed:
                body = f"WITH {ctes}, {body[4:].lstrip()}" if body[:4].upper() == "WITH" else f"WITH {ctes} {body}"
            SQL[name] = body
        return f

    return add
