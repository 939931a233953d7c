"""Schemas of the logical tables, and their binding to the driver's tables.

One row of `calls` is a called genotype of a sample at a variant: gt is the alternate-allele dosage (NULL: no call), dp the
read depth, gq the genotype quality, af the allele fraction, gt_true the dosage in the truth set. A pair without a row is
not assayed and is outside every denominator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrove.shared import dealt, written

CALLS = "variant_id long, sample_id long, gt int, dp int, gq int, af double, gt_true int"
VARIANTS = "variant_id long, chrom string, pos long, ref string, alt string, filter string, mq double, vqslod double"
SAMPLES = "sample_id long, iid string, pheno int, sex int, target_depth string"

#: The thresholds of the full sweep.
GRID_DP, GRID_GQ = list(range(1, 31)), [10, 20, 30]
GRID_LAF, GRID_HAF = [0.0, 0.1, 0.15, 0.2, 0.25, 0.3], [1.0, 0.9, 0.85, 0.8, 0.75, 0.7]


def _dosage(line: str) -> F.Column:
    n = F.col(line)
    return F.when(n <= 3, 0).when(n <= 5, 1).when(n == 6, 2)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call for each (variant, sample): the least lineitem row, by partial aggregation instead of a window."""
    return _least(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", *FIELDS))


def kept_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calls() as a written table for queries that go through them more than once; its tasks take as many rows whatever the input."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", *FIELDS)
    return written(_least(dealt(rows, "l_partkey")), "calls")


#: Their order tells which row of a (variant, sample) counts.
FIELDS = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def _least(rows: DataFrame) -> DataFrame:
    fields = FIELDS
    least = rows.groupBy(F.col("l_partkey").alias("variant_id"), F.col("l_suppkey").alias("sample_id")).agg(F.min(F.struct(*fields)).alias("r"))
    order = F.col("r.l_orderkey")
    true = F.when(order % 17 == 0, None).when(order % 11 == 0, 0).when(order % 13 == 0, 1).when(order % 19 == 0, 2).otherwise(_dosage("r.l_linenumber"))
    return least.select(
        "variant_id", "sample_id", _dosage("r.l_linenumber").alias("gt"), F.col("r.l_quantity").cast("int").alias("dp"), F.round(F.col("r.l_tax") * 1000).cast("int").alias("gq"),
        F.round(F.col("r.l_discount") * 10, 1).alias("af"), true.cast("int").alias("gt_true"),
    )


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    base = lambda letters: F.substring(F.lit(letters), (F.col("p_partkey") % 4 + 1).cast("int"), 1)
    return p.select(
        F.col("p_partkey").alias("variant_id"), F.concat(F.lit("chr"), (F.col("p_size") % 24 + 1).cast("string")).alias("chrom"), (F.col("p_partkey") - F.col("p_partkey") % 2).alias("pos"), base("ACGT").alias("ref"), base("CGTA").alias("alt"),
        F.when(F.col("p_type") == "ECONOMY", "LowQual").otherwise("PASS").alias("filter"), (50 + F.col("p_partkey") % 11).cast("double").alias("mq"), (F.col("p_size").cast("double") / 2).alias("vqslod"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    case = F.col("s_nationkey") < 8
    depth = F.when(F.col("s_acctbal") < 3000, "15x").when(F.col("s_acctbal") < 9000, "30x")
    return s.select(F.col("s_suppkey").alias("sample_id"), F.concat(F.when(case, "PHOM").otherwise("AG"), F.col("s_suppkey").cast("string")).alias("iid"), F.when(case, 2).otherwise(1).alias("pheno"), (F.col("s_suppkey") % 2 + 1).cast("int").alias("sex"), depth.alias("target_depth"))


def panel_af(spark: SparkSession, sf_dir: str, given: DataFrame | None = None) -> DataFrame:
    """A population panel: the own frequency, shifted by a few hundredths; every 29th variant is missing."""
    from callgrove.operators.stats import allele_freq

    own = allele_freq(calls(spark, sf_dir) if given is None else given).where("alt_freq IS NOT NULL AND variant_id % 29 <> 0")
    shifted = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("alt_freq") + (F.col("variant_id") % 7 - 3) / 100.0))
    return own.join(variants(spark, sf_dir).select("variant_id", "filter"), "variant_id").select("variant_id", "filter", shifted.alias("panel_af"))


def regions(spark: SparkSession) -> DataFrame:
    """One interval per chromosome."""
    k = F.col("id")
    return spark.range(1, 25).select(F.concat(F.lit("chr"), k.cast("string")).alias("chrom"), (40 * k).alias("start"), (40 * k + 60).alias("end"))


def chip(spark: SparkSession, sf_dir: str, which: int, own: DataFrame | None = None) -> DataFrame:
    """The calls, or given ones, of one of two arrays: even samples without every 13th variant, or odd ones without every 17th."""
    every = 13 if which == 0 else 17
    return (calls(spark, sf_dir) if own is None else own).where((F.col("sample_id") % 2 == which) & (F.col("variant_id") % every != 0))


#: The same binding for DuckDB, as the start of a WITH clause.
SQL = """
calls_base AS (
  SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY l_partkey, l_suppkey
      ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS rn FROM lineitem l) x WHERE rn = 1),
calls AS (
  SELECT l_partkey AS variant_id, l_suppkey AS sample_id,
    CASE WHEN l_linenumber <= 3 THEN 0 WHEN l_linenumber <= 5 THEN 1 WHEN l_linenumber = 6 THEN 2 END AS gt,
    CAST(l_quantity AS INT) AS dp, CAST(round(l_tax * 1000) AS INT) AS gq, round(l_discount * 10, 1) AS af,
    CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 11 = 0 THEN 0 WHEN l_orderkey % 13 = 0 THEN 1 WHEN l_orderkey % 19 = 0 THEN 2
         WHEN l_linenumber <= 3 THEN 0 WHEN l_linenumber <= 5 THEN 1 WHEN l_linenumber = 6 THEN 2 END AS gt_true
  FROM calls_base),
variants AS (
  SELECT p_partkey AS variant_id, concat('chr', CAST(p_size % 24 + 1 AS VARCHAR)) AS chrom, p_partkey - p_partkey % 2 AS pos,
    substr('ACGT', CAST(p_partkey % 4 AS INT) + 1, 1) AS ref, substr('CGTA', CAST(p_partkey % 4 AS INT) + 1, 1) AS alt,
    CASE WHEN p_type = 'ECONOMY' THEN 'LowQual' ELSE 'PASS' END AS filter,
    CAST(50 + p_partkey % 11 AS DOUBLE) AS mq, CAST(p_size AS DOUBLE) / 2 AS vqslod FROM part),
samples AS (
  SELECT s_suppkey AS sample_id, concat(CASE WHEN s_nationkey < 8 THEN 'PHOM' ELSE 'AG' END, CAST(s_suppkey AS VARCHAR)) AS iid,
    CASE WHEN s_nationkey < 8 THEN 2 ELSE 1 END AS pheno, CAST(s_suppkey % 2 + 1 AS INT) AS sex,
    CASE WHEN s_acctbal < 3000 THEN '15x' WHEN s_acctbal < 9000 THEN '30x' END AS target_depth FROM supplier),
freq AS (
  SELECT variant_id, CAST(sum(gt) AS BIGINT) AS alt_count, 2 * count(gt) AS allele_count, sum(gt) / nullif(2.0 * count(gt), 0) AS alt_freq FROM calls GROUP BY variant_id),
panel_af AS (
  SELECT f.variant_id, v.filter, least(1.0, greatest(0.0, alt_freq + (f.variant_id % 7 - 3) / 100.0)) AS panel_af
  FROM freq f JOIN variants v USING (variant_id) WHERE alt_freq IS NOT NULL AND f.variant_id % 29 <> 0),
regions AS (SELECT concat('chr', CAST(k AS VARCHAR)) AS chrom, 40 * k AS start, 40 * k + 60 AS stop FROM range(1, 25) AS t(k))
"""
