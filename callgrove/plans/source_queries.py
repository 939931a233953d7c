"""Queries of scans and sinks: tables are written to the shared folder in the format, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrove import schema
from callgrove.operators import stats
from callgrove.plans.registry import query
from callgrove.shared import new_folder
from callgrove.sources import tables, vcf


def _vcf(spark: SparkSession, sf_dir: str) -> str:
    path = new_folder(spark, "vcf")
    return vcf.write_vcf(schema.variants(spark, sf_dir), schema.calls(spark, sf_dir), path)


@query("SELECT CAST(variant_id AS VARCHAR) AS id, CAST(sample_id AS VARCHAR) AS sample, gt, dp, gq, af FROM calls")
def src1_vcf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that were written; pairs that were not assayed have no field and are left out."""
    return vcf.read_vcf(spark, _vcf(spark, sf_dir), whole=True).where("dp IS NOT NULL").select("id", "sample", "gt", "dp", "gq", "af")


@query("SELECT chrom, pos, CAST(variant_id AS VARCHAR) AS id, ref, alt, filter, mq, vqslod FROM variants WHERE variant_id IN (SELECT variant_id FROM calls)")
def src2_vcf_query_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcf.sites(spark, _vcf(spark, sf_dir)).select("chrom", "pos", "id", "ref", F.col("alts")[0].alias("alt"), "filter", vcf.info_field("MQ").alias("mq"), vcf.info_field("VQSLOD").alias("vqslod"))


@query("SELECT variant_id AS id, alt_freq FROM freq")
def src3_whitespace_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "ws")
    freq = stats.allele_freq(schema.calls(spark, sf_dir))
    line = F.concat(F.lit("  "), F.col("variant_id").cast("string"), F.lit("   "), F.col("alt_count").cast("string"), F.lit("\t"), F.coalesce(F.col("alt_freq").cast("string"), F.lit("NA")))
    spark.createDataFrame([("#ID ALT_COUNT ALT_FREQS",)], "value string").unionByName(freq.select(line.alias("value"))).write.text(path)
    return tables.read_ws(spark, path, "id long, alt_count long, alt_freq double", "#ID", ["id", "alt_freq"])


@query("SELECT sample_id, iid, target_depth FROM samples")
def src4_delimited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.write_tsv(schema.samples(spark, sf_dir).select("sample_id", "iid", "target_depth"), new_folder(spark, "tsv"))
    return tables.read_delimited(spark, path, "sample_id long, iid string, target_depth string", encoding="ISO-8859-1")


@query("SELECT iid AS id FROM samples")
def src5_id_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "ids")
    ids = schema.samples(spark, sf_dir).select("iid")
    tables.write_lines(ids.unionByName(spark.createDataFrame([("",), ("  ",)], "iid string")), "iid", path)
    return tables.read_ids(spark, path)


@query("SELECT iid AS fid, iid, sex, pheno FROM samples")
def src6_fam_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "fam")
    line = F.concat_ws("\t", "iid", "iid", F.lit("0"), F.lit("0"), F.col("sex").cast("string"), F.col("pheno").cast("string"))
    schema.samples(spark, sf_dir).select(line.alias("value")).write.text(path)
    return tables.read_fam(spark, path)


@query("SELECT chrom, CAST(variant_id AS VARCHAR) AS variant_id, pos, ref AS a1, alt AS a2 FROM variants")
def src6_bim_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "bim")
    line = F.concat_ws("\t", "chrom", F.col("variant_id").cast("string"), F.lit("0"), F.col("pos").cast("string"), "ref", "alt")
    schema.variants(spark, sf_dir).select(line.alias("value")).write.text(path)
    return tables.read_bim(spark, path)


def _matrix(spark: SparkSession, sf_dir: str) -> str:
    return tables.write_matrix_blocks(schema.calls(spark, sf_dir), schema.variants(spark, sf_dir), "dp", new_folder(spark, "matrix"))


def _depths(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_matrix_blocks(spark, path, "dp", blanks=False).groupBy("sample_id").agg(F.count("dp").alias("n"), F.sum("dp").alias("depth"))


@query("SELECT CAST(sample_id AS VARCHAR) AS sample_id, CAST(variant_id AS VARCHAR) AS variant_id, CAST(dp AS DOUBLE) AS dp FROM calls WHERE dp IS NOT NULL")
def src7_wide_matrix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_matrix_blocks(spark, _matrix(spark, sf_dir), "dp", blanks=False).where("dp IS NOT NULL")


@query("SELECT CAST(sample_id AS VARCHAR) AS sample_id, CAST(variant_id AS VARCHAR) AS variant_id, CAST(dp AS DOUBLE) AS dp FROM calls WHERE dp IS NOT NULL")
def src7_wide_matrix_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_matrix_blocks(spark, _matrix(spark, sf_dir), "dp", blanks=False).where("dp IS NOT NULL")


@query("SELECT chrom, count(*) AS sites FROM variants GROUP BY chrom")
def src8_site_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.variants(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("sites"))


@query("SELECT variant_id, chrom, pos, ref, alt, filter FROM variants")
def snk1_table_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.write_tsv(schema.variants(spark, sf_dir).select("variant_id", "chrom", "pos", "ref", "alt", "filter"), new_folder(spark, "tsv"), header=False)
    return tables.read_delimited(spark, path, "variant_id long, chrom string, pos long, ref string, alt string, filter string", header=False)


@query("SELECT CAST(sample_id AS VARCHAR) AS sample_id, count(dp) AS n, sum(CAST(dp AS DOUBLE)) AS depth FROM calls GROUP BY sample_id")
def snk2_wide_matrix_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depths(spark, _matrix(spark, sf_dir))


@query("SELECT CAST(sample_id AS VARCHAR) AS sample_id, count(dp) AS n, sum(CAST(dp AS DOUBLE)) AS depth FROM calls GROUP BY sample_id")
def snk2_wide_matrix_writer_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depths(spark, _matrix(spark, sf_dir))


@query("SELECT chrom, count(*) AS n, count(gt) AS called FROM calls JOIN variants USING (variant_id) GROUP BY chrom")
def snk3_genotype_table_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = schema.calls(spark, sf_dir).join(schema.variants(spark, sf_dir).select("variant_id", "chrom", "pos"), "variant_id")
    path = tables.write_calls(full, new_folder(spark, "calls"))
    return spark.read.parquet(path).groupBy("chrom").agg(F.count("*").alias("n"), F.count("gt").alias("called"))


@query("SELECT dp AS dp_min, variant_id, round(avg(CASE WHEN c.gt IS NULL OR c.dp < p.dp THEN 1.0 ELSE 0.0 END), 4) AS f_miss FROM (SELECT variant_id, gt, dp FROM calls) c CROSS JOIN (VALUES (8), (10)) p(dp) GROUP BY p.dp, variant_id".replace("SELECT dp AS dp_min", "SELECT p.dp AS dp_min"))
def snk4_keyed_result_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callgrove.operators.filters import mask_calls

    calls = schema.calls(spark, sf_dir)
    kept = [({"dp_min": t}, stats.variant_missing(mask_calls(calls, dp=t, gq=0), 4)) for t in (8, 10, 12)]
    path = tables.write_results(kept, new_folder(spark, "results"))
    return tables.read_results(spark, path).where("dp_min <= 10")
