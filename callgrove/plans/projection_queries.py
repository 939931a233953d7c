"""Queries of projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrove import schema
from callgrove.functions import expr, reference
from callgrove.operators import stats
from callgrove.plans.registry import query

GT = "CASE gt WHEN 0 THEN '0/0' WHEN 1 THEN CASE WHEN dp % 2 = 0 THEN '0/1' ELSE '1|0' END WHEN 2 THEN '1|1' ELSE CASE WHEN dp % 3 = 0 THEN './1' ELSE './.' END END"
PREFIXES = [("PHOM", "CTEPH"), ("AG", "AGP3K")]


@query("SELECT variant_id, concat(chrom, ':', CAST(pos AS VARCHAR), ':', ref, ':', alt) AS id FROM variants")
def prj1_set_variant_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expr.set_id(schema.variants(spark, sf_dir)).select("variant_id", "id")


@query("SELECT variant_id, chrom, pos, ref, alt FROM variants")
def prj2_split_variant_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expr.split_id(expr.set_id(schema.variants(spark, sf_dir)).select("variant_id", "id")).drop("id")


@query("SELECT variant_id, CASE WHEN chrom = 'chr23' THEN 'chrX' WHEN chrom = 'chr24' THEN 'chrY' ELSE chrom END AS chrom, replace(CASE WHEN chrom = 'chr23' THEN 'chrX' WHEN chrom = 'chr24' THEN 'chrY' ELSE chrom END, 'chr', '') AS bare FROM variants")
def prj3_rename_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("chr23", "chrX"), ("chr24", "chrY")], "old string, new string")
    return expr.rename_chrom(schema.variants(spark, sf_dir), mapping).select("variant_id", "chrom", expr.strip_chr(F.col("chrom")).alias("bare"))


@query("SELECT variant_id, sample_id, gt AS dosage FROM calls")
def prj4_gt_to_dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.calls(spark, sf_dir).select("variant_id", "sample_id", expr.dosage(F.expr(GT)).alias("dosage"))


@query("SELECT variant_id, sample_id, CASE gt WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' ELSE CASE WHEN dp % 3 = 0 THEN './1' ELSE './.' END END AS gt FROM calls")
def prj5_unphase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.calls(spark, sf_dir).select("variant_id", "sample_id", expr.unphase(F.expr(GT)).alias("gt"))


@query("SELECT variant_id, sample_id, CASE WHEN gq % 5 = 0 OR gq % 7 = 0 THEN NULL ELSE CAST(gq AS DOUBLE) END AS gq FROM calls")
def prj6_nan_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.expr("CASE WHEN gq % 5 = 0 THEN 'nan' WHEN gq % 7 = 0 THEN '.' ELSE CAST(gq AS STRING) END")
    return schema.calls(spark, sf_dir).select("variant_id", "sample_id", expr.clean_num(token).alias("gq"))


@query("SELECT variant_id, sample_id, gq / nullif(CAST(dp % 10 + gq AS DOUBLE), 0) AS fraction FROM calls")
def prj7_allele_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.calls(spark, sf_dir).select("variant_id", "sample_id", expr.allele_fraction(F.array(F.col("dp") % 10, F.col("gq"))).alias("fraction"))


@query("SELECT variant_id, least(alt_freq, 1 - alt_freq) AS maf FROM freq WHERE alt_freq IS NOT NULL")
def prj8_fold_maf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.allele_freq(schema.calls(spark, sf_dir)).dropna(subset=["alt_freq"]).select("variant_id", expr.maf(F.col("alt_freq")).alias("maf"))


@query("SELECT iid, CASE WHEN starts_with(iid, 'PHOM') THEN 'CTEPH' WHEN starts_with(iid, 'AG') THEN 'AGP3K' ELSE 'BBJ' END AS grp, CASE WHEN starts_with(iid, 'PHOM') THEN '2' ELSE '1' END AS pheno FROM samples")
def prj9_label_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.samples(spark, sf_dir).select("iid", expr.label_prefix(F.col("iid"), PREFIXES, "BBJ").alias("grp"), expr.label_prefix(F.col("iid"), [("PHOM", "2")], "1").alias("pheno"))


@query("SELECT a.sample_id AS id1, b.sample_id AS id2, CASE WHEN a.pheno = 2 AND b.pheno = 2 THEN 'case-case' WHEN a.pheno = 1 AND b.pheno = 1 THEN 'control-control' ELSE 'case-control' END AS kind FROM samples a JOIN samples b ON b.sample_id = a.sample_id + 1")
def prj10_pair_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema.samples(spark, sf_dir).select("sample_id", "pheno")
    a, b = s.toDF("id1", "p1"), s.toDF("id2", "p2")
    return a.join(b, F.col("id2") == F.col("id1") + 1).select("id1", "id2", expr.pair_type(F.col("p1"), F.col("p2")).alias("kind"))


@query("SELECT variant_id, CASE WHEN variant_id % 3 = 0 THEN 'YES' ELSE 'NO' END AS reversed FROM variants")
def prj11_allele_reversal_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = expr.set_id(schema.variants(spark, sf_dir))
    turned = v.select("variant_id", "id", F.when(F.col("variant_id") % 3 == 0, F.col("alt")).otherwise(F.col("ref")).alias("r"), F.when(F.col("variant_id") % 3 == 0, F.col("ref")).otherwise(F.col("alt")).alias("a"))
    return turned.select("variant_id", expr.rev_flag(F.col("id"), F.col("r"), F.col("a")).alias("reversed"))


@query("SELECT concat('bbj_', iid) AS fid, concat('bbj_', iid) AS iid FROM samples")
def prj12_prefix_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expr.prefix_ids(expr.double_id(schema.samples(spark, sf_dir)), "bbj_").select("fid", "iid")


@query("SELECT iid AS fid, iid, sample_id FROM samples")
def prj13_double_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expr.double_id(schema.samples(spark, sf_dir)).select("fid", "iid", "sample_id")


@query(", e AS (SELECT chrom, sum(vqslod) AS eigenvalue FROM variants GROUP BY chrom) SELECT chrom, eigenvalue, round(eigenvalue / sum(eigenvalue) OVER () * 100, 9) AS pct FROM e")
def prj14_explained_variance_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = schema.variants(spark, sf_dir).groupBy("chrom").agg(F.sum("vqslod").alias("eigenvalue"))
    return expr.explained_pct(values).withColumn("pct", F.round("pct", 9))


@query("SELECT variant_id, sample_id, round(dp / 77.0, 3) AS v FROM calls WHERE round(dp / 77.0, 3) > 0.5")
def prj15_round_then_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expr.round_filter(schema.calls(spark, sf_dir).select("variant_id", "sample_id", (F.col("dp") / 77.0).alias("v")), "v", 0.5)


def refseq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeating sequence ACGT for each chromosome, as far as its variants reach, in chunks."""
    last = schema.variants(spark, sf_dir).groupBy("chrom").agg(F.max("pos").alias("last"))
    return last.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / reference.CHUNK))).alias("chunk"), F.repeat(F.lit("ACGT"), reference.CHUNK // 4).alias("seq"))


_BASE = "substr('ACGT', CAST((pos - 1) % 4 AS INT) + 1, 1)"


@query(f"""SELECT variant_id, CASE WHEN pos > 0 AND ref <> {_BASE} AND alt = {_BASE} THEN alt ELSE ref END AS ref, CASE WHEN pos > 0 AND ref <> {_BASE} AND alt = {_BASE} THEN ref ELSE alt END AS alt,
  CASE WHEN pos > 0 AND ref <> {_BASE} AND alt = {_BASE} THEN 2 * n - s ELSE s END AS dosage
FROM variants JOIN (SELECT variant_id, CAST(count(gt) AS BIGINT) AS n, CAST(coalesce(sum(gt), 0) AS BIGINT) AS s FROM calls GROUP BY 1) USING (variant_id)""")
def prj16_allele_swap_to_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = reference.fix_ref(schema.variants(spark, sf_dir), schema.calls(spark, sf_dir), refseq(spark, sf_dir))
    return v.select("variant_id", "ref", "alt").join(c.groupBy("variant_id").agg(F.coalesce(F.sum("gt"), F.lit(0)).alias("dosage")), "variant_id")


@query("""SELECT variant_id, sample_id, alt, CASE WHEN gt IS NULL THEN NULL WHEN alt = 'T' THEN CASE WHEN gt >= 1 AND dp % 2 = 0 THEN 1 ELSE 0 END ELSE CASE WHEN gt = 2 THEN 1 + CASE WHEN dp % 2 = 0 THEN 0 ELSE 1 END WHEN gt = 1 AND dp % 2 = 1 THEN 1 ELSE 0 END END AS gt
FROM calls CROSS JOIN (VALUES ('G'), ('T')) a(alt)""")
def prj17_split_multiallelic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gt 1 carries the first allele (odd depth) or the second; gt 2 carries the first and, at even depth, the second."""
    other = F.when(F.col("dp") % 2 == 0, 2).otherwise(1)
    alleles = F.when(F.col("gt").isNull(), F.array(F.lit(None).cast("int"), F.lit(0))).when(F.col("gt") == 0, F.array(F.lit(0), F.lit(0))).when(F.col("gt") == 1, F.array(F.lit(0), other)).otherwise(F.array(F.lit(1), other))
    rows = schema.calls(spark, sf_dir).select("variant_id", "sample_id", F.array(F.lit("G"), F.lit("T")).alias("alts"), alleles.alias("alleles"))
    return expr.split_multiallelic(rows).select("variant_id", "sample_id", "alt", "gt")


@query("SELECT variant_id, chrom, CASE WHEN pos >= 1 AND pos % 2 = 0 THEN 0 ELSE 0 END + pos AS pos, ref, alt FROM variants WHERE pos > 0".replace("CASE WHEN pos >= 1 AND pos % 2 = 0 THEN 0 ELSE 0 END + ", ""))
def prj18_trim_and_left_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions dressed up with shared letters come out as they were."""
    v = schema.variants(spark, sf_dir).where("pos > 0")
    dressed = v.select("variant_id", "chrom", (F.col("pos") - 2).alias("pos"), F.concat(F.lit("TG"), "ref", F.lit("CA")).alias("ref"), F.concat(F.lit("TG"), "alt", F.lit("CA")).alias("alt"))
    return reference.left_align(dressed, refseq(spark, sf_dir)).select("variant_id", "chrom", "pos", "ref", "alt")


@query("SELECT sample_id, iid, CASE WHEN sample_id % 5 = 0 THEN sex ELSE 3 - sex END AS sex, CASE WHEN starts_with(iid, 'PHOM') THEN 2 ELSE 1 END AS pheno FROM samples")
def prj19_update_sex_pheno(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema.samples(spark, sf_dir)
    info = s.where("sample_id % 5 <> 0").select("sample_id", (3 - F.col("sex")).alias("new_sex"))
    joined = s.join(info, "sample_id", "left")
    return joined.select("sample_id", "iid", F.coalesce("new_sex", "sex").alias("sex"), expr.label_prefix(F.col("iid"), [("PHOM", "2")], "1").cast("int").alias("pheno"))


@query(", d AS (SELECT chrom, variant_id, sqrt((mq - 55) ** 2 + (vqslod - 12) ** 2) AS distance FROM variants) SELECT chrom, round(distance, 9) AS distance, variant_id FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY distance, variant_id) AS rn FROM d) WHERE rn = 1")
def prj20_nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expr.nearest(schema.variants(spark, sf_dir), "mq", "vqslod", (55, 12), ["chrom"], ["variant_id"]).withColumn("distance", F.round("distance", 9))


@query("SELECT variant_id, round((mq - min(mq) OVER w) / nullif(max(mq) OVER w - min(mq) OVER w, 0), 9) AS mq_scaled FROM variants WINDOW w AS (PARTITION BY chrom)")
def prj21_minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expr.minmax(schema.variants(spark, sf_dir), ["mq"], ["chrom"]).select("variant_id", F.round("mq_scaled", 9).alias("mq_scaled"))


@query("SELECT coalesce(CAST(gt AS VARCHAR), 'NA') AS gt, count(*) AS n FROM calls GROUP BY 1")
def prj22_format_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.calls(spark, sf_dir).groupBy(expr.format_gt(F.col("gt")).alias("gt")).agg(F.count("*").alias("n"))
