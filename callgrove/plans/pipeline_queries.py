"""Queries of the named compositions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrove import schema
from callgrove.operators import filters
from callgrove.plans import pipelines
from callgrove.plans.concordance_queries import FULL, FULL_SQL, WEIGHTS, knee_sql
from callgrove.functions.expr import strip_chr
from callgrove.plans.filter_queries import CASE_CONTROL, COUNTS, HWE_SQL, MASK, some_scores
from callgrove.plans.model_queries import KIN_SQL, cover_counts, labels
from callgrove.plans.projection_queries import _BASE, refseq
from callgrove.plans.registry import query
from callgrove.plans.statistic_queries import rounded, sweep_sql

_QC = """, b1 AS (SELECT * FROM calls WHERE variant_id IN (SELECT variant_id FROM variants WHERE filter = 'PASS')), b2 AS (SELECT * FROM b1 WHERE variant_id IN (SELECT variant_id FROM b1 GROUP BY 1 HAVING sum(gt) >= 1)),
f2 AS (SELECT variant_id, sum(gt) / nullif(2.0 * count(gt), 0) AS p FROM b2 GROUP BY 1), h2 AS (SELECT sample_id, (count_if(gt <> 1) - sum(1 - 2 * p * (1 - p))) / nullif(count(*) - sum(1 - 2 * p * (1 - p)), 0) AS f FROM b2 JOIN f2 USING (variant_id) WHERE gt IS NOT NULL AND p IS NOT NULL GROUP BY 1),
m2 AS (SELECT sample_id, count_if(gt IS NULL) / count(*) AS f_miss FROM b2 GROUP BY 1), d2 AS (SELECT avg(f) - 5 * stddev_samp(f) AS lo, avg(f) + 5 * stddev_samp(f) AS hi FROM h2 JOIN m2 USING (sample_id)),
ok AS (SELECT sample_id FROM h2 JOIN m2 USING (sample_id), d2 WHERE f BETWEEN lo AND hi AND f_miss <= 0.145),
b3 AS (SELECT * FROM b2 WHERE sample_id IN (SELECT sample_id FROM ok) AND variant_id IN (SELECT variant_id FROM variants WHERE vqslod > 10 AND mq > 58.75))"""


@query(f"{_QC}, b4 AS (SELECT variant_id, sample_id, CASE WHEN {MASK.format(dp=8, gq=20, laf=0, haf=1).split(' AND NOT coalesce(gt = 1')[0]} THEN gt END AS gt FROM b3) SELECT b4.variant_id AS variant_id, sample_id, gt, concat(chrom, ':', CAST(pos AS VARCHAR), ':', ref, ':', alt) AS id FROM b4 JOIN variants v ON v.variant_id = b4.variant_id WHERE b4.variant_id IN (SELECT variant_id FROM b4 GROUP BY 1 HAVING sum(gt) >= 1)")
def pip1_wgs_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pipelines.wgs_select(schema.calls(spark, sf_dir), schema.variants(spark, sf_dir), schema.samples(spark, sf_dir), miss=0.145)
    return got.select("variant_id", "sample_id", "gt", "id")


@query(f"{_QC}, nc AS (SELECT variant_id, sample_id, CASE WHEN {MASK.format(dp=8, gq=20, laf=0, haf=1).split(' AND NOT coalesce(gt = 1')[0]} THEN gt END AS gt, round(dp * af) / nullif(dp, 0) AS af FROM b3) SELECT variant_id, sample_id, gt, af FROM nc WHERE variant_id IN (SELECT variant_id FROM nc GROUP BY 1 HAVING sum(gt) >= 1)")
def pip1_wgs_select_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from genotype strings, some phased, and read counts."""
    calls = schema.calls(spark, sf_dir)
    text = F.when(F.col("gt") == 0, "0|0").when(F.col("gt") == 1, F.when(F.col("dp") % 2 == 0, "1|0").otherwise("0/1")).when(F.col("gt") == 2, "1/1").otherwise("./.")
    alt = F.round(F.col("dp") * F.col("af")).cast("int")
    raw = calls.select("variant_id", "sample_id", "dp", "gq", text.alias("gt_text"), F.array(F.col("dp") - alt, alt).alias("ad"))
    return pipelines.wgs_select(raw, schema.variants(spark, sf_dir), schema.samples(spark, sf_dir), miss=0.145).select("variant_id", "sample_id", "gt", "af")


@query(""", e AS (SELECT variant_id, 1 - 2 * alt_freq * (1 - alt_freq) AS e FROM freq WHERE alt_freq IS NOT NULL), h AS (SELECT sample_id, (count_if(gt <> 1) - sum(e)) / nullif(count(*) - sum(e), 0) AS f FROM calls JOIN e USING (variant_id) WHERE gt IS NOT NULL GROUP BY 1),
m AS (SELECT sample_id, count_if(gt IS NULL) / count(*) AS f_miss FROM calls GROUP BY 1), d AS (SELECT avg(f) - 3 * stddev_samp(f) AS lo, avg(f) + 3 * stddev_samp(f) AS hi FROM h)
SELECT sample_id, round(f, 8) AS f, f_miss, CASE WHEN f NOT BETWEEN lo AND hi AND f_miss > 0.145 THEN 'both' WHEN f NOT BETWEEN lo AND hi THEN 'f' WHEN f_miss > 0.145 THEN 'miss' ELSE 'pass' END AS outlier FROM h JOIN m USING (sample_id), d""")
def pip2_sample_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pipelines.sample_qc(schema.calls(spark, sf_dir), 0.145, "3sd"), 8, ["f"])


@query(", cf AS (SELECT variant_id, sum(gt) / nullif(2.0 * count(gt), 0) AS p FROM calls JOIN samples USING (sample_id) WHERE pheno = 1 GROUP BY 1), m AS (SELECT variant_id, count_if(gt IS NULL) / count(*) AS f_miss FROM calls GROUP BY 1) SELECT variant_id, least(p, 1 - p) AS maf, f_miss, least(p, 1 - p) > 0 AND f_miss < 0.12 AS keeps FROM cf JOIN m USING (variant_id) WHERE p IS NOT NULL")
def pip3_variant_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.variant_qc(schema.calls(spark, sf_dir), schema.samples(spark, sf_dir), 0.12)


@query(", cf AS (SELECT variant_id, sum(gt) / nullif(2.0 * count(gt), 0) AS p FROM calls JOIN samples USING (sample_id) WHERE pheno = 1 GROUP BY 1), m AS (SELECT variant_id, count_if(gt IS NULL) / count(*) AS f_miss FROM calls GROUP BY 1), c AS (SELECT CASE WHEN least(p, 1 - p) >= 0.2 THEN 'high' ELSE 'low' END AS maf_class, f_miss FROM cf JOIN m USING (variant_id) WHERE p IS NOT NULL) SELECT coalesce(maf_class, 'all') AS maf_class, count(*) AS total, count_if(f_miss < 0.14) AS passed, count_if(f_miss < 0.14) / count(*) AS ratio FROM c GROUP BY GROUPING SETS ((maf_class), ())")
def pip3_variant_qc_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.variant_qc_ratio(schema.calls(spark, sf_dir), schema.samples(spark, sf_dir), 0.14, 0.2)


@query(f"""{CASE_CONTROL}, q AS (SELECT CASE WHEN maf >= 0.2 THEN 'high' ELSE 'low' END AS maf_class, coalesce(p_control >= 0.05, FALSE) AS a, coalesce(p_case >= 0.05, FALSE) AS b FROM cp)
SELECT maf_class, count_if(a AND b) AS both_pass, count_if(a AND NOT b) AS control_only, count_if(NOT a AND b) AS case_only, count_if(NOT a AND NOT b) AS none_pass FROM q GROUP BY 1""")
def pip4_hwe_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.hwe_quadrants(schema.calls(spark, sf_dir), schema.samples(spark, sf_dir), 0.05, 0.05, 0.2)


@query(f""", counts AS (SELECT variant_id, pheno, {COUNTS} FROM calls JOIN samples USING (sample_id) GROUP BY ALL), {HWE_SQL},
cc AS (SELECT variant_id, max(CASE WHEN pheno = 2 THEN p END) AS p_case, max(CASE WHEN pheno = 1 THEN p END) AS p_control FROM counts LEFT JOIN hw USING (hom_ref, het, hom_alt) GROUP BY 1)
SELECT variant_id, least(alt_freq, 1 - alt_freq) AS maf, round(p_case, 8) AS p_case, round(p_control, 8) AS p_control FROM freq JOIN cc USING (variant_id) WHERE p_control >= 1e-3 AND p_case >= 1e-4""")
def pip4_hwe_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pipelines.hwe_check(schema.calls(spark, sf_dir), schema.samples(spark, sf_dir), control=1e-3, case=1e-4), 8, ["p_case", "p_control"])


@query()
def pip5_pca_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = schema.calls(spark, sf_dir)
    ids = pipelines.hwe_check(calls, schema.samples(spark, sf_dir), "only_control").select("variant_id")
    return rounded(pipelines.pca_run(calls, schema.variants(spark, sf_dir), schema.regions(spark), ids, 0.05, 5)[0], 6)


_TURNED = f"(pos > 0 AND ref <> {_BASE} AND alt = {_BASE})"


@query(f"""SELECT variant_id, concat(CASE chrom WHEN 'chr23' THEN 'chrX' WHEN 'chr24' THEN 'chrY' ELSE chrom END, ':', CAST(pos AS VARCHAR), ':', CASE WHEN {_TURNED} THEN alt ELSE ref END, ':', CASE WHEN {_TURNED} THEN ref ELSE alt END) AS id,
    CAST(sum(CASE WHEN {_TURNED} THEN 2 - gt ELSE gt END) AS BIGINT) AS dosage, count(gt) AS called
FROM variants JOIN freq f USING (variant_id) JOIN calls USING (variant_id) WHERE least(f.alt_freq, 1 - f.alt_freq) >= 0.05 GROUP BY variant_id, chrom, pos, ref, alt""")
def pip6_reference_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("chr23", "chrX"), ("chr24", "chrY")], "old string, new string")
    v, c = pipelines.reference_prepare(schema.calls(spark, sf_dir), schema.variants(spark, sf_dir), refseq(spark, sf_dir), mapping, 0.05)
    return v.join(c.groupBy("variant_id").agg(F.sum("gt").alias("dosage"), F.count("gt").alias("called")), "variant_id").select("variant_id", "id", "dosage", "called")


@query()
def pip7_reference_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even samples are the reference cohort, odd ones are projected."""
    calls = schema.calls(spark, sf_dir)
    got = pipelines.reference_projection(calls.where("sample_id % 2 = 1"), calls.where("sample_id % 2 = 0"), schema.variants(spark, sf_dir), schema.regions(spark), labels(spark, sf_dir), ["CTEPH", "AGP3K"], k=3, prefix="ref_")
    return rounded(got, 6)


@query()
def pip8_kinship_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, variants = schema.samples(spark, sf_dir), schema.variants(spark, sf_dir)
    return pipelines.kinship_remove(schema.calls(spark, sf_dir), samples, samples.where("target_depth IS NOT NULL"), variants.where("filter = 'PASS'"), 0.02)[0]


_OWN_KIN = KIN_SQL.replace("calls", "own_calls")


@query(f""", own_calls AS (SELECT * FROM calls WHERE sample_id IN (SELECT sample_id FROM samples WHERE target_depth IS NOT NULL) AND variant_id IN (SELECT variant_id FROM variants WHERE filter = 'PASS')) {_OWN_KIN}
SELECT CASE WHEN a.pheno = 2 AND b.pheno = 2 THEN 'case-case' WHEN a.pheno = 1 AND b.pheno = 1 THEN 'control-control' ELSE 'case-control' END AS pair_type, count(*) AS n, 0 AS uncovered, 0 AS unneeded
FROM ph JOIN samples a ON a.sample_id = id1 JOIN samples b ON b.sample_id = id2 WHERE round(p1 / 2 + p2, 3) > 0.02 GROUP BY 1""")
def pip8_kinship_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related pairs by type, with those that the removal leaves, and removed samples of which no pair stays without them."""
    samples, variants = schema.samples(spark, sf_dir), schema.variants(spark, sf_dir)
    gone, pairs = pipelines.kinship_remove(schema.calls(spark, sf_dir), samples, samples.where("target_depth IS NOT NULL"), variants.where("filter = 'PASS'"), 0.02)
    return cover_counts(pairs, gone)


def _clean(x: str) -> str:
    return f"""{x}1 AS (SELECT * FROM {x} WHERE sample_id NOT IN (SELECT sample_id FROM {x} GROUP BY 1 HAVING count_if(gt IS NULL) / count(*) > 0.16)), {x}2 AS (SELECT * FROM {x}1 WHERE variant_id NOT IN (SELECT variant_id FROM {x}1 GROUP BY 1 HAVING count_if(gt IS NULL) / count(*) > 0.2))"""


@query(f""", ca AS (SELECT * FROM calls WHERE sample_id % 2 = 0 AND variant_id % 13 <> 0), cb AS (SELECT * FROM calls WHERE sample_id % 2 = 1 AND variant_id % 17 <> 0), {_clean('ca')}, {_clean('cb')},
st AS (SELECT variant_id FROM variants WHERE (chrom, pos) NOT IN (SELECT chrom, pos FROM variants GROUP BY ALL HAVING count(*) > 1) AND CAST(substr(chrom, 4) AS INT) <= 22),
mg AS (SELECT * FROM (SELECT variant_id, sample_id, gt FROM ca2 UNION ALL SELECT variant_id, sample_id, gt FROM cb2) WHERE variant_id IN (SELECT variant_id FROM ca2 INTERSECT SELECT variant_id FROM cb2) AND variant_id IN (SELECT variant_id FROM st)),
counts AS (SELECT variant_id, {COUNTS} FROM mg GROUP BY 1), {HWE_SQL}, mf AS (SELECT variant_id, sum(gt) / nullif(2.0 * count(gt), 0) AS af FROM mg GROUP BY 1),
nr AS (SELECT variant_id, af, panel_af, round(af - panel_af, 9) AS diff, p FROM mf JOIN counts USING (variant_id) JOIN hw USING (hom_ref, het, hom_alt) JOIN (SELECT variant_id, panel_af FROM panel_af) USING (variant_id) WHERE least(af, 1 - af) > 0.01 AND p > 1e-6)
SELECT variant_id, af AS alt_freq, round(panel_af, 9) AS panel_af, round(p, 8) AS p FROM nr, (SELECT quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi FROM nr) WHERE diff BETWEEN lo AND hi""")
def pip9_array_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = schema.kept_calls(spark, sf_dir)
    got = pipelines.array_truth(schema.chip(spark, sf_dir, 0, own), schema.chip(spark, sf_dir, 1, own), schema.variants(spark, sf_dir), schema.panel_af(spark, sf_dir, own), 0.16, 0.2)
    return got.select("variant_id", "alt_freq", F.round("panel_af", 9).alias("panel_af"), F.round("p", 8).alias("p"))


_SWAP = "pos > 0 AND ref <> substr('ACGT', CAST((pos - 1) % 4 AS INT) + 1, 1) AND alt = substr('ACGT', CAST((pos - 1) % 4 AS INT) + 1, 1)"


@query(f""", ca AS (SELECT * FROM calls WHERE sample_id % 2 = 0 AND variant_id % 13 <> 0), cb AS (SELECT * FROM calls WHERE sample_id % 2 = 1 AND variant_id % 17 <> 0), {_clean('ca')}, {_clean('cb')},
st AS (SELECT variant_id, {_SWAP} AS swapped FROM variants WHERE (chrom, pos) NOT IN (SELECT chrom, pos FROM variants GROUP BY ALL HAVING count(*) > 1) AND CAST(substr(chrom, 4) AS INT) <= 22),
mg AS (SELECT variant_id, sample_id, CASE WHEN swapped THEN 2 - gt ELSE gt END AS gt FROM (SELECT variant_id, sample_id, gt FROM ca2 UNION ALL SELECT variant_id, sample_id, gt FROM cb2) JOIN st USING (variant_id) WHERE variant_id IN (SELECT variant_id FROM ca2 INTERSECT SELECT variant_id FROM cb2)),
counts AS (SELECT variant_id, {COUNTS} FROM mg GROUP BY 1), {HWE_SQL}, mf AS (SELECT variant_id, sum(gt) / nullif(2.0 * count(gt), 0) AS af FROM mg GROUP BY 1),
nr AS (SELECT variant_id, af, panel_af, round(af - panel_af, 9) AS diff, p FROM mf JOIN counts USING (variant_id) JOIN hw USING (hom_ref, het, hom_alt) JOIN (SELECT variant_id, panel_af FROM panel_af) USING (variant_id) WHERE least(af, 1 - af) > 0.01 AND p > 1e-6)
SELECT variant_id, af AS alt_freq, round(panel_af, 9) AS panel_af, round(p, 8) AS p FROM nr, (SELECT quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi FROM nr) WHERE diff BETWEEN lo AND hi""")
def pip9_array_truth_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With names of chromosomes from a table, alleles by the reference sequence, splitting and left alignment."""
    own = schema.kept_calls(spark, sf_dir)
    mapping = spark.createDataFrame([(str(k), f"chr{k}") for k in range(1, 25)], "old string, new string")
    plain = schema.variants(spark, sf_dir).withColumn("chrom", strip_chr(F.col("chrom")))
    got = pipelines.array_truth(schema.chip(spark, sf_dir, 0, own), schema.chip(spark, sf_dir, 1, own), plain, schema.panel_af(spark, sf_dir, own), 0.16, 0.2, refseq=refseq(spark, sf_dir), mapping=mapping)
    return got.select("variant_id", "alt_freq", F.round("panel_af", 9).alias("panel_af"), F.round("p", 8).alias("p"))


_GOALS = "".join(
    f", pf_{m} AS (SELECT a.* FROM gs a WHERE {m} IS NOT NULL AND miss_rate IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gs b WHERE b.platform = a.platform AND b.miss_rate <= a.miss_rate AND b.{m} {op}= a.{m} AND (b.{m} {op} a.{m} OR b.miss_rate < a.miss_rate)))"
    for m, op in (("concordance", ">"), ("fp_rate", "<"), ("fn_rate", "<"))
)


def _knee(m: str, rising: bool) -> str:
    text = re.sub(r"\bk[wsdpmrfn]\b", lambda found: f"{found[0]}_{m}", knee_sql(WEIGHTS, f"pf_{m}", m))
    return text if rising else text.replace("weight * ys - xs AS d", "weight * (1 - ys) - xs AS d")


_PICK = " UNION ALL ".join(
    f"SELECT '{m}' AS goal, platform, weight, dp, gq, laf, haf, value, miss_rate FROM (SELECT k.platform AS platform, weight, dp, gq, laf, haf, {m} AS value, miss_rate, row_number() OVER (PARTITION BY k.platform, weight ORDER BY dp, gq, laf, haf) AS rn FROM kn_{m} k JOIN pf_{m} f ON f.platform = k.platform AND miss_rate = knee_x AND {m} = knee_y) WHERE rn = 1"
    for m in ("concordance", "fp_rate", "fn_rate")
)


@query(f"{FULL_SQL} {_GOALS} {_knee('concordance', True)} {_knee('fp_rate', False)} {_knee('fn_rate', False)} {_PICK}")
def pip10_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = schema.kept_calls(spark, sf_dir)
    return pipelines.tune(calls, calls.select("variant_id", "sample_id", "gt_true"), schema.samples(spark, sf_dir), FULL, WEIGHTS)


@query(sweep_sql("dp", 1, 30).replace("SELECT t.grp AS grp", ", dq AS (SELECT 'dp' AS field, t.grp AS grp").rstrip() + ")" + sweep_sql("gq", 11, 30).replace(", g AS", ", g2 AS").replace("FROM g GROUP", "FROM g2 GROUP").replace("m AS (", "m2 AS (").replace(", t AS (", ", t2 AS (").replace("SELECT t.grp AS grp", ", gq2 AS (SELECT 'gq' AS field, t2.grp AS grp").replace("m.variant_id", "m2.variant_id").replace("FROM t LEFT JOIN m ON m.grp = t.grp AND m.v", "FROM t2 LEFT JOIN m2 ON m2.grp = t2.grp AND m2.v") + ") SELECT * FROM dq UNION ALL SELECT * FROM gq2 UNION ALL SELECT 'mq', 'ALL', 58, count_if(mq > 58.75) FROM variants UNION ALL SELECT 'vqslod', 'ALL', 10, count_if(vqslod > 10) FROM variants")
def pip11_parameter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.parameter_scan(schema.calls(spark, sf_dir), schema.variants(spark, sf_dir), schema.samples(spark, sf_dir))


@query("""SELECT 'dp' AS field, CAST(dp AS INT) AS value, count(*) AS n FROM calls WHERE dp IS NOT NULL GROUP BY dp UNION ALL SELECT 'gq', CAST(gq AS INT), count(*) FROM calls WHERE gq IS NOT NULL GROUP BY gq
UNION ALL SELECT 'mq', CAST(least(floor((mq - lo) * 50 / (hi - lo)), 49) AS INT) AS value, count(*) FROM variants, (SELECT min(mq) AS lo, max(mq) AS hi FROM variants) GROUP BY 2
UNION ALL SELECT 'vqslod', CAST(least(floor((vqslod - lo) * 50 / (hi - lo)), 49) AS INT) AS value, count(*) FROM variants, (SELECT min(vqslod) AS lo, max(vqslod) AS hi FROM variants) GROUP BY 2""")
def pip11_parameter_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.parameter_histograms(schema.calls(spark, sf_dir), schema.variants(spark, sf_dir))


@query(f""", vy AS (SELECT * FROM calls WHERE variant_id NOT IN (SELECT variant_id FROM freq WHERE least(alt_freq, 1 - alt_freq) = 0)), cf AS (SELECT variant_id FROM vy JOIN samples USING (sample_id) WHERE pheno = 1 GROUP BY 1 HAVING least(sum(gt) / nullif(2.0 * count(gt), 0), 1 - sum(gt) / nullif(2.0 * count(gt), 0)) >= 0.2)
SELECT variant_id, pheno, {COUNTS}, count_if(gt IS NULL) AS missing, variant_id IN (SELECT variant_id FROM cf) AS common FROM vy JOIN samples USING (sample_id) GROUP BY variant_id, pheno""")
def pip12_frequency_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.frequency_split(schema.calls(spark, sf_dir), schema.samples(spark, sf_dir), 0.2)


@query()
def pip13_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema.samples(spark, sf_dir)
    got = pipelines.run_association(schema.calls(spark, sf_dir), s, s.where("target_depth IS NOT NULL"), s.where("sample_id % 11 = 0"), some_scores(spark, sf_dir), schema.variants(spark, sf_dir))
    return rounded(got.select("variant_id", "n", "odds_ratio", "se", "ci_low", "ci_high", "z", "p", "neg_log10_p", "expected", "is_lead"), 6)


@query("""SELECT s.iid AS iid, s.sample_id AS sample_id, CASE WHEN starts_with(s.iid, 'PHOM') THEN 'case' ELSE 'control' END AS grp, target_depth, s.sample_id % 10 = 0 AS repeated
FROM (SELECT * FROM samples UNION ALL SELECT * FROM samples WHERE sample_id % 10 = 0) s WHERE target_depth IS NOT NULL AND s.sample_id % 4 <> 1""")
def pip14_sample_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema.samples(spark, sf_dir)
    return pipelines.sample_registry(filters.concat([s, s.where("sample_id % 10 = 0")]), s.where("sample_id % 4 <> 1").select("iid"))
