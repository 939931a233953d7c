"""Queries of aggregates and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrove import schema
from callgrove.functions import expr
from callgrove.operators import concordance, filters, stats
from callgrove.plans.filter_queries import CASE_CONTROL, COUNTS, FREQ_VMISS, HET_MISS, HWE_SQL, case_control_p, freq_vmiss, het_miss
from callgrove.plans.registry import query
from callgrove.shared import sized


def rounded(df: DataFrame, digits: int = 8, columns: list[str] | None = None) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    wanted = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in wanted})


@query("SELECT variant_id, pheno, CAST(coalesce(sum(gt), 0) AS BIGINT) AS alt_count, 2 * count(gt) AS allele_count, sum(gt) / nullif(2.0 * count(gt), 0) AS alt_freq FROM calls JOIN samples USING (sample_id) GROUP BY variant_id, pheno")
def agg1_allele_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = schema.calls(spark, sf_dir).join(sized(schema.samples(spark, sf_dir).select("sample_id", "pheno")), "sample_id")
    return stats.allele_freq(calls, "pheno")


@query(f"SELECT variant_id, {COUNTS}, count_if(gt IS NULL) AS missing FROM calls GROUP BY 1")
def agg2_geno_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.geno_counts(schema.calls(spark, sf_dir))


@query("SELECT sample_id, count_if(gt IS NULL) / count(*) AS f_miss FROM calls GROUP BY 1")
def agg3_sample_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sample_missing(schema.calls(spark, sf_dir))


@query("SELECT variant_id, round(count_if(gt IS NULL) / count(*), 4) AS f_miss FROM calls GROUP BY 1")
def agg4_variant_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.variant_missing(schema.calls(spark, sf_dir), 4)


@query(", ef AS (SELECT variant_id, 1 - 2 * alt_freq * (1 - alt_freq) AS e FROM freq WHERE alt_freq IS NOT NULL) SELECT sample_id, count_if(gt <> 1) AS o_hom, round(sum(e), 8) AS e_hom, count(*) AS n_called, round((count_if(gt <> 1) - sum(e)) / (count(*) - sum(e)), 8) AS f FROM calls JOIN ef USING (variant_id) WHERE gt IS NOT NULL GROUP BY 1")
def agg5_heterozygosity_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.het_f(schema.calls(spark, sf_dir)))


@query(f", counts AS (SELECT variant_id, {COUNTS} FROM calls GROUP BY 1), {HWE_SQL} SELECT variant_id, hom_ref, het, hom_alt, round(p, 8) AS p FROM counts LEFT JOIN hw USING (hom_ref, het, hom_alt)")
def agg6_hwe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.hwe_exact(stats.geno_counts(schema.calls(spark, sf_dir)).drop("missing")))


@query(f"{HET_MISS} SELECT round(avg(f), 8) AS mean, round(stddev_samp(f), 8) AS sd, round(avg(f) - 5 * stddev_samp(f), 8) AS low, round(avg(f) + 5 * stddev_samp(f), 8) AS high FROM hm")
def agg7_sd_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.sd_bounds(stats.het_f(schema.calls(spark, sf_dir)), "f", "5sd"))


@query(f"""{HET_MISS}, b AS (SELECT avg(f) - 2 * stddev_samp(f) AS low, avg(f) + 2 * stddev_samp(f) AS high FROM hm JOIN ms USING (sample_id))
SELECT CASE WHEN f NOT BETWEEN low AND high AND f_miss > 0.145 THEN 'both' WHEN f NOT BETWEEN low AND high THEN 'f' WHEN f_miss > 0.145 THEN 'miss' ELSE 'pass' END AS outlier, count(*) AS n FROM hm JOIN ms USING (sample_id), b GROUP BY 1""")
def agg8_outlier_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.outlier_classes(het_miss(spark, sf_dir), 0.145, "2sd").groupBy("outlier").agg(F.count("*").alias("n"))


@query(f"{FREQ_VMISS}, c AS (SELECT CASE WHEN maf >= 0.2 THEN 'high' ELSE 'low' END AS maf_class, f_miss FROM fv) SELECT coalesce(maf_class, 'all') AS maf_class, count(*) AS total, count_if(f_miss < 0.14) AS passed, count_if(f_miss < 0.14) / count(*) AS ratio FROM c GROUP BY GROUPING SETS ((maf_class), ())")
def agg9_pass_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pass_ratio(freq_vmiss(spark, sf_dir), 0.2, 0.14)


@query(f"""{CASE_CONTROL}, q AS (SELECT CASE WHEN maf >= 0.2 THEN 'high' ELSE 'low' END AS maf_class, coalesce(p_control >= 0.05, FALSE) AS a, coalesce(p_case >= 0.05, FALSE) AS b FROM cp)
SELECT maf_class, count_if(a AND b) AS both_pass, count_if(a AND NOT b) AS control_only, count_if(NOT a AND b) AS case_only, count_if(NOT a AND NOT b) AS none_pass FROM q GROUP BY 1""")
def agg10_quadrant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quadrants(case_control_p(spark, sf_dir), 0.05, 0.05, 0.2)


@query("SELECT coalesce(CAST(gt_true AS VARCHAR), 'NA') AS true_gt, coalesce(CAST(gt AS VARCHAR), 'NA') AS call_gt, count(*) AS n FROM calls GROUP BY 1, 2")
def agg11_confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.confusion(schema.calls(spark, sf_dir))


def sweep_sql(field: str, low: int, high: int) -> str:
    return f""", g AS (SELECT variant_id, 'ALL' AS grp, {field} AS v FROM calls JOIN samples USING (sample_id) UNION ALL SELECT variant_id, upper(target_depth), {field} FROM calls JOIN samples USING (sample_id) WHERE target_depth IS NOT NULL),
    m AS (SELECT variant_id, grp, max(v) AS v FROM g GROUP BY ALL), t AS (SELECT grp, CAST(t AS INT) AS threshold FROM (VALUES ('ALL'), ('15X'), ('30X')) p(grp), range({low}, {high + 1}) r(t))
    SELECT t.grp AS grp, threshold, count(m.variant_id) AS sites FROM t LEFT JOIN m ON m.grp = t.grp AND m.v >= threshold GROUP BY ALL"""


@query(sweep_sql("dp", 1, 30))
def agg12_threshold_sweep_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.threshold_sweep(schema.calls(spark, sf_dir), schema.samples(spark, sf_dir), "dp", 1, 30)


@query(sweep_sql("gq", 11, 30))
def agg12_threshold_sweep_gq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.threshold_sweep(schema.calls(spark, sf_dir), schema.samples(spark, sf_dir), "gq", 11, 30)


@query("SELECT gq, count(*) AS n FROM calls WHERE gq IS NOT NULL GROUP BY 1")
def agg13_value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(schema.calls(spark, sf_dir), "gq")


@query("SELECT CAST(least(floor((vqslod - lo) * 50 / (hi - lo)), 49) AS INT) AS bin, count(*) AS n FROM variants, (SELECT min(vqslod) AS lo, max(vqslod) AS hi FROM variants) GROUP BY 1")
def agg14_binned_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(schema.variants(spark, sf_dir), "vqslod", 50)


@query("SELECT count_if(mq > 58.75) AS above, count(mq) AS total, min(mq) AS least, max(mq) AS most, 100.0 * count_if(mq > 58.75) / count(mq) AS percent FROM variants")
def agg15_share_above_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.share_above(schema.variants(spark, sf_dir), "mq", 58.75)


@query(f"{FREQ_VMISS} SELECT round(100.0 * count_if(f_miss < 0.15) / count(*), 8) AS percent_below, round(avg(f_miss), 8) AS mean FROM fv")
def agg16_percent_below_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.share_below(freq_vmiss(spark, sf_dir), "f_miss", 0.15))


PANEL = ", pj AS (SELECT variant_id, alt_freq, p.panel_af, v.filter FROM freq JOIN variants v USING (variant_id) LEFT JOIN panel_af p USING (variant_id) WHERE alt_freq IS NOT NULL)"


def panel_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stats.allele_freq(schema.calls(spark, sf_dir)).dropna(subset=["alt_freq"]).join(schema.variants(spark, sf_dir).select("variant_id", "filter"), "variant_id")
    return own.join(schema.panel_af(spark, sf_dir).drop("filter"), "variant_id", "left")


@query(f"{PANEL} SELECT round(avg((alt_freq - panel_af) ** 2), 10) AS mse_all, count(panel_af) AS n_all, round(avg((alt_freq - panel_af) ** 2) FILTER (filter = 'PASS'), 10) AS mse_pass, count(panel_af) FILTER (filter = 'PASS') AS n_pass, count_if(panel_af IS NULL) AS missing FROM pj")
def agg17_mean_squared_af_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.af_mse(panel_join(spark, sf_dir)), 10)


@query(f"""{PANEL}, counts AS (SELECT variant_id, {COUNTS} FROM calls GROUP BY 1), {HWE_SQL},
pg AS (SELECT pj.*, least(alt_freq, 1 - alt_freq) AS maf, p FROM pj JOIN counts USING (variant_id) LEFT JOIN hw USING (hom_ref, het, hom_alt)),
gr AS (SELECT hwe_t, maf_t FROM (VALUES (1e-6), (1e-3), (0.05)) a(hwe_t), (VALUES (0.01), (0.1), (0.2)) b(maf_t))
SELECT CAST(hwe_t AS DOUBLE) AS hwe_t, CAST(maf_t AS DOUBLE) AS maf_t, count(pg.variant_id) AS kept, round(count_if(pg.variant_id IS NOT NULL AND panel_af IS NULL) / nullif(count(pg.variant_id), 0), 10) AS missing_rate, round(avg((alt_freq - panel_af) ** 2), 10) AS mse
FROM gr LEFT JOIN pg ON p > hwe_t AND maf > maf_t GROUP BY ALL""")
def agg18_threshold_grid_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.hwe_exact(stats.geno_counts(schema.calls(spark, sf_dir))).select("variant_id", "p")
    full = panel_join(spark, sf_dir).join(p, "variant_id").withColumn("maf", expr.maf(F.col("alt_freq")))
    return rounded(stats.af_grid(full, [1e-6, 1e-3, 0.05], [0.01, 0.1, 0.2]), 10, ["missing_rate", "mse"])


VMISS4 = ", vm AS (SELECT platform, variant_id, round(count_if(gt IS NULL) / count(*), 4) AS vmiss FROM (SELECT 'ALL' AS platform, variant_id, gt FROM calls UNION ALL SELECT upper(target_depth), variant_id, gt FROM calls JOIN samples USING (sample_id) WHERE target_depth IS NOT NULL) GROUP BY ALL)"


def vmiss_by_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.masked_vmiss(schema.calls(spark, sf_dir), schema.samples(spark, sf_dir), 0, 0, 0.0, 1.0)


@query(f"{VMISS4} SELECT platform, round(avg(vmiss), 8) AS mean, round(stddev_samp(vmiss), 8) AS sd, round(median(vmiss), 8) AS median FROM vm GROUP BY 1")
def agg19_moments_of_vmiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.moments(vmiss_by_platform(spark, sf_dir), "vmiss", ["platform"]))


@query("SELECT target_depth, round(corr(CAST(dp AS DOUBLE), CAST(gq AS DOUBLE)), 7) AS r FROM calls JOIN samples USING (sample_id) GROUP BY 1")
def agg20_pearson_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = schema.calls(spark, sf_dir).join(sized(schema.samples(spark, sf_dir).select("sample_id", "target_depth")), "sample_id")
    return rounded(stats.pearson(calls.withColumns({"dp": F.col("dp").cast("double"), "gq": F.col("gq").cast("double")}), "dp", "gq", ["target_depth"]), 7)


@query(f"""{VMISS4}, q AS (SELECT platform, quantile_cont(vmiss, 0.25) AS q1, quantile_cont(vmiss, 0.5) AS median, quantile_cont(vmiss, 0.75) AS q3 FROM vm GROUP BY 1)
SELECT platform, round(q1, 8) AS q1, round(median, 8) AS median, round(q3, 8) AS q3, round(q3 - q1, 8) AS iqr, min(vmiss) FILTER (vmiss >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(vmiss) FILTER (vmiss <= q3 + 1.5 * (q3 - q1)) AS whisker_high FROM vm JOIN q USING (platform) GROUP BY platform, q1, median, q3""")
def agg21_box_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.box_stats(vmiss_by_platform(spark, sf_dir), "vmiss", ["platform"]))


@query()
def agg22_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U, z, p and differences for each pair of platforms; the tail probability has no SQL counterpart."""
    return rounded(stats.mann_whitney(vmiss_by_platform(spark, sf_dir), "vmiss", "platform", concordance.PLATFORMS), 6)


@query(f"""{VMISS4}, rk AS (SELECT a.g AS g1, b.g AS g2, vmiss, platform, rank() OVER (PARTITION BY a.g, b.g ORDER BY vmiss) + (count(*) OVER (PARTITION BY a.g, b.g, vmiss) - 1) / 2.0 AS r
FROM (VALUES ('ALL', 0), ('15X', 1), ('30X', 2)) a(g, i) JOIN (VALUES ('ALL', 0), ('15X', 1), ('30X', 2)) b(g, i) ON a.i < b.i JOIN vm ON platform IN (a.g, b.g))
SELECT g1, g2, round(sum(r) FILTER (platform = g1) - count(*) FILTER (platform = g1) * (count(*) FILTER (platform = g1) + 1) / 2.0, 6) AS u FROM rk GROUP BY ALL""")
def agg22_mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg22_mann_whitney(spark, sf_dir).select("g1", "g2", "u")


@query(f"""{VMISS4}, pr AS (SELECT a.g AS g1, b.g AS g2 FROM (VALUES ('ALL', 0), ('15X', 1), ('30X', 2)) a(g, i) JOIN (VALUES ('ALL', 0), ('15X', 1), ('30X', 2)) b(g, i) ON a.i < b.i),
rk AS (SELECT g1, g2, vmiss, platform, rank() OVER (PARTITION BY g1, g2 ORDER BY vmiss) + (count(*) OVER (PARTITION BY g1, g2, vmiss) - 1) / 2.0 AS r FROM pr JOIN vm ON platform IN (g1, g2)),
us AS (SELECT g1, g2, sum(r) FILTER (platform = g1) - count(*) FILTER (platform = g1) * (count(*) FILTER (platform = g1) + 1) / 2.0 AS u, CAST(count(*) FILTER (platform = g1) AS DOUBLE) AS m1, CAST(count(*) AS DOUBLE) AS m FROM rk GROUP BY g1, g2),
ti AS (SELECT g1, g2, sum(CAST(k AS DOUBLE) ** 3 - k) AS ties FROM (SELECT g1, g2, vmiss, count(*) AS k FROM rk GROUP BY g1, g2, vmiss) GROUP BY g1, g2),
md AS (SELECT platform, quantile_cont(vmiss, 0.5) AS med, avg(vmiss) AS mean FROM vm GROUP BY 1)
SELECT g1, g2, round(greatest((abs(u - m1 * (m - m1) / 2) - 0.5) / sqrt(m1 * (m - m1) / 12 * ((m + 1) - ties / (m * (m - 1)))), 0.0), 8) AS z, round(a.med - b.med, 8) AS median_diff, round(a.mean - b.mean, 8) AS mean_diff
FROM us JOIN ti USING (g1, g2) JOIN md a ON a.platform = g1 JOIN md b ON b.platform = g2""")
def agg22_mann_whitney_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.mann_whitney(vmiss_by_platform(spark, sf_dir), "vmiss", "platform", concordance.PLATFORMS)
    return rounded(got.select("g1", "g2", "z", "median_diff", "mean_diff"))


@query(f"""{VMISS4}, st AS (SELECT platform, min(vmiss) AS lo, max(vmiss) AS hi, 0.2 * stddev_samp(vmiss) AS h, count(*) AS n FROM vm GROUP BY 1),
gx AS (SELECT platform, CAST(i AS INT) AS point, lo + (hi - lo) * i / 299 AS x, h, n FROM st, range(0, 300) r(i))
SELECT platform, point, round(x, 8) AS x, round(sum(exp(-0.5 * ((x - vmiss) / h) ** 2)) / any_value(n * h * sqrt(2 * pi())), 6) AS density FROM gx JOIN vm USING (platform) GROUP BY platform, point, x""")
def agg23_gaussian_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.kde(vmiss_by_platform(spark, sf_dir), "vmiss", ["platform"])
    return got.withColumns({"x": F.round("x", 8), "density": F.round("density", 6)})


@query("SELECT CASE WHEN starts_with(iid, 'PHOM') THEN 'CTEPH' ELSE 'AGP3K' END AS label, count(*) AS n FROM samples GROUP BY 1")
def agg24_group_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.label_counts(schema.samples(spark, sf_dir).select(expr.label_prefix(F.col("iid"), [("PHOM", "CTEPH")], "AGP3K").alias("label")), "label")


_STATE = "CASE {0} WHEN 0 THEN 'HOM_REF' WHEN 1 THEN 'HET_REF_VAR1' WHEN 2 THEN 'HOM_VAR1' ELSE 'NO_CALL' END"
_CONTINGENCY = """CASE WHEN c IN ('NO_CALL', 'LOW_DP', 'LOW_GQ') OR t = 'NO_CALL' THEN 'EMPTY' WHEN t = 'HOM_REF' THEN CASE c WHEN 'HOM_REF' THEN 'TN' WHEN 'HET_REF_VAR1' THEN 'FP,TN' ELSE 'FP' END
WHEN t = 'HET_REF_VAR1' THEN CASE c WHEN 'HOM_REF' THEN 'TN,FN' WHEN 'HET_REF_VAR1' THEN 'TP,TN' ELSE 'TP,FP' END ELSE CASE c WHEN 'HOM_REF' THEN 'FN' WHEN 'HET_REF_VAR1' THEN 'TP,FN' ELSE 'TP' END END"""
STATE_SQL = f""", s0 AS (SELECT sample_id, {_STATE.format('gt_true')} AS t, CASE WHEN gt IS NOT NULL AND dp < 8 THEN 'LOW_DP' WHEN gt IS NOT NULL AND gq < 20 THEN 'LOW_GQ' ELSE {_STATE.format('gt')} END AS c FROM calls),
sd AS (SELECT sample_id, t AS truth_state, c AS call_state, {_CONTINGENCY} AS contingency, count(*) AS n FROM s0 GROUP BY ALL)"""
PLATFORM_SQL = ", pd AS (SELECT 'ALL' AS platform, sd.* FROM sd JOIN samples USING (sample_id) WHERE target_depth IS NOT NULL UNION ALL SELECT upper(target_depth), sd.* FROM sd JOIN samples USING (sample_id) WHERE target_depth IS NOT NULL)"


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.state_detail(schema.calls(spark, sf_dir))


@query(f"{STATE_SQL} SELECT sample_id, truth_state, call_state, n, contingency FROM sd UNION ALL SELECT sample_id, 'HOM_REF', 'HOM_REF', 100000 - sum(n), 'TN' FROM sd GROUP BY sample_id")
def agg25_complement_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.add_hom_ref(detail(spark, sf_dir), 100000)


@query(", vg AS (SELECT p.dp AS dp, p.gq AS gq, variant_id, count_if(gt IS NULL OR c.dp < p.dp OR c.gq < p.gq) / count(*) AS f FROM calls c, (SELECT dp, gq FROM (VALUES (5), (10), (20)) a(dp), (VALUES (10), (20), (30)) b(gq)) p GROUP BY ALL) SELECT dp, gq, round(avg(f), 8) AS mean_vmiss FROM vg GROUP BY ALL")
def agg26_mean_per_parameter_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, grid = schema.calls(spark, sf_dir), [(d, g) for d in (5, 10, 20) for g in (10, 20, 30)]
    hidden = lambda d, g: F.count_if(F.col("gt").isNull() | filters.mask_rule(d, g)) / F.count("*")
    rates = calls.groupBy("variant_id").agg(*[hidden(d, g).alias(f"r_{d}_{g}") for d, g in grid])
    long = rates.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dp"), F.lit(g).alias("gq"), F.col(f"r_{d}_{g}").alias("vmiss")) for d, g in grid])).alias("s")).select("s.*")
    return rounded(stats.mean_by(long, "vmiss", ["dp", "gq"]))


@query(", cf AS (SELECT coalesce(CAST(gt_true AS VARCHAR), 'NA') AS true_gt, coalesce(CAST(gt AS VARCHAR), 'NA') AS c FROM calls) SELECT 'ALL' AS platform, t.true_gt AS true_gt, count_if(c = '0') AS call_0, count_if(c = '1') AS call_1, count_if(c = '2') AS call_2, count_if(c = 'NA') AS call_na FROM (VALUES ('0'), ('1'), ('2'), ('NA')) t(true_gt) LEFT JOIN cf ON cf.true_gt = t.true_gt GROUP BY t.true_gt")
def rsh1_confusion_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.confusion_matrix(concordance.confusion(schema.calls(spark, sf_dir)).withColumn("platform", F.lit("ALL")))


@query(f"""{STATE_SQL} {PLATFORM_SQL}, lb AS (SELECT platform, truth_state FROM (SELECT DISTINCT platform FROM pd), (VALUES ('HOM_REF'), ('HET_REF_VAR1'), ('HOM_VAR1'), ('NO_CALL')) s(truth_state))
SELECT lb.platform AS platform, lb.truth_state AS truth_state, CAST(coalesce(sum(n) FILTER (call_state = 'HOM_REF'), 0) AS BIGINT) AS call_hom_ref, CAST(coalesce(sum(n) FILTER (call_state = 'HET_REF_VAR1'), 0) AS BIGINT) AS call_het_ref_var1,
CAST(coalesce(sum(n) FILTER (call_state = 'HOM_VAR1'), 0) AS BIGINT) AS call_hom_var1, CAST(coalesce(sum(n) FILTER (call_state IN ('NO_CALL', 'LOW_DP', 'LOW_GQ')), 0) AS BIGINT) AS call_no_call FROM lb LEFT JOIN pd ON pd.platform = lb.platform AND pd.truth_state = lb.truth_state GROUP BY ALL""")
def rsh2_state_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.state_matrix(concordance.detail_by_platform(detail(spark, sf_dir), schema.samples(spark, sf_dir)))


@query("SELECT platform, laf, round(max(v) FILTER (haf = 1.0), 8) AS \"1.0\", round(max(v) FILTER (haf = 0.8), 8) AS \"0.8\" FROM (SELECT 'ALL' AS platform, a.laf AS laf, b.haf AS haf, count_if(gt = 1 AND (af < a.laf OR af > b.haf)) / count(*) AS v FROM calls, (VALUES (0.1), (0.2)) a(laf), (VALUES (1.0), (0.8)) b(haf) GROUP BY ALL) GROUP BY platform, laf".replace("a.laf AS laf", "CAST(a.laf AS DOUBLE) AS laf"))
def rsh3_heatmap_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of heterozygotes that a balance threshold hides."""
    calls, pairs = schema.calls(spark, sf_dir), [(a, b) for a in (0.1, 0.2) for b in (1.0, 0.8)]
    hidden = lambda a, b: F.count_if((F.col("gt") == 1) & ((F.col("af") < a) | (F.col("af") > b))) / F.count("*")
    one = calls.agg(*[hidden(a, b).alias(f"v{i}") for i, (a, b) in enumerate(pairs)])
    long = one.select(F.explode(F.array(*[F.struct(F.lit("ALL").alias("platform"), F.lit(8).alias("dp"), F.lit(20).alias("gq"), F.lit(a).alias("laf"), F.lit(b).alias("haf"), F.col(f"v{i}").alias("v")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")
    return concordance.heatmap(long.withColumn("v", F.round("v", 8)), 8, 20, "v", [1.0, 0.8])


@query("SELECT m AS metric, max(v) FILTER (chrom = 'chr1') AS chr1, max(v) FILTER (chrom = 'chr2') AS chr2, max(v) FILTER (chrom = 'chr3') AS chr3 FROM (SELECT chrom, 'passed' AS m, count_if(filter = 'PASS') AS v FROM variants GROUP BY 1 UNION ALL SELECT chrom, 'sites', count(*) FROM variants GROUP BY 1) GROUP BY m")
def rsh4_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = schema.variants(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("sites"), F.count_if(F.col("filter") == "PASS").alias("passed"))
    return stats.transpose(table, "chrom", ["sites", "passed"], ["chr1", "chr2", "chr3"])


@query("SELECT sample_id, 'dp' AS variable, sum(dp) AS value FROM calls GROUP BY 1 UNION ALL SELECT sample_id, 'gq', sum(gq) FROM calls GROUP BY 1")
def rsh5_ravel(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = schema.calls(spark, sf_dir).groupBy("sample_id").agg(F.sum("dp").alias("dp"), F.sum("gq").alias("gq"))
    return stats.ravel(wide, "sample_id", ["dp", "gq"])


@query("SELECT DISTINCT dp, gq, 0.25 AS laf, 0.75 AS haf, upper(target_depth) AS platform FROM calls JOIN samples USING (sample_id) WHERE target_depth IS NOT NULL".replace("0.25 AS laf, 0.75 AS haf", "CAST(0.25 AS DOUBLE) AS laf, CAST(0.75 AS DOUBLE) AS haf"))
def rsh6_parse_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = schema.calls(spark, sf_dir).join(sized(schema.samples(spark, sf_dir).where("target_depth IS NOT NULL")), "sample_id")
    key = F.concat(F.lit("DP"), "dp", F.lit("_GQ"), "gq", F.lit("_LAF0.25_HAF0.75_"), F.upper("target_depth"))
    return stats.parse_key(calls.select(key.alias("key")).distinct(), "key").drop("key")
