"""Queries of concordance, sweeps and the choice of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrove import schema
from callgrove.operators import concordance, selection
from callgrove.plans.filter_queries import CHIPS, masked_sql
from callgrove.plans.registry import query
from callgrove.plans.statistic_queries import PLATFORM_SQL, STATE_SQL, detail, rounded

PLATFORMS = ", pl AS (SELECT sample_id, 'ALL' AS platform FROM samples UNION ALL SELECT sample_id, upper(target_depth) FROM samples WHERE target_depth IS NOT NULL)"
NA = "coalesce(CAST({0} AS VARCHAR), 'NA')"
SUMS = """CAST(coalesce(sum(n) FILTER (t <> 'NA' AND c <> 'NA'), 0) AS BIGINT) AS total_genotype, CAST(coalesce(sum(n) FILTER (t <> 'NA'), 0) AS BIGINT) AS total_with_empty, CAST(sum(n) AS BIGINT) AS total_with_all_na,
CAST(coalesce(sum(n) FILTER (t = c AND t <> 'NA'), 0) AS BIGINT) AS same, CAST(coalesce(sum(n) FILTER (t <> 'NA' AND c = 'NA'), 0) AS BIGINT) AS gone, CAST(coalesce(sum(n) FILTER (t <> 'NA' AND c <> 'NA' AND c > t), 0) AS BIGINT) AS fp, CAST(coalesce(sum(n) FILTER (t <> 'NA' AND c <> 'NA' AND c < t), 0) AS BIGINT) AS fn,
CAST(coalesce(sum(n) FILTER (t = '1' AND c = '2'), 0) AS BIGINT) AS het_homvar_count, CAST(coalesce(sum(n) FILTER (t = '0' AND c = '2'), 0) AS BIGINT) AS homref_homvar_count, CAST(coalesce(sum(n) FILTER (t = '0' AND c = '1'), 0) AS BIGINT) AS homref_het_count"""
RATES = """total_genotype, total_with_empty, total_with_all_na, same / nullif(total_genotype, 0) AS concordance, same / nullif(total_with_empty, 0) AS concordance_with_empty, gone / nullif(total_with_empty, 0) AS miss_rate, fp / nullif(total_genotype, 0) AS fp_rate, fn / nullif(total_genotype, 0) AS fn_rate,
het_homvar_count, homref_homvar_count, homref_het_count, het_homvar_count / nullif(total_genotype, 0) AS het_homvar_rate, homref_homvar_count / nullif(total_genotype, 0) AS homref_homvar_rate, homref_het_count / nullif(total_genotype, 0) AS homref_het_rate"""
VMISS = "round(avg(vmiss), 8) AS vmiss_mean, round(stddev_samp(vmiss), 8) AS vmiss_sd, round(median(vmiss), 8) AS vmiss_median"


@query(f"{CHIPS}, sv AS (SELECT variant_id FROM ca INTERSECT SELECT variant_id FROM calls WHERE sample_id % 3 = 0) SELECT variant_id, sample_id, gt FROM ca WHERE variant_id IN (SELECT variant_id FROM sv) AND sample_id IN (SELECT sample_id FROM calls WHERE sample_id % 3 = 0)")
def cnc1_shared_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = schema.calls(spark, sf_dir).where("sample_id % 3 = 0")
    return concordance.shared_sets(schema.chip(spark, sf_dir, 0), other)[0].select("variant_id", "sample_id", "gt")


@query(f"{PLATFORMS}, {masked_sql(8, 20, 0.25, 0.75)} SELECT platform, {NA.format('gt_true')} AS true_gt, {NA.format('gt')} AS call_gt, count(*) AS n FROM masked JOIN pl USING (sample_id) GROUP BY ALL")
def cnc2_masked_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.masked_confusion(schema.calls(spark, sf_dir), schema.samples(spark, sf_dir))


@query(f"{PLATFORMS}, {masked_sql(8, 20, 0.25, 0.75)} SELECT platform, variant_id, round(count_if(gt IS NULL) / count(*), 4) AS vmiss FROM masked JOIN pl USING (sample_id) GROUP BY platform, variant_id")
def cnc2_masked_vmiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.masked_vmiss(schema.calls(spark, sf_dir), schema.samples(spark, sf_dir))


@query(f"""{PLATFORMS}, {masked_sql(8, 20, 0.25, 0.75)}, mp AS (SELECT * FROM masked JOIN pl USING (sample_id)), cf AS (SELECT platform, {NA.format('gt_true')} AS t, {NA.format('gt')} AS c, count(*) AS n FROM mp GROUP BY ALL),
sm AS (SELECT platform, {SUMS} FROM cf GROUP BY platform), vm AS (SELECT platform, variant_id, round(count_if(gt IS NULL) / count(*), 4) AS vmiss FROM mp GROUP BY platform, variant_id)
SELECT platform, {RATES}, vmiss_mean, vmiss_sd, vmiss_median FROM sm JOIN (SELECT platform, {VMISS} FROM vm GROUP BY platform) USING (platform)""")
def cnc3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, samples = schema.calls(spark, sf_dir), schema.samples(spark, sf_dir)
    got = concordance.summarize(concordance.masked_confusion(calls, samples), concordance.masked_vmiss(calls, samples))
    return rounded(got, 8, ["vmiss_mean", "vmiss_sd", "vmiss_median"])


def _values(name: str, values: list) -> str:
    return f"(VALUES {', '.join(f'({v})' for v in values)}) {name}({name})"


def grid_sql(dp: list, gq: list, laf: list, haf: list) -> str:
    """Every threshold set applied to every distinct call pattern, for DuckDB."""
    hidden = "gt IS NULL OR coalesce(x.dp < p.dp, FALSE) OR coalesce(x.gq < p.gq, FALSE) OR coalesce(gt = 1 AND (af < p.laf OR af > p.haf), FALSE)"
    return f"""{PLATFORMS}, p AS (SELECT dp, gq, CAST(laf AS DOUBLE) AS laf, CAST(haf AS DOUBLE) AS haf FROM {_values('dp', dp)}, {_values('gq', gq)}, {_values('laf', laf)}, {_values('haf', haf)}),
    ct AS (SELECT platform, gt, gt_true, least(dp, {max(dp)}) AS dp, least(gq, {max(gq)}) AS gq, CASE WHEN gt = 1 THEN af END AS af, count(*) AS k FROM calls JOIN pl USING (sample_id) GROUP BY ALL),
    cf AS (SELECT platform, p.dp AS dp, p.gq AS gq, laf, haf, {NA.format('gt_true')} AS t, CASE WHEN {hidden} THEN 'NA' ELSE CAST(gt AS VARCHAR) END AS c, sum(k) AS n FROM ct x, p GROUP BY ALL),
    sm AS (SELECT platform, dp, gq, laf, haf, {SUMS} FROM cf GROUP BY platform, dp, gq, laf, haf),
    vt AS (SELECT platform, variant_id, gt, least(dp, {max(dp)}) AS dp, least(gq, {max(gq)}) AS gq, CASE WHEN gt = 1 THEN af END AS af, count(*) AS k FROM calls JOIN pl USING (sample_id) GROUP BY ALL),
    vm AS (SELECT platform, variant_id, p.dp AS dp, p.gq AS gq, laf, haf, round(sum(CASE WHEN {hidden} THEN k ELSE 0 END) / sum(k), 4) AS vmiss FROM vt x, p GROUP BY platform, variant_id, p.dp, p.gq, laf, haf),
    vs AS (SELECT platform, dp, gq, laf, haf, {VMISS} FROM vm GROUP BY platform, dp, gq, laf, haf),
    gs AS (SELECT platform, dp, gq, laf, haf, {RATES}, vmiss_mean, vmiss_sd, vmiss_median FROM sm JOIN vs USING (platform, dp, gq, laf, haf))"""


FULL = (schema.GRID_DP, schema.GRID_GQ, schema.GRID_LAF, schema.GRID_HAF)
SMALL = ([4, 8, 12, 16, 20], [10, 20], [0.0, 0.2, 0.25], [1.0, 0.8])


@query(f"{grid_sql(*SMALL)} SELECT * FROM gs")
def cnc4_grid_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarser grid than the full one, so that the plain SQL of every pattern against every set stays fast."""
    got = concordance.concordance_grid(schema.calls(spark, sf_dir), schema.samples(spark, sf_dir), *SMALL)
    return rounded(got, 8, ["vmiss_mean", "vmiss_sd", "vmiss_median"])


@query(f"{grid_sql(*FULL).split('vt AS (')[0].rstrip().rstrip(',')} SELECT platform, dp, gq, laf, haf, {RATES} FROM sm")
def cnc4_full_grid_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 3,240 threshold sets for three platforms."""
    keys = ["platform", *concordance.PARAMS]
    return concordance.confusion_grid(schema.calls(spark, sf_dir), schema.samples(spark, sf_dir), *FULL).groupBy(*keys).agg(*concordance.summary_columns())


@query()
def cnc4_full_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 3,240 threshold sets with the moments of missing rates; too many pairs for the plain SQL."""
    return rounded(concordance.concordance_grid(schema.kept_calls(spark, sf_dir), schema.samples(spark, sf_dir), *FULL), 8, ["vmiss_mean", "vmiss_sd", "vmiss_median"])


@query(f"{STATE_SQL} SELECT * FROM sd")
def cnc5_state_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detail(spark, sf_dir)


RELABEL = "CASE WHEN call_state LIKE 'LOW%' THEN 'EMPTY' WHEN truth_state = 'HOM_VAR1' AND call_state = 'HOM_REF' THEN 'FN' WHEN truth_state = 'HOM_REF' AND call_state = 'HOM_VAR1' THEN 'FP' ELSE contingency END"


@query(f"{STATE_SQL} SELECT sample_id, truth_state, call_state, n, {RELABEL} AS contingency FROM sd")
def cnc6_contingency_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.relabel(detail(spark, sf_dir))


def _weight(x: str) -> str:
    return f"CAST(sum(n * CASE WHEN contingency = '{x}' THEN 2 WHEN list_contains(string_split(contingency, ','), '{x}') THEN 1 ELSE 0 END) AS BIGINT) AS {x.lower()}"


@query(f"{STATE_SQL} {PLATFORM_SQL} SELECT platform, {', '.join(map(_weight, ('TN', 'FN', 'TP', 'FP')))} FROM pd GROUP BY platform")
def cnc7_allele_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.allele_confusion(concordance.detail_by_platform(concordance.relabel(detail(spark, sf_dir)), schema.samples(spark, sf_dir)))


_CODE = "CASE {0} WHEN 'HOM_REF' THEN '0' WHEN 'HET_REF_VAR1' THEN '1' WHEN 'HOM_VAR1' THEN '2' ELSE 'NA' END"


@query(f"""{STATE_SQL} {PLATFORM_SQL}, cf AS (SELECT platform, {_CODE.format('truth_state')} AS t, {_CODE.format('call_state')} AS c, n FROM pd), sm AS (SELECT platform, {SUMS} FROM cf GROUP BY platform), al AS (SELECT platform, total_with_all_na AS total_with_no_call, {RATES} FROM sm)
SELECT platform, total_with_no_call, total_genotype, concordance, concordance_with_empty, miss_rate, fp_rate, fn_rate, het_homvar_count, homref_homvar_count, homref_het_count, het_homvar_rate, homref_homvar_rate, homref_het_rate FROM al""")
def cnc8_state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.state_summary(concordance.detail_by_platform(detail(spark, sf_dir), schema.samples(spark, sf_dir)))


@query(f"{grid_sql(list(range(1, 31)), [10, 20, 30], [0.0], [1.0])} SELECT dp, gq, vmiss_mean, vmiss_median FROM vs WHERE platform = 'ALL'")
def cnc9_vmiss_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = concordance.vmiss_grid(schema.calls(spark, sf_dir), schema.samples(spark, sf_dir), list(range(1, 31)), [10, 20, 30], [0.0], [1.0])
    return rounded(got.where("platform = 'ALL'").select("dp", "gq", "vmiss_mean", "vmiss_median"))


def full_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion summary of all 3,240 threshold sets."""
    keys = ["platform", *concordance.PARAMS]
    return concordance.confusion_grid(schema.calls(spark, sf_dir), schema.samples(spark, sf_dir), *FULL).groupBy(*keys).agg(*concordance.summary_columns())


FULL_SQL = grid_sql(*FULL).split("vt AS (")[0].rstrip().rstrip(",") + f", gs AS (SELECT platform, dp, gq, laf, haf, {RATES} FROM sm)"


@query(f"{FULL_SQL} SELECT platform, gq, dp, concordance FROM gs WHERE laf = 0.25 AND haf = 0.75")
def cnc10_metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.metric_series(full_grid(spark, sf_dir), "concordance", 0.25, 0.75)


FRONT = """, pf AS (SELECT a.* FROM gs a WHERE concordance IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gs b WHERE b.platform = a.platform AND b.concordance >= a.concordance AND b.miss_rate <= a.miss_rate AND (b.concordance > a.concordance OR b.miss_rate < a.miss_rate)))"""


@query(f"{FULL_SQL} {FRONT} SELECT platform, dp, gq, laf, haf, concordance, miss_rate FROM pf")
def win1_pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = full_grid(spark, sf_dir).select("platform", *concordance.PARAMS, "concordance", "miss_rate")
    return selection.pareto_front(wanted, "concordance", "miss_rate", True, False, ["platform"])


def knee_sql(weights: list[float], front: str = "pf", y: str = "concordance") -> str:
    return f""", kw AS (SELECT DISTINCT platform, CAST(w AS DOUBLE) AS weight, miss_rate AS x, {y} AS y FROM {front}, {_values('w', weights)}),
    ks AS (SELECT *, (x - min(x) OVER g) / nullif(max(x) OVER g - min(x) OVER g, 0) AS xs, (y - min(y) OVER g) / nullif(max(y) OVER g - min(y) OVER g, 0) AS ys, 1.0 / nullif(count(*) OVER g - 1, 0) AS step FROM kw WINDOW g AS (PARTITION BY platform, weight)),
    kd AS (SELECT *, weight * ys - xs AS d FROM ks), kp AS (SELECT *, lag(d) OVER o AS pv, lead(d) OVER o AS nx FROM kd WINDOW o AS (PARTITION BY platform, weight ORDER BY xs)),
    km AS (SELECT *, CASE WHEN d >= pv AND d >= nx THEN xs END AS peak, CASE WHEN d >= pv AND d >= nx THEN d - step END AS lim FROM kp),
    kr AS (SELECT *, last_value(peak IGNORE NULLS) OVER o AS px, last_value(lim IGNORE NULLS) OVER o AS pl FROM km WINDOW o AS (PARTITION BY platform, weight ORDER BY xs ROWS UNBOUNDED PRECEDING)),
    kf AS (SELECT platform, weight, min(px) AS px FROM kr WHERE d < pl GROUP BY ALL), kn AS (SELECT k.platform, k.weight, x AS knee_x, y AS knee_y FROM kf JOIN kd k ON k.platform = kf.platform AND k.weight = kf.weight AND k.xs = kf.px)"""


@query(f"{FULL_SQL} {FRONT} {knee_sql([1.0])} SELECT platform, knee_x, knee_y FROM kn")
def win2_kneedle_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.kneedle(win1_pareto_front(spark, sf_dir), "miss_rate", "concordance", ["platform"])


#: The weights of the knee.
WEIGHTS = [1 / 10, 1 / 9, 1 / 8, 1 / 7, 1 / 6, 1 / 5, 1 / 4, 1 / 3, 1 / 2, 1.0, 2.0, 3.0]


@query(f"""{FULL_SQL} {FRONT} {knee_sql(WEIGHTS)} SELECT platform, weight, dp, gq, laf, haf, concordance, miss_rate FROM (SELECT *, row_number() OVER (PARTITION BY kn.platform, weight ORDER BY dp, gq, laf, haf) AS rn FROM kn JOIN pf ON pf.platform = kn.platform AND miss_rate = knee_x AND concordance = knee_y) WHERE rn = 1""".replace("SELECT *, row_number() OVER (PARTITION BY kn.platform", "SELECT kn.platform AS platform, weight, dp, gq, laf, haf, concordance, miss_rate, row_number() OVER (PARTITION BY kn.platform"))
def win3_recommend_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.recommend(full_grid(spark, sf_dir), "concordance", "miss_rate", WEIGHTS, ["platform"], concordance.PARAMS)


@query("SELECT chrom, pos, variant_id, row_number() OVER (ORDER BY CAST(substr(chrom, 4) AS INT), pos, variant_id) AS place FROM variants")
def win5_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in order of chromosome number; the place makes the order part of the result."""
    return _placed(schema.variants(spark, sf_dir))


@query("SELECT chrom, pos, variant_id, row_number() OVER (ORDER BY CAST(substr(chrom, 4) AS INT), pos, variant_id) AS place FROM variants")
def win5_sort_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for all variants."""
    return _placed(schema.variants(spark, sf_dir))


def _placed(v: DataFrame) -> DataFrame:
    return selection.placed(v.select("chrom", "pos", "variant_id"), [selection.by_number(F.col("chrom")), F.col("pos"), F.col("variant_id")])


@query("SELECT variant_id, mq FROM variants WHERE vqslod > 10")
def win6_sort_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.variants(spark, sf_dir).where("vqslod > 10").select("variant_id", "mq").orderBy(F.desc("mq"), "variant_id")


@query("SELECT chrom, vqslod, count(*) AS n, any_value(r) AS rank FROM (SELECT chrom, vqslod, rank() OVER (PARTITION BY chrom ORDER BY vqslod) + (count(*) OVER (PARTITION BY chrom, vqslod) - 1) / 2.0 AS r FROM variants) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY chrom, vqslod"))
def win7_rank_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callgrove.operators.stats import rank_avg

    return rank_avg(schema.variants(spark, sf_dir), "vqslod", ["chrom"])
