"""Queries of filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgrove import schema
from callgrove.functions import expr
from callgrove.operators import association, filters, linkage, stats
from callgrove.plans.registry import query
from callgrove.shared import sized

MASK = "gt IS NOT NULL AND NOT coalesce(dp < {dp}, FALSE) AND NOT coalesce(gq < {gq}, FALSE) AND NOT coalesce(gt = 1 AND (af < {laf} OR af > {haf}), FALSE)"


def masked_sql(dp: int = 8, gq: int = 20, laf: float = 0.0, haf: float = 1.0) -> str:
    return f"masked AS (SELECT variant_id, sample_id, CASE WHEN {MASK.format(dp=dp, gq=gq, laf=laf, haf=haf)} THEN gt END AS gt, gt_true FROM calls)"


#: Exact Hardy-Weinberg p of each distinct triple in table `triples`.
HWE_SQL = """
tr AS (SELECT *, hom_ref + het + hom_alt AS n, least(2 * hom_ref + het, 2 * hom_alt + het) AS rare FROM (SELECT DISTINCT hom_ref, het, hom_alt FROM counts) WHERE hom_ref + het + hom_alt > 0),
hs AS (SELECT *, unnest(range(rare % 2, rare + 1, 2)) AS h FROM tr),
lp AS (SELECT *, h * ln(2) - lgamma((rare - h) / 2 + 1) - lgamma(h + 1) - lgamma(n - (rare + h) / 2 + 1) AS l FROM hs),
ob AS (SELECT *, max(l) OVER w AS top, max(CASE WHEN h = het THEN l END) OVER w AS own FROM lp WINDOW w AS (PARTITION BY hom_ref, het, hom_alt)),
hw AS (SELECT hom_ref, het, hom_alt, least(1.0, sum(CASE WHEN l <= own + 1e-9 THEN exp(l - top) ELSE 0 END) / sum(exp(l - top))) AS p FROM ob GROUP BY ALL)
"""
#: Zero where no genotype is called; DuckDB's count_if gives NULL over NULLs alone.
COUNTS = "CAST(coalesce(count_if(gt = 0), 0) AS BIGINT) AS hom_ref, CAST(coalesce(count_if(gt = 1), 0) AS BIGINT) AS het, CAST(coalesce(count_if(gt = 2), 0) AS BIGINT) AS hom_alt"
TALLY = "SELECT variant_id, count(*) AS n, count(gt) AS called FROM {} GROUP BY variant_id"


def tally(calls: DataFrame) -> DataFrame:
    return calls.groupBy("variant_id").agg(F.count("*").alias("n"), F.count("gt").alias("called"))


@query("SELECT variant_id, filter FROM variants WHERE filter = 'PASS'")
def flt1_filter_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_pass(schema.variants(spark, sf_dir)).select("variant_id", "filter")


@query(", k AS (SELECT * FROM calls WHERE variant_id IN (SELECT variant_id FROM calls GROUP BY 1 HAVING sum(gt) >= 10)) " + TALLY.format("k"))
def flt2_min_nonref_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(filters.min_ac(schema.calls(spark, sf_dir), 10))


@query("SELECT variant_id, vqslod, mq FROM variants WHERE vqslod > 10 AND mq > 58.75")
def flt3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.site_filter(schema.variants(spark, sf_dir)).select("variant_id", "vqslod", "mq")


@query(f", {masked_sql()} SELECT variant_id, sample_id, gt FROM masked")
def flt4_genotype_nocall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.mask_calls(schema.calls(spark, sf_dir)).select("variant_id", "sample_id", "gt")


@query(f", {masked_sql(laf=0.25, haf=0.75)} SELECT variant_id, sample_id, gt FROM masked")
def flt5_allele_balance_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.mask_calls(schema.calls(spark, sf_dir), laf=0.25, haf=0.75).select("variant_id", "sample_id", "gt")


@query(", k AS (SELECT * FROM calls WHERE sample_id IN (SELECT sample_id FROM calls GROUP BY 1 HAVING avg(CASE WHEN gt IS NULL THEN 1.0 ELSE 0 END) <= 0.14)) " + TALLY.format("k"))
def flt6_sample_missing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(filters.mind(schema.calls(spark, sf_dir), 0.14))


@query(", k AS (SELECT * FROM calls WHERE variant_id IN (SELECT variant_id FROM calls GROUP BY 1 HAVING avg(CASE WHEN gt IS NULL THEN 1.0 ELSE 0 END) <= 0.1)) " + TALLY.format("k"))
def flt7_variant_missing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(filters.geno(schema.calls(spark, sf_dir), 0.1))


@query(", k AS (SELECT * FROM calls WHERE variant_id IN (SELECT variant_id FROM freq WHERE least(alt_freq, 1 - alt_freq) >= 0.3)) " + TALLY.format("k"))
def flt8_maf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(filters.maf_filter(schema.calls(spark, sf_dir), 0.3))


@query(f", counts AS (SELECT variant_id, {COUNTS} FROM calls GROUP BY 1), {HWE_SQL}, k AS (SELECT * FROM calls WHERE variant_id IN (SELECT variant_id FROM counts JOIN hw USING (hom_ref, het, hom_alt) WHERE p >= 1e-3)) " + TALLY.format("k"))
def flt9_hwe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(filters.hwe_filter(schema.calls(spark, sf_dir), 1e-3))


def case_control_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variant_id, p_case, p_control and maf, from one aggregation by group."""
    calls = schema.calls(spark, sf_dir).join(sized(schema.samples(spark, sf_dir).select("sample_id", "pheno")), "sample_id")
    p = stats.hwe_exact(stats.geno_counts(calls, "pheno"))
    wide = p.groupBy("variant_id").agg(F.max(F.when(F.col("pheno") == 2, F.col("p"))).alias("p_case"), F.max(F.when(F.col("pheno") == 1, F.col("p"))).alias("p_control"))
    return stats.allele_freq(calls).select("variant_id", expr.maf(F.col("alt_freq")).alias("maf")).join(wide, "variant_id", "left")


CASE_CONTROL = f""", counts AS (SELECT variant_id, pheno, {COUNTS} FROM calls JOIN samples USING (sample_id) GROUP BY ALL), {HWE_SQL},
cc AS (SELECT variant_id, max(CASE WHEN pheno = 2 THEN p END) AS p_case, max(CASE WHEN pheno = 1 THEN p END) AS p_control FROM counts LEFT JOIN hw USING (hom_ref, het, hom_alt) GROUP BY 1),
cp AS (SELECT variant_id, least(alt_freq, 1 - alt_freq) AS maf, p_case, p_control FROM freq JOIN cc USING (variant_id))"""


@query(f"{CASE_CONTROL} SELECT variant_id FROM cp WHERE p_control >= 0.05 AND p_case >= 0.01")
def flt10_hwe_mode_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.pass_hwe(case_control_p(spark, sf_dir), "case_control", 0.05, 0.01).select("variant_id")


def freq_vmiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = schema.calls(spark, sf_dir)
    freq = stats.allele_freq(calls).dropna(subset=["alt_freq"]).select("variant_id", expr.maf(F.col("alt_freq")).alias("maf"))
    return freq.join(stats.variant_missing(calls), "variant_id")


FREQ_VMISS = ", fv AS (SELECT variant_id, least(alt_freq, 1 - alt_freq) AS maf, f_miss FROM freq JOIN (SELECT variant_id, avg(CASE WHEN gt IS NULL THEN 1.0 ELSE 0 END) AS f_miss FROM calls GROUP BY 1) USING (variant_id) WHERE alt_freq IS NOT NULL)"


@query(f"{FREQ_VMISS} SELECT variant_id FROM fv WHERE maf > 0 AND f_miss < 0.12")
def flt11_polymorphic_vmiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.polymorphic(freq_vmiss(spark, sf_dir), 0.12).select("variant_id")


@query("SELECT variant_id FROM freq WHERE least(alt_freq, 1 - alt_freq) = 0")
def flt12_monomorphic_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.monomorphic(stats.allele_freq(schema.calls(spark, sf_dir)))


@query("SELECT variant_id FROM (SELECT variant_id, sum(gt) / nullif(2.0 * count(gt), 0) AS f FROM calls JOIN samples USING (sample_id) WHERE pheno = 1 GROUP BY 1) WHERE least(f, 1 - f) >= 0.2")
def flt13_not_rare_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    controls = filters.by_pheno(schema.calls(spark, sf_dir), schema.samples(spark, sf_dir), 1)
    return filters.not_rare(stats.allele_freq(controls), 0.2)


@query("SELECT variant_id, ref, alt FROM variants WHERE variant_id % 5 <> 0")
def flt14_snps_only_acgt(spark: SparkSession, sf_dir: str) -> DataFrame:
    longer = schema.variants(spark, sf_dir).withColumn("alt", F.when(F.col("variant_id") % 5 == 0, F.concat("alt", F.lit("A"))).otherwise(F.col("alt")))
    return filters.snps_only(longer).select("variant_id", "ref", "alt")


@query("SELECT CASE WHEN CAST(substr(chrom, 4) AS INT) <= 22 THEN 'autosome' ELSE 'sex' END AS chrom_class, count(*) AS n FROM variants GROUP BY 1")
def flt15_chrom_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.variants(spark, sf_dir).groupBy(filters.chrom_class(F.col("chrom")).alias("chrom_class")).agg(F.count("*").alias("n"))


@query("SELECT variant_id, chrom, pos FROM variants WHERE (chrom, pos) IN (SELECT chrom, pos FROM variants WHERE variant_id % 9 = 0)")
def flt16_region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = schema.variants(spark, sf_dir)
    return filters.at_positions(v, v.where("variant_id % 9 = 0")).select("variant_id", "chrom", "pos")


@query("SELECT sample_id, s_acctbal / 400000.0 AS pc1, s_nationkey / 800.0 - 0.02 AS pc2 FROM samples JOIN supplier ON s_suppkey = sample_id WHERE s_acctbal / 400000.0 BETWEEN -0.025 AND 0.016 AND s_nationkey / 800.0 - 0.02 BETWEEN -0.025 AND 0.025 AND (starts_with(iid, 'PHOM') OR starts_with(iid, 'AG'))")
def flt17_rectangle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("sample_id"), (F.col("s_acctbal") / 400000.0).alias("pc1"), (F.col("s_nationkey") / 800.0 - 0.02).alias("pc2"))
    labelled = s.join(schema.samples(spark, sf_dir).select("sample_id", expr.label_prefix(F.col("iid"), [("PHOM", "CTEPH"), ("AG", "AGP3K")]).alias("label")), "sample_id")
    return filters.in_rect(labelled, ["CTEPH", "AGP3K"]).drop("label")


@query(", k AS (SELECT * FROM calls WHERE sample_id IN (SELECT sample_id FROM samples WHERE pheno = 2)) " + TALLY.format("k"))
def flt18_keep_if_pheno(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(filters.by_pheno(schema.calls(spark, sf_dir), schema.samples(spark, sf_dir), 2))


@query("SELECT iid, starts_with(iid, 'PHOM') AS is_case FROM samples")
def flt19_prefix_sample_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema.samples(spark, sf_dir).select("iid")
    return filters.with_prefix(s, "iid", "PHOM").withColumn("is_case", F.lit(True)).unionByName(filters.with_prefix(s, "iid", "PHOM", False).withColumn("is_case", F.lit(False)))


@query("SELECT sample_id, target_depth FROM samples WHERE target_depth IS NOT NULL AND sex IS NOT NULL")
def flt20_notna_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.samples(spark, sf_dir).dropna(subset=["target_depth", "sex"]).select("sample_id", "target_depth")


AF_DIFF = ", df AS (SELECT variant_id, alt_freq - panel_af AS diff FROM freq JOIN panel_af USING (variant_id))"


@query(f"{AF_DIFF} SELECT variant_id FROM df, (SELECT quantile_cont(round(diff, 9), 0.025) AS lo, quantile_cont(round(diff, 9), 0.975) AS hi FROM df) WHERE round(diff, 9) BETWEEN lo AND hi")
def flt21_central_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stats.allele_freq(schema.calls(spark, sf_dir)).join(schema.panel_af(spark, sf_dir), "variant_id")
    return filters.central(own.select("variant_id", F.round(F.col("alt_freq") - F.col("panel_af"), 9).alias("diff")), "diff").select("variant_id")


@query("SELECT variant_id FROM variants ORDER BY 1 LIMIT 100")
def flt22_max_rows_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.first_ids(schema.variants(spark, sf_dir), 100)


def af_hwe_steps(df: DataFrame, maf: float = 0.01, p: float = 1e-6) -> DataFrame:
    """How many rows each strict cut leaves and drops."""
    a, b = F.coalesce(F.col("maf") > maf, F.lit(False)), F.coalesce(F.col("p") > p, F.lit(False))
    return df.agg(F.count("*").alias("total"), F.count_if(a).alias("after_maf"), F.count_if(~a).alias("dropped_maf"), F.count_if(a & b).alias("after_hwe"), F.count_if(a & ~b).alias("dropped_hwe"))


@query(f"""{CASE_CONTROL} SELECT count(*) AS total, count_if(coalesce(maf > 0.2, FALSE)) AS after_maf, count_if(NOT coalesce(maf > 0.2, FALSE)) AS dropped_maf,
count_if(coalesce(maf > 0.2, FALSE) AND coalesce(p_control > 0.05, FALSE)) AS after_hwe, count_if(coalesce(maf > 0.2, FALSE) AND NOT coalesce(p_control > 0.05, FALSE)) AS dropped_hwe FROM cp""")
def flt23_frequency_hwe_strict_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return af_hwe_steps(case_control_p(spark, sf_dir).withColumn("p", F.col("p_control")), 0.2, 0.05)


@query("SELECT grp, count(*) AS n, count(DISTINCT sample_id) AS samples FROM (SELECT 'ALL' AS grp, sample_id FROM calls UNION ALL SELECT upper(target_depth), sample_id FROM calls JOIN samples USING (sample_id) WHERE target_depth IS NOT NULL) GROUP BY grp")
def flt24_depth_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, samples = schema.calls(spark, sf_dir), schema.samples(spark, sf_dir)
    groups = [filters.by_depth(calls, samples, g).agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("samples")).select(F.lit(g).alias("grp"), "n", "samples") for g in ("ALL", "15X", "30X")]
    return filters.concat(groups)


def het_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = schema.calls(spark, sf_dir)
    return stats.het_f(calls).join(stats.sample_missing(calls), "sample_id")


HET_MISS = """, ef AS (SELECT variant_id, 1 - 2 * alt_freq * (1 - alt_freq) AS e FROM freq WHERE alt_freq IS NOT NULL),
hm AS (SELECT sample_id, (count_if(gt <> 1) - sum(e)) / nullif(count(*) - sum(e), 0) AS f FROM calls JOIN ef USING (variant_id) WHERE gt IS NOT NULL GROUP BY 1),
ms AS (SELECT sample_id, avg(CASE WHEN gt IS NULL THEN 1.0 ELSE 0 END) AS f_miss FROM calls GROUP BY 1)"""


@query(f"{HET_MISS} SELECT sample_id, round(f, 8) AS f, round(f_miss, 9) AS f_miss FROM hm JOIN ms USING (sample_id)")
def jon1_het_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return het_miss(spark, sf_dir).select("sample_id", F.round("f", 8).alias("f"), F.round("f_miss", 9).alias("f_miss"))


@query(f"{FREQ_VMISS} SELECT variant_id, maf, round(f_miss, 9) AS f_miss FROM fv")
def jon2_freq_vmiss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freq_vmiss(spark, sf_dir).withColumn("f_miss", F.round("f_miss", 9))


@query(f"{CASE_CONTROL} SELECT variant_id, maf, round(p_case, 8) AS p_case, round(p_control, 8) AS p_control FROM cp")
def jon3_freq_hwe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_control_p(spark, sf_dir).withColumns({c: F.round(c, 8) for c in ("p_case", "p_control")})


@query("SELECT variant_id, alt_freq, panel_af FROM freq LEFT JOIN panel_af USING (variant_id)")
def jon4_external_af(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.allele_freq(schema.calls(spark, sf_dir)).join(schema.panel_af(spark, sf_dir).drop("filter"), "variant_id", "left").select("variant_id", "alt_freq", "panel_af")


def some_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean depth and quality of each called sample, in the place of component scores."""
    return schema.calls(spark, sf_dir).where("sample_id % 7 <> 0").groupBy("sample_id").agg((F.sum("dp") / F.count("*")).alias("pc1_avg"), (F.sum("gq") / F.count("*")).alias("pc2_avg"))


SCORES = ", sc AS (SELECT sample_id, sum(dp) / count(*) AS pc1_avg, sum(gq) / count(*) AS pc2_avg FROM calls WHERE sample_id % 7 <> 0 GROUP BY 1)"


@query(f"{SCORES} SELECT sample_id, sex, pc1_avg, pc2_avg FROM samples LEFT JOIN sc USING (sample_id)")
def jon5_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.covariates(schema.samples(spark, sf_dir), some_scores(spark, sf_dir))


@query(", k AS (SELECT * FROM calls WHERE variant_id IN (SELECT variant_id FROM variants WHERE filter = 'PASS')) " + TALLY.format("k"))
def jon6_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(filters.keep(schema.calls(spark, sf_dir), filters.filter_pass(schema.variants(spark, sf_dir)), "variant_id"))


@query(", k AS (SELECT * FROM calls WHERE variant_id NOT IN (SELECT variant_id FROM variants WHERE filter = 'PASS')) " + TALLY.format("k"))
def jon7_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally(filters.exclude(schema.calls(spark, sf_dir), filters.filter_pass(schema.variants(spark, sf_dir)), "variant_id"))


@query("SELECT variant_id FROM variants v WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.chrom = v.chrom AND v.pos BETWEEN r.start AND r.stop)")
def jon8_exclude_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.exclude_ranges(schema.variants(spark, sf_dir), schema.regions(spark)).select("variant_id")


@query("SELECT variant_id, sample_id, gt, gt_true FROM calls WHERE (variant_id + sample_id) % 10 <> 0")
def jon9_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = schema.calls(spark, sf_dir)
    truth = c.where((F.col("variant_id") + F.col("sample_id")) % 10 != 0).select("variant_id", "sample_id", "gt_true")
    return filters.align(c.select("variant_id", "sample_id", "gt"), truth)


CHIPS = ", ca AS (SELECT * FROM calls WHERE sample_id % 2 = 0 AND variant_id % 13 <> 0), cb AS (SELECT * FROM calls WHERE sample_id % 2 = 1 AND variant_id % 17 <> 0)"


@query(f"{CHIPS} SELECT variant_id, sample_id, gt FROM (SELECT * FROM ca UNION ALL SELECT * FROM cb) WHERE variant_id IN (SELECT variant_id FROM ca INTERSECT SELECT variant_id FROM cb)")
def jon10_merge_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = schema.kept_calls(spark, sf_dir)
    return filters.merge_sets(schema.chip(spark, sf_dir, 0, own), schema.chip(spark, sf_dir, 1, own))


@query("SELECT variant_id FROM variants WHERE (chrom, pos) IN (SELECT chrom, pos FROM variants GROUP BY ALL HAVING count(*) > 1)")
def jon11_same_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.same_position_ids(schema.variants(spark, sf_dir))


@query("SELECT a.sample_id AS id1, b.sample_id AS id2, count_if(abs(a.gt - b.gt) = 2) AS n0, count_if(abs(a.gt - b.gt) = 1) AS n1, count_if(a.gt = b.gt) AS n2 FROM calls a JOIN calls b ON a.variant_id = b.variant_id AND a.sample_id < b.sample_id WHERE a.gt IS NOT NULL AND b.gt IS NOT NULL GROUP BY ALL")
def jon12_sample_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callgrove.operators.kinship import sample_pairs

    return sample_pairs(schema.calls(spark, sf_dir))


@query("SELECT chrom, a.n AS n, round(b.m, 9) AS mean_mq FROM (SELECT chrom, count(*) AS n FROM variants GROUP BY 1) a JOIN (SELECT chrom, avg(mq) AS m FROM variants WHERE filter = 'PASS' GROUP BY 1) b USING (chrom)")
def jon13_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = schema.variants(spark, sf_dir)
    return v.groupBy("chrom").agg(F.count("*").alias("n")).join(v.where("filter = 'PASS'").groupBy("chrom").agg(F.round(F.avg("mq"), 9).alias("mean_mq")), "chrom")


@query("SELECT g.dp AS dp, g.gq AS gq, count_if(c.dp >= g.dp AND c.gq >= g.gq) AS n FROM (SELECT dp, gq FROM range(1, 31) a(dp), (VALUES (10), (20), (30)) b(gq)) g CROSS JOIN (SELECT dp, gq FROM calls) c GROUP BY ALL")
def jon14_param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that pass each (DP, GQ), from a histogram that meets the grid."""
    hist = schema.calls(spark, sf_dir).groupBy(F.least("dp", F.lit(30)).alias("d"), F.least(F.floor(F.col("gq") / 10), F.lit(3)).alias("g")).agg(F.count("*").alias("k"))
    grid = spark.range(1, 31).select(F.col("id").cast("int").alias("dp")).crossJoin(spark.createDataFrame([(10,), (20,), (30,)], "gq int"))
    met = grid.crossJoin(F.broadcast(hist))  # at most 150 cells
    return met.groupBy("dp", "gq").agg(F.sum(F.when((F.col("d") >= F.col("dp")) & (F.col("g") * 10 >= F.col("gq")), F.col("k")).otherwise(0)).alias("n"))


@query("SELECT iid, target_depth FROM samples")
def jon15_registry_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema.samples(spark, sf_dir)
    return s.select("iid").join(s.select("iid", "target_depth"), "iid")


@query(", ix AS (SELECT chrom, variant_id, row_number() OVER (PARTITION BY chrom ORDER BY pos, variant_id) AS i FROM variants) SELECT a.variant_id AS v1, b.variant_id AS v2 FROM ix a JOIN ix b ON a.chrom = b.chrom AND b.i > a.i AND b.i - a.i < 50")
def jon16_ld_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.ld_neighbours(schema.variants(spark, sf_dir), 50)


@query(f"{CHIPS} SELECT variant_id FROM ca INTERSECT SELECT variant_id FROM cb")
def set1_intersect_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.shared_ids(schema.chip(spark, sf_dir, 0), schema.chip(spark, sf_dir, 1), "variant_id")


#: Pairs of a sample and the next one of its phenotype by number.
_PAIRS = "SELECT id1, id2 FROM (SELECT sample_id AS id1, lead(sample_id) OVER (PARTITION BY pheno, sex ORDER BY sample_id) AS id2 FROM samples) WHERE id2 IS NOT NULL"


@query(f"SELECT id1 AS id FROM ({_PAIRS}) UNION SELECT id2 FROM ({_PAIRS})")
def set2_pair_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = F.lead("sample_id").over(Window.partitionBy("pheno", "sex").orderBy("sample_id"))
    return filters.pair_nodes(schema.samples(spark, sf_dir).select(F.col("sample_id").alias("id1"), following.alias("id2")).where("id2 IS NOT NULL"))


@query("SELECT sample_id AS id FROM samples EXCEPT SELECT sample_id FROM samples WHERE pheno = 2")
def set3_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema.samples(spark, sf_dir)
    return filters.remaining(s.select(F.col("sample_id").alias("id")), s.where("pheno = 2").select(F.col("sample_id").alias("id")))


@query(f"{CHIPS} SELECT variant_id, sample_id, gt FROM ca UNION ALL SELECT variant_id, sample_id, gt FROM cb")
def set4_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.concat([schema.chip(spark, sf_dir, k).select("variant_id", "sample_id", "gt") for k in (0, 1)])


@query("SELECT DISTINCT chrom, ref, alt FROM variants")
def set5_distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.variants(spark, sf_dir).select("chrom", "ref", "alt").dropDuplicates()


@query("SELECT variant_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY pos) AS n FROM variants) WHERE n > 1")
def set6_all_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.all_duplicates(schema.variants(spark, sf_dir).select("variant_id", "pos"), "pos")
