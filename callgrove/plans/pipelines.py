"""Named compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrove.functions import expr, reference
from callgrove.operators import association, concordance, filters, kinship, linalg, linkage, selection, stats
from callgrove.shared import sized, written


def normalised_calls(calls: DataFrame) -> DataFrame:
    """calls with gt from a genotype string gt_text (unphased), and af from read counts ad (no NaN), where they have these columns."""
    if "gt_text" in calls.columns:
        calls = calls.withColumn("gt", expr.dosage(expr.unphase(F.col("gt_text")))).drop("gt_text")
    if "ad" in calls.columns:
        calls = calls.withColumn("af", expr.clean_num(expr.allele_fraction(F.col("ad")).cast("string"))).drop("ad")
    return calls


def wgs_select(calls: DataFrame, variants: DataFrame, samples: DataFrame, miss: float = 0.05, het: str = "5sd", vqslod: float = 10, mq: float = 58.75, dp: int = 8, gq: int = 20, least: int = 1) -> DataFrame:
    """Calls after site, sample and genotype filters: PASS, varying, samples inside the bounds, good sites, masked calls, varying again."""
    passed = written(filters.min_ac(filters.keep(normalised_calls(calls), filters.filter_pass(variants), "variant_id"), least), "passed")
    fine = sample_qc(passed, miss, het).where("outlier = 'pass'").select("sample_id")
    kept = filters.keep(filters.keep(passed, fine, "sample_id"), filters.site_filter(variants, vqslod, mq), "variant_id")
    ids = expr.set_id(variants).select("variant_id", "id")
    return filters.min_ac(written(filters.mask_calls(kept, dp, gq), "masked"), least).join(ids, "variant_id")


def sample_qc(calls: DataFrame, miss: float = 0.05, het: str = "5sd") -> DataFrame:
    """sample_id, f, f_miss and outlier class."""
    return stats.outlier_classes(stats.het_f(calls).select("sample_id", "f").join(stats.sample_missing(calls), "sample_id"), miss, het)


def variant_qc(calls: DataFrame, samples: DataFrame, vmiss: float = 0.04) -> DataFrame:
    """variant_id, maf among controls, f_miss, and keeps: variants that vary among controls with few missing calls."""
    freq = stats.allele_freq(filters.by_pheno(calls, samples, 1)).dropna(subset=["alt_freq"]).select("variant_id", expr.maf(F.col("alt_freq")).alias("maf"))
    return freq.join(stats.variant_missing(calls), "variant_id").withColumn("keeps", (F.col("maf") > 0) & (F.col("f_miss") < vmiss))


def variant_qc_ratio(calls: DataFrame, samples: DataFrame, vmiss: float = 0.04, maf: float = 0.01) -> DataFrame:
    """How many variants of low and high frequency, and of all, have few missing calls."""
    return stats.pass_ratio(variant_qc(calls, samples, vmiss), maf, vmiss)


def group_p(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """variant_id, maf, p_case and p_control of all variants; both groups come from one aggregation."""
    grouped = calls.join(sized(samples.select("sample_id", "pheno")), "sample_id")
    p = stats.hwe_exact(stats.geno_counts(grouped, "pheno"))
    wide = p.groupBy("variant_id").agg(F.max(F.when(F.col("pheno") == 2, F.col("p"))).alias("p_case"), F.max(F.when(F.col("pheno") == 1, F.col("p"))).alias("p_control"))
    return stats.allele_freq(calls).select("variant_id", expr.maf(F.col("alt_freq")).alias("maf")).join(wide, "variant_id", "left")


def hwe_quadrants(calls: DataFrame, samples: DataFrame, control: float = 1e-6, case: float = 1e-10, maf: float = 0.01) -> DataFrame:
    """Counts of variants that pass among controls, cases, both and none, by class of frequency."""
    return stats.quadrants(group_p(calls, samples), control, case, maf)


def hwe_check(calls: DataFrame, samples: DataFrame, mode: str = "case_control", control: float = 1e-6, case: float = 1e-10) -> DataFrame:
    """variant_id, maf, p_case and p_control of the variants that pass."""
    return filters.pass_hwe(group_p(calls, samples), mode, control, case)


def pca_variants(calls: DataFrame, variants: DataFrame, regions: DataFrame, maf: float = 0.01, window: int = 50, r2: float = 0.2) -> DataFrame:
    """Frequent single-letter variants outside the intervals, pruned for linkage."""
    sites = filters.exclude_ranges(filters.snps_only(filters.keep(variants, filters.maf_filter(calls, maf).select("variant_id").distinct(), "variant_id")), regions)
    sites = written(sites, "pca-sites")
    return linkage.ld_prune(filters.keep(calls, sites, "variant_id"), sites, window, r2)


def pca_run(calls: DataFrame, variants: DataFrame, regions: DataFrame, hwe_ids: DataFrame, maf: float = 0.01, k: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    ids = pca_variants(filters.keep(calls, hwe_ids, "variant_id"), filters.keep(variants, hwe_ids, "variant_id"), regions, maf)
    return linalg.pca(filters.keep(calls, ids, "variant_id"), k, method="auto")


def reference_prepare(calls: DataFrame, variants: DataFrame, refseq: DataFrame, mapping: DataFrame, maf: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """A reference cohort brought into form: frequent variants, own chromosome names, alleles by the reference sequence, new ids."""
    kept = filters.maf_filter(calls, maf)
    sites = filters.keep(variants, kept.select("variant_id").distinct(), "variant_id")
    fixed, turned = reference.fix_ref(sites, kept, refseq)
    aligned = reference.left_align(fixed.drop("swapped"), refseq)
    return expr.set_id(expr.rename_chrom(aligned, mapping)), turned


def reference_projection(calls: DataFrame, ref_calls: DataFrame, variants: DataFrame, regions: DataFrame, labels: DataFrame, groups: list[str], xlim=(-0.025, 0.016), ylim=(-0.025, 0.025), k: int = 10, prefix: str = "") -> DataFrame:
    """Samples whose scores on the reference cohort's components lie in the rectangle; weights and frequencies are the reference's.

    A prefix keeps the ids of the reference's samples apart from the others.
    """
    ref_calls = ref_calls.withColumn("sample_id", F.concat(F.lit(prefix), F.col("sample_id").cast("string"))) if prefix else ref_calls
    shared = filters.shared_ids(calls, ref_calls, "variant_id")
    ids = pca_variants(filters.keep(ref_calls, shared, "variant_id"), variants, regions)
    of_ref = filters.keep(ref_calls, ids, "variant_id")
    _, _, weights = linalg.pca(of_ref, k, method="approximate")
    scores = linalg.project(filters.keep(calls, ids, "variant_id"), weights, stats.allele_freq(of_ref), k)
    placed = scores.withColumnsRenamed({"pc1_avg": "pc1", "pc2_avg": "pc2"}).join(labels, "sample_id")
    return filters.in_rect(placed, groups, xlim, ylim)


def related_pairs(calls: DataFrame, samples: DataFrame, above: float = 0.2) -> DataFrame:
    """id1, id2, pi_hat (rounded) and pair_type of the pairs above the bound."""
    pairs = expr.round_filter(kinship.pi_hat(calls, above=above).select("id1", "id2", "pi_hat"), "pi_hat", above)
    one, two = (samples.select(F.col("sample_id").alias(f"id{k}"), F.col("pheno").alias(f"pheno{k}")) for k in (1, 2))
    typed = pairs.join(sized(one), "id1", "left").join(sized(two), "id2", "left")
    return typed.select("id1", "id2", "pi_hat", expr.pair_type(F.col("pheno1"), F.col("pheno2")).alias("pair_type"))


def kinship_remove(calls: DataFrame, samples: DataFrame, kept: DataFrame, variants: DataFrame, above: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Samples to remove, and the typed pairs above the bound that this covers at small weight."""
    own = written(filters.keep(filters.keep(calls, kept, "sample_id"), variants, "variant_id"), "own-calls")
    pairs = written(related_pairs(own, samples, above), "related")
    nodes = samples.select("sample_id", (F.col("pheno") == 2).alias("is_case")).join(stats.sample_missing(own), "sample_id").withColumnRenamed("sample_id", "id")
    return kinship.relative_removal(pairs.select("id1", "id2"), nodes), pairs


def normalise(calls: DataFrame, variants: DataFrame, refseq: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and variants with the reference's names of chromosomes, one row for each alternate allele (where calls have alts and
    alleles), the reference letter as ref, and alleles trimmed and aligned to the left."""
    if {"alts", "alleles"} <= set(calls.columns):
        calls = expr.split_multiallelic(calls)
    fixed, turned = reference.fix_ref(expr.rename_chrom(variants, mapping), calls, refseq)
    return turned, reference.left_align(fixed.drop("swapped"), refseq)


def array_truth(chip_a: DataFrame, chip_b: DataFrame, variants: DataFrame, panel: DataFrame, mind: float = 0.01, geno: float = 0.01, maf: float = 0.01, hwe: float = 1e-6, share: float = 0.95, refseq: DataFrame | None = None, mapping: DataFrame | None = None) -> DataFrame:
    """Variants of two merged arrays that pass all filters and whose frequency is near the panel's.

    Cleaned arrays and the merged one are written, because each is gone through more than once.
    """
    sites = written(filters.by_chrom_class(filters.exclude(variants, filters.same_position_ids(variants), "variant_id"), "autosome"), "sites")
    a, b = (written(filters.keep(filters.geno(filters.mind(x, mind), geno), sites, "variant_id").select("variant_id", "sample_id", "gt"), "array") for x in (chip_a, chip_b))
    merged = filters.merge_sets(a, b)
    if refseq is not None:
        merged = normalise(merged, sites, refseq, mapping)[0]
    merged = written(merged, "merged")
    p = stats.hwe_exact(stats.geno_counts(merged)).select("variant_id", "p")
    freq = stats.allele_freq(merged).withColumn("maf", expr.maf(F.col("alt_freq"))).join(p, "variant_id")
    near = freq.where((F.col("maf") > maf) & (F.col("p") > hwe)).join(panel.select("variant_id", "panel_af"), "variant_id")
    return filters.central(near.withColumn("diff", F.round(F.col("alt_freq") - F.col("panel_af"), 9)), "diff", share)


def tune(calls: DataFrame, truth: DataFrame, samples: DataFrame, grid: tuple[list, list, list, list], weights: list[float]) -> DataFrame:
    """Recommended thresholds for concordance, false positives and false negatives against the missing rate."""
    own, true = calls.drop("gt_true"), truth.select("variant_id", "sample_id", "gt_true")
    # rows of the same variant and sample are of variants and samples that both sets have
    aligned = filters.align(own, true)
    keys = ["platform", *concordance.PARAMS]
    summary = written(concordance.confusion_grid(aligned, samples, *grid).groupBy(*keys).agg(*concordance.summary_columns()), "summary")
    goals = [("concordance", True), ("fp_rate", False), ("fn_rate", False)]
    parts = [selection.recommend(summary, m, "miss_rate", weights, ["platform"], concordance.PARAMS, best).select(F.lit(m).alias("goal"), "platform", "weight", *concordance.PARAMS, F.col(m).alias("value"), "miss_rate") for m, best in goals]
    return filters.concat(parts)


def parameter_scan(calls: DataFrame, variants: DataFrame, samples: DataFrame) -> DataFrame:
    """Sites reached by depth and quality thresholds, and shares of sites above the site bounds, in one long table."""
    sweeps = [stats.threshold_sweep(calls, samples, f, low, high).select(F.lit(f).alias("field"), "grp", "threshold", "sites") for f, low, high in (("dp", 1, 30), ("gq", 11, 30))]
    shares = [stats.share_above(variants, f, t).select(F.lit(f).alias("field"), F.lit("ALL").alias("grp"), F.lit(int(t)).alias("threshold"), F.col("above").alias("sites")) for f, t in (("mq", 58.75), ("vqslod", 10.0))]
    return filters.concat([*sweeps, *shares])


def parameter_histograms(calls: DataFrame, variants: DataFrame, bins: int = 50) -> DataFrame:
    """Counts of the values of depth and genotype quality, and of equal bins of the sites' figures, in one long table."""
    values = [stats.value_counts(calls, f).select(F.lit(f).alias("field"), F.col(f).alias("value"), "n") for f in ("dp", "gq")]
    binned = [stats.histogram(variants, f, bins).select(F.lit(f).alias("field"), F.col("bin").alias("value"), "n") for f in ("mq", "vqslod")]
    return filters.concat([*values, *binned])


def frequency_split(calls: DataFrame, samples: DataFrame, rare: float = 0.01) -> DataFrame:
    """Genotype counts by phenotype of the variants that vary, with their class by control frequency."""
    freq = stats.allele_freq(calls)
    varying = filters.exclude(calls, filters.monomorphic(freq), "variant_id")
    common = filters.not_rare(stats.allele_freq(filters.by_pheno(varying, samples, 1)), rare).withColumn("common", F.lit(True))
    counts = stats.geno_counts(varying.join(sized(samples.select("sample_id", "pheno")), "sample_id"), "pheno")
    return counts.join(common, "variant_id", "left").withColumn("common", F.coalesce("common", F.lit(False)))


def run_association(calls: DataFrame, samples: DataFrame, kept: DataFrame, removed: DataFrame, scores: DataFrame, variants: DataFrame, lead: float = 5e-8) -> DataFrame:
    _, pheno, covars = association.assemble(samples, kept, removed, scores)
    pcs = [c for c in scores.columns if c.startswith("pc")]
    results = association.logistic_scan(calls, pheno.select("sample_id", "pheno"), covars.dropna(), ["sex", *pcs])
    return association.assoc_view(results, variants, lead)


def sample_registry(samples: DataFrame, ids: DataFrame) -> DataFrame:
    """Listed samples with metadata, split into cases and controls by prefix, with a mark on ids that occur more than once."""
    known = samples.dropna(subset=["target_depth", "sex"])
    listed = filters.keep(known, ids, "iid")
    case, control = filters.with_prefix(listed, "iid", "PHOM"), filters.with_prefix(listed, "iid", "PHOM", False)
    both = filters.concat([case.withColumn("grp", F.lit("case")), control.withColumn("grp", F.lit("control"))])
    twice = filters.all_duplicates(both, "iid").select("iid").distinct().withColumn("repeated", F.lit(True))
    return both.join(twice, "iid", "left").select("iid", "sample_id", "grp", "target_depth", F.coalesce("repeated", F.lit(False)).alias("repeated"))
