"""Filters, joins by id lists and intervals, and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrove.functions.expr import maf
from callgrove.operators import stats
from callgrove.shared import dealt, sized


def filter_pass(variants: DataFrame) -> DataFrame:
    return variants.where("filter = 'PASS'")


def min_ac(calls: DataFrame, least: int = 1) -> DataFrame:
    """Calls at variants whose alternate-allele count reaches a bound."""
    kept = calls.groupBy("variant_id").agg(F.sum("gt").alias("ac")).where(F.col("ac") >= least).select("variant_id")
    return calls.join(kept, "variant_id", "left_semi")


def site_filter(variants: DataFrame, vqslod: float = 10, mq: float = 58.75) -> DataFrame:
    """Both values strictly above their bounds; NULL fails."""
    return variants.where((F.col("vqslod") > vqslod) & (F.col("mq") > mq))


def mask_rule(dp: int = 8, gq: int = 20, laf: float = 0.0, haf: float = 1.0) -> Column:
    """True where a genotype becomes no call; a missing figure never triggers, the balance counts for heterozygotes."""
    low = lambda c, t: F.coalesce(F.col(c) < t, F.lit(False))
    unbalanced = (F.col("gt") == 1) & ((F.col("af") < laf) | (F.col("af") > haf))
    return low("dp", dp) | low("gq", gq) | F.coalesce(unbalanced, F.lit(False))


def mask_calls(calls: DataFrame, dp: int = 8, gq: int = 20, laf: float = 0.0, haf: float = 1.0) -> DataFrame:
    """Weak genotypes set to NULL; all rows stay."""
    return calls.withColumn("gt", F.when(~mask_rule(dp, gq, laf, haf), F.col("gt")))


def mind(calls: DataFrame, most: float = 0.01) -> DataFrame:
    """Calls of samples whose missing rate is within a bound."""
    bad = stats.sample_missing(calls).where(F.col("f_miss") > most).select("sample_id")
    return calls.join(bad, "sample_id", "left_anti")


def geno(calls: DataFrame, most: float = 0.01) -> DataFrame:
    """Calls at variants whose missing rate is within a bound."""
    bad = stats.variant_missing(calls).where(F.col("f_miss") > most).select("variant_id")
    return calls.join(bad, "variant_id", "left_anti")


def maf_filter(calls: DataFrame, least: float = 0.01) -> DataFrame:
    kept = stats.allele_freq(calls).where(maf(F.col("alt_freq")) >= least).select("variant_id")
    return calls.join(kept, "variant_id", "left_semi")


def hwe_filter(calls: DataFrame, least: float = 1e-6) -> DataFrame:
    kept = stats.hwe_exact(stats.geno_counts(calls)).where(F.col("p") >= least).select("variant_id")
    return calls.join(kept, "variant_id", "left_semi")


def pass_hwe(df: DataFrame, mode: str, control: float = 1e-6, case: float = 1e-10) -> DataFrame:
    """Rows that pass in controls, and in cases too in mode case_control; NULL fails."""
    if mode not in ("only_control", "case_control"):
        raise ValueError(f"mode {mode!r} is neither only_control nor case_control")
    fine = F.col("p_control") >= control
    return df.where(fine if mode == "only_control" else fine & (F.col("p_case") >= case))


def polymorphic(df: DataFrame, most: float = 0.04) -> DataFrame:
    """Variants that vary and whose missing rate is strictly below a bound."""
    return df.where((F.col("maf") > 0) & (F.col("f_miss") < most))


def monomorphic(freq: DataFrame) -> DataFrame:
    return freq.where(maf(F.col("alt_freq")) == 0).select("variant_id")


def not_rare(freq: DataFrame, least: float = 0.01) -> DataFrame:
    return freq.where(maf(F.col("alt_freq")) >= least).select("variant_id")


def snps_only(variants: DataFrame) -> DataFrame:
    return variants.where(F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$"))


def chrom_class(chrom: Column) -> Column:
    name = F.regexp_replace(chrom, "^chr", "")
    return F.when(name.rlike("^([1-9]|1[0-9]|2[0-2])$"), "autosome").when(name.isin("X", "Y", "XY", "23", "24", "25"), "sex").when(name.isin("M", "MT", "26"), "mitochondrial").otherwise("other")


def by_chrom_class(variants: DataFrame, wanted: str = "autosome") -> DataFrame:
    return variants.where(chrom_class(F.col("chrom")) == wanted)


def at_positions(variants: DataFrame, positions: DataFrame) -> DataFrame:
    """Variants at listed positions (chrom, pos)."""
    return variants.join(sized(positions.select("chrom", "pos").distinct()), ["chrom", "pos"], "left_semi")


def in_rect(df: DataFrame, groups: list[str], xlim=(-0.025, 0.016), ylim=(-0.025, 0.025)) -> DataFrame:
    """Rows of the groups inside a closed rectangle of the first two components."""
    return df.where(F.col("pc1").between(*xlim) & F.col("pc2").between(*ylim) & F.col("label").isin(groups))


def by_pheno(calls: DataFrame, samples: DataFrame, pheno: int) -> DataFrame:
    return keep(calls, samples.where(F.col("pheno") == pheno), "sample_id")


def by_depth(calls: DataFrame, samples: DataFrame, depth: str) -> DataFrame:
    """Calls of samples of one target depth; ALL keeps every sample."""
    return calls if depth == "ALL" else keep(calls, samples.where(F.lower("target_depth") == depth.lower()), "sample_id")


def with_prefix(df: DataFrame, column: str, prefix: str, wanted: bool = True) -> DataFrame:
    fits = F.col(column).startswith(prefix)
    return df.where(fits if wanted else ~fits)


def central(df: DataFrame, column: str, share: float = 0.95) -> DataFrame:
    """Rows between the outer linear quantiles, both included."""
    low, high = (1 - share) / 2, 1 - (1 - share) / 2
    bounds = stats.quantiles(df, column, [low, high]).withColumnRenamed("q", "__q")  # one row, none without values
    return df.crossJoin(F.broadcast(bounds)).where(F.col(column).between(F.col("__q")[0], F.col("__q")[1])).drop("__q")


def first_ids(df: DataFrame, n: int, column: str = "variant_id") -> DataFrame:
    return df.select(column).distinct().orderBy(column).limit(n)


def keep(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is listed; names that are absent are ignored."""
    names = [on] if isinstance(on, str) else on
    return df.join(ids.select(*names), names, "left_semi")


def exclude(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    names = [on] if isinstance(on, str) else on
    return df.join(ids.select(*names), names, "left_anti")


def exclude_ranges(variants: DataFrame, regions: DataFrame, bin_size: int = 1000) -> DataFrame:
    """Variants inside no interval (chrom, start, end, both included): intervals are dealt to bins, so the join has equal keys."""
    bins = regions.select(F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))).alias("r_bin"))
    inside = (F.col("chrom") == F.col("r_chrom")) & (F.floor(F.col("pos") / bin_size) == F.col("r_bin")) & F.col("pos").between(F.col("r_start"), F.col("r_end"))
    return variants.join(bins, inside, "left_anti")


def align(calls: DataFrame, truth: DataFrame) -> DataFrame:
    return calls.join(truth, ["variant_id", "sample_id"])


def merge_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Calls of both sets at shared variants; a pair that both have keeps equal calls, the only call, or NULL in conflict.

    Both are counted and dealt by variant once, which serves the lookup and the meeting of pairs.
    """
    shared = shared_ids(a, b, "variant_id")
    both = dealt(a.select("variant_id", "sample_id", "gt").unionByName(b.select("variant_id", "sample_id", "gt")), "variant_id")
    return keep(both, shared, "variant_id").groupBy("variant_id", "sample_id").agg(F.when(F.min("gt") == F.max("gt"), F.min("gt")).alias("gt"))


def same_position_ids(variants: DataFrame) -> DataFrame:
    """Ids of variants that share chrom and pos."""
    repeated = variants.groupBy("chrom", "pos").agg(F.count("*").alias("n")).where("n > 1")
    return variants.join(repeated, ["chrom", "pos"], "left_semi").select("variant_id")


def shared_ids(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct ids of both; each side is made distinct before it is shuffled."""
    return a.select(column).distinct().intersect(b.select(column).distinct())


def pair_nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("id1").alias("id")).union(pairs.select("id2")).distinct()


def remaining(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    return nodes.select("id").subtract(removed.select("id"))


def concat(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def all_duplicates(df: DataFrame, key: str) -> DataFrame:
    """All rows of keys that occur more than once."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(key))).where("__n > 1").drop("__n")
