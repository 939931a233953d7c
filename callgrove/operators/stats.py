"""Statistics of calls by variant, by sample and over whole tables, and reshaping."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrove.shared import sized, written


def names(by: str | list[str] | None) -> list[str]:
    return [] if by is None else [by] if isinstance(by, str) else list(by)


def allele_freq(calls: DataFrame, by: str | list[str] | None = None) -> DataFrame:
    """Alternate alleles, alleles and their share by variant (and group); NULL without a call."""
    got = calls.groupBy("variant_id", *names(by)).agg(F.sum("gt").alias("alt"), F.count("gt").alias("n"))
    return got.select("variant_id", *names(by), F.coalesce("alt", F.lit(0)).cast("long").alias("alt_count"), (2 * F.col("n")).alias("allele_count"), F.try_divide(F.col("alt"), 2.0 * F.col("n")).alias("alt_freq"))


def geno_counts(calls: DataFrame, by: str | list[str] | None = None) -> DataFrame:
    gt = F.col("gt")
    return calls.groupBy("variant_id", *names(by)).agg(F.count_if(gt == 0).alias("hom_ref"), F.count_if(gt == 1).alias("het"), F.count_if(gt == 2).alias("hom_alt"), F.count_if(gt.isNull()).alias("missing"))


def missing_rate(calls: DataFrame, by: list[str], digits: int | None = None) -> DataFrame:
    rate = F.count_if(F.col("gt").isNull()) / F.count("*")
    return calls.groupBy(*by).agg((rate if digits is None else F.round(rate, digits)).alias("f_miss"))


def sample_missing(calls: DataFrame) -> DataFrame:
    return missing_rate(calls, ["sample_id"])


def variant_missing(calls: DataFrame, digits: int | None = None) -> DataFrame:
    return missing_rate(calls, ["variant_id"], digits)


def het_f(calls: DataFrame) -> DataFrame:
    """Inbreeding coefficient of each sample: observed against expected homozygotes at its called variants."""
    freq = allele_freq(calls).where("alt_freq IS NOT NULL").select("variant_id", (1 - 2 * F.col("alt_freq") * (1 - F.col("alt_freq"))).alias("e"))
    got = calls.where("gt IS NOT NULL").join(freq, "variant_id").groupBy("sample_id").agg(F.count_if(F.col("gt") != 1).alias("o_hom"), F.sum("e").alias("e_hom"), F.count("*").alias("n_called"))
    return got.withColumn("f", F.try_divide(F.col("o_hom") - F.col("e_hom"), F.col("n_called") - F.col("e_hom")))


def exact_p(hom_ref: int, het: int, hom_alt: int) -> float | None:
    """Exact Hardy-Weinberg p of one count triple, from running sums of the logs of neighbours' ratios; None without calls."""
    n, rare = hom_ref + het + hom_alt, het + 2 * min(hom_ref, hom_alt)
    if not n:
        return None
    h = np.arange(rare % 2, rare + 1, 2, dtype=np.float64)
    a, b = (rare - h[1:]) / 2 + 1, n - (rare + h[1:]) / 2 + 1  # homozygotes at h - 2
    logs = np.concatenate([[0.0], np.cumsum(np.log(4.0 * a * b / (h[1:] * (h[1:] - 1))))])
    weights = np.exp(logs - logs.max())
    return min(1.0, float(weights[logs <= logs[(het - rare % 2) // 2] + 1e-9].sum() / weights.sum()))


def hwe_exact(counts: DataFrame) -> DataFrame:
    """counts with the exact Hardy-Weinberg p of (hom_ref, het, hom_alt); NULL without calls.

    A narrow map: each triple is evaluated in its row, equal ones of a batch once, so nothing is shuffled or run twice.
    """

    @F.pandas_udf("double")
    def p(hom_ref: pd.Series, het: pd.Series, hom_alt: pd.Series) -> pd.Series:
        triples = list(zip(hom_ref.tolist(), het.tolist(), hom_alt.tolist()))
        known = {t: exact_p(*map(int, t)) for t in set(triples)}
        return pd.Series([known[t] for t in triples], dtype="float64")

    return counts.select(*counts.columns, p("hom_ref", "het", "hom_alt").alias("p"))


def sd_bounds(df: DataFrame, column: str, spec: str = "5sd") -> DataFrame:
    """One row: mean minus and plus so many standard deviations (n - 1)."""
    k = float(spec.removesuffix("sd"))
    return df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd")).select("mean", "sd", (F.col("mean") - k * F.col("sd")).alias("low"), (F.col("mean") + k * F.col("sd")).alias("high"))


def outlier_classes(df: DataFrame, miss: float = 0.05, het: str = "5sd") -> DataFrame:
    """df (f, f_miss) with outlier: pass, f, miss or both; bounds are inside."""
    bounds = sd_bounds(df, "f", het).select("low", "high")
    far, gappy = ~F.col("f").between(F.col("low"), F.col("high")), F.col("f_miss") > miss
    label = F.when(far & gappy, "both").when(far, "f").when(gappy, "miss").otherwise("pass")
    return df.crossJoin(F.broadcast(bounds)).withColumn("outlier", label).drop("low", "high")


def pass_ratio(df: DataFrame, rare: float = 0.01, most: float = 0.04) -> DataFrame:
    """Total, passed and share of variants (maf, f_miss), for low and high MAF and for all."""
    classed = df.withColumn("maf_class", F.when(F.col("maf") >= rare, "high").otherwise("low")).withColumn("ok", F.col("f_miss") < most)
    got = classed.rollup("maf_class").agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"))
    return got.select(F.coalesce("maf_class", F.lit("all")).alias("maf_class"), "total", "passed", F.try_divide(F.col("passed"), F.col("total")).alias("ratio"))


def quadrants(df: DataFrame, control: float = 1e-6, case: float = 1e-10, rare: float = 0.01) -> DataFrame:
    """Counts of (control passes, case passes), by MAF class."""
    a, b = F.coalesce(F.col("p_control") >= control, F.lit(False)), F.coalesce(F.col("p_case") >= case, F.lit(False))
    classed = df.withColumn("maf_class", F.when(F.col("maf") >= rare, "high").otherwise("low"))
    return classed.groupBy("maf_class").agg(F.count_if(a & b).alias("both_pass"), F.count_if(a & ~b).alias("control_only"), F.count_if(~a & b).alias("case_only"), F.count_if(~a & ~b).alias("none_pass"))


def threshold_sweep(calls: DataFrame, samples: DataFrame, field: str, low: int, high: int) -> DataFrame:
    """For each threshold and group the sites where any sample of the group reaches it.

    The largest value of each (site, group) decides, so one histogram of maxima and a running sum from above replace a pass per threshold.
    """
    grouped = calls.join(sized(samples.select("sample_id", "target_depth")), "sample_id").withColumn("grp", F.explode(F.array_compact(F.array(F.lit("ALL"), F.upper("target_depth")))))
    most = grouped.groupBy("variant_id", "grp").agg(F.max(field).alias("v")).where(F.col("v") >= low)
    hist = most.groupBy("grp", F.least("v", F.lit(high)).alias("threshold")).agg(F.count("*").alias("n"))
    places = calls.sparkSession.createDataFrame([(g, t) for g in ("ALL", "15X", "30X") for t in range(low, high + 1)], "grp string, threshold int")
    above = Window.partitionBy("grp").orderBy(F.col("threshold").desc())
    return places.join(F.broadcast(hist), ["grp", "threshold"], "left").select("grp", "threshold", F.sum(F.coalesce("n", F.lit(0))).over(above).alias("sites"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts of equal bins between the extremes (or given bounds), the last one closed; empty bins are left out."""
    rows = df.where(F.col(column).isNotNull())
    if low is None or high is None:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))))
    else:
        rows = rows.where(F.col(column).between(low, high)).withColumns({"__lo": F.lit(float(low)), "__hi": F.lit(float(high))})
    at = F.floor(F.try_divide((F.col(column) - F.col("__lo")) * bins, F.col("__hi") - F.col("__lo")))
    return rows.groupBy(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def share_above(df: DataFrame, column: str, bound: float) -> DataFrame:
    v = F.col(column)
    got = df.agg(F.count_if(v > bound).alias("above"), F.count(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"))
    return got.withColumn("percent", F.try_divide(100.0 * F.col("above"), F.col("total")))


def share_below(df: DataFrame, column: str, bound: float) -> DataFrame:
    return df.agg((100.0 * F.count_if(F.col(column) < bound) / F.count(column)).alias("percent_below"), F.avg(column).alias("mean"))


def af_mse(df: DataFrame) -> DataFrame:
    """Mean squared difference of alt_freq and panel_af with its N, and missing panel values: over all rows and over PASS."""
    square, known = F.pow(F.col("alt_freq") - F.col("panel_af"), 2), F.col("panel_af").isNotNull() & F.col("alt_freq").isNotNull()
    ok = F.col("filter") == "PASS"
    return df.agg(
        F.avg(square).alias("mse_all"), F.count_if(known).alias("n_all"), F.avg(F.when(ok, square)).alias("mse_pass"), F.count_if(known & ok).alias("n_pass"), F.count_if(F.col("panel_af").isNull()).alias("missing"),
    )


def af_grid(df: DataFrame, hwe: list[float], rare: list[float], pass_only: bool = False) -> DataFrame:
    """For each (HWE bound, MAF bound): kept variants, share without panel value, MSE. The grid is small and broadcast; df is pre-aggregated to its cells."""
    spark = df.sparkSession
    rows = df.where("filter = 'PASS'") if pass_only else df
    cell = lambda c, ts: sum((F.when(F.col(c) > t, 1).otherwise(0) for t in ts), F.lit(0))
    cells = rows.groupBy(cell("p", sorted(hwe)).alias("hc"), cell("maf", sorted(rare)).alias("mc")).agg(F.count("*").alias("n"), F.count_if(F.col("panel_af").isNull()).alias("gone"), F.sum(F.pow(F.col("alt_freq") - F.col("panel_af"), 2)).alias("sq"), F.count(F.col("alt_freq") - F.col("panel_af")).alias("k"))
    grid = spark.createDataFrame([(h, m, i + 1, j + 1) for i, h in enumerate(sorted(hwe)) for j, m in enumerate(sorted(rare))], "hwe_t double, maf_t double, hi int, mj int")
    met = F.broadcast(grid).join(cells, (F.col("hc") >= F.col("hi")) & (F.col("mc") >= F.col("mj")), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return met.groupBy("hwe_t", "maf_t").agg(total("n").alias("kept"), F.try_divide(total("gone"), total("n")).alias("missing_rate"), F.try_divide(F.sum("sq"), total("k")).alias("mse"))


def moments(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Mean, standard deviation (n - 1) and median of each group."""
    got = df.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"))
    middle = quantiles(df, column, [0.5], by).select(*[F.col(k).alias(f"__{k}") for k in by], F.col("q")[0].alias("median"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]) if by else F.lit(True)
    return got.join(sized(middle), same, "left").select(*by, "mean", "sd", "median")


def pearson(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(x, y).alias("r"))


def cumulated(values: DataFrame, keys: list[str], column: str, count: str) -> DataFrame:
    """values (keys, column, count and more; a row for each distinct value) with __before, the counts of the group's lesser values, and __all, those of all.

    Ranges of (keys, column) with about as many values each, taken from a sample by Spark, are the partitions, whatever the
    values are: an outlier or a large group changes nothing. Counts of the partitions carry the ranks over; a window takes
    a group's values of one partition, never a group.
    """
    order = [*keys, column]
    numbered = written(values.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "cumulated")
    sums = numbered.groupBy("__part", *keys).agg(F.sum(count).alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions of a group
    bases = written(sums.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__{k}") for k in keys], F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"), F.sum("__s").over(Window.partitionBy(*keys)).alias("__all")), "cumulated-bases")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__part") == F.col("__p"))
    within = Window.partitionBy("__part", *keys).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    met = numbered.join(sized(bases), same)
    return met.withColumn("__before", F.col("__base") + F.coalesce(F.sum(count).over(within), F.lit(0))).select(*values.columns, "__before", "__all")


def quantiles(df: DataFrame, column: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact linear quantiles q (array<double>, one for each of probs) of each group that has a value; NULLs are left out.

    Distinct values are counted and get the ranks that they span; those that hold a wanted rank stay.
    """
    keys = by or ["__one"]
    rows = df.where(F.col(column).isNotNull()).select(*(by or [F.lit(0).alias("__one")]), F.col(column).cast("double").alias("__v"))
    placed = cumulated(rows.groupBy(*keys, "__v").agg(F.count("*").alias("__k")), keys, "__v", "__k")
    rank = lambda p: F.lit(float(p)) * (F.col("__all") - 1)
    asked = F.array(*[F.struct(F.lit(i).alias("i"), rank(p).alias("r"), f(rank(p)).cast("long").alias("at")) for i, p in enumerate(probs) for f in (F.floor, F.ceil)])
    held = F.filter(asked, lambda x: (x["at"] >= F.col("__before")) & (x["at"] < F.col("__before") + F.col("__k")))
    found = placed.select(*keys, "__v", F.inline(held))
    ends = found.groupBy(*keys, "i").agg(F.first("r").alias("r"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((F.ceil("r") - F.col("r")) * F.col("lo") + (F.col("r") - F.floor("r")) * F.col("hi"))
    got = ends.withColumn("v", value).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("q"))
    return got.select(*(by or []), F.transform("q", lambda x: x["v"]).alias("q"))


def box_stats(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Linear quartiles, their distance, and the extreme values within 1.5 of it."""
    q = written(quantiles(df, column, [0.25, 0.5, 0.75], by), "quartiles")
    fenced = df.dropna(subset=by).join(sized(q), by, "left") if by else df.crossJoin(F.broadcast(q))  # one row without groups
    span = F.col("q")[2] - F.col("q")[0]
    v = F.col(column)
    inside = lambda f, ok: f(F.when(ok, v))
    return fenced.groupBy(*by, "q").agg(inside(F.min, v >= F.col("q")[0] - 1.5 * span).alias("whisker_low"), inside(F.max, v <= F.col("q")[2] + 1.5 * span).alias("whisker_high")).select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), span.alias("iqr"), "whisker_low", "whisker_high")


def rank_avg(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Distinct values with their count and average rank within the group."""
    counts = cumulated(df.groupBy(*by, column).agg(F.count("*").alias("n")), by, column, "n")
    return counts.withColumn("rank", F.col("__before") + (F.col("n") + 1) / 2.0).drop("__before", "__all")


def two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal variable."""

    @F.pandas_udf("double")
    def tail(v: pd.Series) -> pd.Series:
        kinds, place = np.unique(v.to_numpy(float), return_inverse=True)
        return pd.Series(np.array([math.erfc(abs(x) / math.sqrt(2)) for x in kinds.tolist()])[place] if len(kinds) else [], dtype="float64")

    return tail(z)


def mann_whitney(df: DataFrame, column: str, by: str, groups: list[str]) -> DataFrame:
    """For each pair of groups U, tie-corrected z with continuity correction, two-sided p, and differences of median and mean.

    Values are counted first; the windows run over distinct values of a pair.
    """
    spark = df.sparkSession
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(groups) for b in groups[i + 1 :]], "g1 string, g2 string")
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(by).alias("g"), F.col(column).alias("v")).agg(F.count("*").alias("n"))
    met = counts.join(F.broadcast(pairs), (F.col("g") == F.col("g1")) | (F.col("g") == F.col("g2")))
    values = met.groupBy("g1", "g2", "v").agg(F.sum(F.when(F.col("g") == F.col("g1"), F.col("n")).otherwise(0)).alias("n1"), F.sum("n").alias("n"))
    ranked = cumulated(values, ["g1", "g2"], "v", "n").withColumn("rank", F.col("__before") + (F.col("n") + 1) / 2.0)
    got = ranked.groupBy("g1", "g2").agg(F.sum(F.col("n1") * F.col("rank")).alias("r1"), F.sum("n1").alias("m1"), F.sum("n").alias("m"), F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"))
    m1, m = F.col("m1").cast("double"), F.col("m").cast("double")
    u = F.col("r1") - m1 * (m1 + 1) / 2
    sd = F.sqrt(m1 * (m - m1) / 12 * ((m + 1) - F.col("ties") / (m * (m - 1))))
    apart = F.abs(u - m1 * (m - m1) / 2) - 0.5
    out = got.select("g1", "g2", u.alias("u"), F.greatest(F.try_divide(apart, sd), F.lit(0.0)).alias("z"))
    middle = written(moments(df.where(F.col(by).isin(groups)), column, [by]).select(by, "median", "mean"), "middles")  # a row for each of the groups
    one, two = middle.toDF("g1", "median1", "mean1"), middle.toDF("g2", "median2", "mean2")
    full = out.join(F.broadcast(one), "g1").join(F.broadcast(two), "g2")
    return full.select("g1", "g2", "u", "z", two_sided(F.col("z")).alias("p"), (F.col("median1") - F.col("median2")).alias("median_diff"), (F.col("mean1") - F.col("mean2")).alias("mean_diff"))


def kde(df: DataFrame, column: str, by: list[str], points: int = 300, bw: float | None = 0.2) -> DataFrame:
    """Gaussian density at evenly spaced points between the extremes of each group; bw scales the standard deviation (None: n**-0.2)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("v")).agg(F.count("*").alias("k"))
    span = df.groupBy(*by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.stddev_samp(column).alias("sd"), F.count(column).alias("n")).where("n > 1 AND sd > 0")
    factor = F.lit(bw) if bw is not None else F.pow(F.col("n"), F.lit(-0.2))
    grid = span.select(*by, "n", (factor * F.col("sd")).alias("h"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1))).alias("point", "x"))
    met = counts.join(F.broadcast(grid), by) if by else counts.crossJoin(F.broadcast(grid))  # a grid of fixed size
    density = F.sum(F.col("k") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("h"), 2))) / F.first(F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return met.groupBy(*by, "point", "x").agg(density.alias("density"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def mean_by(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(column).alias(f"mean_{column}"))


def transpose(df: DataFrame, key: str, values: list[str], keys: list) -> DataFrame:
    """Columns become rows and the listed keys become columns."""
    long = df.unpivot([key], values, "metric", "value")
    return long.groupBy("metric").pivot(key, keys).agg(F.first("value"))


def ravel(df: DataFrame, id_column: str, values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot([id_column], values, name, value)


def parse_key(df: DataFrame, column: str) -> DataFrame:
    """dp, gq, laf, haf and platform from a key such as DP8_GQ20_LAF0.25_HAF0.75_ALL."""
    part = lambda name, kind: F.regexp_extract(column, rf"(?:^|_){name}([0-9.]+)", 1).try_cast(kind).alias(name.lower())
    return df.select("*", part("DP", "int"), part("GQ", "int"), part("LAF", "double"), part("HAF", "double"), F.regexp_extract(column, r"(?:^|_)(ALL|15X|30X)(?:_|$)", 1).alias("platform"))
