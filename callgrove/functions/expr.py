"""Projections over call-set columns: ids, dosages, fractions, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_id(df: DataFrame, out: str = "id") -> DataFrame:
    """id as chrom:pos:ref:alt."""
    return df.withColumn(out, F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "alt"))


def split_id(df: DataFrame, column: str = "id") -> DataFrame:
    """chrom, pos, ref and alt from an id; a part that is missing or no number is NULL."""
    parts = F.split(column, ":")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    return df.select("*", at(1).alias("chrom"), at(2).try_cast("long").alias("pos"), at(3).alias("ref"), at(4).alias("alt"))


def rename_chrom(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """chrom by a small mapping table (old, new); names outside it stay."""
    named = df.join(F.broadcast(mapping), F.col("chrom") == F.col("old"), "left")
    return named.withColumn("chrom", F.coalesce("new", "chrom")).drop("old", "new")


def strip_chr(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def dosage(gt: Column) -> Column:
    """Alternate alleles of a diploid genotype string, phased or not; NULL for all other strings."""
    alleles = F.split(F.regexp_replace(gt, r"\|", "/"), "/")
    return F.when(gt.rlike(r"^[01][/|][01]$"), alleles[0].cast("int") + alleles[1].cast("int"))


def unphase(gt: Column) -> Column:
    """Alleles in order, with a slash."""
    return F.array_join(F.array_sort(F.split(gt, r"[/|]")), "/")


def clean_num(text: Column) -> Column:
    """A number, or NULL for nan, a dot and whatever is no number; NaN never enters a column."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def allele_fraction(ad: Column) -> Column:
    """Reads of the first alternate allele over all reads; NULL without reads."""
    return F.try_divide(ad[1].cast("double"), F.aggregate(ad, F.lit(0).cast("long"), lambda s, x: s + x).cast("double"))


def maf(freq: Column) -> Column:
    """Minor allele frequency; a frequency above 1 counts as 1, NULL stays NULL."""
    f = F.least(freq, F.lit(1.0))
    return F.when(freq.isNotNull(), F.least(f, 1.0 - f))


def label_prefix(column: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first prefix that fits."""
    out = F.lit(default)
    for prefix, label in reversed(rules):
        out = F.when(column.startswith(prefix), label).otherwise(out)
    return out


def pair_type(a: Column, b: Column) -> Column:
    """case-case, control-control or case-control from two phenotypes (2: case)."""
    return F.when((a == 2) & (b == 2), "case-case").when((a == 1) & (b == 1), "control-control").otherwise("case-control")


def rev_flag(id_: Column, ref: Column, alt: Column) -> Column:
    """YES where ref and alt are the id's alt and ref."""
    parts = F.split(id_, ":")
    return F.when((ref == parts[3]) & (alt == parts[2]), "YES").otherwise("NO")


def prefix_ids(df: DataFrame, prefix: str, columns: tuple[str, ...] = ("fid", "iid")) -> DataFrame:
    return df.withColumns({c: F.concat(F.lit(prefix), c) for c in columns})


def double_id(df: DataFrame) -> DataFrame:
    return df.withColumn("fid", F.col("iid"))


def explained_pct(values: DataFrame, column: str = "eigenvalue") -> DataFrame:
    """Share of each of a few eigenvalues in their sum, in percent."""
    total = values.agg(F.sum(column).alias("total"))
    return values.crossJoin(F.broadcast(total)).withColumn("pct", F.col(column) / F.col("total") * 100).drop("total")


def round_filter(df: DataFrame, column: str, above: float, digits: int = 3) -> DataFrame:
    """Rows whose rounded value is above a bound; the rounded value replaces the column."""
    return df.withColumn(column, F.round(column, digits)).where(F.col(column) > above)


def nearest(df: DataFrame, x: str, y: str, at: tuple[float, float], by: list[str], fields: list[str]) -> DataFrame:
    """For each group the row closest to a point; ties go to the least fields."""
    far = F.sqrt(F.pow(F.col(x) - at[0], 2) + F.pow(F.col(y) - at[1], 2))
    return df.groupBy(*by).agg(F.min(F.struct(far.alias("distance"), *fields)).alias("r")).select(*by, "r.*")


def minmax(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Each column scaled to 0..1 within its group; NULL where all values are equal."""
    w = Window.partitionBy(*by)
    low, high = (lambda c: F.min(c).over(w)), (lambda c: F.max(c).over(w))
    return df.withColumns({f"{c}_scaled": F.try_divide(F.col(c) - low(c), high(c) - low(c)) for c in columns})


def format_gt(gt: Column) -> Column:
    return F.coalesce(gt.cast("string"), F.lit("NA"))


def split_multiallelic(df: DataFrame) -> DataFrame:
    """One row per alternate allele of (alts array, alleles array); dosage counts that allele, NULL if an allele is missing."""
    rows = df.select("*", F.posexplode("alts").alias("k", "alt"))
    count = F.size(F.filter("alleles", lambda a: a == F.col("k") + 1))
    return rows.withColumn("gt", F.when(~F.exists("alleles", lambda a: a.isNull()), count)).drop("k", "alts", "alleles")


def trim_alleles(df: DataFrame) -> DataFrame:
    """pos, ref and alt without shared letters at the end, then at the start; one letter of each stays."""
    ref, alt = F.col("ref"), F.col("alt")
    short = F.least(F.length(ref), F.length(alt))
    steps = F.sequence(F.lit(0), F.greatest(short - 1, F.lit(0)))
    tail = F.array_max(F.filter(steps, lambda n: F.expr("right(ref, 1)").isNotNull() & (F.substring(F.reverse(ref), F.lit(1), n) == F.substring(F.reverse(alt), F.lit(1), n))))
    cut = df.withColumn("__tail", tail).withColumns({"ref": F.expr("left(ref, length(ref) - __tail)"), "alt": F.expr("left(alt, length(alt) - __tail)")}).drop("__tail")
    steps = F.sequence(F.lit(0), F.greatest(F.least(F.length("ref"), F.length("alt")) - 1, F.lit(0)))
    head = F.array_max(F.filter(steps, lambda n: F.substring(F.col("ref"), F.lit(1), n) == F.substring(F.col("alt"), F.lit(1), n)))
    cut = cut.withColumn("__head", head)
    return cut.withColumns({"pos": F.col("pos") + F.col("__head"), "ref": F.expr("substring(ref, __head + 1)"), "alt": F.expr("substring(alt, __head + 1)")}).drop("__head")
