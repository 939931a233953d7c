"""Operators that need the reference sequence, kept as a table of chunks (chrom, chunk, seq)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrove.functions.expr import trim_alleles
from callgrove.shared import written

#: Letters of one chunk of the sequence table; positions count from 1.
CHUNK = 1000


def with_base(df: DataFrame, refseq: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """df (with variant_id) with the reference letters at pos, as many as ref has, in ref_base; NULL where the sequence is not known.

    A ref inside one chunk takes one join; those that cross chunks gather as many as they need.
    """
    first, last = F.floor((F.col("pos") - 1) / chunk).cast("long"), F.floor((F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 2) / chunk).cast("long")
    keyed = df.withColumns({"__first": first, "__last": last})
    at = ((F.col("pos") - 1) % chunk + 1).cast("int")
    seqs = refseq.select("chrom", F.col("chunk").alias("__chunk"), F.col("seq").alias("__seq"))
    inside = keyed.where(F.coalesce(F.col("__first") == F.col("__last"), F.lit(True))).withColumn("__chunk", F.col("__first")).join(seqs, ["chrom", "__chunk"], "left")
    crossing = keyed.where(F.col("__first") < F.col("__last"))
    wanted = crossing.select("variant_id", "chrom", F.explode(F.sequence("__first", "__last")).alias("__chunk")).distinct().join(seqs, ["chrom", "__chunk"])
    gathered = wanted.groupBy("variant_id", "chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__chunk", "__seq"))), lambda x: x["__seq"]), "").alias("__seq"), F.count("*").alias("__n"))
    outside = crossing.join(gathered, ["variant_id", "chrom"], "left").withColumn("__seq", F.when(F.col("__n") == F.col("__last") - F.col("__first") + 1, F.col("__seq")))
    found = [x.withColumn("ref_base", F.col("__seq").substr(at, F.length("ref"))).select(*df.columns, "ref_base") for x in (inside, outside)]
    return found[0].unionByName(found[1])


def fix_ref(variants: DataFrame, calls: DataFrame, refseq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variants with ref and alt swapped where alt is the reference letter, and calls with their dosage turned there."""
    marked = with_base(variants, refseq)
    swap = (F.col("ref") != F.col("ref_base")) & (F.col("alt") == F.col("ref_base"))
    marked = marked.withColumn("swapped", F.coalesce(swap, F.lit(False))).drop("ref_base")
    fixed = marked.withColumns({"ref": F.when(F.col("swapped"), F.col("alt")).otherwise(F.col("ref")), "alt": F.when(F.col("swapped"), F.col("ref")).otherwise(F.col("alt"))})
    flags = marked.select("variant_id", "swapped")
    turned = calls.join(flags, "variant_id", "left").withColumn("gt", F.when(F.col("swapped"), 2 - F.col("gt")).otherwise(F.col("gt"))).drop("swapped")
    return fixed, turned


def shifted(df: DataFrame, refseq: DataFrame, chunk: int) -> DataFrame:
    """One round of shifting: alleles move left inside their chunk; __more tells that they may go on in the chunk before."""
    keyed = df.withColumn("__chunk", F.floor((F.col("pos") - 2) / chunk).cast("long"))  # that of the letter before
    seqs = refseq.select("chrom", F.col("chunk").alias("__chunk"), F.col("seq").alias("__seq"))
    left = F.substring(F.coalesce("__seq", F.lit("")), F.lit(1), ((F.col("pos") - 2) % chunk + 1).cast("int"))
    context = keyed.join(seqs, ["chrom", "__chunk"], "left").withColumn("__left", F.when(F.col("pos") > 1, left).otherwise("")).drop("__chunk", "__seq").withColumn("__more", F.lit(False))

    def shift(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for pos, ref, alt, left in zip(frame["pos"], frame["ref"], frame["alt"], frame["__left"], strict=True):
                more = False
                if ref and alt and len(ref) != len(alt):
                    given = bool(left)
                    while left and ref[-1] == alt[-1]:
                        base = left[-1]
                        ref, alt, pos, left = base + ref[:-1], base + alt[:-1], pos - 1, left[:-1]
                    more = given and not left and pos > 1 and ref[-1] == alt[-1]
                    while not more and len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
                        ref, alt, pos = ref[1:], alt[1:], pos + 1
                rows.append((pos, ref, alt, more))
            frame = frame.drop(columns="__left")
            frame["pos"], frame["ref"], frame["alt"], frame["__more"] = [[r[i] for r in rows] for i in range(4)]
            yield frame

    return context.mapInPandas(shift, context.drop("__left").schema)


def left_align(df: DataFrame, refseq: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Trimmed alleles, with insertions and deletions shifted left as far as the repeat and the known sequence go.

    Each round reads one chunk; alleles that reach its start go into another round, which reads the one before.
    """
    moving, settled = trim_alleles(df), None
    while True:
        got = written(shifted(moving, refseq, chunk), "left-aligned")
        done = got.where(~F.col("__more")).drop("__more")
        settled = done if settled is None else settled.unionByName(done)
        moving = got.where("__more").drop("__more")
        if moving.isEmpty():
            return settled.select(*df.columns)
